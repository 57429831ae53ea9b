"""Small contracts: token-usage map (X16), report rendering (X11), input spreading, materialised tables."""

from pyspark.sql import functions as F

from patchmetrics.operators import audit, report
from patchmetrics.sources.store import materialize
from patchmetrics.sources.tables import ensure_parallelism


def test_tokens_from_usage_map(spark):
    df = spark.createDataFrame([(1, {"prompt_tokens": 5, "completion_tokens": 7, "total_tokens": 12}),
                                (2, {"total": 0})], "id int, token_usage map<string,bigint>")
    rows = {r.id: r for r in audit.tokens_from_usage_map(df).collect()}
    assert (rows[1].prompt_tokens, rows[1].completion_tokens, rows[1].total_tokens) == (5, 7, 12)
    assert (rows[2].prompt_tokens, rows[2].total_tokens) == (None, None)     # error rows -> defaults later


def test_render_report_lines(spark):
    rows = [("effectiveness", "vuln_fix_rate", None, 2, 3, 66.66666), ("tiers", "level_success_rate", "2", 0, 0, None),
            ("cost", "cost_per_fix", None, 1, 2, 0.5), ("quality", "avg_complexity_change", None, 1, 2, 0.25),
            ("rule", "success_rate_pct", "B101", 1, 3, 33.3)]
    df = spark.createDataFrame(rows, "section string, metric string, key string, numerator long, "
                                     "denominator long, value double")
    df = df.withColumn("numerator", F.col("numerator").cast("decimal(38,6)")) \
        .withColumn("denominator", F.col("denominator").cast("decimal(38,6)"))
    lines = [r.line for r in report.render_report(df).collect()]
    assert lines[0].endswith("66.67% (2/3)") and lines[1].endswith("N/A (No attempts)")
    assert lines[2].endswith("$0.5000") and lines[3].endswith("+0.25")
    assert lines[4].startswith("B101") and "33.3%" in lines[4]


def test_spread_and_materialize(spark):
    one = spark.range(0, 1000, numPartitions=1).withColumnRenamed("id", "k")
    spread = ensure_parallelism(one, "k")
    assert spread.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, numPartitions=spark.sparkContext.defaultParallelism)
    assert ensure_parallelism(many) is many                                   # enough splits: untouched
    stored = materialize(spread.withColumn("x", F.col("k") * 2), "t")
    assert stored.count() == 1000 and stored.agg(F.sum("x")).first()[0] == 999000


def test_sloc_leaves_out_blank_and_comment_lines(spark):
    from patchmetrics.operators.churn import code_stats
    text = ["a = 1", "", "  ", "# note", "\t# note", "b  # tail", "#", "x"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)] + [(2, 0, "-- sql"), (2, 1, "# md")], "doc_id long, line_no int, line string")
    blocks = spark.createDataFrame([(1, "f", 3), (1, "g", 4)], "doc_id long, name string, complexity long")
    got = {r.doc_id: (float(r.avg_cyclomatic_complexity), r.n_blocks, r.sloc) for r in code_stats(blocks, lines).collect()}
    assert got == {1: (3.5, 2, 3), 2: (0.0, 0, 1)}
    assert {r.doc_id: r.sloc for r in code_stats(blocks, lines, comment="--").collect()} == {1: 6, 2: 1}
