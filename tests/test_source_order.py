"""P3 in the order of the source files: row counts per split, no row moved."""

import json

from pyspark.sql import functions as F

from patchmetrics.operators.corpus import index_by_source_order, prepare_corpus
from patchmetrics.queries import REGISTRY
from patchmetrics.sources import io

from .conftest import SF_SMALL


def corpus(spark, folder, files=5, rows=400):
    """Files of many splits, in a name order that is not the order of their sizes."""
    want = []
    for f in range(files):
        with open(folder / f"part-{(f * 3) % files}.jsonl", "w") as out:
            for i in range(rows // (f + 1)):
                out.write(json.dumps({"lang": "python" if (i * 7 + f) % 3 else "js", "chosen": f"{f} {i} " + "x" * (i % 50)}) + "\n")
                if i % 17 == 0:
                    out.write("\n")
    for path in sorted(folder.iterdir()):
        want += [json.loads(x) for x in path.read_text().splitlines() if x.strip()]
    return [r["chosen"] for r in want if r["lang"] == "python"]


def test_ids_are_the_row_numbers_of_the_filtered_files(spark, tmp_path):
    want = corpus(spark, tmp_path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size, cost in ((2000, 0), (7000, 5000), (1 << 27, 1 << 22)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", str(cost))
            kept = io.read_corpus_jsonl(spark, str(tmp_path)).where("lang = 'python'")
            assert size > 10_000 or kept.select(*io.ORDER_COLS).distinct().count() > 5
            out = index_by_source_order(kept, "idx")
            got = sorted((r["idx"], r["chosen"]) for r in out.collect())
            assert got == list(enumerate(want))
            assert sorted((r["idx"], r["chosen"]) for r in out.where("idx % 2 = 1").collect()) == got[1::2]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_exchange_carries_text(spark):
    plan = REGISTRY["corpus_prepare"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "RoundRobin" not in plan


def test_parquet_files_and_no_rows(spark, tmp_path):
    spark.range(1000).select("id", F.lit("python").alias("lang"), F.concat(F.lit("v"), "id").alias("chosen")).repartition(4) \
        .write.parquet(str(tmp_path / "p"))
    df = io.with_source_order(spark.read.parquet(str(tmp_path / "p")))
    rows = prepare_corpus(df, "python", "chosen", io.ORDER_COLS).collect()
    assert sorted(r["sample_id"] for r in rows) == list(range(1000))
    by_file = {}
    for r in sorted(rows, key=lambda r: r["sample_id"]):
        by_file.setdefault(r["_src_file"], []).append(r["id"])
    for path, ids in by_file.items():
        assert ids == [r["id"] for r in spark.read.parquet(path).collect()]
    assert list(by_file) == sorted(by_file)
    assert prepare_corpus(df, "none", "chosen", io.ORDER_COLS).collect() == []
