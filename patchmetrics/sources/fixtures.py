"""Input tables for the library, derived from the test tables (``FIXTURES.md`` section 2).

The reference ships no data; these derivations stand in for its inputs so that every operator runs on tables
whose size grows with the scale factor:

* ``attempts``: one patch attempt per ``lineitem`` row, file = order;
* ``file_facts``: per-file code statistics per ``orders`` row;
* ``raw_samples``: fenced code samples per ``documents`` row;
* ``doc_lines`` / ``edited_lines``: documents split into lines, and an edited version;
* ``rules`` / ``rule_findings`` / ``nested_spans`` / ``scan_reports``: scanner inputs and outputs;
* ``code_blocks``: block table of a document's lines; ``numbered_findings`` / ``fixture_replies``: the cascade's input.

Derived tables that are expensive (sequence numbers) are written once per session and scale factor under
``spark.checkpoint.dir`` (``sources.store.materialize``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import sequences_within
from .store import materialize, shuffles_freed
from .tables import read_table

_MEMO: dict[tuple, DataFrame] = {}


def memo(spark: SparkSession, sf_dir: str, name: str, build):
    key = (spark.sparkContext.applicationId, id(spark), sf_dir.rstrip("/"), name)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


ATTEMPT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

# Fixed values of the fixture (FIXTURES.md 2.1/2.2).
LEVEL1_MODEL = "alibaba-qwen3-32b"
LEVEL2_MODEL = "deepseek-r1-distill-llama-70b"
UNLISTED_MODEL = "unlisted-model"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw attempts: ``file_uid, vulnerability_id, attempt_seq, level_attempted, model, status, finish_reason,
    prompt_tokens, completion_tokens, total_tokens, llm_time_taken, severity, confidence``."""

    def build():
        li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                     "l_quantity", "l_extendedprice", "l_tax", "l_returnflag",
                                                     "l_linestatus"], spread=False)    # one shuffle, by file, follows
        vid = F.concat(F.lit("B"), (F.lit(100) + (F.col("l_orderkey") * 7 + F.col("l_partkey") % 3) % 20)
                       .cast("string"))
        keyed = li.select(F.col("l_orderkey").alias("file_uid"), vid.alias("vulnerability_id"), *li.columns[1:])
        # row_number() per file and per (file, rule) -- computed without a hot task (operators.sequence).
        seqd = sequences_within(keyed, ["file_uid"], {"attempt_seq": (["file_uid"], ATTEMPT_ORDER),
                                                      "vuln_seq": (["file_uid", "vulnerability_id"], ATTEMPT_ORDER)})
        first = F.col("vuln_seq") == 1
        qty50 = F.col("l_quantity") == 50
        p = F.when(qty50, F.lit(None)).otherwise(F.floor(F.col("l_quantity") * 40).cast("bigint")
                                                 + F.col("l_partkey") % 97)
        c = F.when(qty50, F.lit(None)).otherwise(F.floor(F.col("l_extendedprice")).cast("bigint") % 3000)
        out = seqd.select(
            "file_uid", "vulnerability_id", F.col("attempt_seq").cast("bigint").alias("attempt_seq"),
            F.when(first, 1).otherwise(2).alias("level_attempted"),
            F.when(F.col("l_suppkey") % 10 == 0, F.lit(UNLISTED_MODEL)).when(first, F.lit(LEVEL1_MODEL))
            .otherwise(F.lit(LEVEL2_MODEL)).alias("model"),
            F.when(qty50, F.lit("error")).when(F.col("l_linestatus") == "F", F.lit("success"))
            .when(first, F.lit("failed_level_1")).otherwise(F.lit("failed_level_2")).alias("status"),
            F.when(F.col("l_tax") == 0.08, F.lit("Syntax error in reply")).when(qty50, F.lit("timeout"))
            .otherwise(F.lit("stop")).alias("finish_reason"),
            p.alias("prompt_tokens"), c.alias("completion_tokens"),
            (F.coalesce(p, F.lit(0)) + F.coalesce(c, F.lit(0))).alias("total_tokens"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("llm_time_taken"),
            F.when(F.col("l_returnflag") == "A", "HIGH").when(F.col("l_returnflag") == "N", "MEDIUM")
            .otherwise("LOW").alias("severity"),
            F.when(F.col("l_partkey") % 2 == 0, "HIGH").otherwise("MEDIUM").alias("confidence"),
        )
        with shuffles_freed(spark):
            return materialize(out, "attempts")

    return memo(spark, sf_dir, "attempts", build)


def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"])
    cc = lambda c: ((F.lit(10) + c % 90).cast("double") / 10).cast("decimal(6,2)")
    return o.select(
        F.col("o_orderkey").alias("file_uid"), F.col("o_orderpriority").alias("dataset"),
        (F.lit(20) + F.col("o_custkey") % 300).alias("loc_before"),
        (F.lit(20) + (F.col("o_custkey") + F.col("o_orderkey")) % 300).alias("loc_after"),
        cc(F.col("o_custkey")).alias("cc_before"), cc(F.col("o_orderkey")).alias("cc_after"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_custkey") % 40)
        .alias("normalized_loc_churn"),
        (F.col("o_orderkey") % 120).alias("ast_churn"), (F.col("o_orderkey") % 4).alias("vuln_count_after"))


def raw_samples(spark: SparkSession, sf_dir: str, source_order: bool = False) -> DataFrame:
    """Fenced samples; ``source_order`` reads the files as they are split, with the columns of their order."""
    from .io import ORDER_COLS, with_source_order
    if source_order:
        d = with_source_order(read_table(spark, sf_dir, "documents", spread=False)).select("doc_id", "lang", "text", *ORDER_COLS)
    else:
        d = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "text"])
    nl = F.lit("\n")
    chosen = (F.when(F.col("doc_id") % 7 == 0, F.lit("```python\n   \n```"))
              .when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```python\n"), F.col("text"), F.lit("\n```")))
              .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```"), nl, F.col("text"), nl, F.lit("```  ")))
              .otherwise(F.col("text")))
    return d.select("doc_id", "lang", chosen.alias("chosen"), *(ORDER_COLS if source_order else []))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return (d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
            .select("doc_id", (F.col("pos") + 1).alias("line_no"), "line"))


def edited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The "after" text: every line with ``line_no % 7 == 3`` deleted, ``line_no % 5 == 2`` upper-cased."""
    return (doc_lines(spark, sf_dir).filter(F.col("line_no") % 7 != 3)
            .select("doc_id", "line_no",
                    F.when(F.col("line_no") % 5 == 2, F.upper("line")).otherwise(F.col("line")).alias("line")))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the form of source code, one per document line: decorated and nested functions, classes, comments, blanks."""
    dl = doc_lines(spark, sf_dir)
    n, k = F.col("line_no"), F.pmod(F.col("line_no") * 7 + F.col("doc_id"), F.lit(17))
    number = lambda prefix, suffix: F.concat(F.lit(prefix), n.cast("string"), F.lit(suffix))
    line = (F.when(k == 0, number("@mark", "")).when(k == 1, number("def f", "(a):")).when(k == 5, number("    def g", "(b):"))
            .when(k == 8, number("        # note ", "")).when(k == 9, F.lit("")).when(k == 11, number("x", " = 1"))
            .when(k == 12, number("    async def h", "(c):")).when(k == 14, number("class C", ":"))
            .otherwise(F.concat(F.repeat(F.lit(" "), (F.lit(4) * (1 + k % 3)).cast("int")), number("v", " = "), F.length("line").cast("string"))))
    return dl.select("doc_id", "line_no", line.alias("line"))


def moved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited text with every line of ``line_no % 9 = 4`` moved six lines down."""
    edited = edited_lines(spark, sf_dir)
    return edited.withColumn("line_no", F.col("line_no") * 10 + F.when(F.col("line_no") % 9 == 4, F.lit(65)).otherwise(F.lit(0)))


def line_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of line ranges, some overlapping and some of one range: lines with vowels upper-cased, two new lines, insertions."""
    dl = doc_lines(spark, sf_dir)
    n = F.col("line_no")
    kinds = F.filter(F.array(
        F.when(n % 7 == 3, F.struct(F.lit(1).alias("k"), (n + F.col("doc_id") % 4).cast("int").alias("e"),
                                   F.translate("line", "aeiou", "AEIOU").alias("b"))),
        F.when(n % 11 == 5, F.struct(F.lit(2).alias("k"), (n + 1).alias("e"), F.lit("spliced\ntwice").alias("b"))),
        F.when(n % 13 == 1, F.struct(F.lit(3).alias("k"), (n - 1).alias("e"), F.lit("").alias("b")))), lambda x: x.isNotNull())
    return dl.select("doc_id", "line_no", F.explode(kinds).alias("x")).select(
        "doc_id", (F.col("line_no") * 10 + F.col("x.k")).alias("patch_seq"), F.col("line_no").alias("start_line"),
        F.col("x.e").alias("end_line"), F.col("x.b").alias("block"))


# Fixed rule table of the fixture (FIXTURES.md 2.4).
RULES = [
    ("R001", "HIGH", 'token = "[0-9a-f]{40}"'),
    ("R002", "LOW", "License"),
    ("R003", "MEDIUM", "[a-z0-9.]+@[a-z]+"),
]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "test_id string, severity string, pattern string")


def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large catalogue: one rule per distinct word of three letters or more in the ``benchmark`` texts."""
    words = read_table(spark, sf_dir, "benchmark", ["text"], spread=False).select(
        F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), 0)).alias("w")).where("length(w) >= 3").distinct()
    return words.select(F.concat(F.lit("W-"), "w").alias("test_id"), F.lit("LOW").alias("severity"),
                        F.concat("w", F.lit("[a-z]* [a-z]+")).alias("pattern"))


def rule_findings(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    from ..operators.findings import scan_lines
    return scan_lines(doc_lines(spark, sf_dir) if lines is None else lines, rules(spark))


def nested_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    dl = doc_lines(spark, sf_dir)
    outer = dl.filter(F.col("line_no") % 10 == 1).select("doc_id", F.col("line_no").alias("start_line"),
                                                         (F.col("line_no") + 9).alias("end_line"))
    inner = dl.filter(F.col("line_no") % 10 == 4).select("doc_id", F.col("line_no").alias("start_line"),
                                                         (F.col("line_no") + 2).alias("end_line"))
    return outer.unionByName(inner)


def scan_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", ["doc_id"])
    s = lambda c: c.cast("string")
    report = F.concat(
        F.lit('{"results":[{"test_id":"B'), s(100 + F.col("doc_id") % 20), F.lit('","issue_severity":"HIGH","line_range":['),
        s(1 + F.col("doc_id") % 9), F.lit(","), s(3 + F.col("doc_id") % 9),
        F.lit('],"more_info":"https://b.example/en/1.9.2/x.html"},{"test_id":"B'), s(100 + F.col("doc_id") % 7),
        F.lit('","issue_severity":"LOW","line_range":[2]}]}'))
    return d.select("doc_id", F.when(F.col("doc_id") % 50 == 0, F.lit("not json"))
                    .when(F.col("doc_id") % 50 == 1, F.lit('{"errors":[]}')).otherwise(report).alias("report"))


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block table ``(doc_id, name, complexity)``: ten lines to a block, complexity 1 + its lines holding ``the``."""
    dl = doc_lines(spark, sf_dir)
    block = F.floor((F.col("line_no") - 1) / 10).cast("int")
    return (dl.groupBy("doc_id", block.alias("b")).agg((F.count_if(F.col("line").contains("the")) + 1).alias("complexity"))
            .select("doc_id", F.concat(F.lit("b"), F.col("b").cast("string")).alias("name"), "complexity"))


def numbered_findings(spark: SparkSession, sf_dir: str, with_line: bool = False) -> DataFrame:
    """Rule findings with a ``finding_id`` (line and rule number) and, on request, their line text as ``line``."""
    from ..operators.findings import scan_lines
    found = scan_lines(doc_lines(spark, sf_dir), rules(spark), keys=("doc_id", "line_no", "line"))
    fid = F.col("line_no").cast("bigint") * 1000 + F.substring("test_id", 2, 3).cast("int")
    return found.select("doc_id", fid.alias("finding_id"), "test_id", F.col("line_no").alias("line_num"), "severity",
                        F.lit("HIGH").alias("confidence"), *(["line"] if with_line else []))


def fixture_replies(prompts: DataFrame) -> DataFrame:
    """Replies to patch prompts: level 1 masks e-mail addresses, leaves licence lines (they escalate) and does not
    answer token findings (errored attempts); level 2 also rewrites licence lines."""
    masked = F.regexp_replace("code_snippet", RULES[2][2], "[email]")
    out = (F.when(F.col("test_id") == "R001", F.lit(None))
           .when(F.col("level") >= 2, F.replace(masked, F.lit("License"), F.lit("licence")))
           .when(F.col("test_id") == "R003", masked).otherwise(F.col("code_snippet")))
    reply = F.concat(F.lit("```python\n"), out, F.lit("\n```"))
    return prompts.select("doc_id", "finding_id", "level", reply.alias("reply"), F.lit("stop").alias("finish_reason"),
                          F.length("code_snippet").cast("bigint").alias("prompt_tokens"),
                          F.length(reply).cast("bigint").alias("completion_tokens"), F.lit(0.5).alias("duration_s"))
