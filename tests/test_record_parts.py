"""A1 / A10 in parts: bounded, complete, and the same report as from whole records."""

import pytest
from pyspark.sql import functions as F

from patchmetrics.operators import audit, record_parts, report
from patchmetrics.plans import audit_pipeline as ap
from patchmetrics.sources import fixtures

from .conftest import SF_SMALL


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_parts_put_together_are_the_records(spark, size):
    priced, facts = ap.priced_attempts(spark, SF_SMALL), fixtures.file_facts(spark, SF_SMALL)
    stamp = F.lit("1970-01-01T00:00:00")
    parts = record_parts.build_audit_log_parts(priced, facts, size, timestamp=stamp).cache()
    chains = {}
    for r in parts.collect():
        assert sum(len(t["attempts"]) for t in r["vulnerabilities"]) <= size
        chains.setdefault(r["meta"]["file_uid"], []).append(r.asDict(recursive=True))
    for r in audit.build_audit_log(priced, facts, timestamp=stamp).collect():
        whole, chain = r.asDict(recursive=True), sorted(chains[r["meta"]["file_uid"]], key=lambda x: x["part"])
        assert [p["part"] for p in chain] == list(range(chain[0]["n_parts"])) and not chain[0]["continues"]
        traces = []
        for p in chain:
            own = p["vulnerabilities"]
            if p["continues"]:
                assert {**own[0], "attempts": 0} == {**traces[-1], "attempts": 0}
                traces[-1]["attempts"] += own[0]["attempts"]
                own = own[1:]
            traces += own
        together = {**chain[0], "vulnerabilities": traces}
        assert {k: together[k] for k in whole} == whole
    assert len(chains) == facts.count()
    want = sorted(map(str, report.kpi_report(ap.build_log(spark, SF_SMALL)).collect()))
    assert sorted(map(str, record_parts.kpi_report_of_parts(parts).collect())) == want
    parts.unpersist()


def test_a_hot_file_is_many_rows(spark):
    """One file with a third of all attempts, one trace of it with most of them."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 999 + 100).alias("file_uid"),
        F.when(F.col("id") % 15 == 0, "B2").otherwise("B1").alias("vulnerability_id"), F.col("id").alias("attempt_seq"), F.lit(1).alias("level_attempted"),
        F.lit("m").alias("model"), F.when(F.col("id") % 7 == 0, "success").otherwise("failed_level_1").alias("status"), F.lit("stop").alias("finish_reason"),
        F.lit(5).alias("prompt_tokens"), F.lit(6).alias("completion_tokens"), F.lit(11).alias("total_tokens"), F.lit(0.5).alias("llm_time_taken"),
        F.lit("LOW").alias("severity"), F.lit("HIGH").alias("confidence"))
    facts = rows.select("file_uid").distinct().select(
        "file_uid", *[F.lit(2).alias(c) for c in ("loc_before", "loc_after", "normalized_loc_churn", "ast_churn", "vuln_count_after")],
        *[F.lit(1.5).alias(c) for c in ("cc_before", "cc_after")])
    priced = audit.price_attempts(audit.normalize_attempts(rows))
    parts = record_parts.build_audit_log_parts(priced, facts, 500).cache()
    sizes = parts.select("meta.file_uid", F.aggregate("vulnerabilities", F.lit(0), lambda a, t: a + F.size(t["attempts"])).alias("n")).toPandas()
    assert sizes["n"].max() <= 500 and (sizes["file_uid"] == "7").sum() == 20 and sizes["n"].sum() == 30_000
    flat = audit.long_form_log(priced, facts)
    want = sorted(map(str, report.kpi_report_flat(*flat, restrict_to_valid=True).collect()))
    assert sorted(map(str, record_parts.kpi_report_of_parts(parts).collect())) == want
    parts.unpersist()
