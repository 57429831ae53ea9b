"""C3 + C4 wired on the fixture tables: attempts -> priced attempts -> traces / nested log -> report inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import audit, report
from ..sources import fixtures


def priced_attempts(spark: SparkSession, sf_dir: str, pricing=None) -> DataFrame:
    norm = audit.normalize_attempts(fixtures.attempts(spark, sf_dir))
    return audit.price_attempts(norm, pricing)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.vuln_traces(priced_attempts(spark, sf_dir))


def build_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested audit log, one record per order (file); dataset = order priority, fixed timestamp."""
    from pyspark.sql import functions as F
    return audit.build_audit_log(priced_attempts(spark, sf_dir), fixtures.file_facts(spark, sf_dir),
                                 timestamp=F.lit("1970-01-01T00:00:00"))


def long_form(spark: SparkSession, sf_dir: str, stored: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The report's input, built from the attempts anew: ``(files, traces of valid files, attempts of valid files)``.

    Flat rows only: no nested record of a hot file is ever built, shuffled or read for the report. ``stored`` writes the
    traces and files first, for a report that uses all three tables: both are read more than once.
    """
    from ..sources.store import materialize

    priced = priced_attempts(spark, sf_dir)
    by_trace = materialize(audit.vuln_traces(priced), "report_traces") if stored else None
    files, vulns, attempts = audit.long_form_log(priced, fixtures.file_facts(spark, sf_dir), traces=by_trace)
    if stored:
        files = materialize(files, "report_files")
    return files, report.of_valid_files(files, vulns), report.of_valid_files(files, attempts)


def valid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.valid_files(report.as_records(long_form(spark, sf_dir)[0]))
