"""S6 + C4: repeated, failed and competing appends; the report of the states equals the report of all records."""

import os

import pytest
from pyspark.sql import functions as F

from patchmetrics.operators import report
from patchmetrics.plans import audit_pipeline as ap
from patchmetrics.sources import log_store

from .conftest import SF_SMALL
from .test_report import LOG, log_df


def rows(df):
    return sorted(map(str, df.collect()))


def test_report_of_batches_equals_the_report_of_all_records(spark, tmp_path):
    log = ap.build_log(spark, SF_SMALL).cache()
    path, parts = str(tmp_path / "log"), [log.where(F.crc32(F.col("meta.file_uid").cast("string")) % 4 == b) for b in range(4)]
    for b, part in enumerate(parts[:3]):
        assert log_store.append_batch(part, path, f"b{b}")
    before = rows(log_store.report_of_batches(spark, path))
    assert not log_store.append_batch(parts[1], path, "b1")                       # a repeated append changes nothing
    assert rows(log_store.report_of_batches(spark, path)) == before
    assert before == rows(report.kpi_report(log_store.read_batches(spark, path)))
    assert log_store.append_batch(parts[3], path, "b3")
    assert rows(log_store.report_of_batches(spark, path)) == rows(report.kpi_report(log))
    plan = log_store.report_of_batches(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "json" not in plan.lower()                                             # no record is read
    log.unpersist()


def test_a_record_without_vulnerabilities_counts_once_another_batch_makes_its_file_valid(spark, tmp_path):
    twin = {**LOG[1], "meta": {**LOG[1]["meta"], "file_uid": LOG[0]["meta"]["file_uid"]},
            "input_stats": {**LOG[1]["input_stats"], "vuln_count": 0}, "vulnerabilities": LOG[0]["vulnerabilities"]}
    stray = {**twin, "meta": {**twin["meta"], "file_uid": "never valid"}}
    for order in ([[twin, stray], [LOG[0]], LOG[1:]], [LOG, [twin], [stray]]):
        path = str(tmp_path / f"log{len(order[0])}")
        for b, part in enumerate(order):
            log_store.append_batch(log_df(spark, part), path, f"b{b}")
        want = report.kpi_report(log_df(spark, [r for part in order for r in part]))
        assert rows(log_store.report_of_batches(spark, path)) == rows(want)


def test_failed_and_competing_appends(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    with pytest.raises(ValueError):
        log_store.report_of_batches(spark, path)
    log_store.append_batch(log_df(spark, LOG[:1]), path, "b0")
    monkeypatch.setattr(log_store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("driver died")))
    with pytest.raises(RuntimeError):
        log_store.append_batch(log_df(spark, LOG[1:]), path, "b1")
    monkeypatch.undo()
    assert log_store.committed(spark, path).keys() == {"b0"} and log_store.read_batches(spark, path).count() == 1   # nothing visible
    assert log_store.append_batch(log_df(spark, LOG[1:]), path, "b1")
    os.makedirs(f"{path}/batches/late")
    assert not log_store.commit(spark, path, "b1", "batches/late") and not os.path.exists(f"{path}/batches/late")
    assert log_store.read_batches(spark, path).count() == len(LOG)
    for bad in ("", "a/b", "_x", ".x"):
        with pytest.raises(ValueError):
            log_store.append_batch(log_df(spark, LOG), path, bad)


def test_a_batch_is_parsed_once(spark):
    """No state of a batch reads its JSON again."""
    from patchmetrics.schemas import AUDIT_LOG_DDL

    log = spark.range(3).select(F.lit(None).cast(f"struct<{AUDIT_LOG_DDL}>").alias("x")).select("x.*")
    read = [t.inputFiles() for t in log_store._states(log).values()]
    assert all(read) and all("batch_marked" in f for files in read for f in files)


def _files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_an_append_leaves_its_packed_batch_and_nothing_else(spark, tmp_path, monkeypatch):
    """The lines are gzipped, and no table that served a batch's states stays, also when the append fails."""
    from patchmetrics.session import ensure_checkpoint_dir

    shared = ensure_checkpoint_dir(spark).removeprefix("file:")
    many = [{**r, "meta": {**r["meta"], "file_uid": f"{r['meta']['file_uid']}{i}"}} for i in range(300) for r in LOG]
    plain, path, before = str(tmp_path / "plain"), str(tmp_path / "log"), _files(shared)
    log_df(spark, many).coalesce(1).write.json(plain)
    assert log_store.append_batch(log_df(spark, many).coalesce(1), path, "b0")
    lines = {f for f in _files(path) if os.path.basename(os.path.dirname(f)) == "log"}
    assert lines and all(f.endswith(".json.gz") for f in lines)
    assert sum(map(os.path.getsize, lines)) * 5 < sum(map(os.path.getsize, _files(plain)))
    assert rows(log_store.read_batches(spark, path)) == rows(log_df(spark, many))
    assert _files(shared) == before
    states = log_store._states
    monkeypatch.setattr(log_store, "_states", lambda *a: (states(*a), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        log_store.append_batch(log_df(spark, LOG), path, "b1")
    assert _files(shared) == before


def test_shuffles_of_a_write_go_when_it_ends(spark):
    from patchmetrics.sources import store

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with pytest.raises(KeyError), store.shuffles_freed(spark):
        assert spark.conf.get(key) == "true"
        raise KeyError
    assert spark.conf.get(key) == "false"


def test_records_without_id_or_count_are_of_no_valid_file(spark, tmp_path):
    """Only records with both settle their file; the others are of a valid file when another record of it is."""
    uid = lambda r, u: {**r, "meta": {**r["meta"], "file_uid": u}}
    count = lambda r, n: {**r, "input_stats": {**r["input_stats"], "vuln_count": n}}
    log = [*LOG, uid(LOG[0], None), count(LOG[0], None), count(uid(LOG[3], "d"), None), count(uid(LOG[3], None), 0), LOG[2], LOG[0]]
    path = str(tmp_path / "log")
    log_store.append_batch(log_df(spark, log), path, "b0")
    assert rows(log_store.report_of_batches(spark, path)) == rows(report.kpi_report(log_df(spark, log)))


def test_a_batch_of_the_nested_log_nests_its_own_files_only(spark):
    """The filter of a batch stands below the shuffles of both the attempts and the file facts."""
    log = ap.build_log(spark, SF_SMALL)
    plan = log.where(F.pmod(F.col("meta.file_uid").cast("long"), F.lit(3)) == 1)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    filters = [i for i, x in enumerate(lines) if "pmod" in x]
    assert len(filters) == 2 and all("Relation" in lines[i + 1] for i in filters)
