"""S5 / S7 through the data source: round trip, versions, and nothing visible from failed or unfinished writes."""

import os

import pytest
from pyspark.sql import functions as F

from patchmetrics.operators import corpus
from patchmetrics.sources import bundles, fixtures, io

from .conftest import SF_SMALL

FILES = "filename string, code string"


def contents(spark, path):
    return {r["filename"]: r["code"] for r in bundles.read_files(spark, path).collect()}


def test_round_trip_of_the_prepared_corpus(spark, tmp_path):
    prepared = corpus.prepare_corpus(fixtures.raw_samples(spark, SF_SMALL, source_order=True), "en", "chosen", io.ORDER_COLS).repartition(6)
    path = str(tmp_path / "out")
    bundles.write_files(prepared, path)
    want = {r["filename"]: r["code"] for r in prepared.select("filename", "code").collect()}
    assert contents(spark, path) == want and len(want) > 50
    assert len(os.listdir(f"{path}/bundles")) <= 12                 # two files a task, not one a sample
    one = bundles.bundle_index(spark, path).where(F.col("filename") == min(want))
    assert [tuple(r) for r in bundles.read_files(spark, path, one).collect()] == [(min(want), want[min(want)])]


def test_patched_files_replace_their_samples_and_overwrite_replaces_all(spark, tmp_path):
    path = str(tmp_path / "out")
    bundles.write_files(spark.createDataFrame([("a.py", "x = 1\n"), ("b.py", ""), ("ü 😀.py", "y"), ("n.py", None)], FILES), path)
    bundles.write_files(spark.createDataFrame([("a.py", "x = 2\r\n")], FILES), path)
    assert contents(spark, path) == {"a.py": "x = 2\r\n", "b.py": "", "ü 😀.py": "y", "n.py": ""}
    bundles.write_files(spark.createDataFrame([], FILES), path)
    assert len(contents(spark, path)) == 4
    bundles.write_files(spark.createDataFrame([("c.py", "z")], FILES), path, "overwrite")
    assert contents(spark, path) == {"c.py": "z"}


def test_a_failing_task_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "out")
    assert contents(spark, path) == {}
    bundles.write_files(spark.createDataFrame([("a.py", "old")], FILES), path)
    rows = [(f"f{i}.py" if i != 77 else None, "new") for i in range(100)]
    with pytest.raises(Exception, match="needs a name"):
        bundles.write_files(spark.createDataFrame(rows, FILES).repartition(5), path, "overwrite")
    assert contents(spark, path) == {"a.py": "old"}
    writer = bundles.BundleWriter(path, False)          # a task that ran, of a job that was never committed
    message = writer.write(iter([{"filename": "late.py", "code": "x"}]))
    assert contents(spark, path) == {"a.py": "old"}
    writer.abort([message, None])
    assert not any(message.bundle in f for f in os.listdir(f"{path}/bundles"))


def test_a_changed_bundle_is_noticed(spark, tmp_path):
    path = str(tmp_path / "out")
    bundles.write_files(spark.createDataFrame([("a.py", "text")], FILES), path)
    (name,) = [f for f in os.listdir(f"{path}/bundles") if f.endswith(".bin")]
    with open(f"{path}/bundles/{name}", "wb") as f:
        f.write(b"tex?")
    with pytest.raises(Exception, match="as it was written"):
        contents(spark, path)
    with pytest.raises(Exception, match="missing"):
        spark.createDataFrame([(1,)], "x int").write.format(bundles.FORMAT).mode("append").save(path)
