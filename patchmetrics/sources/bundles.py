"""Many small files as indexed bundles, written by a Python data source and visible only once committed.

One file per sample is a small-files trap. Here each task streams its samples into one bundle (the bytes one after the
other) with an index beside it (one JSON line per file: name, offset, length, CRC-32). Spark's commit protocol decides what
counts: a task hands the driver the name of its bundle, and only when all tasks are done does the driver write a manifest,
``manifest-<version>.json``, which names the bundles of that version. Readers go by the highest manifest, so

* a failed task, a failed job or a repeated task attempt leaves nothing visible (what it wrote is deleted where Spark says
  that it failed, and is named by no manifest anyway);
* ``overwrite`` publishes the new bundles instead of the old ones, ``append`` beside them; of several files of one name the
  one of the latest version counts, which is how patched code replaces its sample;
* a single file is read by its index row, without its bundle's other bytes.

Paths are those of ``pyarrow.fs`` (local, ``file:``, ``hdfs:``, ``s3:``, ``gs:``) and must be shared storage on a cluster.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "sample_bundles"
INDEX = "filename string, offset bigint, length bigint, crc32 bigint"
_READ = pa.schema([("filename", pa.string()), ("code", pa.string())])


def open_path(path: str):
    """``(file system, path)`` of pyarrow for a Spark path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.rstrip("/"))


@dataclass
class Written(WriterCommitMessage):
    """What a finished task tells the driver."""

    bundle: str
    files: int


class BundleWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator) -> Written:
        """One task: rows with ``filename`` and ``code`` into a bundle of its own."""
        fs, root = open_path(self.path)
        fs.create_dir(f"{root}/bundles", recursive=True)
        name, at, files = uuid.uuid4().hex, 0, 0
        try:
            with fs.open_output_stream(f"{root}/bundles/{name}.bin") as out, fs.open_output_stream(f"{root}/bundles/{name}.json") as index:
                for row in iterator:
                    if row["filename"] is None:
                        raise ValueError("a file needs a name")
                    data = (row["code"] or "").encode("utf-8", "surrogatepass")
                    out.write(data)
                    index.write((json.dumps({"filename": row["filename"], "offset": at, "length": len(data),
                                             "crc32": zlib.crc32(data)}) + "\n").encode())
                    at, files = at + len(data), files + 1
        except BaseException:
            _delete(fs, root, name)
            raise
        return Written(name, files)

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        fs, root = open_path(self.path)
        for m in done:
            if not m.files:
                _delete(fs, root, m.bundle)
        version, old = latest_manifest(self.path)
        new = [{"bundle": m.bundle, "version": version + 1} for m in done if m.files]
        body = json.dumps(new if self.overwrite else old + new).encode()
        fs.create_dir(root, recursive=True)
        draft = f"{root}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(body)
        fs.move(draft, f"{root}/manifest-{version + 1:08d}.json")

    def abort(self, messages) -> None:
        fs, root = open_path(self.path)
        for m in messages:
            if m is not None:
                _delete(fs, root, m.bundle)


def _delete(fs, root: str, bundle: str) -> None:
    for end in ("bin", "json"):
        try:
            fs.delete_file(f"{root}/bundles/{bundle}.{end}")
        except FileNotFoundError:
            pass


class BundleSource(DataSource):
    """``df.write.format("sample_bundles").mode("append" or "overwrite").save(path)`` for rows ``filename, code``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "filename string, code string"

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        missing = {"filename", "code"} - set(schema.names)
        if missing:
            raise ValueError(f"bundles need the columns filename and code; missing: {sorted(missing)}")
        return BundleWriter(self.options["path"], overwrite)


def latest_manifest(path: str) -> tuple[int, list[dict]]:
    """Version (0 if there is none) and entries of the highest committed manifest."""
    from pyarrow import fs as pafs

    fs, root = open_path(path)
    found = [i.base_name for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith("manifest-")]
    if not found:
        return 0, []
    with fs.open_input_stream(f"{root}/{max(found)}") as f:
        return int(max(found)[len("manifest-"):-len(".json")]), json.loads(f.read())


def write_files(files: DataFrame, path: str, mode: str = "append") -> None:
    """Publish the rows ``filename, code`` of ``files`` as one version of the bundles under ``path``."""
    files.sparkSession.dataSource.register(BundleSource)
    files.select("filename", "code").write.format(FORMAT).mode(mode).save(path)


def bundle_index(spark: SparkSession, path: str) -> DataFrame:
    """``filename, bundle, offset, length, crc32`` of every visible file, the latest version of each name."""
    entries = latest_manifest(path)[1]
    if not entries:
        return spark.createDataFrame([], INDEX + ", bundle string")
    versions = spark.createDataFrame([(e["bundle"], e["version"]) for e in entries], "bundle string, _version bigint")   # one row a task
    rows = spark.read.schema(INDEX).json([f"{path.rstrip('/')}/bundles/{e['bundle']}.json" for e in entries])
    rows = rows.withColumn("bundle", F.regexp_extract(F.col("_metadata.file_name"), r"^(\w+)\.json$", 1)).join(versions, "bundle")
    newest = Window.partitionBy("filename").orderBy(F.desc("_version"), "bundle", "offset")
    return rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "_version")


def _slices(path: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        fs, root = open_path(path)
        held, file = None, None
        for batch in batches:
            names, texts = [], []
            for name, bundle, offset, length, crc in zip(*(batch.column(c).to_pylist() for c in ("filename", "bundle", "offset", "length", "crc32"))):
                if bundle != held:
                    held, file = bundle, fs.open_input_file(f"{root}/bundles/{bundle}.bin")
                data = file.read_at(length, offset)
                if zlib.crc32(data) != crc:
                    raise ValueError(f"bundle {bundle} does not hold {name} as it was written")
                names.append(name)
                texts.append(data.decode("utf-8", "surrogatepass"))
                if len(names) == 256:
                    yield pa.record_batch([names, texts], schema=_READ)
                    names, texts = [], []
            yield pa.record_batch([names, texts], schema=_READ)

    return run


def read_files(spark: SparkSession, path: str, index: DataFrame | None = None) -> DataFrame:
    """``filename, code`` of the visible files, or of those in ``index`` (rows of ``bundle_index``)."""
    rows = bundle_index(spark, path) if index is None else index
    placed = rows.select("filename", "bundle", "offset", "length", "crc32").sortWithinPartitions("bundle", "offset")
    return placed.mapInArrow(_slices(path), "filename string, code string")
