"""Input tables: one parquet file (or folder) per table under a scale-factor directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# Unique key of each table: when a scan has too few splits it is spread by this key, so later joins and
# groupings on the same key can reuse the partitioning. Only unique keys qualify -- hashing a table on a key
# that can be hot (lineitem's order key, a conversation id) would recreate the skew; those spread round-robin.
TABLE_KEYS = {"orders": "o_orderkey", "documents": "doc_id", "pages": "page_id", "events": "event_id"}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def ensure_parallelism(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread a scan that arrives in fewer splits than the cluster has cores (e.g. one large row group).

    With many input splits -- the normal case on a cluster -- this is a no-op; otherwise the rows are
    hash-partitioned on ``key`` (round-robin without one) into as many parts as the cluster has cores
    (``defaultParallelism``), so the per-row work that follows (regexes, explodes, Python jobs) runs on every core.
    """
    target = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key) if key and key in df.columns else df.repartition(target)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
               spread: bool = True) -> DataFrame:
    """Read one table with an explicit column list (narrow ReadSchema), spread over the cores if needed."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    return ensure_parallelism(df, TABLE_KEYS.get(name)) if spread else df
