"""The corpus pipeline: documents of known language, one of each near-copy group, without personal data, mixed to
target weights, packed into training sequences. Each stage reads what the stage before wrote.

All stages take any table with the columns ``doc_id, text, source`` and keep further columns, whatever their names; all but
the last return the columns they got. Empty tables pass through every stage as empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchmetrics.llm import language_id, mixing, near_dup, packing, pii
from patchmetrics.llm.common import Scratch, documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised, unchanged; null, empty and letterless texts go, repeated rows stay alike."""
    return language_id.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8), that of the smallest id; of a repeated id each unlinked text;
    texts without a word and rows without an id stay."""
    return near_dup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data in ``text`` replaced by the name of its kind and ``n_chars`` following; a null text
    stays null."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of the sources takes it; rows without a word go, a null source is a source."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, repeated ones each, with their places in sequences; a null text is its end token."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data),
          ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Language models, MinHash and sampling by hash have no SQL form; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
