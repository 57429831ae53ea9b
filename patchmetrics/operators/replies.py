"""One call per distinct prompt, answers kept between levels and runs.

Requests often repeat a prompt: copies of a file, findings that share a context, a second run. ``answer_once`` asks a
responder for the prompts of which no answer is stored yet, each distinct one once, stores the answers and joins them
back to all requests:

1. prompts are keyed by their SHA-256; the distinct ones are an aggregate (combined before the shuffle, so a prompt of a
   third of all requests is one row a task) and an anti-join against the stored digests;
2. the new prompts are written before the responder sees them, so that no other use of the plan asks again;
3. answers are written as one committed batch of the store (``sources.log_store``: a manifest per batch). A run that dies
   before its commit leaves nothing visible and asks its prompts again; a committed answer is never asked for again.

Of two runs that answered the same prompt at the same time one answer is used throughout (the one of the batch first by
name). A task that Spark repeats, after a lost executor say, asks its prompts again: the store cannot see inside a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import log_store
from ..sources.store import materialize

ANSWER_DDL = "reply string, finish_reason string, prompt_tokens bigint, completion_tokens bigint, duration_s double"


def stored_answers(spark, path: str, columns: str = ANSWER_DDL) -> DataFrame:
    """``digest`` and the answer columns of every answer stored under ``path``, one row a digest."""
    folders = log_store.committed(spark, path)
    if not folders:
        return spark.createDataFrame([], f"digest string, {columns}")
    parts = None
    for batch, folder in sorted(folders.items()):
        own = spark.read.schema(f"digest string, {columns}").parquet(folder).withColumn("_batch", F.lit(batch))
        parts = own if parts is None else parts.unionByName(own)
    names = [c for c in parts.columns if c not in ("digest", "_batch")]
    first = parts.groupBy("digest").agg(F.min_by(F.struct(*names), "_batch").alias("a"))
    return first.select("digest", "a.*")


def answer_once(requests: DataFrame, responder: Callable[[DataFrame], DataFrame], path: str, prompt_col: str = "prompt",
                columns: str = ANSWER_DDL) -> DataFrame:
    """``requests`` with ``digest`` and the answer columns; a null prompt, or one that got no answer, has nulls there.

    ``responder`` maps a table ``digest, prompt`` of distinct prompts to ``digest`` and ``columns`` (``cascade.respond_with``
    wraps a batch function); a prompt that it leaves out is asked again next time. ``path`` is the store, shared by the
    levels and runs that are to know each other's answers.
    """
    spark = requests.sparkSession
    keyed = materialize(requests.withColumn("digest", F.sha2(F.col(prompt_col).cast("binary"), 256)), "requests")
    known = stored_answers(spark, path, columns).select("digest")
    asked = keyed.where(F.col(prompt_col).isNotNull()).groupBy("digest").agg(F.first(prompt_col).alias("prompt"))
    new = materialize(asked.join(known, "digest", "left_anti"), "new_prompts")
    if not new.isEmpty():
        batch = f"answers-{uuid.uuid4().hex}"
        answers = responder(new)
        names = [f.name for f in spark.createDataFrame([], columns).schema]
        answers.select("digest", *names).write.parquet(f"{path.rstrip('/')}/{batch}")
        log_store.commit(spark, path, batch, batch)
    return keyed.join(stored_answers(spark, path, columns), "digest", "left")


def remembering(responder: Callable[[DataFrame], DataFrame], path: str, finding_keys=("doc_id", "finding_id"),
                columns: str = ANSWER_DDL) -> Callable[[DataFrame], DataFrame]:
    """A responder for ``cascade.remediate`` that asks each distinct prompt once: over levels, findings and runs."""

    def respond(prompts: DataFrame) -> DataFrame:
        answered = answer_once(prompts.select(*finding_keys, "level", "prompt"), responder, path, "prompt", columns)
        return answered.where(F.col("reply").isNotNull()).drop("digest", "prompt")

    return respond
