"""A counting responder sees each distinct prompt once, over repeated requests, levels and runs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from patchmetrics.operators import cascade, replies
from patchmetrics.sources import log_store

SCHEMA = f"digest string, {replies.ANSWER_DDL}"


def counting(folder, skip=()):
    """A batch function (run in Spark's workers) that writes down every prompt it sees."""
    folder, skip = str(folder), tuple(skip)

    def respond(batches):
        import os
        import uuid

        import pandas as pd
        for b in batches:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("".join(p + "\x00" for p in b["prompt"]))
            b = b[~b["prompt"].isin(skip)]
            yield pd.DataFrame({"digest": b["digest"], "reply": "R:" + b["prompt"], "finish_reason": "stop", "prompt_tokens": 3,
                                "completion_tokens": 4, "duration_s": 0.25})

    return lambda prompts: cascade.respond_with(prompts, respond, SCHEMA)


def seen(folder):
    return Counter(p for f in folder.iterdir() for p in f.read_text().split("\x00")[:-1])


def test_each_distinct_prompt_once_also_after_a_rerun(spark, tmp_path):
    notes, store = tmp_path / "notes", str(tmp_path / "store")
    notes.mkdir()
    rows = [(i, f"prompt {i % 7}" if i % 11 else None) for i in range(500)] + [(900, "")]
    requests = spark.createDataFrame(rows, "id long, prompt string").repartition(8)
    for _ in range(2):
        out = replies.answer_once(requests, counting(notes), store)
        for _ in range(2):        # using the result twice asks nobody either
            got = {r["id"]: r["reply"] for r in out.collect()}
            assert got == {i: None if p is None else f"R:{p}" for i, p in rows}
    assert seen(notes) == Counter({p: 1 for _, p in rows if p is not None})
    more = spark.createDataFrame([(1, "prompt 3"), (2, "new"), (3, "new")], "id long, prompt string")
    assert {r["reply"] for r in replies.answer_once(more, counting(notes), store).collect()} == {"R:prompt 3", "R:new"}
    assert seen(notes)["new"] == 1 and seen(notes)["prompt 3"] == 1


def test_unanswered_prompts_and_failed_runs_are_asked_again(spark, tmp_path, monkeypatch):
    notes, store = tmp_path / "notes", str(tmp_path / "store")
    notes.mkdir()
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, prompt string")
    out = replies.answer_once(requests, counting(notes, skip=["b"]), store)
    assert {r["id"]: r["reply"] for r in out.collect()} == {1: "R:a", 2: None, 3: None}
    monkeypatch.setattr(log_store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("driver died")))
    with pytest.raises(RuntimeError):
        replies.answer_once(requests, counting(notes), store)
    monkeypatch.undo()
    out = replies.answer_once(requests, counting(notes), store)
    assert {r["id"]: r["reply"] for r in out.collect()} == {1: "R:a", 2: "R:b", 3: "R:b"}
    assert seen(notes) == Counter(a=1, b=3)


def test_cascade_asks_once_for_copies(spark, tmp_path):
    """Ten equal files: one call per level of the cascade, none in a second run."""
    notes, store = tmp_path / "notes", str(tmp_path / "store")
    notes.mkdir()
    docs = spark.createDataFrame([(i, "a\nbad\nc\n") for i in range(10)], "doc_id long, code string")
    finds = spark.createDataFrame([(i, 1, "T", 2, "LOW", "HIGH") for i in range(10)],
                                  "doc_id long, finding_id long, test_id string, line_num int, severity string, confidence string")
    rescan = lambda d: d.where(F.col("code").contains("bad")).select("doc_id", F.lit("T").alias("test_id"))
    for _ in range(2):
        attempts, _, left = cascade.remediate(docs, finds, replies.remembering(counting(notes), store), rescan, window=0)
        assert attempts.count() == 20 and left.count() == 10      # every reply still holds the bad line
    assert sum(seen(notes).values()) == len(seen(notes)) == 2
