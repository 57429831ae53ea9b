import numpy as np

import corpus_pipeline
from patchmetrics.llm import language_id, packing
from patchmetrics.llm.common import Scratch, documents

from .data import SF, empty, odd, small
from .test_mixing import size, targets
from .test_near_dup import brute as near_groups
from .test_packing import check as packed
from .test_pii import brute as base_spans


def test_each_stage_on_what_the_one_before_kept(spark):
    scratch, docs = Scratch(spark, "test-pipeline"), documents(spark, SF)
    before, frames = docs.toPandas(), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, SF), name)
        frames[name] = docs.toPandas()
        if name != "pack_sequences":
            assert docs.columns == documents(spark, SF).columns and len(docs.schema) == 5
    got = frames["language"]
    letters = before["text"].map(language_id.has_letter)
    assert set(got["doc_id"]) == set(before.loc[letters, "doc_id"])
    groups = near_groups(got["doc_id"].tolist(), got["text"].tolist(), 5, 80)
    assert sorted(frames["near_dedup"]["doc_id"]) == sorted(d for d, (_, _, kept) in groups.items() if kept)
    clean = frames["personal_data"]
    assert sorted(clean["doc_id"]) == sorted(frames["near_dedup"]["doc_id"])
    assert not any(base_spans(t) for t in clean["text"]) and (clean["text"].str.len() == clean["n_chars"]).all()
    mixed, goal = frames["mix_sources"], clean.assign(w=clean["text"].map(size)).groupby("source")["w"].sum().to_dict()
    for s, want in targets(goal).items():
        own = mixed.loc[mixed["source"] == s, "text"].map(size).sum()
        assert want - clean.loc[clean["source"] == s, "text"].map(size).max() <= own <= want + 1e-6
    encode = packing.Encoder(packing.default_ranks())
    ids = [np.frombuffer(encode(t) + b"\x02\0\0\0", "<u4") for t in mixed["text"]]
    packed([r.asDict() for r in docs.collect()], ids)


def test_run_is_its_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).count() >= len(small()) // 2


def test_stages_on_odd_rows_and_an_empty_table(spark):
    for make in (odd, empty):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "pack_sequences" or out.columns == docs.columns
            docs = Scratch(spark, "test").save(out, name)


def test_stages_keep_columns_named_like_their_helpers(spark):
    helpers = ["_of", "_copies", "_copy", "_language", "_dropped", "_row", "_same", "_part", "_at", "_before", "_hash", "row",
               "rank", "hash", "same"]
    texts = ["the cat and the dog are in the house of the king " * 3, "der die das und nicht ein eine ist nun da " * 3,
             "los que en la casa de la noche son para el rey " * 3]
    rows = [(i, texts[i % 3] + f"word{i} " * (i % 2), ["en", "de", "es"][i % 3], "ab"[i % 2], 9, *[f"{h}{i}" for h in helpers])
            for i in range(9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{h} string" for h in helpers)
    for some in (rows, [*rows, rows[4], (rows[5][0], "another text of this id, not like others at all", *rows[5][2:])]):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = Scratch(spark, "test").save(stage(spark, docs, SF), name)
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
            for r in docs.collect():
                assert all(r[h] == f"{h}{r['doc_id']}" for h in helpers)
        assert docs.count()
