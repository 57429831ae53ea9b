import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patchmetrics.llm import packing

from .data import SF, empty, odd, odd_rows, small


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")


def check(rows, want: list[np.ndarray], max_len=packing.MAX_LEN):
    """Every document's pieces rebuild its ids; sequences are gapless and within bounds. Repeated documents count."""
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= max_len
    return len(places)


def test_query_rebuilds_every_document(spark, tokenizer):
    docs = small()
    rows = packing.op3_pattern_packing(spark, SF).collect()
    ids = {d: plain_ids(tokenizer, t) for d, t in zip(docs["doc_id"], docs["text"])}
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == ids.keys()
    for d, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        at = 0
        for i, r in enumerate(own):
            assert r["piece"] == i and r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(ids[d][at:at + r["length"]].tobytes())
            assert r["length"] == packing.MAX_LEN or i == 0
            at += r["length"]
        assert at == len(ids[d]) and len(own) == -(-at // packing.MAX_LEN)
    used = check(rows, list(ids.values()))
    assert used <= 1.02 * sum(map(len, ids.values())) / packing.MAX_LEN + 2


def test_encoder_equals_the_tokenizer(tokenizer):
    encode, rng = packing.Encoder(packing.default_ranks()), random.Random(4)
    odd_points = [9, 10, 11, 12, 13, 28, 31, 32, 39, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0x200B, 0x300, 0x660, 0x2167,
                  0x1F600, 0x1D7D8, 0x4E00, 0xE9, 115, 116, 108]
    texts = small()["text"].fillna("").tolist() + ["", "x" * 50_000, " \n" * 20_000, "a<|endoftext|> b<|endoftext|>"]
    for _ in range(4000):
        points = [rng.choice(odd_points) if rng.random() < 0.7 else rng.randrange(32, 0xD7FF) for _ in range(rng.randrange(1, 14))]
        texts.append("".join(map(chr, points)) + "<|endoftext|>" * (rng.random() < 0.05))
    for i in range(0, len(texts), 200):
        for t, e in zip(texts[i:i + 200], tokenizer.encode_batch(texts[i:i + 200], add_special_tokens=False)):
            assert encode(t) == np.array(e.ids, "<u4").tobytes()


def test_enormous_white_space_runs(spark, tokenizer):
    texts = [" " * 2_000_000, "a <|endoftext|>" + " \n" * 1_000_000 + " b's", "plain text"]
    encode = packing.Encoder(packing.default_ranks())
    for t in texts:
        assert encode(t) == plain_ids(tokenizer, t)[:-1].tobytes()
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    check(rows, [plain_ids(tokenizer, t) for t in texts])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 32), st.integers(1, 60)), max_size=20))
def test_plan_holds_every_piece_once(lengths):
    hist = np.zeros(33, np.int64)
    for n, times in lengths:
        hist[n] += times
    where = packing.plan(hist, 32)
    seen = {}
    for n in range(1, 33):
        for number in range(hist[n]):
            rows = where[n]
            at, first, times, offset = rows[np.searchsorted(rows[:, 0], number, "right") - 1]
            seen.setdefault(first + (number - at) // times, []).append((offset + (number - at) % times * n, n))
    for spans in seen.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 32


def test_patterns_fit_a_histogram_made_of_patterns():
    hist = np.zeros(65, np.int64)
    for p in ((40, 24), (30, 20, 14), (50, 10, 4), (64,)):
        for n in p:
            hist[n] += 500
    where = packing.plan(hist, 64)
    used = {int(r[1]) + i for rows, n in ((where[n], n) for n in where) for r in rows for i in range(1)}
    total = max(int(r[1]) for rows in where.values() for r in rows)
    assert used and total < 2000 * 1.02


def groups_hold(groups, hist):
    held = np.zeros_like(hist)
    for contents, n in groups:
        assert n > 0 and sum(length * times for length, times in contents) < len(hist)
        for length, times in contents:
            held[length] += n * times
    assert (held == hist).all()
    return sum(n for _, n in groups)


def test_most_sequences_come_from_fitted_patterns():
    """The lengths of sf0.1: at least 80 per cent of the mixed sequences are repeats of fitted patterns, and there are no
    more sequences than plain best fit decreasing makes."""
    encode, size = packing.Encoder(packing.default_ranks()), packing.MAX_LEN
    hist = np.zeros(size + 1, np.int64)
    for text in pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].fillna(""):
        n = len(encode(text)) // 4 + 1
        hist[size] += n // size
        hist[n % size] += n % size > 0
    groups = packing.pattern_groups(hist, size)
    total = groups_hold(groups, hist)
    left = hist.copy()
    left[size] = 0
    pats = packing.patterns(left, size)
    used, x = packing.fit_repeats(pats, left.astype(float))
    assert len(used) <= size and (x > 0).all()
    fitted = {tuple(zip(*[a.tolist() for a in np.unique(p[p > 0], return_counts=True)])) for p in pats[used]}
    from_patterns = sum(n for contents, n in groups if contents in fitted)
    mixed = total - hist[size]
    assert from_patterns >= 0.8 * mixed
    assert mixed <= sum(n for _, n in packing.best_fit(left, size))
    assert total <= np.ceil((hist * np.arange(size + 1)).sum() / size) * 1.001


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 40)), max_size=25))
def test_never_more_sequences_than_best_fit(lengths):
    hist = np.zeros(65, np.int64)
    for n, times in lengths:
        hist[n] += times
    assert groups_hold(packing.pattern_groups(hist, 64), hist) <= sum(n for _, n in packing.best_fit(hist, 64))


def test_rounded_repeats_are_near_the_fit_and_never_overdraw():
    rng = np.random.default_rng(4)
    hist = rng.integers(0, 60, 129)
    hist[0] = hist[128] = 0
    pats = packing.patterns(hist, 128)
    used, x = packing.fit_repeats(pats, hist.astype(float))
    times = packing.round_repeats(pats[used], x, hist)
    left = hist.copy()
    for p, n in zip(pats[used], times):
        np.subtract.at(left, p[p > 0], n)
    assert (left >= 0).all() and (times <= np.rint(x) + 1).all() and times.sum() >= 0.8 * x.sum()


def test_odd_rows_and_empty_table(spark, tokenizer):
    rows = packing.pack(odd(spark)).collect()
    check(rows, [plain_ids(tokenizer, r[1]) for r in odd_rows()])
    assert packing.pack(empty(spark)).count() == 0
