import random

import pytest

from patchmetrics.llm import token_counts

from .data import SF, empty, odd, odd_rows, small


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_vocabulary())


def plain(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_query_equals_the_library_on_whole_texts(spark, tokenizer):
    docs = small()
    rows = {r["doc_id"]: r for r in token_counts.op13_token_counts(spark, SF).collect()}
    assert len(rows) == len(docs)
    for d, text in zip(docs["doc_id"], docs["text"]):
        n = plain(tokenizer, text)
        assert (rows[d]["n_bytes"], rows[d]["n_tokens"], rows[d]["over_limit"]) == (
            len((text or "").encode()), n, n > 2048)


def test_pre_tokens_are_encoded_apart(tokenizer):
    """Special strings, contractions, odd white space, combining marks and letters that lower-case to two."""
    rng, lengths = random.Random(7), token_counts.Lengths(token_counts.default_vocabulary())
    odd_points = [9, 10, 11, 12, 13, 28, 29, 31, 32, 32, 32, 39, 45, 48, 0x85, 0xA0, 0x1680, 0x2000, 0x2003, 0x2028, 0x3000, 0x200B,
                  0x300, 0x301, 0x323, 0x660, 0x2167, 0x130, 0x3A3, 0x1F600, 0x1D7D8, 0x4E00, 0xE9, 0xAC00, 0x1100, 0x1161,
                  0xD7, 0xDF, 0xF7, 0xFF, 0xC9, 0xB5, 60, 124, 76, 83, 84, 109, 39, 39, 115, 116, 108, 68]
    texts = ["", " ", "É'S ÉÀ'tÖ ''s ×÷ x×y ÿ'LLÿ ªº µ'm 12'd3 ß're <|x <ÿ|", "it's 'standard' they'll", "a<|endoftext|>b <|startoftext|> <|endof text|>", "e ́ ́e", "x" * 70_000,
             "ΣΑΣ ΑΣ", "ÅB Å"]
    for _ in range(3000):
        points = [rng.choice(odd_points) if rng.random() < 0.8 else rng.randrange(33, 0xD7FF) for _ in range(rng.randrange(1, 16))]
        texts.append("".join(map(chr, points)) + "<|endoftext|>" * (rng.random() < 0.05))
    assert lengths.count(texts) == [plain(tokenizer, t) for t in texts]
    assert lengths.count(texts) == [plain(tokenizer, t) for t in texts]   # now from the cache


def test_the_table_and_the_cache_change_no_count(spark, tokenizer, monkeypatch):
    texts = [t for t in small()["text"].fillna("")][:60]
    want = [plain(tokenizer, t) for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    words = token_counts.frequent_words(rows, 10)
    assert 0 < len(words) <= token_counts.TABLE_WORDS
    for some in ([], words[:3], words):
        sizes = token_counts.np.array(token_counts.Lengths(token_counts.default_vocabulary()).encode(some), "uint16")
        lengths = token_counts.Lengths(token_counts.default_vocabulary(), "\n".join(some).encode(), sizes)
        assert lengths.count(texts) == want
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 5)
    lengths = token_counts.Lengths(token_counts.default_vocabulary())
    assert [lengths.count([t])[0] for t in texts] == want


def test_odd_rows_and_empty_table(spark, tokenizer):
    rows = token_counts.count_tokens(odd(spark)).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), plain(tokenizer, r[1])) for r in odd_rows())
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)
    assert token_counts.count_tokens(empty(spark)).collect() == []
