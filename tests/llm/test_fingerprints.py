import hashlib
import random
import re

import xxhash

from patchmetrics.llm import fingerprints as fp

from .data import SF, empty, odd, small


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed=h)
    return h >> 32


def brute(text):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.findall(r"[^ \t\n\x0b\x0c\r]{1,4}", text)]
    if not h:
        return ""
    if len(h) < fp.K:
        return f"{chain(h):08X}"
    out = []
    for i in range(len(h) - fp.K + 1):
        w = h[i:i + fp.K]
        if min(w) in (w[0], w[-1]):
            out.append(f"{chain(w):08X}")
    return ",".join(out)


def dice(a, b):
    a, b = set(filter(None, a.split(","))), set(filter(None, b.split(",")))
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def check(rows, ids, texts):
    got = {r["doc_id"]: r for r in rows}
    order = sorted(range(len(ids)), key=lambda i: -ids[i])
    for at, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        cut = len(text) // 3
        edited, r = text[:len(text) - cut] + after[:cut], got[ids[i]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == brute(text) and r["edited_fingerprint"] == brute(edited)
        assert abs(r["near_edited"] - dice(brute(text), brute(edited))) < 1e-12
        assert abs(r["near_next"] - dice(brute(text), brute(after))) < 1e-12


def test_query_is_the_brute_force_result(spark):
    docs = small()
    check(fp.op2_syncmer_fingerprints(spark, SF).collect(), docs["doc_id"].tolist(), docs["text"].tolist())


def test_sparse_ids_and_code_points(spark):
    ids = [-5, 0, 1, 10**15, -(10**17), 7, 8, 9]
    texts = ["", None, "é\U0001F600ö" * 11, "a b c", "same text here " * 9, "same text here " * 9, "x", "日本語" * 30]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    rows = fp.fingerprints(df).collect()
    check(rows, ids, texts)
    by = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert by[-(10**17)] == by[7]


def test_single_document_is_its_own_next(spark):
    check(fp.fingerprints(spark.createDataFrame([(3, "only one text")], "doc_id long, text string")).collect(), [3],
          ["only one text"])


def test_buckets_count_the_bounds(spark):
    from pyspark.sql import functions as F

    bounds = list(range(0, 1000, 3))
    got = spark.range(-5, 1010).select("id", fp._bucket(F.col("id"), bounds).alias("b")).collect()
    assert all(r["b"] == sum(b <= r["id"] for b in bounds) for r in got)


def test_plan_has_no_python(spark):
    plan = fp.fingerprints(odd(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows_and_empty_table(spark):
    out = fp.fingerprints(odd(spark)).toPandas()
    assert len(out) == odd(spark).count() and out.drop(columns="doc_id").notna().all().all()
    assert out["near_edited"].between(0, 1).all() and out["near_next"].between(0, 1).all()
    assert fp.fingerprints(empty(spark)).count() == 0


def test_near_copies_without_spaces(spark):
    rng = random.Random(3)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(5000))
    edits = [text[:10] + text[11:], text[:2500] + "xyz" + text[2500:], text[:4950] + text[4951:], "a" + text]
    rows = [(2 * i + k, t) for i, e in enumerate(edits) for k, t in enumerate((e, text))]
    got = {r["doc_id"]: r for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i + 1]["near_next"] > 0.98 for i in range(len(edits)))
    short = text[:fp.RUN]
    rows = [(1, "a" + short), (0, short)]
    got = {r["doc_id"]: r for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["near_next"] > 0.8
