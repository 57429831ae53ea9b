import hashlib
import math
import random

import numpy as np
import pandas as pd

from patchmetrics.llm import vector_codes as vc

from .data import SF


def brute(rows, entries=256, rounds=4):
    """The contract word for word, in Python's integers: ``[(vec_id, code, error, label_error, sha)]``."""
    kept = [(i, lab, [math.floor(1024 * x) if abs(x) < 2 ** 53 else 1024 * int(x) for x in e]) for i, e, lab in rows
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = -(-max((len(e) for *_, e in kept), default=0) // 4) * 4
    kept = [(i, lab, e + [0] * (width - len(e))) for i, lab, e in kept]
    d = width // 4
    parts = [[e[p * d:(p + 1) * d] for *_, e in kept] for p in range(4)]
    first = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, kept[j][2]))[:entries]
    books = [[parts[p][j] for j in first] for p in range(4)]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(books[p])) for x in parts[p]]

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for x, (_, i) in zip(parts[p], assign(p)):
                groups.setdefault(i, []).append(x)
            for i, xs in groups.items():
                books[p][i] = [sum(c) // len(xs) for c in zip(*xs)]
    final = [assign(p) for p in range(4)]
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    errors = [min(sum(final[p][j][0] for p in range(4)), vc.LARGEST) for j in range(len(kept))]
    totals = {}
    for (_, lab, _), e in zip(kept, errors):
        totals[lab] = totals.get(lab, 0) + e
    return sorted((str(i), "".join(f"{final[p][j][1]:02x}" for p in range(4)), errors[j], min(totals[lab], vc.LARGEST), sha)
                  for j, (i, lab, _) in enumerate(kept))


def result(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_query_equals_brute_force(spark):
    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    want = brute([(int(i), [float(x) for x in e], None if pd.isna(lab) else int(lab))
                  for i, e, lab in zip(rows["vec_id"], rows["embedding"], rows["label"])])
    assert result(vc.op12_vector_codes(spark, SF)) == want


def test_search_equals_full_search_with_ties():
    rng = np.random.default_rng(3)
    for d, k, top in ((4, 37, 3), (16, 256, 150), (1, 9, 5), (3, 20, 2 ** 40), (2, 300, 2)):
        entries, parts = (rng.integers(-top, top, (n, d)) for n in (k, 400))
        at, best = vc.Codebook(entries).nearest(parts)
        full = ((parts[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        assert best.tolist() == full.min(1).tolist()
        assert at.tolist() == [row.index(min(row)) for row in full.tolist()]


def test_odd_rows_equal_brute_force(spark):
    rng, nan, inf = random.Random(5), float("nan"), float("inf")
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += [(100, None, 1), (101, [0.5, None, 1.0], 1), (102, [nan] * 8, 2), (103, [1.0, -inf], 2), (104, [], None),
             (105, [0.25] * 3, 7), (3, [0.5] * 8, 7), (3, [0.25] * 8, 7), (None, [0.125] * 8, None), (None, [0.0] * 8, 3),
             (7, rows[7][1], rows[7][2]), (106, [float(np.float32(3e38)), -1e30, 1e6] + [0.0] * 6, 9), (107, [2e9] * 8, 9)]
    schema = "vec_id long, embedding array<float>, label int"
    got = spark.createDataFrame(rows, schema)
    want = [(i, e and [x if x is None else float(np.float32(x)) for x in e], lab) for i, e, lab in rows]
    for entries in (256, 5):
        assert result(vc.compress(got, entries)) == brute(want, entries)
    clash = got.selectExpr("*", "'x' AS code", "1 AS error", "2 AS _label", "3 AS label_error", "4 AS codebooks_sha256")
    assert result(vc.compress(clash)) == brute(want)
    assert vc.compress(got.limit(0)).collect() == []
    assert vc.compress(got.where("vec_id = 104")).collect()[0]["code"] == "00000000"


def test_every_kept_row_may_be_alike(spark):
    rows = [(i, [0.5, -0.5, 0.25, 1.5], i % 2) for i in range(500)]
    got = result(vc.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")))
    assert got == brute(rows) and {(r[1], r[2]) for r in got} == {("00000000", 0)}
