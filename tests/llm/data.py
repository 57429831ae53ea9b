"""Small tables for the tests: odd rows, and the smallest generated tables as plain Python."""

from __future__ import annotations

import pandas as pd

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, score double, kept boolean, "
          "source_size string, component_id string, text2 string, rank int, length int, row long, key string")

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [None, "", "   \n\t ", "one", "two words", "1234 !!", "a@b.co a@b.co\n" * 3, LONG, "x" * 100_000,
         "der die das und nicht ein eine ist " * 8, "the cat and the dog are in the house of the king " * 4,
         "the cat and the dog are in the house of the king " * 4, "los que en la casa de la noche son para el rey " * 4]


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns that clash with results."""
    langs, sources = [None, "en", "de", "es"], [None, "a", "b", ""]
    rows = [(i, t, langs[i % 4], sources[i % 4], None if t is None or i % 5 == 0 else len(t), 7, 0.5, True, "s", "c", "t", 1,
             2, 3, "k") for i, t in enumerate(TEXTS)]
    rows += [rows[10], rows[10], (None, "lost id text of some words", "en", "a", 5, *[None] * 10),
             (None, None, None, None, None, *[None] * 10)]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def small(name: str = "documents") -> pd.DataFrame:
    return pd.read_parquet(f"{SF}/{name}.parquet")


def auc(score, label) -> float:
    ranks = pd.Series(score).rank().to_numpy()
    y = pd.Series(label).to_numpy()
    pos, neg = (y == 1).sum(), (y == 0).sum()
    return (ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
