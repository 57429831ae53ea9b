"""The hot-key-safe row_number and dense index against Spark's own window function."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from patchmetrics.operators.sequence import dense_index, sequence_within


def test_sequence_matches_row_number_with_hot_key(spark):
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 101).alias("k"),
        (F.col("id") * 7919 % 20000).alias("o"), F.lit(None).cast("string").alias("nullable"))
    got = sequence_within(df, ["k"], ["o"], "s", num_partitions=13)
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    bad = got.join(want, ["k", "o"]).filter(F.col("s") != F.col("w")).count()
    assert got.count() == 20000 and bad == 0


def test_sequence_null_keys_form_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), (None, 3)], "k string, o int")
    got = {(r.k, r.o): r.s for r in sequence_within(df, ["k"], ["o"], "s", num_partitions=3).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, (None, 3): 3, ("a", 1): 1}


def test_dense_index_is_contiguous_in_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 37 % 5000).alias("x"))
    got = dense_index(df, ["x"], "idx", num_partitions=7).collect()
    assert sorted((r.x, r.idx) for r in got) == [(i, i) for i in range(5000)]


def test_payload_and_keys_are_untouched(spark):
    """Integers beyond 2^53 beside nulls, NaN payloads and a key with a third of the rows come back as they were."""
    big = 2**60
    rows = [(big + i % 3 if i % 3 else None, i, 2**53 + 1 if i % 2 else None, float("nan") if i % 5 == 0 else i / 3) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, o long, p long, x double")
    got = sequence_within(df, ["k"], ["o"], "n", num_partitions=7).collect()
    assert sorted((r.o, r.k, r.p, str(r.x)) for r in got) == sorted((o, k, p, str(x)) for k, o, p, x in rows)
    for k in {r[0] for r in rows}:
        own = sorted((r.o, r.n) for r in got if r.k == k)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    assert "Python" not in sequence_within(df, ["k"], ["o"])._jdf.queryExecution().toString()


def test_several_ordinals_share_one_shuffle_and_split_hot_groups(spark, monkeypatch, capsys):
    from patchmetrics.operators import sequence
    rows = [(k if k != 4 else None, v % 3, v * 7 % 101) for k in range(5) for v in range(90 if k == 2 else 7)]
    df = spark.createDataFrame(rows, "k int, g int, o int")
    ordinals = {"b": (["k", "g"], ["o"]), "a": (["k"], ["o"])}
    want = sorted(((k, g, o, sum(y[2] <= o for y in rows if y[0] == k), sum(y[2] <= o for y in rows if y[:2] == (k, g)))
                   for k, g, o in rows), key=str)
    for hot in (1000, 20, 1):
        monkeypatch.setattr(sequence, "HOT_ROWS", hot)
        got = sequence.sequences_within(df, ["k"], ordinals).select("k", "g", "o", "a", "b")
        assert sorted(map(tuple, got.collect()), key=str) == want
    monkeypatch.setattr(sequence, "HOT_ROWS", 1000)
    sequence.sequences_within(df, ["k"], ordinals).explain()
    assert capsys.readouterr().out.count("Exchange") == 1
