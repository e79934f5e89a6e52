"""Dense ids, id repair, duplicate suffixes and keep-first; partition-count invariance."""

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import identity as ID


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_dense_id_partition_invariance(spark, parts):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = ID.dense_id(df, "k", out="pos", num_partitions=parts).collect()
    assert sorted((r.k, r.pos) for r in out) == [(i, i) for i in range(1000)]


def test_fill_blank_ids(spark):
    df = spark.createDataFrame([(0, None), (1, " nan "), (2, "  "), (3, " a1 "), (4, "NaN")], "pos long, id string")
    gen = {r.pos: r.id for r in ID.fill_blank_ids(df, "id", "pos", "generated").collect()}
    assert gen == {0: "generated_id_0", 1: "generated_id_1", 2: "generated_id_2", 3: "a1", 4: "generated_id_4"}
    pos = {r.pos: r.id for r in ID.fill_blank_ids(df, "id", "pos", "position").collect()}
    assert pos[0] == "0" and pos[3] == "a1"


def test_md5_ids_match_python(spark):
    import hashlib

    df = spark.createDataFrame([(0, None, "T", "C"), (1, "x", "T", None)], "pos long, id string, t string, c string")
    out = {r.pos: r.id for r in ID.fill_blank_ids(df, "id", "pos", "md5", title="t", category="c").collect()}
    assert out[0] == hashlib.md5(b"T|C|0").hexdigest()[:16]
    assert out[1] == "x"


@pytest.mark.parametrize("chunk", [2, 3, 1 << 20])
def test_suffix_duplicates_across_chunks(spark, chunk):
    ids = ["a", "a", "b", "a", "c", "a", "b", "a__1", "a"]
    df = spark.createDataFrame(list(enumerate(ids)), "pos long, id string")
    out = {r.pos: r.id for r in ID.suffix_duplicates(df, "id", "pos", chunk=chunk).collect()}
    # The id that was "a__1" from the start meets a generated one and is moved on.
    assert [out[i] for i in range(len(ids))] == ["a", "a__1", "b", "a__2", "c", "a__3", "b__1", "a__1__1", "a__4"]


def test_running_sum_hot_group(spark):
    # One key holds most rows: the chunked prefix must equal a plain running count.
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(
        (F.col("id") % 10).cast("string")).alias("g"), F.col("id").alias("pos"))
    out = ID.running_sum(df, "g", "pos", F.lit(1), "n", chunk=97).collect()
    seen = {}
    for r in sorted(out, key=lambda r: r.pos):
        seen[r.g] = seen.get(r.g, 0) + 1
        assert r.n == seen[r.g]


def test_keep_first(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (5, None), (4, None)], "pos long, id string")
    out = sorted((r.id or "", r.pos) for r in ID.keep_first(df, "id", "pos").collect())
    assert out == [("", 4), ("x", 1), ("y", 2)]


@pytest.mark.parametrize("parts", [1, 5, 32])
def test_dense_id_string_and_composite_keys(spark, parts):
    words = [f"w{(i * 37) % 211:03d}é" for i in range(211)]
    df = spark.createDataFrame([(w,) for w in words], "k string").repartition(3)
    got = {r.k: r.pos for r in ID.dense_id(df, "k", num_partitions=parts).collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}
    rows = [(i % 4, (i * 7) % 50, i) for i in range(200)]
    cdf = spark.createDataFrame(rows, "a int, b int, c long")
    got2 = {(r.a, r.b, r.c): r.pos for r in ID.dense_id(cdf, ["a", "b", "c"], num_partitions=parts).collect()}
    assert got2 == {t: i for i, t in enumerate(sorted(rows))}


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_dense_id_null_key_comes_first(spark, parts):
    for kind, keys in (("long", list(range(40))), ("string", [f"k{i:02d}" for i in range(40)])):
        df = spark.createDataFrame([(k,) for k in [*keys, None]], f"k {kind}").repartition(3)
        got = {r.k: r.pos for r in ID.dense_id(df, "k", num_partitions=parts).collect()}
        assert got == {None: 0} | {k: i + 1 for i, k in enumerate(keys)}
