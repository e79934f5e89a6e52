"""Mergeable profiles, bootstrap intervals and table functions against exact values."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.functions import table_functions as TF
from shelfspark.functions import text as TX
from shelfspark.operators import chat as CH
from shelfspark.operators import evaluation as EV
from shelfspark.operators import identity as ID
from shelfspark.operators import sketches as SK


def _columns(spark, n=6000):
    return spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("key"),
        F.repeat(F.lit("x"), (F.col("id") % 200).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("kind"), F.lit(None).cast("string").alias("none"))


def test_merged_profiles_are_within_their_bounds(spark, scratch):
    df, root = _columns(spark), os.path.join(scratch, "profiles")
    cols = df.columns
    for k in range(5):
        part = df.where(F.pmod(F.xxhash64("text", "key"), F.lit(5)) == k)
        SK.store_profile(part, cols, root, k)
        SK.store_profile(part, cols, root, k)  # the same batch again replaces itself
    one = {r.column_name: r for r in SK.estimates(SK.column_profiles(df, cols)).collect()}
    got = {r.column_name: r for r in SK.table_profile(spark, root).collect()}
    exact = {"key": df.select("key").distinct().where("key is not null").count(), "text": 199, "kind": df.select("kind").distinct().count()}
    for name, n in exact.items():
        assert got[name].n_rows == 6000 and got[name].n_empty == one[name].n_empty
        for r in (got[name], one[name]):
            assert abs(r.n_distinct - n) <= 0.065 * n + 1
    lengths = np.sort([r[0] for r in df.where("text <> ''").select(F.length("text")).collect()])
    for q, value in zip(SK.QUANTILES, got["text"].length_quantiles):
        low, high = np.searchsorted(lengths, value, "left") / lengths.size, np.searchsorted(lengths, value, "right") / lengths.size
        assert low - 0.027 <= q <= high + 0.027
    assert (got["kind"]["items"][0].item, got["kind"]["items"][0]["count"]) == ("hot", 2000)
    assert got["none"].n_empty == 6000 and got["none"].n_distinct == 0 and got["none"].length_quantiles is None


def _weights(key, replicates, seed):
    bounds, p, total = [], math.exp(-1.0), 0.0
    for k in range(1, 14):
        total += p
        bounds.append(round(total * 2 ** 32))
        p /= k
    out = []
    for r in range(replicates):
        u = int(hashlib.md5(f"{seed}:{r // 4}:{key}".encode()).hexdigest()[8 * (r % 4):8 * (r % 4) + 8], 16)
        out.append(sum(u >= b for b in bounds if b < 2 ** 32))
    return out


def test_bootstrap_equals_a_resample_with_the_same_weights(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, float(x), None if i % 7 == 0 else float(x * x)) for i, x in enumerate(rng.random(150))]
    df = spark.createDataFrame(rows, "k long, j int, a double, b double")
    got = {r.metric: r for r in EV.bootstrap_intervals(df, ["a", "b"], ["k", "j"], replicates=50, seed=5).collect()}
    again = {r.metric: r for r in EV.bootstrap_intervals(df.repartition(9), ["a", "b"], ["k", "j"], replicates=50, seed=5).collect()}
    w = np.array([_weights(f"{k}:{j}", 50, 5) for k, j, _, _ in rows])
    assert 0.9 < w.mean() < 1.1
    for m, at in (("a", 2), ("b", 3)):
        x = np.array([np.nan if r[at] is None else r[at] for r in rows])
        ok = ~np.isnan(x)
        means = (w[ok] * x[ok, None]).sum(axis=0) / w[ok].sum(axis=0)
        for r in (got[m], again[m]):
            assert r.mean == pytest.approx(x[ok].mean()) and r.n_replicates == 50
            assert (r.low, r.high) == pytest.approx((np.quantile(means, 0.025), np.quantile(means, 0.975)))
    assert EV.bootstrap_intervals(df.limit(0), ["a"], "k").first()["low"] is None


def test_turn_pairs_in_sql(spark):
    TF.register(spark)
    rows = [(c, i, ("user", "assistant", "system")[(i * (c + 1)) % 3 if c % 2 else i % 2], f"t{c}.{i}") for c in range(6) for i in range(1 + 40 * (c == 3) + c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.createOrReplaceTempView("turns_for_test")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = spark.sql("SELECT * FROM turn_pairs(TABLE(turns_for_test) PARTITION BY conv_id ORDER BY turn)").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == sorted(map(tuple, CH.turn_pairs(df).collect()))


def test_sentences_in_sql(spark):
    TF.register(spark)
    texts = ["One. Two! One. two, three\nOne.", None, "", " a ,  a,b . ", "x" * 9000 + ". y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.createOrReplaceTempView("texts_for_test")
    got = spark.sql("SELECT * FROM sentences(TABLE(texts_for_test) PARTITION BY doc_id)").orderBy("doc_id", "pos").collect()
    joined = {i: " ".join(r.sentence for r in got if r.doc_id == i) for i in range(len(texts))}
    want = {r.doc_id: r.d for r in df.select("doc_id", TX.dedupe_sentences("text").alias("d")).collect()}
    assert joined == want


def test_dense_id_with_many_buckets(spark):
    """The bounds are constants of the plan, not a tree that grows with them."""
    df = spark.range(50_000).select(((F.col("id") * 7919) % 50_000).alias("k"), F.concat(F.lit("s"), F.lpad(F.col("id"), 6, "0")).alias("s"))
    for key in ("k", ["s", "k"]):
        out = ID.dense_id(df, key, num_partitions=5000)
        row = out.agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count_distinct("pos").alias("n")).first()
        assert tuple(row) == (0, 49_999, 50_000)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") < 10
    assert ID.dense_id(df, "k", num_partitions=5000).where("pos <> k").count() == 0


def test_suffixes_keep_the_rows(spark):
    rows = [(i, x, f"v{i}") for i, x in enumerate(["a", "a__1", "a", "b", "a", "a__1"])]
    df = spark.createDataFrame(rows, "pos long, id string, v string")
    out = {r.pos: (r.id, r.v) for r in ID.suffix_duplicates(df, "id", "pos").collect()}
    assert [out[i][1] for i in range(6)] == [f"v{i}" for i in range(6)]
    assert len({x for x, _ in out.values()}) == 6
