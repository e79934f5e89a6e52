"""Property tests: invariants that must hold on any input/partitioning."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfspark.functions import text as TX
from shelfspark.operators import evaluation as EV
from shelfspark.operators import identity as ID


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "a__1", "", "x"]), min_size=1, max_size=40))
def test_suffixes_unique_when_no_preexisting_suffix(spark, ids):
    ids = [i for i in ids if i != "a__1"] or ["a"]
    df = spark.createDataFrame(list(enumerate(ids)), "pos long, id string")
    out = [r.id for r in ID.suffix_duplicates(df, "id", "pos", chunk=5).collect()]
    assert len(out) == len(set(out)) == len(ids)


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_suffix_and_keep_first_partition_invariance(spark, parts):
    df = spark.range(0, 600).select(F.col("id").alias("pos"), (F.col("id") % 7).cast("string").alias("k"))
    base_s = sorted(map(tuple, ID.suffix_duplicates(df, "k", "pos", chunk=50).collect()))
    base_w = sorted(map(tuple, ID.keep_first(df, "k", "pos").collect()))
    re_df = df.repartition(parts)
    assert sorted(map(tuple, ID.suffix_duplicates(re_df, "k", "pos", chunk=50).collect())) == base_s
    assert sorted(map(tuple, ID.keep_first(re_df, "k", "pos").collect())) == base_w


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab ,\nxy", min_size=0, max_size=25), min_size=1, max_size=6))
def test_dedupe_idempotent_without_punctuation(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    once = df.select(TX.dedupe_sentences("s").alias("o"))
    twice = once.select("o", TX.dedupe_sentences("o").alias("t")).collect()
    for r in twice:
        assert r.o == r.t


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab cdé", max_size=12), st.text(alphabet="ab cdé", max_size=12)),
                min_size=1, max_size=8))
def test_f1_symmetric_and_bounded(spark, pairs):
    df = spark.createDataFrame(pairs, "g string, a string")
    rows = df.select(EV.f1_tokens(F.col("g"), F.col("a")).alias("x"),
                     EV.f1_tokens(F.col("a"), F.col("g")).alias("y"),
                     EV.recall_tokens(F.col("g"), F.col("a")).alias("r")).collect()
    for r in rows:
        assert r.x == pytest.approx(r.y)
        assert 0.0 <= r.x <= 1.0 and 0.0 <= r.r <= 1.0
