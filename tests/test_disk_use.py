"""What searches and collections leave on disk: texts once, no lists per small task."""

import os

import numpy as np
from pyspark.sql import functions as F

from shelfspark.operators import knn as KN
from shelfspark.plans import pipelines as PL
from shelfspark.sources import collection_source as CS
from shelfspark.sources import collections as CO
from tests.test_vectors_knn import _rows, brute

_META = "id string, embedding array<float>, document string, metadata struct<name:string,search_text:string,n:int>"


def _stored_bytes(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet"))


def test_a_text_of_the_metadata_is_stored_once(spark, scratch):
    """r04 F1: the document stood in every collection twice."""
    def text(i):
        return os.urandom(2000).hex() + str(i)

    rows = [(str(i), [1.0, float(i)], t := text(i), ("name", t, i)) for i in range(50)]
    rows += [("a", [0.0, 1.0], None, ("x", None, 1)), ("b", [0.0, 1.0], "doc", None), ("c", [0.0, 2.0], "", ("", "other", None)),
             ("d", [0.0, 2.0], None, (None, "text", 3)), ("e", None, "same", ("same", "same", 4))]
    df = spark.createDataFrame(rows, _META)
    CO.save(df, scratch, "c")
    once = len("".join(t for _, _, t, _ in rows if t))
    assert _stored_bytes(scratch) < 0.8 * once
    as_set = lambda df: sorted(map(repr, df.select("id", "embedding", "document", "metadata").collect()))
    assert as_set(CO.open_collection(spark, scratch, "c")) == as_set(df)
    CS.register(spark)
    where = {"root": scratch, "name": "c"}
    loaded = spark.read.format(CS.NAME).options(**where).load()
    assert loaded.columns == df.columns and as_set(loaded) == as_set(df)
    assert loaded.select("metadata").where("metadata.search_text = 'same'").count() == 1
    # A full build written through the source has no flags, a batch added to it has.
    df.where("id <> 'e'").write.format(CS.NAME).options(**where).mode("overwrite").save()
    CO.upsert(df.where("id IN ('e', '7', 'd')"), scratch, "c", "document")
    assert as_set(CO.open_collection(spark, scratch, "c")) == as_set(df)
    assert as_set(spark.read.format(CS.NAME).options(**where).load()) == as_set(df)


def test_encoded_rows_go_once_the_collections_are_written(spark, scratch, monkeypatch):
    """r04 F1: the scratch table of encoded rows held two texts a row, to the end."""
    made = []
    from shelfspark import session

    place = session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda s, name: made.append((name, place(s, name))) or made[-1][1])
    rows = [(i, f"text {i}", f"n{i}", f"u{i}", str(i), bytes([i]) if i % 2 else None) for i in range(6)]
    cleaned = spark.createDataFrame(rows, "id long, search_text string, name string, image_url string, product_id string, media binary")
    out = PL.build_collections(cleaned, scratch, dim=8, image_bins=8, image_bytes="media")
    path = dict(made)["encoded"].removeprefix("file://").removeprefix("file:")
    assert not os.path.exists(path)
    for name in ("text", "image", "multimodal"):
        got = {r.id: (r.document, *r.metadata) for r in out[name].collect()}
        assert got == {str(i): (t, n, u, p, t) for i, t, n, u, p, _ in rows}


def test_possible_matches_keep_every_match(spark):
    """r04 F1: all documents of all collections were shuffled for the few that were hits."""
    df = spark.range(200_000).select(F.lit("r").alias("route"), F.col("id").cast("string").alias("id"))
    wanted = df.where("id % 100 = 3").unionByName(df.limit(5)).unionByName(spark.createDataFrame([("s", "7"), ("s", None)], "route string, id string"))
    kept = KN.possible_matches(df, wanted, ["route", "id"])
    assert kept.join(wanted.distinct(), ["route", "id"], "left_semi").count() == wanted.where("route = 'r'").distinct().count()
    assert kept.count() < 30_000
    assert KN.possible_matches(df, wanted.limit(0), ["route", "id"]).count() == 0


def test_lists_do_not_grow_with_the_tasks(spark, monkeypatch):
    """r04 F1: each task over the corpus gives a list per query; many tasks filled the disk."""
    rng = np.random.default_rng(4)
    cs = [(i, rng.normal(size=4).round(3).tolist()) for i in range(3000)]
    qs = [(i, rng.normal(size=4).round(3).tolist()) for i in range(700)]
    c = spark.createDataFrame(cs, "id long, vec array<double>").repartition(60)
    q = spark.createDataFrame(qs, "qid long, vec array<double>")
    tasks = []
    streamed = KN._streamed
    monkeypatch.setattr(KN, "_least_copies", lambda df, k: df)
    monkeypatch.setattr(KN, "_streamed", lambda df, *a: tasks.append(df.rdd.getNumPartitions()) or streamed(df, *a))
    got = _rows(KN.knn_join(q, c, 3, "l2", strategy="broadcast_queries"))
    assert got == brute(qs, cs, 3, "l2")
    assert tasks == [2 * spark.sparkContext.defaultParallelism]


def test_quantised_lists_go_to_parts_in_slices(spark, monkeypatch):
    """r04 F2: a row per query and probed cell, and a list for each, filled the disk."""
    rng = np.random.default_rng(6)
    vs = rng.normal(size=(1200, 16)).round(3)
    vs[7] = 0.0
    cs = list(enumerate(vs.tolist()))
    c = spark.createDataFrame(cs, "id long, vec array<double>")
    qs = [(i, v) for i, v in cs if i % 6 == 1] + [(5000, None)]
    q = spark.createDataFrame(qs, "qid long, vec array<double>")
    index = KN.pq_build(c, 20, 8, space="cosine", seed=2)
    at_once = _rows(KN.pq_join(q, index, 5, 12))
    sizes, kept = [], KN._kept
    monkeypatch.setattr(KN, "_kept", lambda df, name: sizes.append((name, (out := kept(df, name)).count())) or out)
    monkeypatch.setattr(KN, "SLICE", 32)
    monkeypatch.setattr(KN, "PQ_QUERIES", 20, raising=False)
    got = KN.pq_join(q, index, 5, 12, block_rows=300)
    assert _rows(got) == at_once and got.count() == 5 * (len(qs) - 1)
    assert max(n for _, n in sizes) == len(qs) - 1
    assert len([n for name, n in sizes if name == "knn-needed" and n < 120]) > 1
    # Of all cells, every row fetched: the exact neighbours.
    assert _rows(KN.pq_join(q, index, 5, 20, rerank=240)) == brute([x for x in qs if x[1]], cs, 5, "cosine")


def test_shuffle_files_go_with_the_table_that_is_stored(spark):
    """r04 F2: those of every search before stayed to the end."""
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(b.isShuffle() for b in (root.getAllBlocks().apply(i) for i in range(root.getAllBlocks().size())))
    spark.range(10).groupBy("id").count().collect()
    before = files()
    out = KN._kept(spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 97).alias("k")).count(), "freed")
    assert out.count() == 97
    assert files() <= before + 2
