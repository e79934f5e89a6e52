"""Searches by parts of the corpus: exact against brute force, each row sent a few times."""

import numpy as np
import pandas as pd
import pytest

from shelfspark.operators import encode as EN
from shelfspark.operators import knn as KN
from tests.test_vectors_knn import _rows, brute


def _data(n=900, m=60, dim=6):
    rng = np.random.default_rng(5)
    cs = [(i, rng.normal(size=dim).round(2).tolist()) for i in range(n)]
    cs += [(n + i, cs[3][1]) for i in range(200)] + [(n + 200, [0.0] * dim)]
    qs = [(10_000 + i, rng.normal(size=dim).round(2).tolist()) for i in range(m)] + [(20_000, cs[3][1]), (20_001, [0.0] * dim)]
    return qs, cs


def _frames(spark, qs, cs):
    return spark.createDataFrame(qs, "qid long, vec array<double>"), spark.createDataFrame(cs, "id long, vec array<double>")


@pytest.mark.parametrize("space", ["l2", "cosine"])
def test_part_in_slices_and_cells(space, monkeypatch):
    monkeypatch.setattr(KN, "SLICE", 16)
    monkeypatch.setattr(KN, "CHUNK", 32)
    monkeypatch.setattr(KN, "NEAR", 64)
    qs, cs = _data()
    e, q = np.array([v for _, v in cs]), np.array([v for _, v in qs])
    cell = np.arange(len(e)) % 7 - 1
    part = KN._Part([i for i, _ in cs], e, space, cell)
    found = part.top(np.array([i for i, _ in qs]), q, 5, np.ones((len(q), 7), bool), np.zeros((len(q), 7)))
    assert sorted((r.qid, r.rank, r.id, round(r.distance, 9)) for r in found.itertuples()) == brute(qs, cs, 5, space)


def test_cells_of_a_part_are_sent_together(spark, monkeypatch):
    """A query goes to parts, not to each of its cells."""
    monkeypatch.setattr(KN, "SLICE", 32)
    qs, cs = _data(n=400)
    q, c = _frames(spark, qs, cs)
    sent = []
    kept = KN._kept
    monkeypatch.setattr(KN, "_kept", lambda df, name: sent.append((name, kept(df, name))) or sent[-1][1])
    got = _rows(KN.knn_join(q, c, 5, "l2", strategy="cells", cells=40, block_rows=150))
    assert got == brute(qs, cs, 5, "l2")
    parts = dict(sent)["knn-needed"].selectExpr("max(size(parts)) AS n").first().n
    assert parts <= 16


def test_copies_travel_once(spark):
    """of a vector that occurs often only the k smallest ids can be found."""
    qs, cs = _data(n=30)
    q, c = _frames(spark, qs, cs)
    assert KN._least_copies(c, 3).count() == 30 + 2 + 1
    assert _rows(KN.knn_join(q, c, 3, "cosine", strategy="broadcast_queries")) == brute(qs, cs, 3, "cosine")


def test_streamed_corpus_is_held_in_parts(spark, monkeypatch):
    """the lists are per task or part, not one per query and Arrow batch."""
    qs, cs = _data(n=500)
    q, c = _frames(spark, qs, cs)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(KN, "_least_copies", lambda df, k: df.coalesce(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        hits = KN.knn_join(q, c, 3, "l2", strategy="broadcast_queries")
        assert _rows(hits) == brute(qs, cs, 3, "l2")
        lists = KN._streamed(c.coalesce(1), [i for i, _ in qs], np.array([v for _, v in qs]), 3, "l2", hits.schema)
        assert lists.count() == 3 * len(qs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


class _Here:
    """Stands for a corpus: runs the function of ``mapInPandas`` in this process."""

    def __init__(self, batches):
        self.sparkSession = self.sparkContext = self
        self.batches = batches

    def broadcast(self, value):
        self.value = value
        return self

    def mapInPandas(self, run, schema):
        return pd.concat(run(iter(self.batches)))


@pytest.mark.parametrize("batch", [700, 10_000, 60_000])
def test_streamed_rows_held_at_a_time_are_bounded(monkeypatch, batch):
    """what a task holds grows neither with the corpus nor with its Arrow batches."""
    rng = np.random.default_rng(8)
    e, q = rng.normal(size=(60_000, 8)), rng.normal(size=(40, 8))
    held, made = [], KN._Part.__init__
    monkeypatch.setattr(KN._Part, "__init__", lambda self, ids, e, *a: held.append(len(ids)) or made(self, ids, e, *a))
    batches = [pd.DataFrame({"id": range(i, min(i + batch, len(e))), "vec": list(e[i:i + batch])}) for i in range(0, len(e), batch)]
    got = KN._streamed(_Here(batches), list(range(40)), q, 3, "l2", None)
    assert sum(held) == len(e) and max(held) < 2 * 8192
    d = ((q[:, None, :] - e[None, :, :]) ** 2).sum(axis=2)
    best = got.sort_values(["qid", "distance"]).groupby("qid").head(3)
    assert best["id"].tolist() == np.argsort(d, axis=1)[:, :3].ravel().tolist()


def test_streamed_corpus_is_encoded_once(spark):
    """a filter on the vectors ran the encoder twice, with two Python workers per task."""
    texts = [(i, f"word{i % 7} other{i % 3} more{i}") for i in range(60)]
    calls = spark.sparkContext.accumulator(0)

    def model():
        def fn(values):
            calls.add(sum(v is not None for v in values))
            return [None if v is None else [] if "word6" in v else [float(len(v)), float(v.count("o")), float(v[-1])] for v in values]
        return fn

    docs = spark.createDataFrame([*texts, (60, None), (None, None)], "id long, text string")
    c = EN.encode(docs, "text", model)
    qs = [(0, [9.0, 2.0, 1.0]), (1, [18.0, 3.0, 5.0])]
    q = spark.createDataFrame(qs, "qid long, vec array<double>")
    hits = KN.knn_join(q, c, 4, "l2", strategy="broadcast_queries", dim=3)
    cs = [(i, [float(len(v)), float(v.count("o")), float(v[-1])]) for i, v in texts if "word6" not in v]
    assert _rows(hits) == brute(qs, cs, 4, "l2")
    assert calls.value == len(texts)


def test_grid_repeats_few_rows():
    """with 600,000 vectors no row is sent to more than some 20 tasks, and no task holds all."""
    blocks, parts = KN._grid(615_000, 615_000, KN.BLOCK_QUERIES, KN.AXES_PART, 24)
    assert blocks + parts < 32 and parts * KN.AXES_PART >= 615_000 and blocks * KN.BLOCK_QUERIES >= 615_000
    assert np.prod(KN._grid(100_000, 100_000, KN.BLOCK_QUERIES, KN.PART_ROWS, 24)) >= 24


def test_ivf_trains_on_a_bounded_sample_and_holds_every_row(spark, monkeypatch):
    """k-means must not grow with the rows times their square root."""
    monkeypatch.setattr(KN, "TRAIN_PER_CELL", 20)
    qs, cs = _data(n=600)
    q, c = _frames(spark, qs, cs)
    from pyspark.ml.clustering import KMeans

    seen, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    index = KN.ivf_build(c, 10, space="l2", seed=3)
    assert seen[0] < 400 and index["df"].count() == len(cs)
    assert _rows(KN.ivf_join(q, index, 5, probe=10)) == brute(qs, cs, 5, "l2")
