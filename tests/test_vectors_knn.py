"""Vector parsing/maths and k-NN: broadcast and cell forms against numpy brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.functions import vectors as V
from shelfspark.operators import knn as KN

PARSE_CASES = [
    ("[1, 2.5, -3e-2]", [1.0, 2.5, -0.03]),
    ('"[1, 2]"', [1.0, 2.0]),
    ("'[1, 2]'", [1.0, 2.0]),
    ("[0.1, 0.2, 0.3", [0.1, 0.2, 0.3]),
    ("[1E+2, .5]", [100.0, 0.5]),
    ("[]", None),
    ("nan", None),
    ("  NaN ", None),
    ("some text", None),
    (None, None),
    ("", None),
    ("[0, 0, 0]", [0.0, 0.0, 0.0]),
]


def test_parse_vector(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(PARSE_CASES)], "i int, s string")
    out = {r.i: r.v for r in df.select("i", V.parse_vector("s").alias("v")).collect()}
    for i, (_, want) in enumerate(PARSE_CASES):
        assert out[i] == want, PARSE_CASES[i]


def test_vector_maths(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    out = df.select(V.l2_normalize("a").alias("n"), V.l2_normalize("b").alias("z"), V.l2_distance("a", "b").alias("l2"),
                    V.cosine_distance("a", "b").alias("cos"), V.concat_vectors("a", "b").alias("c")).collect()
    assert out[0].n == [0.6, 0.8] and out[0].z == [0.0, 0.0]
    assert out[0].l2 == 25.0 and out[0].cos == 1.0          # zero vector under cosine -> 1.0
    assert out[1].l2 == 2.0 and out[1].cos == 1.0
    assert out[0].c == [3.0, 4.0, 0.0, 0.0]


def test_zero_fill_and_dims(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    out = [r.v for r in df.select(V.zero_fill("v", 2).alias("v")).collect()]
    assert out == [[1.0, 2.0], [0.0, 0.0]]
    assert V.assert_dim(df, "v") == 2
    ragged = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<float>")
    with pytest.raises(ValueError):
        V.assert_dim(ragged, "v")


def brute(qs, cs, k, space):
    out = []
    for qid, q in qs:
        scored = []
        for cid, c in cs:
            q_, c_ = np.asarray(q, float), np.asarray(c, float)
            if space == "l2":
                d = float(((q_ - c_) ** 2).sum())
            else:
                nq, nc = math.sqrt(q_ @ q_), math.sqrt(c_ @ c_)
                d = 1.0 if nq == 0 or nc == 0 else 1.0 - float(q_ @ c_) / (nq * nc)
            scored.append((d, cid))
        scored.sort(key=lambda x: (round(x[0], 12), x[1]))
        out += [(qid, r + 1, cid, round(d, 9)) for r, (d, cid) in enumerate(scored[:k])]
    return sorted(out)


def _rows(df):
    return sorted((r.qid, r.rank, r.id, round(r.distance, 9)) for r in df.collect())


@pytest.mark.parametrize("space", ["l2", "cosine"])
@pytest.mark.parametrize("strategy,block", [("broadcast", 4096), ("broadcast_queries", 4096), ("cells", 3),
                                            ("cells", 4096), ("auto", 4096)])
def test_knn_matches_brute_force(spark, space, strategy, block):
    rng = np.random.default_rng(7)
    cs = [(i, rng.normal(size=5).round(2).tolist()) for i in range(40)]
    cs.append((40, list(cs[3][1])))                     # exact duplicate -> tie broken by id
    cs.append((41, [0.0] * 5))                           # zero vector
    qs = [(100 + i, rng.normal(size=5).round(2).tolist()) for i in range(12)]
    qs.append((200, list(cs[5][1])))                      # query equal to a stored vector
    qs.append((201, [0.0] * 5))
    cdf = spark.createDataFrame(cs, "id long, vec array<double>")
    qdf = spark.createDataFrame(qs, "qid long, vec array<double>")
    got = _rows(KN.knn_join(qdf, cdf, 4, space, strategy=strategy, block_rows=block))
    assert got == brute(qs, cs, 4, space)


def test_knn_edge_cases(spark):
    cdf = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<double>")
    qdf = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [])], "qid long, vec array<double>")
    got = _rows(KN.knn_join(qdf, cdf, 5, "l2"))            # k larger than the collection
    assert got == [(1, 1, 1, 0.0), (1, 2, 2, 2.0)]
    empty = spark.createDataFrame([], "id long, vec array<double>")
    assert KN.knn_join(qdf, empty, 3, "l2").count() == 0
    noq = spark.createDataFrame([], "qid long, vec array<double>")
    assert KN.knn_join(noq, cdf, 3, "cosine").count() == 0


@pytest.mark.parametrize("space", ["l2", "cosine"])
def test_cells_are_pruned_and_exact(spark, space):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(8, 6)) * 20
    cs = [(i, (centers[i % 8] + rng.normal(size=6)).tolist()) for i in range(240)]
    qs = [(i, (centers[i % 8] + rng.normal(size=6)).tolist()) for i in range(30)]
    cdf = spark.createDataFrame(cs, "id long, vec array<double>")
    qdf = spark.createDataFrame(qs, "qid long, vec array<double>")
    assert _rows(KN.knn_join(qdf, cdf, 5, space, strategy="cells", cells=20)) == brute(qs, cs, 5, space)
    assert _rows(KN.knn_join(qdf, cdf, 300, space, strategy="cells")) == brute(qs, cs, 300, space)


def test_long_keys_count_against_the_broadcast_bound(spark):
    cdf = spark.createDataFrame([("x" * 10_000 + str(i), [float(i)]) for i in range(20)], "id string, vec array<double>")
    with pytest.raises(ValueError):
        KN.knn_join(cdf.withColumnRenamed("id", "qid"), cdf, 1, strategy="broadcast", broadcast_bytes=100_000)


def test_routed_knn(spark):
    text = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<double>")
    image = spark.createDataFrame([(7, [1.0]), (8, [-1.0])], "id long, vec array<double>")
    mm = spark.createDataFrame([(1, [1.0, 0.0, 1.0]), (2, [0.0, 1.0, -1.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.0], [1.0]), (11, [0.0, 1.0], None), (12, None, [-1.0]), (13, None, None)],
                              "qid long, text_vec array<double>, image_vec array<double>")
    hits = KN.routed_knn(q, {"multimodal": mm, "text": {"df": text, "space": "cosine"}, "image": image}, 1)
    got = sorted((r.qid, r.route, r.id) for r in hits.collect())
    assert got == [(10, "multimodal", 1), (11, "text", 2), (12, "image", 8)]
    assert [r.qid for r in KN.unroutable(q).collect()] == [13]
    with pytest.raises(ValueError):
        KN.routed_knn(q, {"text": text}, 1)
    assert KN.routed_knn(q, {"text": text}, 1, wanted=("text",)).count() == 1


def test_ivf_recall_and_full_probe(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8)) * 4
    cs = [(i, (centers[i % 6] + rng.normal(size=8)).round(3).tolist()) for i in range(300)]
    qs = [(1000 + i, (centers[i % 6] + rng.normal(size=8)).round(3).tolist()) for i in range(40)]
    cdf = spark.createDataFrame(cs, "id long, vec array<double>")
    qdf = spark.createDataFrame(qs, "qid long, vec array<double>")
    exact = _rows(KN.knn_join(qdf, cdf, 5, "l2"))
    index = KN.ivf_build(cdf, 6, space="l2", seed=5)
    # Probing every cell is exact; block splitting of cells must not change results.
    assert _rows(KN.ivf_join(qdf, index, 5, probe=6, block_rows=17)) == exact
    approx = KN.ivf_join(qdf, index, 5, probe=2)
    want = {(q, i) for q, _, i, _ in exact}
    got = {(r.qid, r.id) for r in approx.collect()}
    assert len(got & want) / len(want) >= 0.8


@pytest.mark.parametrize("space", ["l2", "cosine"])
def test_knn_many_exact_ties_use_id_order(spark, space):
    # More tied rows than the kernel's candidate pad: the fallback must order by id.
    same = [1.0, 2.0, 3.0]
    cs = [(i, list(same)) for i in range(40, 10, -1)] + [(100 + i, [float(i), -1.0, 0.5]) for i in range(10)]
    cdf = spark.createDataFrame(cs, "id long, vec array<double>")
    qdf = spark.createDataFrame([(1, list(same)), (2, [0.0, 0.0, 0.0])], "qid long, vec array<double>")
    got = _rows(KN.knn_join(qdf, cdf, 5, space))
    assert got == brute([(1, same), (2, [0.0, 0.0, 0.0])], cs, 5, space)
    assert [r[2] for r in got if r[0] == 1] == [11, 12, 13, 14, 15]


def _spread(seed, n, dim, axes):
    """Vectors whose spread lies in a few directions, none along a coordinate."""
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(np.random.default_rng(99).normal(size=(dim, dim)))[0]
    scale = np.where(np.arange(dim) < axes, 5.0, 0.1)
    return ((rng.normal(size=(n, dim)) * scale) @ turn).round(4).tolist()


@pytest.mark.parametrize("space", ["l2", "cosine"])
def test_axes_are_exact_and_spare_distances(spark, space):
    cs = list(enumerate(_spread(1, 900, 12, 4)))
    cs += [(2000 + i, list(cs[0][1])) for i in range(30)] + [(3000, [0.0] * 12)]
    qs = [(i, v) for i, v in enumerate(_spread(2, 40, 12, 4))] + [(100, list(cs[0][1])), (101, [0.0] * 12)]
    cdf = spark.createDataFrame(cs, "id long, vec array<double>")
    qdf = spark.createDataFrame(qs, "qid long, vec array<double>")
    assert _rows(KN.knn_join(qdf, cdf, 5, space, strategy="axes", block_rows=16)) == brute(qs, cs, 5, space)
    full = {r.qid: r.full for r in KN.knn_axes(qdf, cdf, 5, space).collect()}
    spread = [full[i] for i in range(40)]
    assert sum(spread) < 0.25 * 40 * len(cs)
    assert KN.knn_axes(qdf, cdf.limit(0), 5, space).count() == 0


def test_auto_ships_the_smaller_side(spark):
    cdf = spark.range(400).select("id", F.array(*[(F.col("id") * (i + 1) % 17).cast("double") for i in range(4)]).alias("vec"))
    few = cdf.where("id < 3").withColumnRenamed("id", "qid")
    plan = lambda q: KN.knn_join(q, cdf, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan(few) and "Window" not in plan(cdf.withColumnRenamed("id", "qid"))


@pytest.mark.parametrize("space", ["l2", "cosine"])
def test_quantised_lists(spark, space):
    rng = np.random.default_rng(8)
    vs = rng.normal(size=(1500, 24)).round(3)
    cdf = spark.createDataFrame([(i, v) for i, v in enumerate(vs.tolist())], "id long, vec array<double>")
    index = KN.pq_build(cdf, 16, 12, space=space, seed=3)
    assert index["codes"].select(F.octet_length("code").alias("n")).distinct().collect()[0].n == 12
    qs = cdf.where("id % 10 = 0").withColumnRenamed("id", "qid")
    exact = KN.knn_join(qs, cdf, 5, space)
    search = lambda s, p: KN.pq_join(s, index, 5, p)
    probe = KN.probe_for(qs, index, 5, 0.9, n_sample=60, search=search)
    found = search(qs, probe)
    assert 1 <= probe <= 16 and KN.recall(found, exact) >= 0.85
    # All cells and every row fetched again: exact.
    assert _rows(KN.pq_join(qs, index, 5, 16, rerank=300)) == _rows(exact)
    assert KN.recall(KN.ivf_join(qs, index, 5, 16), exact) == 1.0


def test_short_lists_are_filled(spark):
    """A query whose nearest cells hold fewer than k rows searches further ones."""
    rng = np.random.default_rng(2)
    cs = [(i, (rng.normal(size=3) + (40 * (i % 25))).tolist()) for i in range(75)]
    cdf = spark.createDataFrame(cs, "id long, vec array<double>")
    index = KN.ivf_build(cdf, 25, seed=4)
    qs = cdf.withColumnRenamed("id", "qid")
    assert KN.ivf_join(qs, index, 10, probe=1).groupBy("qid").count().where("count <> 10").count() == 0
