"""Hard negatives by anchor spanning-tree bounds.

A row's score for an anchor is its inner product with the anchor's vector.  The
anchors of a block are joined by a minimum spanning tree; for neighbours p, a in
the tree and a candidate c, |<a, c> - <p, c>| <= |a - p| |c|, so what is known of
the parent's score bounds the child's.  A task walks the tree from its root, keeps
for every candidate the last exact score on the way down and the length of the
path since, and scores only the candidates whose bounds reach into the window the
anchor asks about:

* positives: rows of the anchor's label that can still be among its first ones,
  the window being open above the k-th largest lower bound;
* negatives: rows of other labels whose bounds reach between the lowest and the
  highest score any of the anchor's positives allows.

The anchors are a stated query set, met by all rows in blocks: a task has one block
of anchors with its tree and one part of the rows.  Per task and anchor the first k
go on, so a hot label or a vector that everything repeats adds no rows to the merge.

Scores are exact integers: components are whole numbers, products are summed in
doubles while they stay under 2**53 and in Python integers beyond; pairs with a
score outside 64 bits take no part.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part; a row meets only anchors of its own vector length; rows
with a null id are no anchors and come last among ties; repeated rows are rows of
their own (the copy of an anchor can be its positive); anchors without positives,
and positives without negatives in their window, give no rows; an empty table gives
an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import shuffle_partitions, stored

N_POSITIVES, N_NEGATIVES = 5, 10
#: Hundredths of the positive's score between which a negative's lies.
WINDOW = (30, 90)
#: Anchors in a block (their distance matrix is 8 bytes x the square), and rows in a part.
ANCHOR_ROWS, PART_ROWS = 1024, 32_768
LEAST_PART_ROWS = 1024
#: Whole numbers up to here are exact in a double.
EXACT = float(1 << 53)
NO_ID = np.iinfo(np.int64).max


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
              shift_every: int = 7, labels: int = 10) -> DataFrame:
    """(id, label, vec): rows that take part.  Components become floor(scale * x);
    the label of every ``shift_every``-th id becomes the next one."""
    x = F.col(vector)
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    moved = F.when(F.col(vec_id) % shift_every == 0, (F.col(label) + 1) % labels).otherwise(F.col(label))
    return (rows.filter(F.col(label).isNotNull() & x.isNotNull() & usable)
            .select(F.col(vec_id).cast("long").alias("id"), moved.cast("long").alias("label"),
                    F.transform(x, lambda v: _floor(v.cast("double") * scale)).alias("vec")))


def _floor(x: Column) -> Column:
    """Largest whole number not above ``x``, as a double (doubles from 2**53 on are whole)."""
    return F.when(F.abs(x) < F.lit(EXACT), F.floor(x).cast("double")).otherwise(x)


# ---------------------------------------------------------------------------
# Spanning trees of anchor blocks

_TREE = "uid long, step int, parent int, edge double, last boolean"


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the rows of ``v`` by Euclidean distance, in an order
    in which parents come first: (row, place of the parent or -1, edge length,
    whether it is its parent's last child).  Of a node's children the one with the
    largest subtree comes last: then few nodes wait for children at any time."""
    n = v.shape[0]
    sq = np.einsum("ij,ij->i", v, v)
    near, link = np.full(n, np.inf), np.full(n, -1)
    free = np.ones(n, bool)
    order, at = [0], 0
    free[0] = False
    for _ in range(n - 1):
        d = np.maximum(sq + sq[at] - 2.0 * (v @ v[at]), 0.0)
        closer = free & (d < near)
        near[closer], link[closer] = d[closer], at
        at = int(np.where(free, near, np.inf).argmin())
        if link[at] < 0:  # only distances that are no numbers are left
            link[at] = 0
        free[at] = False
        order.append(at)
    size = np.ones(n, np.int64)
    children: list[list[int]] = [[] for _ in range(n)]
    for x in reversed(order[1:]):
        size[link[x]] += size[x]
        children[link[x]].append(x)
    rows, parent, last, stack = [], [], [], [(0, -1, True)]
    while stack:
        x, p, end = stack.pop()
        at = len(rows)
        rows.append(x)
        parent.append(p)
        last.append(end)
        ranked = sorted(children[x], key=lambda c: (-size[c], c))
        stack.extend((c, at, k == 0) for k, c in enumerate(ranked))
    rows, parent = np.array(rows), np.array(parent)
    edge = np.array([0.0 if p < 0 else float(np.linalg.norm(v[r] - v[rows[p]])) for r, p in zip(rows, parent)])
    return rows, parent, edge, np.array(last)


def _matrix(col) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), values.size // max(len(flat), 1))


def _tree_of(t: pa.Table) -> pa.Table:
    rows, parent, edge, last = spanning_tree(_matrix(t.column("vec")))
    return pa.table({"uid": t.column("uid").combine_chunks().take(pa.array(rows)), "step": pa.array(np.arange(rows.size), pa.int32()),
                     "parent": pa.array(parent, pa.int32()), "edge": pa.array(edge), "last": pa.array(last)})


# ---------------------------------------------------------------------------
# Walking a tree over one part of the rows

def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``c`` with ``a``, as 64-bit integers;
    NO_ID where they do not fit."""
    if not c.size or np.abs(a).max() * np.abs(c).max() * a.size < EXACT:
        return (c @ a).astype(np.int64)
    whole = [int(x) for x in a.tolist()]
    out = [sum(p * int(x) for p, x in zip(whole, row)) for row in c.tolist()]
    return np.array([s if -NO_ID < s < NO_ID else NO_ID for s in out], np.int64)


class Walk:
    """Scores of a block of anchors, in tree order, with one part of the rows."""

    def __init__(self, anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, last: np.ndarray, rows: np.ndarray):
        self.anchors, self.parent, self.edge, self.last, self.rows = anchors, parent, edge, last, rows
        self.norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        self.scored = 0

    def __iter__(self) -> Iterator[tuple[int, Callable, np.ndarray, np.ndarray]]:
        """(anchor, ask, low, high): ``ask(mask)`` gives the places and exact scores
        of the asked rows."""
        alive: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        parents = set(self.parent.tolist())
        for i in range(self.anchors.shape[0]):
            p = self.parent[i]
            if p < 0:
                found = scores(self.anchors[i], self.rows)
                exact, path = found.astype(np.float64), np.where(found == NO_ID, np.inf, 0.0)
                self.scored += self.norm.size
            else:
                exact, path = alive.pop(p) if self.last[i] else tuple(x.copy() for x in alive[p])
                path = path + self.edge[i]
            reach = path * self.norm
            # Roundings of distances, norms and products are far below this slack.
            reach = reach * (1 + 1e-9) + 1e-9 * np.abs(exact) + 0.5

            def ask(mask: np.ndarray, exact=exact, path=path, i=i):
                at = np.flatnonzero(mask)
                found = scores(self.anchors[i], self.rows[at])
                self.scored += at.size
                ok = found != NO_ID
                # A score that does not fit bounds nothing further down.
                exact[at], path[at] = found, np.where(ok, 0.0, np.inf)
                return at[ok], found[ok]

            yield i, ask, exact - reach, exact + reach
            if i in parents:
                alive[i] = (exact, path)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k``: higher scores first, ties by smaller id."""
    if score.size > 8 * k:
        keep = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _sides(left: pa.Table, right: pa.Table):
    a, c = left.sort_by("step"), right
    walk = Walk(_matrix(a.column("vec")), a.column("parent").to_numpy(), a.column("edge").to_numpy(),
                a.column("last").to_numpy(zero_copy_only=False), _matrix(c.column("vec")))
    ids = c.column("id").fill_null(NO_ID).to_numpy()
    return a, walk, a.column("uid").to_numpy(), c.column("uid").to_numpy(), ids, a.column("label").to_numpy(), c.column("label").to_numpy()


_POSITIVE = "anchor long, uid long, id long, score long"
_NEGATIVE = "anchor long, nth int, uid long, id long, score long"


def _found(rows: list, names: list[str], kinds: list) -> pa.Table:
    cols = [np.concatenate(x) if rows else np.empty(0, np.int64) for x in (zip(*rows) if rows else [()] * len(names))]
    arrays = [pa.array(x, k, mask=(x == NO_ID) if n == "id" else None) for x, n, k in zip(cols, names, kinds)]
    return pa.table(dict(zip(names, arrays)))


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            _, walk, auid, cuid, ids, alabel, clabel = _sides(left, right)
            for i, ask, low, high in walk:
                same = (clabel == alabel[i]) & (cuid != auid[i])
                bounds = low[same]
                least = np.partition(bounds, -k)[-k] if bounds.size > k else -np.inf
                at, score = ask(same & (high >= least))
                at, score = (x[_first(score, ids[at], k)] for x in (at, score))
                out.append((np.full(at.size, auid[i]), cuid[at], ids[at], score))
        return _found(out, ["anchor", "uid", "id", "score"], [pa.int64()] * 4)
    return run


def _negatives(k: int, window: tuple[int, int]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            a, walk, auid, cuid, ids, alabel, clabel = _sides(left, right)
            wanted = a.column("positives").to_pylist()
            for i, ask, low, high in walk:
                # window[0] * p <= 100 * s <= window[1] * p, in whole numbers.
                spans = [(p["nth"], -((-window[0] * p["score"]) // 100), (window[1] * p["score"]) // 100) for p in wanted[i]]
                lowest, highest = min((s[1] for s in spans), default=NO_ID), max((s[2] for s in spans), default=-NO_ID)
                at, score = ask((clabel != alabel[i]) & (high >= lowest) & (low <= highest))
                for nth, lo, hi in spans:
                    fits = np.flatnonzero((score >= lo) & (score <= hi))
                    fits = fits[_first(score[fits], ids[at[fits]], k)]
                    out.append((np.full(fits.size, auid[i]), np.full(fits.size, nth), cuid[at[fits]], ids[at[fits]], score[fits]))
        return _found(out, ["anchor", "nth", "uid", "id", "score"], [pa.int64(), pa.int32()] + [pa.int64()] * 3)
    return run


# ---------------------------------------------------------------------------

def _ranked(rows: DataFrame, key: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "uid")
    return rows.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES,
         window: tuple[int, int] = WINDOW) -> DataFrame:
    """(id, label, vec) -> anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.  ``is_anchor`` is a condition on id."""
    spark = rows.sparkSession
    rows = stored(rows.select("id", "label", "vec", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("uid")), "hn-rows")
    anchors = rows.filter(is_anchor & F.col("id").isNotNull())
    n_rows, n_anchors = rows.count(), anchors.count()
    blocks = max(math.ceil(n_anchors / ANCHOR_ROWS), 1)
    parts = max(math.ceil(n_rows / PART_ROWS), min(shuffle_partitions(spark), math.ceil(n_rows / LEAST_PART_ROWS)), 1)
    anchors = stored(anchors.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")), "hn-anchors")
    tree = anchors.groupBy("dim", "block").applyInArrow(_tree_of, _TREE)
    anchors = stored(anchors.join(tree, "uid"), "hn-trees")
    key = ["dim", "block", "part"]
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    met = (rows.select("*", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int").alias("part"))
           .select("*", every(blocks, "block")).groupBy(*key))
    asked = anchors.select("*", every(parts, "part"))
    positives = stored(_ranked(asked.groupBy(*key).cogroup(met).applyInArrow(_positives(n_positives), _POSITIVE),
                               ["anchor"], n_positives, "nth"), "hn-positives")
    of = positives.groupBy("anchor").agg(F.collect_list(F.struct("nth", "score")).alias("positives"))
    # Anchors without a positive stay in the tree: others hang below them.
    none = F.array().cast("array<struct<nth:int,score:bigint>>")
    asked = (stored(anchors.join(of.withColumnRenamed("anchor", "uid"), "uid", "left")
                    .withColumn("positives", F.coalesce("positives", none)), "hn-asked").select("*", every(parts, "part")))
    negatives = _ranked(asked.groupBy(*key).cogroup(met).applyInArrow(_negatives(n_negatives, window), _NEGATIVE),
                        ["anchor", "nth"], n_negatives, "rank")
    return (negatives.select("anchor", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(positives.select("anchor", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                  ["anchor", "nth"])
            .join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def report(embeddings: DataFrame) -> DataFrame:
    return mine(quantised(embeddings), F.col("id") % 100 == 0)
