"""k-nearest-neighbour joins over vector tables.

``knn_join(queries, corpus, k, space)`` returns one row per (query, rank):
``qid, rank, id, distance`` with the closest first and ties broken by id.
Distances: ``l2`` is squared Euclidean, ``cosine`` is ``1 - cos`` (1.0 for a zero
vector).  Results are exact.

Strategies
----------
broadcast  The corpus is small enough (vectors and keys <= ``broadcast_bytes``,
           measured before anything is collected): it is shipped once as a numpy
           matrix and each query partition computes its own top-k with a matrix
           product (``mapInPandas``).  No shuffle at all.
broadcast_queries
           The query side is the small one (e.g. a few distinct questions against
           a large corpus): queries are shipped, the corpus streams through
           ``mapInPandas`` and per-partition top-k lists are merged by a window.
cells      Both sides large: the corpus is cut into cells around pivots.  With the
           count and radius of every cell, the triangle inequality bounds each
           query's k-th distance from above and every cell's distance from below;
           a query only goes to cells that can still hold one of its k nearest.
           Exact for any data; how many cells are left depends on how well the
           data cluster.  ``ivf_join`` is the approximate form, for the caller to
           choose.

axes       Both sides large and no clusters to cut along: see ``knn_axes``.

``auto`` ships the smaller side if one fits, and takes cells otherwise.  All
strategies return the same rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions import vectors as V

DEFAULT_BROADCAST_BYTES = 256 << 20
#: With both sides under the bound, queries are shipped if the corpus is larger by this factor.
FEW_QUERIES = 4
#: Queries whose distances to all cells are held at a time.
QUERY_SLICE = 256
_TILE_ELEMS = 1 << 22  # distance-matrix elements per numpy tile
#: Rows of the corpus, and queries, that a task holds at most.
PART_ROWS, BLOCK_QUERIES = 131_072, 65_536
#: Rows of the lists that a task returns for a block of queries, about.
LIST_ROWS = 1 << 20
#: Rows of a streamed corpus that are gathered before they are compared, unless the
#: queries' lists are longer.
STREAM_ROWS = 8192
#: Queries and corpus rows that are compared at a time, and how many rows near the
#: best k are gathered before they are ranked.
SLICE, CHUNK, NEAR = 1024, 4096, 1 << 20
#: Pairs whose exact distance is computed at a time.
PAIRS = 1 << 13
TIE_DIGITS = 12
#: Bits per wanted row, and in all, of ``possible_matches``.
MATCH_BITS, MATCH_MOST = 16, 1 << 28


# ---------------------------------------------------------------------------
# numpy kernel (runs inside tasks)

def _as_matrix(vectors, dim: int | None = None) -> np.ndarray:
    """Rows of equal width -> float64 matrix (pandas/Arrow arrays, no Python floats)."""
    if len(vectors) == 0:
        return np.zeros((0, dim or 0), dtype=np.float64)
    values = vectors.to_numpy() if hasattr(vectors, "to_numpy") else vectors
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in values])
    if dim is not None and m.shape[1] != dim:
        raise ValueError(f"vector width {m.shape[1]} != {dim}")
    return m


def _exact_row(qv: np.ndarray, cand: np.ndarray, e: np.ndarray, e_norm: np.ndarray, space: str) -> np.ndarray:
    ev = e[cand]
    if space == "l2":
        diff = ev - qv[None, :]
        return np.einsum("ij,ij->i", diff, diff)
    qn = math.sqrt(float(qv @ qv))
    den = qn * e_norm[cand]
    dots = ev @ qv
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(den > 0, 1.0 - dots / np.where(den > 0, den, 1.0), 1.0)


def _topk_block(q: np.ndarray, e: np.ndarray, e_sq: np.ndarray, e_norm: np.ndarray, id_rank: np.ndarray, k: int, space: str):
    """Exact top-k of every row of ``q`` against ``e``: arrays (query index, rank,
    corpus index, distance).

    Per tile of queries: the matrix form ranks all corpus rows, ``argpartition``
    keeps ``k + 8`` candidates per query, the candidates are re-scored with the
    direct formula and ordered by (distance rounded to ``TIE_DIGITS``, id) with
    one ``lexsort``.  A query whose k-th distance is not clearly below every
    non-candidate (ties or rounding near the cut) is redone on its own with all
    rows within tolerance of the k-th value, so results are exact.
    """
    n, dim = e.shape
    none = np.empty(0, np.int64)
    if n == 0 or q.shape[0] == 0:
        return none, none, none, np.empty(0)
    kk = min(k, n)
    pad = min(n, kk + 8)
    step = max(1, min(_TILE_ELEMS // n, _TILE_ELEMS // (pad * max(dim, 1))))
    e_sq_max = float(e_sq.max())
    hit, dist = np.empty((q.shape[0], kk), np.int64), np.empty((q.shape[0], kk))
    for start in range(0, q.shape[0], step):
        qs = q[start:start + step]
        m = qs.shape[0]
        prod = qs @ e.T
        q_sq = np.einsum("ij,ij->i", qs, qs)
        if space == "l2":
            approx = np.maximum(q_sq[:, None] - 2.0 * prod + e_sq[None, :], 0.0)
            tol = 1e-9 * (q_sq + e_sq_max + 1.0)
        else:
            q_norm = np.sqrt(q_sq)
            denom = q_norm[:, None] * e_norm[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                approx = np.where(denom > 0, 1.0 - prod / np.where(denom > 0, denom, 1.0), 1.0)
            tol = np.full(m, 2e-9)
        if pad < n:
            part = np.argpartition(approx, pad - 1, axis=1)[:, :pad]
            bound = np.take_along_axis(approx, part, 1).max(axis=1)
        else:
            part = np.broadcast_to(np.arange(n), (m, n)).copy()
            bound = np.full(m, np.inf)
        ev = e[part]
        if space == "l2":
            diff = ev - qs[:, None, :]
            exact = np.einsum("mpd,mpd->mp", diff, diff)
        else:
            dots = np.einsum("mpd,md->mp", ev, qs)
            den = q_norm[:, None] * e_norm[part]
            with np.errstate(divide="ignore", invalid="ignore"):
                exact = np.where(den > 0, 1.0 - dots / np.where(den > 0, den, 1.0), 1.0)
        # Distances equal to TIE_DIGITS decimals are ties broken by id, so
        # summation-order noise cannot reorder results between engines.
        key = np.round(exact, TIE_DIGITS) + 0.0
        order = np.lexsort((id_rank[part], key), axis=1)[:, :kk]
        hit[start:start + m] = np.take_along_axis(part, order, 1)
        dist[start:start + m] = np.take_along_axis(exact, order, 1)
        safe = np.take_along_axis(key, order, 1)[:, -1] + 2 * tol < bound
        for r in np.flatnonzero(~safe).tolist():
            kth = np.partition(approx[r], kk - 1)[kk - 1]
            cand = np.nonzero(approx[r] <= kth + 2 * tol[r])[0]
            ex = _exact_row(qs[r], cand, e, e_norm, space)
            rows = np.lexsort((id_rank[cand], np.round(ex, TIE_DIGITS) + 0.0))[:kk]
            hit[start + r], dist[start + r] = cand[rows], ex[rows]
    return (np.repeat(np.arange(q.shape[0]), kk), np.tile(np.arange(1, kk + 1), q.shape[0]), hit.ravel(), dist.ravel())


class _Part:
    """Rows of the corpus that a task holds, by cell: all are compared in single
    precision, and those within its error of a query's best k are ranked exactly."""

    def __init__(self, ids, e: np.ndarray, space: str, cell: np.ndarray | None = None):
        order = np.argsort(cell, kind="stable") if cell is not None else slice(None)
        self.ids, self.e, self.space = np.asarray(ids, dtype=object)[order], e[order], space
        self.cells, start = np.unique(cell[order], return_index=True) if cell is not None else (None, [*range(0, len(e), CHUNK)])
        self.start, self.stop = list(start), [*start[1:], len(e)]
        self.id_rank = np.empty(len(self.ids), np.int64)
        self.id_rank[np.argsort(np.array(list(self.ids)), kind="stable")] = np.arange(len(self.ids))
        sq = np.einsum("ij,ij->i", self.e, self.e)
        self.norm, self.most = np.sqrt(sq), float(np.sqrt(sq.max(initial=0.0)))
        #: Products with a query order rows as distances do, the nearest the largest.
        self.b = _unit(self.e, space) if space == "cosine" else np.c_[self.e, sq]
        self.single = np.isfinite(sq).all() and self.most < 1e15
        if self.single:
            self.b = self.b.astype(np.float32)

    def top(self, qids: np.ndarray, q: np.ndarray, k: int, cells: np.ndarray | None = None, low: np.ndarray | None = None) -> pd.DataFrame:
        """The k best per query; with ``cells`` (queries x cells of the part) of those
        cells only, where ``low`` bounds the (Euclidean) distance of their rows from below."""
        found = [self._slice(q[i:i + SLICE], k, *(None if x is None else x[i:i + SLICE] for x in (cells, low)))
                 for i in range(0, len(q), SLICE)]
        at = np.concatenate([i + SLICE * n for n, (i, _, _, _) in enumerate(found)]) if found else np.empty(0, np.int64)
        rank, hit, dist = (np.concatenate([f[n] for f in found]) if found else np.empty(0) for n in (1, 2, 3))
        hit = hit.astype(np.int64)
        return pd.DataFrame({"qid": np.asarray(qids, dtype=object)[at], "rank": rank.astype(np.int32), "id": self.ids[hit], "distance": dist})

    def _slice(self, q: np.ndarray, k: int, cells, low):
        m, k = len(q), min(k, len(self.ids))
        q_sq = np.einsum("ij,ij->i", q, q)
        zero = q_sq == 0 if self.space == "cosine" else np.zeros(m, bool)
        if self.space == "cosine":
            a, size = _unit(q, "cosine"), np.ones(m)
        else:
            a, size = np.c_[2.0 * q, np.full(m, -1.0)], (2.0 * np.sqrt(q_sq) + self.most) * self.most
        single = self.single and np.isfinite(q_sq).all() and float(np.abs(a).max(initial=0.0)) < 1e15
        a, b = (a.astype(np.float32), self.b) if single else (a, self.b.astype(np.float64))
        tol = 2.0 * ((self.b.shape[1] + 8) * (1.2e-7 if single else 2.3e-16) * size + 1e-11)
        best, near, held = np.full((m, k), -np.inf), [], 0
        for c in self._order(low):
            ask = ~zero if cells is None else cells[:, c] & ~zero
            if low is not None:
                # The distance of the k-th best so far, as a square.
                kth = best[:, -1]
                far = np.where(np.isneginf(kth), np.inf, (2.0 * (1.0 - kth) if self.space == "cosine" else q_sq - kth))
                ask = ask & (low[:, c] ** 2 <= far + 4.0 * tol)
            which = np.flatnonzero(ask)
            for start in range(self.start[c], self.stop[c], CHUNK) if which.size else ():
                stop = min(start + CHUNK, self.stop[c])
                s = (a if which.size == m else a[which]) @ b[start:stop].T
                if not (single and self.single):
                    s = np.nan_to_num(s, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                limit = best[which, -1]
                new = np.flatnonzero(np.isneginf(limit))
                if new.size and stop - start > k:
                    limit[new] = np.partition(s[new], stop - start - k, axis=1)[:, stop - start - k]
                at = np.flatnonzero(s >= (limit - tol[which]).astype(s.dtype)[:, None])
                if not at.size:
                    continue
                i, j = np.divmod(at, stop - start)
                _kept_best(best, which[i], s.ravel()[at])
                near.append((which[i], j + start))
                held += at.size
                if held > NEAR:
                    near = [self._ranked(q, q_sq, near, k)[:2]]
                    held = len(near[0][0])
        for i in np.flatnonzero(zero):
            # At distance 1 from everything: the smallest ids.
            rows = (np.arange(len(self.ids)) if cells is None else
                    np.concatenate([np.arange(self.start[c], self.stop[c]) for c in np.flatnonzero(cells[i])] or [np.empty(0, np.int64)]))
            rows = rows[np.argsort(self.id_rank[rows])[:k]]
            near.append((np.full(len(rows), i), rows))
        return self._ranked(q, q_sq, near, k, True)

    def _order(self, low):
        """Cells near to the slice come first: they set the limit for the others."""
        return range(len(self.start)) if low is None else np.argsort(low.mean(axis=0), kind="stable").tolist()

    def _ranked(self, q: np.ndarray, q_sq: np.ndarray, near: list, k: int, ranks: bool = False):
        """Query, row and exact distance of the k best of ``near`` by (distance, id)."""
        i, j = (np.concatenate([n[x] for n in near]) if near else np.empty(0, np.int64) for x in (0, 1))
        d = np.empty(len(i))
        for x in range(0, len(i), PAIRS):
            y = slice(x, x + PAIRS)
            if self.space == "l2":
                diff = self.e[j[y]] - q[i[y]]
                d[y] = np.einsum("ij,ij->i", diff, diff)
            else:
                den = np.sqrt(q_sq[i[y]]) * self.norm[j[y]]
                dots = np.einsum("ij,ij->i", self.e[j[y]], q[i[y]])
                d[y] = np.where(den > 0, 1.0 - dots / np.where(den > 0, den, 1.0), 1.0)
        order = np.lexsort((self.id_rank[j], np.round(d, TIE_DIGITS) + 0.0, i))
        i, j, d = i[order], j[order], d[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        top = nth < k
        return (i[top], nth[top] + 1, j[top], d[top]) if ranks else (i[top], j[top], d[top])


def _kept_best(best: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
    """Puts the scores ``s`` of the rows ``i`` (ascending) into the lists ``best``."""
    k, rows = best.shape[1], np.unique(i)
    at, v = np.r_[i, np.repeat(rows, k)], np.r_[s, best[rows].ravel()].astype(np.float64)
    order = np.lexsort((-v, at))
    at, v = at[order], v[order]
    top = np.arange(len(at)) - np.searchsorted(at, at) < k
    best[rows] = v[top].reshape(len(rows), k)


class _Corpus:
    """A block of the corpus: ids, their order, vectors and norms, once per block."""

    def __init__(self, ids, e: np.ndarray):
        self.ids, self.e = np.asarray(ids, dtype=object), e
        self.e_sq = np.einsum("ij,ij->i", e, e) if len(e) else np.zeros(0)
        self.e_norm = np.sqrt(self.e_sq)
        self.id_rank = np.empty(len(self.ids), np.int64)
        self.id_rank[np.argsort(np.array(list(ids)), kind="stable")] = np.arange(len(self.ids))

    def top(self, qids: np.ndarray, qm: np.ndarray, k: int, space: str) -> pd.DataFrame:
        i, rank, hit, dist = _topk_block(qm, self.e, self.e_sq, self.e_norm, self.id_rank, k, space)
        return pd.DataFrame({"qid": qids[i], "rank": rank.astype(np.int32), "id": self.ids[hit], "distance": dist})


# ---------------------------------------------------------------------------
# DataFrame operators

def _result_schema(qid_type, id_type) -> T.StructType:
    return T.StructType([
        T.StructField("qid", qid_type, False),
        T.StructField("rank", T.IntegerType(), False),
        T.StructField("id", id_type, False),
        T.StructField("distance", T.DoubleType(), False),
    ])


def _normalise_inputs(queries, corpus, qid, qvec, cid, cvec):
    q = queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("vec")) \
               .where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    c = corpus.select(F.col(cid).alias("id"), F.col(cvec).alias("vec")) \
              .where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    return q, c


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, space: str = "l2", *,
             qid: str = "qid", qvec: str = "vec", cid: str = "id", cvec: str = "vec",
             strategy: str = "auto", broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
             block_rows: int | None = None, dim: int | None = None, cells: int | None = None) -> DataFrame:
    """Exact k nearest corpus rows for every query row.

    ``dim`` (the vector width, when the caller knows it, e.g. an encoder's
    output width) saves computing one corpus vector for the size check.
    ``cells`` sets the number of cells of the ``cells`` strategy (about the square
    root of the corpus otherwise), ``block_rows`` the rows and queries per task
    (PART_ROWS and BLOCK_QUERIES otherwise).
    """
    if space not in ("l2", "cosine"):
        raise ValueError(f"unknown space {space!r}")
    if k <= 0:
        raise ValueError("k must be positive")
    q, c = _normalise_inputs(queries, corpus, qid, qvec, cid, cvec)
    schema = _result_schema(q.schema["qid"].dataType, c.schema["id"].dataType)
    # Rows and key bytes of the unfiltered inputs: the vector columns are pruned
    # (an encoder UDF is not run).  The width comes from one row.
    n_corpus, corpus_keys = _measure(corpus, cid)
    if n_corpus == 0:
        return q.sparkSession.createDataFrame([], schema)
    if dim is None:
        first = c.select(F.size("vec").alias("d")).first()
        if first is None:
            return q.sparkSession.createDataFrame([], schema)
        dim = int(first["d"])
    corpus_bytes = n_corpus * dim * 8 + corpus_keys
    if strategy == "broadcast":
        if corpus_bytes > broadcast_bytes:
            raise ValueError("corpus exceeds the broadcast bound; use strategy='cells'")
        return _knn_broadcast(q, c, k, space, schema)
    if strategy in ("auto", "broadcast_queries"):
        n_queries, query_keys = _measure(queries, qid)
        query_bytes = n_queries * dim * 8 + query_keys
        if strategy == "broadcast_queries" and query_bytes > broadcast_bytes:
            raise ValueError("queries exceed the broadcast bound; use strategy='cells'")
        # The smaller side travels; shipped queries cost a merge of lists besides.
        if query_bytes <= broadcast_bytes and (strategy != "auto" or FEW_QUERIES * query_bytes < corpus_bytes or corpus_bytes > broadcast_bytes):
            # Not ``c``: its filter would move below the encoder and run it once more.
            return _knn_broadcast_queries(q, corpus.select(F.col(cid).alias("id"), F.col(cvec).alias("vec")), k, space, schema, n_corpus)
        if corpus_bytes <= broadcast_bytes:
            return _knn_broadcast(q, c, k, space, schema)
    if strategy == "axes":
        return knn_axes(q, c, k, space, qid="qid", qvec="vec", cid="id", cvec="vec", block_rows=block_rows or BLOCK_QUERIES).drop("full")
    if strategy not in ("auto", "cells"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return _knn_cells(q, c, k, space, schema, cells or math.ceil(math.sqrt(n_corpus)), block_rows)


def _measure(df: DataFrame, key: str) -> tuple[int, int]:
    """Rows, and bytes of the keys as text."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(key).cast("string"))).alias("b")).first()
    return int(r.n), int(r.b or 0)


def _collect_matrix(df: DataFrame, key: str):
    """Arrow collect of a size-checked side: keys and a float64 matrix."""
    tbl = df.select(key, F.col("vec").cast("array<double>").alias("vec")).toArrow()
    keys = np.asarray(tbl.column(key).to_pylist(), dtype=object)
    vec = tbl.column("vec").combine_chunks()
    widths = np.diff(vec.offsets.to_numpy())
    if len(widths) and widths.min() != widths.max():
        raise ValueError("ragged vectors")
    dim = int(widths[0]) if len(widths) else 0
    m = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), dim)
    return keys, m


def _knn_broadcast_queries(q: DataFrame, c: DataFrame, k: int, space: str, schema, n_corpus: int) -> DataFrame:
    """Small query side: queries are broadcast, the corpus streams through
    ``mapInPandas`` emitting each query's local top-k per partition, and a
    ``row_number() <= k`` window merges them (partial limit before the shuffle)."""
    qids, qm = _collect_matrix(q, "qid")
    # A task gives a list per query: no more tasks than the machine takes, unless the
    # lists of all are shorter than the corpus.
    tasks = max(_tasks(c.sparkSession), n_corpus // max(k * len(qids), 1))
    cand = _streamed(_least_copies(c, k).coalesce(tasks), qids, qm, k, space, schema)
    w = Window.partitionBy("qid").orderBy(F.round("distance", TIE_DIGITS), "id")
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select("qid", F.col("rank").cast("int").alias("rank"), "id", "distance"))


def _streamed(c: DataFrame, qids, qm: np.ndarray, k: int, space: str, schema) -> DataFrame:
    """The k best of every query among the rows of each task, or of each part of many rows.

    A part has about as many rows as the queries' lists, STREAM_ROWS at least and
    PART_ROWS // 4 at most, and large Arrow batches are cut: what a task holds depends
    neither on the size of the corpus nor on that of a batch.
    """
    bc = c.sparkSession.sparkContext.broadcast((np.asarray(qids, dtype=object), qm))

    def run(batches):
        qids_b, qm_b = bc.value
        rows = min(max(k * len(qids_b), STREAM_ROWS), PART_ROWS // 4)
        # One list per query and part, not per Arrow batch.
        ids, parts = [], []
        for pdf in batches:
            for start in range(0, len(pdf), rows) if len(qids_b) else ():
                cut = pdf.iloc[start:start + rows]
                ids += cut["id"].tolist()
                parts.append(_as_matrix(cut["vec"]))
                if len(ids) >= rows:
                    yield from top(qids_b, qm_b, ids, parts)
                    ids, parts = [], []
        if ids:
            yield from top(qids_b, qm_b, ids, parts)

    def top(qids_b, qm_b, ids, parts):
        part = _Part(ids, np.concatenate(parts), space)
        for i in range(0, len(qids_b), BLOCK_QUERIES):
            yield part.top(qids_b[i:i + BLOCK_QUERIES], qm_b[i:i + BLOCK_QUERIES], k)

    return c.mapInPandas(run, schema)


def _knn_broadcast(q: DataFrame, c: DataFrame, k: int, space: str, schema) -> DataFrame:
    spark = q.sparkSession
    # Bounded by the size check in knn_join; the only vectors that reach the
    # driver, moved as Arrow buffers (no per-float Python objects).
    ids, e = _collect_matrix(c, "id")
    dim = e.shape[1]
    bc = spark.sparkContext.broadcast(_Corpus(ids, e))

    def run(batches):
        for pdf in batches:
            if not pdf.empty:
                yield bc.value.top(pdf["qid"].to_numpy(), _as_matrix(pdf["vec"], dim), k, space)

    return q.mapInPandas(run, schema)


MAX_CELLS = 4096


def _unit(m: np.ndarray, space: str) -> np.ndarray:
    """Vectors whose Euclidean distances order like ``space``."""
    if space == "l2":
        return m
    n = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return m / np.where(n > 0, n, 1.0)


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", m, m)[:, None] - 2.0 * (m @ pivots.T) + np.einsum("ij,ij->i", pivots, pivots)[None, :]
    return np.sqrt(np.maximum(d, 0.0))


def _knn_cells(q: DataFrame, c: DataFrame, k: int, space: str, schema, cells: int, block_rows: int | None) -> DataFrame:
    """Exact search over cells.  Pivots (at most MAX_CELLS vectors) and one row of
    count and radius per cell are all that reaches the driver.

    For a query and a cell with pivot distance d, radius r and n rows, all rows of
    the cell lie within d + r and none nearer than d - r.  The smallest u such that
    cells with d + r <= u hold k rows bounds the k-th distance, and only cells with
    d - r <= u are searched.  Zero vectors under ``cosine`` (distance 1 to all) form
    a cell of their own that every query searches, and zero queries search all.
    """
    from shelfspark.session import scratch_path

    spark = q.sparkSession
    picked = c.select("id", F.col("vec").cast("array<double>").alias("vec")).orderBy(F.xxhash64("id"), "id").limit(min(cells, MAX_CELLS))
    _, pivots = _collect_matrix(picked, "id")
    pivots = np.unique(_unit(pivots, space), axis=0)
    slack = 1e-6 * (1.0 + float(np.abs(pivots).max(initial=0.0)))
    bc = spark.sparkContext.broadcast(pivots)

    @F.pandas_udf("struct<cell:int,dist:double>")
    def place(vs: pd.Series) -> pd.DataFrame:
        raw = _as_matrix(vs)
        m = _unit(raw, space)
        d = _distances(m, bc.value)
        cell = d.argmin(axis=1)
        zero = (raw == 0).all(axis=1) if space == "cosine" else np.zeros(len(m), bool)
        return pd.DataFrame({"cell": np.where(zero, -1, cell).astype(np.int32), "dist": np.where(zero, 0.0, d[np.arange(len(m)), cell])})

    path = scratch_path(spark, "knn-cells")
    c = _least_copies(c, k)
    (c.withColumn("p", place("vec")).select("id", "vec", F.col("p.cell").alias("cell"), F.col("p.dist").alias("dist")).write.parquet(path))
    index = spark.read.parquet(path)
    # One row per cell.
    stats = {r.cell: (r.n, r.r) for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect()}
    used = np.array(sorted(x for x in stats if x >= 0), np.int64)
    count, radius = np.array([stats[x][0] for x in used], np.int64), np.array([stats[x][1] for x in used], np.float64)
    everywhere = [-1] if -1 in stats else []

    def of_slice(raw: np.ndarray) -> np.ndarray:
        """How far a cell may be that holds one of the k nearest."""
        far = _distances(_unit(raw, space), bc.value[used]) + radius
        order = np.argsort(far, axis=1)
        enough = np.cumsum(count[order], axis=1) >= k
        at = np.where(enough.any(axis=1), enough.argmax(axis=1), max(len(used) - 1, 0))
        bound = np.take_along_axis(far, np.take_along_axis(order, at[:, None], 1), 1)[:, 0] + slack if len(used) else np.empty(len(raw))
        bound[~enough.any(axis=1) if len(used) else slice(None)] = np.inf
        if space == "cosine":
            bound[(raw == 0).all(axis=1)] = np.inf
        return bound

    index = index.select("id", "vec", "cell")
    return _search_parts(q, index, k, space, schema, stats, pivots, {x: stats[x][1] for x in used.tolist()}, of_slice, True, block_rows)


def _least_copies(c: DataFrame, k: int) -> DataFrame:
    """Of every vector the k rows with the smallest ids: copies are at one distance
    from any query, so no other can be among its k nearest.  Null and empty vectors
    go, by a condition that Spark can't move below the window: there it would compute
    the vectors a second time, in Python workers of its own."""
    w = Window.partitionBy("vec").orderBy("id")
    return (c.withColumn("__nth", F.row_number().over(w))
             .where((F.col("__nth") <= k) & (F.col("__nth") <= F.when(F.size("vec") > 0, k).otherwise(0))).drop("__nth"))


def _grid(n_q: int, n_c: int, queries: int, rows: int, tasks: int) -> tuple[int, int]:
    """Blocks of queries and parts of the corpus: of bounded size, enough for all
    tasks, and cut where it repeats fewer rows (n_q * parts + n_c * blocks are sent)."""
    a, b = max(math.ceil(n_q / queries), 1), max(math.ceil(n_c / rows), 1)
    while a * b < tasks and max(n_q / a, n_c / b) > SLICE:
        if n_c / b <= SLICE or (n_q / a > SLICE and n_c * a <= n_q * b):
            a *= 2
        else:
            b *= 2
    return a, b


def _tasks(spark) -> int:
    return 2 * spark.sparkContext.defaultParallelism


def _near_order(points: np.ndarray) -> list[int]:
    """The points so that neighbours stand together: halved along the widest axis."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= 2:
            out += rows.tolist()
            continue
        axis = np.ptp(points[rows], axis=0).argmax()
        rows = rows[np.argsort(points[rows, axis], kind="stable")]
        todo += [rows[len(rows) // 2:], rows[:len(rows) // 2]]
    return out


def _search_parts(q: DataFrame, index: DataFrame, k: int, space: str, schema, stats: dict, pivots: np.ndarray, radius: dict,
                  reach, bounds: bool, block_rows: int | None, decoded=None) -> DataFrame:
    """Top k of each query (qid, vec) over the index rows (id, vec, cell) of its cells.

    Neighbouring cells are put together to parts of at most about PART_ROWS rows (a
    larger cell is cut), and queries of a part to blocks, so a query is sent once to
    every part it needs and a row once to every block, however many cells there are.
    ``reach`` gives for a matrix of queries how far from a query's vector a cell may
    begin (pivot distance minus ``radius``); cells without a pivot (-1) are searched by
    all.  With ``bounds``, a cell is skipped also once the k-th best is nearer.
    ``decoded`` makes vectors of the ``vec`` and cells of a part's rows, if they travel
    as codes: the distance is then the squared Euclidean one of unit queries to them.
    The lists of the parts are merged by a window.
    """
    spark = q.sparkSession
    cells = np.array(sorted(x for x in stats if x >= 0), np.int64)
    slack = 1e-7 * (1.0 + float(np.abs(pivots).max(initial=0.0)))
    q = _kept(q, "knn-queries")
    n_q, n_c = q.count(), sum(n for n, _ in stats.values())
    queries = max(min(BLOCK_QUERIES, LIST_ROWS // k), SLICE)
    blocks, parts = _grid(n_q, n_c, block_rows or queries, block_rows or PART_ROWS, _tasks(spark))
    size = max(math.ceil(n_c / parts), 1)
    first, cuts, part, held = {}, {}, 0, 0
    for x in [*(x for x in stats if x < 0), *(cells[i] for i in _near_order(pivots[cells]))]:
        n = stats[x][0]
        if held and held + n > 1.25 * size:
            part, held = part + 1, 0
        first[x], cuts[x] = part, max(math.ceil(n / (1.25 * size)), 1)
        part, held = part + cuts[x] - 1, held + n
        if held >= size:
            part, held = part + 1, 0
    bc = spark.sparkContext.broadcast((pivots, np.array([radius[x] for x in cells.tolist()], np.float64), cells))
    starts, ends = (np.array([v[x] for x in cells.tolist()], np.int64) for v in (first, cuts))
    everywhere = [first[x] + i for x in stats if x < 0 for i in range(cuts[x])]
    n_parts = max((first[x] + cuts[x] for x in stats), default=0)

    def low(raw: np.ndarray, some: np.ndarray) -> np.ndarray:
        p, r, _ = bc.value
        return np.maximum(_distances(_unit(raw, space), p[cells[some]]) - r[some] - slack, 0.0)

    @F.pandas_udf("struct<reach:double,parts:array<int>>")
    def needed(vs: pd.Series) -> pd.DataFrame:
        # A few matrices of queries x cells are alive at once: a slice of queries at a time.
        far, out = [], []
        for i in range(0, len(vs), QUERY_SLICE):
            raw = _as_matrix(vs.iloc[i:i + QUERY_SLICE])
            far.append(reach(raw))
            go = low(raw, np.arange(len(cells))) <= far[-1][:, None]
            hit = np.zeros((len(raw), n_parts + 1), np.int64)
            for x in range(len(cells)):
                hit[:, starts[x]] += go[:, x]
                hit[:, starts[x] + ends[x]] -= go[:, x]
            hit = np.cumsum(hit, axis=1)[:, :n_parts] > 0
            hit[:, everywhere] = True
            out += [np.flatnonzero(x).astype(np.int32) for x in hit]
        return pd.DataFrame({"reach": np.concatenate(far), "parts": out})

    # Read twice (queries per part, search): the bounds are found once.
    kept = _kept(q.withColumn("n", needed("vec")).select("qid", "vec", "n.reach", "n.parts"), "knn-needed")
    per_part = F.broadcast(kept.select(F.explode("parts").alias("part")).groupBy("part").agg(
        F.greatest(F.lit(1), F.least(F.ceil(F.count(F.lit(1)) * blocks / max(n_q, 1)), F.ceil(F.count(F.lit(1)) / SLICE))).cast("int").alias("n_b")))
    at = F.broadcast(spark.createDataFrame([(int(x), int(first[x]), int(cuts[x])) for x in stats], "cell int, first int, cuts int"))
    qs = (kept.withColumn("part", F.explode("parts")).join(per_part, "part")
          .withColumn("qb", F.pmod(F.xxhash64("qid"), "n_b")).select("part", "qb", "qid", "vec", "reach"))
    cs = (index.join(at, "cell").withColumn("part", F.col("first") + F.pmod(F.xxhash64("id"), "cuts").cast("int")).join(per_part, "part")
          .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_b").cast("long") - 1))).select("part", "qb", "cell", "id", "vec"))

    def pair(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or cpdf.empty:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema.fields})
        cell = cpdf["cell"].to_numpy()
        block = _Part(cpdf["id"].tolist(), decoded(cpdf["vec"], cell) if decoded else _as_matrix(cpdf["vec"]), "l2" if decoded else space, cell)
        qm = _as_matrix(qpdf["vec"], block.e.shape[1])
        qm = _unit(qm, space) if decoded else qm
        some, far = np.searchsorted(cells, block.cells[block.cells >= 0]), qpdf["reach"].to_numpy()
        # Queries with the same nearest cell go through the cells together.
        near = np.concatenate([low(qm[i:i + SLICE], some).argmin(axis=1) if len(some) else np.zeros(len(qm[i:i + SLICE]), int)
                               for i in range(0, len(qm), SLICE)])
        order, out = np.argsort(near, kind="stable"), []
        for i in range(0, len(qm), SLICE):
            o = order[i:i + SLICE]
            d = np.c_[np.zeros((len(o), len(block.cells) - len(some))), low(qm[o], some)]
            go = d <= far[o][:, None]
            out.append(block.top(qpdf["qid"].to_numpy()[o], qm[o], k, go, d if bounds else None))
        return pd.concat(out)

    cand = qs.groupBy("part", "qb").cogroup(cs.groupBy("part", "qb")).applyInPandas(pair, schema)
    w = Window.partitionBy("qid").orderBy(F.round("distance", TIE_DIGITS), "id")
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select("qid", F.col("rank").cast("int").alias("rank"), "id", "distance"))


def routed_knn(queries: DataFrame, collections: dict, k: int, *, qid: str = "qid",
               text_vec: str = "text_vec", image_vec: str = "image_vec",
               wanted: tuple[str, ...] = ("multimodal", "text", "image"), **kw) -> DataFrame:
    """Both vectors -> 'multimodal' on their concatenation; text only -> 'text';
    image only -> 'image'.  Output adds a ``route`` column.  Every ``wanted``
    route needs its collection.  Rows with neither vector are returned by
    ``unroutable``."""
    has_t = F.col(text_vec).isNotNull() & (F.size(text_vec) > 0)
    has_i = F.col(image_vec).isNotNull() & (F.size(image_vec) > 0)
    routes = [
        ("multimodal", has_t & has_i, V.concat_vectors(text_vec, image_vec)),
        ("text", has_t & ~has_i, F.col(text_vec)),
        ("image", ~has_t & has_i, F.col(image_vec)),
    ]
    out = None
    for name, cond, vec in (r for r in routes if r[0] in wanted):
        coll = collections.get(name)
        if coll is None:
            raise ValueError(f"no {name} collection given (pass the routes that are wanted)")
        coll_space = coll.get("space", "l2") if isinstance(coll, dict) else "l2"
        coll_df = coll["df"] if isinstance(coll, dict) else coll
        sub = queries.where(cond).select(F.col(qid).alias("qid"), vec.alias("vec"))
        hits = knn_join(sub, coll_df, k, coll_space, **kw).withColumn("route", F.lit(name))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        raise ValueError("no collections given")
    return out


def unroutable(queries: DataFrame, text_vec: str = "text_vec", image_vec: str = "image_vec") -> DataFrame:
    """J2 error side: query rows that carry neither a text nor an image vector."""
    has_t = F.col(text_vec).isNotNull() & (F.size(text_vec) > 0)
    has_i = F.col(image_vec).isNotNull() & (F.size(image_vec) > 0)
    return queries.where(~has_t & ~has_i).withColumn("error", F.lit("query or image must be passed"))


def possible_matches(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose keys may be among those of ``wanted`` (all that are, and
    a few others): what a join need not move stays out.

    One bit per hash value, MATCH_BITS for each row of ``wanted`` and MATCH_MOST in all
    (32 MB, in the driver and once per worker); with so many rows that half the bits
    would be set, all stay."""
    n, spark = wanted.count(), df.sparkSession
    if 2 * n > MATCH_MOST:
        return df
    bits = min(1 << max(math.ceil(math.log2(max(n, 1) * MATCH_BITS)), 15), MATCH_MOST)
    at, size = F.pmod(F.xxhash64(*keys), F.lit(bits)), 1 << 15
    flat = np.zeros(bits // 8, np.uint8)
    for r in wanted.groupBy(F.floor(at / size).alias("b")).agg(F.bitmap_construct_agg(at % size).alias("m")).toLocalIterator():
        flat[r.b * size // 8:(r.b + 1) * size // 8] = np.frombuffer(r.m, np.uint8)
    bc = spark.sparkContext.broadcast(flat)

    @F.pandas_udf("boolean")
    def there(h: pd.Series) -> pd.Series:
        place = h.to_numpy()
        return pd.Series((bc.value[place >> 3] >> (place & 7)) & 1 == 1)

    return df.where(there(at))


def with_documents(hits: DataFrame, collection: DataFrame, id_col: str = "id") -> DataFrame:
    """Attach stored document/metadata to hits (left join on id).

    Catalyst picks the join; hits are k rows per query, the collection is
    joined on its key, so a broadcast happens only when statistics allow it.
    """
    return hits.join(collection, hits["id"] == collection[id_col], "left").drop(collection[id_col]) \
        if id_col != "id" else hits.join(collection, "id", "left")


def salted_join(big: DataFrame, small: DataFrame, key: str, by: list[str], how: str = "inner", salts: int = 64) -> DataFrame:
    """Join on a key that few values of ``big`` dominate.  Rows of ``big`` are
    spread over ``salts`` tasks per key by a hash of ``by``; rows of ``small`` are
    repeated only for the (key, salt) pairs that occur."""
    b = big.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    there = b.select(key, "__salt").distinct().join(small, key)
    return b.join(there, [key, "__salt"], how).drop("__salt")


def knn_distinct_queries(questions: DataFrame, text_col: str, encode_fn, corpus: DataFrame, k: int,
                         space: str = "cosine", by: list[str] | None = None, **kw) -> DataFrame:
    """Search each distinct question text once and join the hits back.

    ``encode_fn(df, text_col) -> df`` adds a ``vec`` column.  The question text
    itself is the query key (no id assignment, no collisions); hits are joined
    back to every row that asked it, popular questions spread by a hash of the
    columns ``by`` (all columns otherwise).
    """
    from shelfspark.session import scratch_path

    # Read several times (size check, encode, search, join back): the narrow pair
    # table is written once instead of derived again.
    spark = questions.sparkSession
    path = scratch_path(spark, "questions")
    questions.write.parquet(path)
    questions = spark.read.schema(questions.schema).parquet(path)
    distinct_q = questions.select(text_col).distinct()
    vecs = encode_fn(distinct_q, text_col)
    hits = knn_join(vecs.select(F.col(text_col).alias("__q"), "vec"), corpus, k, space, qid="__q", **kw)
    return salted_join(questions, hits.withColumnRenamed("qid", text_col), text_col, by or questions.columns)


# ---------------------------------------------------------------------------
# IVF approximate search

#: Rows per cell that k-means is trained on.
TRAIN_PER_CELL = 64


def ivf_build(corpus: DataFrame, cells: int | None = None, *, cid: str = "id", cvec: str = "vec", space: str = "l2",
              seed: int = 1, max_iter: int = 20) -> dict:
    """Cluster the corpus into ``cells`` (about the square root of its rows, at most
    MAX_CELLS, if not given) with Spark ML k-means.

    Returns ``{'df': (id, vec, cell), 'centroids': ndarray, 'space': space}``;
    the centroids (cells x dim) are the only data brought to the driver.
    Under ``cosine`` the clustering runs on unit vectors.
    """
    if cells is None:
        cells = int(min(max(2, math.ceil(math.sqrt(corpus.count()))), MAX_CELLS))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    base = corpus.select(F.col(cid).alias("id"), F.col(cvec).alias("vec")) \
                 .where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    feat = V.l2_normalize("vec") if space == "cosine" else F.transform("vec", lambda x: x.cast("double"))
    # k-means iterates over its input: materialise it once in the shared
    # checkpoint folder so encoders upstream are not re-run every iteration.
    from shelfspark.session import checkpoint_root

    checkpoint_root(corpus.sparkSession)
    train = base.checkpoint(eager=True).withColumn("__features", array_to_vector(feat))
    # Centroids come from a bounded sample by hash; every row is put in a cell, once.
    n, most = train.count(), TRAIN_PER_CELL * cells
    sample = train if n <= most else train.where(F.pmod(F.xxhash64("id"), F.lit(n)) < most)
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, featuresCol="__features",
                   predictionCol="cell").fit(sample)
    index = _kept(model.transform(train).select("id", "vec", F.col("cell").cast("int").alias("cell")), "ivf-cells")
    return {"df": index, "centroids": np.asarray(model.clusterCenters(), dtype=np.float64), "space": space}


def ivf_join(queries: DataFrame, index: dict, k: int, probe: int = 1, *, qid: str = "qid", qvec: str = "vec",
             block_rows: int | None = None) -> DataFrame:
    """Approximate k-NN: each query searches its ``probe`` nearest cells exactly, and
    further ones until they hold ``k`` rows (``probe_for`` finds how many a recall
    takes).

    Queries are routed to cells by one matrix product per batch with the broadcast
    centroids.
    """
    q = queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("vec")) \
               .where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    schema = _result_schema(q.schema["qid"].dataType, index["df"].schema["id"].dataType)
    return _search_parts(q, index["df"], k, index["space"], schema, *_probed(index, k, probe), False, block_rows)


def _probed(index: dict, k: int, probe: int) -> tuple:
    """What ``_search_parts`` takes of an index: cells, centroids, radii (none) and the
    distance of the last cell that a query searches."""
    cents, space, sizes = index["centroids"], index["space"], _cell_sizes(index)
    probe = max(1, min(probe, cents.shape[0]))

    def reach(raw: np.ndarray) -> np.ndarray:
        d = _distances(_unit(raw, space), cents)
        order = np.argsort(d, axis=1, kind="stable")
        n = np.maximum((np.cumsum(sizes[order], axis=1) < k).sum(axis=1) + 1, probe)
        return np.take_along_axis(d, np.take_along_axis(order, np.minimum(n, cents.shape[0])[:, None] - 1, 1), 1)[:, 0]

    stats = {x: (int(n), 0.0) for x, n in enumerate(sizes) if n}
    return stats, cents, dict.fromkeys(stats, 0.0), reach


def _cell_sizes(index: dict) -> np.ndarray:
    if index.get("sizes") is None:
        # One row per cell.
        sizes = np.zeros(index["centroids"].shape[0], np.int64)
        for r in index["df"].groupBy("cell").count().collect():
            sizes[r["cell"]] = r["count"]
        index["sizes"] = sizes
    return index["sizes"]


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (qid, id) pairs that were found."""
    from shelfspark.session import shuffles_freed

    pairs = exact.select("qid", "id").distinct()
    with shuffles_freed(exact.sparkSession):
        r = (pairs.withColumn("want", F.lit(1)).join(found.select("qid", "id").distinct().withColumn("got", F.lit(1)), ["qid", "id"], "left")
             .agg(F.count("want").alias("w"), F.count("got").alias("g")).first())
    return r.g / r.w if r.w else 1.0


def sample_queries(queries: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` queries with the smallest hash of their key."""
    return queries.orderBy(F.xxhash64(key), key).limit(n)


def probe_for(queries: DataFrame, index: dict, k: int, target: float = 0.9, *, qid: str = "qid", qvec: str = "vec",
              n_sample: int = 256, search=None) -> int:
    """The number of cells to probe for a recall of ``target``, measured.

    For a bounded sample of the queries (``n_sample``, by hash) the exact neighbours
    are found; where their cells stand in each query's order of cells tells how many
    probes reach the target.  ``search(sample, probe)`` (the search that is to use
    them, ``ivf_join`` otherwise) then confirms it, with more probes while it falls
    short.  All cells are the upper end.
    """
    sample = queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("vec")).where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    sample = _kept(sample_queries(sample, n_sample, "qid"), "probe-sample")
    exact = _kept(knn_join(sample, index["df"], k, index["space"]), "probe-exact")
    cents, space = index["centroids"], index["space"]
    at = {r.qid: [] for r in exact.select("qid").distinct().collect()}
    for r in exact.select("qid", "id").join(index["df"].select("id", "cell"), "id").collect():
        at[r.qid].append(r.cell)
    ranks: list[int] = []
    for r in sample.collect():
        order = np.argsort(_distances(_unit(np.asarray([r.vec], np.float64), space), cents)[0], kind="stable")
        place = np.empty(order.size, np.int64)
        place[order] = np.arange(order.size)
        ranks += [int(place[c]) + 1 for c in at.get(r.qid, [])]
    search = search or (lambda s, p: ivf_join(s, index, k, p))
    probe = sorted(ranks)[min(math.ceil(target * len(ranks)), len(ranks)) - 1] if ranks else 1
    while probe < cents.shape[0] and recall(search(sample, probe), exact) < target:
        probe = min(2 * probe, cents.shape[0])
    return probe


def _kept(df: DataFrame, name: str) -> DataFrame:
    from shelfspark.session import scratch_path, shuffles_freed

    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------------------
# J1 by principal axes

#: Rows the axes are taken from; any axes give the same rows.
AXES_SAMPLE = 20_000
#: Rows of the corpus one task holds.
AXES_PART = 32_768


def principal_axes(corpus: DataFrame, vec: str, space: str, n_sample: int = AXES_SAMPLE) -> np.ndarray:
    """Orthonormal axes by falling variance, from a bounded sample by hash."""
    picked = corpus.select(F.col(vec).cast("array<double>").alias("vec")).orderBy(F.xxhash64("vec")).limit(n_sample)
    m = _unit(_as_matrix(pd.Series(picked.toArrow().column("vec").to_numpy())), space)
    return np.linalg.eigh(np.cov(m, rowvar=False).reshape(m.shape[1], m.shape[1]))[1][:, ::-1].T if len(m) > 1 else np.eye(m.shape[1])


def _head(axes: np.ndarray, sample: np.ndarray, energy: float) -> int:
    """Axes that hold ``energy`` of the sample's spread."""
    var = np.var(sample @ axes.T, axis=0)
    share = np.cumsum(var) / max(var.sum(), 1e-300)
    return int(min(np.searchsorted(share, energy) + 1, axes.shape[0]))


def knn_axes(queries: DataFrame, corpus: DataFrame, k: int, space: str = "l2", *, qid: str = "qid", qvec: str = "vec",
             cid: str = "id", cvec: str = "vec", block_rows: int = BLOCK_QUERIES, energy: float = 0.95) -> DataFrame:
    """J1 where neither side fits and cells do not prune: qid, rank, id, distance and
    ``full``, the full distances that the query took (a tenth of the corpus is 0.1 n).

    Vectors are turned to principal axes, which keeps distances.  Over the first axes
    (those that hold ``energy`` of the spread) the distance is computed; for the rest
    only the lengths are kept, and (|q| - |c|)**2 over them bounds their part from
    below.  A task holds a block of queries and a part of the corpus: the k rows with
    the smallest bounds give a first k-th distance, and of all others only those whose
    bound does not exceed it get a full distance.  Every task's k rows per query are
    merged by a window.  Exact for any data, ties by id; under ``cosine`` the bounds
    are those of unit vectors; a zero vector is at distance 1 from all.
    """
    q, c = _normalise_inputs(queries, corpus, qid, qvec, cid, cvec)
    spark = q.sparkSession
    q, c = _kept(q, "axes-queries"), _kept(c, "axes-corpus")
    n_q, n_c = q.count(), c.count()
    schema = _result_schema(q.schema["qid"].dataType, c.schema["id"].dataType)
    with_full = T.StructType([*schema.fields, T.StructField("full", T.LongType(), False)])
    if not n_q or not n_c:
        return spark.createDataFrame([], with_full)
    axes = principal_axes(c, "vec", space)
    sample = _unit(_as_matrix(pd.Series(c.select(F.col("vec").cast("array<double>")).limit(1000).toArrow().column(0).to_numpy())), space)
    head = _head(axes, sample, energy)
    bc = spark.sparkContext.broadcast(axes)
    q_blocks, parts = _grid(n_q, n_c, block_rows, AXES_PART, _tasks(spark))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    qs = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(q_blocks))).withColumn("cb", every(parts))
    cs = c.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("qb", every(q_blocks))

    def pair(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or cpdf.empty:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in with_full.fields})
        block = _Corpus(cpdf["id"].tolist(), _as_matrix(cpdf["vec"]))
        return _pruned_top(qpdf["qid"].to_numpy(), _as_matrix(qpdf["vec"], block.e.shape[1]), block, k, space, bc.value, head)

    found = _kept(qs.groupBy("qb", "cb").cogroup(cs.groupBy("qb", "cb")).applyInPandas(pair, with_full), "axes-found")
    # ``full`` stands on the first row of every list.
    full = found.groupBy("qid").agg(F.sum("full").alias("full"))
    w = Window.partitionBy("qid").orderBy(F.round("distance", TIE_DIGITS), "id")
    return (found.drop("full").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .join(full, "qid").select("qid", F.col("rank").cast("int").alias("rank"), "id", "distance", "full"))


def _pruned_top(qids, q: np.ndarray, block: _Corpus, k: int, space: str, axes: np.ndarray, head: int) -> pd.DataFrame:
    def turned(m):
        t = _unit(m, space) @ axes.T
        return t[:, :head], np.sqrt(np.einsum("ij,ij->i", t[:, head:], t[:, head:]))

    (qh, qt), (ch, ct) = turned(q), turned(block.e)
    kk, n = min(k, len(block.ids)), len(block.ids)
    c_sq = np.einsum("ij,ij->i", ch, ch)
    #: cosine distance is half the squared distance of unit vectors.
    half = 0.5 if space == "cosine" else 1.0
    zero = block.e_norm == 0
    cols = [], [], [], [], []
    for a in range(0, len(q), QUERY_SLICE):
        b = slice(a, min(a + QUERY_SLICE, len(q)))
        low = np.maximum(np.einsum("ij,ij->i", qh[b], qh[b])[:, None] - 2.0 * (qh[b] @ ch.T) + c_sq[None, :], 0.0)
        low = half * (low + (qt[b][:, None] - ct[None, :]) ** 2)
        for i, bounds in zip(range(b.start, b.stop), low):
            if space == "cosine" and (zero.any() or not q[i].any()):
                # A zero vector is at distance 1 from everything.
                bounds = np.where(zero, 1.0, bounds) if q[i].any() else np.ones(n)
            first = np.argpartition(bounds, kk - 1)[:kk]
            kth = _exact_row(q[i], first, block.e, block.e_norm, space).max()
            slack = 1e-9 * (1.0 + abs(kth) + float(bounds[first].max()))
            cand = np.flatnonzero(bounds <= kth + slack)
            d = _exact_row(q[i], cand, block.e, block.e_norm, space)
            order = np.lexsort((block.id_rank[cand], np.round(d, TIE_DIGITS) + 0.0))[:kk]
            cols[0].append(np.repeat(qids[i:i + 1], kk))
            cols[1].append(np.arange(1, kk + 1, dtype=np.int32))
            cols[2].append(block.ids[cand[order]])
            cols[3].append(d[order])
            cols[4].append(np.r_[cand.size, np.zeros(kk - 1, np.int64)])
    return pd.DataFrame(dict(zip(("qid", "rank", "id", "distance", "full"), map(np.concatenate, cols))))


# ---------------------------------------------------------------------------
# Product-quantised inverted lists

#: Vectors that codebooks are trained on; codes per sub-space.
PQ_SAMPLE, PQ_CODES = 20_000, 256
#: Queries per core whose lists are on disk at a time.
PQ_QUERIES = 4096


def _kmeans(x: np.ndarray, n: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's centres of the rows of ``x`` (empty ones move to the farthest row)."""
    rng = np.random.default_rng(seed)
    n = min(n, len(x))
    centres = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        d = _distances(x, centres)
        near = d.argmin(axis=1)
        count = np.bincount(near, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        far = np.argsort(-d[np.arange(len(x)), near], kind="stable")
        for empty, row in zip(np.flatnonzero(count == 0).tolist(), far.tolist()):
            centres[empty] = x[row]
    return centres


def _split(dim: int, subspaces: int) -> list[tuple[int, int]]:
    edge = [round(i * dim / subspaces) for i in range(subspaces + 1)]
    return list(zip(edge[:-1], edge[1:]))


def _codes(residuals: np.ndarray, books: list[np.ndarray], parts) -> np.ndarray:
    return np.stack([_distances(residuals[:, a:b], book).argmin(axis=1) for book, (a, b) in zip(books, parts)], axis=1).astype(np.uint8)


def pq_build(corpus: DataFrame, cells: int | None = None, subspaces: int = 16, *, cid: str = "id", cvec: str = "vec",
             space: str = "l2", seed: int = 1) -> dict:
    """Inverted lists of product-quantised residuals.

    The corpus is clustered as in ``ivf_build``; what a row differs from its cell's
    centroid by is cut into ``subspaces`` pieces, and each piece is replaced by the
    nearest of up to PQ_CODES centres of its sub-space.  Codebooks are trained by one
    task per sub-space on the PQ_SAMPLE rows with the smallest hash; every row is
    encoded.  The index has (id, cell, code: one byte per sub-space) and the vectors
    beside it; the driver holds centroids and codebooks.
    """
    index = ivf_build(corpus, cells, cid=cid, cvec=cvec, space=space, seed=seed)
    spark, cents = corpus.sparkSession, index["centroids"]
    dim = cents.shape[1]
    subspaces = min(subspaces, dim)
    parts = _split(dim, subspaces)
    bc = spark.sparkContext.broadcast(cents)

    def residual(vec, cell) -> np.ndarray:
        return _unit(_as_matrix(vec), space) - bc.value[np.asarray(cell)]

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        sub = int(pdf["sub"].iloc[0])
        a, b = parts[sub]
        pdf = pdf.sort_values("place")
        book = _kmeans(residual(pdf["vec"], pdf["cell"])[:, a:b], PQ_CODES, seed + sub)
        return pd.DataFrame({"sub": sub, "code": np.arange(len(book)), "centre": list(book)})

    sample = index["df"].select(F.xxhash64("id").alias("place"), "vec", "cell").orderBy("place").limit(PQ_SAMPLE)
    rows = (sample.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(subspaces - 1)))).groupBy("sub")
            .applyInPandas(train, "sub int, code int, centre array<double>").orderBy("sub", "code").collect())
    books = [np.array([r.centre for r in rows if r["sub"] == s], np.float64) for s in range(subspaces)]
    bb = spark.sparkContext.broadcast(books)

    @F.pandas_udf("binary")
    def encode(vec: pd.Series, cell: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in _codes(residual(vec, cell), bb.value, parts)])

    index["codes"] = _kept(index["df"].select("id", "cell", encode("vec", "cell").alias("code")), "pq-codes")
    index["books"], index["parts"] = books, parts
    return index


def pq_join(queries: DataFrame, index: dict, k: int, probe: int, *, rerank: int = 10, qid: str = "qid", qvec: str = "vec",
            block_rows: int | None = None) -> DataFrame:
    """Approximate k-NN over ``pq_build``'s lists.

    A row's quantised distance is that from the query to what its code stands for (the
    cell's centroid plus a centre per sub-space); the ``rerank * k`` rows that look
    nearest over all probed cells are then fetched, given their exact distance, and
    ranked by it.  Parts of the corpus travel as codes, and a query once to each part
    (``_search_parts``).  Queries go in slices of PQ_QUERIES a core, each stored before
    the next: shuffle files hold the lists and fetched vectors of one slice.
    """
    from shelfspark.session import scratch_path, shuffles_freed

    spark, space = queries.sparkSession, index["space"]
    q = _kept(queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("vec"))
              .where(F.col("vec").isNotNull() & (F.size("vec") > 0)), "pq-queries")
    codes, n_near = index["codes"], rerank * k
    schema = _result_schema(q.schema["qid"].dataType, codes.schema["id"].dataType)
    cents, books, parts = index["centroids"], index["books"], index["parts"]
    bb = spark.sparkContext.broadcast(books)

    def decoded(code: pd.Series, cell: np.ndarray) -> np.ndarray:
        code = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), len(parts))
        return cents[cell] + np.concatenate([book[code[:, s]] for s, book in enumerate(bb.value)], axis=1)

    slices = max(math.ceil(q.count() / (PQ_QUERIES * spark.sparkContext.defaultParallelism)), 1)
    rows, path = index["df"].select("id", F.col("vec").alias("cvec")), scratch_path(spark, "pq-found")
    distance = V.l2_distance("vec", "cvec") if space == "l2" else V.cosine_distance("vec", "cvec")
    w = Window.partitionBy("qid").orderBy(F.round("distance", TIE_DIGITS), "id")
    for i in range(slices):
        some = q.where(F.pmod(F.xxhash64("qid"), F.lit(slices)) == i)
        near = _search_parts(some, codes.withColumnRenamed("code", "vec"), n_near, space, schema, *_probed(index, n_near, probe), False,
                             block_rows, decoded).select("qid", "id")
        both = near.join(rows, "id").join(some, "qid")
        best = (both.select("qid", "id", distance.alias("distance")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select("qid", F.col("rank").cast("int").alias("rank"), "id", "distance"))
        with shuffles_freed(spark):
            best.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
