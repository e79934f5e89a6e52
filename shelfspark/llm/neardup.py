"""Near-duplicate detection with SetSketch registers.

A document's set holds the 64-bit hashes of its distinct five-word shingles
(A-Z lower-cased).  Documents with the same set are one class.  Every set gets a
SetSketch: M registers, each the minimum of exponential variables of its elements
on a geometric scale (base BASE), truncated to 16 bits.  Registers are cut into
bands; classes that agree in a band meet in a bucket.

No list of all pairs is made.  Each class is first compared with its bucket's
class of the smallest document, by a joint maximum likelihood estimate of the
Jaccard index from the registers and the exact set sizes; what fails is compared
with its whole bucket, tile by tile inside tasks.  What passes joins clusters;
within each, tile by tile again, links are confirmed on the full sets, and a tile
returns enough links to connect what is linked.  The components are therefore
those of all links between classes that share a bucket; at the threshold of a Rule
(LINK: 0.85, WIDE: 0.80) a pair misses all buckets with probability under 1e-6, and
an estimate falls under its cut with about 1e-9.

Defined results: null and wordless texts have an empty set and are linked with
nothing; fewer words than a shingle are one shingle; rows with equal sets are
linked; repeated rows are all kept if their doc_id is the component's smallest;
null ids count as largest.  Extra columns are not read.  Empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import (Words, binary_values, join_counted, mix64, pack_sorted, shuffle_partitions,
                                   stored, text_of, unpack_sorted, whole_row, window_hash)
from shelfspark.llm.components import components
from shelfspark.llm.decontaminate import _slices

SHINGLE = 5
M = 180
BASE, RATE = 1.02, 20.0


@dataclass(frozen=True)
class Rule:
    """Links: 100 * intersection >= link * union.  The M registers are cut into
    bands of ``rows``."""

    link: int
    rows: int

    @property
    def bands(self) -> int:
        return M // self.rows

    @property
    def cut(self) -> float:
        """Estimates under this are six standard errors below the threshold."""
        j = self.link / 100
        return j - 6 * (j * (1 - j) / M) ** 0.5


LINK, WIDE = Rule(85, 6), Rule(80, 5)
#: Most classes compared with each other in one task.
TILE = 2048
#: Bits of the filter for texts that are looked at again (2 MB).
FILTER_BITS = 1 << 24
#: Groups of the classes that one class is compared with.
SALT = 64


# ---------------------------------------------------------------------------
# Sets and sketches (inside tasks)

def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of every text."""
    lex = Words()
    ids = [lex.add(t.lower().split()) for t in texts]
    h = lex.hashes()
    return [np.unique(window_hash(h[i], min(k, i.size))) if i.size else np.empty(0, np.uint64) for i in ids]


def class_id(s: np.ndarray) -> int:
    """64 bits that stand for a whole set (0: the empty set)."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if s.size else 0


def sketches(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row each.

    An element is a Poisson process of rate m whose arrivals go to random
    registers, so a register's first arrival over a set of n elements is
    exponential with rate n.  Arrivals are generated only up to a time that all
    registers are expected to fill by; the few sets with an empty register are
    done again up to a later time.
    """
    first = np.full((len(sets), m), np.inf)
    todo, more = np.arange(len(sets)), 6.0
    while todo.size:
        size = np.array([sets[i].size for i in todo])
        until = (np.log(m) + more) / size
        h, d = np.concatenate([sets[i] for i in todo]), np.repeat(np.arange(todo.size), size)
        t, got, step = np.zeros(h.size), np.full(todo.size * m, np.inf), 1
        j = 0
        while h.size:
            r = mix64(h[:, None] + np.arange(j + 1, j + step + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
            at = t[:, None] + np.cumsum(-np.log(u) / m, axis=1)
            x, y = np.nonzero(at <= until[d][:, None])
            reg = (mix64(r[x, y]) % np.uint64(m)).astype(np.int64)
            np.minimum.at(got, d[x] * m + reg, at[x, y])
            live = at[:, -1] <= until[d]
            h, d, t = h[live], d[live], at[live, -1]
            j, step = j + step, min(step * 2 if j else 1, 64)
        first[todo] = got.reshape(-1, m)
        todo, more = todo[np.isinf(first[todo]).any(axis=1)], more * 2
    k = np.floor(1 - np.log(first / RATE) / np.log(BASE))
    return np.clip(k, 0, 65535).astype(np.uint16)


def band_hashes(regs: np.ndarray, rule: Rule = LINK) -> np.ndarray:
    """One 64-bit hash per band and row, bands told apart."""
    x = regs.reshape(len(regs), rule.bands, rule.rows).astype(np.uint64)
    h = np.broadcast_to(mix64(np.arange(1, rule.bands + 1, dtype=np.uint64)), (len(regs), rule.bands))
    for i in range(rule.rows):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, i])
    return h.view(np.int64) if h.flags.c_contiguous else np.ascontiguousarray(h).view(np.int64)


_GRID = np.linspace(0.0, 1.0, 201)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum likelihood Jaccard index of paired registers, given the
    exact sizes: counts of greater, smaller and equal registers on a grid."""
    m = a.shape[-1]
    up, down = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = _GRID[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    like = (up[:, None] * np.log(more + tiny) + down[:, None] * np.log(less + tiny)
            + (m - up - down)[:, None] * np.log(np.maximum(1 - more - less, tiny)))
    return j[np.arange(len(up)), like.argmax(axis=1)]


def _registers(col) -> np.ndarray:
    vals = binary_values(col)
    return np.frombuffer(b"".join(vals), np.uint16).reshape(len(vals), M)


# ---------------------------------------------------------------------------
# Stages

def _sketch(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = binary_values(b.column("text"))
        for i, part in _slices(texts, 2 << 20):
            sets = shingle_sets(part)
            n = np.array([s.size for s in sets])
            full = np.flatnonzero(n)
            regs = sketches([sets[k] for k in full]) if full.size else np.empty((0, M), np.uint16)
            bands = band_hashes(regs, rule) if full.size else np.empty((0, rule.bands), np.int64)
            each, packed = [None] * len(part), [None] * len(part)
            for row, k in enumerate(full):
                each[k], packed[k] = bands[row].tolist(), regs[row].tobytes()
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").slice(i, len(part)), b.column("text_hash").slice(i, len(part)), pa.array(n, pa.int64()),
                pa.array([class_id(s) for s in sets], pa.int64()), pa.array(each, pa.list_(pa.int64())),
                pa.array(packed, pa.binary())], names=["doc_id", "text_hash", "n", "cid", "bands", "regs"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, part in _slices(binary_values(b.column("text")), 2 << 20):
            sets = shingle_sets(part)
            yield pa.RecordBatch.from_arrays([pa.array([class_id(s) for s in sets], pa.int64()),
                                              pa.array([pack_sorted(s) for s in sets], pa.binary())], names=["cid", "shingles"])


def _estimated(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Bucket members with whether their estimate with the leader passes."""
    for b in batches:
        ok = np.zeros(b.num_rows, bool)
        if b.num_rows:
            na, nb = (np.array(b.column(c).to_pylist(), np.float64) for c in ("n_a", "n_b"))
            ok = estimate(_registers(b.column("regs_a")), _registers(b.column("regs_b")), na, nb) >= rule.cut
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(ok)], names=["u", "v", "ok"])


class _Forest:
    """Disjoint sets of positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def roots(self) -> np.ndarray:
        while (r := self.up[self.up]).tolist() != self.up.tolist():
            self.up = r
        return self.up

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Joins i with the others; returns those that were apart so far."""
        new = []
        for k in others.tolist():
            a, b = self.root(i), self.root(k)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                new.append(k)
        return np.array(new, np.int64)


def _tile(table: pa.Table):
    """The classes of a tile, or of two: (cid, rows of the first tile, others a row
    is compared with)."""
    cid, part = (np.array(table.column(c).to_pylist(), np.int64) for c in ("cid", "part"))
    own = part == part[0]
    return cid, np.flatnonzero(own), np.ones(cid.size, bool) if own.all() else ~own


def _edges(us: list, vs: list) -> pa.Table:
    u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _similar(table: pa.Table, rule: Rule) -> pa.Table:
    """Classes that failed against their bucket's leader, compared with the whole
    bucket by the estimate: enough pairs to connect what passes, none twice."""
    cid, rows, others = _tile(table)
    n, regs = np.array(table.column("n").to_pylist(), np.float64), _registers(table.column("regs"))
    failed = np.array(table.column("ok").to_pylist(), bool) ^ True
    forest, us, vs = _Forest(cid.size), [], []
    for i in rows:
        k = np.flatnonzero(others & (failed | failed[i]) & (forest.roots() != forest.root(int(i))))
        if k.size:
            k = k[estimate(np.broadcast_to(regs[i], (k.size, M)), regs[k], np.full(k.size, n[i]), n[k]) >= rule.cut]
            k = forest.join(int(i), k)
            us.append(np.full(k.size, cid[i]))
            vs.append(cid[k])
    return _edges(us, vs)


def _linked(table: pa.Table, rule: Rule) -> pa.Table:
    """Exact links within a cluster, tile by tile: for each class the intersection
    with all others is counted over the lists of its shingles.  Returns enough
    links to connect what is linked."""
    cid, rows, others = _tile(table)
    sets = [unpack_sorted(x) for x in table.column("shingles").to_pylist()]
    size = np.array([x.size for x in sets], np.int64)
    shingle, inv = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(inv, kind="stable")
    owner = np.repeat(np.arange(cid.size), size)[order]
    start = np.searchsorted(inv[order], np.arange(shingle.size + 1))
    begin = np.cumsum(size) - size
    regs = _registers(table.column("regs"))
    forest, us, vs = _Forest(cid.size), [], []
    for i in rows:
        k = np.flatnonzero(others & (forest.roots() != forest.root(int(i))))
        k = k[((regs[k] == regs[i]).sum(axis=1) >= rule.cut * M - 1) if k.size else []]
        if not k.size:
            continue
        mine = inv[begin[i]:begin[i] + size[i]]
        a, b = start[mine], start[mine + 1]
        lists = owner[np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]
        both = np.bincount(lists, minlength=cid.size)[k]
        k = forest.join(int(i), k[100 * both >= rule.link * (size[i] + size[k] - both)])
        us.append(np.full(k.size, cid[i]))
        vs.append(cid[k])
    return _edges(us, vs)


def _tiled(rows: DataFrame, key: str, func) -> DataFrame:
    """``func`` over every pair of tiles of each group (``size`` classes): a group
    of any size is cut into tiles of about TILE classes."""
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    cut = (rows.withColumn("part", F.pmod(F.xxhash64("cid"), tiles).cast("int"))
           .withColumn("x", F.explode(F.sequence(F.lit(0), tiles - 1)))
           .withColumn("i", F.least("part", "x")).withColumn("j", F.greatest("part", "x")).drop("x", "size"))
    return cut.groupBy(key, "i", "j").applyInArrow(func, "u long, v long").distinct()


def _texts_of(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Texts of the rows with one of these ids.

    A filter of FILTER_BITS bits (its size does not depend on the data) drops most
    other rows before the exact semi-join, so few texts move.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1  # noqa: E731  the functions count from 1
    maps = (ids.select(bit("doc_id").alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect())
    bits = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for r in maps:
        bits[(r.k - 1) * 4096:r.k * 4096] = np.frombuffer(bytes(r.m), np.uint8)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array(b.column("b").to_pylist(), np.int64) - 1
            # Position p of bucket k is bit p % 8 of byte p // 8.
            yield b.filter(pa.array((bits[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1)).select(["doc_id", "text"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    near = src.withColumn("b", bit("doc_id")).mapInArrow(keep, "doc_id long, text binary")
    return near.join(ids.select(F.col("doc_id").alias("need")).distinct(), F.col("doc_id").eqNullSafe(F.col("need")), "left_semi")


def find_links(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, rule: Rule) -> DataFrame | None:
    """(node, label) over classes with a link, or None without candidates.
    ``classes``: cid, n, doc_id (the smallest), bands, regs."""
    bands = classes.select("cid", "doc_id", F.explode("bands").alias("bh")).repartition(
        shuffle_partitions(docs.sparkSession), "bh")
    buckets = (bands.groupBy("bh").agg(F.min_by("cid", "doc_id").alias("leader"), F.min("cid").alias("any"),
                                       F.count(F.lit(1)).alias("size")).filter("size > 1")
               .select("bh", F.coalesce("leader", "any").alias("leader"), "size"))
    members = stored(bands.join(buckets, "bh").select("bh", "cid", "doc_id", "leader", "size"), "neardup-members")
    total = members.count()
    if not total:
        return None
    sketch = classes.select("cid", "n", "regs")

    # 1. Estimates with the leader of each bucket.
    pairs = members.filter("cid <> leader").select(F.col("leader").alias("u"), F.col("cid").alias("v")).distinct()
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)))
    left = salted.select("u", "salt").distinct().join(
        sketch.select(F.col("cid").alias("u"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a")), "u")
    right = salted.join(sketch.select(F.col("cid").alias("v"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b")), "v")
    judged = stored(right.join(left, ["u", "salt"]).select("u", "v", "n_a", "n_b", "regs_a", "regs_b")
                    .mapInArrow(lambda b: _estimated(b, rule), "u long, v long, ok boolean"), "neardup-judged")

    # 2. What failed against a leader, against its whole bucket.
    failing = judged.filter("not ok").select(F.col("u").alias("leader"), F.col("v").alias("cid"), F.lit(True).alias("failed"))
    wide = members.filter("size > 2").join(failing, ["leader", "cid"], "left").withColumn("ok", F.col("failed").isNull()).drop("failed")
    open_ = wide.groupBy("bh").agg(F.max(~F.col("ok")).alias("open"), F.count(F.lit(1)).alias("n")).filter("open").select("bh", "n")
    rows = stored(join_counted(wide.select("bh", "cid", "size", "ok"), open_, ["bh"], "n", total).drop("n"), "neardup-open")
    similar = judged.filter("ok").select("u", "v")
    if not rows.isEmpty():
        similar = similar.unionByName(_tiled(rows.join(sketch, "cid"), "bh", lambda t: _similar(t, rule)))

    # 3. Clusters of similar classes, and the exact links within each.
    clusters = components(similar).withColumnRenamed("node", "cid").withColumnRenamed("label", "cluster")
    sized = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    placed = stored(join_counted(clusters, sized, ["cluster"], "size", max(clusters.count(), 1)), "neardup-clusters")
    who = placed.select("cid").join(classes.select("cid", "doc_id"), "cid")
    sets = (_texts_of(docs, who, doc_id, text).select("text").mapInArrow(_full_sets, "cid long, shingles binary")
            .dropDuplicates(["cid"]))
    full = placed.join(sets, "cid").join(classes.select("cid", "regs"), "cid")
    return components(_tiled(full, "cluster", lambda t: _linked(t, rule)))


def _judged(docs: DataFrame, doc_id: str, text: str, rule: Rule) -> DataFrame:
    """doc_id, text_hash, n, cid, component_id of every row."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"),
                      F.col(text).cast("binary").alias("text"))
    sk = stored(src.mapInArrow(lambda b: _sketch(b, rule), "doc_id long, text_hash long, n long, cid long, bands array<long>, regs binary"),
                "neardup-sketches")
    classes = stored(sk.filter("n > 0").groupBy("cid").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("regs").alias("regs")), "neardup-classes")
    labels = find_links(docs, classes, doc_id, text, rule)
    named = classes.select("cid", "doc_id", "rows")
    if labels is None:
        named = named.withColumn("component_id", F.col("doc_id"))
    else:
        named = stored(named.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
                       .withColumn("label", F.coalesce("label", "cid")), "neardup-labels")
        smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
        named = join_counted(named, smallest, ["label"], "size", named.count())
    rows = sk.select("doc_id", "text_hash", "n", "cid")
    linked = join_counted(rows.filter("n > 0"), named.select("cid", "rows", "component_id"), ["cid"], "rows", rows.count())
    alone = rows.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    return linked.drop("rows").unionByName(alone)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = LINK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, class_id."""
    return _judged(docs, doc_id, text, rule).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("cid").alias("class_id"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = LINK) -> DataFrame:
    """The rows of ``docs`` that stay: one document of every component.  Rows are
    told apart by id and text, should an id be there twice."""
    gone = (_judged(docs, doc_id, text, rule).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_text")).distinct())
    rows = docs.select(whole_row(docs), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text_of(text)).alias("h"))
    return (rows.join(gone, F.col("id").eqNullSafe(F.col("gone")) & (F.col("h") == F.col("gone_text")), "left_anti")
            .select("row.*"))


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
