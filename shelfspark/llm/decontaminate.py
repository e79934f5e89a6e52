"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each Arrow batch of training documents is a shard.  A suffix array over its words
is sorted once; every suffix of every benchmark item is then binary-searched in
it, which gives the longest verbatim matches and where they lie.  Shards need no
shuffle.  Benchmark items are searched in blocks of bounded size, so a large
benchmark costs more passes, never more memory.

Defined results: null and wordless texts (of documents or items) have no match;
an item with fewer words than a window is one window of all its words; repeated
documents are judged one by one, items with equal words each count; a null item
id is listed as the empty string; other columns of the input pass through
``remove_contaminated`` untouched.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import binary_values, text_of

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Words searched at once: batches of longer texts are cut into more shards.
SHARD_BYTES = 16 << 20

#: Bytes of words: digits, letters (lower-cased) and everything outside ASCII.
_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32
                    for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class TestSuffixes:
    """All suffixes of a block of benchmark items, as arrays of word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.items: list[str] = []
        seqs: list[list[int]] = []
        for item_id, text in items:
            words = split_words(text)
            if words:
                self.items.append(item_id)
                seqs.append([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words])
        sizes = np.array([len(s) for s in seqs], np.int64)
        # All items one after another, each closed by a 0 that no word matches.
        self.words = np.array([x for s in seqs for x in (*s, 0)], np.int64)
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        # Suffixes with room for a window (a short item has one: itself).
        need = np.minimum(sizes, window)
        n = sizes - need + 1
        self.item = np.repeat(np.arange(len(seqs)), n)
        self.start = np.repeat(begin, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        self.need = need[self.item]
        self.shortest = int(need.min()) if len(seqs) else 0
        low = _keys(self.words, self.start, self.need, window, 0)
        # Items that share a window are searched once for it.
        self.low, first, self.key_of = np.unique(low, return_index=True, return_inverse=True)
        self.key_need = self.need[first]
        self.high = _keys(self.words, self.start[first], self.key_need, window, 0xFFFFFFFF)
        self.key_start = self.start[first]
        order = np.argsort(self.key_of, kind="stable")
        self.key_items = np.split(self.item[order], np.cumsum(np.bincount(self.key_of, minlength=len(first)))[:-1]) if len(first) else []


def _keys(words: np.ndarray, start: np.ndarray, need: np.ndarray, window: int, fill: int) -> np.ndarray:
    """The first ``need`` words at each start as one fixed-width key that sorts
    like the word sequence; the places beyond are filled."""
    at = start[:, None] + np.arange(window)
    k = words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else np.zeros(at.shape, np.int64)
    k = np.where(np.arange(window) < need[:, None], k, fill).astype(">u4")
    return np.ascontiguousarray(k).view(f"S{4 * window}").ravel()


def search_shard(tests: TestSuffixes, texts: list[bytes]):
    """Longest matches of the test suffixes in one shard.

    Returns (words per text, and for each match: its text, first word, length in
    words, index of the matched window key).
    """
    vocab, window = tests.vocab, tests.window
    seqs = [split_words(t) for t in texts]
    n_words = np.array([len(s) for s in seqs], np.int64)
    get = vocab.get
    words = np.fromiter((x for s in seqs for x in (*(get(w, 0) for w in s), 0)), np.int64, int(n_words.sum()) + len(seqs))
    del seqs
    begin = np.cumsum(n_words + 1) - (n_words + 1)
    none = (n_words, *(np.empty(0, np.int64) for _ in range(4)))
    if not words.size or not tests.shortest:
        return none
    # A suffix can only match if its first words all occur in the benchmark:
    # 0 stands for every other word and for the end of a text.
    zero = np.flatnonzero(words == 0)
    run = np.full(words.size, words.size, np.int64)
    run[:zero[-1] + 1] = zero[np.searchsorted(zero, np.arange(zero[-1] + 1))]
    run -= np.arange(words.size)
    cand = np.flatnonzero(run >= tests.shortest)
    if not cand.size:
        return none
    keys = _keys(words, cand, np.minimum(run[cand], window), window, 0)
    order = np.argsort(keys, kind="stable")
    suffixes = keys[order]
    lo = np.searchsorted(suffixes, tests.low, "left")
    hi = np.searchsorted(suffixes, tests.high, "right")
    n = hi - lo
    key = np.repeat(np.arange(n.size), n)
    at = cand[order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
    # Extend each match word by word as far as the texts agree.
    length = tests.key_need[key]
    live = np.arange(at.size)
    tw = tests.words
    while live.size:
        p, q = at[live] + length[live], tests.key_start[key[live]] + length[live]
        same = (p < words.size) & (q < tw.size)
        same[same] = (words[p[same]] == tw[q[same]]) & (tw[q[same]] != 0)
        live = live[same]
        length[live] += 1
    doc = np.searchsorted(begin, at, "right") - 1
    return n_words, doc, at - begin[doc], length, key


def _slices(texts: list[bytes], most: int = SHARD_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts with a bounded number of bytes together (or one text)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


_LONGS, _STRINGS = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
MATCH_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.BinaryType()), T.StructField("n_words", T.LongType()),
    T.StructField("starts", _LONGS), T.StructField("ends", _LONGS), T.StructField("items", _STRINGS),
])


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[Broadcast]:
    """The benchmark in blocks of at most ``block_bytes`` (or one item), each
    broadcast as soon as it is full: the driver's program holds one block at a time
    and a handle for each of the others."""
    sc = benchmark.sparkSession.sparkContext
    handles: list[Broadcast] = []
    block: list[tuple[str, bytes]] = []
    size = 0
    for r in (benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"),
                               text_of(text_col).cast("binary").alias("t"))
              .orderBy("i", "t").toLocalIterator()):
        if block and size + len(r.t) > block_bytes:
            handles.append(sc.broadcast(block))
            block, size = [], 0
        block.append((r.i, bytes(r.t)))
        size += len(r.t)
    return [*handles, sc.broadcast(block)] if block else handles


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: n_words, the disjoint word ranges [starts, ends)
    inside matches and the sorted items with occurring windows.

    The benchmark is read block by block; each block is at most ``block_bytes`` and
    is broadcast.  A later pass adds to what the earlier ones found, so rows never
    move.
    """
    empty = F.array().cast("array<long>")
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"),
                      F.lit(0).cast("long").alias("n_words"), empty.alias("starts"), empty.alias("ends"),
                      F.array().cast("array<string>").alias("items"))
    for block in _item_blocks(benchmark, item_id, item_text, block_bytes) or [docs.sparkSession.sparkContext.broadcast([])]:
        out = out.mapInArrow(_searcher(block, window), MATCH_SCHEMA)
    return out.drop("text")


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """The union of ranges as disjoint ascending ranges."""
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > reach[:-1]]
    return s[new].tolist(), reach[np.r_[np.flatnonzero(new)[1:] - 1, s.size - 1]].tolist()


def _searcher(block: Broadcast, window: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestSuffixes(block.value, window)
        for batch in batches:
            starts, ends, items = (batch.column(c).to_pylist() for c in ("starts", "ends", "items"))
            counts = []
            for i, texts in _slices(binary_values(batch.column("text"))):
                n_words, doc, pos, length, key = search_shard(tests, texts)
                counts.append(n_words)
                order = np.argsort(doc, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if order.size else ():
                    k = i + int(doc[rows[0]])
                    starts[k], ends[k] = _merged(np.r_[starts[k], pos[rows]].astype(np.int64),
                                                 np.r_[ends[k], pos[rows] + length[rows]].astype(np.int64))
                    found = np.unique(np.concatenate([tests.key_items[x] for x in np.unique(key[rows])]))
                    items[k] = sorted({*items[k], *(tests.items[x] for x in found)})
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text"),
                pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
                pa.array(items, pa.list_(pa.string()))], names=MATCH_SCHEMA.names)
    return search


def n_covered(starts, ends) -> F.Column:
    """Words covered by disjoint ranges."""
    return F.aggregate(F.zip_with(starts, ends, lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, all columns kept.

    Affected rows go in the pass that finds them, so no row travels; with a
    benchmark of several blocks each pass works on what the last one kept.
    """
    schema = docs.schema
    out = docs
    for block in _item_blocks(benchmark, item_id, item_text, block_bytes):
        out = out.mapInArrow(_cleaner(block, window, text), schema)
    return out


def _cleaner(block: Broadcast, window: int, text: str):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestSuffixes(block.value, window)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            texts = [(x or "").encode() for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for i, part in _slices(texts):
                keep[i + search_shard(tests, part)[1]] = False
            yield batch.filter(pa.array(keep))
    return clean


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 (ids sorted as strings,
    comma-joined), contaminated, longest (words of its longest matched range)."""
    found = matches(docs, benchmark, **options)
    return found.select(
        "doc_id", "n_words", n_covered(F.col("starts"), F.col("ends")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.zip_with("starts", "ends", lambda a, b: b - a)), F.lit(0).cast("long")).alias("longest"))
