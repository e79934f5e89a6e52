"""Substring dedup: winnowed anchors as seeds, extended both ways.

Anchors are the word sequences of ANCHOR words with the smallest hash among any
WINDOW - ANCHOR + 1 consecutive ones, so every window of WINDOW words holds one.
Documents are joined on the anchors' hashes: an anchor that no other document
has is no seed.  Every seed is extended both ways, up to WINDOW - ANCHOR words to
either side: each window around it is matched, and the smallest document that
holds the window is found.  Consecutive matched windows form the maximal repeats.

A word is removed if a window over it also starts in a document with a smaller
doc_id; windows are judged on the input.  Windows are compared by 64-bit hashes
of word hashes.

Defined results: null and wordless texts have no words; texts shorter than a
window lose nothing; repeats inside one document, or among rows with equal
doc_id, stay; a null doc_id is larger than all others; extra columns are not
read.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import Words, spans_to_mask, stored, window_hash
from shelfspark.llm.exchange import (NO_ID, REQUEST, decode_texts, encode_texts, n_buckets, per_block, replies, reply_values,
                                     request_batch, request_rows, with_replies, write_blocks)

WINDOW, ANCHOR = 50, 18


class Block:
    """The words of a block as hashes, document after document."""

    def __init__(self, payload: list[bytes]):
        self.ids, texts = decode_texts(payload)
        self.words = [t.split() for t in texts]
        lex = Words()
        tok = [lex.add(w) for w in self.words]
        self.h = lex.hashes()[np.concatenate(tok)] if tok else np.empty(0, np.uint64)
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.begin = np.cumsum(self.n) - self.n
        #: The document of every word.
        self.doc = np.repeat(np.arange(self.n.size), self.n)

    def starts(self, k: int) -> np.ndarray:
        """Whether ``k`` words of one document begin at each word."""
        last = (self.begin + self.n)[self.doc] if self.doc.size else self.doc
        return np.arange(self.doc.size) + k <= last

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the winnowed anchors of documents with a window."""
        room = self.starts(WINDOW)
        if not room.any():
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        k = window_hash(self.h, ANCHOR)
        span = WINDOW - ANCHOR + 1
        at = np.flatnonzero(room)
        view = np.lib.stride_tricks.sliding_window_view(k, span)
        pos = np.concatenate([np.unique(a + view[a].argmin(axis=1)) for a in np.array_split(at, max(at.size // 100_000, 1))])
        pos = np.unique(pos)
        return pos, k[pos]


def _grouped(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, their smallest and largest id, the key of each row."""
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, np.diff(keys[order]) != 0] if keys.size else np.empty(0, bool)
    start = np.flatnonzero(new)
    place = np.empty(keys.size, np.int64)
    place[order] = np.cumsum(new) - 1
    if not keys.size:
        return keys, ids, ids, place
    return keys[order][start], np.minimum.reduceat(ids[order], start), np.maximum.reduceat(ids[order], start), place


def _ask_anchors(buckets: int):
    def ask(block: int, payload, _got) -> pa.RecordBatch:
        b = Block(payload)
        pos, h = b.anchors()
        keys, least, most, _ = _grouped(h, b.ids[b.doc[pos]])
        return request_batch(request_rows("anchor", block, keys, [least, most], buckets))
    return ask


def _windows(b: Block, got) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows around seeds."""
    pos, h = b.anchors()
    _, _, _, place = _grouped(h, b.ids[b.doc[pos]])
    least, most = (reply_values(got, "anchor", c, np.int64) for c in (0, 1))
    seed = pos[(least != most)[place]] if pos.size else pos
    if not seed.size:
        return seed, np.empty(0, np.uint64)
    near = spans_to_mask(b.doc.size, np.maximum(seed + ANCHOR - WINDOW, b.begin[b.doc[seed]]), seed + 1)
    at = np.flatnonzero(near & b.starts(WINDOW))
    return at, window_hash(b.h, WINDOW)[at]


def _ask_windows(buckets: int):
    def ask(block: int, payload, got) -> pa.RecordBatch:
        b = Block(payload)
        at, h = _windows(b, got)
        keys, least, _, _ = _grouped(h, b.ids[b.doc[at]])
        return request_batch(request_rows("window", block, keys, [least], buckets))
    return ask


_RESULT = "doc_id long, n_words long, starts array<long>, ends array<long>, kept binary"


def _cut(block: int, payload, got) -> pa.RecordBatch:
    b = Block(payload)
    at, h = _windows(b, got)
    _, _, _, place = _grouped(h, b.ids[b.doc[at]])
    first = reply_values(got, "window", 0, np.int64)
    hit = at[first[place] < b.ids[b.doc[at]]] if at.size else at
    gone = spans_to_mask(b.doc.size, hit, hit + WINDOW)
    edge = np.flatnonzero(gone & ~np.r_[False, gone[:-1] & (b.doc[1:] == b.doc[:-1])]) if gone.size else hit
    stop = np.flatnonzero(gone & ~np.r_[gone[1:] & (b.doc[1:] == b.doc[:-1]), False]) if gone.size else hit
    starts, ends, kept = [[] for _ in b.words], [[] for _ in b.words], [b" ".join(w) for w in b.words]
    for s, e in zip(edge.tolist(), stop.tolist()):
        d = int(b.doc[s])
        starts[d].append(s - int(b.begin[d]))
        ends[d].append(e + 1 - int(b.begin[d]))
    for d in np.unique(b.doc[edge]).tolist():
        keep = ~gone[b.begin[d]:b.begin[d] + b.n[d]]
        kept[d] = b" ".join([w for w, k in zip(b.words[d], keep.tolist()) if k])
    return pa.RecordBatch.from_arrays([
        pa.array(b.ids, pa.int64(), mask=b.ids == NO_ID), pa.array(b.n, pa.int64()), pa.array(starts, pa.list_(pa.int64())),
        pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "starts", "ends", "kept"])


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, the removed word ranges
    [starts, ends) and the kept words joined by one space (UTF-8 bytes)."""
    buckets = n_buckets(docs, text)
    blocks = write_blocks(docs, encode_texts, buckets, doc_id, text)
    both = {"anchor": [("int64", "minimum"), ("int64", "maximum")], "window": [("int64", "minimum")]}
    seeds = stored(replies(per_block(blocks, _ask_anchors(buckets), REQUEST), both), "substring-anchors")
    found = stored(replies(with_replies(blocks, seeds, _ask_windows(buckets), REQUEST), both), "substring-windows")
    return with_replies(blocks, seeds.unionByName(found), _cut, _RESULT)


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_repeats (maximal repeats cut out)."""
    out = deduplicate(docs, **options)
    gone = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"),
                      F.size("starts").cast("long").alias("n_repeats"))
