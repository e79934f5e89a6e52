"""Blocks of documents, and totals over all blocks for keys that a block holds.

Statistics about words or word sequences need, for every distinct key of a block
of documents, a total over all blocks.  One row per key and block would be most
of the work, so keys travel packed: a block asks with ascending 64-bit hashes and
the values it adds, cut by hash range into buckets; a bucket combines what all
blocks sent and answers each block with the totals in the order asked.  Both ways
are plain shuffles (``groupBy(...).applyInArrow``), hash ranges are even whatever
the keys are, and a key that is everywhere arrives once per block.

Blocks are rows of a table bucketed by block id, so they meet their answers
without moving again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import binary_values, pack, pack_sorted, scratch_path, shuffles_freed, unpack, unpack_sorted

#: Bytes of text in a block: what one task holds at a time.
BLOCK_BYTES = 6 << 20
MAX_BUCKETS = 50_000
#: Stands for a null id: larger than all others.
NO_ID = np.iinfo(np.int64).max

REQUEST = "tag string, bucket int, block long, keys binary, vals array<binary>"
REPLY = "tag string, bucket int, block long, vals array<binary>"
VALS = pa.list_(pa.binary())


def n_buckets(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """About one bucket per block: grows with the text."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("s")).first().s or 0
    return int(min(max(total // block_bytes + 1, 4), MAX_BUCKETS))


def _bucketed(rows: DataFrame, name: str, buckets: int) -> DataFrame:
    spark = rows.sparkSession
    with shuffles_freed(spark):
        (rows.write.bucketBy(buckets, "block").option("path", scratch_path(spark, name)).option("compression", "none")
         .format("parquet").saveAsTable(name))
    return spark.table(name)


def write_replies(reply: DataFrame, buckets: int) -> DataFrame:
    """Replies as a table bucketed like the blocks: they move to their block once,
    however often the block reads them."""
    return _bucketed(reply.repartition(buckets, "block"), f"llm_replies_{uuid.uuid4().hex[:12]}", buckets)


def write_blocks(docs: DataFrame, encode: Callable, buckets: int, doc_id: str = "doc_id", text: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, payload): consecutive documents of a scan task, ``encode(ids, texts)``
    makes the payload (a list of byte strings).  Texts are never cut; a block ends
    once it has ``block_bytes``."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ids: list = []
        texts: list[bytes] = []
        size = seq = 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([task << 24 | seq], pa.int64()), pa.array([encode(ids, texts)], VALS)],
                                              names=["block", "payload"])
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), binary_values(b.column("text"))):
                ids.append(i)
                texts.append(t)
                size += len(t) + 16
                if size >= block_bytes:
                    yield row()
                    ids, texts, size, seq = [], [], 0, seq + 1
        if ids:
            yield row()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return _bucketed(rows.mapInArrow(blocks, "block long, payload array<binary>"), f"llm_blocks_{uuid.uuid4().hex[:12]}", buckets)


def encode_texts(ids: list, texts: list[bytes]) -> list[bytes]:
    blob = b"".join(texts)
    return [pack(np.array([NO_ID if i is None else i for i in ids], np.int64)), pack(np.array([len(t) for t in texts], np.int64)),
            pack(np.frombuffer(blob, np.uint8))]


def decode_texts(payload: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    ids, size = unpack(payload[0], np.int64), unpack(payload[1], np.int64)
    blob, end = unpack(payload[2], np.uint8).tobytes(), np.cumsum(size)
    return ids, [blob[e - n:e] for e, n in zip(end.tolist(), size.tolist())]


# ---------------------------------------------------------------------------

def hash_ranges(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, bucket) for ascending ``keys``: buckets are even ranges of hashes."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.r_[0, np.flatnonzero(np.diff(of)) + 1, keys.size] if keys.size else np.empty(0, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield a, b, int(of[a])


def request_rows(tag: str, block: int, keys: np.ndarray, vals: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """Rows that ask for the totals of ascending ``keys``, one per hash range."""
    for a, b, bucket in hash_ranges(keys, buckets):
        yield tag, bucket, block, pack_sorted(keys[a:b]), [pack(v[a:b]) for v in vals]


def request_batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    tag, bucket, block, keys, vals = zip(*rows, strict=True) if (rows := list(rows)) else ((), (), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(tag, pa.string()), pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(keys, pa.binary()),
         pa.array(vals, VALS)], names=["tag", "bucket", "block", "keys", "vals"])


def replies(requests: DataFrame, kinds: dict[str, list[tuple[str, str]]],
            summary: Callable[[str, list[np.ndarray]], list[np.ndarray]] | None = None, number: int = 0) -> DataFrame:
    """Totals for all requests.  ``kinds[tag]`` lists (dtype, ufunc name) for each
    value.  ``summary(tag, totals over the bucket's distinct keys)`` may add a row
    with block -1 per bucket.  With ``number`` (the number of buckets) a last value
    numbers the distinct keys of all buckets: no two share one, and as hash ranges
    are even, numbers stay near the count of keys."""
    def answer(table: pa.Table) -> pa.Table:
        tag, bucket = table.column("tag")[0].as_py(), table.column("bucket")[0].as_py()
        parts = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
        vals = table.column("vals").to_pylist()
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        new = np.r_[True, np.diff(keys[order]) != 0]
        start = np.flatnonzero(new)
        place = np.empty(keys.size, np.int64)
        place[order] = np.cumsum(new) - 1
        totals = []
        for c, (dtype, how) in enumerate(kinds[tag]):
            v = np.concatenate([unpack(x[c], dtype) for x in vals])[order]
            totals.append(getattr(np, how).reduceat(v, start))
        if number:
            totals.append(np.arange(start.size, dtype=np.int64) * number + bucket)
        end = np.cumsum([p.size for p in parts]).tolist()
        out, blocks = [], table.column("block").to_pylist()
        for p, e in zip(parts, end):
            at = place[e - p.size:e]
            out.append([pack(t[at]) for t in totals])
        if summary is not None and (more := summary(tag, totals)) is not None:
            blocks, out = [*blocks, -1], [*out, [pack(x) for x in more]]
        return pa.table({"tag": pa.array([tag] * len(out), pa.string()), "bucket": pa.array([bucket] * len(out), pa.int32()),
                         "block": pa.array(blocks, pa.int64()), "vals": pa.array(out, VALS)})

    return requests.groupBy("tag", "bucket").applyInArrow(answer, REPLY)


def collected(table: pa.Table) -> dict[str, list[list[bytes]]]:
    """The replies to one block by tag, in key order."""
    rows = sorted(zip(table.column("tag").to_pylist(), table.column("bucket").to_pylist(), table.column("vals").to_pylist()),
                  key=lambda r: r[:2])
    out: dict[str, list[list[bytes]]] = {}
    for tag, _, vals in rows:
        out.setdefault(tag, []).append(vals)
    return out


def reply_values(got: dict[str, list[list[bytes]]], tag: str, column: int, dtype) -> np.ndarray:
    parts = [unpack(v[column], dtype) for v in got.get(tag, [])]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def with_replies(blocks: DataFrame, reply: DataFrame, func: Callable, schema: str) -> DataFrame:
    """``func(block id, payload, replies by tag) -> RecordBatch or Table`` over all blocks."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [func(b, p, collected(right)) for b, p in zip(left.column("block").to_pylist(), left.column("payload").to_pylist())]
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([], pa.schema([]))

    return blocks.groupBy("block").cogroup(reply.filter("block >= 0").groupBy("block")).applyInArrow(run, schema)


def per_block(blocks: DataFrame, func: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(b.column("block").to_pylist(), b.column("payload").to_pylist()):
                yield func(block, payload, {})

    return blocks.mapInArrow(run, schema)
