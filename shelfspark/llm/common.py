"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import checkpoint_root, scratch_path, ship_package, shuffles_freed

#: Separators between words: space and the ASCII controls tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes in one Arrow batch handed to Python.  Texts can be long and rows
#: can be packed blocks, so rows alone are no useful bound.
ARROW_ROWS, ARROW_BYTES = 256, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Shared folder, package on the executors, bounded Arrow batches."""
    checkpoint_root(spark)
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, and
    what reads it several times does not derive it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(c: str | Column = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def hash_mod(c: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n`` (null: of the empty text)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct: helper columns beside it can't clash
    with the names of an input."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def join_counted(left: DataFrame, groups: DataFrame, key: list[str], size: str, total: int,
                 share: int = 1000) -> DataFrame:
    """Inner join of ``left`` with ``groups`` (one row per key; ``size`` is the
    number of left rows with that key) without a hot task.

    Keys with more than ``total / share`` rows go by broadcast: by counting there
    are fewer than ``share`` of them, whatever the input.  All other keys hold at
    most that share of the rows each, and go by a shuffle join.
    """
    limit = max(total // share, 1)
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    rest = groups.filter(F.col(size) <= limit)
    names = [*left.columns, *[c for c in groups.columns if c not in key]]
    return (left.join(hot, key).select(*names)
            .unionByName(left.join(F.broadcast(groups.filter(F.col(size) > limit).select(*key)), key, "left_anti")
                         .join(rest, key).select(*names)))


# ---------------------------------------------------------------------------
# Arrays in binary columns

def pack(a: np.ndarray) -> bytes:
    """An integer array as zstd-compressed byte planes, least significant first."""
    a = np.ascontiguousarray(a)
    raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.size else b""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(b: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.empty(0, dtype)
    raw = np.frombuffer(pa.decompress(b[8:], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned integers, as packed differences."""
    return pack(np.diff(a, prepend=a.dtype.type(0))) if a.size else pack(a)


def unpack_sorted(b: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(b, dtype), dtype=dtype)


# ---------------------------------------------------------------------------
# 64-bit hashing of words and word sequences

def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche on uint64 arrays (wraps modulo 2**64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(h: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its start and of its next element."""
    return mix64(h * np.uint64(0x9E3779B97F4A7C15) + nxt)


def window_hash(h: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Mixed polynomial hash of every ``n`` consecutive values of ``h``."""
    if h.size < n:
        return np.empty(0, np.uint64)
    p = np.uint64(base | 1)
    out = np.zeros(h.size - n + 1, np.uint64)
    # Binary decomposition: hashes of 1, 2, 4... values combine to ``n`` values.
    part, width, done = h.astype(np.uint64), 1, 0
    power = p
    left = n
    while left:
        if left & 1:
            out = out * power + part[done:done + out.size]
            done += width
        left >>= 1
        if left:
            part = part[:-width] * power + part[width:] if part.size > width else part[:0]
            power = power * power
            width *= 2
    return mix64(out)


class Words:
    """Interns words (bytes) as small integers and keeps their 64-bit hashes."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}

    def add(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        for w in dict.fromkeys(words):
            if w not in ids:
                ids[w] = len(ids)
        return np.fromiter(map(ids.__getitem__, words), np.int32, len(words))

    def hashes(self) -> np.ndarray:
        import xxhash

        h = xxhash.xxh64_intdigest
        return np.fromiter((h(w) for w in self.ids), np.uint64, len(self.ids))


def spans_to_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask over ``n`` positions covered by any [start, end)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def binary_values(col) -> list[bytes]:
    """A binary Arrow column as a list, nulls as empty bytes."""
    return [x or b"" for x in col.to_pylist()]
