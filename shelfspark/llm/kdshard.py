"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

The tree splits recursively: a node takes the metadata dimension in which its
documents are spread widest (relative to the spread of all documents) and is cut
at the weighted median of that dimension, the weight of a document being its
bytes.  A node that still stands for n leaves is cut at the quantile
floor(n / 2) / n, so any number of leaves comes out even.  The tree ends when its
leaves have reached the target size; the leaves are the shards.

All nodes of a level look for their medians together.  A pass bins the rows that
can still be the median into BINS equal intervals per node (bytes and extremes of
a bin are pre-aggregated before the shuffle, a node's running sum is over at most
BINS rows) and the next pass goes into the bin that holds it.  Rows with equal
values are cut by a hash of their doc_id, then by their number in the staged
table, so one value, one source or one group of copies may hold any share of all
rows.  Texts are read once; passes read narrow rows from the shared folder.

Defined results: a null text has no bytes (its row counts OVERHEAD) and crc32 0; a
null or not-a-number coordinate counts as 0, a null string as the empty one;
strings are ordered by their first seven bytes; repeated rows are rows like all
others; with fewer rows than shards some shards stay empty; an empty table gives
an empty result.  Extra columns are not read, ``write_shards`` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import shuffle_partitions, stored, text_of, whole_row

#: Intervals a node's remaining range is cut into per pass.
BINS = 4096
#: Bytes a row counts beside its text.
OVERHEAD = 8
#: Rows that one task numbers within a shard.
CHUNK_ROWS = 1_000_000
DIMS = ("n_chars", "source", "lang")
_LARGEST = 1e300


def coordinate(docs: DataFrame, name: str) -> Column:
    """A metadata column as a double that keeps its order."""
    c, kind = F.col(f"`{name}`"), docs.schema[name].dataType
    if isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        first = F.rpad(F.hex(F.substring(F.coalesce(c.cast("binary"), F.lit(b"")), 1, 7)), 14, "0")
        c = F.conv(first, 16, 10)
    x = F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.least(x, F.lit(_LARGEST)), F.lit(-_LARGEST))


def staged(docs: DataFrame, dims: tuple = DIMS, doc_id: str = "doc_id", text: str = "text",
           number: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, h, r, c0...): what the tree needs of a document.
    ``r`` numbers the rows; the table has to be written to fix it."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.col(doc_id)), 12).cast("double").alias("h"),
        (F.monotonically_increasing_id().cast("double") if number is None else number).alias("r"),
        *[coordinate(docs, d).alias(f"c{i}") for i, d in enumerate(dims)])


def _extremes(names: list[str]) -> list[Column]:
    return [f(c).alias(f"{side}_{c}") for c in names for side, f in (("lo", F.min), ("hi", F.max))]


def _narrowed(state: DataFrame) -> DataFrame:
    """Next range of every node: in the same key, or in the next one once all rows
    left have one value.  Keys are 0 the dimension, 1 the hash, 2 the row."""
    same_x = (F.col("k") > 0) | (F.col("lo_x") == F.col("hi_x"))
    same_h = (F.col("k") > 1) | (same_x & (F.col("lo_h") == F.col("hi_h")))
    alone = F.col("n") == 1
    k = F.when(alone | ~same_x, F.col("k")).when(~same_h, F.greatest(F.col("k"), F.lit(1))).otherwise(F.lit(2))
    side = lambda s: F.when(F.col("k") == 0, F.col(f"{s}_x")).when(F.col("k") == 1, F.col(f"{s}_h")).otherwise(F.col(f"{s}_r"))
    return (state.withColumn("k", k).withColumn("lo", side("lo")).withColumn("hi", side("hi"))
            .select("first", "leaves", "dim", "goal", "before", "n", "w", "k", F.col("lo_x").alias("v0"),
                    F.col("lo_h").alias("v1"), "lo", "hi"))


def _start(rows: DataFrame, n_dims: int, spread: list[float]) -> DataFrame:
    """Every node that is to be split: its widest dimension and the bytes that go left."""
    dims = [f"c{i}" for i in range(n_dims)]
    of = rows.filter("leaves > 1").groupBy("first", "leaves").agg(
        F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), *_extremes([*dims, "h", "r"]))
    width = F.array(*[(F.col(f"hi_{c}") - F.col(f"lo_{c}")) / F.lit(s or 1.0) for c, s in zip(dims, spread)])
    pick = lambda s: F.element_at(F.array(*[F.col(f"{s}_{c}") for c in dims]), F.col("dim"))
    return _narrowed(of.withColumn("dim", F.array_position(width, F.array_max(width)).cast("int"))
                     .withColumn("goal", F.col("w") * F.floor(F.col("leaves") / 2) / F.col("leaves"))
                     .withColumn("before", F.lit(0).cast("long")).withColumn("k", F.lit(0))
                     .withColumn("lo_x", pick("lo")).withColumn("hi_x", pick("hi")))


def _refined(rows: DataFrame, state: DataFrame, n_dims: int) -> DataFrame:
    """One pass for all nodes whose range still has several values."""
    live = state.filter("lo < hi").drop("n", "w")
    key = F.when(F.col("k") == 0, F.col("x")).when(F.col("k") == 1, F.col("h")).otherwise(F.col("r"))
    inside = ((F.col("k") == 0) | (F.col("x") == F.col("v0"))) & ((F.col("k") < 2) | (F.col("h") == F.col("v1")))
    at = F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
    bins = (rows.drop("leaves").join(F.broadcast(live), "first")
            .withColumn("x", F.element_at(F.array(*[F.col(f"c{i}") for i in range(n_dims)]), F.col("dim")))
            .withColumn("key", key).filter(inside & F.col("key").between(F.col("lo"), F.col("hi")))
            .groupBy("first", "goal", "before", at.alias("bin"))
            .agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), *_extremes(["x", "h", "r"])))
    up_to = F.sum("w").over(Window.partitionBy("first").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    found = (bins.withColumn("reached", F.col("before") + up_to).filter(F.col("reached") >= F.col("goal"))
             .withColumn("nth", F.row_number().over(Window.partitionBy("first").orderBy("bin"))).filter("nth = 1")
             .withColumn("before", F.col("reached") - F.col("w")).drop("goal", "reached", "bin", "nth"))
    return _narrowed(live.select("first", "leaves", "dim", "goal", "k").join(found, "first")).unionByName(state.filter("lo = hi"))


def _divided(rows: DataFrame, cuts: DataFrame, n_dims: int) -> DataFrame:
    """Rows with the child of their node: what lies before the cut goes left, the
    rows at the cut go where they bring the left side nearer to its goal."""
    cut = cuts.select("first", "dim", "k", "v0", "v1", "lo", (F.col("goal") - F.col("before") > F.col("w") / 2).alias("at_left"))
    x = F.element_at(F.array(*[F.col(f"c{i}") for i in range(n_dims)]), F.col("dim"))
    before = lambda c: (c < F.col("lo")) | ((c == F.col("lo")) & F.col("at_left"))
    left = F.when(F.col("k") == 0, before(x)).when(
        F.col("k") == 1, (x < F.col("v0")) | ((x == F.col("v0")) & before(F.col("h")))).otherwise(
        (x < F.col("v0")) | ((x == F.col("v0")) & ((F.col("h") < F.col("v1")) | ((F.col("h") == F.col("v1")) & before(F.col("r"))))))
    half = F.floor(F.col("leaves") / 2).cast("int")
    return (rows.join(F.broadcast(cut), "first", "left")
            .withColumn("go", F.when(F.col("dim").isNull(), F.lit(0)).when(left, F.lit(1)).otherwise(F.lit(2)))
            .select(*[c for c in rows.columns if c not in ("first", "leaves")],
                    F.when(F.col("go") == 2, F.col("first") + half).otherwise(F.col("first")).cast("int").alias("first"),
                    F.when(F.col("go") == 0, F.col("leaves")).when(F.col("go") == 1, half)
                    .otherwise(F.col("leaves") - half).cast("int").alias("leaves")))


def _with_slots(rows: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """Gapless numbers from 0 within every shard: rows are numbered in chunks and
    the chunks before are added.  Chunks are as many as rows / CHUNK_ROWS, and some
    per shuffle partition: their table is the one that is broadcast."""
    chunks = max(math.ceil(n_rows / shards / CHUNK_ROWS), math.ceil(4 * shuffle_partitions(rows.sparkSession) / shards))
    cut = rows.withColumn("chunk", F.pmod(F.xxhash64("r"), F.lit(chunks)))
    sizes = cut.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("offset", F.coalesce(before, F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("h", "r"))
    return (cut.withColumn("nth", nth).join(F.broadcast(offsets), ["shard", "chunk"])
            .withColumn("slot", (F.col("offset") + F.col("nth") - 1).cast("long")).drop("chunk", "nth", "offset"))


def assign(rows: DataFrame, n_dims: int, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``staged`` rows (stored) with shard and slot.  The leaves reach the target
    bytes, or their number is given."""
    dims = [f"c{i}" for i in range(n_dims)]
    all_of = rows.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), *_extremes(dims)).first()
    if shards is None:
        shards = max(math.ceil((all_of.w or 0) / target_bytes), 1)
    spread = [(all_of[f"hi_{c}"] or 0.0) - (all_of[f"lo_{c}"] or 0.0) for c in dims]
    rows = rows.withColumn("first", F.lit(0)).withColumn("leaves", F.lit(shards))
    for _ in range(math.ceil(math.log2(shards))) if all_of.n else ():
        state = stored(_start(rows, n_dims, spread), "kd-cuts")
        while state.filter("lo < hi").limit(1).count():
            state = stored(_refined(rows, state, n_dims), "kd-cuts")
        rows = stored(_divided(rows, state, n_dims), "kd-rows")
    return _with_slots(rows.withColumnRenamed("first", "shard").drop("leaves"), all_of.n, shards)


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple = DIMS,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot."""
    rows = stored(staged(docs, dims, doc_id, text), "kd-rows")
    return assign(rows, len(dims), shards, target_bytes).select("doc_id", "size", "text_crc32", "shard", "slot")


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def write_shards(docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None,
                 dims: tuple = DIMS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as Parquet under ``path``, one folder per shard, by slot within a
    file, with columns shard and slot (underscores added while the input has such
    names); returns the assignment (doc_id, size, text_crc32, shard, slot)."""
    no, to, at = (_free(n, docs.columns) for n in ("row_no", "shard", "slot"))
    numbered = stored(docs.withColumn(no, F.monotonically_increasing_id().cast("double")), "kd-docs")
    rows = stored(staged(numbered, dims, doc_id, text, F.col(no)), "kd-rows")
    placed = stored(assign(rows, len(dims), shards, target_bytes), "kd-placed")
    place = placed.select(F.col("r").alias(no), F.col("shard").alias(to), F.col("slot").alias(at))
    numbered.join(place, no).drop(no).sortWithinPartitions(to, at).write.partitionBy(to).parquet(path)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


def report(docs: DataFrame, shards: int = 24, dims: tuple = DIMS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: sizes in bytes come
    out near equal; a tree for one more shard would be another tree."""
    return shard(docs, shards, dims=dims).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                                 F.lit(None).cast("int").alias("grown_shard"))
