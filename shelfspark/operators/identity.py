"""Identity operators: dense positions, id repair, duplicate handling.

Tables carry no order, so every operator takes an explicit ``order_by`` key that
must be a total order (unique).  Nothing here sends a whole table, or a whole
hot group, through one task:

* ``dense_id`` buckets rows by sampled key bounds (one constant array in the plan),
  numbers rows within a bucket and adds per-bucket offsets (one row per bucket, broadcast).
* ``running_sum`` is a segmented prefix sum: a window per (group, chunk of the
  integral order key) plus a prefix over chunk totals, so a group holding a third
  of the table is spread over many tasks.
* ``keep_first`` is ``row_number() = 1``; Catalyst inserts a partial
  ``WindowGroupLimit`` before the shuffle, so a hot id shrinks map-side.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import is_blank, strip_ws

# Fixed value: prefix of generated ids.
GENERATED_ID_PREFIX = "generated_id_"
DUPLICATE_SUFFIX_SEPARATOR = "__"

DEFAULT_CHUNK = 1 << 20
#: Rows that one bucket of ``dense_id`` should hold at most (on average).
ROWS_PER_BUCKET = 4_000_000


def _cols(cols) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _num_partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


#: Between bounds in their literal; keys that hold it give no bound.
_SEP = "\x1f"


def _bounds(keyed: DataFrame, order: list[Column], n: int, per_bucket: int, seed: int, total: int) -> list[Column]:
    """Ascending bounds of ``n`` buckets, one constant array per order column.

    They come from a sample of about ``n * per_bucket`` keys, sorted and thinned by
    Spark; only the n - 1 bounds reach the driver, as one string per column, and the
    plan holds them as one constant each, however many buckets there are."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    types = [f.dataType for f in keyed.select(*keys).schema.fields]
    rows = keyed.select(*keys)
    if n <= 1 or not total:
        return []
    usable = [F.col(f"k{i}").isNotNull() & ~F.col(f"k{i}").cast("string").contains(_SEP) for i in range(len(keys))]
    sample = rows.sample(False, min(1.0, 1.2 * n * per_bucket / total), seed).where(functools.reduce(Column.__and__, usable))
    def as_text(name: str):
        return F.array_join(F.transform("b", lambda x: x[name].cast("string")), _SEP).alias(name)

    picked = (sample.agg(F.array_sort(F.collect_set(F.struct(*rows.columns))).alias("s"))
              .select(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(n - 1)),
                                                   lambda i: F.get("s", F.floor(i * F.size("s") / n).cast("int")))).alias("b"))
              .select(*[as_text(c) for c in rows.columns], F.size("b").alias("n")).first())
    if not picked["n"] or picked["k0"] is None:
        return []
    return [F.split(F.lit(picked[f"k{i}"]), _SEP).cast(T.ArrayType(t)) for i, t in enumerate(types)]


def _bucket(order: list[Column], bounds: list[Column]) -> Column:
    """The number of bounds <= key, by binary search over constant arrays."""
    if not bounds:
        return F.lit(0)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    size = F.size(bounds[0])

    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        at = F.struct(*[F.get(b, mid).alias(f"k{i}") for i, b in enumerate(bounds)])
        below = F.struct(acc["lo"].alias("lo"), mid.alias("hi"))
        above = F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))
        return F.when(acc["lo"] >= acc["hi"], acc).when(key < at, below).otherwise(above)

    start = F.struct(F.lit(0).alias("lo"), size.alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int")), start, step)["lo"]


def dense_id(df: DataFrame, order_by, out: str = "pos", num_partitions: int | None = None,
             sample_per_bucket: int = 20, seed: int = 17) -> DataFrame:
    """0-based dense position in ``order_by`` order, without a global window.

    Bucket bounds come from a sample of the keys; a binary search over them, held as
    constants, puts each row in its bucket.  Counts per bucket (one row per bucket,
    broadcast) give offsets and ``row_number`` within a bucket gives the rest.  The
    ids depend only on key values, never on partitioning or arrival order, so every
    consumer and any recomputation after a lost executor see the same ids.
    ``order_by`` must be unique; a null key comes first.  The number of buckets
    follows the rows.
    """
    total = df.count()
    n = num_partitions or max(_num_partitions(df), -(-total // ROWS_PER_BUCKET))
    order = _cols(order_by)
    bounds = _bounds(df, order, n, sample_per_bucket, seed, total)
    # A null key sorts first: it belongs to the first bucket.
    bucket = F.when(order[0].isNull(), F.lit(0)).otherwise(_bucket(order, bounds)) if len(order) == 1 else _bucket(order, bounds)
    # Never null, and Spark sees it: otherwise the join below filters by the search
    # over the bounds once more, down in the scan, where a small file is one task.
    bucket = F.coalesce(bucket, F.lit(0))
    within = Window.partitionBy("__bucket").orderBy(*order)
    ranked = df.withColumn("__bucket", bucket).withColumn("__rn", F.row_number().over(within))
    # Bucket sizes read off the window output: same clustering, same exchange.
    counts = ranked.groupBy("__bucket").agg(F.max("__rn").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    # offsets has one row per bucket: a proven bound for the broadcast.
    return (ranked.join(F.broadcast(offsets), "__bucket")
                  .withColumn(out, (F.col("__off") + F.col("__rn") - 1).cast("bigint"))
                  .drop("__bucket", "__rn", "__off"))


def running_sum(df: DataFrame, group_by, order_col: str, value: Column, out: str,
                chunk: int = DEFAULT_CHUNK, inclusive: bool = True) -> DataFrame:
    """Segmented prefix sum of a non-negative ``value`` per group in ``order_col`` order.

    ``order_col`` must be integral and unique within a group.  Work is split by
    ``chunk = order_col div chunk`` so no task holds more than ``chunk`` rows of
    one group; chunk totals (one row per group and chunk) carry the prefix.
    The totals are read off the window's output (the max of an inclusive
    running sum of non-negative values), so both branches share one exchange.
    """
    groups = [g for g in ([group_by] if isinstance(group_by, str) else list(group_by))]
    keyed = df.withColumn("__chunk", F.floor(F.col(order_col) / F.lit(chunk)).cast("bigint")) \
              .withColumn("__v", value.cast("bigint"))
    frame = (Window.partitionBy(*groups, "__chunk").orderBy(order_col)
             .rowsBetween(Window.unboundedPreceding, 0))
    local = keyed.withColumn("__incl", F.coalesce(F.sum("__v").over(frame), F.lit(0)))
    totals = local.groupBy(*groups, "__chunk").agg(F.max("__incl").alias("__tot"))
    earlier = Window.partitionBy(*groups).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(*groups, "__chunk", F.coalesce(F.sum("__tot").over(earlier), F.lit(0)).alias("__before"))
    own = F.col("__incl") if inclusive else F.col("__incl") - F.col("__v")
    return (local.join(prefix, [*groups, "__chunk"])
                 .withColumn(out, (F.col("__before") + own).cast("bigint"))
                 .drop("__chunk", "__v", "__incl", "__before"))


def fill_blank_ids(df: DataFrame, id_col: str, pos_col: str, style: str = "position",
                   title: str | None = None, category: str | None = None) -> DataFrame:
    """Replace blank ids (null, blank, 'nan'); others are stripped.

    style 'generated' -> ``generated_id_<pos>``; 'position' -> ``<pos>``;
    'md5' -> first 16 hex digits of md5(``title|category|pos``).
    """
    pos = F.col(pos_col).cast("string")
    if style == "generated":
        fill = F.concat(F.lit(GENERATED_ID_PREFIX), pos)
    elif style == "position":
        fill = pos
    elif style == "md5":
        t = F.coalesce(F.col(title), F.lit("")) if title else F.lit("")
        c = F.coalesce(F.col(category), F.lit("")) if category else F.lit("")
        fill = F.substring(F.md5(F.concat(t, F.lit("|"), c, F.lit("|"), pos)), 1, 16)
    else:
        raise ValueError(f"unknown style {style!r}")
    if id_col not in df.columns:
        df = df.withColumn(id_col, F.lit(None).cast("string"))
    src = F.col(id_col).cast("string")
    return df.withColumn(id_col, F.when(is_blank(src), fill).otherwise(strip_ws(src)))


def suffix_duplicates(df: DataFrame, id_col: str, pos_col: str, out: str | None = None,
                      chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """I4: the k-th repeat (k >= 1, in position order) of an id gets ``__k``.

    An id that already looked like that may now be there twice; such repeats get a
    suffix again, until every id is unique.  The passes after the first, and the
    checks, run on a narrow table of ids and positions in the shared folder; ``df``
    itself is derived for it and for the result.  Positions are unique, ids not null
    (``fill_blank_ids`` comes first).
    """
    out = out or id_col
    narrow = _stored(df.select(F.col(id_col).alias("__id"), F.col(pos_col).alias("__pos")), "suffixes")
    now, passes = narrow, 0
    while True:
        now = _stored(_suffix_once(now, "__id", "__pos", "__id", chunk), "suffixes")
        passes += 1
        if not suffix_collisions(now, "__id"):
            break
    if passes == 1:
        return _suffix_once(df, id_col, pos_col, out, chunk)
    named = now.withColumnRenamed("__id", "__new").withColumnRenamed("__pos", pos_col)
    return df.join(named, pos_col).withColumn(out, F.col("__new")).drop("__new").select(
        *df.columns, *([out] if out not in df.columns else []))


def _stored(df: DataFrame, name: str) -> DataFrame:
    from shelfspark.session import scratch_path

    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _suffix_once(df: DataFrame, id_col: str, pos_col: str, out: str, chunk: int) -> DataFrame:
    ranked = running_sum(df, id_col, pos_col, F.lit(1), "__k", chunk=chunk, inclusive=False)
    return (ranked.withColumn(out, F.when(F.col("__k") > 0,
                                          F.concat(F.col(id_col), F.lit(DUPLICATE_SUFFIX_SEPARATOR),
                                                   F.col("__k").cast("string")))
                                     .otherwise(F.col(id_col)))
                  .drop("__k"))


def suffix_collisions(df: DataFrame, id_col: str) -> int:
    """Number of ids that are still not unique (e.g. an input id already ended in ``__1``)."""
    return df.groupBy(id_col).count().where(F.col("count") > 1).count()


def keep_first(df: DataFrame, id_col: str, order_by) -> DataFrame:
    """One row per id, the first in ``order_by`` order."""
    w = Window.partitionBy(id_col).orderBy(*_cols(order_by))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def valid_rows(id_col: str, text_col: str, vec_col: str | None = None) -> Column:
    """Id not blank/'nan', text not blank, vector a non-empty list."""
    cond = ~is_blank(F.col(id_col)) & F.col(text_col).isNotNull() & (strip_ws(F.col(text_col)) != "")
    if vec_col is not None:
        cond = cond & F.col(vec_col).isNotNull() & (F.size(F.col(vec_col)) > 0)
    return cond
