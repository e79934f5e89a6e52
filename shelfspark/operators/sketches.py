"""Mergeable column profiles (A2, A3, A5): sketches per batch, merged when read.

A profile of a batch has one row per column: rows and blank cells (exact), a distinct
sketch (HyperLogLog), a quantile sketch of the lengths (KLL) and a frequent-item
sketch, all of bounded size.  Profiles are stored by batch number, so a batch profiled
again replaces its rows, and the profile of the whole table reads and merges sketches
only, however large the table has grown.

Error bounds, as the tests check them: distinct counts within 4 standard errors of
1.04 / sqrt(2**LG_K) (6.5 % at 12); the rank of a reported quantile within 2.7 % of
the asked one; the count of an item within 3.5 / TRACKED of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.text import is_blank

#: Log2 of the registers of a distinct sketch; items a frequent-item sketch follows.
LG_K, TRACKED = 12, 10_000
#: Longer values count as their start and a digest.
ITEM_CHARS = 64
QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)

_SKETCHES = ("n_rows", "n_empty", "distinct_sketch", "length_sketch", "item_sketch")


def _item(c):
    return F.when(F.length(c) <= ITEM_CHARS, c).otherwise(F.concat(F.substring(c, 1, ITEM_CHARS), F.md5(c.cast("binary"))))


def column_profiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column of ``columns``, in one pass: column_name, n_rows, n_empty
    and the three sketches.  Blank cells are in none of the sketches."""
    aggs = []
    for i, name in enumerate(columns):
        text = F.col(f"`{name}`").cast("string")
        value = F.when(~is_blank(text), text)
        aggs += [F.count(F.lit(1)).alias(f"n_rows{i}"), F.count_if(is_blank(text)).alias(f"n_empty{i}"),
                 F.hll_sketch_agg(value, LG_K).alias(f"distinct_sketch{i}"),
                 F.kll_sketch_agg_bigint(F.length(value).cast("bigint")).alias(f"length_sketch{i}"),
                 F.call_function("approx_top_k_accumulate", _item(value), F.lit(TRACKED)).alias(f"item_sketch{i}")]
    rows = [F.struct(F.lit(name).alias("column_name"), *[F.col(f"{s}{i}").alias(s) for s in _SKETCHES]) for i, name in enumerate(columns)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def store_profile(df: DataFrame, columns: list[str], root: str, batch: int) -> None:
    """The profile of one batch under ``root``; the same number again replaces it."""
    column_profiles(df, columns).coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch}")


def merged_sketches(profiles: DataFrame) -> DataFrame:
    """Profiles of any number of batches as one row per column."""
    return profiles.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_empty").alias("n_empty"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_bigint("length_sketch").alias("length_sketch"),
        F.call_function("approx_top_k_combine", F.col("item_sketch"), F.lit(TRACKED)).alias("item_sketch"))


def estimates(sketches: DataFrame, n_items: int = 5, quantiles=QUANTILES) -> DataFrame:
    """column_name, n_rows, n_empty, n_distinct, length_quantiles (null without
    values), items (array of item, count: the most frequent ones)."""
    filled = F.kll_sketch_get_n_bigint("length_sketch") > 0
    at = F.array(*[F.kll_sketch_get_quantile_bigint("length_sketch", F.lit(float(q))) for q in quantiles])
    return sketches.select(
        "column_name", "n_rows", "n_empty", F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"),
        F.when(filled, at).alias("length_quantiles"),
        F.call_function("approx_top_k_estimate", F.col("item_sketch"), F.lit(n_items)).alias("items"))


def table_profile(spark: SparkSession, root: str, n_items: int = 5) -> DataFrame:
    """The profile of all batches stored under ``root``, from their sketches alone."""
    return estimates(merged_sketches(spark.read.parquet(root).drop("batch")), n_items)
