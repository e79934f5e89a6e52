"""Data-quality profiling (A1, A2, A3, A5): single aggregate passes.

Every report is one ``agg`` over the table (partial aggregation map-side, a
tiny final merge), never a per-column loop of jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import is_blank, strip_ws


def quality_counts(df: DataFrame, id_col: str, text_col: str, vec_col: str) -> DataFrame:
    """A1: total rows and rows with a bad id, text or vector (a null vector counts once)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(is_blank(F.col(id_col))).alias("n_bad_id"),
        F.count_if(F.col(text_col).isNull() | (strip_ws(F.col(text_col)) == "")).alias("n_bad_text"),
        F.count_if(F.col(vec_col).isNull() | (F.size(vec_col) == 0)).alias("n_bad_vec"),
    )


def empty_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """A2: per requested column, count of blank cells; absent columns are reported
    with ``present = false`` instead of failing."""
    present = [c for c in cols if c in df.columns]
    aggs = [F.count_if(is_blank(F.col(c).cast("string"))).alias(f"e{i}") for i, c in enumerate(present)]
    aggs.append(F.count(F.lit(1)).alias("__n"))
    one = df.agg(*aggs)
    stack_args = ", ".join(f"'{c}', e{i}" for i, c in enumerate(present))
    if present:
        long = one.selectExpr(f"stack({len(present)}, {stack_args}) AS (column_name, n_empty)", "__n AS n_rows")
    else:
        long = one.selectExpr("CAST(NULL AS string) AS column_name", "CAST(NULL AS bigint) AS n_empty",
                              "__n AS n_rows").where("false")
    long = long.select("column_name", F.col("n_empty").cast("bigint").alias("n_empty"),
                       F.col("n_rows").cast("bigint").alias("n_rows"), F.lit(True).alias("present"))
    missing = [c for c in cols if c not in df.columns]
    if missing:
        spark = df.sparkSession
        miss = spark.createDataFrame([(c,) for c in missing], "column_name string").select(
            "column_name", F.lit(None).cast("bigint").alias("n_empty"),
            F.lit(None).cast("bigint").alias("n_rows"), F.lit(False).alias("present"))
        long = long.unionByName(miss)
    return long


def length_histogram(df: DataFrame, length_expr, n: int = 5) -> DataFrame:
    """A3: the ``n`` most common lengths (count desc, length asc)."""
    lengths = df.select(length_expr.cast("bigint").alias("length")).where(F.col("length").isNotNull())
    return (lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_rows"))
                   .orderBy(F.col("n_rows").desc(), F.col("length").asc()).limit(n))


def duplicate_counts(df: DataFrame, id_col: str, approximate: bool = False) -> DataFrame:
    """A5: rows, distinct ids, and rows whose id repeats an earlier one."""
    distinct = F.approx_count_distinct(id_col) if approximate else F.count_distinct(id_col)
    return (df.agg(F.count(F.lit(1)).alias("n_rows"), distinct.alias("n_unique"))
              .withColumn("n_duplicates", F.col("n_rows") - F.col("n_unique")))


def widest_text_column(df: DataFrame, candidates: list[str]) -> DataFrame:
    """P4 report: mean length of each candidate text column in one pass, widest first."""
    aggs = [F.avg(F.length(F.col(c).cast("string"))).alias(f"m{i}") for i, c in enumerate(candidates)]
    one = df.agg(*aggs)
    stack_args = ", ".join(f"'{c}', m{i}" for i, c in enumerate(candidates))
    return (one.selectExpr(f"stack({len(candidates)}, {stack_args}) AS (column_name, mean_length)")
               .withColumn("mean_length", F.round("mean_length", 6))
               .withColumn("is_widest", F.row_number().over(
                   Window.orderBy(F.col("mean_length").desc(), F.col("column_name"))) == 1))


def pick_text_column(df: DataFrame, candidates: list[str]) -> str:
    """The candidate with the longest mean length."""
    return widest_text_column(df, candidates).where("is_widest").first()["column_name"]
