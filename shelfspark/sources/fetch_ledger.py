"""Fetching media in rounds, with a ledger of attempts.

A round asks for every address that is due: not fetched yet, fewer than
``max_attempts`` attempts, and its pause over (2**(a - 1) rounds after the a-th failed
attempt).  Of one host at most ``host_budget`` addresses are asked per round, first
those with the fewest attempts; a host's addresses are spread over SPREAD groups of
tasks, so a host with a third of all rows is no hot task.  A round's attempts and
contents are written as one folder and then listed in the ledger; a round that dies
before that has not happened, and running it again asks the same addresses, so every
address gets its due number of attempts.  A round that is listed is not run again.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shelfspark.operators.encode import encode_column

ATTEMPT = "url string, host string, round long, attempt long, ok boolean, content binary"
LISTED = "round long, path string"
SPREAD = 64
MAX_ATTEMPTS = 3


def _rounds(spark: SparkSession, root: str) -> list:
    try:
        return spark.read.schema(LISTED).json(f"{root.rstrip('/')}/rounds").orderBy("round").collect()
    except AnalysisException:
        return []


def attempts(spark: SparkSession, root: str) -> DataFrame:
    """All attempts of the listed rounds (ATTEMPT)."""
    paths = [r.path for r in _rounds(spark, root)]
    return spark.read.schema(ATTEMPT).parquet(*paths) if paths else spark.createDataFrame([], ATTEMPT)


def due(addresses: DataFrame, root: str, round_no: int, url_col: str = "url", max_attempts: int = MAX_ATTEMPTS,
        host_budget: int | None = None) -> DataFrame:
    """(url, host, attempt): the addresses to ask in this round, each once."""
    spark = addresses.sparkSession
    state = attempts(spark, root).groupBy("url").agg(
        F.max("attempt").alias("tried"), F.bool_or("ok").alias("done"), F.max("round").alias("last"))
    rows = (addresses.select(F.col(url_col).alias("url")).where("url is not null").distinct().join(state, "url", "left")
            .withColumn("tried", F.coalesce("tried", F.lit(0)))
            .where(~F.coalesce("done", F.lit(False)) & (F.col("tried") < max_attempts))
            .where((F.col("tried") == 0) | (F.lit(round_no) >= F.col("last") + F.pow(F.lit(2.0), F.col("tried") - 1)))
            .select("url", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"), (F.col("tried") + 1).alias("attempt")))
    if host_budget is not None:
        order = ["attempt", F.xxhash64("url"), "url"]
        group = F.pmod(F.xxhash64("url"), F.lit(SPREAD))
        first = lambda df, key: df.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(
            F.col("nth") <= host_budget).drop("nth")
        rows = first(first(rows.withColumn("group", group), ["host", "group"]).drop("group"), ["host"])
    return rows


def spread(asked: DataFrame) -> DataFrame:
    """A host's addresses over SPREAD groups, groups over tasks (their number is given:
    rows are short and waiting is long, so tasks are not merged by size)."""
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asked.repartition(tasks, F.col("host"), F.pmod(F.xxhash64("url"), F.lit(SPREAD)))


def fetch_round(addresses: DataFrame, root: str, fetcher, round_no: int, url_col: str = "url", max_attempts: int = MAX_ATTEMPTS,
                host_budget: int | None = None, batch_size: int = 16) -> DataFrame:
    """Runs round ``round_no`` (from 1) unless the ledger lists it; returns its
    attempts.  ``fetcher`` is built once per task, as in ``fetch_media``."""
    spark = addresses.sparkSession
    listed = {r.round: r.path for r in _rounds(spark, root)}
    if round_no not in listed:
        path = f"{root.rstrip('/')}/attempts/{uuid.uuid4().hex}"
        (spread(due(addresses, root, round_no, url_col, max_attempts, host_budget)).withColumn("content", encode_column("url", fetcher, batch_size, return_type="binary"))
         .select("url", "host", F.lit(round_no).cast("long").alias("round"), F.col("attempt").cast("long").alias("attempt"),
                 F.col("content").isNotNull().alias("ok"), "content").write.parquet(path))
        (spark.createDataFrame([(round_no, path)], LISTED).coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/rounds"))
        listed[round_no] = path
    return spark.read.schema(ATTEMPT).parquet(listed[round_no])


def fetch_rounds(addresses: DataFrame, root: str, fetcher_of, rounds: int, **options) -> DataFrame:
    """Runs the rounds up to ``rounds`` that are not listed, with ``fetcher_of(round)``
    as the fetcher; returns url, host, n_attempts, ok and content of every address
    asked so far."""
    for n in range(1, rounds + 1):
        fetch_round(addresses, root, fetcher_of(n), n, **options)
    return fetched(addresses.sparkSession, root)


def fetched(spark: SparkSession, root: str) -> DataFrame:
    return attempts(spark, root).groupBy("url", "host").agg(
        F.max("attempt").alias("n_attempts"), F.bool_or("ok").alias("ok"), F.max_by("content", "attempt").alias("content"))


def rounds_needed(max_attempts: int = MAX_ATTEMPTS) -> int:
    """Rounds in which an address that always fails gets all its attempts (without a budget)."""
    return 1 + sum(math.ceil(2 ** (a - 1)) for a in range(1, max_attempts))
