"""Model results by the content of their inputs.

A store holds (key, result) for one model: the key is SHA-256 of the input.  To answer
a table, its distinct inputs are reduced to one row per key, anti-joined with what the
store has, and only the rest goes to the model; equal inputs go once.  What the model
gives is added as a segment, a table bucketed and sorted by key, so the store's side of
later joins does not move; from MAX_SEGMENTS segments on they are merged into one.  An
input without a result (the model gave null) is not stored and will be asked again.

Segments are listed under ``root/segments`` once they are complete, so a run that dies
adds nothing, and a store opens again in another session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shelfspark.operators.encode import encode_column
from shelfspark.operators.identity import _stored as stored

LISTED = "name string, buckets int, number int, generation int, result string"
MAX_SEGMENTS = 8


def content_key(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unhex(F.sha2(c.cast("binary"), 256))


class ResultStore:
    """The results of the model ``model_id`` under ``root`` (a folder all executors
    share).  ``result_type`` is the model's output as a DDL type."""

    def __init__(self, spark: SparkSession, root: str, model_id: str, result_type: str, buckets: int = 200):
        self.spark, self.result_type = spark, result_type
        self.root = f"{root.rstrip('/')}/model={model_id}"
        try:
            rows = spark.read.schema(LISTED).json(f"{self.root}/segments").orderBy("number").collect()
        except AnalysisException:
            rows = []
        self.generation = max((r.generation for r in rows), default=0)
        rows = [r for r in rows if r.generation == self.generation]
        if rows and rows[0].result != result_type:
            raise ValueError(f"the store holds {rows[0].result}, not {result_type}")
        self.buckets, self.segments = rows[0].buckets if rows else buckets, [r.name for r in rows]
        for r in rows:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {r.name} (key BINARY, result {result_type}) USING parquet CLUSTERED BY (key) "
                      f"SORTED BY (key) INTO {r.buckets} BUCKETS LOCATION '{self.root}/{r.name}'")

    def _add(self, rows: DataFrame, number: int, generation: int) -> str:
        name = f"model_results_{uuid.uuid4().hex[:12]}"
        (rows.select("key", "result").repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key")
         .option("path", f"{self.root}/{name}").format("parquet").saveAsTable(name))
        (self.spark.createDataFrame([(name, self.buckets, number, generation, self.result_type)], LISTED)
         .coalesce(1).write.mode("append").json(f"{self.root}/segments"))
        return name

    def results(self) -> DataFrame:
        """(key, result) of all stored results; a key is in one segment."""
        out = self.spark.createDataFrame([], f"key binary, result {self.result_type}")
        for name in self.segments:
            out = out.unionByName(self.spark.table(name))
        return out

    def compact(self) -> None:
        merged = self._add(self.results(), 0, self.generation + 1)
        self.segments, self.generation = [merged], self.generation + 1

    def ensure(self, inputs: DataFrame, col: str, fn_factory, batch_size: int = 32) -> None:
        """Ask the model for the inputs in ``col`` that the store has no result of."""
        asked = (inputs.where(F.col(col).isNotNull()).select(content_key(col).alias("key"), F.col(col).alias("input"))
                 .groupBy("key").agg(F.first("input").alias("input")))
        if len(self.segments) >= MAX_SEGMENTS:
            self.compact()
        for name in self.segments:
            asked = asked.join(self.spark.table(name).select("key"), "key", "left_anti")
        if asked.isEmpty():
            return
        # Written before the test for null: in one plan the filter would run the model again.
        answered = stored(asked.select("key", encode_column("input", fn_factory, batch_size, self.result_type).alias("result")), "model-results")
        self.segments.append(self._add(answered.where("result is not null"), len(self.segments), self.generation))

    def encode(self, df: DataFrame, col: str, fn_factory, out: str = "vec", batch_size: int = 32) -> DataFrame:
        """``df`` with the model's result of ``col`` in ``out``; nulls have none."""
        self.ensure(df, col, fn_factory, batch_size)
        known = self.results().select(F.col("key").alias("__key"), F.col("result").alias(out))
        return df.withColumn("__key", content_key(col)).join(known, "__key", "left").drop("__key")
