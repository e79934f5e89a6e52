"""Structured Streaming forms of the incremental operators.

R1  Incremental collection upsert: a file stream of new catalog rows is
    cleaned and encoded per micro-batch and added to the collection with
    ``foreachBatch``.  The stored batch number follows from the micro-batch id
    alone, so a batch replayed after a restart replaces itself.
R2  Sessions over an event stream: ``session_window`` with a watermark; the
    batch form (``session_counts``) is the same plan on a static DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_GAP = "10 minutes"


def session_counts(events: DataFrame, gap: str = DEFAULT_GAP, user: str = "user_id", ts: str = "ts",
                   watermark: str | None = None) -> DataFrame:
    """R2: one row per (user, session): start, end (= last event + gap), event count."""
    # Event time must be TIMESTAMP for watermarks; NTZ input is read as session-zone time.
    src = events.withColumn(ts, F.col(ts).cast("timestamp"))
    src = src.withWatermark(ts, watermark) if watermark else src
    s = (src.groupBy(F.col(user), F.session_window(F.col(ts), gap).alias("session"))
            .agg(F.count(F.lit(1)).alias("n_events")))
    return s.select(user,
                    F.col("session.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("session.end").cast("timestamp_ntz").alias("session_end"),
                    "n_events")


def sessions_batch(events: DataFrame, gap: str = DEFAULT_GAP, user: str = "user_id", ts: str = "ts",
                   tiebreak: str = "event_id", chunk: int | None = None) -> DataFrame:
    """R2 in batch, skew-safe: same result as ``session_counts`` without putting a
    user's whole history in one task.

    Events get dense positions in (user, ts, tiebreak) order (a range exchange,
    which also splits a hot user), the previous event's time comes from the
    chunked ``neighbour`` and session numbers from the chunked ``running_sum``;
    sessions are then plain (user, session) aggregates with partial aggregation.
    """
    from shelfspark.operators.identity import DEFAULT_CHUNK, dense_id, running_sum
    from shelfspark.operators.sequence import neighbour

    chunk = chunk or DEFAULT_CHUNK
    ev = events.select(user, F.col(ts).cast("timestamp").alias(ts), tiebreak)
    pos = dense_id(ev, [user, ts, tiebreak], out="__pos")
    prev = neighbour(pos, user, "__pos", [ts], "prev", "__prev_", chunk=chunk)
    gap_expr = F.expr(f"INTERVAL {gap}")
    flagged = prev.withColumn("__new", (F.col(f"__prev_{ts}").isNull() |
                                        (F.col(ts) > F.col(f"__prev_{ts}") + gap_expr)).cast("int"))
    numbered = running_sum(flagged, user, "__pos", F.col("__new"), "__sid", chunk=chunk)
    return (numbered.groupBy(user, "__sid")
                    .agg(F.min(ts).alias("__start"), F.max(ts).alias("__last"), F.count(F.lit(1)).alias("n_events"))
                    .select(user, F.col("__start").cast("timestamp_ntz").alias("session_start"),
                            (F.col("__last") + gap_expr).cast("timestamp_ntz").alias("session_end"), "n_events"))


def stream_sessions(spark, path: str, schema, checkpoint: str, gap: str = DEFAULT_GAP,
                    watermark: str = "30 minutes", sink=None, query_name: str = "sessions",
                    glob: str | None = None):
    """R2 streaming: parquet file stream -> watermarked session windows -> sink.

    ``sink(df, batch_id)`` receives each micro-batch of closed sessions
    (append mode: a session is emitted once the watermark passes its end).
    """
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    events = reader.parquet(path)
    sessions = session_counts(events, gap, watermark=watermark)
    writer = sessions.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if sink is not None:
        writer = writer.foreachBatch(sink)
    else:
        writer = writer.format("memory").queryName(query_name)
    return writer.start()


def stream_upserts(spark, path: str, schema, root: str, name: str, checkpoint: str, prepare, order_by,
                   id_col: str = "id"):
    """File stream -> ``prepare(df)`` (clean + encode) -> upsert per micro-batch.

    ``order_by`` decides which of several rows with one id in a micro-batch stays.
    One stream writes a collection between two full builds: its batch numbers are
    its micro-batch ids plus one.
    """
    from shelfspark.sources import collections as CO

    def merge(batch: DataFrame, batch_id: int):
        CO.upsert(prepare(batch), root, name, order_by, id_col=id_col, batch=batch_id + 1)

    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return (src.writeStream.foreachBatch(merge)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
