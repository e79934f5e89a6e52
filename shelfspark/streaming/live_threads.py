"""Threads of conversations that are still going on (C1, R2), with state per conversation.

Turns arrive in any order.  Per conversation the state holds every kept turn with its
role, its thread and its flag, and whether the conversation is closed.  A batch's turns
are put in and the threads are numbered again from the earliest new turn on; every row
whose number or flag is new or has changed is emitted with a version, so the last
version of a turn is what the batch form (``chat.threads``) gives for all turns so far.
With a timeout, a timer closes a conversation that has been silent for ``timeout_ms`` of
processing time (a row of its own); a late turn opens it again and corrects what it
changes.  Spark goes on running batches for timers, so such a stream ends only when it
is stopped; without a timeout it can also run over what is there and end.

State is one short row per turn, without texts; a task holds the turns of one
conversation while it numbers them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfspark.functions.text import strip_ws
from shelfspark.operators.chat import ASSISTANT_ROLE, USER_ROLE

OUTPUT = "conv_id long, turn long, role string, is_reset boolean, thread long, status string, version long"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ThreadProcessor(StatefulProcessor):
    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn long", "role string, is_reset boolean, thread long")
        #: Version of what was emitted last, and whether the conversation is open.
        self.status = handle.getValueState("status", "version long, is_open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: tuple(v) for k, v in self.turns.iterator()}
        new = {int(t): r for pdf in rows for t, r in zip(pdf["turn"].tolist(), pdf["role"].tolist())}
        version = (self.status.get()[0] if self.status.exists() else 0) + 1
        roles = {t: known[t][0] for t in known} | new
        order, out = sorted(roles), []
        first = min(new)
        thread, previous = 0, None
        for turn in order:
            role = roles[turn]
            if turn < first and turn in known:
                _, reset, thread = known[turn]
            else:
                reset = role == USER_ROLE and (previous is None or previous == ASSISTANT_ROLE)
                thread += int(reset)
                if known.get(turn) != (role, reset, thread):
                    self.turns.updateValue((turn,), (role, reset, thread))
                    out.append((key[0], turn, role, reset, thread, "turn", version))
            previous = role
        self.status.update((version, True))
        if self.timeout_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.status.exists() and self.status.get()[1]:
            version = self.status.get()[0] + 1
            self.status.update((version, False))
            yield pd.DataFrame([(key[0], None, None, None, None, "closed", version)], columns=_COLUMNS)

    def close(self) -> None:
        pass


def live_threads(turns: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """A stream of (conv_id, turn, role, text) -> rows of OUTPUT: a turn's thread
    whenever it is new or has changed, and ``closed`` rows (without a turn).  Blank
    turns are dropped, as in the batch form; a turn number that comes again replaces
    the turn.  The query has to be started with the state store STATE_STORE."""
    kept = turns.where(F.col("text").isNotNull() & (strip_ws(F.col("text")) != "")).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role")
    return kept.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=ThreadProcessor(timeout_ms), outputStructType=OUTPUT, outputMode="Update",
        timeMode="None" if timeout_ms is None else "ProcessingTime")


def current_threads(emitted: DataFrame) -> DataFrame:
    """The last version of every turn of an emitted table: conv_id, turn, role,
    is_reset, thread."""
    last = Window.partitionBy("conv_id", "turn").orderBy(F.desc("version"))
    return (emitted.where("status = 'turn'").withColumn("nth", F.row_number().over(last)).where("nth = 1")
            .select("conv_id", "turn", "role", "is_reset", "thread"))


def closed_conversations(emitted: DataFrame) -> DataFrame:
    """(conv_id, is_closed) by the last version of every conversation."""
    return (emitted.groupBy("conv_id").agg(F.max_by("status", "version").alias("s"))
            .select("conv_id", (F.col("s") == "closed").alias("is_closed")))


def stream_threads(turns: DataFrame, sink: str, checkpoint: str, timeout_ms: int | None = None):
    """Runs ``live_threads`` into Parquet under ``sink``, a folder per micro-batch, so
    a batch that runs again after a restart replaces itself.  Without a timeout the
    query ends when all that is there has been read."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/micro_batch={batch}")

    writer = (live_threads(turns, timeout_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
              .foreachBatch(write))
    # The query keeps the store it is started with; the session's other streams keep theirs.
    spark, key = turns.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    try:
        return (writer.trigger(availableNow=True) if timeout_ms is None else writer).start()
    finally:
        spark.conf.set(key, before)
