"""Chat-log operators (C1-C3, W4) over ``(conv_id, turn, role, text)`` tables.

Conversations can be long and one can dominate the log, so ordered steps use
the chunked helpers (``running_sum``, ``neighbour``) instead of a window over a
whole conversation, and transcripts are assembled in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import strip_ws
from shelfspark.operators.identity import running_sum
from shelfspark.operators.sequence import neighbour

# Roles and transcript labels.
USER_ROLE = "user"
ASSISTANT_ROLE = "assistant"
USER_LABEL = "**You:**"
ASSISTANT_LABEL = "**Assistant:**"

#: Turns of one conversation that one task holds, with their texts.
TURN_CHUNK = 4096


def _non_blank(text: str) -> Column:
    return F.col(text).isNotNull() & (strip_ws(F.col(text)) != "")


def default_reset(prev_role: str = "prev_role") -> Column:
    """A user turn that follows an assistant turn (or opens the log) starts a thread."""
    return (F.col("role") == USER_ROLE) & (F.col(prev_role).isNull() | (F.col(prev_role) == ASSISTANT_ROLE))


def threads(log: DataFrame, is_reset: Column | None = None, conv: str = "conv_id", turn: str = "turn",
            text: str = "text", chunk: int = TURN_CHUNK) -> DataFrame:
    """Drop blank turns, then number threads by a running count of resets."""
    kept = log.where(_non_blank(text))
    with_prev = neighbour(kept, conv, turn, ["role"], "prev", "prev_", chunk=chunk)
    reset = is_reset if is_reset is not None else default_reset("prev_role")
    flagged = with_prev.withColumn("is_reset", reset)
    numbered = running_sum(flagged, conv, turn, F.col("is_reset").cast("int"), "thread", chunk=chunk)
    return numbered.drop("prev_role")


def transcript(log: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text",
               chunk: int = TURN_CHUNK) -> DataFrame:
    """One transcript string per conversation, labelled by role, blank turns skipped.

    Lines are first joined per (conversation, chunk of turns), then the chunk
    strings per conversation, so no task sorts a whole conversation's turns.  The
    transcript itself is one value; ``transcript_chunks`` is the form for
    conversations that are too long for that.
    """
    partial = transcript_chunks(log, conv, turn, text, chunk)
    return (partial.groupBy(conv)
                   .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))),
                                                 lambda x: x["part"]), "\n").alias("transcript"),
                        F.sum("n").cast("bigint").alias("n_lines")))


def transcript_chunks(log: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text",
                      chunk: int = TURN_CHUNK) -> DataFrame:
    """C2 in pieces: (conversation, chunk, part, n), the lines of ``chunk`` turns each."""
    label = F.when(F.col("role") == USER_ROLE, F.lit(USER_LABEL)).otherwise(F.lit(ASSISTANT_LABEL))
    lines = (log.where(_non_blank(text))
                .select(conv, turn, F.concat(label, F.lit(" "), F.col(text)).alias("line"),
                        F.floor(F.col(turn) / F.lit(chunk)).alias("chunk")))
    return (lines.groupBy(conv, "chunk")
                    .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, "line"))),
                                                  lambda x: x["line"]), "\n").alias("part"),
                         F.count(F.lit(1)).alias("n")))


def turn_pairs(log: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text",
               chunk: int = TURN_CHUNK) -> DataFrame:
    """Each user turn with the following turn's text when that turn is the assistant's."""
    nxt = neighbour(log, conv, turn, ["role", text], "next", "next_", chunk=chunk)
    return (nxt.where(F.col("role") == USER_ROLE)
               .select(conv, turn, F.col(text).alias("question"),
                       F.when(F.col("next_role") == ASSISTANT_ROLE, F.col(f"next_{text}")).alias("reply")))
