"""Table functions for SQL (C3, F5): Arrow batches in, Arrow tables out.

    register(spark)
    SELECT * FROM turn_pairs(TABLE(SELECT conv_id, turn, role, text FROM log)
                             PARTITION BY conv_id ORDER BY turn)
    SELECT * FROM sentences(TABLE(SELECT doc_id, text FROM documents) PARTITION BY doc_id)

A group is read as a stream of batches in its order; ``turn_pairs`` keeps one open
turn between batches, so a conversation may be of any length, and ``sentences`` the
distinct sentences of one document.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.text import _SENTENCE_RE, _TRIM_RE
from shelfspark.operators.chat import ASSISTANT_ROLE, USER_ROLE

_PAIR = {"conv_id": pa.int64(), "turn": pa.int64(), "question": pa.string(), "reply": pa.string()}
_SENTENCE = {"doc_id": pa.int64(), "pos": pa.int64(), "sentence": pa.string()}


def _table(rows: list[tuple], columns: dict) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * len(columns)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(columns.items(), cols)})


@F.arrow_udtf(returnType="conv_id long, turn long, question string, reply string")
class TurnPairs:
    """Every user turn with the next turn's text if that is the assistant's."""

    def __init__(self):
        self.open = None

    def eval(self, batch: pa.RecordBatch):
        rows = []
        for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
            if self.open is not None:
                rows.append((*self.open, text if role == ASSISTANT_ROLE else None))
                self.open = None
            if role == USER_ROLE:
                self.open = (conv, turn, text)
        yield _table(rows, _PAIR)

    def terminate(self):
        if self.open is not None:
            yield _table([(*self.open, None)], _PAIR)


@F.arrow_udtf(returnType="doc_id long, pos long, sentence string")
class Sentences:
    """F5 row by row: the distinct stripped sentences and clauses of a document (all
    its rows together), in the order they first occur, from position 1."""

    def __init__(self):
        self.split, self.trim, self.seen = re.compile(_SENTENCE_RE), re.compile(_TRIM_RE), {}

    def eval(self, batch: pa.RecordBatch):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            for piece in self.split.split(text or ""):
                piece = self.trim.sub("", piece)
                if piece and piece not in self.seen:
                    self.seen[piece] = len(self.seen) + 1
                    rows.append((doc, self.seen[piece], piece))
        yield _table(rows, _SENTENCE)


def register(spark: SparkSession) -> None:
    spark.udtf.register("turn_pairs", TurnPairs)
    spark.udtf.register("sentences", Sentences)
