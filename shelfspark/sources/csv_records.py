"""CSV records of large files, read by many tasks though fields hold line breaks.

Spark's CSV reader gives a whole file to one task when fields may hold line
breaks: where a record starts depends on every quote before it.  Here the file is
read as physical lines by byte range, as any text file.  What a line does to the
reader is one of four functions on {between records, inside a quoted field}: nothing,
swap, or one of the two constants; functions compose, so

1. every byte range composes the functions of its lines into one (a row per range),
2. a prefix composition over the ranges of a file, in order, tells in which state
   each range begins, and
3. every range cuts its lines at the line breaks that lie between records.  What it
   has of a record that began earlier or ends later are pieces, at most two per
   range, which are put together by the range the record began in.

Only the pieces are shuffled.  A line that a range ends in belongs to the range it
starts in (Spark's text reader), so quotes across range edges are met in their line.

What opens and closes a quoted field follows Spark's reader: a quote at the start of
a field opens it; a quote that is followed by the delimiter, or by blanks and the
delimiter or line end, closes it; a doubled (or escaped) quote and any other quote
inside are text, as is a quote inside an unquoted field.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Functions of a line on the state, and of the states themselves: 1 is inside a quoted field.
SAME, SWAP, OUT, IN = 0, 1, 2, 3
#: A record: its file, the byte range it starts in, its place there, its text.
RECORD = "file string, start long, seq long, record string"


def inside_after(line: str, inside: bool, quote: str = '"', escape: str = '"', delimiter: str = ",") -> bool:
    """Whether the end of ``line`` lies inside a quoted field, for either begin."""
    at, size = 0, len(line)
    while True:
        if not inside:
            if line.startswith(quote, at):
                inside, at = True, at + 1
                continue
            at = line.find(delimiter, at)
            if at < 0:
                return False
            at += 1
            continue
        end = line.find(quote, at)
        if escape != quote:
            mark = line.find(escape, at, end if end >= 0 else size)
            if mark >= 0:
                at = mark + 2
                continue
        if end < 0:
            return True
        at = end + 1
        if escape == quote and line.startswith(quote, at):
            at += 1
            continue
        after = at
        while after < size and line[after] <= " " and line[after] != delimiter:
            after += 1
        if after == size:
            return False
        if line[after] == delimiter:
            inside, at = False, after + 1


def line_functions(lines: pa.Array, quote: str, escape: str, delimiter: str) -> np.ndarray:
    """What each line does to the state; only lines with a quote are looked at one
    by one (inside a field and without a quote, a line changes nothing)."""
    out = np.full(len(lines), SAME, np.int8)
    if not quote:
        return out
    for i in np.flatnonzero(pc.match_substring(lines, quote).to_numpy(zero_copy_only=False)).tolist():
        line = lines[i].as_py()
        line = line[:-1] if line.endswith("\r") else line
        a, b = (inside_after(line, s, quote, escape, delimiter) for s in (False, True))
        out[i] = SAME if (a, b) == (False, True) else SWAP if (a, b) == (True, False) else IN if a else OUT
    return out


def composed(functions: np.ndarray) -> int:
    """The functions one after the other, as one."""
    fixed = np.flatnonzero(functions >= OUT)
    swaps = int((functions[fixed[-1] + 1 if fixed.size else 0:] == SWAP).sum()) % 2
    if not fixed.size:
        return swaps
    return OUT + ((int(functions[fixed[-1]]) - OUT) ^ swaps)


def states(functions: np.ndarray, state: int) -> np.ndarray:
    """The state after each line, from the state before the first."""
    at = np.arange(functions.size)
    last = np.maximum.accumulate(np.where(functions >= OUT, at, -1))
    swaps = np.cumsum(functions == SWAP)
    base = np.where(last >= 0, functions[last] - OUT, state)
    since = swaps - np.where(last >= 0, swaps[last], 0)
    return (base ^ (since & 1)).astype(np.int8)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Stretches of a batch that come from one byte range."""
    files, starts = batch.column("file"), batch.column("start").to_numpy()
    new = np.r_[True, (starts[1:] != starts[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)]
    cut = np.r_[np.flatnonzero(new), len(starts)]
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield files[a].as_py(), int(starts[a]), batch.slice(a, b - a)


def _range_functions(quote: str, escape: str, delimiter: str):
    def run(batches):
        key, parts = None, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()),
                                               pa.array([composed(np.array(parts, np.int8))], pa.int32())], names=["file", "start", "does"])
        for b in batches:
            if not b.num_rows:
                continue
            for file, start, lines in _runs(b):
                if key is not None and key != (file, start):
                    yield row()
                    parts = []
                key = file, start
                parts.append(composed(line_functions(lines.column("value"), quote, escape, delimiter)))
        if key is not None:
            yield row()
    return run


_PIECE = RECORD + ", first boolean, last boolean"


class _Range:
    """The lines of one byte range on their way to records."""

    def __init__(self, file: str, start: int, state: int):
        self.file, self.start, self.state, self.seq = file, start, state, 0
        #: Lines of the record that is open, and whether it began in this range.
        self.open: list[str] = []
        self.began = state == 0

    def batch(self, rows: list[tuple[str, bool, bool]]) -> pa.RecordBatch:
        n = len(rows)
        at = np.arange(self.seq, self.seq + n)
        self.seq += n
        text, first, last = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.file] * n), pa.array([self.start] * n, pa.int64()), pa.array(at, pa.int64()), pa.array(text, pa.string()),
             pa.array(first, pa.bool_()), pa.array(last, pa.bool_())], names=["file", "start", "seq", "record", "first", "last"])

    def add(self, lines: list[str], after: np.ndarray) -> list[tuple[str, bool, bool]]:
        rows = []
        for line, s in zip(lines, after.tolist()):
            if s:
                self.open.append(line)
            else:
                text = "\n".join([*self.open, line]) if self.open else line
                text = text[:-1] if text.endswith("\r") else text
                if text or not self.began:
                    rows.append((text, self.began, True))
                self.open, self.began = [], True
        return rows

    def rest(self) -> list[tuple[str, bool, bool]]:
        return [("\n".join(self.open), self.began, False)] if self.open else []


def _cut(quote: str, escape: str, delimiter: str):
    def run(batches):
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            for file, start, lines in _runs(b):
                if now is None or (now.file, now.start) != (file, start):
                    if now is not None and (rows := now.rest()):
                        yield now.batch(rows)
                    now = _Range(file, start, int(lines.column("state")[0].as_py()))
                after = states(line_functions(lines.column("value"), quote, escape, delimiter), now.state)
                now.state = int(after[-1])
                if rows := now.add(lines.column("value").to_pylist(), after):
                    yield now.batch(rows)
        if now is not None and (rows := now.rest()):
            yield now.batch(rows)
    return run


def read_records(spark: SparkSession, path: str, quote: str = '"', escape: str = '"', delimiter: str = ",") -> DataFrame:
    """The records of all CSV files under ``path`` (RECORD), headers included, empty
    ones not.  (file, start, seq) orders the records of a file as they stand there;
    the first record of a file has start 0 and seq 0.

    Every byte range is read twice; no task holds more than its range's batch and
    one record.  The states of the ranges (one short row per range, that is per 128
    MB at Spark's default) are broadcast.
    """
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"))
    if not quote:
        # Nothing is quoted: a line is a record.
        return (lines.withColumn("state", F.lit(0)).mapInArrow(_cut("", "", delimiter), _PIECE)
                .select("file", "start", "seq", "record"))
    does = lines.mapInArrow(_range_functions(quote, escape, delimiter), "file string, start long, does int")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # The last constant before a range, and the swaps since.
    fixed = F.max(F.when(F.col("does") >= OUT, F.struct("start", (F.col("does") - OUT).alias("state"), "swaps"))).over(before)
    known = (does.withColumn("swaps", F.coalesce(F.sum((F.col("does") == SWAP).cast("int")).over(before), F.lit(0)))
             .withColumn("fixed", fixed)
             .select("file", "start", ((F.coalesce("fixed.state", F.lit(0)) + F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0))) % 2)
                     .cast("int").alias("state")))
    pieces = (lines.join(F.broadcast(known), ["file", "start"]).select("file", "start", "value", "state")
              .mapInArrow(_cut(quote, escape, delimiter), _PIECE))
    return _whole(pieces)


def _whole(pieces: DataFrame) -> DataFrame:
    """Records within one range, and those put together from pieces."""
    split = pieces.filter("not (first and last)")
    # A record's pieces in order: the one that opens it (first, not last), ranges
    # wholly inside (neither), the one that closes it (last, not first).
    begun = F.sum(F.col("first").cast("int")).over(Window.partitionBy("file").orderBy("start", "seq"))
    joined = (split.withColumn("nth", begun).groupBy("file", "nth")
              .agg(F.array_sort(F.collect_list(F.struct("start", "seq", "record"))).alias("p"))
              .select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["seq"].alias("seq"),
                      F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))
    return pieces.filter("first and last").select("file", "start", "seq", "record").unionByName(joined)
