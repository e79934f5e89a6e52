"""Line deduplication over content-defined chunks, DataFrame functions only.

A hash of every line decides whether a chunk ends after it, on average after every
second one, so boundaries depend on the passage alone: whatever stands around it, its
chunks from the first boundary to the last are the same.  A chunk that occurs more than
once anywhere is a repeat but for its first occurrence (smallest doc_id, then position),
after its bytes were compared.  Repeats that follow each other in a document are one
run, and a run that holds a repeat of two and more lines, not all blank, is removed;
single repeated lines on their own stay.

The bytes are compared by grouping on the chunk text itself, with partial groups
before the shuffle; where two different texts ever shared both 64-bit hashes,
none of them is removed.  Everything else moves as narrow rows of hashes.

Defined results: a null text has one empty line; blank chunks and single lines
are never removed on their own; rows with equal doc_id and text are one document and
all keep what it keeps; a null doc_id orders last; input columns pass through, the
text is replaced.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import join_counted, stored, text_of, whole_row

#: Average lines of a chunk.
DIVISOR = 2
MIN_LINES = 2


def line_hashes(lines: Column) -> Column:
    """Twenty bits of md5 of every line."""
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 5), 16, 10).cast("long"))


def chunks(text: str | Column = "text", divisor: int = DIVISOR) -> Column:
    """The chunks of a text as strings; within a chunk every line has the prefix L.

    Lines hold no line feed and all begin with L, so a double line feed can only
    be a boundary.  All steps take whole arrays as arguments: linear in the text.
    """
    lines = F.split(text_of(text), "\n", -1)
    ends = F.transform(line_hashes(lines), lambda h: h % divisor == 0)
    marked = F.zip_with(lines, ends, lambda x, e: F.concat(F.lit("L"), x, F.when(e, F.lit("\n")).otherwise(F.lit(""))))
    return F.split(F.regexp_replace(F.array_join(marked, "\n"), F.lit(r"\n\z"), F.lit("")), "\n\n", -1)


def _row_key(doc_id: str, text: str) -> Column:
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.hex(F.xxhash64(text_of(text))))


def _n_lines(body: Column) -> Column:
    return F.size(F.split(body, "\n", -1))


def repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, divisor: int = DIVISOR,
                    min_lines: int = MIN_LINES) -> DataFrame:
    """One row per chunk: key, doc_id, pos, n_lines, removed."""
    rows = (docs.select(_row_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"),
                        F.posexplode(chunks(text, divisor)).alias("pos", "body"))
            .withColumn("n_lines", _n_lines(F.col("body")))
            .withColumn("h1", F.xxhash64("body")).withColumn("h2", F.xxhash64(F.lit(1), F.col("body")))
            .withColumn("multi", (F.col("n_lines") >= min_lines) & F.col("body").rlike(r"L[^\n]*[^\x20\x09-\x0D]")))
    narrow = stored(rows.drop("body").distinct(), "line-chunks")
    # Byte comparison: one group per chunk text, then how many texts share the hashes.
    same = (rows.groupBy("h1", "h2", "body").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
            .filter("texts = 1 and n > 1").select("h1", "h2"))
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("key").alias("c"), F.col("pos").alias("d"))
    groups = (narrow.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1").join(same, ["h1", "h2"])
              .select("h1", "h2", "n", F.col("first.c").alias("first_key"), F.col("first.d").alias("first_pos")))
    groups = stored(groups, "line-groups")
    repeats = (join_counted(narrow, groups, ["h1", "h2"], "n", narrow.count())
               .filter("not (key = first_key and pos = first_pos)").select("key", "pos", "multi"))
    # Repeats at neighbouring positions differ as their row numbers do.
    nth = F.row_number().over(Window.partitionBy("key").orderBy("pos"))
    runs = repeats.withColumn("run", F.col("pos") - nth)
    held = F.max("multi").over(Window.partitionBy("key", "run"))
    removed = runs.withColumn("gone", held).filter("gone").select("key", "pos", "gone")
    return (narrow.select("key", "doc_id", "pos", "n_lines").join(removed, ["key", "pos"], "left")
            .select("key", "doc_id", "pos", "n_lines", F.coalesce("gone", F.lit(False)).alias("removed")))


def _marked(docs: DataFrame, doc_id: str, text: str, divisor: int, min_lines: int) -> DataFrame:
    """row (the input's columns), body (the text that is left), n_lines, n_removed."""
    marks = repeated_chunks(docs, doc_id, text, divisor=divisor, min_lines=min_lines)
    flags = (marks.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("pos", "removed"))).alias("flags"),
        F.sum(F.when(F.col("removed"), F.col("n_lines")).otherwise(0)).alias("n_removed"))
        .filter("n_removed > 0").withColumn("flags", F.col("flags.removed")))
    rows = docs.select(_row_key(doc_id, text).alias("key"), whole_row(docs)).join(flags, "key", "left")
    old = F.col("row")[text]
    left = F.filter(F.zip_with(chunks(old, divisor), F.col("flags"), lambda c, gone: F.when(~gone, c)), lambda c: c.isNotNull())
    rebuilt = F.regexp_replace(F.array_join(left, "\n"), F.lit(r"(^|\n)L"), F.lit("$1"))
    return rows.select("row", F.when(F.col("flags").isNull(), old).otherwise(rebuilt).alias("body"),
                       F.size(F.split(text_of(old), "\n", -1)).cast("long").alias("n_lines"),
                       F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, divisor: int = DIVISOR,
           min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), kept_sha256 (of the text that is left)."""
    out = _marked(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", divisor, min_lines)
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(text_of("body").cast("binary"), 256).alias("kept_sha256"))


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, divisor: int = DIVISOR,
            min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with the repeated chunks cut out of the text; documents of which no
    line is left are gone."""
    out = _marked(docs, doc_id, text, divisor, min_lines).filter("n_removed < n_lines")
    return out.select(*[F.col("body").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
