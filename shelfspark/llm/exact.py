"""Exact deduplication against a persistent digest index, DataFrame functions only.

The index is a list of segments, each a table of distinct digests bucketed and
sorted by digest.  A new batch is reduced to one row per digest (pre-aggregated
before the shuffle, so a text that makes up a third of the batch is no hot key),
anti-joined with every segment by sort-merge join (the segments do not move) and
what is new is appended as a further segment.  From MAX_SEGMENTS segments on they
are merged into one first, so a batch meets a bounded number of them.

``report`` ingests a table in batches by ranges of doc_id, in ascending order, so
that all but the first are looked up in what came before.

Texts are equal when identical after every run of separators became one space;
the digest is SHA-256 of that text in UTF-8.

Defined results: a null text counts as empty; among equal texts of one batch the
smallest doc_id stays (a null doc_id only if there is no other), the rest go;
a text that an earlier batch brought in belongs to that batch's row; repeated
rows with one doc_id are one group, each kept if that id is kept.  Empty batches
append an empty segment.  Extra columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import SPACES, join_counted, scratch_path, shuffle_partitions, stored, text_of


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(text_of(text), F.lit(SPACES), F.lit(" "))


def digest(text: str | Column = "text") -> Column:
    """SHA-256 of the normalised text, lowercase hex."""
    return F.sha2(normalised(text).cast("binary"), 256)


#: Columns of a segment.
SEGMENT = "digest BINARY, keep_id BIGINT, group_size BIGINT"
LISTED = "name string, buckets int, number int, generation int"
MAX_SEGMENTS = 8
#: Batches that ``report`` ingests a table in.
BATCHES = 4


class DigestIndex:
    """Digests seen so far, with the row that brought each in.

    ``root`` is a folder all executors share: segment tables are external tables
    under it, and ``root/segments`` lists them, so that ``open_index`` finds an
    index again in another session.  ``buckets`` stays the same over its life.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int, segments: list[str] | None = None, generation: int = 0):
        self.spark, self.root, self.buckets, self.generation = spark, root, buckets, generation
        self.segments = list(segments or [])

    def _segment(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def _write(self, rows: DataFrame, number: int, generation: int) -> str:
        name = f"digest_segment_{uuid.uuid4().hex[:12]}"
        (rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", f"{self.root}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name))
        # Listed once its data is complete.
        (self.spark.createDataFrame([(name, self.buckets, number, generation)], LISTED)
            .coalesce(1).write.mode("append").json(f"{self.root}/segments"))
        return name

    def append(self, groups: DataFrame) -> DataFrame:
        """Anti-join ``groups`` (digest, keep_id, group_size) with the index and
        append what is new; returns the appended segment."""
        if len(self.segments) >= MAX_SEGMENTS:
            self.compact()
        new = groups.select("digest", F.col("keep_id").cast("long").alias("keep_id"), "group_size")
        for name in self.segments:
            new = new.join(self._segment(name).select("digest").hint("merge"), "digest", "left_anti")
        name = self._write(new, len(self.segments), self.generation)
        self.segments.append(name)
        return self._segment(name)

    def compact(self) -> None:
        """All segments as one.  The list names it as a new generation, so an index
        opened meanwhile sees either all of the old segments or the merged one."""
        merged = self._write(self.lookup(), 0, self.generation + 1)
        self.segments, self.generation = [merged], self.generation + 1

    def lookup(self) -> DataFrame:
        """All digests of the index (each is in exactly one segment)."""
        out = self._segment(self.segments[0])
        for name in self.segments[1:]:
            out = out.unionByName(self._segment(name))
        return out


def open_index(spark: SparkSession, root: str) -> DigestIndex:
    """The index under ``root``, its segments registered in this session if they
    are not (one short row per segment is read)."""
    rows = spark.read.schema(LISTED).json(f"{root}/segments").orderBy("number").collect()
    generation = max(r.generation or 0 for r in rows)
    rows = [r for r in rows if (r.generation or 0) == generation]
    for r in rows:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {r.name} ({SEGMENT}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                  f"INTO {r.buckets} BUCKETS LOCATION '{root}/{r.name}'")
    return DigestIndex(spark, root, rows[0].buckets, [r.name for r in rows], generation)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.unhex(digest(text)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: the smallest doc_id and the number of rows."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def deduplicate(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ingest one batch.  One row per row of ``docs``: doc_id, keep_id (the row
    that stays, from this or an earlier batch), group_size (rows of this batch
    with that text), kept, text_sha256."""
    rows = stored(digests(docs, doc_id, text), "digests")
    groups = grouped(rows)
    earlier = list(index.segments)
    added = index.append(groups).select("digest", "keep_id", "group_size")
    if earlier:
        old = DigestIndex(index.spark, index.root, index.buckets, earlier).lookup()
        known = groups.select("digest", "group_size").join(old.select("digest", "keep_id"), "digest")
        added = added.withColumn("new", F.lit(True)).unionByName(
            known.select("digest", "keep_id", "group_size").withColumn("new", F.lit(False)))
    else:
        added = added.withColumn("new", F.lit(True))
    return join_counted(rows, added, ["digest"], "group_size", rows.count()).select(
        "doc_id", "keep_id", "group_size",
        (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def new_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index under the shared folder."""
    return DigestIndex(spark, scratch_path(spark, "digest-index"), buckets or shuffle_partitions(spark))


def deduplicate_in_batches(docs: DataFrame, index: DigestIndex, batches: int = BATCHES, doc_id: str = "doc_id",
                           text: str = "text") -> DataFrame:
    """Ingest a table in ``batches`` ranges of doc_id, ascending (null ids with the
    last).  One row per row of ``docs`` as in ``deduplicate``, group_size counting the
    rows of all batches."""
    rows = stored(digests(docs, doc_id, text), "digests")
    bounds = rows.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    for low, high in zip([None, *bounds], [*bounds, None]):
        mine = F.lit(True) if low is None else F.col("doc_id") > low
        mine = mine & (F.col("doc_id") <= high) if high is not None else mine | F.col("doc_id").isNull()
        index.append(grouped(rows.filter(mine)))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    owners = stored(index.lookup().select("digest", "keep_id").join(sizes, "digest"), "digest-owners")
    return join_counted(rows, owners, ["digest"], "group_size", rows.count()).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def report(docs: DataFrame) -> DataFrame:
    return deduplicate_in_batches(docs, new_index(docs.sparkSession))
