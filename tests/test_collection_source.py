"""Deletion bitmaps of collections, and collections as a Spark data source."""

import os
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.sources import collection_source as CS
from shelfspark.sources import collections as CO

SCHEMA = "id string, embedding array<float>, document string"


def rows(spark, ids, doc):
    return spark.createDataFrame([(str(i), [float(i), 1.0], doc) for i in ids], SCHEMA)


def content(df):
    return sorted((r.id or "", r.document) for r in df.collect())


def want(*batches):
    out = {}
    for ids, doc in batches:
        out |= {str(i): doc for i in ids}
    return sorted(out.items())


def options(df, root, name="c"):
    return df.format(CS.NAME).option("root", root).option("name", name)


def test_reading_is_a_scan(spark, scratch):
    root = os.path.join(scratch, "r")
    CO.save(rows(spark, range(0, 100), "base").repartition(3), root, "c")
    CO.upsert(rows(spark, range(50, 120), "one"), root, "c", "document")
    out = CO.upsert(rows(spark, range(0, 120, 10), "two"), root, "c", "document")
    assert content(out) == want((range(100), "base"), (range(50, 120), "one"), (range(0, 120, 10), "two"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_batch_written_again_below_later_ones(spark, scratch):
    root = os.path.join(scratch, "r")
    CO.save(rows(spark, range(20), "base"), root, "c")
    CO.upsert(rows(spark, range(0, 10), "one"), root, "c", "document", batch=1)
    CO.upsert(rows(spark, range(5, 15), "two"), root, "c", "document", batch=2)
    # Batch 1 again, with other rows: those of batch 2 stay on top, 0 to 4 come back.
    out = CO.upsert(rows(spark, range(8, 12), "one again"), root, "c", "document", batch=1)
    assert content(out) == want((range(20), "base"), (range(8, 12), "one again"), (range(5, 15), "two"))


def test_null_ids_and_many_buckets(spark, scratch, monkeypatch):
    monkeypatch.setattr(CO, "BITS", 8)
    root = os.path.join(scratch, "r")
    base = rows(spark, range(60), "base").unionByName(spark.createDataFrame([(None, [1.0, 1.0], "none")], SCHEMA))
    CO.save(base.coalesce(1), root, "c")
    new = rows(spark, range(0, 60, 7), "new").unionByName(spark.createDataFrame([(None, [1.0, 1.0], "none 2")], SCHEMA))
    assert content(CO.upsert(new, root, "c", "document")) == sorted(want((range(60), "base"), (range(0, 60, 7), "new")) + [("", "none 2")])


def test_many_batches_are_compacted(spark, scratch, monkeypatch):
    monkeypatch.setattr(CO, "MAX_BATCHES", 3)
    root = os.path.join(scratch, "r")
    CO.save(rows(spark, range(5), "base"), root, "c")
    for k in range(4):
        out = CO.upsert(rows(spark, [k, k + 1], f"b{k}"), root, "c", "document")
    assert content(out) == want((range(5), "base"), *[([k, k + 1], f"b{k}") for k in range(4)])
    man = CO.current_manifest(spark, root, "c")
    assert man["version"] == 2 and man["batches"] <= 3


def test_source_reads_what_open_collection_reads(spark, scratch):
    CS.register(spark)
    root = os.path.join(scratch, "r")
    CO.save(rows(spark, range(0, 50), "base").repartition(2), root, "c", space="cosine")
    CO.upsert(rows(spark, range(30, 60), "one"), root, "c", "document")
    CO.upsert(rows(spark, range(0, 60, 9), "two"), root, "c", "document")
    got = options(spark.read, root).load()
    opened = CO.open_collection(spark, root, "c")
    assert got.schema == opened.schema
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, opened.collect()))
    assert content(got.where("document = 'two' and id > '3'")) == content(opened.where("document = 'two' and id > '3'"))
    with pytest.raises(Exception, match="not found"):
        options(spark.read, root, "other").load()


def test_source_writes_a_full_build(spark, scratch):
    CS.register(spark)
    root = os.path.join(scratch, "r")
    options(rows(spark, range(40), "first").repartition(3).write, root).option("space", "cosine").mode("overwrite").save()
    man = CO.current_manifest(spark, root, "c")
    assert (man["version"], man["n"], man["dim"], man["space"]) == (1, 40, 2, "cosine")
    CO.upsert(rows(spark, [1, 41], "one"), root, "c", "document")
    options(rows(spark, range(3), "second").write, root).mode("overwrite").save()
    assert content(CO.open_collection(spark, root, "c")) == want((range(3), "second"))
    options(rows(spark, [], "none").write, root).mode("overwrite").save()
    assert CO.open_collection(spark, root, "c").count() == 0
    with pytest.raises(Exception, match="overwrite"):
        options(rows(spark, [1], "x").write, root).mode("append").save()


def test_failed_writer_exposes_nothing(spark, scratch):
    CS.register(spark)
    root = os.path.join(scratch, "r")
    CO.save(rows(spark, range(3), "base"), root, "c")
    before = sorted(os.listdir(os.path.join(root, "c", "data")))
    broken = rows(spark, range(40), "bad").repartition(4).withColumn(
        "document", F.when(F.col("id") == "17", F.raise_error(F.lit("broken row"))).otherwise(F.col("document")))
    with pytest.raises(Exception, match="broken row"):
        options(broken.write, root).mode("overwrite").save()
    assert content(CO.open_collection(spark, root, "c")) == want((range(3), "base"))
    assert CO.current_manifest(spark, root, "c")["version"] == 1
    left = [d for d in os.listdir(os.path.join(root, "c", "data")) if d not in before]
    assert not [f for d in left for f in os.listdir(os.path.join(root, "c", "data", d)) if not f.startswith(".")]


def test_task_that_ends_after_the_abort_leaves_nothing(scratch, monkeypatch):
    monkeypatch.setattr(CS.TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))
    w = CS.CollectionWriter(os.path.join(scratch, "r"), "c", "l2", None)

    def batches():
        w.abort([])
        yield pa.RecordBatch.from_pydict({"embedding": [[1.0, 2.0]]})

    with pytest.raises(RuntimeError, match="aborted"):
        w.write(batches())
    assert os.listdir(w.folder) == [".aborted"]


def test_stream_yields_every_batch_once(spark, scratch):
    CS.register(spark)
    root, seen = os.path.join(scratch, "r"), []

    def run():
        q = (options(spark.readStream, root).load().writeStream.option("checkpointLocation", os.path.join(scratch, "ck"))
             .foreachBatch(lambda df, n: seen.extend(content(df))).start())
        q.processAllAvailable()
        q.stop()

    CO.save(rows(spark, [1, 2], "base"), root, "c")
    CO.upsert(rows(spark, [2], "one"), root, "c", "document")
    run()
    assert sorted(seen) == [("1", "base"), ("2", "base"), ("2", "one")]
    CO.upsert(rows(spark, [3], "two"), root, "c", "document")
    CO.compact(spark, root, "c")
    CO.upsert(rows(spark, [1], "three"), root, "c", "document")
    run()
    # A restart goes on behind what was read; the compaction brings nothing.
    assert sorted(seen[3:]) == [("1", "three"), ("3", "two")]
