"""Streaming forms equal their batch forms; driver contract smoke checks."""

import os


from shelfspark.streaming import incremental as INC

SF = "/root/testdata/sf0.001"


def test_session_stream_equals_batch(spark, scratch):
    events = spark.read.parquet(f"{SF}/events.parquet")
    batch = sorted(map(tuple, INC.session_counts(events).collect()))
    q = INC.stream_sessions(spark, SF, events.schema, os.path.join(scratch, "ck"),
                            watermark="0 seconds", query_name="sess_test", glob="events.parquet")
    q.processAllAvailable()
    q.stop()
    streamed = sorted(map(tuple, spark.sql("SELECT * FROM sess_test").collect()))
    # Append mode emits sessions closed by the watermark; all of them must be batch sessions.
    assert set(streamed) <= set(batch) and len(streamed) > 0


def test_stream_upserts_equal_batch(spark, scratch):
    from shelfspark.sources import collections as CO

    src = os.path.join(scratch, "in")
    rows1 = [("a", [1.0], "A"), ("b", [2.0], "B"), ("b", [2.5], "Bx")]
    rows2 = [("b", [3.0], "B2"), ("c", [4.0], "C")]
    schema = "id string, embedding array<float>, document string"
    spark.createDataFrame(rows1, schema).coalesce(1).write.parquet(os.path.join(src, "f1"))
    spark.createDataFrame(rows2, schema).coalesce(1).write.parquet(os.path.join(src, "f2"))
    root = os.path.join(scratch, "colls")
    def run():
        q = INC.stream_upserts(spark, os.path.join(src, "*"), spark.createDataFrame([], schema).schema, root, "text",
                               os.path.join(scratch, "ck"), prepare=lambda df: df, order_by="document")
        q.awaitTermination()
        return sorted((r.id, r.document) for r in CO.open_collection(spark, root, "text").collect())

    assert run() == [("a", "A"), ("b", "B2"), ("c", "C")]
    # Restart: a third batch, after one more process start.
    spark.createDataFrame([("c", [5.0], "C2"), ("d", [6.0], "D")], schema).coalesce(1).write.parquet(os.path.join(src, "f3"))
    assert run() == [("a", "A"), ("b", "B2"), ("c", "C2"), ("d", "D")]
    # Replay: the commit of the last batch is lost, so the stream runs it again.
    commits = os.path.join(scratch, "ck", "commits")
    last = max(f for f in os.listdir(commits) if f.isdigit())
    for f in (last, f".{last}.crc"):
        if os.path.exists(os.path.join(commits, f)):
            os.remove(os.path.join(commits, f))
    assert run() == [("a", "A"), ("b", "B2"), ("c", "C2"), ("d", "D")]
    assert CO.current_manifest(spark, root, "text")["batches"] == 3


def test_entry_and_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["qid", "context"] and df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 60
    small = qs["cosine_topk"](spark, SF)
    assert small.columns == ["qid", "rank", "id", "distance"]


def test_sessions_batch_equals_session_window(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    a = sorted(map(tuple, INC.session_counts(events).collect()))
    # Tiny chunks force every chunk-boundary path of the segmented version.
    b = sorted(map(tuple, INC.sessions_batch(events, chunk=7).collect()))
    assert a == b


def test_sessions_hot_user(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=3 * i if i < 50 else 3 * i + 30), 1) for i in range(80)]
    rows += [(100 + i, base + dt.timedelta(minutes=20 * i), 2) for i in range(5)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    got = sorted((r.user_id, r.n_events) for r in INC.sessions_batch(ev, chunk=4).collect())
    assert got == [(1, 30), (1, 50), (2, 1), (2, 1), (2, 1), (2, 1), (2, 1)]
