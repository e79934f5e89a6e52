"""Result store, fetch ledger and live threads."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import chat as CH
from shelfspark.operators import result_store as RS
from shelfspark.sources import fetch_ledger as FL
from shelfspark.streaming import live_threads as LT


def _counted(spark):
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def fn(texts):
            calls.add(len(texts))
            return [None if t == "fails" else t.upper() for t in texts]
        return fn
    return calls, factory


def test_results_are_asked_for_once(spark, scratch, monkeypatch):
    monkeypatch.setattr(RS, "MAX_SEGMENTS", 2)
    root = os.path.join(scratch, "store")
    texts = ["a", "b", "a", None, "", "c", "a"] + [f"t{i % 5}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(4)
    calls, model = _counted(spark)
    store = RS.ResultStore(spark, root, "m1", "string", buckets=4)
    for _ in range(2):
        got = {r.i: r.vec for r in store.encode(df, "text", model).collect()}
        assert got == {i: None if x is None else x.upper() for i, x in enumerate(texts)}
        assert calls.value == len(set(texts) - {None})
    # Another session's view of the store; new inputs only; a failed one is asked again.
    store = RS.ResultStore(spark, root, "m1", "string")
    assert store.buckets == 4 and len(store.segments) == 1
    for n, more in enumerate((["a", "new"], ["fails", "b"], ["fails", "x"])):
        before = calls.value
        rows = store.encode(spark.createDataFrame([(x,) for x in more], "text string"), "text", model).collect()
        assert {r.text: r.vec for r in rows} == {x: None if x == "fails" else x.upper() for x in more}
        assert calls.value - before == (1, 1, 2)[n]
    assert store.generation > 0 and RS.ResultStore(spark, root, "m1", "string").segments == store.segments
    assert RS.ResultStore(spark, root, "m2", "string").segments == []
    with pytest.raises(ValueError):
        RS.ResultStore(spark, root, "m1", "array<float>")


def test_ledger_gives_every_address_its_attempts(spark, scratch):
    root = os.path.join(scratch, "ledger")
    kind = {f"http://h{i % 3 if i % 2 else 0}.example/{i}": ("ok", "never", "second")[i % 3] for i in range(60)}
    urls = spark.createDataFrame([(u,) for u in kind] + [(None,), (next(iter(kind)),)], "url string")

    def fetcher_of(n):
        def factory():
            return lambda asked: [None if kind[u] == "never" or (kind[u] == "second" and n < 2) else u.encode() for u in asked]
        return factory

    def dies():
        def fn(asked):
            raise RuntimeError("killed")
        return fn

    need = FL.rounds_needed(3)
    assert need == 4
    FL.fetch_round(urls, root, fetcher_of(1), 1)
    with pytest.raises(Exception, match="killed"):
        FL.fetch_round(urls, root, dies, 2)
    out = {r.url: r for r in FL.fetch_rounds(urls, root, fetcher_of, need + 1).collect()}
    assert set(out) == set(kind)
    for u, k in kind.items():
        assert (out[u].n_attempts, out[u].ok) == {"ok": (1, True), "never": (3, False), "second": (2, True)}[k]
        assert out[u].content == (u.encode() if out[u].ok else None)
    log = Counter((r.url, r.attempt) for r in FL.attempts(spark, root).collect())
    assert max(log.values()) == 1
    assert {r["round"] for r in FL.attempts(spark, root).where("attempt = 3").collect()} == {4}


def test_host_budget_spreads_and_holds(spark, scratch):
    root = os.path.join(scratch, "ledger")
    urls = spark.range(300).select(F.concat(F.lit("http://"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), F.col("id"))),
                                            F.lit(".example/"), F.col("id")).alias("url"))
    ok = lambda: lambda asked: [b"x"] * len(asked)
    for n, left in ((1, 100), (2, 60), (3, 20), (4, 0)):
        hosts = {r.host: r["count"] for r in FL.fetch_round(urls, root, ok, n, host_budget=40).groupBy("host").count().collect()}
        assert hosts.get("hot.example", 0) == min(left, 40)
    assert FL.fetched(spark, root).count() == 300
    sizes = [r.n for r in FL.spread(FL.due(urls, os.path.join(scratch, "none"), 1)).where("host = 'hot.example'").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 1


def test_live_threads_equal_the_batch_form(spark, scratch):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "user"]), r.choice(["x", "y", " ", None])) for c in range(12) for t in range(r.randint(1, 14))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r.shuffle(rows)
    src, sink = os.path.join(scratch, "in"), os.path.join(scratch, "out")

    def arrive(n, part):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(os.path.join(src, f"f{n}"))

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
        assert LT.stream_threads(stream, sink, os.path.join(scratch, "ck")).awaitTermination(120)
        return spark.read.parquet(sink)

    third = len(rows) // 3
    arrive(1, rows[:third])
    arrive(2, rows[third:2 * third])
    run()
    # A restart: the last turns come late and correct the threads behind them.
    arrive(3, rows[2 * third:])
    emitted = run()
    want = sorted(map(tuple, CH.threads(df).select("conv_id", "turn", "role", "is_reset", "thread").collect()))
    assert sorted(map(tuple, LT.current_threads(emitted).collect())) == want
    assert emitted.where("status = 'closed'").count() == 0


def test_silent_conversations_are_closed(spark, scratch):
    import time

    df = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "y"), (2, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    src, sink = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    df.write.parquet(src)
    q = LT.stream_threads(spark.readStream.schema(df.schema).parquet(src), sink, os.path.join(scratch, "ck"), timeout_ms=200)
    try:
        for _ in range(60):
            time.sleep(1)
            if os.path.isdir(sink) and (done := spark.read.schema(LT.OUTPUT).parquet(sink)).where("status = 'closed'").count() >= 2:
                break
    finally:
        q.stop()
    assert {(r.conv_id, r.is_closed) for r in LT.closed_conversations(done).collect()} == {(1, True), (2, True)}
    assert LT.current_threads(done).count() == 3
