"""Registered queries of the sources, sketches, intervals and searches whose checks
compare values row by row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.functions import table_functions as TF
from shelfspark.operators import evaluation as EV
from shelfspark.operators import knn as KN
from shelfspark.operators import result_store as RS
from shelfspark.operators import sketches as SK
from shelfspark.plans import pipelines as PL
from shelfspark.plans import sql_text as S
from shelfspark.plans.extra_queries import _EVAL_BASE, _stored_collection
from shelfspark.plans.registered import _DEDUPE_SQL, _PAIRS_SQL, DIM, SQL, _records, big, r6, register, t
from shelfspark.session import scratch_path
from shelfspark.sources import catalog as SC
from shelfspark.sources import collection_source as CS
from shelfspark.sources import collections as CO
from shelfspark.sources import fetch_ledger as FL

_NULLS = ", ".join(S.lit(x) for x in SC.NULL_TOKENS)


@register("multiline_csv_ranges", f"""
WITH d AS (SELECT doc_id, CASE WHEN {S.strip('text')} NOT IN ({_NULLS}) THEN text END AS text FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5,
       (length(text) - length(replace(text, chr(10), '')))::BIGINT AS n_breaks FROM d""")
def multiline_csv_ranges(spark, sf):
    """Documents as CSV, line breaks and quotes inside fields, read by byte ranges."""
    path = scratch_path(spark, "documents-csv")
    (t(spark, sf, "documents").select("doc_id", "text", "lang")
     .write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
    back = SC.read_catalog(spark, path, ["doc_id", "text", "lang"])
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"),
                       big(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n_breaks"))


@register("l2_topk_axes", SQL["l2_topk"])
def l2_topk_axes(spark, sf):
    """J1 with bounds over principal axes: the rows of ``l2_topk``."""
    e = t(spark, sf, "embeddings")
    hits = KN.knn_join(e, e, 5, "l2", qid="vec_id", qvec="embedding", cid="vec_id", cvec="embedding", strategy="axes")
    return hits.select("qid", big("rank").alias("rank"), "id", r6("distance").alias("distance"))


#: What the registered approximate searches must find of the exact neighbours.
RECALL = 0.9


def _measured(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    qs = e.withColumnRenamed("id", "qid")
    return e, qs, KN._kept(KN.knn_join(qs, e, 5, "cosine"), "exact-neighbours")


@register("ivf_recall", f"""
SELECT m AS method, (count(*) * least(count(*), 5))::BIGINT AS n_pairs, {RECALL}::DOUBLE AS target, true AS reached
FROM embeddings, (VALUES ('cells'), ('quantised')) v(m) WHERE len(embedding) > 0 GROUP BY m""")
def ivf_recall(spark, sf):
    """Recall at 5 of both approximate searches, at the probes chosen for it."""
    e, qs, exact = _measured(spark, sf)
    plain, coded = KN.ivf_build(e, space="cosine", seed=7), KN.pq_build(e, space="cosine", seed=7)
    search = lambda s, p: KN.pq_join(s, coded, 5, p)
    found = {"cells": KN.ivf_join(qs, plain, 5, KN.probe_for(qs, plain, 5, RECALL + 0.02)),
             "quantised": search(qs, KN.probe_for(qs, coded, 5, RECALL + 0.02, search=search))}
    n = exact.count()
    rows = [(name, n, RECALL, KN.recall(hits, exact) >= RECALL) for name, hits in found.items()]
    return spark.createDataFrame(rows, "method string, n_pairs long, target double, reached boolean")


@register("collection_source", SQL["upsert_collection"])
def collection_source(spark, sf):
    """The collection of ``upsert_collection``, its full build written and
    its current rows read through the data source."""
    CS.register(spark)
    root = scratch_path(spark, "source")
    e = t(spark, sf, "embeddings").select(F.col("vec_id"), "embedding")
    row = lambda key, doc: (key.cast("string").alias("id"), "embedding", doc.alias("document"))
    where = {"root": root, "name": "vectors"}
    e.select(*row(F.col("vec_id"), F.lit("base"))).write.format(CS.NAME).options(**where).mode("overwrite").save()
    one = (e.where("vec_id % 3 = 0").withColumn("k", F.explode(F.array(F.lit("b"), F.lit("a"))))
           .select(*row(F.col("vec_id"), F.concat(F.lit("first "), "k"))))
    CO.upsert(one, root, "vectors", "document", batch=1)
    CO.upsert(e.where("vec_id % 5 = 0").select(*row(F.col("vec_id") + 1, F.lit("second"))), root, "vectors", "document", batch=2)
    return spark.read.format(CS.NAME).options(**where).load().select("id", "document")


@register("streamed_upserts", """
SELECT CAST(i AS VARCHAR) AS id, arg_max(document, n) AS document FROM (
  SELECT vec_id AS i, 'one' AS document, 1 AS n FROM embeddings
  UNION ALL SELECT vec_id, 'two', 2 FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT vec_id + 1, 'three', 3 FROM embeddings WHERE vec_id % 5 = 0) GROUP BY i""")
def streamed_upserts(spark, sf):
    """Three files of rows arrive as a stream and are upserted batch by batch."""
    from shelfspark.streaming import incremental as INC

    src, root = scratch_path(spark, "arriving"), scratch_path(spark, "streamed")
    e = t(spark, sf, "embeddings")
    row = lambda df, key, doc: df.select(key.cast("string").alias("id"), "embedding", F.lit(doc).alias("document"))
    parts = [row(e, F.col("vec_id"), "one"), row(e.where("vec_id % 3 = 0"), F.col("vec_id"), "two"),
             row(e.where("vec_id % 5 = 0"), F.col("vec_id") + 1, "three")]
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{src}/f{k}")
    INC.stream_upserts(spark, f"{src}/*", parts[0].schema, root, "vectors", scratch_path(spark, "stream-checkpoint"),
                       prepare=lambda df: df, order_by="document").awaitTermination()
    return CO.open_collection(spark, root, "vectors").select("id", "document")


@register("cap_first_100", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def cap_first_100(spark, sf):
    """P7 with a cap below the table."""
    return SC.cap_first_n(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 100)


def _scored(spark, sf):
    records = _records(spark, sf)
    return PL.evaluate(PL.evaluation_pairs(records, "__key"), _stored_collection(spark, records), PL.EVAL_TOP_K, "l2", dim=DIM)


@register("report_roundtrip", _EVAL_BASE + """
SELECT pid, q_index::BIGINT AS q_index, round(answer_f1, 6) AS answer_f1, (SELECT round(avg(answer_f1), 6) FROM sc) AS mean_f1,
       (SELECT count(*) FROM sc) AS n_questions, row_number() OVER (ORDER BY round(answer_f1, 9), question, pid, q_index) <= 5 AS is_worst
FROM sc""")
def report_roundtrip(spark, sf):
    """S13 + E10: predictions, worst rows and metrics written and read back."""
    scored = _scored(spark, sf).withColumn("f1_lex", F.round("f1_lex", 9))
    path = scratch_path(spark, "report")
    PL.report(scored, path, key=["question", "pid", "q_index"])
    back = SC.read_catalog(spark, f"{path}/predictions", scored.columns)
    worst = SC.read_catalog(spark, f"{path}/worst", scored.columns).select("pid", "q_index", F.lit(True).alias("w"))
    metrics = spark.read.json(f"{path}/metrics").select(r6("answer_f1").alias("mean_f1"), "n_questions")
    return (back.select("pid", "q_index", r6(F.col("answer_f1").cast("double")).alias("answer_f1"))
            .join(F.broadcast(worst), ["pid", "q_index"], "left").join(F.broadcast(metrics))
            .select("pid", big("q_index").alias("q_index"), "answer_f1", "mean_f1", "n_questions", F.coalesce("w", F.lit(False)).alias("is_worst")))


_BOUNDS = " + ".join(f"(u >= {b})::INT" for b in EV._poisson_bounds())
_METRICS = ["answer_f1", "context_recall", "context_precision"]


@register("eval_intervals", _EVAL_BASE + f""",
u AS (SELECT sc.*, r, ('0x' || substr(md5('17:' || (r // 4) || ':' || pid || ':' || q_index), 1 + 8 * (r % 4)::INT, 8))::BIGINT AS u
      FROM sc, range({EV.REPLICATES}) g(r)),
w AS (SELECT *, {_BOUNDS} AS w FROM u),
means AS (SELECT r, {', '.join(f'sum(w * {m}) / sum(w) AS {m}' for m in _METRICS)} FROM w GROUP BY r HAVING sum(w) > 0),
""" + "long AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS x FROM means" for m in _METRICS) + "),\n" + "avgs AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, avg({m}) AS mean FROM sc" for m in _METRICS) + """)
SELECT metric, round(any_value(mean), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high,
       count(x) AS n_replicates FROM long JOIN avgs USING (metric) GROUP BY metric""")
def eval_intervals(spark, sf):
    """Metrics of the evaluation with bootstrap intervals."""
    out = EV.bootstrap_intervals(_scored(spark, sf), _METRICS, ["pid", "q_index"])
    return out.select("metric", r6("mean").alias("mean"), r6("low").alias("low"), r6("high").alias("high"), "n_replicates")


_PROFILED = ["source", "lang", "text"]


@register("profile_sketches", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) AS n_rows, count_if({S.is_blank(c)}) AS n_empty, true AS distinct_ok, true AS median_ok, true AS items_ok
FROM documents""" for c in _PROFILED))
def profile_sketches(spark, sf):
    """A2, A3, A5: four batches profiled, their sketches merged; distinct counts, median
    lengths and frequent items stay within the stated bounds of the exact values."""
    d, root = t(spark, sf, "documents").select("doc_id", *_PROFILED), scratch_path(spark, "profiles")
    for k in range(4):
        SK.store_profile(d.where(F.pmod("doc_id", F.lit(4)) == k), _PROFILED, root, k)
    found = SK.table_profile(spark, root)
    cells = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in _PROFILED])).alias("s")).select("s.*")
    cells = cells.where(~SK.is_blank(F.col("v"))).withColumn("item", SK._item(F.col("v")))
    median = found.select("column_name", F.col("length_quantiles")[2].alias("q"))
    exact = (cells.join(F.broadcast(median), "column_name").groupBy("column_name")
             .agg(F.count_distinct("v").alias("n_exact"), F.avg((F.length("v") < F.col("q")).cast("int")).alias("below"),
                  F.avg((F.length("v") <= F.col("q")).cast("int")).alias("upto"), F.count(F.lit(1)).alias("n")))
    per_item = cells.groupBy("column_name", "item").agg(F.count(F.lit(1)).alias("c"))
    items = (found.select("column_name", F.explode("items").alias("i")).select("column_name", "i.item", F.col("i.count").alias("got"))
             .join(per_item, ["column_name", "item"]).join(exact.select("column_name", "n"), "column_name")
             .groupBy("column_name").agg(F.bool_and(F.abs(F.col("got") - F.col("c")) <= 3.5 / SK.TRACKED * F.col("n") + 1).alias("items_ok"),
                                         F.count(F.lit(1)).alias("n_items")))
    return found.join(exact, "column_name").join(items, "column_name").select(
        "column_name", "n_rows", "n_empty", (F.abs(F.col("n_distinct") - F.col("n_exact")) <= 0.065 * F.col("n_exact") + 1).alias("distinct_ok"),
        ((F.col("below") <= 0.527) & (F.col("upto") >= 0.473)).alias("median_ok"), (F.col("items_ok") & (F.col("n_items") > 0)).alias("items_ok"))


@register("turn_pairs_table", SQL["turn_pairs"])
def turn_pairs_table(spark, sf):
    """C3 as a table function, partitioned by conversation."""
    TF.register(spark)
    t(spark, sf, "conversations").createOrReplaceTempView("shelfspark_turns")
    return spark.sql("SELECT * FROM turn_pairs(TABLE(SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM shelfspark_turns) "
                     "PARTITION BY conv_id ORDER BY turn)")


@register("sentences_table", _DEDUPE_SQL[:_DEDUPE_SQL.index("SELECT d.doc_id")] + """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, piece AS sentence FROM first_seen""")
def sentences_table(spark, sf):
    """F5 as a table function: the distinct sentences in order."""
    TF.register(spark)
    t(spark, sf, "documents").createOrReplaceTempView("shelfspark_texts")
    return spark.sql("SELECT * FROM sentences(TABLE(SELECT doc_id, text FROM shelfspark_texts) PARTITION BY doc_id)")


@register("live_threads", SQL["chat_threads"])
def live_threads(spark, sf):
    """C1 + R2: turns arrive as three files in no order; the last version of every turn."""
    from shelfspark.streaming import live_threads as LT

    src, sink = scratch_path(spark, "turns-arriving"), scratch_path(spark, "threads")
    turns = t(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    for k in range(3):
        part = turns.where(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == k)
        part.repartition(1).write.parquet(f"{src}/f{k}")
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    LT.stream_threads(stream, sink, scratch_path(spark, "threads-checkpoint")).awaitTermination()
    out = LT.current_threads(spark.read.schema(LT.OUTPUT).parquet(sink))
    kinds = {f.name: f.dataType for f in turns.schema.fields}
    return out.select(F.col("conv_id").cast(kinds["conv_id"]).alias("conv_id"), F.col("turn").cast(kinds["turn"]).alias("turn"),
                      "role", "is_reset", "thread")


@register("stored_results", """
SELECT doc_id, md5(text) AS result, (SELECT count(DISTINCT text) FROM documents) AS n_stored FROM documents""")
def stored_results(spark, sf):
    """B1: a stand-in model over half of the documents, then over all through its store;
    the last answers come from the store alone, as its model would fail."""
    def model():
        import hashlib

        return lambda texts: [hashlib.md5(x.encode()).hexdigest() for x in texts]

    def broken():
        def fn(texts):
            raise RuntimeError("every result is stored")
        return fn

    d, root = t(spark, sf, "documents").select("doc_id", "text"), scratch_path(spark, "results")
    RS.ResultStore(spark, root, "md5", "string", buckets=8).ensure(d.where("doc_id % 2 = 0"), "text", model)
    RS.ResultStore(spark, root, "md5", "string").ensure(d, "text", model)
    store = RS.ResultStore(spark, root, "md5", "string")
    out = store.encode(d, "text", broken, out="result")
    return out.select("doc_id", "result").join(F.broadcast(store.results().agg(F.count(F.lit(1)).alias("n_stored"))))


@register("fetch_ledger", """
SELECT url, max(CASE length(url) % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS n_attempts, bool_and(length(url) % 5 <> 0) AS ok,
       max(CASE WHEN length(url) % 5 <> 0 THEN octet_length(encode(upper(url))) END)::BIGINT AS n_bytes
FROM pages WHERE url IS NOT NULL GROUP BY url""")
def fetch_ledger(spark, sf):
    """S14 in rounds, with a stand-in fetcher: some addresses always fail, some once."""
    def fetcher_of(n):
        def fetcher():
            return lambda urls: [None if len(u) % 5 == 0 or (len(u) % 5 == 1 and n == 1) else u.upper().encode() for u in urls]
        return fetcher

    out = FL.fetch_rounds(t(spark, sf, "pages").select("url"), scratch_path(spark, "ledger"), fetcher_of, FL.rounds_needed())
    return out.select("url", "n_attempts", "ok", big(F.octet_length("content")).alias("n_bytes"))
