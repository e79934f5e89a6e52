"""Registered queries for the media, collection, answer and evaluation pipelines
(PL2-PL5, S3-S13, J4); all but the probed IVF query have oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import encode as EN
from shelfspark.operators import evaluation as EV
from shelfspark.plans import pipelines as PL
from shelfspark.plans import sql_text as S
from shelfspark.plans.registered import (_CATALOG_SQL, _RECORDS_SQL, DIM, K_CHAT, SQL_SEARCH_TEXT, _qa_sql,
                                         _records, big, r6, register, t)
from shelfspark.plans.registered import digest as _digest
from shelfspark.sources import catalog as SC


SHOP_PROMPT = "Products found:\n{context}\n===\nCustomer asks: {query}\nReply:"


def _answer_batch_sql() -> str:
    a, rest = SHOP_PROMPT.split("{context}")
    b, c = rest.split("{query}")
    sep = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    return f"""
{SQL_SEARCH_TEXT},
cat AS (SELECT CAST(row_number() OVER (ORDER BY __key) - 1 AS VARCHAR) AS id, coalesce(search_text, '') AS document,
               string_split("Image", '|')[1] AS image_url FROM st),
cv AS (SELECT k AS id, v FROM {S.hash_vectors('cat', 'id', 'document', DIM)}),
qs AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS qid, text AS question
       FROM conversations WHERE role = 'user'),
qv AS (SELECT k AS qid, v FROM {S.hash_vectors('qs', 'qid', 'question', DIM)}),
hits AS ({S.topk('qv', 'cv', K_CHAT, 'cosine')}),
blocks AS (SELECT h.qid, h.rank, c.document || CASE WHEN c.image_url IS NOT NULL
                  THEN chr(10) || 'Image URL: ' || c.image_url ELSE '' END AS block
           FROM hits h JOIN cat c ON h.id = c.id),
ctx AS (SELECT qid, count(*) AS n, string_agg(block, {sep} ORDER BY rank) AS context FROM blocks GROUP BY qid)
SELECT q.qid, coalesce(ctx.n, 0)::BIGINT AS n_contexts,
       md5(CASE WHEN coalesce(ctx.n, 0) = 0 THEN 'I don''t know.'
                ELSE {S.lit(a)} || ctx.context || {S.lit(b)} || coalesce(q.question, '') || {S.lit(c)} END) AS answer_md5
FROM qs q LEFT JOIN ctx ON q.qid = ctx.qid"""


@register("answer_batch", _answer_batch_sql())
def answer_batch(spark, sf):
    """PL4: user turns as questions against the catalog text collection."""
    from shelfspark.session import scratch_path

    cat = PL.clean_catalog(PL.catalog_from_tables(spark, sf), F.col("`Uniq Id`").cast("bigint"))
    # PL2 then PL4: the collection is built and stored once, then searched.
    coll = PL.build_collections(cat, scratch_path(spark, "collections"), dim=DIM)["text"]
    conv = t(spark, sf, "conversations").where(F.col("role") == "user")
    # (conversation, turn) as an exact text key: no arithmetic packing that could collide.
    qid = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    qs = EN.hash_encode(conv.select(qid.alias("qid"), F.col("text").alias("question")), "question", dim=DIM)
    ans = PL.answer_batch(qs, coll, K_CHAT, "cosine", dim=DIM, prompt=SHOP_PROMPT)
    return ans.select("qid", big(F.size("contexts")).alias("n_contexts"), F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


_PROMPT_A, _PROMPT_REST = PL.EVAL_PROMPT.split("{context}")
_PROMPT_B, _PROMPT_C = _PROMPT_REST.split("{question}")
_EVAL_BASE = f"""
WITH {_CATALOG_SQL}, {_RECORDS_SQL},
capped AS (SELECT * FROM records ORDER BY __key LIMIT {PL.EVAL_CAP}),
sampled AS (SELECT *, row_number() OVER (ORDER BY md5('{PL.EVAL_SAMPLE_SEED}:' || CAST(__key AS VARCHAR)), __key) - 1
                      AS sample_idx
            FROM capped ORDER BY md5('{PL.EVAL_SAMPLE_SEED}:' || CAST(__key AS VARCHAR)), __key LIMIT {PL.EVAL_SAMPLE_SIZE}),
withpid AS (SELECT *, {S.strip('id')} AS pid FROM sampled),
{_qa_sql('withpid', 'pid')},
coll AS (SELECT id, concat_ws(' || ', "Title", "Description", "Category") AS document FROM records),
cv AS (SELECT k AS id, v FROM {S.hash_vectors('coll', 'id', 'document', DIM)}),
qs AS (SELECT DISTINCT question FROM kept),
qv AS (SELECT k AS qid, v FROM {S.hash_vectors('qs', 'question', 'question', DIM)}),
hits AS ({S.topk('qv', 'cv', PL.EVAL_TOP_K, 'l2')}),
ctx AS (SELECT h.qid AS question, list(c.document ORDER BY h.rank) AS contexts
        FROM hits h JOIN coll c ON h.id = c.id GROUP BY h.qid),
pred AS (SELECT kp.pid, kp.q_index, kp.question, kp.ground_truth AS reference, coalesce(ctx.contexts, []) AS contexts
         FROM kept kp LEFT JOIN ctx ON kp.question = ctx.question),
prompted AS (SELECT *, {S.lit(_PROMPT_A)} || array_to_string(contexts, chr(10) || chr(10)) || {S.lit(_PROMPT_B)} || question
                       || {S.lit(_PROMPT_C)} AS prompt FROM pred),
ans AS (SELECT *, CASE WHEN len(contexts) = 0 THEN 'I don''t know.' ELSE prompt END AS answer FROM prompted),
sc AS (SELECT pid, q_index, question, {S.f1(S.tokens('reference'), S.tokens('answer'))} AS answer_f1,
              {S.ratio_in(S.tokens("array_to_string(contexts, ' ')"), S.tokens('reference'))} AS context_recall,
              {S.ratio_in(S.tokens("array_to_string(contexts, ' ')"), S.tokens('answer'))} AS context_precision,
              contexts, md5(prompt) AS prompt_md5 FROM ans)"""

_EVAL_SQL = _EVAL_BASE + """
SELECT round(coalesce(avg(answer_f1), 0.0), 6) AS answer_f1, round(coalesce(avg(context_recall), 0.0), 6) AS context_recall,
       round(coalesce(avg(context_precision), 0.0), 6) AS context_precision, count(*) AS n_questions,
       count_if(len(contexts) = 0) AS n_no_context
FROM sc"""


def _stored_collection(spark, records):
    from shelfspark.session import scratch_path
    from shelfspark.sources import collections as CO

    coll = PL.text_collection(records.withColumn("text", F.concat_ws(" || ", "Title", "Description", "Category")), "text", dim=DIM)
    return CO.save(coll, scratch_path(spark, "eval-collection"), "text")


@register("eval_summary", _EVAL_SQL)
def eval_summary(spark, sf):
    """PL5: pairs -> retrieval over the catalog collection -> answers -> scores -> summary."""
    records = _records(spark, sf)
    pairs = PL.evaluation_pairs(records, "__key")
    coll = _stored_collection(spark, records)
    scored = PL.evaluate(pairs, coll, PL.EVAL_TOP_K, "l2", dim=DIM)
    s = EV.summarize(scored)
    return s.select(r6("answer_f1").alias("answer_f1"), r6("context_recall").alias("context_recall"),
                    r6("context_precision").alias("context_precision"), "n_questions", "n_no_context")


_EMB_TOP5 = S.topk("(SELECT vec_id AS qid, embedding AS v FROM embeddings)", "(SELECT vec_id AS id, embedding AS v FROM embeddings)", 5, "cosine")


def _ivf(spark, sf, probe):
    from shelfspark.operators import knn as KN

    e = t(spark, sf, "embeddings")
    index = KN.ivf_build(e, cid="vec_id", cvec="embedding", space="cosine", seed=7)
    probe = probe(e, index) if probe else len(index["centroids"])
    hits = KN.ivf_join(e, index, 5, probe=probe, qid="vec_id", qvec="embedding")
    return hits.select("qid", big("rank").alias("rank"), "id", r6("distance").alias("distance"))


@register("ivf_topk", f"SELECT qid, rank::BIGINT AS rank, id, round(distance, 6) AS distance FROM ({_EMB_TOP5})")
def ivf_topk(spark, sf):
    """J4 with all cells (about the square root of the rows) probed: exact."""
    return _ivf(spark, sf, None)


@register("ivf_topk_probed")
def ivf_topk_probed(spark, sf):
    """J4, approximate: as many cells as a recall of 0.92 takes (``ivf_recall`` checks it)."""
    from shelfspark.operators import knn as KN

    return _ivf(spark, sf, lambda e, index: KN.probe_for(e, index, 5, 0.92, qid="vec_id", qvec="embedding"))


_COLLECTION_SQL = f"""
{SQL_SEARCH_TEXT},
coll AS (SELECT "Uniq Id" AS id, coalesce(search_text, '') AS document, "Product Name" AS name,
                string_split("Image", '|')[1] AS image_url FROM st),
cv AS (SELECT k AS id, v FROM {S.hash_vectors('coll', 'id', 'document', DIM)})
SELECT c.id, len(cv.v)::BIGINT AS dim, round({S.weighted_digest('cv.v')}, 6) AS digest, c.name, c.image_url,
       c.id AS product_id
FROM coll c JOIN cv ON c.id = cv.id"""


@register("catalog_text_collection", _COLLECTION_SQL)
def catalog_text_collection(spark, sf):
    """PL2 (text): cleaned catalog -> stand-in encoder -> versioned collection
    under the shared checkpoint folder -> read back with its metadata."""
    from shelfspark.session import scratch_path

    cleaned = PL.clean_catalog(PL.catalog_from_tables(spark, sf), F.col("`Uniq Id`").cast("bigint"))
    cleaned = cleaned.withColumn("id", F.col("`Uniq Id`"))
    out = PL.build_collections(cleaned, scratch_path(spark, "collections"), dim=DIM)
    coll = out["text"]
    return coll.select("id", big(F.size("embedding")).alias("dim"), r6(_digest("embedding")).alias("digest"),
                       "metadata.name", "metadata.image_url", "metadata.product_id")


@register("tolerant_csv_counts", """
SELECT count_if(doc_id % 7 <> 0) AS n_good, count_if(doc_id % 7 = 0) AS n_corrupt,
       count_if(doc_id % 7 <> 0 AND doc_id % 5 = 0) AS n_short FROM documents""")
def tolerant_csv_counts(spark, sf):
    """S3: documents written as CSV with every fifth row short and every seventh
    too long, read back with the tolerant reader."""
    from shelfspark.session import scratch_path

    path = scratch_path(spark, "documents-csv")
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.coalesce("text", F.lit("")), '"', '""'), F.lit('"'))
    doc = F.col("doc_id")
    line = (F.when(doc % 7 == 0, F.concat_ws(",", doc.cast("string"), quoted, F.lit("x"), F.lit("too many")))
             .when(doc % 5 == 0, F.concat_ws(",", doc.cast("string"), quoted))
             .otherwise(F.concat_ws(",", doc.cast("string"), quoted, F.lit("x"))))
    # One line per file part carries the header, as any CSV writer does.
    rows = t(spark, sf, "documents").select(line.alias("value"))

    def with_header(batches):
        import pyarrow as pa

        for i, b in enumerate(batches):
            if i == 0:
                yield pa.RecordBatch.from_arrays([pa.array(["doc_id,text,lang"], b.schema.field(0).type)], schema=b.schema)
            yield b

    rows.mapInArrow(with_header, "value string").write.text(path)
    good, corrupt = SC.read_tolerant_csv(spark, path, ["doc_id", "text"])
    return (good.select(F.lit(1).alias("g"), F.col("lang").isNull().alias("short"))
            .unionByName(corrupt.select(F.lit(0).alias("g"), F.lit(False).alias("short")))
            .agg(F.count_if(F.col("g") == 1).alias("n_good"), F.count_if(F.col("g") == 0).alias("n_corrupt"),
                 F.count_if("short").alias("n_short")))


_PRED_SQL = _EVAL_BASE + """
SELECT pid, q_index::BIGINT AS q_index, question, round(answer_f1, 6) AS answer_f1,
       round(context_recall, 6) AS context_recall, round(context_precision, 6) AS context_precision,
       len(contexts)::BIGINT AS n_contexts, prompt_md5
FROM sc"""


@register("eval_predictions", _PRED_SQL)
def eval_predictions(spark, sf):
    """E3/E4/E5-E7 per evaluation pair (the table behind ``eval_summary``)."""
    records = _records(spark, sf)
    pairs = PL.evaluation_pairs(records, "__key")
    coll = _stored_collection(spark, records)
    scored = PL.evaluate(pairs, coll, PL.EVAL_TOP_K, "l2", dim=DIM)
    return scored.select("pid", "q_index", "question", r6("answer_f1").alias("answer_f1"),
                         r6("context_recall").alias("context_recall"),
                         r6("context_precision").alias("context_precision"),
                         big(F.size("contexts")).alias("n_contexts"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@register("upsert_collection", f"""
WITH base AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS v, 'base' AS document FROM embeddings),
b1 AS (SELECT id, min(document) AS document FROM (
         SELECT CAST(vec_id AS VARCHAR) AS id, 'first ' || k AS document FROM embeddings, (VALUES ('a'), ('b')) t(k) WHERE vec_id % 3 = 0) GROUP BY id),
b2 AS (SELECT CAST(vec_id + 1 AS VARCHAR) AS id, 'second' AS document FROM embeddings WHERE vec_id % 5 = 0),
ids AS (SELECT id FROM base UNION SELECT id FROM b1 UNION SELECT id FROM b2)
SELECT ids.id, coalesce(b2.document, b1.document, base.document) AS document
FROM ids LEFT JOIN b2 USING (id) LEFT JOIN b1 USING (id) LEFT JOIN base USING (id)""")
def upsert_collection(spark, sf):
    """S7 + S8: build, two upserts (one with duplicates inside, written twice under
    one batch number), read back."""
    from shelfspark.session import scratch_path
    from shelfspark.sources import collections as CO

    root = scratch_path(spark, "upserts")
    e = t(spark, sf, "embeddings").select(F.col("vec_id"), "embedding")
    row = lambda key, doc: (key.cast("string").alias("id"), "embedding", doc.alias("document"))
    CO.save(e.select(*row(F.col("vec_id"), F.lit("base"))), root, "vectors")
    one = (e.where("vec_id % 3 = 0").withColumn("k", F.explode(F.array(F.lit("b"), F.lit("a"))))
           .select(*row(F.col("vec_id"), F.concat(F.lit("first "), "k"))))
    CO.upsert(one, root, "vectors", "document", batch=1)
    CO.upsert(one, root, "vectors", "document", batch=1)
    two = e.where("vec_id % 5 = 0").select(*row(F.col("vec_id") + 1, F.lit("second")))
    return CO.upsert(two, root, "vectors", "document", batch=2).select("id", "document")


@register("list_collections", """
SELECT 'text' AS name, 'cosine' AS space, max(len(embedding))::INT AS dim, 2::BIGINT AS version, 1::BIGINT AS batches FROM embeddings
UNION ALL SELECT 'extra', 'l2', max(len(embedding))::INT, 1, 1 FROM embeddings""")
def list_collections(spark, sf):
    """S7 ``replace`` and ``keep`` on existing collections, S10 listing."""
    from shelfspark.session import scratch_path
    from shelfspark.sources import collections as CO

    root = scratch_path(spark, "listed")
    e = t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", F.lit("d").alias("document"))
    CO.save(e, root, "text", space="cosine")
    CO.save(e, root, "text", space="cosine", if_exists="replace")
    CO.save(e.limit(1), root, "text", space="cosine", if_exists="keep")
    CO.save(e, root, "extra")
    return CO.list_collections(spark, root)


_DOC_COLUMNS = ["doc_id", "text", "lang"]


@register("detect_vector_column", "SELECT 'vec_text' AS column_name, count(*) AS n_rows FROM embeddings")
def detect_vector_column(spark, sf):
    """No column has a vector's name, and the first values of the right one are null."""
    e = t(spark, sf, "embeddings").select(
        F.when(F.col("vec_id") % 2 == 1, F.to_json(F.transform("embedding", lambda x: x.cast("double")))).alias("vec_text"),
        F.concat(F.lit("["), F.col("vec_id").cast("string")).alias("half"), F.col("vec_id").cast("string").alias("other"))
    return e.agg(F.lit(SC.detect_vector_column(e)).alias("column_name"), F.count(F.lit(1)).alias("n_rows"))


@register("column_pick", """
SELECT 'body' AS named, 'text' AS widest, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS id FROM documents""")
def column_pick(spark, sf):
    """Text column by name, by width, and the id from the position."""
    from shelfspark.operators import identity as ID

    d = t(spark, sf, "documents").select(*_DOC_COLUMNS)
    named = SC.pick_text_column(d.withColumnRenamed("lang", "body").withColumnRenamed("text", "words"))
    widest = SC.pick_text_column(d.select(F.col("doc_id").alias("n"), F.col("text").alias("words"), "lang")).replace("words", "text")
    placed = ID.dense_id(d.select(F.col("doc_id").alias("number")), "number", out="pos")
    out, id_col = SC.with_id_column(placed, "pos")
    return out.select(F.lit(named).alias("named"), F.lit(widest).alias("widest"), F.col(id_col).alias("id"))


@register("synth_description", f"""
SELECT CAST(p_partkey AS VARCHAR) AS id, {S.collapse("p_name || ' ' || p_type")} AS "Description" FROM part""")
def synth_description(spark, sf):
    """records from a table without a description column."""
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"))
    return SC.product_records(p, "id", "title", None, "category", None).select("id", "Description")


@register("clean_catalog_sink", f"""
{SQL_SEARCH_TEXT} SELECT "Uniq Id" AS product_id, CASE WHEN search_text <> '' THEN search_text END AS search_text FROM st""")
def clean_catalog_sink(spark, sf):
    """P1 + PL1 + S5: useful columns, cleaned, written as CSV and read back."""
    from shelfspark.session import scratch_path

    raw = SC.keep_columns(PL.catalog_from_tables(spark, sf))
    path = scratch_path(spark, "clean-catalog")
    cleaned = PL.clean_catalog(raw, F.col("`Uniq Id`").cast("bigint"))
    SC.write_clean_catalog(cleaned, path)
    # Product texts hold words that the reader would take for missing values; none here.
    return SC.read_catalog(spark, path, cleaned.columns).select("product_id", "search_text")


_IMAGE_BINS = 64
_IMAGE_SQL = f"""
{SQL_SEARCH_TEXT},
coll AS (SELECT "Uniq Id" AS id, __key AS k, coalesce(search_text, '') AS document FROM st),
bytes AS (SELECT page_id AS k, ('0x' || substr(h, 2 * i + 1, 2))::INT // {256 // _IMAGE_BINS} AS b
          FROM (SELECT page_id, hex(encode(html)) AS h, unnest(range(0, octet_length(encode(html)))) AS i FROM pages WHERE html IS NOT NULL)),
cnt AS (SELECT k, b, count(*)::DOUBLE AS c FROM bytes GROUP BY ALL),
nrm AS (SELECT k, sqrt(sum(c * c)) AS n FROM cnt GROUP BY k),
img AS (SELECT coll.id, list(coalesce(cnt.c / nrm.n, 0)::FLOAT::DOUBLE ORDER BY g.b) AS v,
               bool_and(p.html IS NULL) AS encode_failed
        FROM coll CROSS JOIN (SELECT range AS b FROM range({_IMAGE_BINS})) g LEFT JOIN pages p ON p.page_id = coll.k
        LEFT JOIN cnt ON cnt.k = coll.k AND cnt.b = g.b LEFT JOIN nrm ON nrm.k = coll.k GROUP BY coll.id),
cv AS (SELECT k AS id, v FROM {S.hash_vectors('coll', 'id', 'document', DIM)})"""


def _media_collections(spark, sf):
    """PL2 with the page sources as the products' media bytes (B2)."""
    from shelfspark.session import scratch_path

    cleaned = PL.clean_catalog(PL.catalog_from_tables(spark, sf), F.col("`Uniq Id`").cast("bigint")).withColumn("id", F.col("`Uniq Id`"))
    pages = t(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), F.encode("html", "UTF-8").alias("media"))
    return PL.build_collections(cleaned.join(pages, "id", "left"), scratch_path(spark, "collections"), dim=DIM,
                                image_bins=_IMAGE_BINS, image_bytes="media")


def _media_columns(coll):
    return coll.select("id", "encode_failed", big(F.size("embedding")).alias("dim"), F.round(_digest("embedding"), 4).alias("digest"))


@register("image_collection", _IMAGE_SQL + f"""
SELECT id, encode_failed, len(v)::BIGINT AS dim, round({S.weighted_digest('v')}, 4) AS digest FROM img""")
def image_collection(spark, sf):
    return _media_columns(_media_collections(spark, sf)["image"])


@register("multimodal_collection", _IMAGE_SQL + f"""
SELECT id, encode_failed, len(w)::BIGINT AS dim, round({S.weighted_digest('w')}, 4) AS digest
FROM (SELECT img.id, encode_failed, list_concat(cv.v, img.v) AS w FROM img JOIN cv ON img.id = cv.id)""")
def multimodal_collection(spark, sf):
    return _media_columns(_media_collections(spark, sf)["multimodal"])


@register("answer_batch_routed", """
SELECT 'text' AS route, count(*) AS n FROM conversations WHERE role = 'user' AND turn % 3 = 0
UNION ALL SELECT 'image', count(*) FROM conversations WHERE role = 'user' AND turn % 3 = 1
UNION ALL SELECT 'multimodal', count(*) FROM conversations WHERE role = 'user' AND turn % 3 = 2""")
def answer_batch_routed(spark, sf):
    """PL4 + J2: questions with a text vector, media bytes or both against the three collections."""
    from shelfspark.operators import encode as EN

    colls = _media_collections(spark, sf)
    spaces = {"text": "cosine", "image": "cosine", "multimodal": "l2"}
    given = {n: {"df": c.withColumnRenamed("embedding", "vec"), "space": spaces[n]} for n, c in colls.items()}
    conv = t(spark, sf, "conversations").where("role = 'user'")
    qid = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    qs = EN.hash_encode(conv.select(qid.alias("qid"), "turn", F.col("text").alias("question")), "question", dim=DIM, out="tv")
    media = EN.encode_column(F.encode("question", "UTF-8"), EN.byte_histogram_model(_IMAGE_BINS))
    qs = qs.select("qid", "turn", "question", F.when(F.col("turn") % 3 != 1, F.col("tv")).alias("text_vec"),
                   F.when(F.col("turn") % 3 != 0, media).alias("image_vec"))
    ans = PL.answer_batch(qs, given, K_CHAT, prompt=SHOP_PROMPT).where(F.size("contexts") == K_CHAT)
    turn = F.substring_index("qid", ":", -1).cast("long")
    route = F.when(turn % 3 == 0, "text").when(turn % 3 == 1, "image").otherwise("multimodal")
    return ans.where(F.col("answer") == F.col("prompt")).groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@register("repair_collection", f"""
WITH src AS (SELECT row_number() OVER (ORDER BY e.vec_id) - 1 AS rn, CASE WHEN e.label = 2 THEN NULL ELSE CAST(e.label AS VARCHAR) END AS id, d.text,
                    CASE WHEN e.label = 1 THEN NULL ELSE embedding END AS v
             FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id),
ok AS (SELECT rn, coalesce(id, 'generated_id_' || rn) AS id, text, v FROM src WHERE v IS NOT NULL AND text IS NOT NULL AND {S.strip('text')} <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn) - 1 AS k FROM ok)
SELECT CASE WHEN k > 0 THEN id || '__' || k ELSE id END AS id, md5(text) AS document_md5, len(v)::BIGINT AS length,
       (SELECT count(*) FROM src) AS n_total, (SELECT count_if(id IS NULL) FROM src) AS n_bad_id, (SELECT count_if(v IS NULL) FROM src) AS n_bad_vec
FROM n""")
def repair_collection(spark, sf):
    """PL3 end to end from CSV files with bad ids and vectors: every stored row."""
    from shelfspark.session import scratch_path

    e = t(spark, sf, "embeddings")
    d = t(spark, sf, "documents").select("doc_id", "text")
    # The files hold the rows by vec_id, so a row's place is known to the check.
    rows = (e.join(d, e["vec_id"] == d["doc_id"], "left").repartitionByRange("vec_id").sortWithinPartitions("vec_id").select(
        F.when(F.col("label") != 2, F.col("label").cast("string")).alias("id"), "text",
        F.when(F.col("label") != 1, F.to_json(F.transform("embedding", lambda x: x.cast("double")))).alias("embedding")))
    path = scratch_path(spark, "repair-csv")
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    out = PL.repair_collection(spark, path, scratch_path(spark, "repaired"), "text")
    counts = F.broadcast(out["counts"].select("n_total", "n_bad_id", "n_bad_vec"))
    return (out["collection"].join(counts)
            .select("id", F.md5(F.col("document").cast("binary")).alias("document_md5"), big(F.size("embedding")).alias("length"),
                    "n_total", "n_bad_id", "n_bad_vec"))


@register("fetch_media", """
SELECT page_id, url IS NOT NULL AND length(url) % 5 = 0 AS fetch_failed,
       CASE WHEN length(url) % 5 <> 0 THEN octet_length(encode(upper(url)))::BIGINT END AS n_bytes FROM pages""")
def fetch_media(spark, sf):
    """S14 with a stand-in fetcher: some addresses fail, the others give bytes."""
    def fetcher():
        return lambda urls: [None if u is None or len(u) % 5 == 0 else u.upper().encode() for u in urls]

    got = SC.fetch_media(t(spark, sf, "pages").select("page_id", "url"), "url", fetcher)
    return got.select("page_id", "fetch_failed", big(F.octet_length("content")).alias("n_bytes"))
