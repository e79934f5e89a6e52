"""Registered queries over the driver tables, with their DuckDB oracles.

Every query reads whole tables (or data Spark derives from them) and returns a
DataFrame whose column names and types match the oracle SQL.  Integers are
bigint, ratios and distances are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import text as TX
from shelfspark.functions import vectors as V
from shelfspark.operators import chat as CH
from shelfspark.operators import encode as EN
from shelfspark.operators import evaluation as EV
from shelfspark.operators import identity as ID
from shelfspark.operators import knn as KN
from shelfspark.operators import profile as PR
from shelfspark.plans import pipelines as PL
from shelfspark.plans import sql_text as S
from shelfspark.sources import catalog as SC
from shelfspark.sources import collections as CO

DIM = 64
K_EVAL = 5
K_CHAT = 3
HALF = 32
GUARD_RADIUS = 0.75

Q: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return PL.table(spark, sf, name)


def big(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def digest(c) -> F.Column:
    """sum(x_i * i), i from 1 (same as ``sql_text.weighted_digest``)."""
    v = F.col(c) if isinstance(c, str) else c
    return F.aggregate(F.zip_with(v, F.sequence(F.lit(1), F.size(v)), lambda x, i: x.cast("double") * i),
                       F.lit(0.0).cast("double"), lambda a, b: a + b)


# ---------------------------------------------------------------------------
# §2.3 text

@register("clean_text_pages", f"SELECT page_id, {S.clean_text('html')} AS cleaned FROM pages")
def clean_text_pages(spark, sf):
    return t(spark, sf, "pages").select("page_id", TX.clean_text("html").alias("cleaned"))


@register("clean_text_documents", f"SELECT doc_id, {S.clean_text('text')} AS cleaned FROM documents")
def clean_text_documents(spark, sf):
    return t(spark, sf, "documents").select("doc_id", TX.clean_text("text").alias("cleaned"))


@register("collapse_ws", f"SELECT doc_id, {S.collapse('text')} AS collapsed FROM documents")
def collapse_ws(spark, sf):
    return t(spark, sf, "documents").select("doc_id", TX.collapse_ws("text").alias("collapsed"))


_CATEGORY_PATH = "concat_ws(' | ', p_type, '', p_brand)"


@register("clean_category", f"SELECT p_partkey, {S.clean_category(_CATEGORY_PATH)} AS category FROM part")
def clean_category(spark, sf):
    path = F.concat_ws(" | ", "p_type", F.lit(""), "p_brand")
    return t(spark, sf, "part").select("p_partkey", TX.clean_category(path).alias("category"))


_PRICE_RUN = "replace(regexp_extract(CAST(p_retailprice AS VARCHAR), '[0-9,.]+', 0), ',', '')"


@register("normalize_price",
          f"SELECT p_partkey, CASE WHEN TRY_CAST({_PRICE_RUN} AS DECIMAL(38,10)) IS NULL THEN '' ELSE "
          f"'price: ' || CAST(ROUND(TRY_CAST({_PRICE_RUN} AS DECIMAL(38,10)), 2)::DECIMAL(38,2) AS VARCHAR) "
          f"|| ' USD' END AS price FROM part")
def normalize_price(spark, sf):
    return t(spark, sf, "part").select("p_partkey", TX.normalize_price("p_retailprice").alias("price"))


_DEDUPE_SQL = f"""
WITH pieces AS (
  SELECT doc_id, unnest(L) AS piece, generate_subscripts(L, 1) AS pos
  FROM (SELECT doc_id, {S.sentence_list('text')} AS L FROM documents)),
first_seen AS (SELECT doc_id, piece, min(pos) AS pos FROM pieces GROUP BY ALL)
SELECT d.doc_id, coalesce(string_agg(f.piece, ' ' ORDER BY f.pos), '') AS deduped
FROM documents d LEFT JOIN first_seen f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""


@register("dedupe_sentences", _DEDUPE_SQL)
def dedupe_sentences(spark, sf):
    return t(spark, sf, "documents").select("doc_id", TX.dedupe_sentences("text").alias("deduped"))


# Catalog derived from part (+ documents): the raw-catalog column names.
_CATALOG_SQL = """
catalog AS (
  SELECT CAST(p.p_partkey AS VARCHAR) AS "Uniq Id", p.p_name AS "Product Name",
         concat_ws(' | ', p.p_type, p.p_brand) AS "Category",
         '$' || CAST(p.p_retailprice AS VARCHAR) AS "Selling Price",
         d.text AS "About Product",
         'Size: ' || CAST(p.p_size AS VARCHAR) || '. Brand: ' || p.p_brand || '.' AS "Technical Details",
         'https://img.example.com/' || CAST(p.p_partkey AS VARCHAR) || '/a.jpg|https://img.example.com/'
           || CAST(p.p_partkey AS VARCHAR) || '/b.jpg' AS "Image",
         p.p_partkey AS __key
  FROM part p LEFT JOIN documents d ON p.p_partkey = d.doc_id)
"""


def _search_text_sql() -> str:
    about, tech = S.clean_text('"About Product"'), S.clean_text('"Technical Details"')
    combined = f"concat_ws(' ', CASE WHEN {about} <> '' THEN {about} END, CASE WHEN {tech} <> '' THEN {tech} END)"
    name, cat = S.clean_text('"Product Name"'), S.clean_category('"Category"')
    return f"""
WITH {_CATALOG_SQL},
pieces AS (
  SELECT __key, unnest(L) AS piece, generate_subscripts(L, 1) AS pos
  FROM (SELECT __key, {S.sentence_list(combined)} AS L FROM catalog)),
first_seen AS (SELECT __key, piece, min(pos) AS pos FROM pieces GROUP BY ALL),
merged AS (SELECT c.__key, coalesce(string_agg(f.piece, ' ' ORDER BY f.pos), '') AS m
           FROM catalog c LEFT JOIN first_seen f ON c.__key = f.__key GROUP BY c.__key),
st AS (
  SELECT c.*, concat_ws(' | ',
      CASE WHEN {name} <> '' THEN 'name: ' || {name} END,
      CASE WHEN {cat} <> '' THEN 'category: ' || {cat} END,
      CASE WHEN m.m <> '' THEN 'description: ' || m.m END) AS search_text
  FROM catalog c JOIN merged m ON c.__key = m.__key)
"""


SQL_SEARCH_TEXT = _search_text_sql()


@register("build_search_text", SQL_SEARCH_TEXT + "SELECT __key AS p_partkey, search_text FROM st")
def build_search_text(spark, sf):
    cat = PL.catalog_from_tables(spark, sf)
    st = TX.search_text(name=TX.clean_text("`Product Name`"), category=TX.clean_category("Category"),
                        about=TX.clean_text("`About Product`"), details=TX.clean_text("`Technical Details`"))
    return cat.select(F.col("`Uniq Id`").cast("bigint").alias("p_partkey"), st.alias("search_text"))


@register("clean_catalog", SQL_SEARCH_TEXT + """
SELECT "Uniq Id", "Product Name", "Category", "Selling Price", "About Product", "Technical Details", "Image",
       search_text, string_split("Image", '|')[1] AS image_url, "Uniq Id" AS product_id, "Product Name" AS name,
       (row_number() OVER (ORDER BY __key) - 1)::BIGINT AS id
FROM st""")
def clean_catalog(spark, sf):
    raw = PL.catalog_from_tables(spark, sf)
    return PL.clean_catalog(raw, F.col("`Uniq Id`").cast("bigint"))


@register("first_list_item",
          "SELECT page_id, string_split(url || '|https://mirror.example.com/' || CAST(page_id AS VARCHAR), '|')[1]"
          " AS first_url FROM pages")
def first_list_item(spark, sf):
    p = t(spark, sf, "pages")
    joined = F.concat(F.col("url"), F.lit("|https://mirror.example.com/"), F.col("page_id").cast("string"))
    return p.select("page_id", TX.first_list_item(joined).alias("first_url"))


@register("embed_text", """
SELECT p.p_partkey, coalesce(p.p_name, '') || ' || ' || coalesce(d.text, '') || ' || ' || coalesce(p.p_type, '')
       AS embed_text
FROM part p LEFT JOIN documents d ON p.p_partkey = d.doc_id""")
def embed_text(spark, sf):
    p = t(spark, sf, "part")
    d = t(spark, sf, "documents").select("doc_id", "text")
    j = p.join(d, p["p_partkey"] == d["doc_id"], "left")
    return j.select("p_partkey", TX.embed_text("p_name", "text", "p_type").alias("embed_text"))


@register("token_sets", f"SELECT doc_id, array_to_string(list_sort({S.tokens('text')}), ' ') AS tokens, "
                        f"len({S.tokens('text')})::BIGINT AS n_tokens FROM documents")
def token_sets(spark, sf):
    tok = TX.tokens("text")
    return t(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(tok), " ").alias("tokens"),
                                            big(F.size(tok)).alias("n_tokens"))


# ---------------------------------------------------------------------------
# §2.7 retrieval on embeddings

_EMB = "(SELECT vec_id AS qid, vec_id AS id, embedding AS v FROM embeddings)"


def _emb_topk_sql(k: int, space: str) -> str:
    return (f"SELECT qid, rank::BIGINT AS rank, id, round(distance, 6) AS distance FROM "
            f"({S.topk(_EMB, _EMB, k, space)})")


def _emb_topk(spark, sf, k, space) -> DataFrame:
    e = t(spark, sf, "embeddings")
    hits = KN.knn_join(e, e, k, space, qid="vec_id", qvec="embedding", cid="vec_id", cvec="embedding")
    return hits.select("qid", big("rank").alias("rank"), "id", r6("distance").alias("distance"))


@register("l2_topk", _emb_topk_sql(K_EVAL, "l2"))
def l2_topk(spark, sf):
    return _emb_topk(spark, sf, K_EVAL, "l2")


@register("cosine_topk", _emb_topk_sql(K_EVAL, "cosine"))
def cosine_topk(spark, sf):
    return _emb_topk(spark, sf, K_EVAL, "cosine")


def _strategy(name: str, space: str, strategy: str):
    @register(name, _emb_topk_sql(K_EVAL, space))
    def run(spark, sf):
        e = t(spark, sf, "embeddings")
        hits = KN.knn_join(e, e, K_EVAL, space, qid="vec_id", qvec="embedding", cid="vec_id", cvec="embedding", strategy=strategy)
        return hits.select("qid", big("rank").alias("rank"), "id", r6("distance").alias("distance"))


for _space in ("l2", "cosine"):
    _strategy(f"{_space}_topk_broadcast_queries", _space, "broadcast_queries")
    _strategy(f"{_space}_topk_cells", _space, "cells")


@register("context_blocks", f"""
WITH hits AS ({S.topk(_EMB, _EMB, K_CHAT, 'cosine')}),
blocks AS (
  SELECT h.qid, h.rank, coalesce(d.text, '') ||
         CASE WHEN p.url IS NOT NULL THEN chr(10) || 'Image URL: ' || p.url ELSE '' END AS block
  FROM hits h LEFT JOIN documents d ON h.id = d.doc_id LEFT JOIN pages p ON h.id = p.page_id)
SELECT qid, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM blocks GROUP BY qid""")
def context_blocks(spark, sf):
    e = t(spark, sf, "embeddings")
    hits = KN.knn_join(e, e, K_CHAT, "cosine", qid="vec_id", qvec="embedding", cid="vec_id", cvec="embedding")
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    pages = t(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")
    blocks = (hits.join(docs, "id", "left").join(pages, "id", "left")
                  .withColumn("block", TX.context_block("text", "url")))
    ctx = EV.contexts_by_rank(blocks, "qid", "rank", "block")
    return ctx.select("qid", EV.context_string(F.col("contexts")).alias("context"))


@register("hits_with_metadata", f"""
SELECT h.qid, h.rank::BIGINT AS rank, h.id, round(h.distance, 6) AS distance, d.lang, d.n_chars
FROM ({S.topk(_EMB, _EMB, K_CHAT, 'l2')}) h LEFT JOIN documents d ON h.id = d.doc_id""")
def hits_with_metadata(spark, sf):
    e = t(spark, sf, "embeddings")
    hits = KN.knn_join(e, e, K_CHAT, "l2", qid="vec_id", qvec="embedding", cid="vec_id", cvec="embedding")
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    j = KN.with_documents(hits, docs)
    return j.select("qid", big("rank").alias("rank"), "id", r6("distance").alias("distance"), "lang", "n_chars")


def _routed_sql() -> str:
    q = ("(SELECT vec_id AS qid, CASE WHEN label < 7 THEN embedding[1:32] END AS tv, "
         "CASE WHEN label < 4 OR label >= 7 THEN embedding[33:64] END AS iv FROM embeddings)")
    mm_q = f"(SELECT qid, list_concat(tv, iv) AS v FROM {q} WHERE tv IS NOT NULL AND iv IS NOT NULL)"
    t_q = f"(SELECT qid, tv AS v FROM {q} WHERE tv IS NOT NULL AND iv IS NULL)"
    i_q = f"(SELECT qid, iv AS v FROM {q} WHERE tv IS NULL AND iv IS NOT NULL)"
    mm_c = "(SELECT vec_id AS id, embedding AS v FROM embeddings)"
    t_c = "(SELECT vec_id AS id, embedding[1:32] AS v FROM embeddings)"
    i_c = "(SELECT vec_id AS id, embedding[33:64] AS v FROM embeddings)"
    parts = [(mm_q, mm_c, "l2", "multimodal"), (t_q, t_c, "cosine", "text"), (i_q, i_c, "cosine", "image")]
    return " UNION ALL ".join(
        f"SELECT qid, rank::BIGINT AS rank, id, round(distance, 6) AS distance, '{name}' AS route "
        f"FROM ({S.topk(a, b, K_CHAT, sp)})" for a, b, sp, name in parts)


@register("routed_topk", _routed_sql())
def routed_topk(spark, sf):
    e = t(spark, sf, "embeddings")
    queries = e.select(F.col("vec_id").alias("qid"),
                       F.when(F.col("label") < 7, F.slice("embedding", 1, HALF)).alias("text_vec"),
                       F.when((F.col("label") < 4) | (F.col("label") >= 7),
                              F.slice("embedding", HALF + 1, HALF)).alias("image_vec"))
    colls = {
        "multimodal": {"df": e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "space": "l2"},
        "text": {"df": e.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, HALF).alias("vec")),
                 "space": "cosine"},
        "image": {"df": e.select(F.col("vec_id").alias("id"), F.slice("embedding", HALF + 1, HALF).alias("vec")),
                  "space": "cosine"},
    }
    hits = KN.routed_knn(queries, colls, K_CHAT)
    return hits.select("qid", big("rank").alias("rank"), "id", r6("distance").alias("distance"), "route")


@register("align_on_id", """
SELECT d.doc_id AS id, d.n_chars, len(e.embedding)::BIGINT AS dim, e.label
FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id""")
def align_on_id(spark, sf):
    d = t(spark, sf, "documents")
    e = t(spark, sf, "embeddings")
    j = d.join(e, d["doc_id"] == e["vec_id"])
    return j.select(F.col("doc_id").alias("id"), "n_chars", big(F.size("embedding")).alias("dim"), "label")


@register("contexts_by_rank", f"""
SELECT qid, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS contexts
FROM ({S.topk(_EMB, _EMB, K_EVAL, 'cosine')}) GROUP BY qid""")
def contexts_by_rank(spark, sf):
    e = t(spark, sf, "embeddings")
    hits = KN.knn_join(e, e, K_EVAL, "cosine", qid="vec_id", qvec="embedding", cid="vec_id", cvec="embedding")
    ctx = EV.contexts_by_rank(hits.withColumn("t", F.col("id").cast("string")), "qid", "rank", "t")
    return ctx.select("qid", F.array_join("contexts", ",").alias("contexts"))


@register("answer_guard", f"""
WITH hits AS (SELECT * FROM ({S.topk(_EMB, _EMB, K_CHAT, 'cosine')}) WHERE distance < {GUARD_RADIUS} AND id <> qid),
ctx AS (SELECT h.qid, list(coalesce(d.text, '') ORDER BY h.rank) AS contexts
        FROM hits h LEFT JOIN documents d ON h.id = d.doc_id GROUP BY h.qid)
SELECT e.vec_id AS qid, coalesce(len(ctx.contexts), 0)::BIGINT AS n_contexts,
       CASE WHEN coalesce(len(ctx.contexts), 0) = 0 THEN 'I don''t know.' ELSE array_to_string(ctx.contexts, chr(10) || chr(10)) END AS answer
FROM embeddings e LEFT JOIN ctx ON e.vec_id = ctx.qid""")
def answer_guard(spark, sf):
    e = t(spark, sf, "embeddings")
    hits = KN.knn_join(e, e, K_CHAT, "cosine", qid="vec_id", qvec="embedding", cid="vec_id", cvec="embedding")
    hits = hits.where((F.col("distance") < GUARD_RADIUS) & (F.col("id") != F.col("qid")))
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    # A hit without a stored document contributes an empty context.
    named = KN.with_documents(hits, docs).withColumn("text", F.coalesce("text", F.lit("")))
    ctx = EV.contexts_by_rank(named, "qid", "rank", "text")
    q = e.select(F.col("vec_id").alias("qid")).join(ctx, "qid", "left")
    q = q.withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    ans = EN.generate(q, F.array_join("contexts", PL.EVAL_SEPARATOR), "contexts", EN.echo_model())
    return ans.select("qid", big(F.size("contexts")).alias("n_contexts"), "answer")


# ---------------------------------------------------------------------------
# §2.4 identity

_POS = "(row_number() OVER (ORDER BY doc_id) - 1)"
_RAW_ID = ("CASE WHEN lang = 'de' THEN NULL WHEN lang = 'es' THEN ' nan ' WHEN lang = 'fr' AND n_chars < 200 "
           "THEN '  ' ELSE CAST(doc_id AS VARCHAR) END")


def _raw_ids(spark, sf) -> DataFrame:
    d = t(spark, sf, "documents")
    raw = (F.when(F.col("lang") == "de", F.lit(None).cast("string"))
            .when(F.col("lang") == "es", F.lit(" nan "))
            .when((F.col("lang") == "fr") & (F.col("n_chars") < 200), F.lit("  "))
            .otherwise(F.col("doc_id").cast("string")))
    return d.select("doc_id", raw.alias("id"))


@register("dense_row_id", f"SELECT doc_id, {_POS}::BIGINT AS pos FROM documents")
def dense_row_id(spark, sf):
    return ID.dense_id(t(spark, sf, "documents").select("doc_id"), "doc_id", out="pos")


@register("dense_row_id_null_key", """
SELECT doc_id, (row_number() OVER (ORDER BY k NULLS FIRST) - 1)::BIGINT AS pos
FROM (SELECT doc_id, CASE WHEN doc_id > 0 THEN md5(CAST(doc_id AS VARCHAR)) END AS k FROM documents)""")
def dense_row_id_null_key(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") > 0, F.md5(F.col("doc_id").cast("string").cast("binary"))).alias("k"))
    return ID.dense_id(d, "k", out="pos").select("doc_id", "pos")


@register("fill_generated_id", f"""
SELECT doc_id, CASE WHEN {S.is_blank('raw')} THEN 'generated_id_' || CAST(pos AS VARCHAR) ELSE {S.strip('raw')} END AS id
FROM (SELECT doc_id, {_RAW_ID} AS raw, {_POS} AS pos FROM documents)""")
def fill_generated_id(spark, sf):
    df = ID.dense_id(_raw_ids(spark, sf), "doc_id", out="pos")
    return ID.fill_blank_ids(df, "id", "pos", style="generated").select("doc_id", "id")


@register("fill_position_id", f"""
SELECT doc_id, CASE WHEN {S.is_blank('raw')} THEN CAST(pos AS VARCHAR) ELSE {S.strip('raw')} END AS id
FROM (SELECT doc_id, {_RAW_ID} AS raw, {_POS} AS pos FROM documents)""")
def fill_position_id(spark, sf):
    df = ID.dense_id(_raw_ids(spark, sf), "doc_id", out="pos")
    return ID.fill_blank_ids(df, "id", "pos", style="position").select("doc_id", "id")


@register("suffix_duplicate_ids", """
SELECT p_partkey, CASE WHEN k > 0 THEN p_name || '__' || CAST(k AS VARCHAR) ELSE p_name END AS id
FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)""")
def suffix_duplicate_ids(spark, sf):
    p = ID.dense_id(t(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", out="pos")
    out = ID.suffix_duplicates(p, "p_name", "pos", out="id")
    return out.select("p_partkey", "id")


@register("suffix_duplicate_ids_twice", """
WITH raw AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '__1' ELSE p_brand END AS id FROM part),
one AS (SELECT p_partkey, CASE WHEN k > 0 THEN id || '__' || k ELSE id END AS id
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey) - 1 AS k FROM raw)),
two AS (SELECT p_partkey, CASE WHEN k > 0 THEN id || '__' || k ELSE id END AS id
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey) - 1 AS k FROM one)),
three AS (SELECT p_partkey, CASE WHEN k > 0 THEN id || '__' || k ELSE id END AS id
          FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey) - 1 AS k FROM two))
SELECT * FROM three""")
def suffix_duplicate_ids_twice(spark, sf):
    """Ids that end in a suffix from the start meet generated ones, and those meet others."""
    p = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("__1")))
                                    .otherwise(F.col("p_brand")).alias("id"))
    out = ID.suffix_duplicates(ID.dense_id(p, "p_partkey", out="pos"), "id", "pos")
    return out.select("p_partkey", "id")


@register("md5_synthetic_id", """
SELECT p_partkey, substr(md5(coalesce(p_name, '') || '|' || coalesce(p_type, '') || '|' || CAST(pos AS VARCHAR)), 1, 16) AS id
FROM (SELECT p_partkey, p_name, p_type, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part)""")
def md5_synthetic_id(spark, sf):
    p = ID.dense_id(t(spark, sf, "part"), "p_partkey", out="pos").withColumn("id", F.lit(None).cast("string"))
    return ID.fill_blank_ids(p, "id", "pos", style="md5", title="p_name", category="p_type").select("p_partkey", "id")


@register("dedupe_keep_first", """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1""")
def dedupe_keep_first(spark, sf):
    return ID.keep_first(t(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@register("dedupe_keep_first_part", """
SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn
FROM part) WHERE rn = 1""")
def dedupe_keep_first_part(spark, sf):
    return ID.keep_first(t(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@register("valid_rows", f"""
SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
WHERE NOT {S.is_blank('CAST(d.doc_id AS VARCHAR)')} AND d.text IS NOT NULL AND {S.strip('d.text')} <> ''
  AND e.embedding IS NOT NULL AND len(e.embedding) > 0""")
def valid_rows(spark, sf):
    d = t(spark, sf, "documents")
    e = t(spark, sf, "embeddings")
    j = d.join(e, d["doc_id"] == e["vec_id"], "left").withColumn("id", F.col("doc_id").cast("string"))
    return j.where(ID.valid_rows("id", "text", "embedding")).select("doc_id")


# ---------------------------------------------------------------------------
# §2.5 vectors

_JSON_TEXT = "CAST(list_transform(embedding, lambda x: x::DOUBLE) AS VARCHAR)"
_TRUNC_TEXT = "'[' || array_to_string(list_transform(embedding[1:32], lambda x: CAST(x::DOUBLE AS VARCHAR)), ', ')"
_PARSE_SQL = f"""
WITH texts AS (
  SELECT vec_id, 'json' AS variant, {_JSON_TEXT} AS s FROM embeddings
  UNION ALL SELECT vec_id, 'quoted', '"' || {_JSON_TEXT} || '"' FROM embeddings
  UNION ALL SELECT vec_id, 'truncated', {_TRUNC_TEXT} FROM embeddings),
parsed AS (
  SELECT vec_id, variant, coalesce(
     CASE WHEN len(TRY_CAST(body AS DOUBLE[])) > 0 THEN TRY_CAST(body AS DOUBLE[]) END,
     CASE WHEN len(regexp_extract_all(body, '([-+]?(?:[0-9]*\\.[0-9]+|[0-9]+)(?:[eE][-+]?[0-9]+)?)', 1)) > 0
          THEN list_transform(regexp_extract_all(body, '([-+]?(?:[0-9]*\\.[0-9]+|[0-9]+)(?:[eE][-+]?[0-9]+)?)', 1),
                              lambda x: x::DOUBLE) END) AS v
  FROM (SELECT vec_id, variant, CASE WHEN s LIKE '"%"' THEN {S.strip("s[2:-2]")} ELSE s END AS body FROM texts))
SELECT vec_id, variant, len(v)::BIGINT AS dim, round({S.weighted_digest('v')}, 6) AS digest FROM parsed"""


@register("parse_vector", _PARSE_SQL)
def parse_vector(spark, sf):
    e = t(spark, sf, "embeddings")
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    json_text = F.to_json(as_double)
    trunc = F.concat(F.lit("["), F.array_join(F.transform(F.slice("embedding", 1, HALF),
                                                          lambda x: x.cast("double").cast("string")), ", "))
    texts = (e.select("vec_id", F.lit("json").alias("variant"), json_text.alias("s"))
              .unionByName(e.select("vec_id", F.lit("quoted").alias("variant"),
                                    F.concat(F.lit('"'), json_text, F.lit('"')).alias("s")))
              .unionByName(e.select("vec_id", F.lit("truncated").alias("variant"), trunc.alias("s"))))
    parsed = texts.withColumn("v", V.parse_vector("s"))
    return parsed.select("vec_id", "variant", big(F.size("v")).alias("dim"), r6(digest("v")).alias("digest"))


@register("concat_vectors", f"""
SELECT vec_id, len(v)::BIGINT AS dim, round({S.weighted_digest('v')}, 6) AS digest
FROM (SELECT vec_id, list_concat(embedding[1:32], embedding[33:64]) AS v FROM embeddings)""")
def concat_vectors(spark, sf):
    e = t(spark, sf, "embeddings")
    v = V.concat_vectors(F.slice("embedding", 1, HALF), F.slice("embedding", HALF + 1, HALF))
    return e.select("vec_id", big(F.size(v)).alias("dim"), r6(digest(v)).alias("digest"))


@register("vector_dims", """
SELECT count(*) AS n, min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim
FROM embeddings WHERE embedding IS NOT NULL""")
def vector_dims(spark, sf):
    return V.vector_dims(t(spark, sf, "embeddings"), "embedding")


@register("l2_normalize", f"""
SELECT vec_id, len(n)::BIGINT AS dim, round({S.weighted_digest('n')}, 6) AS digest, round({S.norm('n')}, 6) AS norm
FROM (SELECT vec_id, CASE WHEN {S.norm('s')} > 0 THEN list_transform(s, lambda x: x::DOUBLE / {S.norm('s')})
                          ELSE {S.dvec('s')} END AS n
      FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + label)) AS s FROM embeddings))""")
def l2_normalize(spark, sf):
    e = t(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    n = V.l2_normalize(scaled)
    return e.select("vec_id", big(F.size(n)).alias("dim"), r6(digest(n)).alias("digest"), r6(V.norm(n)).alias("norm"))


@register("zero_fill", f"""
SELECT vec_id, v IS NULL AS encode_failed, len(coalesce(v, list_transform(range(64), lambda i: 0.0::FLOAT)))::BIGINT AS dim,
       round(coalesce({S.norm('v')}, 0.0), 6) AS norm
FROM (SELECT vec_id, CASE WHEN label = 3 THEN NULL ELSE embedding END AS v FROM embeddings)""")
def zero_fill(spark, sf):
    e = t(spark, sf, "embeddings")
    v = F.when(F.col("label") == 3, F.lit(None)).otherwise(F.col("embedding"))
    filled = V.zero_fill(v, DIM)
    return e.select("vec_id", v.isNull().alias("encode_failed"), big(F.size(filled)).alias("dim"),
                    r6(V.norm(filled)).alias("norm"))


@register("hash_encode", f"""
SELECT k AS doc_id, len(v)::BIGINT AS dim, round({S.weighted_digest('v')}, 6) AS digest
FROM {S.hash_vectors('documents', 'doc_id', 'text', DIM)}""")
def hash_encode(spark, sf):
    d = EN.hash_encode(t(spark, sf, "documents").select("doc_id", "text"), "text", dim=DIM)
    return d.select("doc_id", big(F.size("vec")).alias("dim"), r6(digest("vec")).alias("digest"))


# ---------------------------------------------------------------------------
# §2.8 profiling

_FAULTY = f"""
faulty AS (
  SELECT e.vec_id, CASE WHEN e.label = 2 THEN NULL ELSE CAST(e.vec_id AS VARCHAR) END AS id, d.text,
         CASE WHEN e.label = 0 THEN {_TRUNC_TEXT.replace('embedding', 'e.embedding')}
              WHEN e.label = 1 THEN 'nan'
              ELSE {_JSON_TEXT.replace('embedding', 'e.embedding')} END AS vec_text
  FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id)"""


def _faulty(spark, sf) -> DataFrame:
    e = t(spark, sf, "embeddings")
    d = t(spark, sf, "documents").select("doc_id", "text")
    j = e.join(d, e["vec_id"] == d["doc_id"], "left")
    trunc = F.concat(F.lit("["), F.array_join(F.transform(F.slice("embedding", 1, HALF),
                                                          lambda x: x.cast("double").cast("string")), ", "))
    vt = (F.when(F.col("label") == 0, trunc).when(F.col("label") == 1, F.lit("nan"))
           .otherwise(F.to_json(F.transform("embedding", lambda x: x.cast("double")))))
    return j.select("vec_id", F.when(F.col("label") == 2, F.lit(None).cast("string"))
                    .otherwise(F.col("vec_id").cast("string")).alias("id"), "text", vt.alias("vec_text"))


_PARSE_EXPR = ("coalesce(CASE WHEN len(TRY_CAST(vec_text AS DOUBLE[])) > 0 THEN TRY_CAST(vec_text AS DOUBLE[]) END, "
               "CASE WHEN len(regexp_extract_all(vec_text, '([-+]?(?:[0-9]*\\.[0-9]+|[0-9]+)(?:[eE][-+]?[0-9]+)?)', 1)) > 0 "
               "THEN list_transform(regexp_extract_all(vec_text, '([-+]?(?:[0-9]*\\.[0-9]+|[0-9]+)(?:[eE][-+]?[0-9]+)?)', 1), "
               "lambda x: x::DOUBLE) END)")
_PARSE_FAULTY = f"CASE WHEN {S.is_blank('vec_text')} THEN NULL ELSE {_PARSE_EXPR} END"


@register("quality_counts", f"""
WITH {_FAULTY}, parsed AS (SELECT id, text, {_PARSE_FAULTY} AS v FROM faulty)
SELECT count(*) AS n_total, count_if({S.is_blank('id')}) AS n_bad_id,
       count_if(text IS NULL OR {S.strip('text')} = '') AS n_bad_text,
       count_if(v IS NULL OR len(v) = 0) AS n_bad_vec
FROM parsed""")
def quality_counts(spark, sf):
    f = _faulty(spark, sf).withColumn("v", V.parse_vector("vec_text"))
    return PR.quality_counts(f, "id", "text", "v")


@register("repair_embeddings", f"""
WITH {_FAULTY},
pos AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM faulty),
parsed AS (SELECT vec_id, p, CASE WHEN {S.is_blank('id')} THEN 'generated_id_' || CAST(p AS VARCHAR)
                                  ELSE {S.strip('id')} END AS id,
                  text, {_PARSE_FAULTY} AS v FROM pos),
valid AS (SELECT * FROM parsed WHERE NOT {S.is_blank('id')} AND text IS NOT NULL AND {S.strip('text')} <> ''
          AND v IS NOT NULL AND len(v) > 0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS k FROM valid)
SELECT CASE WHEN k > 0 THEN id || '__' || k ELSE id END AS id, vec_id, len(v)::BIGINT AS dim,
       round({S.weighted_digest('v')}, 6) AS digest FROM firsts""")
def repair_embeddings(spark, sf):
    out = PL.repair_embeddings(_faulty(spark, sf), "id", "text", "vec_text", "vec_id")
    return out.select("id", "vec_id", big(F.size("embedding")).alias("dim"), r6(digest("embedding")).alias("digest"))


def _empty_profile_sql() -> str:
    parts = []
    for table, cols, missing in (("documents", ["text", "lang", "source"], ["title"]),
                                 ("pages", ["url", "html"], [])):
        for c in cols:
            parts.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, "
                         f"count_if({S.is_blank(f'CAST({c} AS VARCHAR)')}) AS n_empty, count(*) AS n_rows, "
                         f"true AS present FROM {table}")
        for c in missing:
            parts.append(f"SELECT '{table}', '{c}', 0::BIGINT, 0::BIGINT, false")
    return " UNION ALL ".join(parts)


@register("empty_profile", _empty_profile_sql())
def empty_profile(spark, sf):
    d = PR.empty_profile(t(spark, sf, "documents"), ["text", "lang", "source", "title"])
    p = PR.empty_profile(t(spark, sf, "pages"), ["url", "html"])
    return (d.withColumn("table_name", F.lit("documents"))
             .unionByName(p.withColumn("table_name", F.lit("pages")))
             .select("table_name", "column_name", F.coalesce("n_empty", F.lit(0)).alias("n_empty"),
                     F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "present"))


@register("vector_length_hist", f"""
SELECT length, n_rows FROM (
  SELECT len(regexp_extract_all(lower(coalesce(text, '')), '({S.WORD}+)', 1))::BIGINT AS length, count(*) AS n_rows
  FROM documents GROUP BY 1) ORDER BY n_rows DESC, length ASC LIMIT 5""")
def vector_length_hist(spark, sf):
    d = t(spark, sf, "documents")
    words = F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"({TX.WORD}+)"), 1))
    return PR.length_histogram(d, words, 5)


@register("embedding_length_hist", """
SELECT length, n_rows FROM (SELECT len(embedding)::BIGINT AS length, count(*) AS n_rows FROM embeddings
WHERE embedding IS NOT NULL GROUP BY 1) ORDER BY n_rows DESC, length ASC LIMIT 5""")
def embedding_length_hist(spark, sf):
    return PR.length_histogram(t(spark, sf, "embeddings"), F.size("embedding"), 5)


@register("duplicate_counts", """
SELECT count(*) AS n_rows, count(DISTINCT text) AS n_unique, count(*) - count(DISTINCT text) AS n_duplicates
FROM documents""")
def duplicate_counts(spark, sf):
    return PR.duplicate_counts(t(spark, sf, "documents"), "text")


@register("widest_text_column", """
SELECT column_name, round(mean_length, 6) AS mean_length,
       row_number() OVER (ORDER BY round(mean_length, 6) DESC, column_name) = 1 AS is_widest
FROM (SELECT 'text' AS column_name, avg(length(text)) AS mean_length FROM documents
      UNION ALL SELECT 'lang', avg(length(lang)) FROM documents
      UNION ALL SELECT 'source', avg(length(source)) FROM documents)""")
def widest_text_column(spark, sf):
    return PR.widest_text_column(t(spark, sf, "documents"), ["text", "lang", "source"])


# ---------------------------------------------------------------------------
# sources

@register("cap_first_n", f"SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT {PL.EVAL_CAP}")
def cap_first_n(spark, sf):
    return SC.cap_first_n(t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", PL.EVAL_CAP)


_RECORDS_SQL = f"""
records AS (
  SELECT {S.collapse('"Uniq Id"')} AS id, {S.collapse('"Product Name"')} AS "Title",
         {S.collapse('"About Product"')} AS "Description", {S.collapse('"Category"')} AS "Category",
         CASE WHEN "Image" IS NOT NULL THEN {S.collapse('"Image"')} END AS image_url, __key
  FROM catalog)"""


def _records(spark, sf) -> DataFrame:
    cat = PL.catalog_from_tables(spark, sf)
    cols = SC.resolve_columns(cat.drop("Uniq Id").withColumnRenamed("Selling Price", "price"),
                              {"title": SC.TITLE_CANDIDATES, "description": SC.DESCRIPTION_CANDIDATES,
                               "category": SC.CATEGORY_CANDIDATES, "image": SC.IMAGE_CANDIDATES})
    rec = SC.product_records(cat, "Uniq Id", cols["title"], cols["description"], cols["category"], cols["image"])
    return rec.withColumn("__key", F.col("id").cast("bigint"))


@register("product_records", f"WITH {_CATALOG_SQL}, {_RECORDS_SQL} SELECT id, \"Title\", \"Description\", "
                             f"\"Category\", image_url FROM records")
def product_records(spark, sf):
    return _records(spark, sf).drop("__key")


@register("json_roundtrip", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def json_roundtrip(spark, sf):
    from shelfspark.session import scratch_path

    path = scratch_path(spark, "json-roundtrip")
    part = t(spark, sf, "part")
    SC.write_json_records(part, path)
    back = SC.read_json_records(spark, path, part.schema)
    return back.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@register("csv_roundtrip", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size
FROM part""")
def csv_roundtrip(spark, sf):
    from shelfspark.session import scratch_path

    path = scratch_path(spark, "csv-roundtrip")
    part = t(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    part.write.option("header", True).option("escape", '"').csv(path)
    return SC.read_catalog(spark, path, ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


@register("embedding_json_roundtrip", f"""
SELECT vec_id, len(embedding)::BIGINT AS dim, round({S.weighted_digest('embedding')}, 6) AS digest FROM embeddings""")
def embedding_json_roundtrip(spark, sf):
    from shelfspark.session import scratch_path

    path = scratch_path(spark, "embedding-csv")
    SC.embeddings_to_csv(t(spark, sf, "embeddings").select("vec_id", "embedding"), path)
    back = SC.read_catalog(spark, path, ["vec_id", "embedding"])
    v = V.to_float32(V.parse_vector("embedding"))
    return back.select(big("vec_id").alias("vec_id"), big(F.size(v)).alias("dim"), r6(digest(v)).alias("digest"))


@register("upsert_merge", """
WITH new AS (SELECT p_partkey, upper(p_name) AS p_name, p_size FROM part WHERE p_size > 25)
SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM new)
UNION ALL SELECT * FROM new""")
def upsert_merge(spark, sf):
    part = t(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    new = part.where(F.col("p_size") > 25).withColumn("p_name", F.upper("p_name"))
    return CO.merge_upsert(part, new, "p_partkey", "p_partkey")


# ---------------------------------------------------------------------------
# §2.11 evaluation

@register("hash_sample", f"""
SELECT doc_id, (row_number() OVER (ORDER BY md5('{PL.EVAL_SAMPLE_SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1)::BIGINT
       AS sample_idx
FROM documents ORDER BY md5('{PL.EVAL_SAMPLE_SEED}:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT {PL.EVAL_SAMPLE_SIZE}""")
def hash_sample(spark, sf):
    d = t(spark, sf, "documents").select("doc_id")
    return EV.hash_sample(d, "doc_id", PL.EVAL_SAMPLE_SIZE, PL.EVAL_SAMPLE_SEED)


def _qa_sql(source: str, key: str) -> str:
    t_ = S.strip("coalesce(\"Title\", '')")
    c_ = S.strip("coalesce(\"Category\", '')")
    d_ = f"substring({S.strip(chr(34) + 'Description' + chr(34))}, 1, 250)"
    return f"""
cands AS (
  SELECT {key}, 0 AS o, 'What is the product name?' AS question, {t_} AS ground_truth FROM {source}
  UNION ALL SELECT {key}, 1, 'What is the product category?', {c_} FROM {source}
  UNION ALL SELECT {key}, 2, 'Briefly describe the product.', {d_} FROM {source}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY o) AS rn FROM cands WHERE ground_truth <> ''),
kept AS (SELECT * EXCLUDE (rn), rn - 1 AS q_index FROM ranked WHERE rn <= 2)"""


@register("qa_pairs", f"""
WITH {_CATALOG_SQL}, {_RECORDS_SQL}, {_qa_sql('records', '__key')}
SELECT __key AS p_partkey, q_index::BIGINT AS q_index, question, ground_truth FROM kept""")
def qa_pairs(spark, sf):
    rec = _records(spark, sf).withColumnRenamed("__key", "p_partkey")
    return EV.qa_pairs(rec, "Title", "Description", "Category", keep=["p_partkey"])


@register("eval_pairs", f"""
WITH {_CATALOG_SQL}, {_RECORDS_SQL},
capped AS (SELECT * FROM records ORDER BY __key LIMIT {PL.EVAL_CAP}),
sampled AS (SELECT *, row_number() OVER (ORDER BY md5('{PL.EVAL_SAMPLE_SEED}:' || CAST(__key AS VARCHAR)), __key) - 1
                      AS sample_idx
            FROM capped ORDER BY md5('{PL.EVAL_SAMPLE_SEED}:' || CAST(__key AS VARCHAR)), __key LIMIT {PL.EVAL_SAMPLE_SIZE}),
withpid AS (SELECT *, CASE WHEN {S.is_blank('id')} THEN substr(md5(coalesce("Title", '') || '|' || coalesce("Category", '')
                      || '|' || CAST(sample_idx AS VARCHAR)), 1, 16) ELSE {S.strip('id')} END AS pid FROM sampled),
{_qa_sql('withpid', 'pid')}
SELECT pid, q_index::BIGINT AS q_index, question, ground_truth FROM kept""")
def eval_pairs(spark, sf):
    rec = _records(spark, sf)
    pairs = PL.evaluation_pairs(rec, "__key")
    return pairs.select("pid", "q_index", "question", "ground_truth")


_PAIRS_SQL = """
pairs AS (
  SELECT conv_id, turn, text AS question,
         CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS reply, role
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def _pairs(spark, sf) -> DataFrame:
    return CH.turn_pairs(t(spark, sf, "conversations"))


@register("turn_pairs", f"WITH {_PAIRS_SQL} SELECT conv_id, turn, question, reply FROM pairs WHERE role = 'user'")
def turn_pairs(spark, sf):
    return _pairs(spark, sf)


@register("answer_f1", f"""
WITH {_PAIRS_SQL}
SELECT conv_id, turn, round({S.f1(S.tokens('question'), S.tokens('reply'))}, 6) AS answer_f1
FROM pairs WHERE role = 'user'""")
def answer_f1(spark, sf):
    p = _pairs(spark, sf)
    return p.select("conv_id", "turn", r6(EV.f1_tokens(F.col("question"), F.col("reply"))).alias("answer_f1"))


@register("worst_answers", f"""
WITH {_PAIRS_SQL}
SELECT conv_id, turn, round({S.f1(S.tokens('question'), S.tokens('reply'))}, 6) AS f1_lex
FROM pairs WHERE role = 'user'
ORDER BY {S.f1(S.tokens('question'), S.tokens('reply'))}, conv_id, turn LIMIT 5""")
def worst_answers(spark, sf):
    p = _pairs(spark, sf).withColumn("f1_lex", EV.f1_tokens(F.col("question"), F.col("reply")))
    return EV.worst(p, 5, ["conv_id", "turn"]).select("conv_id", "turn", r6("f1_lex").alias("f1_lex"))


@register("harmonize_eval", f"""
WITH {_PAIRS_SQL}
SELECT conv_id, turn,
       CASE WHEN reply IS NOT NULL AND reply <> '' THEN reply ELSE '' END AS reference,
       CASE WHEN reply IS NOT NULL AND reply <> '' THEN 1 ELSE 0 END::BIGINT AS n_truths,
       coalesce(question, 'None') AS contexts
FROM pairs WHERE role = 'user'""")
def harmonize_eval(spark, sf):
    p = _pairs(spark, sf).select("conv_id", "turn", F.col("reply").alias("ground_truths"),
                                 F.array("question").alias("contexts"))
    h = EV.harmonize(p)
    return h.select("conv_id", "turn", "reference", big(F.size("ground_truths")).alias("n_truths"),
                    F.array_join("contexts", "\n").alias("contexts"))


@register("f1_lex", f"""
WITH truths AS (SELECT conv_id, list(text ORDER BY turn) AS gts FROM conversations WHERE role = 'user' GROUP BY conv_id),
answers AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS answer FROM conversations
            WHERE role = 'assistant' GROUP BY conv_id)
SELECT t.conv_id, round({S.f1(S.tokens("array_to_string(t.gts, ' ')"), S.tokens("coalesce(a.answer, '')"))}, 6) AS f1_lex
FROM truths t LEFT JOIN answers a ON t.conv_id = a.conv_id""")
def f1_lex(spark, sf):
    """E9 per conversation: user turns as ground truths, assistant turns as the
    answer; token sets come from a distributed overlap, never one big row."""
    c = t(spark, sf, "conversations")
    sizes = EV.token_set_overlap(c, "conv_id", "role", "text", "user", "assistant")
    users = c.where(F.col("role") == "user").select("conv_id").distinct()
    j = users.join(sizes, "conv_id", "left")
    f1 = EV.f1_from_sizes(F.col("n_left"), F.col("n_right"), F.col("n_both"))
    return j.select("conv_id", r6(f1).alias("f1_lex"))


_BENCH_RETRIEVAL_SQL = f"""
bq AS (SELECT k AS qid, v FROM {S.hash_vectors('benchmark', 'item_id', 'text', DIM)}),
dc AS (SELECT k AS id, v FROM {S.hash_vectors('documents', 'doc_id', 'text', DIM)}),
hits AS ({S.topk('bq', 'dc', K_CHAT, 'cosine')}),
ctx AS (SELECT h.qid, string_agg(coalesce(d.text, ''), ' ' ORDER BY h.rank) AS ctx_text
        FROM hits h LEFT JOIN documents d ON h.id = d.doc_id GROUP BY h.qid)"""


def _bench_contexts(spark, sf) -> DataFrame:
    b = EN.hash_encode(t(spark, sf, "benchmark"), "text", dim=DIM)
    docs = t(spark, sf, "documents").select("doc_id", "text")
    dv = EN.hash_encode(docs, "text", dim=DIM)
    hits = KN.knn_join(b, dv, K_CHAT, "cosine", qid="item_id", qvec="vec", cid="doc_id", cvec="vec", dim=DIM)
    named = KN.with_documents(hits, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t"))) \
              .withColumn("t", F.coalesce("t", F.lit("")))
    ctx = EV.contexts_by_rank(named, "qid", "rank", "t")
    return ctx.select("qid", F.array_join("contexts", " ").alias("ctx_text"))


@register("context_recall", f"""
WITH {_BENCH_RETRIEVAL_SQL}
SELECT b.item_id, round({S.ratio_in(S.tokens('c.ctx_text'), S.tokens('b.text'))}, 6) AS context_recall
FROM benchmark b LEFT JOIN ctx c ON b.item_id = c.qid""")
def context_recall(spark, sf):
    b = t(spark, sf, "benchmark")
    ctx = _bench_contexts(spark, sf)
    j = b.join(ctx, b["item_id"] == ctx["qid"], "left")
    return j.select("item_id", r6(EV.recall_tokens(F.col("text"), F.coalesce("ctx_text", F.lit(""))))
                    .alias("context_recall"))


@register("context_precision", f"""
WITH {_BENCH_RETRIEVAL_SQL}
SELECT b.item_id, round({S.ratio_in(S.tokens('c.ctx_text'), S.tokens('d.text'))}, 6) AS context_precision
FROM benchmark b LEFT JOIN ctx c ON b.item_id = c.qid LEFT JOIN documents d ON b.item_id = d.doc_id""")
def context_precision(spark, sf):
    b = t(spark, sf, "benchmark").select("item_id")
    ctx = _bench_contexts(spark, sf)
    ans = t(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("answer"))
    j = b.join(ctx, b["item_id"] == ctx["qid"], "left").join(ans, "item_id", "left")
    return j.select("item_id", r6(EV.precision_tokens(F.coalesce("answer", F.lit("")),
                                                      F.coalesce("ctx_text", F.lit("")))).alias("context_precision"))


@register("hit_rate_at_k", f"""
WITH hits AS ({S.topk(_EMB, _EMB, K_EVAL + 1, 'cosine')}),
per_q AS (SELECT h.qid, max(CASE WHEN h.id <> h.qid AND eq.label = ec.label THEN 1 ELSE 0 END) AS hit
          FROM hits h JOIN embeddings eq ON h.qid = eq.vec_id JOIN embeddings ec ON h.id = ec.vec_id GROUP BY h.qid)
SELECT round(avg(hit), 6) AS hit_rate, count(*) AS n_queries FROM per_q""")
def hit_rate_at_k(spark, sf):
    e = t(spark, sf, "embeddings")
    hits = KN.knn_join(e, e, K_EVAL + 1, "cosine", qid="vec_id", qvec="embedding", cid="vec_id", cvec="embedding")
    labels = e.select(F.col("vec_id").alias("id"), F.col("label").alias("hit_label"))
    own = e.select(F.col("vec_id").alias("qid"), F.col("label").alias("q_label"))
    # A hit counts when a neighbour other than the query itself has the query's label.
    h = (hits.where(F.col("id") != F.col("qid")).join(labels, "id").join(own, "qid")
             .where(F.col("hit_label") == F.col("q_label")).select("qid", F.col("q_label").alias("id")))
    truth = own.select("qid", F.col("q_label").alias("id"))
    return EV.hit_rate(h, truth).select(r6("hit_rate").alias("hit_rate"), "n_queries")


@register("retrieve_distinct_join_back", f"""
WITH {_CATALOG_SQL}, {_RECORDS_SQL}, {_qa_sql('records', '__key')},
qs AS (SELECT DISTINCT question FROM kept),
qk AS (SELECT question, row_number() OVER (ORDER BY question) - 1 AS qid FROM qs),
qv AS (SELECT qid, v FROM {S.hash_vectors('qk', 'qid', 'question', DIM)} h JOIN qk ON h.k = qk.qid),
dc AS (SELECT k AS id, v FROM {S.hash_vectors('documents', 'doc_id', 'text', DIM)}),
hits AS ({S.topk('qv', 'dc', K_EVAL, 'cosine')})
SELECT kp.__key AS p_partkey, kp.q_index::BIGINT AS q_index, h.rank::BIGINT AS rank, h.id
FROM kept kp JOIN qk ON kp.question = qk.question JOIN hits h ON h.qid = qk.qid""")
def retrieve_distinct_join_back(spark, sf):
    pairs = EV.qa_pairs(_records(spark, sf).withColumnRenamed("__key", "p_partkey"), "Title", "Description",
                        "Category", keep=["p_partkey"])
    docs = EN.hash_encode(t(spark, sf, "documents").select("doc_id", "text"), "text", dim=DIM)

    def enc(df, col):
        return EN.hash_encode(df, col, dim=DIM, out="vec")

    hits = KN.knn_distinct_queries(pairs.select("p_partkey", "q_index", "question"), "question", enc, docs, K_EVAL, "cosine",
                                   by=["p_partkey"], cid="doc_id", cvec="vec", dim=DIM)
    return hits.select("p_partkey", "q_index", big("rank").alias("rank"), "id")


# ---------------------------------------------------------------------------
# §2.12 chat

@register("chat_threads", f"""
WITH kept AS (SELECT * FROM conversations WHERE text IS NOT NULL AND {S.strip('text')} <> ''),
flag AS (SELECT *, role = 'user' AND (lag(role) OVER w IS NULL OR lag(role) OVER w = 'assistant') AS is_reset
         FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, is_reset,
       sum(CASE WHEN is_reset THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS thread
FROM flag""")
def chat_threads(spark, sf):
    th = CH.threads(t(spark, sf, "conversations"))
    return th.select("conv_id", "turn", "role", "is_reset", "thread")


@register("chat_transcript", f"""
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '**You:**' ELSE '**Assistant:**' END || ' ' || text,
                           chr(10) ORDER BY turn) AS transcript, count(*)::BIGINT AS n_lines
FROM conversations WHERE text IS NOT NULL AND {S.strip('text')} <> '' GROUP BY conv_id""")
def chat_transcript(spark, sf):
    return CH.transcript(t(spark, sf, "conversations"))


def _prompt_sql() -> str:
    tmpl = PL.EVAL_PROMPT
    a, rest = tmpl.split("{context}")
    b, c = rest.split("{question}")
    return (f"WITH {_PAIRS_SQL} SELECT conv_id, turn, {S.lit(a)} || coalesce(reply, '') || {S.lit(b)} || "
            f"coalesce(question, '') || {S.lit(c)} AS prompt FROM pairs WHERE role = 'user'")


@register("render_prompt", _prompt_sql())
def render_prompt(spark, sf):
    p = _pairs(spark, sf)
    return p.select("conv_id", "turn",
                    TX.render_prompt(PL.EVAL_PROMPT, context="reply", question="question").alias("prompt"))


# ---------------------------------------------------------------------------
# §2.13 sessions (batch form of the streaming operator)

@register("session_counts", """
WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 10 MINUTE THEN 1 ELSE 0 END)
          OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(max(ts) + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS n_events
FROM s GROUP BY user_id, sid""")
def session_counts(spark, sf):
    from shelfspark.streaming.incremental import sessions_batch

    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    s = sessions_batch(t(spark, sf, "events"))
    # Times as ISO text with microseconds: identical rendering in both engines.
    return s.select("user_id", F.date_format("session_start", fmt).alias("session_start"),
                    F.date_format("session_end", fmt).alias("session_end"), "n_events")
