"""End-to-end pipelines (PL1-PL5) composed from the operators.

Each pipeline is one lazy plan; callers decide where results are written.
``catalog_from_tables`` derives a product catalog with the raw catalog's column
names from the driver tables (``part`` for products, ``documents`` for long
descriptions), so the pipelines run on data whose size grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import text as TX
from shelfspark.functions import vectors as V
from shelfspark.operators import encode as EN
from shelfspark.operators import evaluation as EV
from shelfspark.operators import identity as ID
from shelfspark.operators import knn as KN
from shelfspark.sources import catalog as SC

# Fixed value: the evaluation answer prompt.
EVAL_PROMPT = """You are a precise product assistant. Answer the question using ONLY the context.
If the answer is not present, say 'I don't know'.

Context:
{context}

Question: {question}
Answer (concise factual):"""
EVAL_SAMPLE_SEED = 42
EVAL_SAMPLE_SIZE = 50
EVAL_CAP = 2000
EVAL_TOP_K = 5
CHAT_TOP_K = 3


MAX_SPREAD_SPLITS = 64


def spread_small_scan(df: DataFrame, max_splits: int = MAX_SPREAD_SPLITS) -> DataFrame:
    """Rebalance a *small* scan that has fewer partitions than the cluster has cores.

    Text, vector and UDF work is CPU-bound; a small file with one row group (or
    a small table streamed through a broadcast join) would otherwise run in a
    single task.  Only scans with at most ``max_splits`` splits (a few GB at
    the default split size) are rebalanced, so large inputs are never shuffled
    just to spread them.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    if n < target and n <= max_splits:
        return df.repartition(min(target, max_splits * 4))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_small_scan(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def catalog_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-catalog-shaped table: one product per ``part`` row, description from
    the document with the same key (left join), all columns strings."""
    part = table(spark, sf_dir, "part")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text").alias("__about"))
    j = part.join(docs, part["p_partkey"] == docs["doc_id"], "left")
    key = F.col("p_partkey").cast("string")
    return j.select(
        key.alias("Uniq Id"),
        F.col("p_name").alias("Product Name"),
        F.concat_ws(" | ", "p_type", "p_brand").alias("Category"),
        F.concat(F.lit("$"), F.col("p_retailprice").cast("string")).alias("Selling Price"),
        F.col("__about").alias("About Product"),
        F.concat(F.lit("Size: "), F.col("p_size").cast("string"), F.lit(". Brand: "), F.col("p_brand"),
                 F.lit(".")).alias("Technical Details"),
        F.concat(F.lit("https://img.example.com/"), key, F.lit("/a.jpg|https://img.example.com/"), key,
                 F.lit("/b.jpg")).alias("Image"),
    )


def clean_catalog(raw: DataFrame, order_by) -> DataFrame:
    """PL1: raw catalog -> raw columns + search_text, image_url, id, product_id, name.

    Only ``search_text`` uses cleaned text; ``name`` is the raw title.
    """
    # Every cleaned text is a column of its own: the search text names each several
    # times, and as one expression each naming would clean the text again.
    sources = {"name": ("Product Name", TX.clean_text), "category": ("Category", TX.clean_category),
               "about": ("About Product", TX.clean_text), "details": ("Technical Details", TX.clean_text)}
    made = {k: (f"__{k}", fn(F.col(f"`{c}`"))) for k, (c, fn) in sources.items() if c in raw.columns}
    parts = raw.withColumns(dict(made.values()))
    texts = {k: F.col(c) for k, (c, _) in made.items()}
    merged = [texts.pop(k) for k in ("about", "details") if k in texts]
    parts = parts.withColumn("__merged", TX.dedupe_sentences(*merged) if merged else F.lit(""))
    out = parts.withColumns({
        "search_text": TX.search_text(**texts, description="__merged"),
        "image_url": TX.first_list_item(F.col("Image")),
        "product_id": F.col("`Uniq Id`"),
        "name": F.col("`Product Name`"),
    }).drop("__merged", *[c for c, _ in made.values()])
    # Cleaning runs on the scan partitions (full parallelism); the id pass then
    # moves finished rows.  Its bounds job reads only the key, so column pruning
    # keeps the cleaning expressions out of it.
    return ID.dense_id(out, order_by, out="id")


def text_collection(products: DataFrame, text_col: str, dim: int = 64) -> DataFrame:
    """PL2 (text): ``id, embedding, document`` with the stand-in encoder.

    A CSV round trip turns an empty text into null; it is encoded as ''.
    """
    base = products.withColumn("document", F.coalesce(F.col(text_col), F.lit("")))
    enc = EN.hash_encode(base, "document", dim=dim, out="embedding")
    return enc.select(F.col("id").cast("string").alias("id"), "embedding", "document")


def catalog_metadata() -> "F.Column":
    """Per-vector metadata of catalog collections."""
    return F.struct(F.col("name").cast("string").alias("name"), F.col("image_url").alias("image_url"),
                    F.col("product_id").cast("string").alias("product_id"),
                    F.coalesce("search_text", F.lit("")).alias("search_text"))


def build_collections(cleaned: DataFrame, root: str, dim: int = 64, image_fetcher=None, image_bins: int = 64,
                      if_exists: str = "replace", image_bytes: str | None = None) -> dict:
    """PL2: text (cosine), image (cosine) and multimodal (l2) collections from a
    cleaned catalog (PL1 output), written as versioned collections.

    Images are the bytes in the column ``image_bytes``, or are fetched through
    ``image_fetcher`` (S14); they are encoded with the byte-histogram stand-in
    (B2).  A missing image becomes a zero vector with an ``encode_failed`` flag
    (V7).  The multimodal vector is text ++ image (V4).
    """
    from shelfspark.session import drop_scratch, scratch_path, shuffles_freed
    from shelfspark.sources import collections as CO

    base = cleaned.select(F.col("id").cast("string").alias("id"),
                          F.coalesce("search_text", F.lit("")).alias("document"),
                          catalog_metadata().alias("metadata"), "image_url", *([image_bytes] if image_bytes else []))
    text = EN.hash_encode(base, "document", dim=dim, out="text_vec")
    with_images = image_fetcher is not None or image_bytes
    if with_images:
        # Three collections come of the rows: cleaned, fetched and encoded once.
        fetched = (text.withColumn("image_bytes", F.col(image_bytes)) if image_bytes
                   else SC.fetch_media(text, "image_url", image_fetcher, out="image_bytes"))
        enc = fetched.withColumn("image_vec", EN.encode_column("image_bytes", EN.byte_histogram_model(image_bins)))
        enc = (enc.withColumn("encode_failed", F.col("image_vec").isNull())
                  .withColumn("image_vec", V.zero_fill("image_vec", image_bins))
                  # The search text of the metadata is the document: kept once here.
                  .select("id", "document", F.col("metadata").dropFields("search_text").alias("metadata"), "text_vec", "image_vec", "encode_failed"))
        spark, path = cleaned.sparkSession, scratch_path(cleaned.sparkSession, "encoded")
        with shuffles_freed(spark):
            enc.write.option("compression", "zstd").parquet(path)
        enc = spark.read.schema(enc.schema).parquet(path)
        text = enc = enc.withColumn("metadata", F.col("metadata").withField("search_text", F.col("document")))
    out = {"text": CO.save(text.select("id", F.col("text_vec").alias("embedding"), "document", "metadata"),
                           root, "text", space="cosine", if_exists=if_exists)}
    if not out["text"].isEmpty():
        V.assert_dim(out["text"], "embedding")
    if with_images:
        out["image"] = CO.save(enc.select("id", F.col("image_vec").alias("embedding"), "document", "metadata",
                                          "encode_failed"), root, "image", space="cosine", if_exists=if_exists)
        mm = enc.select("id", V.concat_vectors("text_vec", "image_vec").alias("embedding"), "document",
                        "metadata", "encode_failed")
        out["multimodal"] = CO.save(mm, root, "multimodal", space="l2", if_exists=if_exists)
        # All three are on the shared storage.
        drop_scratch(spark, path)
    return out


def repair_embeddings(raw: DataFrame, id_col: str, text_col: str, vec_text_col: str, order_by) -> DataFrame:
    """PL3, the rows: V1 parse -> I2 generated ids -> P6 validity -> I4 suffixes.

    Repeated ids are made unique by suffixes, as the repair of the stored table
    does; nothing valid is lost.  Generated ids are positions in ``order_by``."""
    from shelfspark.session import scratch_path

    with_pos = ID.dense_id(raw, order_by, out="__pos")
    parsed = with_pos.withColumn("embedding", V.parse_vector(F.col(vec_text_col)))
    filled = ID.fill_blank_ids(parsed.withColumn("id", F.col(id_col).cast("string")), "id", "__pos",
                               style="generated")
    valid = filled.where(ID.valid_rows("id", text_col, "embedding"))
    # Read for the checks of the suffixes and for the result: parsed once.
    path = scratch_path(raw.sparkSession, "repaired-rows")
    valid.write.parquet(path)
    return ID.suffix_duplicates(raw.sparkSession.read.schema(valid.schema).parquet(path), "id", "__pos")


def repair_collection(spark: SparkSession, csv_path: str, root: str, name: str, multiline: bool = True) -> dict:
    """PL3 end to end: tolerant load (S3) -> column pick (P3, P4) -> quality counts
    (A1) -> repair -> length histogram (A3) -> collection (S7).  Generated ids are the
    rows' places in their files (files by name), from 0.

    Returns the DataFrames ``counts`` (before), ``corrupt``, ``lengths`` and ``collection``.
    """
    from shelfspark.operators import profile as PR
    from shelfspark.session import scratch_path
    from shelfspark.sources import collections as CO

    good, corrupt = SC.read_tolerant_csv(spark, csv_path, [], multiline=multiline, position="__at")
    path = scratch_path(spark, "tolerant-rows")
    good.write.parquet(path)
    rows = spark.read.schema(good.schema).parquet(path)
    place = [F.col("__at.file"), F.col("__at.start"), F.col("__at.seq")]
    vec = SC.detect_vector_column(rows.drop("__at"))
    text = SC.pick_text_column(rows.drop("__at"), vec)
    rows, id_col = SC.with_id_column(ID.dense_id(rows, place, out="__row"), "__row")
    counts = PR.quality_counts(rows.withColumn("__v", V.parse_vector(vec)), id_col, text, "__v")
    fixed = repair_embeddings(rows, id_col, text, vec, "__row")
    stored = CO.save(fixed.select("id", "embedding", F.col(text).alias("document")), root, name)
    return {"counts": counts, "corrupt": corrupt, "lengths": PR.length_histogram(stored, F.size("embedding")), "collection": stored}


def answer_batch(questions: DataFrame, collection, k: int = CHAT_TOP_K, space: str = "cosine",
                 model_factory=None, qvec: str = "vec", dim: int | None = None, prompt: str = EVAL_PROMPT) -> DataFrame:
    """PL4: k-NN -> metadata lookup -> context blocks (F12) -> prompt -> answer.

    ``collection`` is one collection searched with the vector column ``qvec``, or
    a dict of collections (``open_all``) that the columns ``text_vec`` and
    ``image_vec`` are routed to (J2).  ``prompt`` is the caller's template with the
    slots {context} and {question} (or {query}).
    """
    if isinstance(collection, dict):
        given = {n: c for n, c in collection.items() if c is not None}
        hits = KN.routed_knn(questions, given, k, wanted=tuple(given), dim=None)
        parts = [(n, c["df"] if isinstance(c, dict) else c) for n, c in given.items()]
    else:
        hits = KN.knn_join(questions, collection, k, space, qvec=qvec, cvec="embedding", dim=dim).withColumn("route", F.lit(""))
        parts = [("", collection)]
    # Read twice, and its shuffles go before the texts move.
    hits, meta = KN._kept(hits, "hits"), None
    for name, c in parts:
        url = (F.col("image_url") if "image_url" in c.columns else F.col("metadata.image_url").alias("image_url")
               if "metadata" in c.columns else F.lit(None).cast("string").alias("image_url"))
        one = c.select(F.lit(name).alias("route"), "id", "document", url)
        meta = one if meta is None else meta.unionByName(one)
    # Most documents are no hit: they stay where they are.
    meta = KN.possible_matches(meta, hits, ["route", "id"])
    blocks = hits.join(meta, ["route", "id"], "left").withColumn("block", TX.context_block("document", "image_url"))
    ctx = EV.contexts_by_rank(blocks, "qid", "rank", "block")
    q = questions.select("qid", "question").join(ctx, "qid", "left") \
                 .withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    q = q.withColumn("context", EV.context_string(F.col("contexts")))
    q = q.withColumn("prompt", TX.render_prompt(prompt, context="context", question="question", query="question"))
    return EN.generate(q, "prompt", "contexts", model_factory or EN.echo_model())


def evaluation_pairs(records: DataFrame, order_col: str, n_cap: int | None = EVAL_CAP,
                     n_sample: int | None = EVAL_SAMPLE_SIZE, seed: int = EVAL_SAMPLE_SEED) -> DataFrame:
    """First ``n_cap`` records -> reproducible sample -> question pairs with pids
    (None: no cap, no sample)."""
    capped = SC.cap_first_n(records, order_col, n_cap)
    sampled = EV.hash_sample(capped, order_col, n_sample, seed, out="sample_idx")
    with_pid = ID.fill_blank_ids(sampled.withColumn("pid", F.col("id")), "pid", "sample_idx", style="md5",
                                 title="Title", category="Category")
    pairs = EV.qa_pairs(with_pid, "Title", "Description", "Category", keep=["pid", "sample_idx"])
    # Read several times downstream (distinct questions, join-back): written once.
    from shelfspark.session import scratch_path

    path = scratch_path(records.sparkSession, "pairs")
    pairs.write.parquet(path)
    return records.sparkSession.read.schema(pairs.schema).parquet(path)


#: Between contexts in the evaluation prompt.
EVAL_SEPARATOR = "\n\n"


def evaluate(pairs: DataFrame, collection: DataFrame, k: int = EVAL_TOP_K, space: str = "l2",
             dim: int = 64, model_factory=None, prompt: str = EVAL_PROMPT) -> DataFrame:
    """PL5: J6 retrieval of distinct questions -> contexts (A6) -> the caller's
    prompt with all contexts and the question -> answers (B3) -> harmonised
    predictions (E4) -> per-row scores (E5-E7, E9)."""
    def enc(df, col):
        return EN.hash_encode(df, col, dim=dim, out="vec")

    vecs = enc(pairs.select("question").distinct(), "question")
    hits = KN.knn_join(vecs, collection, k, space, qid="question", cvec="embedding", dim=dim).withColumnRenamed("qid", "question")
    docs = KN.with_documents(hits, collection.select("id", "document"))
    ctx = EV.contexts_by_rank(docs, "question", "rank", "document")
    # Few distinct questions make hot keys: the pairs are spread over salts.
    pred = (KN.salted_join(pairs, ctx, "question", ["pid", "q_index"], how="left")
                 .withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
                 .withColumn("ground_truths", F.array("ground_truth")))
    pred = pred.withColumn("context", F.array_join("contexts", EVAL_SEPARATOR))
    pred = pred.withColumn("prompt", TX.render_prompt(prompt, context="context", question="question", query="question")).drop("context")
    answered = EN.generate(pred, "prompt", "contexts", model_factory or EN.echo_model())
    return EV.score(EV.harmonize(answered))


def report(scored: DataFrame, path: str, worst_n: int = 5, key: str = "question") -> dict:
    """Write the per-row predictions, the ``worst_n`` rows by ``f1_lex``
    and the one-row summary under ``path``; returns the three DataFrames.  ``scored``
    is derived once, so a model answers every question once and all three outputs
    tell of the same answers."""
    from shelfspark.session import scratch_path

    spark, stored = scored.sparkSession, scratch_path(scored.sparkSession, "scored")
    scored.write.parquet(stored)
    scored = spark.read.schema(scored.schema).parquet(stored)
    summary = EV.summarize(scored)
    worst_rows = EV.worst(scored, worst_n, key)
    SC.write_predictions(scored, summary, path)
    worst_rows.select([F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct")
                       else F.col(f.name) for f in worst_rows.schema.fields]) \
              .coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/worst")
    return {"predictions": scored, "worst": worst_rows, "summary": summary}
