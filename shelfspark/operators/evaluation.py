"""Evaluation of retrieval-augmented answers.

Token metrics work on token *sets* (F11) with ``array_intersect``/``size``;
empty denominators give 0 (ANSI mode would raise on division by zero).
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import CONTEXT_SEPARATOR, strip_ws, tokens, truncate

# ---------------------------------------------------------------------------
# Question templates of the generated evaluation pairs.
QUESTION_NAME = "What is the product name?"
QUESTION_CATEGORY = "What is the product category?"
QUESTION_DESCRIPTION = "Briefly describe the product."
DESCRIPTION_LIMIT = 250
PAIRS_PER_PRODUCT = 2
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def overlap(a_tokens: Column, b_tokens: Column) -> Column:
    return F.size(F.array_intersect(a_tokens, b_tokens))


def f1_tokens(truth: Column, answer: Column) -> Column:
    """E5 on two text columns: token-set F1, 0 for empty sets."""
    g, a = tokens(truth), tokens(answer)
    inter = overlap(g, a)
    p = _ratio(inter, F.size(a))
    r = _ratio(inter, F.size(g))
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def recall_tokens(truth: Column, contexts_text: Column) -> Column:
    """Share of truth tokens found in the contexts."""
    g, c = tokens(truth), tokens(contexts_text)
    return _ratio(overlap(c, g), F.size(g))


def precision_tokens(answer: Column, contexts_text: Column) -> Column:
    """E7 (as named in the reference): share of *answer* tokens found in the contexts."""
    a, c = tokens(answer), tokens(contexts_text)
    return _ratio(overlap(c, a), F.size(a))


# ---------------------------------------------------------------------------
# pairs

def hash_sample(df: DataFrame, key: str, n: int | None, seed: int = 42, out: str = "sample_idx") -> DataFrame:
    """T4: reproducible sample of ``n`` rows (None: all), the same on any
    partitioning: the first rows by md5(seed:key)."""
    from shelfspark.operators.identity import dense_id
    from shelfspark.sources.catalog import top_rows

    hashed = df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string"))))
    if n is None:
        return dense_id(hashed, ["__h", key], out=out).drop("__h")
    # n rows at most: a bounded single-partition window for the sample position.
    return (top_rows(hashed, ["__h", key], n)
            .withColumn(out, (F.row_number().over(Window.orderBy("__h", key)) - 1).cast("bigint")).drop("__h"))


def qa_pairs(products: DataFrame, title: str, description: str, category: str,
             keep: list[str] | None = None) -> DataFrame:
    """Up to two (question, ground_truth) pairs per product, in the order
    name, category, description (first 250 code points), skipping blanks."""
    t = strip_ws(F.coalesce(_col(title), F.lit("")))
    c = strip_ws(F.coalesce(_col(category), F.lit("")))
    d = truncate(strip_ws(F.coalesce(_col(description), F.lit(""))), DESCRIPTION_LIMIT)
    cands = F.array(
        F.struct(F.lit(QUESTION_NAME).alias("q"), t.alias("gt")),
        F.struct(F.lit(QUESTION_CATEGORY).alias("q"), c.alias("gt")),
        F.struct(F.lit(QUESTION_DESCRIPTION).alias("q"), d.alias("gt")),
    )
    chosen = F.slice(F.filter(cands, lambda x: x["gt"] != ""), 1, PAIRS_PER_PRODUCT)
    cols = keep or []
    return (products.select(*cols, F.posexplode(chosen).alias("q_index", "qa"))
                    .select(*cols, F.col("q_index").cast("bigint").alias("q_index"),
                            F.col("qa.q").alias("question"), F.col("qa.gt").alias("ground_truth")))


# ---------------------------------------------------------------------------
# predictions

def contexts_by_rank(hits: DataFrame, key: str, rank: str, text: str, out: str = "contexts") -> DataFrame:
    """Per key, the hit texts as an array in rank order (k rows per key)."""
    return (hits.groupBy(key)
                .agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
                     .alias("__c"))
                .select(key, F.transform("__c", lambda x: x["t"]).alias(out)))


def harmonize(pred: DataFrame, contexts: str = "contexts", ground_truths: str = "ground_truths") -> DataFrame:
    """Contexts as strings, ground truths as a list, ``reference`` = first truth or ''."""
    gt = F.col(ground_truths)
    if dict(pred.dtypes).get(ground_truths, "").startswith("array"):
        gts = F.coalesce(gt, F.array().cast("array<string>"))
    else:
        gts = F.when(gt.isNotNull() & (gt != ""), F.array(gt)).otherwise(F.array().cast("array<string>"))
    ctx = F.col(contexts)
    ctxs = F.transform(F.coalesce(ctx, F.array().cast("array<string>")), lambda x: F.coalesce(x.cast("string"), F.lit("None")))
    return (pred.withColumn(ground_truths, gts)
                .withColumn(contexts, ctxs)
                .withColumn("reference", F.coalesce(F.get(F.col(ground_truths), 0), F.lit(""))))


def score(pred: DataFrame, answer: str = "answer", contexts: str = "contexts") -> DataFrame:
    """E5-E7 and E9 per row (``reference`` or the joined ground truths as truth)."""
    truth = F.when(F.col("reference") != "", F.col("reference")) \
             .otherwise(F.array_join("ground_truths", " "))
    ctx_text = F.array_join(F.col(contexts), " ")
    return (pred.withColumn("answer_f1", f1_tokens(truth, F.col(answer)))
                .withColumn("context_recall", recall_tokens(truth, ctx_text))
                .withColumn("context_precision", precision_tokens(F.col(answer), ctx_text))
                .withColumn("f1_lex", f1_tokens(F.array_join("ground_truths", " "), F.col(answer))))


def summarize(scored: DataFrame, contexts: str = "contexts") -> DataFrame:
    """Mean of each metric (0 when there are no rows) and empty-context count."""
    return scored.agg(
        F.coalesce(F.avg("answer_f1"), F.lit(0.0)).alias("answer_f1"),
        F.coalesce(F.avg("context_recall"), F.lit(0.0)).alias("context_recall"),
        F.coalesce(F.avg("context_precision"), F.lit(0.0)).alias("context_precision"),
        F.count(F.lit(1)).alias("n_questions"),
        F.count_if(F.size(contexts) == 0).alias("n_no_context"),
    )


#: Replicates of the bootstrap, and the share of them an interval holds.
REPLICATES, LEVEL = 200, 0.95
_U32 = 1 << 32


def _poisson_bounds() -> list[int]:
    """32-bit bounds of a Poisson variable of mean 1: its value is the number of
    bounds that a uniform 32-bit number reaches (none beyond, up to 1 in 2**32)."""
    out, p, total = [], math.exp(-1.0), 0.0
    for k in range(1, 14):
        total += p
        out.append(round(total * _U32))
        p /= k
    return [b for b in out if b < _U32]


def poisson_weights(key: Column, replicates: int, seed: int) -> Column:
    """Array of a row's weight in every replicate, from md5(seed:group:key), each
    digest giving four; the same on any partitioning."""
    digests = F.transform(F.sequence(F.lit(0), F.lit((replicates - 1) // 4)),
                          lambda g: F.md5(F.concat(F.lit(f"{seed}:"), g.cast("string"), F.lit(":"), key).cast("binary")))
    words = F.flatten(F.transform(digests, lambda d: F.array(*[F.conv(F.substring(d, 1 + 8 * j, 8), 16, 10).cast("bigint") for j in range(4)])))
    value = lambda u: functools.reduce(Column.__add__, [(u >= b).cast("int") for b in _poisson_bounds()])
    return F.transform(F.slice(words, 1, replicates), value)


def bootstrap_intervals(scored: DataFrame, metrics: list[str], key: str | list[str], replicates: int = REPLICATES,
                        level: float = LEVEL, seed: int = 17) -> DataFrame:
    """E8 with intervals: metric, mean, low, high, n_replicates.

    Poisson bootstrap: every row counts Poisson(1) times in every replicate, its
    counts derived from ``key`` (unique), so all replicates are sums of one aggregate
    pass with partial sums (one row per replicate leaves a task) and reruns agree.
    ``low`` and ``high`` are quantiles of the replicates' means; replicates in which
    no row counts are left out.  Nulls of a metric do not count.
    """
    keys = [key] if isinstance(key, str) else list(key)
    name = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    each = (scored.select(*metrics, F.posexplode(poisson_weights(name, replicates, seed)).alias("replicate", "w")).where("w > 0"))
    sums = each.groupBy("replicate").agg(*[
        (F.sum(F.col("w") * F.col(m)) / F.sum(F.when(F.col(m).isNotNull(), F.col("w")))).alias(m) for m in metrics])
    half = (1 - level) / 2
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("s"))
    limits = long.select("s.*").groupBy("metric").agg(F.percentile("x", half).alias("low"), F.percentile("x", 1 - half).alias("high"),
                                                      F.count("x").alias("n_replicates"))
    means = scored.agg(*[F.avg(m).alias(m) for m in metrics])
    means = means.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("mean")) for m in metrics])).alias("s"))
    return means.select("s.*").join(F.broadcast(limits), "metric", "left").select("metric", "mean", "low", "high", "n_replicates")


def worst(scored: DataFrame, n: int = 5, key: str | list[str] = "question", metric: str = "f1_lex") -> DataFrame:
    """The ``n`` lowest-scoring rows (ties broken by ``key``)."""
    keys = [key] if isinstance(key, str) else key
    return scored.orderBy(F.col(metric).asc(), *[F.col(k).asc() for k in keys]).limit(n)


def hit_rate(hits: DataFrame, truth: DataFrame, qid: str = "qid", hit_id: str = "id",
             truth_id: str = "id", k: int | None = None) -> DataFrame:
    """Share of queries whose source item is among their hits (rank <= k)."""
    h = hits if k is None else hits.where(F.col("rank") <= k)
    per_query = (truth.select(F.col(qid).alias("__q"), F.col(truth_id).alias("__t"))
                      .join(h.select(F.col(qid).alias("__q"), F.col(hit_id).alias("__h")), "__q", "left")
                      .groupBy("__q")
                      .agg(F.max((F.col("__h") == F.col("__t")).cast("int")).alias("__hit")))
    return per_query.agg(F.coalesce(F.avg(F.coalesce("__hit", F.lit(0))), F.lit(0.0)).alias("hit_rate"),
                         F.count(F.lit(1)).alias("n_queries"))


def context_string(blocks: Column) -> Column:
    """blocks joined in rank order."""
    return F.array_join(blocks, CONTEXT_SEPARATOR)


def token_set_overlap(df: DataFrame, key, side: str, text: str, left: str, right: str) -> DataFrame:
    """Token-set sizes for two sides of arbitrarily large texts, fully distributed.

    ``df`` has one row per text fragment with ``side`` equal to ``left`` or
    ``right`` (e.g. user and assistant turns of a conversation).  Returns per
    key ``n_left, n_right, n_both``: distinct tokens of each side and of both.
    Tokens are exploded and aggregated per (key, token) with partial
    aggregation, so no task ever holds a whole group's text.
    """
    keys = [key] if isinstance(key, str) else list(key)
    toks = (df.where(F.col(side).isin(left, right))
              .select(*keys, F.col(side).alias("__side"), F.explode(tokens(F.col(text))).alias("__tok")))
    per_tok = (toks.groupBy(*keys, "__tok")
                   .agg(F.max((F.col("__side") == left).cast("int")).alias("__l"),
                        F.max((F.col("__side") == right).cast("int")).alias("__r")))
    sizes = per_tok.groupBy(*keys).agg(F.sum("__l").cast("bigint").alias("n_left"),
                                       F.sum("__r").cast("bigint").alias("n_right"),
                                       F.sum(F.col("__l") * F.col("__r")).cast("bigint").alias("n_both"))
    present = df.select(*keys).distinct()
    return (present.join(sizes, keys, "left")
                   .fillna(0, subset=["n_left", "n_right", "n_both"]))


def f1_from_sizes(n_truth: Column, n_answer: Column, n_both: Column) -> Column:
    """E5 from set sizes: p = both/answer, r = both/truth, 0 for empty sets."""
    p = _ratio(n_both, n_answer)
    r = _ratio(n_both, n_truth)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
