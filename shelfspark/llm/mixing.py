"""Mixing sources to target token weights, with DataFrame functions only.

Tokens are counted per source (pre-aggregated before the shuffle), each source
gets a target and so a repetition rate (target / size), and every document is
emitted floor(rate) times plus one more copy when a hash of (seed, doc_id) as a
uniform number falls below the fraction.  Nothing random: reruns, other
partitionings and recomputed tasks agree.

Defined results: a null text has size 0; null is a source of its own and comes
last; a source without tokens has target 0 and rate 0; rows with the same doc_id
draw the same number; a null doc_id draws as the empty text; input columns keep
their names and values.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import WORD, join_counted, stored, text_of, whole_row

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix"


def n_tokens(text: str | Column = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def uniform(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of md5(seed:doc_id)."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double")
    return bits / F.lit(float(2 ** 52))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs) -> the same with ``target``.

    The sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all tokens; no target exceeds ``most`` times its source, the
    excess is shared again by weight.  Written as water-filling: with the sources
    by most * size / weight ascending, a source is at its cap exactly if its cap
    is within its share of what the caps before it leave over, so running sums
    give the common level in one go.  This table has one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    by_fill = everything.orderBy("fill", F.col("source").asc_nulls_last())
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(float(most))
    kept = (sizes
            .withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                          (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
            .withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("w"))
            .withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share))
                        - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            .withColumn("level", F.col("left") / F.sum("w").over(after))
            .withColumn("full", F.col("fill") <= F.col("level")))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("fill"), F.col("level")))).over(everything)["level"]
    return (kept.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * level))
            .select("source", "source_size", "n_docs", "target"))


def rates(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text",
          weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                        n_tokens(text).alias("size"))
    sized = stored(sized, "mix-sizes")
    return _with_copies(sized, _targets(sized, weights, share, most), seed).select(
        "doc_id", "size", "source_size", "target", "copies")


def _targets(sized: DataFrame, weights, share, most) -> DataFrame:
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    return (source_targets(sizes, weights, share, most)
            .withColumn("is_null", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit(""))))


def _with_copies(sized: DataFrame, targets: DataFrame, seed: str, total: int | None = None) -> DataFrame:
    keyed = sized.withColumn("is_null", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    total = sized.count() if total is None else total
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.col("rate"))
    return (join_counted(keyed, targets, ["source", "is_null"], "n_docs", total)
            .withColumn("rate", rate)
            .withColumn("copies", whole + (uniform("doc_id", seed) < F.col("rate") - whole).cast("long"))
            .withColumn("source", F.when(~F.col("is_null"), F.col("source"))).drop("is_null", "rate"))


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text",
          copy_col: str = "copy_no", **options) -> DataFrame:
    """The mix itself: every document's row as often as its copies, with the
    number of the copy (from 1) in ``copy_col`` (with underscores added while the
    input has a column of that name)."""
    while copy_col in docs.columns:
        copy_col += "_"
    opts = {"weights": WEIGHTS, "share": SHARE, "most": MOST, "seed": SEED} | options
    src = F.col(source).cast("string")
    sizes = docs.select(src.alias("source"), n_tokens(text).alias("size"))
    rows = docs.select(whole_row(docs), F.col(doc_id).alias("doc_id"),
                       src.alias("source"))
    targets = stored(_targets(sizes, opts["weights"], opts["share"], opts["most"]), "mix-targets")
    out = _with_copies(rows, targets, opts["seed"], docs.count())
    return (out.filter(F.col("copies") > 0)
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy_no"))
            .select("row.*", F.col("copy_no").alias(copy_col)))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words in the mix, repeats counted)."""
    return rates(docs, **options).select("doc_id", "size", "source_size", "target",
                                         (F.col("size") * F.col("copies")).alias("taken"))
