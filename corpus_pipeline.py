"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last keep the columns of ``documents``.

Defined results, for all stages: an empty table gives an empty one with the same
columns; rows with a null text or doc_id pass as each operator defines (a null text
counts as empty); repeated rows are rows of their own; further columns of ``docs``
are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import decontaminate, lines, mixing, neardup, toxicity
from shelfspark.llm.common import prepare, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that score as toxic go.  Null and empty texts are scored
    as texts without words; without labels nothing goes."""
    prepare(spark)
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: repeated line chunks are cut out of the texts (n_chars follows
    the text); a document of which no line is left goes.  Null and blank texts have
    no repeated chunk and stay."""
    prepare(spark)
    return lines.cleaned(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of every group of near duplicates stays, linked from
    a similarity of 0.8 on over shingles of five words.  Texts without words are
    near nothing and stay."""
    prepare(spark)
    return neardup.deduplicated(docs, rule=neardup.WIDE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark window go.  An empty benchmark
    has no windows, nor has a text without words."""
    prepare(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every document as often as the mix takes it, with the number of
    the copy.  A null source is a source; documents of a source without words go."""
    prepare(spark)
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The toxicity scores come from a fitted model: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
