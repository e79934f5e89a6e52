"""Versioned vector collections on shared storage.

Layout under ``root``::

    <root>/<name>/data/<uuid>/part-*.parquet            rows of one write
    <root>/<name>/deletes/<uuid>/part-*.parquet         file, bucket, bitmap: rows that a batch replaced
    <root>/<name>/manifest/version=<n>/batch=<b>/*.json  one row, see MANIFEST_SCHEMA

A version is a full build (batch 0) and the batches added to it since.  An upsert
writes its own rows, as a batch, and one bit per row of an earlier write that it
replaces: a bitmap per data file and BITS rows.  Reading is a scan of all writes
and a test of the row's bit, without a shuffle.  After MAX_BATCHES batches, or when
the bitmaps outgrow MAX_BITMAP_BYTES, an upsert ends with ``compact``, which writes
the current rows as a new version; so what a reader holds of bitmaps is bounded.

A write's data is complete before its manifest row names it, so a crashed writer
exposes nothing; the same batch id written again replaces that batch and its
bitmaps (a replayed micro-batch changes nothing).

A text of the metadata that is the row's document is stored once: the field is null
there and a flag in the column SAME is set; readers put the text back.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from shelfspark.operators.identity import keep_first
from shelfspark.session import shuffles_freed

#: ``origin`` is build, batch or compact; ``deletes`` the folder of the bitmaps, if any.
MANIFEST_SCHEMA = ("name string, space string, dim int, n long, version long, batch long, path string, "
                   "deletes string, origin string")
#: Rows of a data file that one bitmap covers (4 KB).
BITS = 32_768
MAX_BATCHES = 64
MAX_BITMAP_BYTES = 64 << 20
#: Stored column with a flag for each text of the metadata.
SAME = "__same_as_document"


def _paths(root: str, name: str) -> tuple[str, str]:
    base = f"{root.rstrip('/')}/{name}"
    return f"{base}/data", f"{base}/manifest"


def _manifest(spark: SparkSession, root: str, name: str) -> list:
    """Manifest rows of the newest version, by batch (empty: no such collection).

    One small row per batch since the last full build; ``compact`` starts anew."""
    _, man = _paths(root, name)
    try:
        # A reader with a schema of its own: version and batch are in the rows too.
        rows = spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", True).json(man)
        newest = rows.select(F.max("version")).first()[0]
    except AnalysisException:
        return []
    return [] if newest is None else rows.where(F.col("version") == newest).orderBy("batch").collect()


def current_manifest(spark: SparkSession, root: str, name: str) -> dict | None:
    """Name, space, dim, version, number of batches and (if nothing was added
    since the full build) rows n; None when the collection does not exist."""
    rows = _manifest(spark, root, name)
    if not rows:
        return None
    return {"name": name, "space": rows[0]["space"], "dim": max(r["dim"] for r in rows), "version": rows[0]["version"],
            "batches": len(rows), "last_batch": rows[-1]["batch"], "n": rows[0]["n"] if len(rows) == 1 else None}


def _metadata_texts(schema: T.StructType) -> list[str]:
    """Fields of the metadata that may hold the document again."""
    kinds = {f.name: f.dataType for f in schema.fields}
    if not isinstance(kinds.get("metadata"), T.StructType) or kinds.get("document") != T.StringType():
        return []
    return [f.name for f in kinds["metadata"].fields if f.dataType == T.StringType() and re.fullmatch(r"\w+", f.name)]


def _stored_form(df: DataFrame) -> DataFrame:
    texts, meta = _metadata_texts(df.schema), F.col("metadata")
    if not texts:
        return df
    same = {f: F.coalesce(meta[f] == F.col("document"), F.lit(False)) for f in texts}
    less = meta
    for f in texts:
        less = less.withField(f, F.when(~same[f], meta[f]))
    return df.withColumns({SAME: F.struct(*[c.alias(f) for f, c in same.items()]), "metadata": less})


def _given_form(df: DataFrame, texts: list[str]) -> DataFrame:
    meta = F.col("metadata")
    for f in texts:
        meta = meta.withField(f, F.when(F.col(SAME)[f], F.col("document")).otherwise(F.col("metadata")[f]))
    return df.withColumn("metadata", meta).drop(SAME) if texts else df


def _replaced(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """(file, bucket, bitmap) of the stored ``rows`` whose id is among ``ids``."""
    hit = (rows.select(F.col(id_col).alias("id"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
           .join(ids.select(F.col(id_col).alias("new_id")).distinct(), F.col("id").eqNullSafe(F.col("new_id")), "left_semi"))
    return (hit.groupBy("file", F.floor(F.col("at") / BITS).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.col("at") % BITS).alias("bitmap")))


def _write(df: DataFrame, root: str, name: str, space: str, version: int, batch: int, origin: str,
           others: list | None = None, id_col: str = "id") -> None:
    """One write and its manifest row; ``others`` are the version's manifest rows."""
    spark = df.sparkSession
    data, man = _paths(root, name)
    out = f"{data}/{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        _stored_form(df).write.option("compression", "zstd").parquet(out)
    new = spark.read.schema(df.schema).parquet(out)
    stats = new.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    rows = lambda found: spark.read.schema(df.schema).parquet(*[r["path"] for r in found])
    earlier, later = ([r for r in others or [] if r["batch"] < batch], [r for r in others or [] if r["batch"] > batch])
    gone = None
    if earlier:
        gone = _replaced(rows(earlier), new, id_col)
    if later:
        # A batch written again below later ones: they replace its rows, too.
        own = _replaced(new, rows(later), id_col)
        gone = own if gone is None else gone.unionByName(own)
    deletes = None
    if gone is not None:
        deletes = f"{root.rstrip('/')}/{name}/deletes/{uuid.uuid4().hex}"
        with shuffles_freed(spark):
            gone.write.option("compression", "zstd").parquet(deletes)
    row = spark.createDataFrame([(name, space, int(stats["dim"] or 0), int(stats["n"]), version, batch, out, deletes, origin)],
                                MANIFEST_SCHEMA)
    row.coalesce(1).write.mode("overwrite").json(f"{man}/version={version}/batch={batch}")


def save(df: DataFrame, root: str, name: str, space: str = "l2", if_exists: str = "replace") -> DataFrame:
    """(re)build a collection ``(id, embedding, document, metadata)``.

    ``if_exists='replace'`` writes a new version; ``'keep'`` leaves a non-empty
    collection untouched (the populate-if-empty behaviour).
    """
    if space not in ("l2", "cosine"):
        raise ValueError(f"unknown space {space!r}")
    spark = df.sparkSession
    cur = current_manifest(spark, root, name)
    if cur is not None and if_exists == "keep" and (cur["n"] is None or cur["n"] > 0):
        return open_collection(spark, root, name)
    _write(df, root, name, space, 1 if cur is None else int(cur["version"]) + 1, 0, "build")
    return open_collection(spark, root, name)


def merge_upsert(old: DataFrame, new: DataFrame, id_col: str, order_by) -> DataFrame:
    """S8 as a plan: rows of ``new`` replace rows of ``old`` with the same id.

    Duplicates inside ``new`` are resolved first (first in ``order_by`` order).
    """
    new = keep_first(new, id_col, order_by)
    cols = old.columns
    return old.join(new.select(id_col), id_col, "left_anti").select(*cols).unionByName(new.select(*cols))


def upsert(df: DataFrame, root: str, name: str, order_by, id_col: str = "id", batch: int | None = None,
           space: str = "l2") -> DataFrame:
    """Upsert by id; writes the batch's rows only (created when absent).

    Duplicates inside the batch are resolved by ``order_by`` (the first stays).
    ``batch`` (from 1) names the batch: the same number again replaces it; without
    one, the next number is taken.
    """
    spark = df.sparkSession
    cur = current_manifest(spark, root, name)
    if batch is None:
        batch = 1 if cur is None else int(cur["last_batch"]) + 1
    if batch < 1:
        raise ValueError("batch numbers start at 1")
    version, kind = (1, space) if cur is None else (int(cur["version"]), cur["space"])
    _write(keep_first(df, id_col, order_by), root, name, kind, version, batch, "batch",
           _manifest(spark, root, name) if cur is not None else None, id_col)
    rows = _manifest(spark, root, name)
    if len(rows) > MAX_BATCHES or _bitmaps(spark, rows).count() * BITS // 8 > MAX_BITMAP_BYTES:
        return compact(spark, root, name)
    return open_collection(spark, root, name)


def _bitmaps(spark: SparkSession, rows: list) -> DataFrame:
    """(file, bucket, bitmap): one row per BITS rows of which some are replaced."""
    schema = "file string, bucket long, bitmap binary"
    paths = [r["deletes"] for r in rows if r["deletes"]]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths).groupBy("file", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def replaced_bits(bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)


def _is_current(spark: SparkSession, gone: dict) -> Column:
    bc = spark.sparkContext.broadcast(gone)

    @F.pandas_udf("boolean")
    def current(file: pd.Series, at: pd.Series) -> pd.Series:
        out, place = np.ones(len(file), bool), at.to_numpy()
        for name in file.unique():
            held, mine = bc.value.get(name, {}), np.flatnonzero((file == name).to_numpy())
            bucket = place[mine] // BITS
            for b in np.unique(bucket).tolist():
                if b in held:
                    of = mine[bucket == b]
                    out[of] = ~replaced_bits(held[b])[place[of] % BITS]
        return pd.Series(out)

    return current(F.col("_metadata.file_name"), F.col("_metadata.row_index"))


def open_collection(spark: SparkSession, root: str, name: str, required: bool = True) -> DataFrame | None:
    """The current rows of a collection: of every id the newest batch's.

    One scan of all writes.  Rows of writes that a later batch touched pass a test of
    their bit; the bitmaps (bounded, see MAX_BITMAP_BYTES) are broadcast."""
    rows = _manifest(spark, root, name)
    if not rows:
        if required:
            raise FileNotFoundError(f"collection {name!r} not found under {root}")
        return None
    schema = spark.read.parquet(rows[0]["path"]).schema
    gone: dict = {}
    for r in _bitmaps(spark, rows).toLocalIterator():
        gone.setdefault(r["file"], {})[r["bucket"]] = bytes(r["bitmap"])
    schema = T.StructType([f for f in schema.fields if f.name != SAME])
    texts = _metadata_texts(schema)
    # A write without flags reads as null there: nothing of it was left out.
    stored = T.StructType([*schema.fields, *([T.StructField(SAME, T.StructType([T.StructField(f, T.BooleanType()) for f in texts]))] if texts else [])])
    every = spark.read.schema(stored).parquet(*[r["path"] for r in rows])
    return _given_form(every.where(_is_current(spark, gone)) if gone else every, texts)


def compact(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current rows as a new version with nothing added (earlier versions stay
    for readers that opened them)."""
    cur = current_manifest(spark, root, name)
    _write(open_collection(spark, root, name), root, name, cur["space"], int(cur["version"]) + 1, 0, "compact")
    return open_collection(spark, root, name)


def list_collections(spark: SparkSession, root: str) -> DataFrame:
    """Name, space, dim, version and batches of every collection under ``root``."""
    schema = "name string, space string, dim int, version long, batches long"
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
        newest = rows.groupBy("name").agg(F.max("version").alias("version"))
        return (rows.join(newest, ["name", "version"]).groupBy("name", "version")
                .agg(F.first("space").alias("space"), F.max("dim").alias("dim"), F.count(F.lit(1)).alias("batches"))
                .select("name", "space", "dim", "version", "batches"))
    except AnalysisException:
        return spark.createDataFrame([], schema)


def open_all(spark: SparkSession, root: str, main: str = "multimodal",
             optional: tuple[str, ...] = ("text", "image")) -> dict:
    """Name -> {'df', 'space'}; optional collections that are absent map to None."""
    out = {}
    for name in (main, *optional):
        cur = current_manifest(spark, root, name)
        if cur is None:
            if name == main:
                raise FileNotFoundError(f"collection {name!r} not found under {root}")
            out[name] = None
            continue
        out[name] = {"df": open_collection(spark, root, name), "space": cur["space"]}
    return out


def metadata_table(collection: DataFrame) -> DataFrame:
    """The metadata side table (stored in the same rows)."""
    return collection.select("id", "metadata.*")
