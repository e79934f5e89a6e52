"""Collections as a Spark data source.

    register(spark)
    spark.read.format("shelfspark_collection").option("root", r).option("name", n).load()
    df.write.format("shelfspark_collection").option("root", r).option("name", n).mode("overwrite").save()
    spark.readStream.format("shelfspark_collection").option("root", r).option("name", n).load()

Reading gives the rows ``open_collection`` gives: one partition per data file, which
leaves out the rows that later batches replaced; comparisons of a column with a
constant are tested while a file is read.  Writing makes a full build: tasks
write files that nothing names, the commit removes what failed or repeated attempts
left and then writes the manifest row; an aborted write leaves no manifest row and
no files.  Batches are added with ``collections.upsert``, which needs a join.

A stream gives the rows of every full build and batch once, as they were written, in
order; an offset is the (version, batch) read last.  Compactions bring no rows of
their own and are passed over.

Files are opened with pyarrow's filesystems, by path or URI.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from shelfspark.sources.collections import BITS, MANIFEST_SCHEMA, SAME, replaced_bits

NAME = "shelfspark_collection"
#: Rows of a data file read at a time.
READ_ROWS = 8192
_TESTS = {D.EqualTo: pc.equal, D.GreaterThan: pc.greater, D.GreaterThanOrEqual: pc.greater_equal, D.LessThan: pc.less,
          D.LessThanOrEqual: pc.less_equal}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    # Hadoop writes local URIs with one slash.
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:"):]
    return pafs.FileSystem.from_uri(path)


def _files(path: str, suffix: str) -> list[str]:
    fs, base = _open(path)
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    names = [f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(suffix)]
    return sorted(p for p in names if not p.rsplit("/", 1)[-1].startswith(("_", ".")))


def manifest_rows(root: str, name: str) -> list[dict]:
    """All manifest rows, by (version, batch)."""
    base = f"{root.rstrip('/')}/{name}/manifest"
    fs, _ = _open(base)
    rows = []
    for path in _files(base, ".json"):
        with fs.open_input_stream(path) as f:
            rows += [json.loads(x) for x in f.read().decode().splitlines() if x.strip()]
    return sorted(rows, key=lambda r: (r["version"], r["batch"]))


def _columns_of(root: str, name: str) -> StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    rows = manifest_rows(root, name)
    if not rows:
        raise FileNotFoundError(f"collection {name!r} not found under {root}")
    fs, _ = _open(root)
    first = next(r for r in rows if r["version"] == rows[-1]["version"])
    found = from_arrow_schema(pq.read_schema(_files(first["path"], ".parquet")[0], filesystem=fs).remove_metadata())
    return StructType([f for f in found.fields if f.name != SAME])


class _File(D.InputPartition):
    """A data file, and the folders of bitmaps that may name it."""

    def __init__(self, path: str, deletes: list[str]):
        self.path, self.deletes = path, deletes


def _gone(fs: pafs.FileSystem, file: str, deletes: list[str]) -> dict[int, np.ndarray]:
    """Replaced rows of ``file`` by bucket."""
    out: dict[int, np.ndarray] = {}
    for folder in deletes:
        for path in _files(folder, ".parquet"):
            t = pq.read_table(path, filesystem=fs, filters=[("file", "=", file.rsplit("/", 1)[-1])])
            for bucket, bitmap in zip(t.column("bucket").to_pylist(), t.column("bitmap").to_pylist()):
                bits = replaced_bits(bitmap)
                out[bucket] = out[bucket] | bits if bucket in out else bits
    return out


def _with_texts(t: pa.Table) -> pa.Table:
    """Texts of the metadata that were stored as the document only, put back."""
    meta, doc, same = (t.column(c).combine_chunks() for c in ("metadata", "document", SAME))
    kept = dict(zip([f.name for f in meta.type], meta.flatten()))
    for f, flag in zip([f.name for f in same.type], same.flatten()):
        kept[f] = pc.if_else(pc.fill_null(flag, False), doc, kept[f])
    whole = pa.StructArray.from_arrays([*kept.values()], fields=[*meta.type], mask=meta.is_null())
    return t.set_column(t.schema.get_field_index("metadata"), "metadata", whole)


def _read(part: _File, schema: StructType, filters: list) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    fs, path = _open(part.path)
    gone, at = _gone(fs, path, part.deletes), 0
    with fs.open_input_file(path) as f:
        stored = pq.ParquetFile(f)
        left_out = SAME in stored.schema_arrow.names and "metadata" in target.names
        columns = list(dict.fromkeys([*target.names, *(["document", SAME] if left_out else [])]))
        for batch in stored.iter_batches(batch_size=READ_ROWS, columns=columns):
            place = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            keep = np.ones(batch.num_rows, bool)
            for b in np.unique(place // BITS).tolist():
                if b in gone:
                    keep &= ~np.where(place // BITS == b, gone[b][place % BITS], False)
            keep = pa.array(keep)
            for column, test, value in filters:
                keep = pc.and_(keep, pc.fill_null(test(batch.column(column), pa.scalar(value)), False))
            t = pa.Table.from_batches([batch]).filter(keep)
            t = (_with_texts(t) if left_out else t).select(target.names).cast(target)
            yield from t.to_batches()


class CollectionReader(D.DataSourceReader):
    def __init__(self, root: str, name: str, schema: StructType):
        self.root, self.name, self.schema, self.filters = root, name, schema, []

    def pushFilters(self, filters):
        for f in filters:
            test = _TESTS.get(type(f))
            if test and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self.filters.append((f.attribute[0], test, f.value))
            else:
                yield f

    def partitions(self):
        rows = manifest_rows(self.root, self.name)
        rows = [r for r in rows if r["version"] == rows[-1]["version"]]
        deletes = [r["deletes"] for r in rows if r.get("deletes")]
        return [_File(p, deletes) for r in rows for p in _files(r["path"], ".parquet")]

    def read(self, partition):
        return _read(partition, self.schema, self.filters)


class CollectionStreamReader(D.DataSourceStreamReader):
    def __init__(self, root: str, name: str, schema: StructType):
        self.root, self.name, self.schema = root, name, schema

    def initialOffset(self):
        return {"version": 0, "batch": -1}

    def latestOffset(self):
        rows = manifest_rows(self.root, self.name)
        return {k: rows[-1][k] for k in ("version", "batch")} if rows else self.initialOffset()

    def partitions(self, start, end):
        key = lambda r: (r["version"], r["batch"])
        rows = [r for r in manifest_rows(self.root, self.name) if key(start) < key(r) <= key(end) and r.get("origin") != "compact"]
        return [_File(p, []) for r in rows for p in _files(r["path"], ".parquet")]

    def read(self, partition):
        return _read(partition, self.schema, [])


class _Written(D.WriterCommitMessage):
    def __init__(self, path: str | None, rows: int, dim: int):
        self.path, self.rows, self.dim = path, rows, dim


#: Marks the folder of an aborted write.
ABORTED = ".aborted"


class CollectionWriter(D.DataSourceArrowWriter):
    def __init__(self, root: str, name: str, space: str, schema: StructType):
        self.root, self.name, self.space, self.schema = root.rstrip("/"), name, space, schema
        self.folder = f"{self.root}/{name}/data/{uuid.uuid4().hex}"

    def write(self, iterator):
        task, rows, dim, out = TaskContext.get(), 0, 0, None
        fs, base = _open(self.folder)
        name = f"part-{task.partitionId():05d}-{uuid.uuid4().hex}.parquet"
        hidden, path = f"{base}/.{name}", f"{base}/{name}"
        for batch in iterator:
            if out is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(hidden)
                out = pq.ParquetWriter(sink, batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
            if batch.num_rows:
                dim = max(dim, pc.max(pc.list_value_length(batch.column("embedding"))).as_py() or 0)
        if out is None:
            return _Written(None, 0, 0)
        out.close()
        sink.close()
        # Complete before it gets its name.
        fs.move(hidden, path)
        if fs.get_file_info(f"{base}/{ABORTED}").type != pafs.FileType.NotFound:
            fs.delete_file(path)
            raise RuntimeError("the write was aborted")
        return _Written(path, rows, dim)

    def commit(self, messages):
        done = [m for m in messages if m is not None and m.path]
        fs, base = _open(self.folder)
        fs.create_dir(base, recursive=True)
        named = {m.path for m in done}
        for f in fs.get_file_info(pafs.FileSelector(base)):
            if f.path not in named:
                fs.delete_file(f.path)
        if not done:
            from pyspark.sql.pandas.types import to_arrow_schema

            pq.write_table(to_arrow_schema(self.schema).empty_table(), f"{base}/part-0.parquet", filesystem=fs)
        earlier = manifest_rows(self.root, self.name)
        version = earlier[-1]["version"] + 1 if earlier else 1
        names = [c.split()[0] for c in MANIFEST_SCHEMA.split(", ")]
        row = dict(zip(names, (self.name, self.space, max((m.dim for m in done), default=0), sum(m.rows for m in done), version, 0,
                               self.folder, None, "build")))
        man = f"{self.root}/{self.name}/manifest/version={version}/batch=0"
        fs, at = _open(man)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/.part.json") as f:
            f.write(json.dumps(row).encode() + b"\n")
        fs.move(f"{at}/.part.json", f"{at}/part-0.json")

    def abort(self, messages):
        # Tasks may still run: those that name a file after this mark take it back.
        fs, base = _open(self.folder)
        fs.create_dir(base, recursive=True)
        fs.open_output_stream(f"{base}/{ABORTED}").close()
        for f in fs.get_file_info(pafs.FileSelector(base)):
            if f.base_name != ABORTED:
                try:
                    fs.delete_file(f.path)
                except FileNotFoundError:  # the task moved it or took it back
                    pass


class CollectionSource(D.DataSource):
    """Options: root, name; for writing also space (l2 or cosine)."""

    @classmethod
    def name(cls):
        return NAME

    def _where(self) -> tuple[str, str]:
        missing = [k for k in ("root", "name") if not self.options.get(k)]
        if missing:
            raise ValueError(f"set the options {missing}")
        return self.options["root"], self.options["name"]

    def schema(self):
        return _columns_of(*self._where())

    def reader(self, schema):
        return CollectionReader(*self._where(), schema)

    def streamReader(self, schema):
        return CollectionStreamReader(*self._where(), schema)

    def writer(self, schema, overwrite):
        if not overwrite:
            raise ValueError("write with mode overwrite; batches are added with collections.upsert")
        space = self.options.get("space", "l2")
        if space not in ("l2", "cosine"):
            raise ValueError(f"unknown space {space!r}")
        if "embedding" not in schema.names:
            raise ValueError("a collection has a column embedding")
        return CollectionWriter(*self._where(), space, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it (a reader that
    takes filters cannot be used without)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CollectionSource)
