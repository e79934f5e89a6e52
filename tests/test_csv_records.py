"""Multi-line CSV read by byte ranges equals Spark's one-task reader."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.sources import catalog as SC
from shelfspark.sources import csv_records as CR

NAMES = ["c0", "c1", "c2", "c3"]


def _file(folder, text, name="x.csv"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def _generated(seed, escape, odd):
    """A CSV text: line breaks, delimiters and quotes inside fields; with ``odd``
    also quotes where none should be."""
    r = random.Random(seed)
    plain = ["a", "b", " ", "é", "x1", "\t"]

    def field():
        k = r.random()
        if k < 0.4:
            return "".join(r.choice(plain) for _ in range(r.randint(0, 6))).strip("\t")
        if k < 0.8 or not odd:
            quote = '""' if escape == '"' else '\\"'
            return '"' + "".join(r.choice(plain + ["\n", "\n", ",", "\r\n", quote]) for _ in range(r.randint(0, 12))) + '"'
        if k < 0.9:
            return 'a"' + r.choice(["", "b", '"', 'c"'])
        return '"a' + r.choice(['"b', '" b', '"b"c" ']) + '"'

    rows = [",".join(field() for _ in range(3)) for _ in range(r.randint(1, 40))]
    return "h1,h2,h3\n" + "\n".join(rows) + r.choice(["", "\n"])


@pytest.fixture()
def split_size(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, before)


def _one_task(spark, path, escape):
    rows = (spark.read.options(header=True, multiLine=True, quote='"', escape=escape, enforceSchema=True)
            .schema(SC.string_schema(NAMES)).csv(path).collect())
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("seed", range(4))
def test_ranges_equal_one_task(spark, scratch, split_size, seed):
    escape = '"' if seed % 2 else "\\"
    path = _file(scratch, _generated(seed, escape, seed > 1))
    want = _one_task(spark, path, escape)
    for size in (37, 8 << 20):
        split_size(size)
        got = SC._records_to_columns(spark, path, NAMES, {"quote": '"', "escape": escape}, True, "at").collect()
        assert [tuple(r)[:4] for r in sorted(got, key=lambda r: tuple(r["at"]))] == want


def test_one_record_over_many_ranges(spark, scratch, split_size):
    """Ranges wholly inside a field, an escaped quote at a range's edge, a field that
    is never closed."""
    body = "\n".join(f'line {i} with ""quotes"", commas' for i in range(60))
    path = _file(scratch, f'h1,h2,h3\n1,"{body}",x\n2,y,z\n3,"open\nto the end\n')
    split_size(64)
    lines = CR.read_records(spark, path)
    assert lines.rdd.getNumPartitions() > 8
    rows = SC.read_catalog(spark, path, ["a", "b", "c"], position="at").collect()
    rows = [tuple(r)[:3] for r in sorted(rows, key=lambda r: tuple(r["at"]))]
    assert rows[0] == ("1", body.replace('""', '"'), "x") and rows[1] == ("2", "y", "z") and rows[2][0] == "3"
    assert len(rows) == 3


def test_places_in_several_files(spark, scratch, split_size):
    for k, n in enumerate((2, 40, 3)):
        _file(scratch, "id,t\n" + "".join(f'{100 * k + i},"a\nb"\n' for i in range(n)), f"part-{k}.csv")
    split_size(50)
    rows = SC.read_catalog(spark, scratch, position="at").collect()
    got = [r.id for r in sorted(rows, key=lambda r: tuple(r["at"]))]
    assert got == [str(100 * k + i) for k, n in enumerate((2, 40, 3)) for i in range(n)]
    assert all(r.t == "a\nb" for r in rows)


def test_without_line_breaks_in_fields(spark, scratch, split_size):
    path = _file(scratch, "a,b\n" + "".join(f'{i},"x, {i}"\n' for i in range(50)))
    split_size(64)
    rows = SC.read_catalog(spark, path, multiline=False).collect()
    assert sorted((int(r.a), r.b) for r in rows) == [(i, f"x, {i}") for i in range(50)]


def test_functions_compose():
    r = random.Random(1)
    apply = {CR.SAME: lambda s: s, CR.SWAP: lambda s: 1 - s, CR.OUT: lambda s: 0, CR.IN: lambda s: 1}
    for _ in range(200):
        fs = np.array([r.randint(0, 3) for _ in range(r.randint(0, 8))], np.int8)
        for start in (0, 1):
            s, after = start, []
            for f in fs.tolist():
                s = apply[f](s)
                after.append(s)
            assert apply[CR.composed(fs)](start) == s
            assert CR.states(fs, start).tolist() == after if fs.size else True


def test_tolerant_reader_gives_places(spark, scratch):
    path = _file(scratch, 'id,text\n5,"a\nb"\n6,x,too many\n7,\n')
    good, corrupt = SC.read_tolerant_csv(spark, path, ["id"], position="at")
    rows = sorted(good.collect(), key=lambda r: tuple(r["at"]))
    assert [(r.id, r.text) for r in rows] == [("5", "a\nb"), ("7", None)]
    assert corrupt.select(F.get("fields", 0)).first()[0] == "6"
