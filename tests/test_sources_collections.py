"""CSV/JSON sources, column resolution, versioned collections, media files."""

import os

import pytest
from pyspark.sql import functions as F

from shelfspark.sources import catalog as SC
from shelfspark.sources import collections as CO

RECORDED_HEADER = ["Uniq Id", "Product Name", "Brand Name", "Asin", "Category", "Upc Ean Code", "List Price",
                   "Selling Price", "Quantity", "Model Number", "About Product", "Product Specification",
                   "Technical Details", "Shipping Weight", "Product Dimensions", "Image"]


def test_find_col_recorded_header():
    assert SC.find_col(RECORDED_HEADER, SC.ID_CANDIDATES) == "Asin"
    assert SC.find_col(RECORDED_HEADER, SC.TITLE_CANDIDATES) == "Product Name"
    assert SC.find_col(RECORDED_HEADER, SC.DESCRIPTION_CANDIDATES) == "About Product"
    assert SC.find_col(RECORDED_HEADER, SC.CATEGORY_CANDIDATES) == "Category"
    assert SC.find_col(["TITLE", "X"], SC.TITLE_CANDIDATES) == "TITLE"
    assert SC.find_col(["a", "b"], SC.TITLE_CANDIDATES) is None


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_catalog_edges(spark, scratch):
    p = os.path.join(scratch, "cat.csv")
    _write(p, '﻿ Uniq Id ,Product Name,About Product\n'
              '1,"Say ""hi""","line one\nline two, with comma"\n'
              '2,NA,N/A\n'
              '3,,nan\n'
              '4,short\n')
    df = SC.read_catalog(spark, p)
    assert df.columns == ["Uniq Id", "Product Name", "About Product"]
    rows = {r["Uniq Id"]: r for r in df.collect()}
    assert rows["1"]["Product Name"] == 'Say "hi"'
    assert rows["1"]["About Product"] == "line one\nline two, with comma"
    assert rows["2"]["Product Name"] is None and rows["2"]["About Product"] is None
    assert rows["3"]["Product Name"] is None and rows["3"]["About Product"] is None
    assert rows["4"]["About Product"] is None


def test_tolerant_csv_required_short_and_long_rows(spark, scratch):
    p = os.path.join(scratch, "emb.csv")
    _write(p, "\ufeffid, text ,embedding\n1,a,\"[1,2]\"\n2,b\n3,c,\"[3,4]\",extra\n4,\"x\ny\",NA\n")
    with pytest.raises(ValueError):
        SC.read_tolerant_csv(spark, p, ["id", "vector"])
    good, corrupt = SC.read_tolerant_csv(spark, p, ["id", "embedding"], one_of=["text", "document"])
    assert sorted(map(tuple, good.collect())) == [("1", "a", "[1,2]"), ("2", "b", None), ("4", "x\ny", None)]
    assert [r.fields for r in corrupt.collect()] == [["3", "c", "[3,4]", "extra"]]


def test_tolerant_csv_tries_the_next_settings(spark, scratch):
    p = os.path.join(scratch, "odd.csv")
    _write(p, 'id,"text\\",embedding"\n1,a\n')
    # Only with the backslash as escape the header has the column text",embedding.
    good, _ = SC.read_tolerant_csv(spark, p, ["id", 'text",embedding'])
    assert [tuple(r) for r in good.collect()] == [("1", "a")]


def test_product_records_and_json(spark, scratch):
    df = spark.createDataFrame([("  a  b ", "T", None, "img|x"), (None, "T2", "C", None)],
                               "id string, title string, cat string, image string")
    rec = SC.product_records(df, "id", "title", None, "cat", "image")
    rows = rec.collect()
    assert rows[0].id == "a b" and rows[0].Description == "T" and rows[0].image_url == "img|x"
    assert rows[1].Description == "T2 C" and rows[1].image_url is None
    out = os.path.join(scratch, "rec")
    SC.write_json_records(rec, out)
    back = SC.read_json_records(spark, out, rec.schema)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_detect_vector_column(spark):
    df = spark.createDataFrame([("1", "[1,2]", "x"), ("2", "[3]", "y")], "a string, b string, c string")
    assert SC.detect_vector_column(df) == "b"
    late = spark.createDataFrame([(str(i), None, "x") for i in range(300)] + [("q", "[1,2]", "y")], "a string, b string, c string")
    assert SC.detect_vector_column(late.coalesce(1)) == "b"
    assert SC.detect_vector_column(late.withColumnRenamed("c", " Vectors ")) == " Vectors "
    assert SC.detect_vector_column(late.select("a", "c")) is None


def test_column_pick_by_name_then_fallback(spark):
    df = spark.createDataFrame([(0, "short", "a much longer text"), (1, "s", "another long one")], "pos long, a string, b string")
    assert SC.pick_text_column(df) == "b" and SC.pick_text_column(df, vector_col="b") == "a"
    assert SC.pick_text_column(df.withColumnRenamed("a", "body")) == "body"
    same, name = SC.with_id_column(df.withColumnRenamed("a", "pid"), "pos")
    assert name == "pid"
    new, name = SC.with_id_column(df, "pos")
    assert name == "__id__" and sorted(r["__id__"] for r in new.collect()) == ["0", "1"]


def test_clean_catalog_sink(spark, scratch):
    df = spark.createDataFrame([("1", 'say "hi"\nthere', None), ("2", "a,b", "x")], "id string, search_text string, name string")
    SC.write_clean_catalog(df, os.path.join(scratch, "clean"))
    back = SC.read_catalog(spark, os.path.join(scratch, "clean"), df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def _coll(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<float>, document string")


def test_collection_rebuild_upsert_open(spark, scratch):
    root = os.path.join(scratch, "colls")
    v1 = CO.save(_coll(spark, [("a", [1.0, 0.0], "A"), ("b", [0.0, 1.0], "B")]), root, "text", space="cosine")
    assert v1.count() == 2
    kept = CO.save(_coll(spark, [("z", [1.0, 1.0], "Z")]), root, "text", if_exists="keep")
    assert sorted(r.id for r in kept.collect()) == ["a", "b"]
    newer = _coll(spark, [("b", [0.5, 0.5], "B2"), ("b", [0.0, 0.0], "B3"), ("c", [1.0, 1.0], "C")])
    want = [("a", "A"), ("b", "B2"), ("c", "C")]
    up = CO.upsert(newer, root, "text", "document", batch=1)
    assert sorted((r.id, r.document) for r in up.collect()) == want
    # The same batch again replaces itself; another one adds to it.
    assert sorted((r.id, r.document) for r in CO.upsert(newer, root, "text", "document", batch=1).collect()) == want
    CO.upsert(_coll(spark, [("a", [0.0, 0.0], "A2")]), root, "text", "document")
    man = CO.current_manifest(spark, root, "text")
    assert (man["version"], man["batches"], man["dim"], man["space"]) == (1, 3, 2, "cosine")
    assert sorted(r.document for r in CO.compact(spark, root, "text").collect()) == ["A2", "B2", "C"]
    man = CO.current_manifest(spark, root, "text")
    assert (man["version"], man["n"], man["batches"]) == (2, 3, 1)
    CO.save(_coll(spark, [("n", [1.0], "N")]), root, "image")
    assert sorted(map(tuple, CO.list_collections(spark, root).collect())) == [("image", "l2", 1, 1, 1), ("text", "cosine", 2, 2, 1)]
    assert CO.list_collections(spark, root + "-none").count() == 0
    CO.save(_coll(spark, [("m", [1.0], "M")]), root, "image", if_exists="replace")
    assert [r.id for r in CO.open_collection(spark, root, "image").collect()] == ["m"]
    with pytest.raises(FileNotFoundError):
        CO.open_all(spark, root, main="multimodal")
    allc = CO.open_all(spark, root, main="text", optional=("other",))
    assert allc["other"] is None and allc["text"]["space"] == "cosine"


def test_media_files(spark):
    files = SC.read_media_files(spark, "/root/testdata/sf0.001", glob="region.parquet")
    r = files.first()
    assert r.length == len(r.content) > 0


def test_build_collections_with_images(spark, scratch):
    from shelfspark.plans import pipelines as PL

    cleaned = spark.createDataFrame(
        [(0, "name: a | category: x", "u/ok1", "p0", "A"), (1, "", "u/bad", "p1", "B"), (2, "name: c", None, "p2", "C")],
        "id long, search_text string, image_url string, product_id string, name string")

    def fetcher():
        def fetch(urls):
            return [None if (u is None or "bad" in u) else b"\x00\x01\xff" * 10 for u in urls]
        return fetch

    out = PL.build_collections(cleaned, os.path.join(scratch, "c"), dim=16, image_fetcher=fetcher, image_bins=8)
    text = {r.id: r for r in out["text"].collect()}
    img = {r.id: r for r in out["image"].collect()}
    mm = {r.id: r for r in out["multimodal"].collect()}
    assert len(text["0"].embedding) == 16 and text["0"].metadata.product_id == "p0"
    assert img["1"].encode_failed and img["1"].embedding == [0.0] * 8
    assert not img["0"].encode_failed and abs(sum(x * x for x in img["0"].embedding) - 1) < 1e-5
    assert len(mm["2"].embedding) == 24
    opened = CO.open_all(spark, os.path.join(scratch, "c"))
    assert opened["multimodal"]["space"] == "l2" and opened["text"]["space"] == "cosine"
    meta = CO.metadata_table(opened["text"]["df"])
    assert set(meta.columns) == {"id", "name", "image_url", "product_id", "search_text"}


def test_keep_columns_synth_and_predictions_sink(spark, scratch):
    from shelfspark.functions import text as TX
    from shelfspark.operators import evaluation as EV

    df = spark.createDataFrame([("1", "T", "C", "x")], "`Uniq Id` string, `Product Name` string, Category string, z string")
    assert SC.keep_columns(df).columns == ["Uniq Id", "Product Name", "Category"]
    assert df.select(TX.synth_description("`Product Name`", "Category")).first()[0] == "T C"
    pred = spark.createDataFrame([("q", ["g"], ["c1", "c2"], "a")], "question string, ground_truths array<string>, "
                                                                  "contexts array<string>, answer string")
    scored = EV.score(EV.harmonize(pred))
    SC.write_predictions(scored, EV.summarize(scored), os.path.join(scratch, "run"))
    back = spark.read.option("header", True).option("escape", "\"").csv(os.path.join(scratch, "run", "predictions"))
    assert back.first()["contexts"] == '["c1","c2"]'
    m = spark.read.json(os.path.join(scratch, "run", "metrics")).first()
    assert m["n_questions"] == 1


def test_report_writes_three_outputs(spark, scratch):
    from shelfspark.operators import evaluation as EV
    from shelfspark.plans import pipelines as PL

    pred = spark.createDataFrame([(f"q{i}", ["a b c"], ["a b"], "a" if i % 2 else "z") for i in range(8)],
                                 "question string, ground_truths array<string>, contexts array<string>, answer string")
    out = PL.report(EV.score(EV.harmonize(pred)), os.path.join(scratch, "rep"), worst_n=3)
    assert out["worst"].count() == 3
    worst = spark.read.option("header", True).csv(os.path.join(scratch, "rep", "worst"))
    assert worst.count() == 3 and {r.answer for r in worst.collect()} == {"z"}
    assert spark.read.json(os.path.join(scratch, "rep", "metrics")).first()["n_questions"] == 8


def test_product_records_position_fallback(spark):
    df = spark.createDataFrame([(7, "T", "C"), (8, "U", None)], "pos long, title string, cat string")
    rows = {r.id: r for r in SC.product_records(df, None, "title", None, "cat", None, pos_col="pos").collect()}
    assert set(rows) == {"7", "8"}
    assert rows["7"].Description == "T C" and rows["8"].Description == "U" and rows["8"].Category == ""
    assert rows["7"].image_url is None


def test_cap_first_n_keeps_every_row_it_should(spark):
    df = spark.range(0, 20000).select(((F.col("id") * 7919) % 20000).alias("k"), F.col("id")).repartition(16)
    assert sorted(r.k for r in SC.cap_first_n(df, "k", 300).collect()) == list(range(300))
    assert SC.cap_first_n(df, "k", None).count() == 20000
    nan = df.select(F.when(F.col("k") % 10 > 0, F.lit(float("nan"))).otherwise(F.col("k").cast("double")).alias("k"))
    assert SC.cap_first_n(nan, "k", 300).count() == 300
    assert SC.cap_first_n(nan, "k", 2500).where(~F.isnan("k")).count() == 2000
