"""The catalog's texts are cleaned, encoded and numbered once."""

import re

from pyspark.sql import functions as F

from shelfspark.functions import text as TX
from shelfspark.operators import identity as ID
from shelfspark.plans import pipelines as PL


def _raw(spark, n=40):
    rows = [(str(i), f"Name {i}", "A | B", f"It is <b>good</b> &amp; new.  Size {i}, red.", "Size: 4.", "u|v") for i in range(n)]
    return spark.createDataFrame(rows, ["Uniq Id", "Product Name", "Category", "About Product", "Technical Details", "Image"])


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_text_is_cleaned_once(spark):
    """the search text named every cleaned text several times."""
    cleaned = PL.clean_catalog(_raw(spark), F.col("`Uniq Id`").cast("bigint"))
    assert len(re.findall(r"<\[\^>\]\+>", _plan(cleaned.select("search_text", "id")))) == 4
    one = cleaned.where("product_id = '7'").first()
    assert one.search_text == "name: name 7 | category: a , b | description: it is good & new. size 7 red. size: 4."
    assert sorted(r.id for r in cleaned.collect()) == list(range(40))


def test_bounds_are_searched_once_a_row(spark):
    """the join with the offsets filtered the scan by the same search."""
    d = ID.dense_id(_raw(spark).repartition(3), F.col("`Uniq Id`").cast("bigint"), num_partitions=8)
    assert not re.search(r"Filter .*aggregate\(", _plan(d))


def test_whitespace_class_is_pythons(spark):
    every = spark.range(1, 0x110000).where("id < 55296 or id > 57343")
    char = F.pandas_udf(lambda s: s.map(chr), "string")
    found = every.withColumn("c", char("id")).where(F.col("c").rlike(TX.WS)).collect()
    assert {r.c for r in found} == set(TX.WS_CHARACTERS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_three_collections_encode_once(spark, scratch):
    """cleaning, fetching and encoding ran once for each collection."""
    cleaned = PL.clean_catalog(_raw(spark), F.col("`Uniq Id`").cast("bigint"))
    fetched = spark.sparkContext.accumulator(0)

    def fetcher():
        return lambda urls: fetched.add(len(urls)) or [u.encode() for u in urls]

    out = PL.build_collections(cleaned, scratch, dim=8, image_fetcher=fetcher, image_bins=8)
    assert {n: c.count() for n, c in out.items()} == {"text": 40, "image": 40, "multimodal": 40}
    assert fetched.value == 40
