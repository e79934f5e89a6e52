"""The corpus pipeline, stage by stage against brute force, and the registered names."""

import math

from cases import decontaminated_rows, frame, kept_lines, messy, near_components, sha, words

import corpus_pipeline as CP
from shelfspark.llm import mixing, toxicity
from shelfspark.llm.common import prepare, stored, table

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    prepare(spark)
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(CP.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]

    def step(name, src):
        out = stored(stages[name](spark, src, SF), f"test-{name}")
        assert name == "mixing" or out.columns == columns
        return out

    def texts(df):
        return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    clean = step("toxicity", docs)
    bad = {r.doc_id for r in toxicity.report(docs, table(spark, SF, "labels")).collect() if r.predicted}
    assert {i for i, _ in texts(clean)} == {i for i, _ in texts(docs)} - bad
    lines = step("line_dedup", clean)
    want = {(i, h) for i, n, h in kept_lines(texts(clean))}
    got = {(i, sha(x)) for i, x in texts(lines)}
    assert got == {(i, h) for i, h in want if (i, h) in got or h != sha("")} and len(got) == lines.count()
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    unique = step("near_dedup", lines)
    assert {i for i, _ in texts(unique)} == {i for i, n, c in near_components(texts(lines), link=80) if i == c}
    safe = step("decontamination", unique)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert {i for i, _ in texts(safe)} == {r[0] for r in decontaminated_rows(texts(unique), items) if not r[5]}
    mix = step("mixing", safe)
    assert mix.columns == [*columns, "copy_no"]
    rate = {r.doc_id: (r.target / r.source_size, r.taken) for r in mixing.report(safe).collect() if r.source_size}
    copies = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    for i, x in texts(safe):
        low = math.floor(rate[i][0])
        assert copies.get(i, 0) in (low, low + 1) and copies.get(i, 0) * len(words(x)) == rate[i][1]
    assert CP.run(spark, SF).count() == mix.count()


def test_registered_names():
    from shelfspark.llm import queries as LQ

    assert sorted(int(n[2:].split("_")[0]) for n in LQ.Q) == list(range(1, 14))
    assert set(LQ.SQL) <= set(LQ.Q)


def messy_table(spark, folder, rows):
    """``rows`` as the documents of a folder of tables, beside empty labels and benchmark."""
    frame(spark, rows, extra=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run_on_empty_and_messy_tables(spark, scratch):
    messy_table(spark, f"{scratch}/none", [])
    out = CP.run(spark, f"{scratch}/none")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy_no"] and out.count() == 0
    messy_table(spark, f"{scratch}/messy", messy())
    rows = CP.run(spark, f"{scratch}/messy").collect()
    # Nothing is toxic or contaminated; of the copies of one text one is left.
    ids = {r.doc_id for r in rows}
    assert {14, 15} <= ids and len(ids & {0, 1, 2, 16}) <= 1 and all(r.text for r in rows)
