"""Operators 11 to 13 against brute force, on messy and empty input."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import frame, lower, messy

from shelfspark.llm import hardneg, kdshard, permuterm
from shelfspark.llm.common import prepare


@pytest.fixture(autouse=True)
def _ready(spark):
    prepare(spark)


# ---------------------------------------------------------------------------
# Operator 11

def size_of(x):
    return len((x or "").encode()) + 8


def check_shards(rows, shards, n):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert len(rows) == n and all(0 <= s < shards for s in by)
    assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values())
    return {s: sum(r.size for r in by.get(s, [])) for s in range(shards)}


def test_shards_of_messy_rows(spark):
    rows = kdshard.report(frame(spark), shards=3).collect()
    check_shards(rows, 3, len(messy()))
    want = sorted(((i, size_of(x), zlib.crc32((x or "").encode())) for i, x, *_ in messy()), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=repr) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert kdshard.report(frame(spark, [])).count() == 0


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_are_even_whatever_is_hot(spark, shards):
    """Half of the rows agree in every dimension, a third has no id."""
    r = random.Random(1)
    rows = [(None if k % 3 == 0 else k, "same text" if k % 2 else "y" * r.randint(0, 40), "en", "hot" if k % 2 else f"s{k % 7}",
             9 if k % 2 else r.randint(0, 10 ** 6)) for k in range(6000)]
    sizes = check_shards(kdshard.report(frame(spark, rows), shards=shards).collect(), shards, len(rows))
    mean = sum(sizes.values()) / shards
    # A cut is off by half a row at most, and a leaf hangs below five of them.
    assert all(abs(s - mean) <= 60 for s in sizes.values())


def test_shards_follow_the_tree(spark):
    """Against the same tree built in memory: distinct values, so no ties."""
    r = random.Random(2)
    a, b = r.sample(range(10 ** 6), 400), r.sample(range(10 ** 6), 400)
    rows = [(k, "z" * r.randint(0, 90), "en", None, x) for k, x in enumerate(a)]
    docs = frame(spark, rows, extra=False).join(spark.createDataFrame([(k, y / 7) for k, y in enumerate(b)], "doc_id long, score double"), "doc_id")
    got = {x.doc_id: x.shard for x in kdshard.shard(docs, 6, dims=("n_chars", "score")).collect()}
    items = [(k, size_of(x[1]), (float(x[4]), b[k] / 7)) for k, x in enumerate(rows)]
    spread = [max(i[2][d] for i in items) - min(i[2][d] for i in items) for d in (0, 1)]
    want = {}

    def split(part, first, leaves):
        if leaves == 1:
            want.update({i[0]: first for i in part})
            return
        wide = [(max(i[2][d] for i in part) - min(i[2][d] for i in part)) / spread[d] for d in (0, 1)]
        d = wide.index(max(wide))
        part = sorted(part, key=lambda i: i[2][d])
        goal, done, cut = sum(i[1] for i in part) * (leaves // 2) / leaves, 0, 0
        while done + part[cut][1] < goal:
            done += part[cut][1]
            cut += 1
        cut += goal - done > part[cut][1] / 2
        split(part[:cut], first, leaves // 2)
        split(part[cut:], first + leaves // 2, leaves - leaves // 2)

    split(items, 0, 6)
    assert got == want


def test_shards_by_target_size(spark):
    rows = [(k, "z" * 92, "en", f"s{k % 5}", k) for k in range(300)]
    sizes = check_shards(kdshard.shard(frame(spark, rows), target_bytes=3000).collect(), 10, 300)
    assert set(sizes.values()) == {3000}


def test_written_shards(spark, scratch):
    src = frame(spark, extra=False).selectExpr("*", "lang as shard")
    placed = kdshard.write_shards(src, f"{scratch}/out", shards=4)
    back = spark.read.parquet(f"{scratch}/out")
    assert sorted(map(repr, back.select("doc_id", "text", "shard").collect())) == sorted(map(repr, src.select("doc_id", "text", "shard").collect()))
    ids = lambda df, c: sorted((repr(r.doc_id), r[c], r.slot) for r in df.collect())
    assert ids(back, "shard_") == ids(placed, "shard")


# ---------------------------------------------------------------------------
# Operator 12

def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variant_rows(counts, ratio=2):
    close = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, c in close.items():
        best = min(c, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted(((w, form[w], root(w), n, len(close[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()), key=repr)


def counted(rows):
    out = Counter()
    for i, x in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", x or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def all_of(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def test_variants_of_documents(spark):
    r, rows = random.Random(7), []
    base = ["letter", "better", "seller", "Größe", "grosse", "aaaaaa", "committee", "naïveté", "naivete", "übermut"]
    for i in range(60):
        w = []
        for _ in range(50):
            x = list(r.choice(base))
            if r.random() < 0.4:
                at = r.randrange(len(x))
                x[at:at + r.randint(0, 1)] = r.choice(["", "e", "ö", "t"])
            w.append("".join(x).upper() if r.random() < 0.1 else "".join(x))
        rows.append((None if i % 9 == 0 else i, r.choice([" ", "-", "1"]).join(w)))
    rows += [(70, None), (71, ""), (72, "abcd ab"), (73, rows[1][1]), (73, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "2L as id", "'k' as key")
    want = variant_rows(counted(rows))
    assert all_of(permuterm.report(docs)) == want
    assert any(w[1] for w in want) and len(want) > 60
    assert permuterm.report(docs.limit(0)).count() == 0


def test_variants_of_messy_documents(spark):
    rows = [(i, re.sub("[0-9]", lambda m: "abcdefghij"[int(m[0])], x or "") + " verylong" + "xyz" * 5000) for i, x, *_ in messy()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all_of(permuterm.report(docs)) == variant_rows(counted(rows))


def test_variants_across_key_forms(spark):
    """Words around PLAIN code points and far beyond: keys change their form there."""
    r = random.Random(3)
    words = {}
    for size in (5, 62, 63, 64, 65, 66, 300):
        w = "".join(r.choice("abé") for _ in range(size))
        for v in (w, w[1:], w[:-1], "b" + w, w + "é", w[:size // 2] + "x" + w[size // 2 + 1:], w[:2] + w[3:], w[:2] + w[2:4] + w[2:]):
            words[v] = r.randint(1, 40)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert all_of(permuterm.variants(df)) == variant_rows(words)


def test_variants_in_a_dense_vocabulary(spark):
    """All words of five letters over three: many neighbours, long chains, ties."""
    words = {"".join(w): 3 + (zlib.crc32("".join(w).encode()) % 7) ** 3 for w in itertools.product("abc", repeat=5)}
    words |= {w + "a": 50 for w in list(words)[:40]}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    want = variant_rows(words)
    assert all_of(permuterm.variants(df)) == want and any(w[1] and w[1] != w[2] for w in want)


# ---------------------------------------------------------------------------
# Operator 13

def negative_rows(rows, every=100):
    keep = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [int(np.floor(256.0 * float(x))) for x in v]) for i, v, lab in rows
            if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for k, (a, alab, av) in enumerate(keep):
        if a is None or a % every:
            continue
        scored = sorted(((sum(x * y for x, y in zip(av, v)), i, lab) for j, (i, lab, v) in enumerate(keep) if j != k and len(v) == len(av)), key=order)
        for ps, p, _ in [s for s in scored if s[2] == alab][:5]:
            fits = [s for s in scored if s[2] != alab and 30 * ps <= 100 * s[0] <= 90 * ps][:10]
            out += [(a, p, n + 1, i, ps, s) for n, (s, i, _) in enumerate(fits)]
    return sorted(out, key=repr)


def mined(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def vectors(seed, n, dim=8, spread=0.2):
    """Around few centres, with copies and ties."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dim))
    v = centres[r.integers(0, 4, n)] + spread * r.normal(size=(n, dim))
    v[n // 2:n // 2 + n // 8] = v[0]
    return np.round(v, 2).astype(np.float32).tolist()


@pytest.mark.parametrize("block,part", [(1024, 32768), (4, 60)])
def test_hard_negatives(spark, monkeypatch, block, part):
    monkeypatch.setattr(hardneg, "ANCHOR_ROWS", block)
    monkeypatch.setattr(hardneg, "PART_ROWS", part)
    monkeypatch.setattr(hardneg, "LEAST_PART_ROWS", 100)
    r = random.Random(4)
    rows = [(i * 20 - 1000, v, r.choice([0, 1, 2, 9])) for i, v in enumerate(vectors(1, 400))]
    rows += [(100, None, 1), (200, rows[0][1], None), (300, [1.0] * 7 + [None], 1), (400, [float("nan")] * 8, 1),
             (500, [float("inf")] * 8, 1), (None, rows[3][1], 1), (600, rows[5][1], 2), (600, rows[5][1], 2), (700, [0.0] * 8, 1),
             (800, [0.5, 0.25], 1), (801, [0.5, 0.25], 1), (803, [0.25, 0.25], 2), (900, [], 1), (901, [], 1), (902, [], 2)]
    df = spark.createDataFrame(rows, EMBEDDINGS).selectExpr("*", "1 as uid", "2 as part", "3 as block", "'x' as id")
    got = mined(hardneg.report(df))
    assert got == negative_rows(rows) and len(got) > 100
    assert hardneg.report(df.limit(0)).count() == 0


def test_hard_negatives_of_large_components(spark):
    """Scores beyond 2**53 are exact, those beyond 64 bits take no part."""
    r = np.random.default_rng(5)
    rows = [(10 * i, [float(np.float32(x)) for x in r.normal(size=3) * s], int(r.integers(0, 3)))
            for i, s in enumerate(np.repeat([1e6, 1e5], 30).tolist())]
    assert mined(hardneg.report(spark.createDataFrame(rows, EMBEDDINGS))) == negative_rows(rows)
    rows = [(0, [3e38], 1), (1, [3e38], 1), (2, [1.0], 2), (3, [-3e38], 1)]
    assert mined(hardneg.report(spark.createDataFrame(rows, EMBEDDINGS))) == []


def test_tree_bounds_spare_scores():
    """Anchors in tight groups: far rows are never scored again below a group's first anchor."""
    v = np.floor(256 * np.array(vectors(6, 300, 16, 0.01), np.float64))
    rows, parent, edge, last = hardneg.spanning_tree(v[:100])
    assert sorted(rows.tolist()) == list(range(100)) and (parent < np.arange(100)).all()
    walk = hardneg.Walk(v[:100][rows], parent, edge, last, v)
    for i, ask, low, high in walk:
        exact = v @ v[:100][rows][i]
        assert (low <= exact).all() and (exact <= high).all()
        window = high >= np.partition(low, -5)[-5]
        at, score = ask(window)
        assert (score == exact[at]).all() and set(np.argsort(-exact, kind="stable")[:1]) <= set(at.tolist())
    assert walk.scored < 0.6 * 100 * 300


