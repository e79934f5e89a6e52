"""Every operator on messy and empty input against brute force."""

import re

import pytest
from cases import decontaminated_rows, frame, held, kept_lines, messy, near_components, prose, sha, substring_rows, words

from shelfspark.llm import chatformat, decontaminate, exact, lines, mixing, neardup, pii, substrings, suffixtree, toxicity
from shelfspark.llm.common import prepare


@pytest.fixture(autouse=True)
def _ready(spark):
    prepare(spark)


def pairs():
    return [(r[0], r[1]) for r in messy()]


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


def by_repr(rows):
    return sorted(rows, key=repr)


def test_exact_dedup(spark):
    out = exact.deduplicate(frame(spark), exact.new_index(spark, 4))
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", x or "")) for i, x in pairs()]
    want = []
    for i, x in norm:
        ids = [j for j, y in norm if y == x]
        least = min((j for j in ids if j is not None), default=None)
        want.append((i, least, len(ids), i == least, sha(x)))
    assert rows_of(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == by_repr(want)


def test_exact_dedup_index_lasts(spark):
    index = exact.new_index(spark, 4)
    first = spark.createDataFrame([(5, "a  b"), (6, "c")], "doc_id long, text string")
    later = spark.createDataFrame([(1, "a b"), (2, "d"), (3, "d")], "doc_id long, text string")
    exact.deduplicate(first, index).collect()
    # Another session: the catalog knows nothing of the index.
    spark.sql(f"DROP TABLE {index.segments[0]}")
    index = exact.open_index(spark, index.root)
    assert rows_of(exact.deduplicate(later, index), "doc_id", "keep_id", "group_size", "kept") == [
        (1, 5, 1, False), (2, 2, 2, True), (3, 2, 2, False)]
    assert len(index.segments) == 2 and index.lookup().count() == 3


def test_exact_dedup_in_batches(spark, monkeypatch):
    """Later batches are looked up in the index; segments are merged on the way."""
    monkeypatch.setattr(exact, "MAX_SEGMENTS", 3)
    index = exact.new_index(spark, 4)
    out = exact.deduplicate_in_batches(frame(spark), index, batches=7)
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", x or "")) for i, x in pairs()]
    want = []
    for i, x in norm:
        ids = [j for j, y in norm if y == x]
        least = min((j for j in ids if j is not None), default=None)
        want.append((i, least, len(ids), i == least, sha(x)))
    assert rows_of(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == by_repr(want)
    assert index.generation >= 2 and len(index.segments) <= 3
    again = exact.open_index(spark, index.root)
    assert again.segments == index.segments and again.lookup().count() == len({x for _, x in norm})


def test_line_dedup(spark):
    out = lines.report(frame(spark))
    assert rows_of(out, "doc_id", "n_lines", "kept_sha256") == by_repr(kept_lines(pairs()))
    gone = {r.doc_id: r.n_removed for r in out.collect()}
    assert gone[12] + gone[13] > 0 and gone[0] == gone[1] == 0 and gone[19] == 0


@pytest.mark.parametrize("n,share", [(5, 0.35), (10, 0.7), (20, 0.8)])
def test_line_dedup_finds_passages_in_other_surroundings(spark, n, share):
    rows = []
    for k in range(60):
        passage = [f"line {i} of passage {k}" for i in range(n)]
        for copy in (0, 1):
            around = [[f"{side} {k} {copy} {i}" for i in range(4)] for side in ("before", "after")]
            rows.append((2 * k + copy, "\n".join(around[0] + passage + around[1])))
    out = lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = {r.doc_id: r.n_removed for r in out}
    assert all(gone[2 * k] == 0 for k in range(60))
    assert all(gone[2 * k + 1] <= n for k in range(60)) and sum(gone.values()) >= share * 60 * n


def test_line_dedup_keeps_columns(spark):
    src = frame(spark)
    out = lines.cleaned(src)
    assert out.columns == src.columns and out.schema == src.schema
    assert out.filter("doc_id = 6").count() == 3 and out.filter("doc_id is null").count() == 1


def test_near_dedup(spark):
    out = neardup.near_duplicates(frame(spark))
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == by_repr(near_components(pairs()))
    src = frame(spark)
    kept = neardup.deduplicated(src)
    assert kept.columns == src.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    want = [i for i, _, c in near_components(pairs()) if i == c or c is None or i is None]
    assert ids == sorted([i for i, n, c in near_components(pairs()) if n == 0 or i == c or (i is None and c is None)], key=repr), want


def test_near_dedup_finds_all_links_of_a_large_group(spark):
    """Copies of one text with random changes: links between copies differ."""
    import random

    base, r, rows = prose(11, 80), random.Random(5), []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
        rows.append((i * 7 % 151, " ".join(w)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == by_repr(near_components(rows))


def test_near_dedup_threshold(spark):
    """One word of 60 replaced: 51 of 61 shingles, linked from 0.80 on only."""
    rows = []
    for i in range(30):
        base = prose(100 + i, 60, 5000)
        near = list(base)
        near[20 + i % 20] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rule, n in ((neardup.WIDE, 30), (neardup.LINK, 60)):
        out = neardup.near_duplicates(docs, rule=rule)
        assert rows_of(out, "doc_id", "n_shingles", "component_id") == by_repr(near_components(rows, link=rule.link))
        assert neardup.deduplicated(docs, rule=rule).count() == n


def test_estimate_is_close(spark):
    import numpy as np

    r = np.random.default_rng(1)
    for j in (0.5, 0.85, 0.95):
        n = 2000
        both = round(2 * n * j / (1 + j))
        est = []
        for _ in range(20):
            x = r.integers(1, 2 ** 62, 2 * n - both).astype(np.uint64)
            regs = neardup.sketches([x[:n], x[n - both:]])
            est.append(neardup.estimate(regs[:1], regs[1:], np.array([float(n)]), np.array([float(n)]))[0])
        assert abs(np.mean(est) - j) < 0.03


def test_substring_dedup(spark):
    out = substrings.report(frame(spark))
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == by_repr(substring_rows(pairs()))
    assert sum(r.n_removed for r in out.collect()) > 100


ITEMS = [(1, " ".join(prose(2, 70)[5:30])), (2, "One TWO"), (3, None), (4, "..."), (5, " ".join(prose(2, 70)[5:30])),
         (None, " ".join(prose(5, 30_000, 5000)[29_900:29_930])), (10, "unseen words in this item only")]


@pytest.mark.parametrize("block_bytes", [8 << 20, 100])
def test_decontamination(spark, block_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.report(frame(spark), bench, block_bytes=block_bytes)
    want = decontaminated_rows(pairs(), ITEMS)
    assert rows_of(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == by_repr(want)
    src = frame(spark)
    clean = decontaminate.decontaminated(src, bench, block_bytes=block_bytes)
    assert clean.columns == src.columns
    assert by_repr([r.doc_id for r in clean.collect()]) == by_repr([r[0] for r in want if not r[5]])


def test_mixing(spark):
    src = frame(spark)
    out = mixing.report(src).collect()
    sizes = {}
    for _, t, _, s, _ in messy():
        sizes[s] = sizes.get(s, 0) + len(words(t))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    # Shared by weight again and again until nothing is above twice its source.
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    source = {r[0]: r[3] for r in messy()}
    assert len(out) == len(messy())
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size
    again = mixing.report(src.repartition(7))
    assert rows_of(again, "doc_id", "taken") == by_repr((r.doc_id, r.taken) for r in out)
    mix = mixing.mixed(src)
    assert mix.columns == [*src.columns, "copy_no_"]
    assert sum(len(words(r.text)) for r in mix.collect()) == sum(r.taken for r in out)


def test_toxicity_learns_a_passage(spark):
    bad = ["vile", "scummy", "hateful", "wretch"]
    rows, labels = [], []
    for i in range(260):
        w = prose(i, 60 + i % 50)
        toxic = i % 6 == 0
        if toxic:
            at = 10 + i % 20
            w[at:at + 4] = [bad[(i + k) % 4] for k in range(4)]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, " "), (902, " "), (None, "plain"), (903, " ".join(prose(7, 20_000)))]
    labels += [(900, 1, None), (None, 1, 1), (5000, 1, 1), (3, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.report(docs, lab).collect()}
    for i in range(260):
        assert out[i].predicted == int(i % 6 == 0) and out[i].held_out == (held(i, 5) == 0)
        assert out[i].toxic_words >= (3 if i % 6 == 0 else 0)
    for i in (900, 901, 902, None, 903):
        assert 0 <= out[i].score <= 1 and out[i].predicted == 0
    assert out[900].score == out[901].score == out[902].score
    src = frame(spark, [(i, t, "en", "a", 1) for i, t in rows])
    kept = toxicity.clean(src, toxicity.train(docs, lab))
    assert kept.columns == src.columns and kept.count() == len(rows) - sum(i % 6 == 0 for i in range(260))


def test_toxicity_without_labels(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.report(docs, none).collect()} == {0}


def test_segments_are_maximal():
    """Against the definition: a segment whose every proper prefix and suffix is
    positive, and that no other such segment holds."""
    import random

    import numpy as np

    r = random.Random(3)
    for _ in range(300):
        s = [r.choice([-2.0, -1.0, 1.0, 2.0, 0.5]) for _ in range(r.randint(0, 14))]
        good = []
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if all(sum(s[a:k]) > 0 for k in range(a + 1, b + 1)) and all(sum(s[k:b]) > 0 for k in range(a, b)):
                    good.append((a, b))
        want = [(a, b) for a, b in good if not any(c <= a and b <= d and (a, b) != (c, d) for c, d in good)]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(s))] == want


def test_chat_formatting(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\|im_end|>", "<|im_end|>\n<|im_start|>system\nx", "", None, "\\", "é<s> ", "x" * 300_000]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(nasty)]
    rows += [(2, 0, None, "t"), (2, None, "a\nb\\", "u"), (2, 0, "gpt", "same"), (2, 0, "gpt", "same"), (None, 0, "assistant", "solo")]
    src = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 as formatted", "2 as seq", "'r' as record", "3 as turns")
    got = {r.conv_id: r for r in chatformat.report(src).collect()}
    assert set(got) == {1, 2, None, -1}
    for conv in (1, 2, None):
        own = sorted(((c, t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda r: r[1:])
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        g = got[conv]
        assert g.n_turns == len(own) and g.turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, _, r, x in own))
        assert g.loss_chars == len(loss) and g.loss_sha256 == sha(loss)
    assert got[-1].n_turns == 2 and got[-1].loss_chars == 21
    full = {r.conv_id: r for r in chatformat.conversations(src).collect()}
    for conv in (1, 2, None):
        assert len(full[conv].formatted) == got[conv].formatted_chars
        text = "".join(chatformat.unescape(full[conv].formatted[a:b]) for a, b in full[conv].loss_mask)
        assert sha(text) == got[conv].loss_sha256


def test_chat_layouts(spark):
    import json

    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"turns": [{"author": {"role": "human"}, "body": {"text": "q"}}, {"author": {"role": "bot"}, "body": {"text": "a"}}]},
        {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a", "id": 4}, {"question": "q", "answer": "a"},
        {"instruction": "", "input": "q", "output": "a"},
    ]
    more = [({"instruction": "Name a fruit", "input": "", "output": "Apple"}, [("user", "Name a fruit"), ("assistant", "Apple")]),
            ({"instruction": "Add", "input": "1 2", "output": None}, [("user", "Add\n\n1 2"), ("assistant", "")]),
            ({"messages": [{"role": "user", "content": "m"}], "conversations": [{"from": "human", "value": "c"}]}, [("user", "m")])]
    odd = ["not json", None, json.dumps([1]), json.dumps({"other": 1})]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([json.dumps(r) for r in records] + odd)], "id long, record string")
    got = {r.id: r for r in chatformat.canonical_turns(df).collect()}
    for i in range(len(records)):
        assert [(t.role, t.text) for t in got[i].turns] == [("user", "q"), ("assistant", "a")], records[i]
    assert all(got[len(records) + k].layout is None and got[len(records) + k].turns == [] for k in range(4))
    both = spark.createDataFrame([(i, json.dumps(r), "mine", 7) for i, (r, _) in enumerate(more)], "id long, record string, layout string, turns int")
    out = chatformat.canonical_turns(both)
    assert out.columns == ["id", "layout", "turns", "fingerprint", "layout_", "turns_"]
    for r in out.collect():
        assert [(t.role, t.text) for t in r.turns_] == more[r.id][1] and r.layout == "mine"


PII_TEXTS = [
    "mail a.b+c@x-y.example.com, or d@e.f x@y", "c@d.com_x@y.org 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255", None, "",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111", "+1 (988) 555-2485 or +49 30 1234567890 +1 2 +12345678",
    "é😀 4539 1488 0343 6467 x +1.988.555.2485.", "9" * 50_000, "a" * 50_000 + "@" + "b" * 20 + ".c", "+1" + " " * 20_000 + "5",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9", "12 34", "x@@y.z", "...1.1.1.1", "a@b..c a@b.c..",
]


def base_spans(x):
    x, out = x or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x) if "@" in x else []:
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if "." in x else []:
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(sum(divmod(v * (1 + k % 2), 10)) for k, v in enumerate(reversed(d))) % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return sorted(out)


def test_pii_base_spans(spark):
    rows = [(i, x) for i, x in enumerate(PII_TEXTS)] + [(0, PII_TEXTS[0]), (None, PII_TEXTS[1])]
    out = pii.report(frame(spark, [(i, x, "en", "a", 1) for i, x in rows]))
    want = [(i, *[sum(k == n for k, _, _ in base_spans(x)) for n in range(4)],
             sha(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base_spans(x)))) for i, x in rows]
    assert rows_of(out, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == by_repr(want)


def test_pii_bootstraps_unseen_identifiers(spark):
    rows = [(i, f"{' '.join(prose(i, 5))} reachable under {m} anytime {' '.join(prose(i + 50, 5))}")
            for i, m in enumerate([f"p{k}@mail.example.com" for k in range(12)] + ["handle#2291-zz", "user_77120"])]
    rows += [(50, "version 20.04.1-x is out"), (51, "build 77123456 done")]
    out = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[12].n_id == out[13].n_id == 1 and out[50].n_id == out[51].n_id == 0
    kind, a, b = out[12].spans.split(":")
    assert kind == "id" and rows[12][1][int(a):int(b)] == "handle#2291-zz"


def test_pii_bootstraps_over_two_hops(spark):
    """No seed stands after "ticket": only identifiers found beside seeds do."""
    known = [f"acct-77{k:03d}" for k in range(10)]
    texts = [f"reachable under {m} anytime" for m in [f"p{k}@mail.example.com" for k in range(40)] + known]
    texts += [f"closed ticket {m} yesterday" for m in [*known, "zeta-90210"]] + ["version 20.04.1-x is out"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.n_id for r in pii.report(docs).collect()}
    assert [i for i in range(len(texts)) if out[i]] == list(range(40, 61))


def test_pii_context_reaches_over_other_matches(spark):
    """The word before an identifier may be a match itself."""
    texts = [f"unit7 {m} end{k}x" for k, m in enumerate([f"p{k}@mail.example.com" for k in range(12)] + ["handle#2291-zz"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in pii.report(docs).collect() if r.n_id} == {12}


def brute_identifiers(texts):
    """The strings that the bootstrap finds, by its definition."""
    from collections import defaultdict

    edge = re.compile(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")

    def word(w):
        w = re.sub("[0-9]+", "0", w.lower())
        w = re.sub(r"^[!-/:-@\[-`{-~]+(?=[^\W\d_])", "", w)
        return re.sub(r"(?<=[^\W\d_])[!-/:-@\[-`{-~]+$", "", w)

    def patterns(before, after):
        b, a = words(before), words(after)
        left, right = word(b[-1]) if b else "", word(a[0]) if a else ""
        further = word(b[-2]) if len(b) > 1 else ""
        return ([f"L {left}"] if left else []) + ([f"LL {further} {left}"] if left and further else []) + (
            [f"R {right}"] if right else []) + ([f"B {left} {right}"] if left and right else [])

    edges, secrets, cands = {}, set(), set()
    for x in texts:
        spans = base_spans(x)
        for _, s, e in spans:
            for p in patterns(x[:s], x[e:]):
                edges[p, x[s:e]] = 1.0
        for m in re.finditer(r"[^\x20\x09-\x0D]+", x):
            core = edge.sub("", m[0])
            s = m.start() + len(m[0]) - len(re.sub(r"^[!-/:-@\[-`{-~]+", "", m[0]))
            if not re.search("[0-9]", m[0]) or len(core) < 6 or any(a < s + len(core) and s < b for _, a, b in spans):
                continue
            shape = bool(re.fullmatch(pii.SECRET[2:-2], core))
            cands.add(core)
            secrets |= {core} if shape else set()
            for p in patterns(x[:m.start()], x[m.end():]):
                edges[p, core] = max(edges.get((p, core), 0.0), float(shape))
    of = defaultdict(set)
    for p, h in edges:
        of[p].add(h)
    keep = {p for p, hs in of.items() if len(hs) > pii.MIN_SEEDS and sum(edges[p, h] for h in hs) < len(hs)}
    edges = {k: s for k, s in edges.items() if k[0] in keep}
    found = set(secrets)
    while True:
        seed = defaultdict(float)
        for (p, h), s in edges.items():
            seed[h] = max(seed[h], s)
        score = None
        for _ in range(pii.ROUNDS):
            conf = {}
            for p in {k[0] for k in edges}:
                mine = [(edges[k], edges[k] if score is None else max(edges[k], score[k[1]])) for k in edges if k[0] == p]
                conf[p] = sum(v for _, v in mine) / (len(mine) + pii.SMOOTH) if sum(s for s, _ in mine) >= pii.MIN_SEEDS else 0.0
            score = {h: max(conf[k[0]] for k in edges if k[1] == h) for h in {k[1] for k in edges}}
        good = {h for h, v in score.items() if v >= pii.ACCEPT}
        found |= good
        if not {h for h in good if seed[h] < 1}:
            return found & cands
        edges = {(p, h): 1.0 if h in good else seed[h] for p, h in edges}


def test_pii_bootstrap_against_brute_force(spark):
    import random

    r, texts = random.Random(9), []
    ids = [f"acct-{k}77{k:03d}" for k in range(12)] + [f"u{k}#20{k}xx" for k in range(8)]
    frames = ["reachable under {} anytime", "closed ticket {} yesterday", "see {}", 'token = "{}"!!', "user: {}, now", "build {} done"]
    for i in range(140):
        kind = r.random()
        what = (f"p{r.randint(0, 40)}@mail.example.com" if kind < 0.5 else r.choice(ids) if kind < 0.9
                else "".join(r.choice("0123456789abcdef") for _ in range(39)) + "a")
        texts.append(" ".join(prose(i, 3)) + " " + r.choice(frames[:4] if kind >= 0.9 else frames).format(what) + " " + " ".join(prose(i + 500, 3)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(s.doc_id, s.text) for s in pii.listed(docs).filter("kind = 'id'").collect()}
    assert {t for _, t in got} == brute_identifiers(texts)
    assert len([t for _, t in got if len(t) == 40]) > 5 and any(t in ids for _, t in got)
    for i, t in got:
        assert t in texts[i]


def test_pii_secrets_by_shape(spark):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(0, f'x token = "{secret}" y'), (1, f"TOKEN = \"{secret.upper()}\"!!"), (2, "9" * 40), (3, "deadbeef" * 3), (4, "key AKIA" + "B2" * 8)]
    out = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].n_id for i in range(5)] == [1, 1, 0, 0, 1] and out[0].n_spans == 1
    kind, a, b = out[1].spans.split(":")
    assert rows[1][1][int(a):int(b)] == secret.upper()


def brute_scores(rows, order, gain, weights):
    import math
    from collections import Counter, defaultdict

    docs = [(i, held(i, 7) == 2, [*words((x or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))), "\n"])
            for i, x in rows]
    c = [Counter() for _ in range(order + 2)]
    for _, h, t in docs:
        for n in range(1, order + 2) if not h else ():
            c[n].update(tuple(t[k:k + n]) for k in range(len(t) - n + 1))
    total, types, tree = sum(c[1].values()), len(c[1]), {}
    least = suffixtree.least_count(total)

    def p(s, w):
        while s and s not in tree:
            s = s[1:]
        if not s:
            return (c[1][w,] + 1) / (total + types + 1)
        return (c[len(s) + 1][(*s, w)] + tree[s] * p(s[1:], w)) / (c[len(s)][s] + tree[s])

    for n in range(2, order + 2):
        nexts, new = defaultdict(list), {}
        for g in c[n]:
            nexts[g[:-1]].append(g[-1])
        for s, ws in nexts.items():
            size = c[n - 1][s]
            if size >= least:
                q = [(c[n][(*s, w)], p(s[1:], w)) for w in ws]
                gains = [sum(m * (math.log((m - 1 + k * x) / (size - 1 + k)) - math.log(x)) for m, x in q) for k in weights]
                if max(gains) > gain:
                    new[s] = weights[gains.index(max(gains))]
        tree |= new
    out = []
    for i, h, t in docs:
        base = sum(math.log10((c[1][w,] + 1) / (total + types + 1)) for w in t)
        out.append((i, h, len(t), sum(c[1][w,] > 0 for w in t), total, base,
                    sum(math.log10(p(tuple(t[max(0, k - order):k]), w)) for k, w in enumerate(t))))
    return out, tree


def chained(seed, n, order):
    """Words that follow from the last ``order`` ones, now and then a random one."""
    import random

    r, w = random.Random(seed), [0] * order
    for _ in range(n):
        w.append(r.randrange(3) if r.random() < 0.2 else sum((k + 1) * x for k, x in enumerate(w[-order:], 1)) % 3 + 1 - (order == 1))
        w[-1] %= 3
    return [f"{'abc'[order - 1]}{x}" for x in w]


@pytest.mark.parametrize("order", [1, 3])
def test_suffix_tree(spark, order):
    rows = pairs() + [(100 + i, " ".join(chained(i, 300, i % 3 + 1))) for i in range(24)]
    out = suffixtree.score_texts(frame(spark, [(i, x, "en", "a", 1) for i, x in rows]), order=order)
    want, tree = brute_scores(rows, order, suffixtree.GAIN, suffixtree.WEIGHTS)
    assert len(tree) > 5 and {len(s) for s in tree} == set(range(1, order + 1))
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert rows_of(out, *names) == by_repr(w[:5] for w in want)
    for col, at in (("base_score", 5), ("score", 6)):
        assert sorted(r[col] for r in out.collect()) == pytest.approx(sorted(w[at] for w in want), abs=1e-3)


def test_suffix_tree_keeps_a_context_at_every_size(spark):
    """A context seen 9 times stays when 7 million other tokens stand beside it."""
    ids = [i for i in range(100) if not held(i, 7) == 2]
    few = spark.createDataFrame([(i, "alpha beta") for i in ids[:9]], "doc_id long, text string")
    many = few.unionByName(spark.sql(f"SELECT {ids[9]}L AS doc_id, repeat('x ', 7000000) AS text"))
    for docs in (few, many):
        got = {r.doc_id: r.n_context for r in suffixtree.score_texts(docs).collect()}
        assert [got[i] for i in ids[:9]] == [2] * 9


def test_empty_tables(spark):
    docs = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for out in (exact.deduplicate(docs, exact.new_index(spark, 4)), lines.report(docs), lines.cleaned(docs), neardup.near_duplicates(docs),
                neardup.deduplicated(docs), substrings.report(docs), decontaminate.report(docs, bench), decontaminate.decontaminated(docs, bench),
                mixing.report(docs), mixing.mixed(docs), toxicity.report(docs, lab), pii.report(docs), suffixtree.report(docs)):
        assert out.count() == 0
    assert [r.conv_id for r in chatformat.report(conv).collect()] == [-1]
    # Documents, but an empty benchmark.
    assert decontaminate.report(frame(spark), bench).filter("contaminated").count() == 0
    assert decontaminate.decontaminated(frame(spark), bench).count() == len(messy())


@pytest.mark.parametrize("hot_degree", [3, 200_000])
def test_components(spark, monkeypatch, hot_degree):
    import random

    from shelfspark.llm import components as C

    monkeypatch.setattr(C, "HOT_DEGREE", hot_degree)
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(-7, 9), (9, -7), (3, 3)]
    edges += [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(120)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {(x.node, x.label) for x in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(x, root(x)) for a, b in edges if a != b for x in (a, b)}
