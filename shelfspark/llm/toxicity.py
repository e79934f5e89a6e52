"""Toxic passages by maximum-scoring segment search.

Training (on a bounded sample of labelled documents) gives every word a log-odds
of toxic against clean documents with Dirichlet priors: the prior of a word is
its stem (first letters), the prior of a stem the label's share.  Scoring walks
once over a document's words and finds all maximal scoring segments (linear
time); Karlin-Altschul statistics of the clean training documents turn segment
scores into bits above what a text of that length reaches by chance; their sum
over the document goes through a logistic curve fitted by cross-fitting: each half
of the sample is scored with the log-odds of the other half.

Only the text is read for a score.  Defined results: null and wordless texts
score as texts without any passage; a document labelled twice counts as toxic if
one label says so, null labels are ignored; labels of unknown documents are
ignored; without toxic or clean training documents every score is the share of
toxic labels (0 with no labels); repeated rows get equal scores; input columns
pass through ``clean`` untouched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import Words, binary_values, hash_mod, stored
from shelfspark.llm.decontaminate import split_words

#: Bounds of the training sample, in labelled documents of each class.
SAMPLE_TOXIC, SAMPLE_CLEAN = 6_000, 14_000
FOLDS, HELD_OUT = 5, 0
STEM = 4
PRIOR_WORD, PRIOR_STEM = 2.0, 4.0
#: A word (a stem) needs that many training documents to be scored by itself.
MIN_DOCS = 3
#: Words without a significant (in standard errors) and sizeable log-odds count
#: against a passage by DRIFT.
SIGNIFICANT, EFFECT = 3.0, math.log(4)
DRIFT = 0.03
MOST = 8.0


@dataclass
class Model:
    word: dict[bytes, float] = field(default_factory=dict)
    stem: dict[bytes, float] = field(default_factory=dict)
    other: float = -DRIFT
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -30.0

    def token_scores(self, words: list[bytes]) -> np.ndarray:
        word, stem, other = self.word, self.stem, self.other
        return np.fromiter((word[w] if w in word else stem.get(w[:STEM], other) for w in words), np.float64, len(words))


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) of a score sequence with their
    scores, in one pass.

    Only positive scores can begin a candidate; the running total carries what
    lies between.  A candidate joins the nearest earlier one whose total before
    it is smaller, if its own total after is larger.
    """
    total = np.concatenate([[0.0], np.cumsum(s)])
    out: list[list] = []
    for i in np.flatnonzero(s > 0).tolist():
        start, low, high = i, total[i], total[i + 1]
        while out:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0 or out[j][3] >= high:
                break
            start, low = out[j][0], out[j][2]
            del out[j:]
        j = len(out) - 1
        while j >= 0 and out[j][2] >= low:
            j = out[j][4]
        out.append([start, i + 1, low, high, j])
    return [(a, b, hi - lo) for a, b, lo, hi, _ in out]


def statistic(model: Model, s: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum over segments of the nats above chance level, and those segments.
    Without any, how far the best segment stays below that level (at most 0)."""
    if not s.size or not (s > 0).any():
        return -math.log(max(s.size, 1) + 1.0) - model.log_k, []
    level = model.log_k + math.log(s.size)
    found = [(a, b, model.lam * x - level) for a, b, x in segments(s)]
    over = [f for f in found if f[2] > 0]
    return (sum(f[2] for f in over) if over else max(f[2] for f in found)), over


def log_odds(toxic: Counter, clean: Counter, stem_t: Counter, stem_c: Counter, n_toxic: int, n_clean: int) -> tuple[dict, dict]:
    """Scores of words and of stems from document counts in each class; a count is
    held against all counts of its class, so that longer documents of one class
    don't lift every word."""
    base = n_toxic / (n_toxic + n_clean)

    def odds(t: int, c: int, more_t: float, more_c: float) -> float:
        value = math.log((t + more_t) / n_toxic) - math.log((c + more_c) / n_clean)
        error = math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        return min(max(value, -MOST), MOST) if abs(value) >= max(SIGNIFICANT * error, EFFECT) else -DRIFT

    stem, share = {}, {}
    for s in stem_t.keys() | stem_c.keys():
        t, c = stem_t[s], stem_c[s]
        share[s] = (t + PRIOR_STEM * base) / (t + c + PRIOR_STEM)
        if t + c >= MIN_DOCS:
            stem[s] = odds(t, c, PRIOR_STEM * base, PRIOR_STEM * (1 - base))
    word = {}
    for w in toxic.keys() | clean.keys():
        t, c = toxic[w], clean[w]
        if t + c >= MIN_DOCS:
            p = share.get(w[:STEM], base)
            word[w] = odds(t, c, PRIOR_WORD * p, PRIOR_WORD * (1 - p))
    return word, stem


def solve_lambda(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum(weight * exp(lam * score)) = 1 (bisection)."""
    lo, hi = 1e-3, 1.0
    weight = weight / weight.sum()
    value = lambda x: float((weight * np.exp(np.minimum(x * scores, 500))).sum())
    while value(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 1 else (lo, mid)
    return (lo + hi) / 2


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted one-feature logistic regression by Newton steps (a small ridge
    keeps separable data finite)."""
    a, b = 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -35, 35)))
        g, h = w * (y - p), w * p * (1 - p)
        ga, gb = g.sum() - 1e-3 * a, (g * x).sum() - 1e-3 * b
        haa, hab, hbb = h.sum() + 1e-3, (h * x).sum(), (h * x * x).sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 4.0 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if max(abs(da), abs(db)) < 1e-6:
            break
    return a, b


def training_ids(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """The bounded sample: doc_id, toxic, half (0: log-odds, 1: calibration).

    Never a row of the held-out fold.  Of each class the documents with the
    smallest md5 of their id, at most SAMPLE_TOXIC and SAMPLE_CLEAN.
    """
    one = (labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (hash_mod(doc_id, FOLDS) != HELD_OUT))
           .groupBy(F.col(doc_id).alias("doc_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
           .withColumn("k", F.md5(F.col("doc_id").cast("string").cast("binary"))))
    take = lambda y, n: one.filter(F.col("toxic") == y).orderBy("k", "doc_id").limit(n)
    return (take(1, SAMPLE_TOXIC).unionByName(take(0, SAMPLE_CLEAN))
            .withColumn("half", F.conv(F.substring("k", 32, 1), 16, 10).cast("int") % 2))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on the sample.  The sampled ids (at most SAMPLE_TOXIC + SAMPLE_CLEAN)
    are broadcast; only their texts are counted, and words with under MIN_DOCS
    documents are dropped before anything reaches the driver."""
    eligible = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (hash_mod("doc_id", FOLDS) != HELD_OUT))
    share = float(eligible.agg(F.avg((F.col("toxic") > 0).cast("double")).alias("p")).first().p or 0.0)
    ids = stored(training_ids(labels), "toxic-sample")
    sample = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
                    .join(F.broadcast(ids), "doc_id").select("toxic", "half", "text"), "toxic-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {(y, h): Counter() for y in (0, 1) for h in (0, 1)}
        for b in batches:
            for y, h, t in zip(b.column("toxic").to_pylist(), b.column("half").to_pylist(), binary_values(b.column("text"))):
                words = set(split_words(t))
                groups[y, h].update(words)
                groups[y, h].update(w + b" " for w in {w[:STEM] for w in words})
        for (y, h), c in groups.items():
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(c), pa.int32()), pa.array([h] * len(c), pa.int32()),
                                              pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())],
                                             names=["toxic", "half", "word", "n"])

    def of(y: int, h: int):
        return F.sum(F.when((F.col("toxic") == y) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"n{y}{h}")

    words = (sample.mapInArrow(count, "toxic int, half int, word binary, n long")
             .groupBy("word").agg(of(0, 0), of(0, 1), of(1, 0), of(1, 1))
             .filter(F.expr(f"n00 + n01 + n10 + n11 >= {MIN_DOCS}")).toPandas())
    n = {(r.toxic, r.half): r.n for r in sample.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys = [bytes(w) for w in words["word"]]

    def fitted(halves: tuple[int, ...]) -> Model | None:
        """The log-odds and chance level from these halves."""
        size = [sum(n.get((y, h), 0) for h in halves) for y in (0, 1)]
        if not all(size):
            return None
        both = [sum(words[f"n{y}{h}"] for h in halves).tolist() for y in (0, 1)]
        word, stem = ([Counter(), Counter()] for _ in range(2))
        for w, c, t in zip(keys, *both):
            into, key = (stem, w[:-1]) if w.endswith(b" ") else (word, w)
            into[0][key], into[1][key] = c, t
        model = Model()
        model.word, model.stem = log_odds(word[1], word[0], stem[1], stem[0], word[1].total(), word[0].total())
        seen = list(word[0])
        model.lam = solve_lambda(model.token_scores(seen), np.array([word[0][w] for w in seen], float))
        return model

    final, crossed = fitted((0, 1)), [fitted((1,)), fitted((0,))]
    if final is None or None in crossed:
        p = min(max(share, 1e-9), 1 - 1e-9)
        return Model(offset=math.log(p / (1 - p)))
    calibrate(final, crossed, sample, share)
    return final


def _words_scores(model: Model, texts: list[bytes]) -> list[np.ndarray]:
    """The score of every word of every text; the r-th occurrence of a word that
    speaks for toxicity counts 1 / r (a text of one word over and over is no
    series of independent signs)."""
    lex = Words()
    ids = [lex.add(split_words(t)) for t in texts]
    scores = model.token_scores(list(lex.ids))
    out = []
    for i in ids:
        s = scores[i]
        at = np.flatnonzero(s > 0)
        if at.size > 1:
            order = at[np.argsort(i[at], kind="stable")]
            first = np.r_[True, np.diff(i[order]) != 0]
            s[order] /= np.arange(at.size) - np.flatnonzero(first)[np.cumsum(first) - 1] + 1
        out.append(s)
    return out


def calibrate(final: Model, crossed: list[Model], sample: DataFrame, share: float) -> None:
    """The chance level K from the best segments of clean texts (the mean of a
    Gumbel variable), then the logistic curve, each half scored by the other's
    log-odds.  At most one row per sampled document reaches the driver."""
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, h, t = b.column("toxic").to_pylist(), b.column("half").to_pylist(), binary_values(b.column("text"))
            rows = [(math.nan, 0)] * len(t)
            for half, model in enumerate(crossed):
                at = [i for i in range(len(t)) if h[i] == half and y[i] == 0]
                for i, s in zip(at, _words_scores(model, [t[i] for i in at])):
                    top = max((x[2] for x in segments(s)), default=0.0)
                    rows[i] = (model.lam * top - math.log(s.size) if top > 0 else math.nan, half)
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.float64())],
                                             names=["half", "level"])

    levels = (sample.mapInArrow(best, "half int, level double").filter(~F.isnan("level"))
              .agg(F.avg("level").alias("m"), F.count(F.lit(1)).alias("n")).first())
    log_k = float(levels.m) - 0.5772156649 if levels.n else 0.0
    for model in (final, *crossed):
        model.log_k = log_k

    def stat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, t = np.array(b.column("half").to_pylist()), binary_values(b.column("text"))
            x = np.zeros(len(t))
            for half, model in enumerate(crossed):
                at = np.flatnonzero(h == half)
                x[at] = [statistic(model, s)[0] for s in _words_scores(model, [t[i] for i in at])]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.float64())], names=["toxic", "x"])

    fit = sample.mapInArrow(stat, "toxic int, x double").toPandas()
    y = fit["toxic"].to_numpy(float)
    w = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    final.offset, final.slope = logistic(squash(fit["x"].to_numpy(float)), y, w)


def squash(x):
    """Signed logarithm: long documents with many passages do not set the slope."""
    return np.sign(x) * np.log1p(np.abs(x))


def _scores(model: Model, stats: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.offset + model.slope * squash(stats), -35, 35)))


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_passages, toxic_words (words inside significant
    passages), passages (list of start word, end word, nats above chance), score."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [(len(s), *statistic(model, s)) for s in _words_scores(model, binary_values(b.column("text")))]
            p = _scores(model, np.array([e[1] for e in each]))
            found = [[{"start": a, "end": z, "nats": x} for a, z, x in e[2]] for e in each]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([e[0] for e in each], pa.int64()),
                pa.array([len(e[2]) for e in each], pa.int64()),
                pa.array([sum(z - a for a, z, _ in e[2]) for e in each], pa.int64()),
                pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("nats", pa.float64())]))),
                pa.array(p, pa.float64())],
                names=["doc_id", "n_words", "n_passages", "toxic_words", "passages", "score"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
            .mapInArrow(score, "doc_id long, n_words long, n_passages long, toxic_words long, "
                               "passages array<struct<start: long, end: long, nats: double>>, score double"))


def clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, all columns kept."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(x or "").encode() for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            p = _scores(model, np.array([statistic(model, s)[0] for s in _words_scores(model, texts)]))
            yield b.filter(pa.array(p < threshold))

    return docs.mapInArrow(keep, docs.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the passage counts of every document."""
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", (hash_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "n_passages", "toxic_words")
