"""Spelling variants by permuterm rotations.

Every word is marked with a terminator and rotated.  A rotation that ends with the
character at an edited place has everything else of the word as its prefix, so two
words of one length that differ at that place share the prefix, and a word without
that character has the prefix as a whole rotation of its own.  Sorting rotations
and prefixes puts all words around one edit side by side: one scan over the sorted
groups finds replacements (members of a group) and indels (the group's whole
rotation).  A group holds one word per character at the edited place, so its size
is bounded by the alphabet, not by the data; per member the scan emits one row, the
number of its neighbours in the group and the best of them, never pairs.  A
character in a run of equal ones can be deleted at any of their places with the
same result: only the first place counts for indels, so every pair is met once.

Words are counted over all documents before anything else; only the vocabulary is
rotated.  A prefix of up to PLAIN code points is its own key, a longer one is keyed
by two polynomial hashes modulo 2**61 - 1 (a pair of different prefixes of n code
points agrees in both with probability below (n / 2**61)**2), so a word of n code
points costs n, not n**2.

Defined results: a null text has no words; a null doc_id counts as the empty text;
repeated rows count again; among near words of equal count the one first in
code-point order is the form; empty tables give empty results; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import join_counted, stored

LETTERS = r"a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, NOISE = 5, 3, 97
#: A form occurs at least so many times as often as the word.
RATIO = 2
#: Terminator of a word; no letter.
END = "$"
PLAIN = 64
_P = (1 << 61) - 1
_BASES = (1_000_003_133, 2_038_074_743_927)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): distinct runs of letters and their occurrences.  Where ``noise``
    divides crc32(doc_id:run), one code point of the run is deleted first (0: never)."""
    low = F.translate(F.col(text), UPPER, LOWER)
    # A run that is too short before the deletion is too short after it.
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"),
                       F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{max(least_length, 1)},}}"), F.lit(0))).alias("word"))
    if noise:
        h = F.crc32(F.concat("d", F.lit(":"), "word").cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("h", h).withColumn("word", F.when(F.col("h") % noise == 0, cut).otherwise(F.col("word")))
    return (runs.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= least_count))


def numbered(words: DataFrame) -> DataFrame:
    """(id, word, n), stored; ids ascend in code-point order."""
    return stored(words.select("word", "n").orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"),
                  "permuterm-words")


def _hashes(word: str) -> list[tuple[list[int], list[int]]]:
    """Per base: prefix hashes of the word and powers of the base."""
    out = []
    for base in _BASES:
        pre, power = [0], [1]
        for c in map(ord, word):
            pre.append((pre[-1] * base + c + 1) % _P)
            power.append(power[-1] * base % _P)
        out.append((pre, power))
    return out


def rotation_keys(word: str) -> tuple[list[str], list[str], list[bool]]:
    """Keys of the whole rotations from each place, keys of the rotations that end
    with each place's character, without it, and whether an indel counts there."""
    size = len(word)
    first = [i == 0 or word[i] != word[i - 1] for i in range(size)]
    if size < PLAIN:
        return ([word[i:] + END + word[:i] for i in range(size + 1)], [word[i + 1:] + END + word[:i] for i in range(size)], first)
    tables, mark = _hashes(word), ord(END) + 1

    def key(start: int, end: int) -> str:
        """word[start:] END word[:end]"""
        if size - start + end <= PLAIN:
            return word[start:] + END + word[:end]
        parts = []
        for base, (pre, power) in zip(_BASES, tables):
            tail = (pre[size] - pre[start] * power[size - start]) % _P
            parts.append(((tail * base + mark) * power[end] + pre[end]) % _P)
        return f"#{size - start + end}:{parts[0]:x}:{parts[1]:x}"

    return [key(i, i) for i in range(size + 1)], [key(i + 1, i) for i in range(size)], first


_ROTATION = "key string, id long, n long, whole boolean, first boolean"
_MEMBER = "id long, n_near long, best_n long, best_id long"


def _rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(keys, ids, ns, whole, first):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()),
                                           pa.array(whole, pa.bool_()), pa.array(first, pa.bool_())],
                                          names=["key", "id", "n", "whole", "first"])
    for b in batches:
        out = [], [], [], [], []
        for i, word, n in zip(*(b.column(c).to_pylist() for c in ("id", "word", "n"))):
            full, skip, first = rotation_keys(word)
            for dst, x in zip(out, (full + skip, [i] * (len(full) + len(skip)), [n] * (len(full) + len(skip)),
                                    [True] * len(full) + [False] * len(skip), [False] * len(full) + first)):
                dst.extend(x)
            if len(out[0]) > 20_000:
                yield batch(*out)
                out = [], [], [], [], []
        if out[0]:
            yield batch(*out)


def _better(n: np.ndarray, i: np.ndarray, n2: np.ndarray, i2: np.ndarray) -> np.ndarray:
    return (n > n2) | ((n == n2) & (i < i2))


def _members(t: pa.Table, new: np.ndarray) -> pa.RecordBatch:
    """Whole groups, each with its whole rotation first, then by falling count and
    ascending id: one row per member that has neighbours there."""
    ids, n = t.column("id").to_numpy(), t.column("n").to_numpy()
    whole = t.column("whole").to_numpy(zero_copy_only=False)
    first = t.column("first").to_numpy(zero_copy_only=False)
    start = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    size = np.diff(np.r_[start, new.size])
    has = whole[start].astype(np.int64)
    skips = size - has
    last = new.size - 1
    # The best member that is not the row itself: the first one, for the first one the second.
    at = np.arange(new.size)
    other = np.minimum(np.where(at == (start + has)[of], at + 1, (start + has)[of]), last)
    with_other = ~whole & (skips[of] > 1)
    best_n, best_id = np.where(with_other, n[other], -1), np.where(with_other, ids[other], -1)
    indel = ~whole & first & (has[of] == 1)
    top = indel & _better(n[start[of]], ids[start[of]], best_n, best_id)
    best_n, best_id = np.where(top, n[start[of]], best_n), np.where(top, ids[start[of]], best_id)
    near = np.where(whole, 0, skips[of] - 1 + indel)
    # The group's whole rotation: its neighbours are the members whose place counts.
    near[start[has == 1]] = np.add.reduceat(first.astype(np.int64), start)[has == 1]
    f = np.flatnonzero(first)
    lead = f[np.r_[True, of[f][1:] != of[f][:-1]]] if f.size else f
    lead = lead[has[of[lead]] == 1]
    best_n[start[of[lead]]], best_id[start[of[lead]]] = n[lead], ids[lead]
    keep = near > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(near[keep].astype(np.int64)), pa.array(best_n[keep]),
                                       pa.array(best_id[keep])], names=["id", "n_near", "best_n", "best_id"])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rotations of a partition; a group that a batch ends in waits for
    the next batch (it is never larger than the alphabet)."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        keys = t.column("key").combine_chunks()
        new = np.r_[True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)]
        cut = int(np.flatnonzero(new)[-1])
        rest = t.slice(cut)
        if cut:
            yield _members(t.slice(0, cut).combine_chunks(), new[:cut])
    if rest is not None and rest.num_rows:
        yield _members(rest.combine_chunks(), np.r_[True, np.zeros(rest.num_rows - 1, bool)])


def neighbours(words: DataFrame) -> DataFrame:
    """``numbered`` words -> (id, n_near, best_n, best_id): the words at edit distance
    one, and the one of them with the largest count, the first in code-point order
    among equals.  Words without near words have no row."""
    groups = (words.select("id", "word", "n").mapInArrow(_rotated, _ROTATION).repartition("key")
              .sortWithinPartitions("key", F.desc("whole"), F.desc("n"), "id"))
    best = F.max(F.struct("best_n", (-F.col("best_id")).alias("i")))
    return (groups.mapInArrow(_scanned, _MEMBER).groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("id", "n_near", F.col("b.best_n").alias("best_n"), (-F.col("b.i")).alias("best_id")))


def _looked_up(rows: DataFrame, key: str, table: DataFrame, total: int) -> DataFrame:
    """Inner join of ``rows`` on ``key`` with ``table`` (``key`` and more), one row per key."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows_of_key"))
    return join_counted(rows, table.join(sizes, key), [key], "rows_of_key", total).drop("rows_of_key")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n) -> word, form, root, n, n_near, form_n.

    Counts grow at least ``ratio``-fold from a word to its form, so chains of forms
    are logarithmic in the largest count; a round follows every chain by one step,
    and only words whose end is not reached take part in the next."""
    words = numbered(words)
    found = (words.join(neighbours(words), "id", "left")
             .withColumn("is_form", F.col("best_n") >= ratio * F.col("n"))
             .select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                     F.when(F.col("is_form"), F.col("best_id")).alias("form_id"),
                     F.when(F.col("is_form"), F.col("best_n")).alias("form_n")))
    found = stored(found, "permuterm-found")
    step = found.filter("form_id is not null").select(F.col("id").alias("at"), F.col("form_id").alias("next"))
    open_ = stored(step.select(F.col("at").alias("id"), F.col("next").alias("at")), "permuterm-chains")
    ends = None
    while total := open_.count():
        moved = stored(_looked_up(open_, "at", found.select(F.col("id").alias("at"), F.col("form_id").alias("next")), total),
                       "permuterm-chains")
        done = moved.filter("next is null").select("id", F.col("at").alias("root_id"))
        ends = done if ends is None else ends.unionByName(done)
        open_ = moved.filter("next is not null").select("id", F.col("next").alias("at"))
    if ends is None:
        ends = found.select("id", F.col("id").alias("root_id")).limit(0)
    chained = stored(found.filter("form_id is not null").join(ends, "id"), "permuterm-ends")
    total = chained.count()
    for key, name in (("form_id", "form"), ("root_id", "root")):
        chained = _looked_up(chained, key, words.select(F.col("id").alias(key), F.col("word").alias(name)), total)
    names = ["word", "form", "root", "n", "n_near", "form_n"]
    return (found.filter("form_id is null").withColumn("form", F.lit(None).cast("string")).withColumn("root", F.col("word"))
            .select(*names).unionByName(chained.select(*names)))


def report(docs: DataFrame, **options) -> DataFrame:
    return variants(vocabulary(docs, **options))
