"""Language-model scores from a probabilistic suffix tree over words.

Contexts are word sequences of up to ORDER words.  The tree keeps a context if it
was seen MIN_COUNT times in training, a number that does not depend on the size of
the input, and passes a divergence test against its suffix: the gain in
log-likelihood of its next words, each left out of its own counts, over the
suffix's distribution must exceed GAIN nats.  The distribution
of a kept context s is smoothed towards its suffix with a weight k of its own,

    P(w | s) = (n(s w) + k P(w | suffix of s)) / (n(s) + k),

k being the one of WEIGHTS with the largest gain; the empty context has the
add-one distribution over the training words and one unknown word.  A text is
scored word by word from the longest suffix of what came before that the tree
holds.

Counts of words, and of contexts with their next words, are totals over all blocks
of documents (see exchange.py); nothing of the model is collected.  The words that
follow a context meet in the bucket of the context's hash, each with its probability
after the context's suffix, so one exchange per context length gives totals, gains
and weights.

Defined results: null and wordless texts have the end token alone; a null doc_id
counts as the empty text in the split; without training documents every token
scores 0 (one unknown word of probability 1); repeated rows are each scored and
each counted.  Extra columns are not read.  Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import chain, pack, pack_sorted, unpack, unpack_sorted
from shelfspark.llm.exchange import (NO_ID, REPLY, REQUEST, VALS, hash_ranges, n_buckets, per_block, replies, reply_values,
                                     request_batch, request_rows, with_replies, write_blocks, write_replies)

ORDER = 3
MIN_COUNT = 2
GAIN = 8.0
WEIGHTS = (2.0, 16.0, 128.0, 1024.0, 8192.0, 65536.0)
FOLDS, HELD_OUT = 7, 2
END = b"\n"
#: Gains are taken from probabilities rounded to this part of an octave (two bytes).
OCTAVE = 1024.0


def least_count(tokens: int) -> int:
    """Occurrences a context needs: the same however many training tokens there are."""
    return MIN_COUNT


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def distinct_places(keys: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, which of them in that order are new, and the place of every
    key among the distinct ones."""
    order = np.argsort(keys) if order is None else order
    by = keys[order]
    new = np.ones(order.size, bool)
    step = by[1:] != by[:-1]
    new[1:] = step.any(axis=1) if step.ndim > 1 else step
    place = np.empty(order.size, np.int64)
    place[order] = np.cumsum(new) - 1
    return order, new, place


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Tokens per text, the number of every token's word, and the words."""
    raw = pa.array(texts, pa.binary()).view(pa.string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(raw))
    flat, text = parts.flatten(), pc.list_parent_indices(parts)
    there = pc.not_equal(pc.binary_length(flat), 0)
    flat, text = flat.filter(there).dictionary_encode(), text.filter(there).to_numpy()
    words = flat.dictionary.view(pa.binary()).to_pylist()
    n = np.bincount(text, minlength=len(texts)).astype(np.int64) + 1
    tok = np.full(int(n.sum()), len(words), np.int32)
    # Every text before a word has put its end in front of it.
    tok[np.arange(text.size) + text] = flat.indices.to_numpy()
    return n, tok, [*words, END]


def encode_tokens(ids: list, texts: list[bytes]) -> list[bytes]:
    """Token numbers (by falling frequency, which packs best) and word hashes."""
    n, tok, words = _tokens(texts)
    count = np.bincount(tok, minlength=len(words))
    order = np.argsort(-count, kind="stable")
    rank = np.empty(order.size, np.int32)
    rank[order] = np.arange(order.size, dtype=np.int32)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return [pack(np.array([NO_ID if i is None else i for i in ids], np.int64)), pack(n),
            pack(np.array([held_out(i) for i in ids], np.uint8)), pack(rank[tok]), pack(hashes[order])]


class Block:
    """A block's tokens and, level by level, its distinct n-grams with their totals."""

    def __init__(self, payload: list[bytes], got: dict, least: int = 0):
        self.ids, self.n = unpack(payload[0], np.int64), unpack(payload[1], np.int64)
        self.held = unpack(payload[2], np.uint8).astype(bool)
        self.tok = unpack(payload[3], np.int32).astype(np.int64)
        self.words = unpack(payload[4], np.uint64)
        self.begin = np.cumsum(self.n) - self.n
        self.train = np.repeat(~self.held, self.n)
        self.inner = np.ones(self.tok.size, bool)  # a token with one before it in its text
        self.inner[self.begin] = False
        #: The words by hash, and the place of each in that order.
        self.by_hash = np.argsort(self.words)
        self.place = np.empty(self.words.size, np.int64)
        self.place[self.by_hash] = np.arange(self.words.size)
        self.got, self.least, self._memo = got, least, {}

    def grams(self, level: int):
        """Distinct n-grams of ``level`` words at positions whose context counts:
        (gram per position or -1, hash per gram, count in this block's training
        texts, context per gram, last word per gram)."""
        if level == 1:
            return self.tok, self.words, np.bincount(self.tok[self.train], minlength=self.words.size), None, None
        ctx_at, ctx_hash, *_ = self.level(level - 1)
        total = self.total(level - 1)
        before = np.r_[np.int64(-1), ctx_at[:-1]]
        ok = self.inner & (before >= 0)
        ok[ok] = total[before[ok]] >= self.least
        at = np.flatnonzero(ok)
        pair = before[at] * self.words.size + self.tok[at]
        by, new, inv = distinct_places(pair)
        pair = pair[by[new]]
        ctx, word = pair // max(self.words.size, 1), pair % max(self.words.size, 1)
        gram = np.full(self.tok.size, -1, np.int64)
        gram[at] = inv
        return gram, chain(ctx_hash[ctx], self.words[word]), np.bincount(inv[self.train[at]], minlength=pair.size), ctx, word

    def _once(self, key, make: Callable):
        if key not in self._memo:
            self._memo[key] = make()
        return self._memo[key]

    def level(self, level: int):
        return self._once(level, lambda: self.grams(level))

    def order(self, level: int) -> np.ndarray:
        """The n-grams in the order in which they are asked for and answered: by the
        hash of the context, then of the last word."""
        def make():
            _, _, _, ctx, word = self.level(level)
            rank = np.empty(self.level(level - 1)[1].size, np.int64)
            rank[self.contexts(level - 1)] = np.arange(self.contexts(level - 1).size)
            return np.argsort(rank[ctx] * self.words.size + self.place[word])
        return self.by_hash if level == 1 else self._once(("order", level), make)

    def contexts(self, length: int) -> np.ndarray:
        """The contexts of ``length`` words that have a next word here, by hash."""
        def make():
            used = np.zeros(self.level(length)[1].size, bool)
            used[self.level(length + 1)[3]] = True
            used = np.flatnonzero(used)
            return used[np.argsort(self.level(length)[1][used])]
        return self._once(("contexts", length), make)

    def numbers(self) -> np.ndarray:
        """A number per word that all blocks share: less to send than a hash."""
        def make():
            out = np.empty(self.words.size, np.int64)
            out[self.by_hash] = reply_values(self.got, "n1", 1, np.int64)
            return out
        return self._once("numbers", make)

    def total(self, level: int) -> np.ndarray:
        """Training count of every n-gram of the level over all blocks."""
        def make():
            out = np.empty(self.level(level)[1].size, np.int64)
            out[self.order(level)] = reply_values(self.got, f"n{level}", 0, np.int64)
            return out
        return self._once(("total", level), make)

    def weight(self, length: int) -> np.ndarray:
        """Smoothing weight of every context of ``length`` words, 0: not in the tree."""
        def make():
            out = np.zeros(self.level(length)[1].size)
            out[self.contexts(length)] = np.r_[0.0, WEIGHTS][reply_values(self.got, f"n{length + 1}", 1, np.int8)]
            return out
        return self._once(("weight", length), make)

    def probability(self, level: int, base: float) -> np.ndarray:
        """P(last word | context) of every n-gram of the level, under the tree's
        contexts of up to level - 1 words."""
        def make():
            if level == 1:
                return (self.total(1) + 1.0) / base
            _, _, _, ctx, _ = self.level(level)
            p, n, size = self.suffix_probability(level, base), self.total(level), self.total(level - 1)[ctx]
            k = self.weight(level - 1)[ctx]
            return np.where(k > 0, (n + k * p) / (size + k), p)
        return self._once(("probability", level), make)

    def suffix_probability(self, level: int, base: float) -> np.ndarray:
        """The same n-grams without the first word of their context."""
        def make():
            gram, keys, _, _, word = self.level(level)
            shorter = self.probability(level - 1, base)
            if level == 2:
                return shorter[word]
            out = np.empty(keys.size)
            at = np.flatnonzero(gram >= 0)
            # A counted context has counted suffixes, so the shorter n-gram is there.
            out[gram[at]] = shorter[self.level(level - 1)[0][at]]
            return out
        return self._once(("suffix", level), make)

    def ask_words(self, block: int, buckets: int):
        n = self.level(1)[2]
        return request_rows("n1", block, self.words[self.by_hash], [n[self.by_hash].astype(np.int64)], buckets)

    def ask(self, level: int, block: int, buckets: int, base: float):
        """Per context its next words here, their counts and their probabilities
        after the context's suffix: all that its bucket needs for totals, gains and
        weight."""
        _, _, local, ctx, word = self.level(level)
        asked, order, p = self.contexts(level - 1), self.order(level), self.suffix_probability(level, base)
        keys, size = self.level(level - 1)[1][asked], np.bincount(ctx, minlength=self.level(level - 1)[1].size)[asked]
        word, local, end = self.numbers()[word[order]], local[order], np.cumsum(size)
        # The bucket needs a probability only with a count.
        p = np.where(local > 0, np.minimum(np.round(-OCTAVE * np.log2(p[order])), 65535), 0).astype(np.uint16)
        for a, b, bucket in hash_ranges(keys, buckets):
            pairs = slice(int(end[a] - size[a]), int(end[b - 1]))
            yield (f"n{level}", bucket, block, pack_sorted(keys[a:b]),
                   [pack(size[a:b].astype(np.int32)), pack(word[pairs]), pack(local[pairs].astype(np.int64)), pack(p[pairs])])


def context_replies(requests: DataFrame) -> DataFrame:
    """For every pair of a context and a next word its total, for every context the
    number of its best weight (from 1), 0 if it fails the divergence test."""
    def answer(table: pa.Table) -> pa.Table:
        tag, bucket = table.column("tag")[0].as_py(), table.column("bucket")[0].as_py()
        asked = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
        vals = table.column("vals").to_pylist()
        flat = lambda c, dtype: np.concatenate([unpack(v[c], dtype) for v in vals])
        keys, of = np.unique(np.concatenate(asked), return_inverse=True)
        ctx, word, n = np.repeat(of, flat(0, np.int32)), flat(1, np.int64), flat(2, np.int64)
        q = flat(3, np.uint16)
        words = int(word.max()) + 1
        if keys.size * words < 1 << 62:
            order, new, place = distinct_places(ctx * words + word)
        else:
            order = np.lexsort((word, ctx))
            order, new, place = distinct_places(np.stack([ctx, word], 1), order)
        start = np.flatnonzero(new)
        total = np.add.reduceat(n[order], start)
        p = np.exp2(np.maximum.reduceat(q[order], start) / -OCTAVE)
        owner = ctx[order][start]
        size = np.bincount(owner, total, minlength=keys.size)
        seen = np.flatnonzero(total > 0)
        m, s, p, owner = total[seen].astype(np.float64), size[owner[seen]], p[seen], owner[seen]
        log_p = np.log(p)
        gain = np.stack([np.bincount(owner, m * (np.log((m - 1 + k * p) / (s - 1 + k)) - log_p), minlength=keys.size) for k in WEIGHTS])
        best = np.where(gain.max(axis=0) > GAIN, gain.argmax(axis=0) + 1, 0).astype(np.int8)
        out, done, pairs = [], 0, 0
        for a, v in zip(asked, vals):
            m = int(unpack(v[0], np.int32).sum())
            out.append([pack(total[place[pairs:pairs + m]]), pack(best[of[done:done + a.size]])])
            done, pairs = done + a.size, pairs + m
        return pa.table({"tag": pa.array([tag] * len(out), pa.string()), "bucket": pa.array([bucket] * len(out), pa.int32()),
                         "block": table.column("block"), "vals": pa.array(out, VALS)})

    return requests.groupBy("tag", "bucket").applyInArrow(answer, REPLY)


_RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
           "n_context long")


def _score(order: int, base: float, least: int):
    def score(block: int, payload, got) -> pa.RecordBatch:
        b = Block(payload, got, least)
        known = b.total(1) > 0
        p0 = b.probability(1, base)
        p = p0[b.tok]
        depth = np.zeros(b.tok.size, np.int64)
        for level in range(2, order + 2):
            gram = b.level(level)[0]
            at = np.flatnonzero(gram >= 0)
            kept = b.weight(level - 1)[b.level(level)[3]] > 0
            p[at] = b.probability(level, base)[gram[at]]
            depth[at[kept[gram[at]]]] = level - 1
        sums = lambda x: np.add.reduceat(x, b.begin) if b.begin.size else np.empty(0, x.dtype)
        return pa.RecordBatch.from_arrays([
            pa.array(b.ids, pa.int64(), mask=b.ids == NO_ID), pa.array(b.held), pa.array(b.n, pa.int64()),
            pa.array(sums(known[b.tok].astype(np.int64)), pa.int64()), pa.array(sums(np.log10(p0)[b.tok]), pa.float64()),
            pa.array(sums(np.log10(p)), pa.float64()), pa.array(sums((depth > 0).astype(np.int64)), pa.int64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_context"])
    return score


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10), n_context (tokens scored from a
    context of the tree)."""
    buckets = n_buckets(docs, text)
    blocks = write_blocks(docs, encode_tokens, buckets, doc_id, text)

    def distinct(tag: str, totals):
        return [np.array([(totals[0] > 0).sum(), totals[0].sum()], np.int64)]

    def ask_words(block, payload, got):
        return request_batch(Block(payload, got).ask_words(block, buckets))

    words = replies(per_block(blocks, ask_words, REQUEST), {"n1": [("int64", "add")]}, distinct, number=buckets)
    known = write_replies(words, buckets)
    found = [np.zeros(2, np.int64)] + [unpack(r.vals[0], np.int64) for r in known.filter("block = -1").select("vals").toLocalIterator()]
    types, tokens = (int(x) for x in sum(found))
    base, least = float(tokens + types + 1), least_count(tokens)
    for level in range(2, order + 2):
        def ask(block, payload, got, level=level):
            return request_batch(Block(payload, got, least).ask(level, block, buckets, base))

        known = known.unionByName(write_replies(context_replies(with_replies(blocks, known, ask, REQUEST)), buckets))
    return (with_replies(blocks, known, _score(order, base, least), _RESULT)
            .withColumn("train_tokens", F.lit(tokens).cast("long"))
            .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_context"))


def report(docs: DataFrame) -> DataFrame:
    return score_texts(docs)
