"""Personal data by bootstrapped contextual extraction, DataFrame functions only.

Seeds are the matches of four kinds of entities (email, ip, card, phone).  The
words before and after a seed are its lexical patterns, one or two of them to a side.
Tokens of identifier shape (with a digit, at least MIN_CHARS characters, punctuation
at their edges taken off) that are no seed are candidates.  Candidates of the shape of
a secret (SECRET: long runs of hex digits or of letters of both cases and digits, keys
of known prefixes) score 1 by their shape and are seeds, too.  Patterns and instances form a bipartite graph; scores go back and
forth over it ROUNDS times: a pattern's confidence is the mean score of its
strings (damped by SMOOTH strings that are none), a candidate's score the
best confidence among patterns that MIN_SEEDS different instances support.
Candidates that score ACCEPT or more are found identifiers (kind ``id``) and
become instances beside the seeds, so that patterns which no seed has can bring in
more; this goes on until nothing new is found.  Every generation adds at least one
string to the instances, so there are at most as many as distinct candidates; chains
of contexts that lead from one to the next decide how many there are.

Matches are leftmost and do not overlap.  The expressions use possessive
quantifiers and start only where a match can start, which matches the same spans
in linear time.  Offsets are code points, from the lengths of the texts between
matches.

Defined results: null and empty texts have no spans; matches that fail their test
(octets, digits, Luhn) are dropped without a retry; a token that overlaps a base
span is no candidate; repeated rows each have their own result; a null doc_id
stays null.  Extra columns are not read.  Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import join_counted, stored, text_of

KINDS = ("email", "ip", "card", "phone", "id")

_EMAIL_CHAR = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_EMAIL_CHAR}]))[{_EMAIL_CHAR}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Whitespace-delimited tokens with a digit in them.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"

#: Shapes of secrets; each match holds a letter and a digit.
SECRET = (r"\A(?:(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})"
          r"|(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])(?=[^0-9]*[0-9])[A-Za-z0-9+/_-]{32,}"
          r"|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9-]{20,})\z")
MIN_CHARS = 6
#: Characters on either side that a context word is looked for in.
NEAR = 64
ROUNDS = 3
SMOOTH = 2.0
MIN_SEEDS = 3
ACCEPT = 0.7


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, F.lit("[^0-9]"), F.lit(""))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(digits)
    doubled = F.transform(F.sequence(F.lit(1), F.length(digits)),
                          lambda i: F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    if kind == "ip":
        octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return hit.rlike(rf"\A{octet}\.{octet}\.{octet}\.{octet}\z")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, kind: int, where: Column) -> Column:
    """Array of (kind, k, gap, hit, before, after): the k-th match, the code points
    since the previous one, and the texts next to it (matches beside it included)."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    short = F.transform(pieces, lambda p: F.struct(F.length(p).alias("gap"), F.substring(p, 1, NEAR).alias("head"),
                                                   F.substring(p, F.lit(-NEAR), F.lit(NEAR)).alias("tail")))
    after = F.slice(short, F.lit(2), F.size(short))
    last = F.concat(F.array(F.lit("")), hits)
    nxt = F.concat(F.slice(hits, F.lit(2), F.greatest(F.size(hits), F.lit(1))), F.array(F.lit("")))
    rows = F.transform(
        F.filter(F.arrays_zip(short.alias("a"), after.alias("b"), hits.alias("hit"), last.alias("last"), nxt.alias("next")),
                 lambda x: x["hit"].isNotNull()),
        lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), x["a"]["gap"].alias("gap"), x["hit"].alias("hit"),
                              F.substring(F.concat(x["last"], x["a"]["tail"]), F.lit(-NEAR), F.lit(NEAR)).alias("before"),
                              F.substring(F.concat(x["b"]["head"], x["next"]), 1, NEAR).alias("after")))
    none = F.array().cast("array<struct<kind:int,k:int,gap:int,hit:string,before:string,after:string>>")
    return F.when(where, rows).otherwise(none)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: rid (a number of the row), doc_id, found (all matches
    of the four kinds and all tokens with a digit)."""
    t = F.col("t")
    digit = t.rlike("[0-9]")
    where = {"email": t.contains("@"), "ip": digit & t.contains("."), "card": digit, "phone": t.contains("+")}
    all_ = [_matches(t, PATTERNS[k], i, where[k]) for i, k in enumerate(KINDS[:4])] + [_matches(t, TOKEN, 4, digit)]
    return (docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
            .select("rid", "doc_id", F.concat(*all_).alias("found")))


def occurrences(scanned: DataFrame) -> DataFrame:
    """(rid, kind, start, end, hit, before, after) of the valid matches."""
    flat = scanned.select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    upto = Window.partitionBy("rid", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.length("hit")).cast("long")).over(upto)
    ok = reduce(lambda a, i: F.when(F.col("kind") == i, valid(KINDS[i], F.col("hit"))).otherwise(a), range(4), F.lit(True))
    # A token's edge punctuation is no part of it.
    token, lead = F.col("kind") == 4, F.length(F.regexp_extract("hit", r"\A\p{Punct}+", 0))
    core = F.regexp_replace("hit", r"\A\p{Punct}+|\p{Punct}+\z", "")
    return (flat.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))
            .withColumn("start", F.when(token, F.col("start") + lead).otherwise(F.col("start")))
            .withColumn("hit", F.when(token, core).otherwise(F.col("hit")))
            .withColumn("end", F.when(token, F.col("start") + F.length("hit")).otherwise(F.col("end")))
            .filter(ok).select("rid", "kind", "start", "end", "hit", "before", "after"))


def _word(c: Column) -> Column:
    """A context word: lower case, digits as 0, edge punctuation off."""
    plain = F.regexp_replace(F.lower(c), F.lit("[0-9]+"), F.lit("0"))
    return F.regexp_replace(plain, F.lit(r"^\p{Punct}+(?=\p{L})|(?<=\p{L})\p{Punct}+$"), F.lit(""))


def with_patterns(occ: DataFrame) -> DataFrame:
    """Occurrences with their lexical patterns: the word before, the two words before,
    the word after, the words on both sides.  The context of a token starts beyond the
    token itself, its punctuation included."""
    left = _word(F.regexp_extract("before", r"([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+\z", 1))
    further = _word(F.regexp_extract("before", r"([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+\z", 1))
    right = _word(F.regexp_extract("after", r"\A[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)", 1))
    pats = F.array(F.when(F.col("l") != "", F.concat(F.lit("L "), F.col("l"))),
                   F.when(F.col("l2") != "", F.concat(F.lit("LL "), F.col("l2"), F.lit(" "), F.col("l"))), F.when(F.col("r") != "", F.concat(F.lit("R "), F.col("r"))),
                   F.when((F.col("l") != "") & (F.col("r") != ""), F.concat(F.lit("B "), F.col("l"), F.lit(" "), F.col("r"))))
    return (occ.withColumn("l", left).withColumn("l2", further).withColumn("r", right)
            .withColumn("patterns", F.filter(pats, lambda p: p.isNotNull())).drop("l", "l2", "r", "before", "after"))


def is_secret(hit: str | Column) -> Column:
    return (F.col(hit) if isinstance(hit, str) else hit).rlike(SECRET)


def candidates(occ: DataFrame) -> DataFrame:
    """Tokens of identifier shape that overlap no base span."""
    w = Window.partitionBy("rid").orderBy("start", "kind")
    seed = F.col("kind") < 4
    before = F.max(F.when(seed, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(seed, F.col("start"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    return (occ.withColumn("_b", before).withColumn("_a", after)
            .filter((F.col("kind") == 4) & (F.length("hit") >= MIN_CHARS)
                    & (F.coalesce(F.col("_b"), F.lit(-1)) <= F.col("start"))
                    & (F.coalesce(F.col("_a"), F.col("end")) >= F.col("end"))).drop("_a", "_b"))


def _scores(edges: DataFrame, total: int, rounds: int) -> DataFrame:
    """(hit, score, m, seed) of every string, m being its patterns."""
    scores = None
    for _ in range(rounds):
        if scores is None:
            scored = edges.withColumn("score", F.col("seed"))
        else:
            scored = join_counted(edges, scores.select("hit", "score", "m"), ["hit"], "m", total).withColumn(
                "score", F.greatest(F.col("seed"), F.col("score")))
        conf = scored.groupBy("pattern").agg(
            F.when(F.sum("seed") >= MIN_SEEDS, F.sum("score") / (F.count(F.lit(1)) + F.lit(SMOOTH))).otherwise(0.0).alias("conf"),
            F.count(F.lit(1)).alias("k"))
        scores = stored(join_counted(edges, conf, ["pattern"], "k", total).groupBy("hit")
                        .agg(F.max("conf").alias("score"), F.count(F.lit(1)).alias("m"), F.max("seed").alias("seed")), "pii-scores")
    return scores


def bootstrap(seeds: DataFrame, cands: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The strings found: (hit)."""
    each = lambda df, s: df.select(F.explode("patterns").alias("pattern"), "hit", s.cast("double").alias("seed"))
    edges = each(seeds, F.lit(1)).unionByName(each(cands, is_secret("hit"))).groupBy("pattern", "hit").agg(F.max("seed").alias("seed"))
    # A pattern without candidates tells nothing, nor does one of MIN_SEEDS strings:
    # it counts only once all of them are instances.
    useful = (edges.groupBy("pattern").agg(F.sum("seed").alias("seeds"), F.count(F.lit(1)).alias("n"))
              .filter((F.col("n") > MIN_SEEDS) & (F.col("seeds") < F.col("n"))).drop("seeds"))
    edges = stored(join_counted(edges, useful, ["pattern"], "n", edges.count()).drop("n"), "pii-edges")
    total = edges.count()
    found = [cands.filter(is_secret("hit")).select("hit")]
    while True:
        scores = _scores(edges, total, rounds)
        accepted = F.col("score") >= ACCEPT
        found.append(scores.filter(accepted).select("hit"))
        if scores.filter(accepted & (F.col("seed") < 1)).isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()
        now = scores.select("hit", "m", F.when(accepted, 1.0).otherwise(F.col("seed")).alias("seed"))
        edges = stored(join_counted(edges.drop("seed"), now, ["hit"], "m", total).drop("m"), "pii-edges")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans: array of (kind, start, end, text),
    kind by number (see KINDS), ordered by kind, then start."""
    scanned = stored(scan(docs, doc_id, text), "pii-scan")
    occ = stored(occurrences(scanned), "pii-occurrences")
    cands = stored(with_patterns(candidates(occ)), "pii-candidates")
    seeds = occ.filter("kind < 4")
    more = cands.join(bootstrap(with_patterns(seeds), cands), "hit", "left_semi")
    spans = (seeds.select("rid", "kind", "start", "end", "hit")
             .unionByName(more.select("rid", "kind", "start", "end", "hit")).groupBy("rid")
             .agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", F.col("hit").alias("text")))).alias("spans")))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,text:string>>")
    return (scanned.select("rid", "doc_id").join(spans, "rid", "left")
            .select("doc_id", F.coalesce("spans", none).alias("spans")))


def span_list(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_id, n_spans (all spans), base_sha256, spans."""
    s = F.col("spans")

    def of(kind: int) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")

    counts = [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return find(docs).select("doc_id", *counts, F.size(s).cast("long").alias("n_spans"),
                             F.sha2(span_list(F.filter(s, lambda x: x["kind"] < 4)).cast("binary"), 256).alias("base_sha256"),
                             span_list(s).alias("spans"))


def listed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the strings found in it with their kinds (one row per span)."""
    return (find(docs, doc_id, text).select("doc_id", F.explode("spans").alias("s"))
            .select("doc_id", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("s.kind") + 1).alias("kind"), "s.start", "s.end", "s.text"))
