"""Small inputs and brute-force versions shared by the tests of this folder."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that operators might use as names of their own.
EXTRA = "key string, row long, n long, size long, target double, copy_no int, cid long, label string, block int, hit string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randint(0, vocabulary)}" for _ in range(n)]


def messy():
    """(doc_id, text, lang, source, n_chars): nulls, empty and blank texts, a very
    long one, ties, repeated rows, near copies, shared passages."""
    base, passage = prose(1, 120), prose(2, 70)
    near = list(base)
    near[60] = "changed"
    lines = [f"shared line {k} of a block" for k in range(30)]
    rows = [
        (0, " ".join(base), "en", "a"), (1, " ".join(base), "en", "a"), (2, " ".join(near).upper(), "en", "b"),
        (3, None, None, None), (4, "", "en", ""), (5, " \t\n ", "en", "a"), (6, "one two", "en", "a"), (7, "One two", "en", "a"),
        (8, "x " + " ".join(passage) + " y", "en", "b"), (9, " ".join(prose(3, 30) + passage + prose(4, 40)), "en", "c"),
        (10, " ".join(passage * 2), "en", "c"), (11, "\n".join(["Intro"] + lines + ["End"]), "en", "a"),
        (12, "\n".join(["Other start", "more"] + lines + ["Tail", "tail"]), "en", "b"), (13, "\n".join(lines), "de", "b"),
        (14, " ".join(prose(5, 30_000, 5000)), "en", "long"), (15, "naïve Ünïcode \U0001F600 text " * 12, "fr", "a"),
        (16, " ".join(base), "en", None), (17, "one  two", "en", "a"), (None, "no id " + " ".join(prose(6, 20)), "en", "a"),
        (6, "one two", "en", "a"), (6, "one two", "en", "a"), (18, "\n\n\n\n", "en", "a"), (19, "\n\n\n\n", "en", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, extra=True):
    df = spark.createDataFrame(messy() if rows is None else rows, SCHEMA)
    if extra:
        for c in EXTRA.split(", "):
            name, kind = c.split()
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(x):
    return WORD.findall(x or "")


def lower(x):
    return (x or "").translate(LOWER)


def near_components(rows, k=5, link=85):
    """Row -> (set size, smallest id reachable); null ids are never smallest."""
    sets = []
    for _, x in rows:
        w = words(lower(x))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= link * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)].append(i)
    return [(i, len(sets[a]), min(least[find(a)], default=None)) for a, (i, _) in enumerate(rows)]


def substring_rows(rows, size=50):
    first = {}
    for i, x in rows:
        w = words(x)
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            rank = (i is None, i)
            first[key] = min(first.get(key, rank), rank)
    out = []
    for i, x in rows:
        w = words(x)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < (i is None, i):
                gone[k:k + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(" ".join(a for a, g in zip(w, gone) if not g))))
    return out


def decontaminated_rows(rows, items, size=10):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    wins = defaultdict(set)
    for item, x in items:
        w = split(x)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[k:k + n])].add("" if item is None else str(item))
    sizes = {len(k) for k in wins}
    out = []
    for i, x in rows:
        w = split(x)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k:k + n])) in wins:
                    hit[k:k + n] = [True] * n
                    found |= wins[key]
        out.append((i, len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)))
    return out


def held(i, mod):
    return zlib.crc32(b"" if i is None else str(i).encode()) % mod


def kept_lines(rows, divisor=2):
    """Texts after removal, for distinct rows by (null, id, text)."""
    def cut(x):
        out = [[]]
        for line in (x or "").split("\n"):
            out[-1].append(line)
            if int(hashlib.md5(line.encode()).hexdigest()[:5], 16) % divisor == 0:
                out.append([])
        return [c for c in out if c]

    seen, done = set(), {}
    for i, x in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        kept, run = [], []
        for c in [*cut(x), None]:
            key = None if c is None else (len(c), "\n".join(c))
            if key in seen:
                run.append(c)
                continue
            if not any(len(r) >= 2 and words("\n".join(r)) for r in run):
                kept += run
            run = []
            if c is not None:
                seen.add(key)
                kept.append(c)
        done[i, x or ""] = "\n".join("\n".join(c) for c in kept)
    return [(i, len((x or "").split("\n")), sha(done[i, x or ""])) for i, x in rows]
