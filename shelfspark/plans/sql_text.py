"""DuckDB SQL spellings of the column helpers, used to write the equality oracles.

RE2 has no look-behind, so sentence splitting first rewrites ``([.!?])WS+`` to
``\\1\\n``; DuckDB lambdas use the ``lambda x: …`` form.
"""

from __future__ import annotations

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def strip_spaces(x: str) -> str:
    return f"regexp_replace({x}, '^ +| +$', '', 'g')"


def collapse(x: str) -> str:
    return strip_spaces(f"regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g')")


def unescape(x: str) -> str:
    # The driver tables only hold these entities (legacy names also decode
    # without the semicolon); '&amp' last keeps one-pass semantics.
    out = f"coalesce({x}, '')"
    for name, ch in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">")):
        out = f"regexp_replace({out}, '&{name};?', '{ch}', 'g')"
    out = "replace(" + out + ", '&#39;', '''')"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


def clean_text(x: str) -> str:
    u = f"regexp_replace({unescape(x)}, '<[^>]+>', ' ', 'g')"
    u = f"replace({u}, '|', ', ')"
    u = f"regexp_replace({u}, '{WS}+', ' ', 'g')"
    return f"lower({strip_spaces(u)})"


def clean_category(x: str) -> str:
    return f"regexp_replace({clean_text(x)}, ',{WS}*,', ',', 'g')"


def sentence_list(x: str) -> str:
    """Stripped, non-empty pieces (duplicates kept, in order)."""
    rew = f"regexp_replace(coalesce({x}, ''), '([.!?]){WS}+', '\\1\n', 'g')"
    return (f"list_filter(list_transform(string_split_regex({rew}, '[,\n]'), lambda p: {strip('p')}), "
            f"lambda p: p <> '')")


def dedupe_list(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '({WORD}+)', 1))"


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '' OR lower({strip(x)}) = 'nan')"


def bucket(t: str, dim: int) -> str:
    return f"(('0x' || substr(md5({t}), 1, 8))::BIGINT % {dim})"


def f1(g: str, a: str) -> str:
    """Token-set F1 of two token lists (already distinct)."""
    inter = f"len(list_intersect({g}, {a}))"
    p = f"(CASE WHEN len({a}) > 0 THEN {inter}::DOUBLE / len({a}) ELSE 0.0 END)"
    r = f"(CASE WHEN len({g}) > 0 THEN {inter}::DOUBLE / len({g}) ELSE 0.0 END)"
    return f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"


def ratio_in(src: str, ref: str) -> str:
    """|src ∩ ref| / |ref| (0 when ref is empty)."""
    return f"(CASE WHEN len({ref}) > 0 THEN len(list_intersect({src}, {ref}))::DOUBLE / len({ref}) ELSE 0.0 END)"


def dvec(v: str) -> str:
    return f"list_transform({v}, lambda x: x::DOUBLE)"


def norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


def cosine(a: str, b: str) -> str:
    dot = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
    return f"(CASE WHEN {norm(a)} = 0 OR {norm(b)} = 0 THEN 1.0 ELSE 1.0 - {dot} / ({norm(a)} * {norm(b)}) END)"


def weighted_digest(v: str) -> str:
    """sum(x_i * i), i from 1: a scalar fingerprint of a vector."""
    return f"list_sum(list_transform({v}, lambda x, i: x::DOUBLE * i))"


def topk(queries: str, corpus: str, k: int, space: str) -> str:
    """SQL k-NN: ``queries(qid, v)``, ``corpus(id, v)`` -> qid, rank, id, distance."""
    d = l2("q.v", "c.v") if space == "l2" else cosine("q.v", "c.v")
    return (f"SELECT qid, rank, id, distance FROM (SELECT q.qid, c.id, {d} AS distance, "
            f"row_number() OVER (PARTITION BY q.qid ORDER BY round({d}, 12), c.id) AS rank "
            f"FROM {queries} q, {corpus} c WHERE len(q.v) > 0 AND len(c.v) > 0) WHERE rank <= {k}")


def hash_vectors(source: str, key: str, text: str, dim: int) -> str:
    """SQL form of the stand-in encoder: ``key, v`` (float32-rounded, as DOUBLE[])."""
    return f"""(
      WITH toks AS (SELECT {key} AS k, unnest({tokens(text)}) AS t FROM {source}),
      cells AS (SELECT k, {bucket('t', dim)} AS b, count(*)::DOUBLE AS c FROM toks GROUP BY ALL),
      norms AS (SELECT k, sqrt(sum(c * c)) AS n FROM cells GROUP BY k),
      grid AS (SELECT s.k, g.b FROM (SELECT DISTINCT {key} AS k FROM {source}) s,
               (SELECT range AS b FROM range({dim})) g),
      dense AS (SELECT grid.k, grid.b, coalesce(cells.c, 0.0) / CASE WHEN coalesce(norms.n, 0) > 0
                       THEN norms.n ELSE 1.0 END AS x
                FROM grid LEFT JOIN cells ON grid.k = cells.k AND grid.b = cells.b
                LEFT JOIN norms ON grid.k = norms.k)
      SELECT k, list(x::FLOAT::DOUBLE ORDER BY b) AS v FROM dense GROUP BY k
    )"""
