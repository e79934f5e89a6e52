"""Column -> Column text helpers (catalog cleaning, sentences, tokens, prompts).

Everything except HTML entity decoding is a built-in Spark expression, so it
stays inside whole-stage code generation.  Entity decoding needs the full
HTML5 entity table (2,000+ names), which Spark lacks, so it is one Arrow-batched
``pandas_udf`` that only receives values that contain ``&``.

Unicode note: Python's ``\\s``/``\\w``/``strip`` are Unicode-aware while the JVM
shorthand classes are not, so the explicit classes below are used everywhere.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Character classes that reproduce Python's Unicode whitespace
# and word characters in Java regex syntax.
# The property is one test a character; the same 29 characters as ranges are a chain of them.
WS = r"[\p{IsWhite_Space}\x1c-\x1f]"
WS_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WORD = r"[\p{L}\p{N}_]"
# Text fragments of the catalog search text and contexts.
NAME_PREFIX = "name: "
CATEGORY_PREFIX = "category: "
DESCRIPTION_PREFIX = "description: "
PART_SEPARATOR = " | "
LIST_SEPARATOR_REPLACEMENT = ", "
IMAGE_URL_PREFIX = "\nImage URL: "
CONTEXT_SEPARATOR = "\n\n---\n\n"
EMBED_TEXT_SEPARATOR = " || "
# ---------------------------------------------------------------------------

#: The class for Python's ``re``, which has no properties, and what is built of it.
_RANGES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_TRIM_RE, _SENTENCE_RE = f"^{_RANGES}+|{_RANGES}+$", f"(?<=[.!?]){_RANGES}+|,|\n"
_SENTENCE_SPLIT = f"(?<=[.!?]){WS}+|,|\n"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _html_unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: html.unescape(v) if isinstance(v, str) else None)


def html_unescape(c) -> Column:
    """HTML entity decoding (null -> '').

    Only values that contain ``&`` are sent to Python; the others travel to the
    UDF as nulls (a null bit in the Arrow batch) and are taken back unchanged.
    """
    c = _col(c)
    decoded = _html_unescape(F.when(F.instr(c, "&") > 0, c))
    return F.coalesce(decoded, c, F.lit(""))


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.btrim(_col(c), F.lit(WS_CHARACTERS))


def collapse_ws(c) -> Column:
    """null -> '', whitespace runs -> one space, stripped, case kept."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), f"{WS}+", " "))


def clean_text(c) -> Column:
    """entities decoded first, tags -> space, '|' -> ', ', spaces collapsed, lower."""
    u = html_unescape(c)
    u = F.regexp_replace(u, "<[^>]+>", " ")
    u = F.replace(u, F.lit("|"), F.lit(LIST_SEPARATOR_REPLACEMENT))
    u = F.regexp_replace(u, f"{WS}+", " ")
    return F.lower(F.trim(u))


def clean_category(c) -> Column:
    """``clean_text`` then one pass of ``,WS*,`` -> ``,``."""
    return F.regexp_replace(clean_text(c), f",{WS}*,", ",")


def normalize_price(c) -> Column:
    """first run of digits/commas/dots, commas dropped -> ``price: x.xx USD``.

    Unparsable or missing -> ''.  Rounding is half-up on the decimal text.
    """
    run = F.regexp_extract(_col(c).cast("string"), r"[0-9,.]+", 0)
    parsed = F.replace(run, F.lit(","), F.lit("")).try_cast("decimal(38,10)")
    text = F.concat(F.lit("price: "), F.round(parsed, 2).cast("decimal(38,2)").cast("string"), F.lit(" USD"))
    return F.when(parsed.isNull(), F.lit("")).otherwise(text)


def dedupe_sentences(*cols) -> Column:
    """join non-empty inputs with a space, split into sentences/clauses,
    keep the first occurrence of each stripped piece, join with a space."""
    parts = [F.when(_col(c) != "", _col(c)) for c in cols]
    combined = F.concat_ws(" ", *parts)
    pieces = F.transform(F.split(combined, _SENTENCE_SPLIT, -1), strip_ws)
    kept = F.array_distinct(F.filter(pieces, lambda p: p != ""))
    return F.array_join(kept, " ")


def search_text(name=None, category=None, price=None, about=None, details=None, description=None) -> Column:
    """``name: … | category: … | <price> | description: <F5(about, details)>``.

    Inputs are already-cleaned columns ('' for missing); missing inputs are skipped.
    ``description`` is F5(about, details) where the caller has it as a column.
    """
    parts = []
    if name is not None:
        parts.append(F.when(_col(name) != "", F.concat(F.lit(NAME_PREFIX), _col(name))))
    if category is not None:
        parts.append(F.when(_col(category) != "", F.concat(F.lit(CATEGORY_PREFIX), _col(category))))
    if price is not None:
        parts.append(F.when(_col(price) != "", _col(price)))
    desc_inputs = [c for c in (about, details) if c is not None]
    if desc_inputs or description is not None:
        merged = _col(description) if description is not None else dedupe_sentences(*desc_inputs)
        parts.append(F.when(merged != "", F.concat(F.lit(DESCRIPTION_PREFIX), merged)))
    if not parts:
        return F.lit("")
    return F.concat_ws(PART_SEPARATOR, *parts)


def first_list_item(c) -> Column:
    """first element of a '|'-separated list; null stays null, no trimming."""
    return F.element_at(F.split(_col(c), r"\|", -1), 1)


def embed_text(title, description, category) -> Column:
    """F8: ``Title || Description || Category`` with missing parts as ''."""
    z = [F.coalesce(_col(x), F.lit("")) for x in (title, description, category)]
    return F.concat(z[0], F.lit(EMBED_TEXT_SEPARATOR), z[1], F.lit(EMBED_TEXT_SEPARATOR), z[2])


def synth_description(title, category) -> Column:
    """title + space + category when no description column exists."""
    return collapse_ws(F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "),
                                F.coalesce(_col(category), F.lit(""))))


def truncate(c, n: int = 250) -> Column:
    """first ``n`` code points."""
    return F.substring(_col(c), 1, n)


def tokens(c) -> Column:
    """distinct lower-cased word runs, in first-seen order (null -> [])."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(f"({WORD}+)"), 1)
    return F.array_distinct(words)


def is_blank(c) -> Column:
    """Null, blank after strip, or 'nan' in any case."""
    s = strip_ws(c)
    return _col(c).isNull() | (s == "") | (F.lower(s) == "nan")


def context_block(text, url) -> Column:
    """F12 (one block): text plus an image line when the URL is not null."""
    return F.concat(F.coalesce(_col(text), F.lit("")),
                    F.when(_col(url).isNotNull(), F.concat(F.lit(IMAGE_URL_PREFIX), _col(url))).otherwise(F.lit("")))


_SLOT = re.compile(r"\{(\w+)\}")


def render_prompt(template: str, **cols) -> Column:
    """fill ``{name}`` slots of a constant template in one pass.

    The template is turned into a ``format_string`` pattern on the driver, so a
    slot value that itself contains ``{…}`` is never substituted again.
    """
    order: list[str] = []

    def repl(m):
        name = m.group(1)
        if name not in cols:
            return m.group(0).replace("%", "%%")
        if name not in order:
            order.append(name)
        return f"%{order.index(name) + 1}$s"

    pieces = []
    last = 0
    for m in _SLOT.finditer(template):
        pieces.append(template[last:m.start()].replace("%", "%%"))
        pieces.append(repl(m))
        last = m.end()
    pieces.append(template[last:].replace("%", "%%"))
    fmt = "".join(pieces)
    args = [F.coalesce(_col(cols[n]), F.lit("")) for n in order]
    return F.format_string(fmt, *args)
