"""Column -> Column vector helpers (parse, combine, normalise, distances).

Spark has no vector built-ins, so these are higher-order-function expressions
(``transform``/``aggregate``/``zip_with``) that run JVM-side.  Bulk distance
work (k-NN) uses the blocked matrix form in ``operators.knn``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import WS

# Fixed value: the number salvage pattern of the tolerant vector parser.
NUMBER_PATTERN = r"[-+]?(?:[0-9]*\.[0-9]+|[0-9]+)(?:[eE][-+]?[0-9]+)?"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_vector(c) -> Column:
    """V1: text -> array<double>, strictest of the reference behaviours.

    null / blank / 'nan' -> null; one outer quote pair removed; a JSON (or
    Python-literal) list of numbers; else every number salvaged by regex; an
    empty result is null.
    """
    s = F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")
    quoted = (s.startswith('"') & s.endswith('"') & (F.length(s) >= 2)) | \
             (s.startswith("'") & s.endswith("'") & (F.length(s) >= 2))
    inner = F.regexp_extract(s, r"(?s)^.(.*).$", 1)
    body = F.when(quoted, F.regexp_replace(inner, f"^{WS}+|{WS}+$", "")).otherwise(s)
    as_json = F.from_json(body, "array<double>")
    json_ok = as_json.isNotNull() & (F.size(as_json) > 0) & F.forall(as_json, lambda x: x.isNotNull())
    salvaged = F.transform(F.regexp_extract_all(body, F.lit(f"({NUMBER_PATTERN})"), 1),
                           lambda x: x.cast("double"))
    result = F.when(json_ok, as_json).when(F.size(salvaged) > 0, salvaged)
    blank = _col(c).isNull() | (s == "") | (F.lower(s) == "nan")
    return F.when(blank, F.lit(None).cast("array<double>")).otherwise(result)


def to_float32(c) -> Column:
    """V5: cast every element to float (the collections' storage type)."""
    return F.transform(_col(c), lambda x: x.cast("float"))


def concat_vectors(*cols) -> Column:
    """V4: concatenate text and image vectors."""
    return F.concat(*[_col(c) for c in cols])


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(c) -> Column:
    return F.sqrt(F.aggregate(_col(c), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(c) -> Column:
    """V6: divide by the L2 norm; a zero vector is returned unchanged (as double)."""
    n = norm(c)
    return F.when(n > 0, F.transform(_col(c), lambda x: x.cast("double") / n)) \
            .otherwise(F.transform(_col(c), lambda x: x.cast("double")))


def l2_distance(a, b) -> Column:
    """V8: squared Euclidean distance (the ``l2`` space)."""
    return F.aggregate(F.zip_with(_col(a), _col(b),
                                  lambda x, y: (x.cast("double") - y.cast("double")) *
                                               (x.cast("double") - y.cast("double"))),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def cosine_distance(a, b) -> Column:
    """V9: ``1 - a.b / (|a| |b|)``; 1.0 when either norm is 0."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / (na * nb))


def zero_fill(c, dim: int) -> Column:
    """V7: a zero vector in place of a missing one."""
    return F.coalesce(_col(c), F.array_repeat(F.lit(0.0).cast("float"), dim))


def round_vector(c, digits: int = 6) -> Column:
    return F.transform(_col(c), lambda x: F.round(x.cast("double"), digits))


def vector_dims(df: DataFrame, c: str) -> DataFrame:
    """V5 report: one row ``n, min_dim, max_dim`` in a single aggregate pass."""
    size = F.size(F.col(c)).cast("bigint")
    return df.where(F.col(c).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"))


def assert_dim(df: DataFrame, c: str) -> int:
    """V5: fail on ragged input, return the common width."""
    row = vector_dims(df, c).first()
    if row is None or row["n"] == 0:
        raise ValueError(f"no vectors in column {c!r}")
    if row["min_dim"] != row["max_dim"]:
        raise ValueError(f"ragged vectors in {c!r}: widths {row['min_dim']}..{row['max_dim']}")
    return int(row["min_dim"])
