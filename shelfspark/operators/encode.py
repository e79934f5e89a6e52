"""Batch inference with caller-supplied models (B1-B3) and the stand-in encoder.

Models are passed as *factories*: ``fn_factory()`` is called once per task
(iterator-of-batches pandas UDF) and returns a function from a list of inputs
to a list of outputs.  Inputs are cut into ``batch_size`` slices; keys stay in
the DataFrame, so results are never matched back by position across tasks.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import tokens

# Fixed value: the answer given when no context was retrieved.
NO_CONTEXT_ANSWER = "I don't know."


def _batched(values: list, n: int):
    for i in range(0, len(values), n):
        yield values[i:i + n]


def encode_column(c, fn_factory: Callable[[], Callable[[list], list]], batch_size: int = 32,
                  return_type: str = "array<float>") -> Column:
    """B1/B2 as a column expression: ``fn_factory`` builds the model once per task."""

    @F.pandas_udf(return_type)
    def _apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = fn_factory()
        for s in batches:
            values = s.tolist()
            out: list = []
            for chunk in _batched(values, batch_size):
                res = fn(chunk)
                if len(res) != len(chunk):
                    raise ValueError("model returned a different number of outputs")
                out.extend(res)
            yield pd.Series(out, index=s.index, dtype=object)

    return _apply(F.col(c) if isinstance(c, str) else c)


def encode(df: DataFrame, col: str, fn_factory, dim: int | None = None, batch_size: int = 32,
           out: str = "vec") -> DataFrame:
    """B1: add a vector column computed by a caller-supplied batch encoder."""
    res = df.withColumn(out, encode_column(col, fn_factory, batch_size))
    if dim is not None:
        res = res.withColumn(out, F.when(F.col(out).isNull() | (F.size(out) == dim), F.col(out))
                             .otherwise(F.raise_error(F.lit(f"encoder output width is not {dim}"))))
    return res


def encode_predict_batch(df: DataFrame, col: str, make_predict_fn, dim: int, batch_size: int = 32,
                         out: str = "vec") -> DataFrame:
    """B1 through Spark ML's ``predict_batch_udf``.

    ``make_predict_fn()`` returns ``predict(inputs: np.ndarray) -> np.ndarray``
    of shape (batch, dim); Spark caches the model per Python worker and feeds
    fixed-size batches.  Use this for numpy-in/numpy-out models; ``encode`` for
    list-valued inputs.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=None)
    res = df.withColumn(out, udf(F.col(col)))
    return res.withColumn(out, F.when(F.col(out).isNull() | (F.size(out) == dim), F.col(out))
                          .otherwise(F.raise_error(F.lit(f"encoder output width is not {dim}"))))


# ---------------------------------------------------------------------------
# Stand-in encoder: feature hashing of the token set.
#
# Bucket of a token = first 8 hex digits of md5(token) as an integer, mod dim.
# The token -> bucket step is a JVM expression; the per-row histogram and the
# L2 normalisation are a small numpy helper run through ``encode_column``.

def token_buckets(c, dim: int) -> Column:
    return F.transform(tokens(c), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"),
                                                  F.lit(dim)).cast("int"))


def _hash_model(dim: int):
    def factory():
        def fn(bucket_lists: list) -> list:
            there = [np.asarray(b, dtype=np.int64) for b in bucket_lists if b is not None]
            row = np.repeat(np.arange(len(there)), [len(b) for b in there]).astype(np.int64)
            flat = row * dim + np.concatenate(there) if there else row
            h = np.bincount(flat, minlength=len(there) * dim).reshape(len(there), dim).astype(np.float64)
            n = np.sqrt(np.einsum("ij,ij->i", h, h))[:, None]
            rows = iter((h / np.where(n > 0, n, 1.0)).astype(np.float32))
            return [None if b is None else next(rows) for b in bucket_lists]
        return fn
    return factory


def hash_encode(df: DataFrame, text_col: str, dim: int = 64, out: str = "vec",
                batch_size: int = 1024) -> DataFrame:
    """Deterministic text encoder for tests and benches (unit length, float32)."""
    return df.withColumn(out, encode_column(token_buckets(text_col, dim), _hash_model(dim), batch_size))


def byte_histogram_model(bins: int = 256):
    """Stand-in image encoder: normalised byte histogram of the raw bytes."""
    def factory():
        def fn(blobs: list) -> list:
            res = []
            for b in blobs:
                if b is None:
                    res.append(None)
                    continue
                h = np.bincount(np.frombuffer(bytes(b), dtype=np.uint8), minlength=256).astype(np.float64)
                if bins != 256:
                    h = h.reshape(bins, -1).sum(axis=1)
                n = float(np.sqrt(h @ h))
                res.append((h / n if n > 0 else h).astype(np.float32).tolist())
            return res
        return fn
    return factory


# ---------------------------------------------------------------------------
# answers

def generate(df: DataFrame, prompt_col: str, contexts_col: str, fn_factory, out: str = "answer",
             empty_answer: str = NO_CONTEXT_ANSWER, batch_size: int = 16) -> DataFrame:
    """Answer each row's prompt; rows without contexts get ``empty_answer``
    natively and are never sent to the model."""
    has_ctx = F.col(contexts_col).isNotNull() & (F.size(contexts_col) > 0)
    prompt = F.col(prompt_col) if isinstance(prompt_col, str) else prompt_col
    to_model = F.when(has_ctx, prompt)
    answered = encode_column(to_model, _guarded(fn_factory), batch_size, return_type="string")
    return df.withColumn(out, F.when(has_ctx, answered).otherwise(F.lit(empty_answer)))


def _guarded(fn_factory):
    def factory():
        fn = fn_factory()

        def run(prompts: list) -> list:
            idx = [i for i, p in enumerate(prompts) if p is not None]
            res: list = [None] * len(prompts)
            if idx:
                answers = fn([prompts[i] for i in idx])
                for i, a in zip(idx, answers):
                    res[i] = a
            return res
        return run
    return factory


def echo_model():
    """Stand-in answer model: returns its input unchanged (makes B3 checkable)."""
    def factory():
        return lambda prompts: list(prompts)
    return factory
