"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can say it, the same in SQL."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, mod ``m``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def box(docs: DataFrame, *leave_out: str) -> Column:
    """A row's own columns in one struct, so that no name of theirs can clash with a working column."""
    return F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in leave_out]).alias("doc")


def unbox(docs: DataFrame, *leave_out: str) -> list[Column]:
    return [F.col("doc")[c].alias(c) for c in docs.columns if c not in leave_out]


LARGEST = 1 << 27


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<int>): ``embedding`` with each component x as floor(scale * x), x as double.

    Vectors that are null or hold a null or non-finite component are left out. A
    component beyond 2**27 in size is an error: sums of squares could leave the longs."""
    x = F.col("embedding").cast("array<double>")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fit = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    whole = F.transform("x", lambda c: F.when(
        F.abs(c * scale) < LARGEST, F.floor(c * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int")))
    return own.where(fit).select("vec_id", whole.alias("v"))


U = np.uint64
_P, _Q = 0x9E6D62D06F6A9A9B, 0xC2B2AE3D27D4EB4F  # odd multipliers
_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"]] = True
_WORD[128:] = True
_FOLD = np.arange(1, 257).astype(U)
_FOLD[65:91] += U(32)
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=U)
    return _powers


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, in order.

    A word is a run of ASCII letters, digits, underscores and any characters
    beyond ASCII; A-Z counts as a-z. Word hashes are differences of one running
    polynomial sum, so a text costs a few passes over its bytes."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not b.size:
        return np.zeros(0, U)
    inside = np.concatenate(([False], _WORD[b], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    up, down = _power(len(b) + 1)
    with np.errstate(over="ignore"):
        run = np.concatenate((np.zeros(1, U), np.cumsum(_FOLD[b] * up[: len(b)], dtype=U)))
        return mix((run[end] - run[start]) * down[start] + (end - start).astype(U))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order; of all words together if there are fewer."""
    w = word_hashes(text)
    if not len(w):
        return w
    width = min(width, len(w))
    with np.errstate(over="ignore"):
        out = np.full(len(w) - width + 1, width, U)
        for j in range(width):
            out = out * U(_Q) + w[j : len(w) - width + 1 + j]
    return mix(out)
