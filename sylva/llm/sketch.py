"""Document fingerprints: bottom-k sketches of word shingles.

A sketch is the k smallest distinct hashes of a text's five-word shingles. With
fewer it is the whole set, and all estimates are exact. Sketches of parts merge
into that of the whole.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import query, shingles, table
from sylva.session import materialize

K = 256
BITS = 48
_TOP = np.uint64(64 - BITS)


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending. A text without words has none."""
    return _least(shingles(text) >> _TOP, k)


def _least(h: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values."""
    size = 2 * k
    while size < len(h):
        got = np.unique(np.partition(h, size)[:size])
        if len(got) >= k:
            return got[:k]
        size *= 4
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's sketch that is in both. Two empty sketches: 1."""
    union = np.union1d(a, b)[:k]
    if not len(union):
        return 1.0
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    if len(a) < k:
        return float(len(a))
    return (k - 1) * float(1 << BITS) / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has: the intersection's size over a's. An empty a: 1."""
    n = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / n) if n else 1.0


def pack(a: np.ndarray) -> str:
    """As text: six bytes a hash, base64."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    return np.concatenate((np.zeros((len(raw), 2), np.uint8), raw), 1).reshape(-1).view(">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """``docs`` with fingerprint and distinct_shingles (columns of these names are replaced). A null text is empty."""
    docs = docs.drop("fingerprint", "distinct_shingles")

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [sketch(t, k) for t in texts]
            yield pd.DataFrame({"fingerprint": [pack(x) for x in got], "distinct_shingles": [distinct(x, k) for x in got]})

    out = docs.withColumn("_fingerprint_of_text", F.pandas_udf(of, "fingerprint string, distinct_shingles double")(F.col("text")))
    return out.select(*docs.columns, "_fingerprint_of_text.*")


def union_fingerprints(prints: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """The fingerprint of the union of each group's texts.

    Tasks first merge what they hold of a group, then partial sketches meet under
    sixteen salts, and last one sketch for each of these."""

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(0, np.uint64)
        for s in pdf["fingerprint"]:
            total = merge(total, unpack(s), k)
        out = pdf.iloc[:1].copy()
        out["fingerprint"] = pack(total)
        return out

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, group in batch.groupby(by, dropna=False, sort=False):
                yield merged(group)

    rows = prints.select(*by, "fingerprint")
    part = rows.mapInPandas(local, rows.schema).withColumn("_salt", F.spark_partition_id() % 16)
    salted = part.groupBy(*by, "_salt").applyInPandas(merged, part.schema)
    return salted.drop("_salt").groupBy(*by).applyInPandas(merged, rows.schema)


PAIR = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")
RANGES_A_TASK = 8


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """Each text's fingerprint against its edited text's and the next document's.

    The next document is that with the next id, after the last the first; a null
    id comes first, and rows of one id are in the order of their texts' hashes. A
    single document is its own next.

    Keys alone are first put in ranges, whose starts come to the driver, a few for
    each task. Texts then move once, to their range; a range's first text also goes
    to the range before, as what follows its last. A task walks its ranges in order
    and holds two texts at a time."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ids = materialize(keyed.select("doc_id", "tie"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.repartitionByRange(n * RANGES_A_TASK, "doc_id", "tie").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "tie")).alias("s"))
    starts = sorted((r["s"]["doc_id"] is not None, r["s"]["doc_id"] or 0, r["s"]["tie"]) for r in ranged.collect())

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, tie in zip(batch["id"], batch["tie"], strict=True):
                key = (doc_id is not None, int(doc_id or 0), tie)
                at = bisect_right(starts, key) - 1
                out.append([at, (at - 1) % len(starts)] if starts[at] == key else [at])
            yield pd.DataFrame({"to": out})

    key = F.struct(F.col("doc_id").cast("string").alias("id"), "tie")
    spread = keyed.withColumn("_r", F.pandas_udf(place, "to array<int>")(key)).select(
        F.posexplode("_r.to").alias("extra", "range"), F.col("doc_id"), "tie", "text")
    ordered = spread.repartition(n, "range").sortWithinPartitions("range", "extra", "doc_id", "tie", "text")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # range, id, text and sketch of the document that waits for its next
        for batch in batches:
            rows = []
            for extra, where, doc_id, text in batch.itertuples(index=False):
                own = sketch(text, k)
                if last is not None and last[0] == where:
                    rows.append((*_pair(*last[1:], text, own, k),))
                last = None if extra else (where, doc_id, text, own)
            yield _frame(rows)

    return ordered.select("extra", "range", F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(walk, PAIR)


def _pair(doc_id, text: str, own: np.ndarray, following: str, other: np.ndarray, k: int) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed = own if edited == text else sketch(edited, k)
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), pack(own), pack(changed),
            resemblance(own, changed, k), resemblance(own, other, k))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in PAIR.split(", ")], dtype=object)
    out["doc_id"] = pd.array([None if i is None else int(i) for i in out["doc_id"]], "Int64")
    return out.astype({"n_chars": "int64", "near_edited": float, "near_next": float})


@query("op7_fingerprints")
def op7_fingerprints(spark, sf_dir):
    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
