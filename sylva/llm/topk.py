"""Exact search for the k highest inner products, with a pivot table.

Vectors are dealt into shards of bounded size. A shard holds the exact distances of
its vectors to its own pivots. For a query q and a vector x, every pivot p bounds
|q - x| from below by the difference of their distances to p, hence the product
(|q|^2 + |x|^2 - |q - x|^2) / 2 from above. Candidates are evaluated in the order
of their bounds, exactly, until the next bound is below the k-th product. The origin
is a pivot too: alone it gives the bound |q| |x|.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.common import integer_vectors, query, table
from sylva.session import materialize, spread

K = 10
SCALE = 1024
PIVOTS = 32
SHARD_POINTS = 8192
QUERY_ROWS = 128
INDEX = "shard int, dims int, ids binary, points binary, squares binary, pivots binary, far binary"


def choose_pivots(v: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """The origin, then again and again the vector farthest from all pivots so far; fewer where vectors run out."""
    out = [np.zeros(v.shape[1])]
    near = (v * v).sum(axis=1)
    while len(out) < most and len(v) and near.max() > 0:
        out.append(v[int(near.argmax())])
        near = np.minimum(near, ((v - out[-1]) ** 2).sum(axis=1))
    return np.array(out)


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(pivot, vector) distances, without cancellation."""
    return np.array([np.sqrt(((v - p) ** 2).sum(axis=1)) for p in pivots])


def upper_bounds(q: np.ndarray, squares: np.ndarray, pivots: np.ndarray, far: np.ndarray) -> np.ndarray:
    """(query, vector) bounds on the inner products, with room for rounding."""
    own = distances(q, pivots)
    least = np.zeros((len(q), far.shape[1]))
    gap = np.empty_like(least)
    for a, b in zip(own, far, strict=True):
        np.subtract(a[:, None], b[None, :], out=gap)
        np.abs(gap, out=gap)
        np.maximum(least, gap, out=least)
    both = (q * q).sum(axis=1)[:, None] + squares
    room = 1e-11 * (both + 2 * (pivots * pivots).sum(axis=1).max())
    return (both - least * least) / 2 + room


def best(q: np.ndarray, bound: np.ndarray, v: np.ndarray, ids: np.ndarray, own_id: int, k: int = K) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, candidates evaluated) of the ``k`` highest products of other ids, ties to smaller ids."""
    order = np.argsort(-bound, kind="stable")
    scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = 0, 4 * k
    while at < len(order):
        if len(scores) == k and bound[order[at]] < scores[-1]:
            break
        some = order[at : at + step]
        at, step = at + len(some), 2 * step
        some = some[ids[some] != own_id]
        scores = np.concatenate((scores, v[some] @ q))
        found = np.concatenate((found, ids[some]))
        keep = np.lexsort((found, -scores))[:k]
        scores, found = scores[keep], found[keep]
    return scores, found, at


def build_index(rows: DataFrame, shard_points: int = SHARD_POINTS, pivots: int = PIVOTS) -> DataFrame:
    """One row for each shard of (vec_id, v): ids, vectors, squared lengths, pivots and the distances to them.

    Vectors of one shard have one length; the number of shards goes by all rows, so
    every shard is about ``shard_points`` long or shorter."""
    shards = max(1, -(-rows.count() // shard_points))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        n, d = len(pdf), int(pdf["dims"].iloc[0])
        v = np.array(pdf["v"].tolist(), np.int32).reshape(n, d)
        x = v.astype(float)
        p = choose_pivots(x, pivots)
        return pd.DataFrame({
            "shard": pdf["shard"].iloc[:1], "dims": [d], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "points": [v.tobytes()],
            "squares": [(x * x).sum(axis=1).tobytes()], "pivots": [p.tobytes()], "far": [distances(x, p).tobytes()]})

    dealt = rows.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"))
    return spread(dealt, "shard", "dims").groupBy("shard", "dims").applyInPandas(build, INDEX)


def search(index: DataFrame, asked: DataFrame, k: int = K) -> DataFrame:
    """(query_id, turn, vec_id, score): for each row of (query_id, turn, v) the ``k`` highest products in each shard.

    Queries go to every shard of their length, and there follow the shard's own row
    in sorted order: a task reads a shard once and holds it and one batch of queries."""
    shards = index.select("shard", "dims")
    none = [F.lit(None).cast("binary").alias(c) for c in ("ids", "points", "squares", "pivots", "far")]
    left = index.select("shard", "dims", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("int").alias("turn"),
                        F.lit(None).cast("array<int>").alias("v"), "ids", "points", "squares", "pivots", "far")
    right = asked.withColumn("dims", F.size("v")).join(shards, "dims").select("shard", "dims", F.lit(1).alias("kind"), "query_id", "turn", "v", *none)
    rows = spread(left.unionByName(right), "shard", "dims").sortWithinPartitions("shard", "dims", "kind")
    found = pa.schema([("query_id", pa.int64()), ("turn", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            kind = b.column("kind").to_numpy()
            opens = np.flatnonzero(kind == 0).tolist()
            edges = sorted({0, len(kind), *opens, *[i + 1 for i in opens]})
            for lo, hi in zip(edges, edges[1:], strict=False):
                if kind[lo] == 0:
                    d = b.column("dims")[lo].as_py()
                    get = lambda c, t: np.frombuffer(b.column(c)[lo].as_buffer(), t)  # noqa: B023, E731
                    ids = get("ids", np.int64)
                    p = get("pivots", float)
                    p = p.reshape(max(1, p.size // max(d, 1)), d)
                    shard = (ids, get("points", np.int32).reshape(len(ids), d).astype(np.int64), get("squares", float), p, get("far", float).reshape(len(p), len(ids)))
                    continue
                ids, v, squares, p, far = shard
                for at in range(lo, hi, QUERY_ROWS):
                    part = b.slice(at, min(QUERY_ROWS, hi - at))
                    q = part.column("v").flatten().to_numpy().astype(np.int64).reshape(part.num_rows, v.shape[1])
                    bounds = upper_bounds(q.astype(float), squares, p, far)
                    who, turn = part.column("query_id").to_numpy(), part.column("turn").to_numpy()
                    got = [best(q[i], bounds[i], v, ids, int(who[i]), k) for i in range(len(q))]
                    n = [len(s) for s, _, _ in got]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(who, n)), pa.array(np.repeat(turn, n)), pa.array(np.concatenate([f for _, f, _ in got])),
                        pa.array(np.concatenate([s for s, _, _ in got]))], schema=found)

    return rows.mapInArrow(run, "query_id long, turn int, vec_id long, score long")


def highest(vectors: DataFrame, every: int = 100, k: int = K, scale: int = SCALE, shard_points: int = SHARD_POINTS, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score, turn): for each vec_id divisible by ``every`` the ``k`` other rows of highest inner product, ties to smaller ids.

    Exact: no candidate is left out unless its bound is below the k-th score. Rows
    with a null id take no part, nor do null vectors or those with a null or
    non-finite component; zero vectors do, and repeated rows count once. Vectors of
    other lengths than the query's don't meet it, an empty one meets empty ones with
    score 0. If an id divisible by ``every`` has several vectors, each is searched,
    told apart by ``turn``, and none meets another of its id. Fewer rows where there
    are fewer candidates."""
    rows = materialize(integer_vectors(vectors.where(F.col("vec_id").isNotNull()), scale).distinct())
    index = materialize(build_index(rows, shard_points, pivots))
    turn = F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), turn.alias("turn"), "v")
    found = search(index, materialize(asked), k)
    rank = F.row_number().over(Window.partitionBy("query_id", "turn").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "turn")


SQL = f"""
WITH v AS MATERIALIZED (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= {K}"""


@query("op13_exact_topk", SQL)
def op13_exact_topk(spark, sf_dir):
    return highest(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")
