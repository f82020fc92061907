"""Approximate nearest neighbours by navigable small-world graphs.

Vectors are dealt into shards of bounded size, and each has a hierarchical graph:
every vector is on the lowest layer, one in M of those also on the next. A graph is
kept as flat arrays, M neighbours a row and layer after layer. A search goes down
the layers greedily and widens on the lowest; the shards' finds are merged. Equal
vectors are one point of a graph, since copies would be each other's only
neighbours.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.common import U, mix, query, table
from sylva.session import materialize, spread

K = 10
M = 12
BUILD_WIDTH = 64
SEARCH_WIDTH = 192
SHARD_POINTS = 4096
QUERY_BLOCK = 512
SALTS = 32
INDEX = "shard int, dims int, points binary, place array<long>, layers array<int>, neighbours binary"


def levels(n: int, m: int = M) -> np.ndarray:
    """The top layer of each point: a hashed geometric draw, so the same at every build."""
    u = ((mix(np.arange(1, n + 1).astype(U)) >> U(11)).astype(float) + 1) / float((1 << 53) + 1)
    return np.minimum((-np.log(u) / np.log(m)).astype(int), 8)


def _search(vectors: np.ndarray, links: np.ndarray, q: np.ndarray, start: list[tuple[float, int]], width: int) -> list[tuple[float, int]]:
    """The ``width`` nearest points found on one layer, nearest first; -1 fills unused links."""
    seen = {i for _, i in start}
    todo = list(start)
    heapq.heapify(todo)
    best = [(-d, i) for d, i in start]
    heapq.heapify(best)
    while todo:
        d, i = heapq.heappop(todo)
        if len(best) >= width and d > -best[0][0]:
            break
        fresh = [j for j in links[i].tolist() if j >= 0 and j not in seen]
        if not fresh:
            continue
        seen.update(fresh)
        diff = vectors[fresh] - q
        for e, j in zip(np.einsum("ij,ij->i", diff, diff).tolist(), fresh, strict=True):
            if len(best) < width or e < -best[0][0]:
                heapq.heappush(todo, (e, j))
                heapq.heappush(best, (-e, j))
                if len(best) > width:
                    heapq.heappop(best)
    return sorted((-d, i) for d, i in best)


def _choose(vectors: np.ndarray, found: list[tuple[float, int]], m: int) -> list[int]:
    """Up to ``m`` of these, nearest first, those nearer to a chosen one than to the base only if room is left."""
    chosen: list[int] = []
    spare: list[int] = []
    for d, i in found:
        if len(chosen) >= m:
            break
        if chosen:
            diff = vectors[chosen] - vectors[i]
            if np.einsum("ij,ij->i", diff, diff).min() < d:
                spare.append(i)
                continue
        chosen.append(i)
    return chosen + spare[: m - len(chosen)]


def build_graph(vectors: np.ndarray, m: int = M, width: int = BUILD_WIDTH) -> tuple[np.ndarray, list[np.ndarray]]:
    """(top layer of each point, links of each layer): rows of 2m links on the lowest, m above."""
    top = levels(len(vectors), m)
    layers = [np.full((len(vectors), 2 * m if k == 0 else m), -1, np.int32) for k in range(int(top.max(initial=0)) + 1)]
    entry, high = 0, int(top[0]) if len(top) else 0
    for p in range(1, len(vectors)):
        q = vectors[p]
        near = [(float(((vectors[entry] - q) ** 2).sum()), entry)]
        for k in range(high, -1, -1):
            if k > top[p]:
                near = _search(vectors, layers[k], q, near, 1)
                continue
            near = _search(vectors, layers[k], q, near, width)
            most = layers[k].shape[1]
            own = _choose(vectors, near, m)
            layers[k][p, : len(own)] = own
            for i in own:
                row = layers[k][i]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = p
                else:
                    other = [*row.tolist(), p]
                    diff = vectors[other] - vectors[i]
                    d = np.einsum("ij,ij->i", diff, diff)
                    kept = _choose(vectors, sorted(zip(d.tolist(), other, strict=True)), most)
                    row[:] = -1
                    row[: len(kept)] = kept
        if top[p] > high:
            entry, high = p, int(top[p])
    return top, layers


def search_graph(vectors: np.ndarray, top: np.ndarray, layers: list[np.ndarray], q: np.ndarray, width: int = SEARCH_WIDTH) -> list[tuple[float, int]]:
    """(squared distance, point) of the ``width`` nearest found."""
    if not len(vectors):
        return []
    entry = int(top.argmax())
    near = [(float(((vectors[entry] - q) ** 2).sum()), entry)]
    for k in range(len(layers) - 1, 0, -1):
        near = _search(vectors, layers[k], q, near, 1)
    return _search(vectors, layers[0], q, near, width)


def points(vectors: DataFrame, k: int = K) -> DataFrame:
    """(vector, point, members): each vector once, with the k + 1 smallest ids that have it.

    More ids can't be among anyone's k nearest, ties going to smaller ids. Rows with
    a null id, a null or zero vector, or a component that is null or not finite take
    no part; repeated rows count once. A hot vector's ids are first cut down under
    salts."""
    x = F.col("embedding")
    fit = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("vector"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    fit = fit.where(F.coalesce(~F.exists("vector", bad), F.lit(False)) & F.exists("vector", lambda v: v != 0))
    key = fit.select("vec_id", "vector", F.xxhash64("vector").alias("h"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).distinct()
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
    few = key.withColumn("r", rank("h", "vector", "salt")).where(F.col("r") <= k + 1)
    few = few.withColumn("r", rank("h", "vector")).where(F.col("r") <= k + 1)
    # At most k + 1 ids are gathered.
    return few.groupBy("h", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).select(
        "vector", F.col("members")[0].alias("point"), "members")


def build_index(own: DataFrame, shards: int, m: int = M, width: int = BUILD_WIDTH) -> DataFrame:
    """One row for each shard and vector length of ``points``: vectors as float64, the points' ids, top layers, and all layers' links one after another."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point")
        v = np.stack(pdf["vector"].to_numpy()).astype(float)
        top, layers = build_graph(v, m, width)
        flat = np.concatenate([x.ravel() for x in layers]).astype("<i4").tobytes()
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "dims": pdf["dims"].iloc[:1], "points": [v.tobytes()], "place": [pdf["point"].to_numpy()], "layers": [top], "neighbours": [flat]})

    dealt = own.select(F.pmod(F.xxhash64("point"), F.lit(shards)).cast("int").alias("shard"), F.size("vector").alias("dims"), "vector", "point")
    return spread(dealt, "shard", "dims").groupBy("shard", "dims").applyInPandas(build, INDEX)


def unpack_index(row, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(vectors, point ids, top layers, layers) of an index row."""
    place, top = np.asarray(row["place"]), np.asarray(row["layers"])
    v = np.frombuffer(row["points"], float).reshape(len(place), -1)
    flat = np.frombuffer(row["neighbours"], "<i4")
    layers, at = [], 0
    for k in range(int(top.max(initial=0)) + 1):
        size = 2 * m if k == 0 else m
        layers.append(flat[at : at + size * len(place)].reshape(len(place), size))
        at += size * len(place)
    return v, place, top, layers


FOUND = "asked long, point long, d double"


def search(index: DataFrame, shards: int, asked: DataFrame, k: int = K, width: int = SEARCH_WIDTH, m: int = M) -> DataFrame:
    """(asked, point, d): for each row of (asked, vector), of every shard the k + 1 nearest points of its length found.

    Queries go in blocks; each block meets each shard once."""
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("asked"), F.lit(blocks)).cast("int").alias("block")
    all_shards = F.sequence(F.lit(0), F.lit(shards - 1))
    left = asked.select("asked", "vector", F.size("vector").alias("dims"), block, F.explode(all_shards).alias("shard")).groupBy("shard", "dims", "block")
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("shard", "dims", "block")

    def find(queries: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(graph):
            v, place, top, layers = unpack_index(graph.iloc[0], m)
            for a, q in zip(queries["asked"], queries["vector"], strict=True):
                got = search_graph(v, top, layers, np.asarray(q, float), width)
                got = sorted((float(np.sqrt(d)), int(place[i])) for d, i in got)[: k + 1]
                out += [(a, p, d) for d, p in got]
        return pd.DataFrame(out, columns=["asked", "point", "d"]).astype({"asked": "int64", "point": "int64", "d": float})

    return left.cogroup(right).applyInPandas(find, FOUND)


def nearest(vectors: DataFrame, every: int = 100, k: int = K, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` the k nearest other rows found, by Euclidean distance, ties to smaller ids.

    Fewer rows where there are fewer candidates. Vectors of another length than the
    query's don't meet it."""
    own = materialize(points(vectors, k))
    shards = max(1, -(-own.count() // shard_points))
    index = materialize(build_index(own, shards))
    ids = vectors.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    # Equal query vectors are one search.
    asking = materialize(ids.distinct().join(own.select("vector", "point"), "vector").select("query_id", F.col("point").alias("asked")))
    asked = materialize(own.select(F.col("point").alias("asked"), "vector").join(asking.select("asked").distinct(), "asked"))
    found = search(index, shards, asked, k)
    # A point's copies are at its distance; shards times k rows meet here for each query vector.
    each = found.join(own.select("point", "members"), "point").select("asked", "d", F.explode("members").alias("vec_id"))
    near = each.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy("d", "vec_id"))).where(F.col("r") <= k + 1)
    merged = materialize(near.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("d", "vec_id"))).alias("near")))
    best = asking.join(merged, "asked").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return best.select("query_id", F.posexplode("near").alias("i", "x")).select(
        "query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.d").alias("score"))


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))
