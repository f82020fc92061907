"""Centroid clustering with exact integer distances kept up to date.

Each vector's dot products with all centroids are kept in a table. When centroids
move, a vector's products change only by the components that moved, so a round adds
those to the stored products and takes the smallest distance anew; nothing is
rounded. A round is one pass over the table, written to the checkpoint folder, and
one sum for each cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import integer_vectors, query, table
from sylva.session import materialize

K = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
SEED = "1"
TABLE = "vec_id long, v array<int>, norm long, dots array<long>, cluster int, distance long"
_ARROW = pa.schema([
    ("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("norm", pa.int64()), ("dots", pa.list_(pa.int64())),
    ("cluster", pa.int32()), ("distance", pa.int64())])


def start(vectors: DataFrame, k: int, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """The table before any centroid: squared lengths, and products of 0 with ``k`` centroids at the origin.

    With components up to 2**27 and 64 of them every distance fits a long; larger
    components are an error, never a wrong number."""
    whole = integer_vectors(vectors, scale).where(F.size("v") == dims)
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    return whole.select(
        "vec_id", "v", square.alias("norm"), F.array_repeat(F.lit(0).cast("long"), k).alias("dots"),
        F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))


def seeds(rows: DataFrame, k: int, dims: int = DIMS, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes, in that order; rows without an id start none."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where(F.col("vec_id").isNotNull()).select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)


def moved(rows: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The table for centroids ``new``, given the one for ``old``: products, nearest centroid (ties: smaller number), distance."""
    change = new - old
    changed = [(j, np.flatnonzero(change[j])) for j in np.flatnonzero(change.any(axis=1)).tolist()]
    squares = (new * new).sum(axis=1)
    arrow = _ARROW

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v").flatten().to_numpy().astype(np.int64).reshape(b.num_rows, -1)
            dots = b.column("dots").flatten().to_numpy().reshape(b.num_rows, -1).copy()
            for j, at in changed:
                dots[:, j] += v[:, at] @ change[j, at]
            far = b.column("norm").to_numpy()[:, None] - 2 * dots + squares
            best = far.argmin(axis=1)
            ends = pa.array(np.arange(0, dots.size + 1, dots.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id"), b.column("v"), b.column("norm"), pa.ListArray.from_arrays(ends, pa.array(dots.ravel())),
                pa.array(best.astype(np.int32)), pa.array(far[np.arange(len(best)), best])], schema=arrow)

    return rows.mapInArrow(step, TABLE)


def means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each cluster; an empty one's centroid stays. k rows come to the driver."""
    out = centroids.copy()
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(table of all kept vectors with products, cluster and distance; the final centroids).

    Kept are the rows whose ``embedding`` has exactly ``dims`` components, none null
    or not finite. A row is a vector: repeated rows all count, and those among the
    seeds give equal centroids, of which the later stay empty. Rows without an id
    are clustered but start no centroid. With fewer rows than ``k`` there are fewer
    centroids, without any the result is empty. Other columns are left alone."""
    first = materialize(start(vectors, k, dims, scale))
    centroids = seeds(first, k, dims, seed)
    if not len(centroids):
        return first.where(F.lit(False)), centroids
    if len(centroids) < k:
        first = first.withColumn("dots", F.slice("dots", 1, len(centroids)))
    rows = materialize(moved(first, np.zeros_like(centroids), centroids))
    for _ in range(rounds):
        new = means(rows, centroids)
        if (new == centroids).all():
            break
        rows, centroids = materialize(moved(rows, centroids, new)), new
    return rows, centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def _sql() -> str:
    nearest = """
        p{i} AS MATERIALIZED (
            SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
                SELECT rid, c, sum((x - y) * (x - y))::BIGINT AS d FROM v JOIN c{i} USING (k) GROUP BY rid, c) GROUP BY rid)"""
    means_ = """
        c{j} AS MATERIALIZED (
            SELECT o.c, o.k, coalesce(m.y, o.y) AS y FROM c{i} o LEFT JOIN (
                SELECT c, k, floor(sum(x)::DOUBLE / count(*))::BIGINT AS y FROM p{i} JOIN v USING (rid) GROUP BY c, k) m USING (c, k))"""
    parts = [nearest.format(i=0)]
    for i in range(ROUNDS):
        parts += [means_.format(i=i, j=i + 1), nearest.format(i=i + 1)]
    last = ROUNDS
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS rid, vec_id, embedding AS e FROM embeddings
        WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    v AS MATERIALIZED (SELECT rid, unnest(range({DIMS})) AS k, floor({SCALE} * unnest(e)::DOUBLE)::BIGINT AS x FROM kept),
    c0 AS MATERIALIZED (
        SELECT c, k, x AS y FROM v JOIN (
            SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM kept
            QUALIFY c < {K}) USING (rid)),{",".join(parts)},
    seal AS (SELECT c, sha256(string_agg(y, ',' ORDER BY k)) AS h FROM c{last} GROUP BY c)
    SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
           (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
    FROM p{last} JOIN kept USING (rid) JOIN seal USING (c)"""


@query("op11_centroids", _sql())
def op11_centroids(spark, sf_dir):
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    spent = {r["cluster"]: r["spent"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("spent")).collect()}
    facts = [(j, s, sum(spent.values()), digest(centroids[j])) for j, s in sorted(spent.items())]
    # One row for each of at most k clusters.
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
