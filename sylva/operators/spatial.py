"""Distance joins as equi-joins on grid cells, safe when one cell is crowded.

A grid of side ``2d`` turns "within d" into a hash join on four cells. When a
cell holds more than ``LEAF`` points it is split in four, again and again, so
that no join key ever meets an unbounded list of partners: a query walks down
the split cells, dropping those whose box is farther than the best box so far.
The answer is exact; nothing is capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.session import materialize, meet

LEAF = 64
DEEPEST = 40


def cell_of(v: Column, side: float, level: int = 0) -> Column:
    """Cell index; dividing first makes the cells of all levels nest exactly."""
    return F.floor(v / F.lit(float(side)) * F.lit(float(2**level)))


def _around(reach: int) -> Column:
    return F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
        for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)
    ])


def explode_around(df: DataFrame, reach: int = 1, i: str = "i", j: str = "j") -> DataFrame:
    """One row per neighbouring cell of (i, j), the cell itself included."""
    return (
        df.withColumn("_o", F.explode(_around(reach)))
        .withColumn(i, F.col(i) + F.col("_o.a"))
        .withColumn(j, F.col(j) + F.col("_o.b"))
        .drop("_o")
    )


def _best(pairs: DataFrame, inclusive: bool, d: float) -> DataFrame:
    near = F.col("dist") <= d if inclusive else F.col("dist") < d
    return (
        pairs.filter(near)
        .groupBy("qid")
        .agg(F.min(F.struct("dist", "rid")).alias("_b"))
        .select("qid", F.col("_b.rid").alias("rid"), F.col("_b.dist").alias("dist"))
    )


def _distance() -> Column:
    dx, dy = F.col("qx") - F.col("x"), F.col("qy") - F.col("y")
    return F.sqrt(dx * dx + dy * dy)


def crowded(points: DataFrame, side: float, keys: list[str], leaf: int) -> bool:
    """Does any cell hold more than ``leaf`` points? One partial aggregation."""
    counts = points.groupBy(*keys, cell_of(F.col("x"), side).alias("i"),
                            cell_of(F.col("y"), side).alias("j")).count()
    return not counts.filter(F.col("count") > leaf).isEmpty()


def nearest_in_cells(
    queries: DataFrame, points: DataFrame, d: float, side: float,
    keys: list[str] | None = None, inclusive: bool = False, leaf: int = LEAF, weighted: bool = False,
    derived: dict[str, Column] | None = None,
) -> DataFrame:
    """Nearest point per query among the root cells the query names.

    ``queries(qid, qx, qy, [keys], i, j)`` holds one row per query and root
    cell, ``points(rid, x, y, [keys])``. Returns ``qid, rid, dist`` for
    queries with a point nearer than ``d``; equal distances go to the lowest
    ``rid``. ``weighted`` queries have their own ``limit`` (at most ``d``) in place
    of ``d`` and meet only points whose ``weight`` is at least their ``need``; of
    several points at one place any one may then stand for the others.
    ``derived`` columns of a query, such as a wide ``qid``, follow from its others
    and need not travel with it; they are made where it meets its points.
    """
    keys = keys or []
    at = keys + ["i", "j"]
    own, more = (["limit", "need"], ["weight"]) if weighted else ([], [])

    def best(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("dist", _distance())
        if weighted:
            near = F.col("dist") <= F.col("limit") if inclusive else F.col("dist") < F.col("limit")
            pairs = pairs.filter(near & (F.col("weight") >= F.col("need")))
        return _best(pairs, inclusive, d)

    if not crowded(points, side, keys, leaf):
        placed = points.select("rid", "x", "y", *more, *keys,
                               cell_of(F.col("x"), side).alias("i"), cell_of(F.col("y"), side).alias("j"))
        return best(meet(queries, placed, at).withColumns(derived or {}))

    # Copies of a place: the lowest id answers for all of them.
    active = points.groupBy("x", "y", *keys).agg(F.min("rid").alias("rid"), *[F.max(c).alias(c) for c in more])
    asking = queries.withColumns(derived or {}).withColumn("bound", F.col("limit") if weighted else F.lit(float(d)))
    found: DataFrame | None = None
    for level in range(DEEPEST + 1):
        placed = materialize(
            active.withColumn("i", cell_of(F.col("x"), side, level))
            .withColumn("j", cell_of(F.col("y"), side, level))
        )
        cells = materialize(placed.groupBy(*at).agg(
            F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
            F.min("y").alias("y0"), F.max("y").alias("y1"),
            *[f(c).alias(f"{c}_{n}") for c in more for f, n in ((F.min, "least"), (F.max, "most"))],
        ))
        is_leaf = (F.col("n") <= leaf) if level < DEEPEST else F.lit(True)
        gap_x = F.greatest(F.lit(0.0), F.col("x0") - F.col("qx"), F.col("qx") - F.col("x1"))
        gap_y = F.greatest(F.lit(0.0), F.col("y0") - F.col("qy"), F.col("qy") - F.col("y1"))
        far_x = F.greatest(F.abs(F.col("qx") - F.col("x0")), F.abs(F.col("qx") - F.col("x1")))
        far_y = F.greatest(F.abs(F.col("qy") - F.col("y0")), F.abs(F.col("qy") - F.col("y1")))
        reached = (
            meet(asking, cells, at)
            .withColumn("lo", F.sqrt(gap_x * gap_x + gap_y * gap_y))
            .withColumn("hi", F.sqrt(far_x * far_x + far_y * far_y))
            .withColumn("leaf", is_leaf)
        )
        if weighted:
            # A box promises an answer only if all its points are heavy enough.
            reached = reached.filter("weight_most >= need").withColumn("hi", F.when(F.col("weight_least") >= F.col("need"), F.col("hi")))
        # The farthest corner of the nearest box bounds every later answer. The
        # tiny allowance keeps rounding from dropping an equal distance.
        tight = reached.groupBy("qid").agg(F.min("hi").alias("_hi"))
        kept = materialize(
            meet(reached, tight, "qid")
            .withColumn("bound", F.least("bound", "_hi"))
            .filter(F.col("lo") <= F.col("bound") * (1 + 1e-12))
            .select("qid", "qx", "qy", *own, *at, "bound", "leaf")
        )
        here = best(meet(kept.filter("leaf").drop("leaf", "bound"), placed, at))
        found = here if found is None else found.unionByName(here)
        deeper = cells.filter(~is_leaf)
        if deeper.isEmpty():
            break
        active = placed.join(deeper.select(*at), at, "left_semi").drop("i", "j")
        child = F.explode(F.array(*[
            F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
            for a in (0, 1) for b in (0, 1)
        ]))
        asking = (
            kept.filter(~F.col("leaf")).withColumn("_c", child)
            .withColumn("i", F.col("i") * 2 + F.col("_c.a"))
            .withColumn("j", F.col("j") * 2 + F.col("_c.b"))
            .drop("_c", "leaf")
        )
    return (
        found.groupBy("qid").agg(F.min(F.struct("dist", "rid")).alias("_b"))
        .select("qid", F.col("_b.rid").alias("rid"), F.col("_b.dist").alias("dist"))
    )


def nearest_within(
    left: DataFrame, right: DataFrame, d: float, left_id: str = "fid", right_id: str = "fid",
    inclusive: bool = False, leaf: int = LEAF, keys: list[str] | None = None,
) -> DataFrame:
    """Each left point's single nearest right point closer than ``d``."""
    keys = keys or []
    if d <= 0:
        raise ValueError("the search distance must be positive")
    # With cells of side 2d a search disc meets two cells per axis, so a query
    # is sent to four keys, not nine.
    side, reach = 2.0 * d, d * (1 + 1e-9)
    span = lambda c: F.explode(F.sequence(cell_of(F.col(c) - reach, side), cell_of(F.col(c) + reach, side)))
    asked = left.select(F.col(left_id).alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), *keys)
    queries = asked.withColumn("i", span("qx")).withColumn("j", span("qy"))
    points = right.select(F.col(right_id).alias("rid"), "x", "y", *keys)
    return nearest_in_cells(queries, points, d, side, keys, inclusive, leaf)
