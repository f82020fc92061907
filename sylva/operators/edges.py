"""Polygons as an index of edges in grid cells.

An edge is listed in the cells it crosses, so the index grows with the length of the
outlines and no cell holds a whole ring. Each such cell also has a seed: whether its
lower right corner is inside. A point of the cell is then judged by the cell's own
edges: walk from the corner up the cell's right side to the point's height, then left
to the point, and count the edges crossed. Both counts use the one comparison that
the even-odd rule on whole rings uses, so the answers are the same. Between two such
cells of a grid row all cells are inside or all outside; inside ones are kept as
runs, cut at powers of two so that an equi-join finds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.geometry import _next, pin
from sylva.session import materialize, spread

#: Edges in one row of a cell; a cell with more has several rows, whose counts add up.
CHUNK = 64
#: Halving a side so often comes to the resolution of coordinates.
FINEST = 40
EDGE = ("ax", "ay", "bx", "by")


def edges_of(polys: DataFrame, rings: str = "rings") -> DataFrame:
    """One row per edge: all columns but the rings, and ``ax, ay, bx, by``."""
    ring = F.col("_ring")
    sides = F.zip_with(ring, _next(ring), lambda a, b: F.struct(
        a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    others = [c for c in polys.columns if c != rings]
    return polys.select(*others, F.explode(rings).alias("_ring")).select(*others, F.inline(sides))


def _slack(side: float) -> Column:
    """A reach that covers rounding of places in the grid."""
    return F.lit(side * 1e-9) + F.greatest(*[F.abs(F.col(c)) for c in EDGE]) * F.lit(1e-14)


def crossed_cells(edges: DataFrame, side: float) -> DataFrame:
    """Edges with each grid cell ``i, j`` they cross or touch."""
    s = F.lit(float(side))
    ax, ay, bx, by = (F.col(c) for c in EDGE)
    e = F.col("_e")
    columns = edges.withColumn("_e", _slack(side)).withColumn(
        "i", F.explode(F.sequence(F.floor((F.least(ax, bx) - e) / s), F.floor((F.greatest(ax, bx) + e) / s))))

    def at(x: Column) -> Column:
        t = (F.least(F.greatest(x, F.least(ax, bx)), F.greatest(ax, bx)) - ax) / (bx - ax)
        return ay + t * (by - ay)

    y0 = F.when(ax == bx, ay).otherwise(at(F.col("i") * s - e))
    y1 = F.when(ax == bx, by).otherwise(at((F.col("i") + 1) * s + e))
    ends = pin(columns, _y0=y0, _y1=y1)
    rows = F.sequence(F.floor((F.least("_y0", "_y1") - e) / s), F.floor((F.greatest("_y0", "_y1") + e) / s))
    return ends.withColumn("j", F.explode(rows)).drop("_e", "_y0", "_y1")


def _straddles(y: Column) -> Column:
    return (F.col("ay") > y) != (F.col("by") > y)


def _at(y: Column) -> Column:
    return (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")


def toggles(edges: Column, px: Column, py: Column, x1: Column, y0: Column) -> Column:
    """How many of a cell's edges lie on the way from its corner ``x1, y0`` to a point of the cell."""
    def crossed(e: Column) -> Column:
        def right_of(x: Column, y: Column) -> Column:
            straddles = (e["ay"] > y) != (e["by"] > y)
            at = (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
            return F.when(straddles, x < at).otherwise(F.lit(False))

        left = right_of(px, py) & ~right_of(x1, py)
        # Up the right side: only edges that cross its line count, by the side on which they leave a height.
        end = F.when(e["ax"] > x1, e["ay"]).otherwise(e["by"])
        above = lambda y: right_of(x1, y) != (end > y)
        up = ((e["ax"] > x1) != (e["bx"] > x1)) & (above(py) != above(y0))
        return left.cast("int") + up.cast("int")

    return F.aggregate(edges, F.lit(0), lambda n, e: n + F.coalesce(crossed(e), F.lit(0)))


def _chunked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with their edges in rows of at most ``CHUNK``; only the first row has the seed."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*EDGE)) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    cells = rows.withColumn("chunk", F.floor(number / CHUNK)).withColumn("chunks", F.ceil(total / CHUNK))
    return cells.groupBy(*keys, "chunk", "chunks").agg(
        F.max(F.when(F.col("chunk") == 0, F.col("seed")).otherwise(0)).alias("seed"), F.collect_list(F.struct(*EDGE)).alias("edges"))


def edge_index(polys: DataFrame, side: float) -> tuple[DataFrame, DataFrame]:
    """(cells with edges: ``fid, i, j, chunk, chunks, seed, edges``; cells inside: ``level, i, j``).

    The second has runs of 2**level cells, ``i`` counted in such runs. One exchange
    by polygon and grid row serves both; rings go no further than the first step."""
    s = F.lit(float(side))
    edges = edges_of(polys.select("fid", "rings"))
    local = crossed_cells(edges, side).select("fid", "i", "j", *EDGE, ((F.col("i") + 1) * s).alias("pos"), F.lit(0).alias("kind"))
    lines = edges.withColumn("j", F.explode(F.sequence(
        F.floor(F.least("ay", "by") / s) - 1, F.floor(F.greatest("ay", "by") / s) + 1)))
    line = F.col("j") * s
    met = lines.filter(_straddles(line)).select(
        "fid", F.lit(None).cast("long").alias("i"), "j", *[F.lit(None).cast("double").alias(c) for c in EDGE], _at(line).alias("pos"), F.lit(1).alias("kind"))
    rows = spread(local.unionByName(met), "fid", "j")
    from_right = Window.partitionBy("fid", "j").orderBy(F.desc("pos"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    seeded = rows.withColumn("seed", (F.sum("kind").over(from_right) % 2).cast("int")).filter("kind = 0")
    cells = materialize(_chunked(seeded.drop("pos", "kind"), ["fid", "j", "i"]))
    follows = F.lead("i").over(Window.partitionBy("fid", "j").orderBy("i"))
    runs = cells.filter("chunk = 0").withColumn("_b", follows).filter((F.col("seed") == 1) & (F.col("_b") - F.col("i") > 1))
    return cells, materialize(_runs(runs.select((F.col("i") + 1).alias("_a"), "_b", "j")))


def _runs(runs: DataFrame) -> DataFrame:
    """Runs of cells from ``_a`` to before ``_b`` in aligned stretches of powers of two."""
    levels = F.sequence(F.lit(0), F.ceil(F.log2((F.col("_b") - F.col("_a")).cast("double"))).cast("int"))
    size = F.pow(F.lit(2.0), F.col("level"))
    each = runs.withColumn("level", F.explode(levels)).withColumn("_l", F.ceil(F.col("_a") / size)).withColumn("_r", F.floor(F.col("_b") / size)).filter("_l < _r")
    odd = lambda c: F.pmod(F.col(c), F.lit(2)) == 1
    ends = F.array_compact(F.array(F.when(odd("_l"), F.col("_l")), F.when(odd("_r"), F.col("_r") - 1)))
    return each.select("level", F.explode(ends).alias("i"), "j").distinct()


def split_cells(cells: DataFrame, side: float) -> tuple[DataFrame, DataFrame]:
    """(cells with edges, cells inside) of half the side, from whole cells of ``side``."""
    half = F.lit(side / 2)
    quarter = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    child = lambda c, q: F.col(c) * 2 + F.col(f"_q.{q}")
    corners = cells.withColumn("_q", quarter).select(
        "fid", child("i", "a").alias("i"), child("j", "b").alias("j"), "seed", "edges",
        ((F.col("i") + 1) * F.lit(side)).alias("_x1"), (F.col("j") * F.lit(side)).alias("_y0"))
    turned = toggles(F.col("edges"), (F.col("i") + 1) * half, F.col("j") * half, F.col("_x1"), F.col("_y0"))
    seeds = corners.groupBy("fid", "i", "j").agg((F.sum(F.col("seed") + turned) % 2).cast("int").alias("seed"))
    each = cells.select("fid", F.col("i").alias("_i"), F.col("j").alias("_j"), F.inline("edges"))
    local = crossed_cells(each, side / 2).filter((F.floor(F.col("i") / 2) == F.col("_i")) & (F.floor(F.col("j") / 2) == F.col("_j")))
    joined = materialize(seeds.join(local.select("fid", "i", "j", *EDGE), ["fid", "i", "j"], "left"))
    inside = joined.filter(F.col("ax").isNull() & (F.col("seed") == 1)).select(F.lit(0).alias("level"), "i", "j").distinct()
    return materialize(_chunked(joined.filter("ax is not null"), ["fid", "i", "j"])), inside


def points_in_index(points: DataFrame, cells: DataFrame, inside: DataFrame, side: float, crowded: int) -> DataFrame:
    """``_id`` of the points ``_id, x, y`` inside some polygon of the index, each once.

    A cell where points times rows of edges exceed ``crowded`` is split in four as
    long as its points lie apart: most polygons then hold a quarter wholly or not
    at all. Splitting saves work and changes no answer."""
    found: DataFrame | None = None
    for depth in range(FINEST + 1):
        levels = sorted(r[0] for r in inside.select("level").distinct().collect())
        s = F.lit(float(side))
        placed = points.withColumn("i", F.floor(F.col("x") / s)).withColumn("j", F.floor(F.col("y") / s))
        busy = None
        if depth < FINEST:
            many = placed.groupBy("i", "j").agg(
                F.count("*").alias("n"), ((F.min("x") < F.max("x")) | (F.min("y") < F.max("y"))).alias("apart"))
            busy = materialize(
                cells.groupBy("i", "j").agg(F.count("*").alias("m")).join(many, ["i", "j"])
                .filter(F.col("apart") & (F.col("n") * F.col("m") > crowded)).select("i", "j"))
            busy = None if busy.isEmpty() else busy
        here = cells if busy is None else cells.join(busy, ["i", "j"], "left_anti")
        here = here.withColumn("level", F.lit(0))
        hit = toggles(F.col("edges"), F.col("x"), F.col("y"), (F.col("i") + 1) * s, F.col("j") * s) + F.col("seed")
        alone = placed.withColumn("level", F.lit(0))
        if levels:
            # A point asks for its cell and for the run that holds it on each level there is.
            level = F.explode(F.array(*[F.lit(n) for n in sorted({0, *levels})]))
            alone = placed.withColumn("level", level).withColumn(
                "i", F.floor(F.col("i") / F.pow(F.lit(2.0), F.col("level"))))
            here = here.unionByName(inside, allowMissingColumns=True)
        joined = alone.join(here, ["level", "i", "j"])
        whole = joined.filter(F.col("edges").isNull()).select("_id") if levels else None
        single = joined.filter((F.col("chunks") == 1) & (hit % 2 == 1)).select("_id")
        several = joined.filter("chunks > 1").select("_id", "x", "y", "fid", "chunk", hit.alias("_h")).distinct().groupBy(
            "_id", "x", "y", "fid").agg(F.sum("_h").alias("_h")).filter("_h % 2 = 1").select("_id")
        got = single.unionByName(several) if whole is None else single.unionByName(several).unionByName(whole)
        found = got if found is None else found.unionByName(got)
        if busy is None:
            return found.distinct()
        points = materialize(placed.join(busy, ["i", "j"], "left_semi").select("_id", "x", "y"))
        cells, inside = split_cells(cells.join(busy, ["i", "j"], "left_semi"), side)
        side = side / 2
    raise AssertionError("the finest level is not split")
