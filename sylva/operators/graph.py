"""Connected components and greedy suppression in rounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sylva.operators.spatial import cell_of, explode_around, nearest_in_cells
from sylva.session import materialize, spread


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Minima are written out: what is left is a plain join, where Spark splits a hub's partition.
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return (
        both.filter(F.col("v") > F.col("u")).join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` with the smallest node of each component as its label.

    Alternating large-star and small-star rounds; the edge list never grows, and
    a node with very many neighbours meets only one minimum row per round.
    """
    current = materialize(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    )
    state = _checksum(current)
    while state[0] > 0:
        current = materialize(_small_star(materialize(_large_star(current))))
        after = _checksum(current)
        if after == state:
            break
        state = after
    labels = current.groupBy("u").agg(F.min("v").alias("v"))
    roots = labels.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return labels.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def cycle_order(links: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, ring, ahead`` for links (``keys, node, next``) that form closed rings.

    ``ring`` is the smallest node of the ring and ``ahead`` the number of steps from
    the node on to it. Pointer doubling: each round every node knows the smallest of
    twice as many nodes ahead, so a ring of n nodes takes log2(n) + 1 rounds, each a
    join on unique keys. A round without a change ends it: were some ring not known
    as a whole, two neighbouring stretches of it would hold different smallest nodes."""
    at = keys + ["jump"]
    state = materialize(links.select(*keys, "node", F.col("next").alias("jump"), F.col("node").alias("ring"), F.lit(0).cast("long").alias("ahead")))
    width = 1
    while True:
        far = state.select(*keys, F.col("node").alias("jump"), F.col("jump").alias("_j"), F.col("ring").alias("_r"), F.col("ahead").alias("_a"))
        nearer = F.col("_r") < F.col("ring")
        moved = materialize(state.join(far, at).select(
            *keys, "node", F.col("_j").alias("jump"), F.least("ring", "_r").alias("ring"),
            F.when(nearer, F.col("_a") + width).otherwise(F.col("ahead")).alias("ahead"), nearer.alias("moved")))
        if moved.filter("moved").isEmpty():
            return state.select(*keys, "node", "ring", "ahead")
        state, width = moved, 2 * width


# ---- cells by radius ----------------------------------------------------------

#: Cells of a level have a diagonal just below the level's least radius.
UNIT = 2.0**-0.5 * (1 - 1e-9)
#: A radius of a level, below twice its least one, reaches this many cells.
REACH = 3
#: Cells along a tile, and around it, that are settled together.
TILE_CELLS = 64
RIM_CELLS = 8
#: Points of a cell looked at in one round; more of them wait, none are dropped.
DEEP = 8


def _base(radii: DataFrame, r: str) -> float:
    """The smallest positive radius without its power of two, so that it opens a level of its own; one value."""
    least = radii.filter(F.col(r) > 0).agg(F.min(r)).first()[0]
    return 2 * math.frexp(least)[0] if least else 1.0


def level_of(r: Column, base: float) -> Column:
    """The k of the largest base * 2**k at or below a radius."""
    return F.floor(F.log2(r / F.lit(base))).cast("int")


def _scaled(v: Column, level: Column) -> Column:
    """A length in units of the level; scaling by a power of two is exact."""
    return v * F.pow(F.lit(2.0), -level)


def _cell(v: str, level: Column, base: float) -> Column:
    return F.floor(_scaled(F.col(v), level) / F.lit(base * UNIT))


def _gap(ox: str, oy: str) -> Column:
    dx, dy = F.col("x") - F.col(ox), F.col("y") - F.col(oy)
    return F.sqrt(dx * dx + dy * dy)


def _settle(tile: int, rim: int, keys: list[str], side: float, fid: pa.DataType):
    """The sequential pass over tiles and their rims: who is certainly kept, who certainly goes.

    Rows come sorted by tile and rank. Only the first points of each cell are there; a
    cell's last row stands for the points after it, wherever in the cell they are.
    Whoever might be reached by a point that isn't decided isn't decided either."""
    steps = [(a, b) for a in range(-REACH, REACH + 1) for b in range(-REACH, REACH + 1)]
    told = pa.schema([("fid", fid), ("kept", pa.bool_())])

    def judge(x: float, y: float, near) -> tuple[bool, bool]:
        open_ = False
        for ox, oy, reach, kept, i, j in near:
            if ox is None:
                dx, dy = max(i * side - x, 0.0, x - (i + 1) * side), max(j * side - y, 0.0, y - (j + 1) * side)
                open_ |= math.sqrt(dx * dx + dy * dy) <= reach * (1 + 1e-6)
            elif math.sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) <= reach:
                if kept:
                    return True, False
                open_ = True
        return False, open_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, flat, here = None, [], {}
        for batch in batches:
            ids, kept_ = [], []
            columns = (batch.column(c).to_pylist() for c in ("fid", "x", "y", "r", "i", "j", "last", "_ti", "_tj"))
            groups = zip(*[batch.column(k).to_pylist() for k in keys], strict=True) if keys else iter(lambda: (), None)
            for key, (fid_, x, y, r, i, j, last, ti, tj) in zip(groups, zip(*columns, strict=True), strict=False):
                if (key, ti, tj) != current:
                    current, flat, here = (key, ti, tj), [], {}
                if last:
                    entry, gone = (None, None, r, False, i, j), False
                else:
                    if len(flat) > len(steps):
                        near = (e for a, b in steps for e in here.get((i + a, j + b), ()))
                    else:
                        near = flat
                    gone, open_ = judge(x, y, near)
                    di, dj = i - ti * tile, j - tj * tile
                    seen = min(di, dj) >= REACH - rim and max(di, dj) < tile + rim - REACH
                    kept = not gone and not open_ and seen
                    if 0 <= di < tile and 0 <= dj < tile and (gone or kept):
                        ids.append(fid_)
                        kept_.append(kept)
                    entry = (x, y, r, kept, i, j)
                if not gone:
                    flat.append(entry)
                    here.setdefault((i, j), []).append(entry)
            yield pa.RecordBatch.from_arrays([pa.array(ids, fid), pa.array(kept_, pa.bool_())], schema=told)

    return run


def nms(
    points: DataFrame, radius: float | None = None,
    keys: list[str] | None = None, tile: int = TILE_CELLS,
) -> DataFrame:
    """Greedy suppression: a point goes if an earlier kept point has it within
    that kept point's radius (its own ``sigma``, or ``radius`` for all).

    The order is sigma descending, then fid. Radii fall into levels, doubling from
    the smallest on, and levels are settled from the largest: a point meets the kept
    points of the levels above its own, then its level's points are settled in tiles
    in the sequential order. A cell of a level has a diagonal below its radii, so it
    holds one kept point at most and joins meet a bounded number of them. What a tile
    can't know of its rim waits for the next round; a round settles all but such
    points, and always the first one left. Of points at one place only the first can
    be kept. Points without a place or a radius meet nobody and stay.
    """
    keys = keys or []
    sigma = F.col("sigma").cast("double")
    r = sigma if radius is None else F.lit(float(radius))
    rank = F.struct((-sigma).alias("s"), "fid")
    slim = points.select("fid", F.col("x").cast("double"), F.col("y").cast("double"), *keys, r.alias("r"), rank.alias("rank"))
    somewhere = "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"
    placed = slim.filter(f"r >= 0 AND NOT isnan(r) AND {somewhere}")
    first = placed.groupBy(*keys, "x", "y").agg(F.min(F.struct("rank", "r")).alias("_f")).select(*keys, "x", "y", "_f.rank", "_f.r", F.col("_f.rank.fid").alias("fid"))
    first = materialize(first)
    base = _base(first, "r")
    # A radius of 0 reaches only its own place, where one point is left.
    todo = first.withColumn("level", F.when(F.col("r") > 0, level_of(F.col("r"), base)))
    # At most one row for each exponent of a double.
    levels = sorted((v[0] for v in todo.select("level").distinct().collect()), key=lambda v: (v is None, -(v or 0)))
    fid = points.schema["fid"].dataType
    none = F.lit(None).cast("int")
    kept: DataFrame | None = None
    for at, level in enumerate(levels):
        own = todo.filter(F.col("level").isNull() if level is None else F.col("level") == level).drop("level")
        if kept is not None:
            own = materialize(_beyond_reach(own, kept, levels[:at], keys, base))
        if level is None:
            own = own.withColumn("level", none)
            kept = own if kept is None else kept.unionByName(own)
            continue
        lv = F.lit(level)
        while True:
            celled = own.withColumn("i", _cell("x", lv, base)).withColumn("j", _cell("y", lv, base))
            number = F.row_number().over(Window.partitionBy(*keys, "i", "j").orderBy("rank"))
            heads = celled.withColumn("_n", number).filter(F.col("_n") <= DEEP + 1)
            around = lambda c: F.explode(F.sequence(F.floor((F.col(c) - RIM_CELLS) / tile), F.floor((F.col(c) + RIM_CELLS) / tile)))
            dealt = heads.select(*keys, "fid", "x", "y", "r", "i", "j", "rank", (F.col("_n") > DEEP).alias("last"))
            dealt = dealt.withColumn("_ti", around("i")).withColumn("_tj", around("j"))
            rows = spread(dealt, *keys, "_ti", "_tj").sortWithinPartitions(*keys, "_ti", "_tj", "rank").drop("rank")
            run = _settle(tile, RIM_CELLS, keys, base * UNIT * 2.0**level, to_arrow_type(fid))
            told = materialize(rows.mapInArrow(run, f"fid {fid.simpleString()}, kept boolean"))
            new = materialize(own.join(told.filter("kept"), "fid", "left_semi").withColumn("level", lv))
            kept = new if kept is None else kept.unionByName(new)
            own = materialize(own.join(told, "fid", "left_anti"))
            if own.isEmpty():
                break
            own = materialize(_beyond_reach(own, new, [level], keys, base))
    lost = placed.select("fid")
    if kept is not None:
        lost = lost.join(kept.select("fid"), "fid", "left_anti")
        # What has a place but a negative radius reaches nobody, yet can be reached.
        meek = slim.filter(f"r < 0 AND {somewhere}")
        free = _beyond_reach(meek, kept, levels, keys, base).join(kept.filter("level is null").select(*keys, "x", "y"), [*keys, "x", "y"], "left_anti")
        lost = lost.unionByName(meek.select("fid").join(free.select("fid"), "fid", "left_anti"))
    return points.join(lost, "fid", "left_anti")


def _beyond_reach(points: DataFrame, kept: DataFrame, levels: list[int | None], keys: list[str], base: float) -> DataFrame:
    """Points that no kept point of these levels reaches. A point asks for one cell on each level."""
    real = [v for v in levels if v is not None]
    if not real:
        return points
    at = keys + ["level", "i", "j"]
    lv = F.col("level")
    around = kept.filter(lv.isNotNull()).select(*keys, "level", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("r").alias("_reach"))
    around = explode_around(around.withColumn("i", _cell("ox", lv, base)).withColumn("j", _cell("oy", lv, base)), REACH)
    asked = points.select("fid", "x", "y", *keys, F.explode(F.array(*[F.lit(v) for v in real])).alias("level"))
    asked = asked.withColumn("i", _cell("x", lv, base)).withColumn("j", _cell("y", lv, base))
    reached = asked.join(around, at).filter(_gap("ox", "oy") <= F.col("_reach")).select("fid").distinct()
    return points.join(reached, "fid", "left_anti")


def dedup(points: DataFrame, factor: float = 0.3, floor_px: float = 48.0, keys: list[str] | None = None) -> DataFrame:
    """One point per cluster of points closer than ``max(min(sigma)*factor, floor)``.

    The highest score stays, the lowest fid on a tie. A pair's limit is the smaller
    of its two points' own limits, which fall into levels, doubling from the smallest
    on. All points of a cell whose diagonal is below the level are linked, so cells
    are the nodes, and a point is in one cell of every level up to its own. On its own
    level it asks each cell around for the nearest point with no smaller limit. One
    edge list holds all levels, and one component search ends it. Points at one place
    are linked, and the one with the largest limit asks for all.
    """
    keys = keys or []
    own = F.greatest(F.col("sigma").cast("double") * F.lit(float(factor)), F.lit(float(floor_px)))
    slim = points.select("fid", "score", F.col("x").cast("double"), F.col("y").cast("double"), *keys, own.alias("own"))
    # A limit of 0 links nobody.
    slim = materialize(slim.filter("own > 0 AND NOT isnan(own) AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"))
    base = _base(slim, "own")
    places = slim.groupBy(*keys, "x", "y").agg(F.max("own").alias("own")).withColumn("level", level_of(F.col("own"), base))
    places = materialize(places.withColumn("place", F.struct(*keys, "x", "y")))
    # At most one row for each exponent of a double.
    levels = sorted(v[0] for v in places.select("level").distinct().collect())
    if not levels:
        return points
    side = base * UNIT
    upto = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v <= F.col("level"))
    each = places.withColumn("lv", F.explode(upto)) if len(levels) > 1 else places.withColumn("lv", F.col("level"))
    unit = lambda c: _scaled(F.col(c), F.col("lv"))
    each = each.select("place", *keys, "lv", "level", unit("x").alias("x"), unit("y").alias("y"), unit("own").alias("weight"))
    each = each.withColumn("ci", cell_of(F.col("x"), side)).withColumn("cj", cell_of(F.col("y"), side))

    def span(v: str) -> Column:
        far = F.col("weight") * (1 + 1e-9)
        return F.explode(F.sequence(cell_of(F.col(v) - far, side), cell_of(F.col(v) + far, side)))

    def gap(v: str, cell: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(cell) * F.lit(side) - F.col(v), F.col(v) - (F.col(cell) + 1) * F.lit(side))

    asking = each.filter("lv = level").withColumn("i", span("x")).withColumn("j", span("y"))
    reached = F.sqrt(gap("x", "i") * gap("x", "i") + gap("y", "j") * gap("y", "j")) < F.col("weight") * (1 + 1e-9)
    # A point asks many cells, so each question is as narrow as it can be.
    queries = asking.filter(((F.col("i") != F.col("ci")) | (F.col("j") != F.col("cj"))) & reached).select(
        F.col("x").alias("qx"), F.col("y").alias("qy"), *keys, "lv", "i", "j", F.col("weight").alias("limit"))
    home = [cell_of(F.col(f"q{v}"), side).alias(f"c{c}") for v, c in (("x", "i"), ("y", "j"))]
    derived = dict(qid=F.struct(*keys, "lv", F.col("qx").alias("x"), F.col("qy").alias("y"), *home, "i", "j"), need=F.col("limit"))
    found = nearest_in_cells(
        queries, each.select(F.struct("x", "y").alias("rid"), "x", "y", "weight", *keys, "lv"), 2.0 * base * (1 + 1e-9), side, [*keys, "lv"], weighted=True, derived=derived)
    node = lambda *c: F.struct(*[F.col(f"qid.{k}").alias(k) for k in keys], F.col("qid.lv").alias("lv"), F.col(f"qid.{c[0]}").alias("ci"), F.col(f"qid.{c[1]}").alias("cj"))
    edges = found.select(node("ci", "cj").alias("src"), node("i", "j").alias("dst"))
    here = F.struct(*keys, "lv", "ci", "cj")
    if len(levels) > 1:
        # A point ties its cells of neighbouring levels together.
        below = F.lag(here).over(Window.partitionBy("place").orderBy("lv"))
        edges = edges.unionByName(each.select(here.alias("dst"), below.alias("src")).filter("src is not null").select("src", "dst"))
    comps = connected_components(edges)
    at_home = each.filter("lv = level").select("place", here.alias("node")).join(comps, "node", "left").select("place.*", F.coalesce("component", "node").alias("component"))
    labelled = slim.select("fid", "score", *keys, "x", "y").join(at_home, [*keys, "x", "y"]).select("fid", "score", "component")
    best = labelled.groupBy("component").agg(F.max(F.struct("score", (-F.col("fid")).alias("_o"))).alias("_b"))
    lost = labelled.select("fid").join(best.select((-F.col("_b._o")).alias("fid")), "fid", "left_anti")
    return points.join(lost, "fid", "left_anti")
