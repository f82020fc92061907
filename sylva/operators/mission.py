"""Flight missions for a table of survey blocks, all blocks in parallel.

A block row holds its own ring arrays, so lines, crossings, runs, directions
and failure texts are narrow expressions without a shuffle. Runs stay compact
(two ends each) until their order is known; only then are waypoints made.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.functions.geometry import (
    distance, high, let, low, pin, point_in_rings, rotate_ring, rotate_x, rotate_y, vertical_crossings,
)
from sylva.operators.edges import edges_of
from sylva.session import materialize, meet, spread

# Planner defaults and limits.
DEFAULTS = dict(altitude=100.0, gsd=5.0, img_w=4000, img_h=3000, front=80.0, side=70.0, direction=0.0, speed=8.0, minutes=20.0)
LEAST_SPACING_M = 0.5
MOST_OVERLAP_PCT = 95.0
EDGE_INSET_M = 2.0
TINY = 1e-6
MULTI_START_RUNS = 60
ANGLES = 180
TANGENT_REACH = 3


def _spacing(gsd: Column, pixels: Column, overlap: Column) -> Column:
    return F.greatest(F.lit(LEAST_SPACING_M), gsd / 100.0 * pixels * (1 - F.least(overlap, F.lit(MOST_OVERLAP_PCT)) / 100.0))


def spacing(blocks: DataFrame) -> DataFrame:
    """Adds ``line_spacing`` (across) and ``waypoint_spacing`` (along)."""
    return blocks.withColumn("line_spacing", _spacing(F.col("gsd"), F.col("img_w"), F.col("side"))).withColumn(
        "waypoint_spacing", _spacing(F.col("gsd"), F.col("img_h"), F.col("front")))


def _pivoted(blocks: DataFrame) -> DataFrame:
    """Adds the centre of the outer ring's bounding box; the outer ring is first."""
    outer = F.element_at("rings", 1)
    return pin(blocks, px=(low(outer, "x") + high(outer, "x")) / 2.0, py=(low(outer, "y") + high(outer, "y")) / 2.0)


def _local(blocks: DataFrame, degrees: Column) -> DataFrame:
    turned = F.transform("rings", lambda r: rotate_ring(r, F.col("px"), F.col("py"), -degrees))
    return pin(_pivoted(blocks), local=turned)


def _lined(blocks: DataFrame) -> DataFrame:
    """Blocks in their rotated frame, with ``_x0, _x1`` and the last line's number ``_n``, below 0 for one line in the middle."""
    pts = F.flatten("local")
    b = pin(_local(spacing(spread(blocks, "fid")), F.col("direction")), _x0=low(pts, "x"), _x1=high(pts, "x"))
    s = F.col("line_spacing")
    return b.withColumn("_n", F.floor((F.col("_x1") - F.col("_x0") - s / 2.0) / s).cast("int"))


def _line_x(k: Column) -> Column:
    s = F.col("line_spacing")
    return F.when(F.col("_n") >= 0, F.col("_x0") + s / 2.0 + k * s).otherwise((F.col("_x0") + F.col("_x1")) / 2.0)


def coverage_lines(blocks: DataFrame) -> DataFrame:
    """One row per flight line: ``line, x`` in the rotated frame."""
    lines = _lined(blocks).withColumn("line", F.explode(F.sequence(F.lit(0), F.greatest("_n", F.lit(0)))))
    return lines.select("fid", "px", "py", "direction", "line_spacing", "waypoint_spacing", "line", _line_x(F.col("line")).alias("x"))


def coverage_runs(blocks: DataFrame) -> DataFrame:
    """``fid, line, part, x, y0, y1, n``: inside stretches of the flight lines, with an inset from the edge.

    Every edge goes to the lines it crosses and no ring to any; a line's crossings
    are put in order there, and pairs of them are inside."""
    kept = ["fid", "px", "py", "direction", "waypoint_spacing"]
    edges = edges_of(_lined(blocks).select(*kept, "line_spacing", "_x0", "_x1", "_n", "local"), "local")
    number = lambda x: F.floor((x - F.col("_x0")) / F.col("line_spacing") - 0.5)
    first, last = number(F.least("ax", "bx")), number(F.greatest("ax", "bx")) + 1
    most = F.greatest("_n", F.lit(0))
    among = F.sequence(*[F.greatest(F.lit(0), F.least(k, most)).cast("int") for k in (first, last)])
    on = edges.withColumn("line", F.explode(among)).withColumn("x", _line_x(F.col("line")))
    met = on.filter((F.col("ax") > F.col("x")) != (F.col("bx") > F.col("x"))).select(
        *kept, "line", "x", ((F.col("by") - F.col("ay")) * (F.col("x") - F.col("ax")) / (F.col("bx") - F.col("ax")) + F.col("ay")).alias("_lo"))
    lane = Window.partitionBy("fid", "line").orderBy("_lo")
    paired = met.withColumn("_k", F.row_number().over(lane) - 1).withColumn("_hi", F.lead("_lo").over(lane))
    spans = paired.filter((F.col("_k") % 2 == 0) & F.col("_hi").isNotNull()).withColumn("part", F.floor(F.col("_k") / 2).cast("int")).drop("_k")
    spans = spans.withColumn("_span", F.col("_hi") - F.col("_lo")).filter(F.col("_span") >= TINY)
    inset = F.least(F.lit(EDGE_INSET_M), F.col("_span") / 2.0 - TINY)
    ends = spans.withColumn("_a", F.col("_lo") + inset).withColumn("_b", F.col("_hi") - inset)
    meet = F.col("_b") - F.col("_a") < TINY
    middle = (F.col("_lo") + F.col("_hi")) / 2.0
    runs = ends.withColumn("y0", F.when(meet, middle).otherwise(F.col("_a"))).withColumn("y1", F.when(meet, middle).otherwise(F.col("_b")))
    inner = F.greatest(F.lit(0), F.ceil((F.col("y1") - TINY - F.col("y0")) / F.col("waypoint_spacing")) - 1)
    return runs.withColumn("n", (inner + 2).cast("int")).select(
        "fid", "line", "part", "x", "y0", "y1", "n", "px", "py", "direction", "waypoint_spacing")


def _inside(px: np.ndarray, py: np.ndarray, rings: list) -> np.ndarray:
    """Even-odd test of many points against rings of corners; a corner is two numbers, or two columns of one for each block."""
    odd = np.zeros(px.shape, dtype=bool)
    for ring in rings:
        for k, (xi, yi) in enumerate(ring):
            xj, yj = ring[k - 1]
            # A level edge is met by no point: its other corner is as good as any.
            rise = np.where(yi == yj, 1.0, yj - yi)
            odd ^= ((yi > py) != (yj > py)) & (px < (xj - xi) * (py - yi) / rise + xi)
    return odd


def _tours(first: np.ndarray, last: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest-next-end walks, one per start run and direction, side by side.

    Returns run order and direction, each (2 * starts, runs)."""
    n = len(first)
    walk = np.empty((2 * starts, n), dtype=np.int64)
    back = np.zeros((2 * starts, n), dtype=bool)
    walk[:, 0] = np.repeat(np.arange(starts), 2)
    back[1::2, 0] = True
    todo = np.ones((2 * starts, n), dtype=bool)
    rows = np.arange(2 * starts)
    todo[rows, walk[:, 0]] = False
    for step in range(1, n):
        at, rev = walk[:, step - 1], back[:, step - 1]
        here = np.where(rev[:, None], first[at], last[at])
        d0 = ((first[None, :, :] - here[:, None, :]) ** 2).sum(axis=2)
        d1 = ((last[None, :, :] - here[:, None, :]) ** 2).sum(axis=2)
        gap = np.where(todo, np.minimum(d0, d1), np.inf)
        pick = gap.argmin(axis=1)
        walk[:, step] = pick
        back[:, step] = d1[rows, pick] < d0[rows, pick]
        todo[rows, pick] = False
    return walk, back


class _OpenEnds:
    """Run ends in square cells, for the nearest one that is still open.

    Cells hold about two ends each; once three quarters are taken the rest is dealt
    into larger cells, so a search looks at few cells from first to last and memory
    is linear in the runs."""

    def __init__(self, first: np.ndarray, last: np.ndarray):
        self.first, self.last = first, last
        self.open = np.ones(len(first), dtype=bool)
        self._deal()

    def _deal(self) -> None:
        runs = np.flatnonzero(self.open)
        self.left = self.dealt = len(runs)
        xy = np.concatenate((self.first[runs], self.last[runs])) if len(runs) else np.zeros((1, 2))
        self.low = xy.min(axis=0)
        wide = xy.max(axis=0) - self.low
        # Ends on one line have no area: then the length decides.
        self.side = max(float(np.sqrt(wide[0] * wide[1] / max(1, len(runs)))), float(wide.max()) / max(1, len(runs)), 1e-9)
        self.most = int(wide.max() / self.side) + 2
        at = np.floor((xy - self.low) / self.side).astype(int)
        order = np.lexsort((at[:, 1], at[:, 0]))
        starts = np.flatnonzero(np.concatenate(([True], (at[order][1:] != at[order][:-1]).any(axis=1))))
        owners = np.tile(runs, 2)[order] if len(runs) else np.zeros(0, dtype=int)
        self.cells = {tuple(at[order[k]].tolist()): held for k, held in zip(starts.tolist(), np.split(owners, starts[1:]), strict=True)}

    def take(self, run: int) -> None:
        self.open[run] = False
        self.left -= 1
        if self.left and self.left * 4 < self.dealt:
            self._deal()

    def nearest(self, here: np.ndarray) -> tuple[int, bool]:
        """(run, its last end is the nearer one); equal distances go to the lower run."""
        i, j = np.floor((here - self.low) / self.side).astype(int).tolist()
        # Cells on which the search comes in from outside are skipped at once.
        reach = max(0, -i, -j, i - self.most, j - self.most)
        best, k = (math.inf, -1, False), reach
        while True:
            ring = [(i + a, j + b) for a in range(-k, k + 1) for b in ((-k, k) if abs(a) < k else range(-k, k + 1))] if k else [(i, j)]
            for cell in ring:
                held = self.cells.get(cell)
                if held is None:
                    continue
                held = self.cells[cell] = held[self.open[held]]
                if not len(held):
                    del self.cells[cell]
                    continue
                d0 = ((self.first[held] - here) ** 2).sum(axis=1)
                d1 = ((self.last[held] - here) ** 2).sum(axis=1)
                gap = np.minimum(d0, d1)
                at = np.lexsort((held, gap))[0] if len(held) > 1 else 0
                best = min(best, (float(gap[at]), int(held[at]), bool(d1[at] < d0[at])))
            # All that isn't looked at yet is farther than k cells.
            if best[1] >= 0 and best[0] < (k * self.side) ** 2:
                return best[1], best[2]
            if k > reach + 2 * self.most + 2:
                return best[1], best[2]
            k += 1


def _long_tours(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_tours`` from the first run only, both directions, with ends in cells."""
    n = len(first)
    walk, back = np.zeros((2, n), dtype=np.int64), np.zeros((2, n), dtype=bool)
    back[1, 0] = True
    for w in range(2):
        ends = _OpenEnds(first, last)
        ends.take(0)
        for step in range(1, n):
            at = walk[w, step - 1]
            run, rev = ends.nearest(first[at] if back[w, step - 1] else last[at])
            walk[w, step], back[w, step] = run, rev
            ends.take(run)
    return walk, back


def _walks_and_scores(first: np.ndarray, last: np.ndarray, rings: np.ndarray, lengths: tuple, multi_start: int) -> tuple[np.ndarray, ...]:
    """Walks of blocks with equally many runs and ring corners, all blocks side by side.

    ``first, last``: (blocks, runs, 2); ``rings``: (blocks, corners, 2). Returns walk and
    direction, (blocks, walks, runs), legs outside and the longest leg, (blocks, walks)."""
    blocks, n = first.shape[:2]
    at = np.arange(blocks)[:, None]
    if n > multi_start:
        walk, back = (np.stack(v) for v in zip(*[_long_tours(first[b], last[b]) for b in range(blocks)], strict=True))
    else:
        walk, back = _tours_of(first, last)
    block = at[:, :, None]
    leave = np.where(back[:, :, :-1, None], first[block, walk[:, :, :-1]], last[block, walk[:, :, :-1]])
    enter = np.where(back[:, :, 1:, None], last[block, walk[:, :, 1:]], first[block, walk[:, :, 1:]])
    mid = (leave + enter) / 2.0
    cut = np.cumsum(lengths)
    corners = [rings[:, e - k:e] for k, e in zip(lengths, cut, strict=True)]
    sides = [[tuple(r[:, k, c][:, None, None] for c in (0, 1)) for k in range(r.shape[1])] for r in corners]
    off = (~_inside(mid[..., 0], mid[..., 1], sides)).sum(axis=2)
    legs = np.sqrt(((enter - leave) ** 2).sum(axis=3))
    return walk, back, off, legs.max(axis=2, initial=0.0)


def _tours_of(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_tours`` of many blocks from every run of each: (blocks, 2 * runs, runs).

    The way from each end to each other is measured once; a step picks from it."""
    blocks, n = first.shape[:2]
    ends = np.stack((first, last), axis=2).reshape(blocks, 2 * n, 2)
    d0 = ((first[:, None, :, :] - ends[:, :, None, :]) ** 2).sum(axis=3)
    d1 = ((last[:, None, :, :] - ends[:, :, None, :]) ** 2).sum(axis=3)
    least = np.minimum(d0, d1)
    walk = np.empty((blocks, 2 * n, n), dtype=np.int64)
    back = np.zeros((blocks, 2 * n, n), dtype=bool)
    walk[:, :, 0] = np.repeat(np.arange(n), 2)
    back[:, 1::2, 0] = True
    todo = np.ones((blocks, 2 * n, n), dtype=bool)
    at, rows = np.arange(blocks)[:, None], np.arange(2 * n)[None, :]
    todo[at, rows, walk[:, :, 0]] = False
    for step in range(1, n):
        here = 2 * walk[:, :, step - 1] + ~back[:, :, step - 1]
        pick = np.where(todo, least[at, here], np.inf).argmin(axis=2)
        walk[:, :, step] = pick
        back[:, :, step] = d1[at, here, pick] < d0[at, here, pick]
        todo[at, rows, pick] = False
    return walk, back


_TOUR = T.StructType().add("walk", T.ArrayType(T.IntegerType())).add("back", T.ArrayType(T.BooleanType())).add("off", T.LongType())
#: Distances from run end to run end that are held at once.
HELD = 1 << 20


def _best_walks(multi_start: int, ax, ay, bx, by, off_legs, longest, ring_x, ring_y, ring_n) -> pd.DataFrame:
    """Best walk over the runs of each block; one row is one block."""
    out: list = [None] * len(ax)
    alike: dict[tuple, list[int]] = {}
    for k, (xs, rn) in enumerate(zip(ax, ring_n, strict=True)):
        alike.setdefault((len(xs), tuple(int(v) for v in rn)), []).append(k)
    pairs = lambda x, y, some: np.stack((np.stack([x.iat[k] for k in some]), np.stack([y.iat[k] for k in some])), axis=2).astype(float)
    for (n, lengths), members in alike.items():
        size = max(1, HELD // (2 * n * n)) if n <= multi_start else 1
        for at in range(0, len(members), size):
            some = members[at:at + size]
            walk, back, off, legs = _walks_and_scores(pairs(ax, ay, some), pairs(bx, by, some), pairs(ring_x, ring_y, some), lengths, multi_start)
            off = off + np.array([int(np.sum(off_legs.iat[k])) for k in some])[:, None]
            score = np.maximum(legs, np.array([np.max(longest.iat[k]) for k in some])[:, None])
            best = np.lexsort((np.broadcast_to(np.arange(off.shape[1]), off.shape), score, off), axis=-1)[:, 0]
            for b, k in enumerate(some):
                out[k] = (walk[b, best[b]].astype("int32"), back[b, best[b]], int(off[b, best[b]]))
    return pd.DataFrame(out, columns=["walk", "back", "off"])


def order_runs(runs: DataFrame, areas: DataFrame, multi_start: int = MULTI_START_RUNS) -> DataFrame:
    """Flight order of the runs of each block: adds ``pos, reversed`` and per block
    ``off_polygon_legs``.

    ``runs``: ``fid, run_id, ax, ay, bx, by, off_legs, longest`` and anything
    else: two ends, legs inside the run that leave the area, longest leg inside.
    ``areas``: ``fid, rings`` in the same frame. In blocks of up to
    ``multi_start`` runs every run and direction is tried as the start, in larger
    ones only the first run: a rule of the plan, not of its execution. The fewest
    legs outside wins, then the shortest longest leg, then the earliest start.
    A block travels as one row of run ends, never with its waypoints; above
    ``multi_start`` runs the nearest open end is found in cells, so work and memory
    are about linear in the runs."""
    carried = ["run_id"] + [c for c in runs.columns if c not in ("fid", "run_id")]
    rows = runs.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct(*carried))).alias("_runs"))
    @F.pandas_udf(_TOUR)
    def _tour(
        ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, off: pd.Series, most: pd.Series, rx: pd.Series, ry: pd.Series, rn: pd.Series,
    ) -> pd.DataFrame:
        return _best_walks(multi_start, ax, ay, bx, by, off, most, rx, ry, rn)

    flat = F.flatten("rings")
    shapes = areas.select(
        "fid", F.transform(flat, lambda p: p["x"]).alias("_rx"), F.transform(flat, lambda p: p["y"]).alias("_ry"),
        F.transform("rings", lambda r: F.size(r)).alias("_rn"))
    ends = [F.col("_runs")[c] for c in ("ax", "ay", "bx", "by", "off_legs", "longest")]
    toured = meet(rows, shapes, "fid", unique=True).withColumn("_t", _tour(*ends, "_rx", "_ry", "_rn")).drop("_rx", "_ry", "_rn")
    steps = toured.select("fid", "_runs", F.col("_t.off").alias("off_polygon_legs"), F.posexplode(F.arrays_zip("_t.walk", "_t.back")).alias("pos", "_s"))
    return steps.select("fid", F.element_at("_runs", F.col("_s.walk") + 1).alias("_r"), "pos", F.col("_s.back").alias("reversed"), "off_polygon_legs").select(
        "fid", "_r.*", "pos", "reversed", "off_polygon_legs")


def _in_flight_order(ordered: DataFrame) -> DataFrame:
    """Adds the number of waypoints flown before each run of its block."""
    before = Window.partitionBy("fid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return ordered.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def coverage_points(blocks: DataFrame, multi_start: int = MULTI_START_RUNS) -> DataFrame:
    """``fid, seq, x, y, off_polygon_legs``: the whole flight of each block in order."""
    runs = coverage_runs(blocks).withColumn("run_id", F.col("line").cast("long") * (1 << 20) + F.col("part"))
    m = F.col("n") - 2
    longest = F.when(m > 0, F.col("waypoint_spacing")).otherwise(F.col("y1") - F.col("y0"))
    ends = runs.withColumn("ax", F.col("x")).withColumn("ay", F.col("y0")).withColumn("bx", F.col("x")).withColumn("by", F.col("y1"))
    ends = ends.withColumn("off_legs", F.lit(0)).withColumn("longest", longest)
    local = _local(blocks, F.col("direction")).select("fid", F.col("local").alias("rings"))
    flown = _in_flight_order(order_runs(ends, local, multi_start))
    pts = flown.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    along = F.when(F.col("reversed"), F.col("n") - 1 - F.col("_k")).otherwise(F.col("_k"))
    y = F.when(along == F.col("n") - 1, F.col("y1")).otherwise(F.col("y0") + along * F.col("waypoint_spacing"))
    placed = pts.withColumn("_y", y)
    return placed.select(
        "fid", (F.col("_before") + F.col("_k")).cast("long").alias("seq"),
        rotate_x(F.col("x"), F.col("_y"), F.col("px"), F.col("py"), F.col("direction")).alias("x"),
        rotate_y(F.col("x"), F.col("_y"), F.col("px"), F.col("py"), F.col("direction")).alias("y"), "off_polygon_legs")


CHUNK = 4096


def _with_leg(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds ``_chunk`` and ``leg``, the distance from the waypoint before.

    The last waypoint of a chunk also opens the next one, so a window never
    spans more than a chunk, however long a plan is."""
    here = F.floor(F.col("seq") / chunk)
    carry = F.col("seq") % chunk == chunk - 1
    twice = points.withColumn("_chunk", F.explode(F.when(carry, F.array(here, here + 1)).otherwise(F.array(here))))
    lane = Window.partitionBy("fid", "_chunk").orderBy("seq")
    leg = distance(F.lag("x").over(lane), F.lag("y").over(lane), F.col("x"), F.col("y"))
    return twice.withColumn("leg", F.coalesce(leg, F.lit(0.0))).filter(F.floor(F.col("seq") / chunk) == F.col("_chunk"))


def timed(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds ``t``: seconds flown since the plan's first waypoint, and ``leg``.

    ``points``: ``fid, seq, x, y, speed``. Sums inside chunks are shifted by the
    totals of the chunks before: one row per chunk is all a plan brings together.
    Negative ``minutes``, where there are any, fail the job."""
    if "minutes" in points.columns:
        wrong = F.raise_error(F.lit("minutes must not be negative")).cast("double")
        points = points.withColumn("minutes", F.when(F.col("minutes") < 0, wrong).otherwise(F.col("minutes")))
    seconds = F.when(F.col("speed") > 0, F.col("leg") / F.col("speed")).otherwise(0.0)
    legs = materialize(_with_leg(points, chunk).withColumn("_s", seconds))
    lane = Window.partitionBy("fid", "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    part = legs.withColumn("_in", F.sum("_s").over(lane))
    before = Window.partitionBy("fid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = legs.groupBy("fid", "_chunk").agg(F.sum("_s").alias("_sum")).withColumn(
        "_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    return meet(part, base.select("fid", "_chunk", "_base"), ["fid", "_chunk"], unique=True).withColumn(
        "t", F.col("_base") + F.col("_in")).drop("_base", "_in", "_s")


def budget_cuts(flown: DataFrame) -> DataFrame:
    """``fid, cut``: waypoints where a new part starts, for ``timed`` waypoints.

    Where a part that starts at any waypoint would end is found for all
    waypoints at once, in buckets of one budget; the cuts really made are then
    reached from waypoint 0 by doubling, so rounds grow with the logarithm of
    the number of parts. Without minutes every leg that takes time is cut;
    without speed nothing is."""
    given = flown.filter(F.col("speed") > 0)
    at_once = given.filter((F.col("minutes") == 0) & (F.col("leg") > 0)).select("fid", F.col("seq").alias("cut"))
    flown = given.filter(F.col("minutes") > 0)
    return _cuts_by_doubling(flown).unionByName(at_once)


def _cuts_by_doubling(flown: DataFrame) -> DataFrame:
    budget = F.col("minutes") * 60.0
    ways = flown.select("fid", "seq", "t", budget.alias("b"))
    asked = ways.select("fid", F.lit(None).cast("long").alias("i"), F.col("seq").alias("s"), (F.col("t") + F.col("b")).alias("at"), "b", F.lit(0).alias("kind"))
    given = ways.select("fid", F.col("seq").alias("i"), F.lit(None).cast("long").alias("s"), F.col("t").alias("at"), "b", F.lit(1).alias("kind"))
    bucket = F.floor(F.col("at") / F.col("b"))
    late_first = Window.partitionBy("fid", "bucket").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = given.unionByName(asked).withColumn("bucket", bucket)
    inside = both.withColumn("_n", F.min("i").over(late_first)).filter("kind = 0").select("fid", "s", "bucket", "_n")
    firsts = given.withColumn("bucket", bucket).groupBy("fid", "bucket").agg(F.min("i").alias("_f"))
    # Behind an empty bucket the next waypoint is the first of the next bucket in use.
    slots = inside.select("fid", "bucket").distinct().join(firsts, ["fid", "bucket"], "full_outer")
    later = Window.partitionBy("fid").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_next", F.min("_f").over(later)).select("fid", "bucket", "_next")
    jump = materialize(
        meet(inside, slots, ["fid", "bucket"], unique=True).select("fid", "s", F.coalesce("_n", "_next").alias("n")).filter("n is not null"))
    reached = materialize(ways.select("fid").distinct().withColumn("s", F.lit(0).cast("long")))
    size = reached.count()
    while True:
        further = meet(reached, jump, ["fid", "s"]).select("fid", F.col("n").alias("s"))
        reached = materialize(reached.unionByName(further).distinct())
        after = reached.count()
        if after == size:
            return reached.filter("s > 0").select("fid", F.col("s").alias("cut"))
        size = after
        jump = materialize(meet(jump, jump.select("fid", F.col("s").alias("n"), F.col("n").alias("_n2")), ["fid", "n"], unique=True).select("fid", "s", F.col("_n2").alias("n")))


def split_by_budget(points: DataFrame) -> DataFrame:
    """``fid, part, sequence, seq, x, y``: battery-sized parts with shared seams.

    ``points``: ``fid, seq (dense from 0), x, y, speed, minutes``. The cut
    waypoint closes one part and opens the next; its leg counts for neither."""
    flown = materialize(timed(points.select("fid", "seq", "x", "y", "speed", "minutes")))
    return place_parts(flown, materialize(budget_cuts(flown)))


def place_parts(flown: DataFrame, numbered: DataFrame) -> DataFrame:
    """Waypoints of all parts from timed waypoints and their cuts."""
    # Parts as intervals of seq, then per chunk the part it opens with.
    lane = Window.partitionBy("fid").orderBy("cut")
    starts = numbered.withColumn("_p", (F.row_number().over(lane) + 1).cast("int")).withColumn(
        "_prev", F.coalesce(F.lag("cut").over(lane), F.lit(0).cast("long")))
    chunks = flown.groupBy("fid", "_chunk").agg(F.min("seq").alias("_at"))
    marks = chunks.select("fid", "_at", "_chunk", F.lit(None).cast("int").alias("_p"), F.lit(None).cast("long").alias("_c")).unionByName(
        starts.select("fid", F.col("cut").alias("_at"), F.lit(None).cast("long").alias("_chunk"), "_p", F.col("cut").alias("_c")))
    upto = Window.partitionBy("fid").orderBy("_at", F.col("_chunk").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    opens = marks.withColumn("_p0", F.coalesce(F.max("_p").over(upto), F.lit(1))).withColumn(
        "_c0", F.coalesce(F.max("_c").over(upto), F.lit(0).cast("long"))).filter("_chunk is not null").select("fid", "_chunk", "_p0", "_c0")
    marked = flown.join(starts.select("fid", F.col("cut").alias("seq"), "_p", "_prev"), ["fid", "seq"], "left").join(opens, ["fid", "_chunk"])
    inside = Window.partitionBy("fid", "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("part", F.coalesce(F.max("_p").over(inside), F.col("_p0"))).withColumn(
        "_start", F.coalesce(F.max(F.when(F.col("_p").isNotNull(), F.col("seq"))).over(inside), F.col("_c0")))
    opened = placed.withColumn("sequence", (F.col("seq") - F.col("_start")).cast("int"))
    closing = placed.filter("_p is not null").withColumn("part", F.col("_p") - 1).withColumn(
        "sequence", (F.col("seq") - F.col("_prev")).cast("int"))
    cols = ["fid", "part", "sequence", "seq", "x", "y"]
    return opened.select(*cols).unionByName(closing.select(*cols))


def plan_totals(points: DataFrame) -> DataFrame:
    """``fid, total_distance_m, total_minutes``; without speed no time passes."""
    total = F.coalesce(F.sum("leg"), F.lit(0.0))
    return _with_leg(points).groupBy("fid").agg(
        total.alias("total_distance_m"),
        F.when(F.max("speed") > 0, total / F.max("speed") / 60.0).otherwise(0.0).alias("total_minutes"))


def cross_hatch(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two passes as one plan; the second pass's parts are numbered on."""
    offset = first.groupBy("fid").agg(F.max("part").alias("_o"))
    moved = second.join(offset, "fid", "left").withColumn("part", (F.col("part") + F.coalesce("_o", F.lit(0))).cast("int")).drop("_o")
    return first.unionByName(moved)


def suggest_direction(blocks: DataFrame) -> DataFrame:
    """Whole degree with the least width across, and line counts there and at the
    present direction. A narrow projection: each block row tries its own angles."""
    b = _pivoted(spacing(spread(blocks, "fid")))
    b = pin(b, _outer=F.transform(F.element_at("rings", 1), lambda p: F.struct((p["x"] - F.col("px")).alias("x"), (p["y"] - F.col("py")).alias("y"))))

    def width(deg: Column) -> Column:
        rad = -deg * F.pi() / 180.0
        turned = let(F.struct(F.cos(rad).alias("c"), F.sin(rad).alias("s")), lambda t: F.transform("_outer", lambda p: F.col("px") + p["x"] * t["c"] - p["y"] * t["s"]))
        return let(turned, lambda xs: F.array_max(xs) - F.array_min(xs))

    tries = F.transform(F.sequence(F.lit(0), F.lit(ANGLES - 1)), lambda d: F.struct(width(d.cast("double")).alias("width"), d.alias("deg")))
    best = pin(b, _b=F.array_min(tries))
    lines = lambda w: F.greatest(F.lit(1), F.ceil(w / F.col("line_spacing")).cast("int"))
    current = ((F.col("direction") % 180) + 180) % 180
    return best.select(
        "fid", F.col("_b.deg").alias("best_degrees"), F.lit(ANGLES).alias("angles_tested"),
        lines(F.col("_b.width")).alias("lines_at_best"), lines(width(current)).alias("lines_at_current"))


def coverage_failure(blocks: DataFrame) -> DataFrame:
    """Why a block has no waypoint: ``fid, width, height, line_spacing,
    waypoint_spacing, too_small, cause``, sizes along the flight direction."""
    b = pin(_pivoted(spacing(blocks)), _o=rotate_ring(F.element_at("rings", 1), F.col("px"), F.col("py"), -F.col("direction")))
    b = pin(b, width=high(F.col("_o"), "x") - low(F.col("_o"), "x"), height=high(F.col("_o"), "y") - low(F.col("_o"), "y"))
    small = (F.col("width") < F.col("line_spacing")) | (F.col("height") < F.col("waypoint_spacing"))
    return b.select(
        "fid", "width", "height", "line_spacing", "waypoint_spacing", small.alias("too_small"),
        F.when(small, "smaller than the spacing").otherwise("no sampled point inside").alias("cause"))


# ---- corridors ---------------------------------------------------------------

def resample_line(lines: DataFrame, step: float | Column) -> DataFrame:
    """``fid, k, x, y``: points at 0, step, 2 step ... along ``fid, path``.

    Each segment makes its own points, so a long line costs its length."""
    step_col = F.lit(float(step)) if isinstance(step, (int, float)) else step
    segs = lines.filter(F.size("path") >= 2).select(
        "fid", step_col.alias("step"),
        F.posexplode(F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("seg", "_e"))
    segs = segs.withColumn("_len", distance(F.col("_e.a.x"), F.col("_e.a.y"), F.col("_e.b.x"), F.col("_e.b.y")))
    order = Window.partitionBy("fid").orderBy("seg")
    segs = segs.withColumn("_acc", F.coalesce(F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    segs = segs.withColumn("_total", F.sum("_len").over(Window.partitionBy("fid"))).filter(F.col("_total") >= TINY)
    first = F.when(F.col("seg") == 0, F.lit(0).cast("long")).otherwise(F.floor(F.col("_acc") / F.col("step")) + 1)
    last = F.floor((F.col("_acc") + F.col("_len")) / F.col("step"))
    made = segs.withColumn("_a", first).withColumn("_b", last).filter("_a <= _b").withColumn("k", F.explode(F.sequence("_a", "_b")))
    t = F.when(F.col("_len") > TINY, (F.col("k") * F.col("step") - F.col("_acc")) / F.col("_len")).otherwise(0.0)
    mix = lambda a: F.col(f"_e.a.{a}") + (F.col(f"_e.b.{a}") - F.col(f"_e.a.{a}")) * t
    return made.select("fid", F.col("k").cast("int").alias("k"), mix("x").alias("x"), mix("y").alias("y"))


def smooth_tangent(points: DataFrame, reach: int = TANGENT_REACH) -> DataFrame:
    """Adds the unit vector ``dx, dy`` from ``reach`` points behind to ``reach`` ahead."""
    # Points near a chunk border also go to the chunk beyond it.
    here, place = F.floor(F.col("k") / CHUNK), F.col("k") % CHUNK
    beside = F.array_compact(F.array(here, F.when(place < reach, here - 1), F.when(place >= CHUNK - reach, here + 1)))
    points = points.withColumn("_chunk", F.explode(beside))
    around = Window.partitionBy("fid", "_chunk").orderBy("k").rowsBetween(-reach, reach)
    ddx = F.last("x").over(around) - F.first("x").over(around)
    ddy = F.last("y").over(around) - F.first("y").over(around)
    vec = points.withColumn("_dx", ddx).withColumn("_dy", ddy).withColumn("_l", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
    ok = F.col("_l") > TINY
    return vec.withColumn("dx", F.when(ok, F.col("_dx") / F.col("_l")).otherwise(1.0)).withColumn(
        "dy", F.when(ok, F.col("_dy") / F.col("_l")).otherwise(0.0)).filter(here == F.col("_chunk")).drop("_dx", "_dy", "_l", "_chunk")


def runs(df: DataFrame, inside: Column, by: list[str], order: str) -> DataFrame:
    """Rows inside, with ``run``: the number of the consecutive stretch they are in."""
    lane = Window.partitionBy(*by).orderBy(order)
    flagged = df.withColumn("_in", F.coalesce(inside, F.lit(False)))
    starts = (F.col("_in") & ~F.coalesce(F.lag("_in").over(lane), F.lit(False))).cast("int")
    return flagged.withColumn("_st", starts).withColumn("run", F.sum("_st").over(lane)).filter("_in").drop("_in", "_st")


def corridor_lanes(blocks: DataFrame) -> DataFrame:
    """``fid, lane, k, run, x, y``: offset lanes of each centre line inside its rings.

    ``blocks`` carry ``path`` and ``rings``. Lanes go outward in pairs until the
    first pair that is empty on both sides; lanes after it are not flown. The
    ring's bounding box tells how far any lane could be inside."""
    b = spacing(blocks)
    pts = F.flatten("rings")
    diagonal = distance(low(pts, "x"), low(pts, "y"), high(pts, "x"), high(pts, "y"))
    reach = F.ceil(diagonal / F.col("line_spacing")).cast("int") + 1
    box = dict(_xa=low(pts, "x"), _xb=high(pts, "x"), _ya=low(pts, "y"), _yb=high(pts, "y"))
    wide = pin(b, _reach=reach, **box).select("fid", "rings", "line_spacing", "_reach", *box)
    centre = smooth_tangent(resample_line(b.select("fid", "path", "waypoint_spacing"), F.col("waypoint_spacing")))
    # Lanes whose point could be in the box, one more on both sides; the box itself decides below.
    among = pin(meet(centre, wide, "fid", unique=True), **_lanes_in_box()).filter("_first <= _last")
    lanes = spread(among, "fid", "k").withColumn("lane", F.explode(F.sequence("_first", "_last")))
    off = F.col("lane") * F.col("line_spacing")
    in_box = F.col("_px").between(F.col("_xa"), F.col("_xb")) & F.col("_py").between(F.col("_ya"), F.col("_yb"))
    inside = materialize(
        pin(lanes, _px=F.col("x") - F.col("dy") * off, _py=F.col("y") + F.col("dx") * off)
        .filter(in_box).filter(point_in_rings(F.col("_px"), F.col("_py"), F.col("rings")))
        .select("fid", "lane", "k", F.col("_px").alias("x"), F.col("_py").alias("y"), F.abs("lane").alias("_l"))
    )
    used = inside.filter("_l > 0").groupBy("fid", "_l").count()
    # Lane pairs 1..m are flown when all of them are used: the rank equals the lane.
    rank = F.row_number().over(Window.partitionBy("fid").orderBy("_l"))
    flown = used.withColumn("_r", rank).filter(F.col("_r") == F.col("_l")).select("fid", "_l", F.lit(True).alias("_flown"))
    # Points outside are gone, so a stretch ends where k skips a number. One exchange serves lanes and the join.
    along = Window.partitionBy("fid", "_l", "lane").orderBy("k")
    starts = F.coalesce((F.lag("k").over(along) != F.col("k") - 1).cast("int"), F.lit(1))
    rows = meet(spread(inside, "fid", "_l"), flown, ["fid", "_l"], "left", unique=True).filter("_l = 0 OR _flown")
    return rows.withColumn("_st", starts).withColumn("run", F.sum("_st").over(along)).select("fid", "lane", "k", "x", "y", "run")


def _lanes_in_box() -> dict[str, Column]:
    """The first and the last lane that can have a centre line's point moved into the box ``_xa.._xb, _ya.._yb``."""
    bounds = []
    for v, way, low_, high_ in (("x", -F.col("dy"), "_xa", "_xb"), ("y", F.col("dx"), "_ya", "_yb")):
        move = way * F.col("line_spacing")
        one, two = ((F.col(c) - F.col(v)) / F.nullif(move, F.lit(0.0)) for c in (low_, high_))
        # A way that doesn't move this coordinate leaves all lanes or none.
        stays = F.col(v).between(F.col(low_), F.col(high_))
        bounds.append((F.when(move != 0, F.least(one, two)).when(stays, -F.col("_reach")).otherwise(F.col("_reach") + 2.0),
                       F.when(move != 0, F.greatest(one, two)).when(stays, F.col("_reach")).otherwise(-F.col("_reach") - 2.0)))
    first, last = F.greatest(bounds[0][0], bounds[1][0]), F.least(bounds[0][1], bounds[1][1])
    within = lambda lane: F.greatest(-F.col("_reach") - 2.0, F.least(F.col("_reach") + 2.0, lane))
    return dict(_first=F.greatest(-F.col("_reach"), (F.floor(within(first)) - 1).cast("int")), _last=F.least(F.col("_reach"), (F.ceil(within(last)) + 1).cast("int")))


def corridor_points(blocks: DataFrame, multi_start: int = MULTI_START_RUNS) -> DataFrame:
    """The whole corridor flight of each block in order: ``fid, seq, x, y``."""
    lanes = materialize(corridor_lanes(blocks))
    rings = blocks.select("fid", "rings")
    # Lane order of the search: 0, +1, -1, +2, -2, ... then along the lane.
    turn = F.when(F.col("lane") > 0, 2 * F.col("lane") - 1).otherwise(-2 * F.col("lane"))
    keyed = lanes.withColumn("run_id", turn.cast("long") * (1 << 32) + F.col("run"))
    lane = Window.partitionBy("fid", "run_id").orderBy("k")
    legs = meet(keyed, rings, "fid", unique=True).withColumn("_nx", F.lead("x").over(lane)).withColumn("_ny", F.lead("y").over(lane))
    outside = ~point_in_rings((F.col("x") + F.col("_nx")) / 2.0, (F.col("y") + F.col("_ny")) / 2.0, F.col("rings"))
    legs = legs.withColumn("_off", F.when(F.col("_nx").isNotNull(), outside.cast("int")).otherwise(0)).withColumn(
        "_leg", F.coalesce(distance(F.col("x"), F.col("y"), F.col("_nx"), F.col("_ny")), F.lit(0.0)))
    ends = legs.groupBy("fid", "run_id").agg(
        F.min_by("x", "k").alias("ax"), F.min_by("y", "k").alias("ay"), F.max_by("x", "k").alias("bx"), F.max_by("y", "k").alias("by"),
        F.sum("_off").alias("off_legs"), F.max("_leg").alias("longest"), F.count("*").alias("n"), F.min("k").alias("_k0"))
    flown = _in_flight_order(order_runs(spread(ends, "fid"), rings, multi_start))
    placed = flown.select("fid", "run_id", "n", "_k0", "reversed", "_before", "off_polygon_legs")
    pts = meet(keyed.select("fid", "run_id", "k", "x", "y"), placed, ["fid", "run_id"], unique=True)
    step = F.col("k") - F.col("_k0")
    at = F.when(F.col("reversed"), F.col("n") - 1 - step).otherwise(step)
    return pts.select("fid", (F.col("_before") + at).cast("long").alias("seq"), "x", "y", "off_polygon_legs")


# ---- layers ------------------------------------------------------------------

def counts_by_part(waypoints: DataFrame) -> DataFrame:
    """Waypoints, metres and minutes per mission part (``speed`` on the rows)."""
    lane = Window.partitionBy("fid", "part").orderBy("sequence")
    leg = distance(F.lag("x").over(lane), F.lag("y").over(lane), F.col("x"), F.col("y"))
    metres = F.coalesce(F.sum("_leg"), F.lit(0.0))
    return waypoints.withColumn("_leg", leg).groupBy("fid", "part").agg(
        F.count("*").alias("waypoints"), metres.alias("distance_m"),
        F.when(F.max("speed") > 0, metres / F.max("speed") / 60.0).otherwise(0.0).alias("minutes"))


def path_lines(waypoints: DataFrame) -> DataFrame:
    """One polyline per part in flight order; a part is one battery, so bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("sequence", "x", "y")))
    return waypoints.groupBy("fid", "part").agg(ordered.alias("_p")).filter(F.size("_p") >= 2).select(
        "fid", "part", F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("path"))
