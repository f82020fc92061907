"""Regions of a sparse mask: labels, holes, measures, overlay with polygons."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.geometry import POINTS, clip_to_box, dist_point_segment, distance, high, let, low, pin, point_in_rings, ring_area
from sylva.operators.edges import edge_index, edges_of, points_in_index
from sylva.operators.graph import connected_components
from sylva.operators.outlines import measures
from sylva.operators.raster import in_metres
from sylva.operators.stencil import with_size
from sylva.session import materialize, meet, spread

ROW_STRIDE = 1 << 32
CELL = ["raster_id", "row", "col"]


def cell_id(row: Column, col: Column) -> Column:
    """Row-major id, so the smallest id of a region is its first cell."""
    return row.cast("long") * ROW_STRIDE + col.cast("long")


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index per component: hook to the minimum, then shorten."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low_ = np.minimum(la, lb)
        np.minimum.at(label, la, low_)
        np.minimum.at(label, lb, low_)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def _steps(diagonal: bool) -> list[tuple[int, int]]:
    return [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])


def _label_grid(index: np.ndarray, diagonal: bool) -> np.ndarray:
    """Component of each numbered cell of a grid; -1 marks cells that do not count."""
    p = np.pad(index, 1, constant_values=-1)
    a, b = [], []
    for dr, dc in _steps(diagonal):
        here = p[1:-1, 1:-1]
        there = p[1 + dr:p.shape[0] - 1 + dr, 1 + dc:p.shape[1] - 1 + dc]
        both = (here >= 0) & (there >= 0)
        a.append(here[both])
        b.append(there[both])
    return _components(int((index >= 0).sum()), np.concatenate(a), np.concatenate(b))


def label_cells(mask: DataFrame, diagonal: bool = False, tile: int = 512) -> DataFrame:
    """Adds ``label``: the id of the first cell of the connected region.

    Tiles are labelled alone; only touching cells on tile borders go into the
    global component search."""
    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"], ignore_index=True)
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        index = np.full((tile, tile), -1, dtype=np.int64)
        index[r % tile, c % tile] = np.arange(len(pdf))
        ids = r.astype(np.int64) * ROW_STRIDE + c
        return pd.DataFrame({"raster_id": key[0], "row": r, "col": c, "local": ids[_label_grid(index, diagonal)]})

    local = materialize(
        spread(
            mask.select("raster_id", F.col("row").cast("int"), F.col("col").cast("int"))
            .withColumn("_tr", F.floor(F.col("row") / tile)).withColumn("_tc", F.floor(F.col("col") / tile)), "raster_id", "_tr", "_tc")
        .groupBy("raster_id", "_tr", "_tc").applyInPandas(kernel, "raster_id string, row int, col int, local long")
    )
    node = lambda c: F.struct("raster_id", F.col(c).alias("local"))
    joined: DataFrame | None = None
    for dr, dc in _steps(diagonal):
        crossing = F.lit(False)
        if dr:
            crossing = crossing | (F.col("row") % tile == tile - 1)
        if dc:
            crossing = crossing | (F.col("col") % tile == (tile - 1 if dc > 0 else 0))
        rim = local.filter(crossing).select(
            "raster_id", (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.col("local").alias("from"))
        pairs = rim.join(local, CELL).select(node("from").alias("src"), node("local").alias("dst"))
        joined = pairs if joined is None else joined.unionByName(pairs)
    comps = connected_components(joined).select(
        F.col("node.raster_id").alias("raster_id"), F.col("node.local").alias("local"), F.col("component.local").alias("_c"))
    return (
        local.join(comps, ["raster_id", "local"], "left")
        .select(*CELL, F.coalesce("_c", "local").alias("label"))
    )


def label_plateaus(maxima: DataFrame) -> DataFrame:
    """Connected equal maxima become one point at the truncated mean position."""
    return (
        label_cells(maxima).groupBy("raster_id", "label")
        .agg(F.avg("row").cast("int").alias("row"), F.avg("col").cast("int").alias("col"))
    )


def label_regions(cells: DataFrame, px_size: float, tile: int = 512) -> DataFrame:
    """One row per region of labelled cells: cells, area, bounding box, perimeter.

    ``row1``/``col1`` are the last row and column inside. Counted in tiles, so no
    group is a whole row or column of a raster."""
    return measures(cells, tile).select(
        "raster_id", "label", "cells", (F.col("cells") * F.lit(px_size * px_size)).alias("area"),
        "row0", "row1", "col0", "col1", (F.col("sides") * F.lit(px_size)).alias("perimeter"))


def measure_regions(cells: DataFrame, meta: DataFrame, tile: int = 512) -> DataFrame:
    """``label_regions`` with each raster's own cell size in metres."""
    px = F.col("px_m")
    sized = measures(cells, tile).join(in_metres(meta).select("raster_id", "px_m"), "raster_id")
    return sized.select(
        "raster_id", "label", "cells", (F.col("cells") * px * px).alias("area"), "row0", "row1", "col0", "col1", (F.col("sides") * px).alias("perimeter"))


def fill_holes(cells: DataFrame, meta: DataFrame, px_size: float, max_area: float = 2000.0, tile: int = 512) -> DataFrame:
    """Give small background islands inside exactly one region to that region.

    Only tiles that hold region cells are looked at. A tile without any is
    background of at least ``max_area`` by the choice of tile size, so a
    background part that reaches one is no hole."""
    if max_area <= 0:
        return cells
    least = max_area / (px_size * px_size)
    tile = max(tile, math.isqrt(math.ceil(least)) + 1)

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        raster_id, tr, tc, height, width = key
        r0, c0 = tr * tile, tc * tile
        h, w = min(tile, height - r0), min(tile, width - c0)
        empty = np.ones((h, w), dtype=bool)
        empty[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = False
        r, c = np.nonzero(empty)
        index = np.full((h, w), -1, dtype=np.int64)
        index[r, c] = np.arange(len(r))
        label = _label_grid(index, False)
        rim = (r == 0) | (c == 0) | (r == h - 1) | (c == w - 1)
        row, col = r + r0, c + c0
        outer = (row == 0) | (col == 0) | (row == height - 1) | (col == width - 1)
        size = np.bincount(label, minlength=max(1, len(r)))
        open_ = (size >= least) | (np.bincount(label, weights=outer, minlength=max(1, len(r))) > 0)
        keep = ~open_[label] | rim if len(r) else np.zeros(0, dtype=bool)
        ids = row.astype(np.int64) * ROW_STRIDE + col
        return pd.DataFrame({
            "raster_id": raster_id, "row": row[keep].astype("int32"), "col": col[keep].astype("int32"),
            "part": ids[label][keep] if len(r) else ids, "open": open_[label][keep] if len(r) else rim, "rim": rim[keep]})

    keys = ["raster_id", "_tr", "_tc", "height", "width"]
    placed = with_size(cells.select(*CELL), meta).withColumn("_tr", F.floor(F.col("row") / tile).cast("int")).withColumn(
        "_tc", F.floor(F.col("col") / tile).cast("int"))
    back = materialize(
        spread(placed, *keys).groupBy(*keys)
        .applyInPandas(kernel, "raster_id string, row int, col int, part long, open boolean, rim boolean")
    )
    # Across tile borders: background meets background, a region, or a tile that was never opened.
    offs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    at_tile = lambda c: F.floor(F.col(c) / tile)
    across = (
        with_size(back.filter("rim"), meta).withColumn("_o", offs)
        .withColumn("nrow", F.col("row") + F.col("_o.a")).withColumn("ncol", F.col("col") + F.col("_o.b"))
        .filter((at_tile("nrow") != at_tile("row")) | (at_tile("ncol") != at_tile("col")))
        .filter(F.col("nrow").between(0, F.col("height") - 1) & F.col("ncol").between(0, F.col("width") - 1))
        .select("raster_id", "part", F.col("nrow").alias("row"), F.col("ncol").alias("col"))
    )
    known = back.filter("rim").select(*CELL, F.col("part").alias("other")).unionByName(
        cells.select(*CELL, F.lit(None).cast("long").alias("other")))
    met = materialize(across.join(known.withColumn("_seen", F.lit(True)), CELL, "left"))
    node = lambda c: F.struct("raster_id", F.col(c).alias("part"))
    comps = connected_components(met.filter("other is not null").select(node("part").alias("src"), node("other").alias("dst"))).select(
        F.col("node.raster_id").alias("raster_id"), F.col("node.part").alias("part"), F.col("component.part").alias("_c"))
    leaks = met.filter("_seen is null").select("raster_id", "part").distinct().withColumn("_leak", F.lit(True))
    parts = (
        back.join(leaks, ["raster_id", "part"], "left").join(comps, ["raster_id", "part"], "left")
        .withColumn("hole", F.coalesce("_c", "part"))
    )
    small = (
        parts.groupBy("raster_id", "hole")
        .agg(F.count("*").alias("n"), F.max(F.col("open") | F.coalesce("_leak", F.lit(False))).alias("leaks"))
        .filter(~F.col("leaks") & (F.col("n") < least)).select("raster_id", "hole")
    )
    inner = materialize(parts.join(small, ["raster_id", "hole"], "left_semi").select(*CELL, "hole"))
    touched = (
        inner.withColumn("_o", offs)
        .select("raster_id", "hole", (F.col("row") + F.col("_o.a")).alias("row"), (F.col("col") + F.col("_o.b")).alias("col"))
        .join(cells.select(*CELL, "label"), CELL)
        .groupBy("raster_id", "hole").agg(F.min("label").alias("label"), F.max("label").alias("_hi"))
        .filter(F.col("label") == F.col("_hi")).drop("_hi")
    )
    filled = inner.join(touched, ["raster_id", "hole"]).select(*CELL, "label")
    return cells.select(*CELL, "label").unionByName(filled)


# ---- polygons ---------------------------------------------------------------

def polygons(rings: DataFrame) -> DataFrame:
    """``fid, rings``: the parts of a feature together, for the even-odd rule."""
    return rings.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("part", "pts"))).alias("_p")).select(
        "fid", F.col("_p.pts").alias("rings"))


def _all_points(rings: Column) -> Column:
    return F.flatten(rings)


def _edge_touches(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Does some edge's bounding box meet the cell?"""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.exists(
        F.zip_with(ring, turned, lambda a, b: (
            (F.least(a["x"], b["x"]) <= x1) & (F.greatest(a["x"], b["x"]) >= x0)
            & (F.least(a["y"], b["y"]) <= y1) & (F.greatest(a["y"], b["y"]) >= y0))),
        lambda hit: hit)


def usual_size(polys: DataFrame) -> float:
    """A grid side in the order of the polygons' own size."""
    pts = _all_points(F.col("rings"))
    got = polys.agg(F.avg(F.greatest(high(pts, "x") - low(pts, "x"), high(pts, "y") - low(pts, "y"))).alias("s")).first()["s"]
    return float(2.0 ** round(math.log2(max(got or 1.0, 1e-6))))


CROWDED_PAIRS = 100_000


def points_inside(
    points: DataFrame, polys: DataFrame, id_: str = "fid", side: float | None = None, crowded: int = CROWDED_PAIRS,
) -> DataFrame:
    """Ids of points inside at least one polygon, by the index of edges in grid cells.

    Points in cells that no edge meets are settled by an equi-join; others meet the
    edges of their own cell only, never a whole ring."""
    side = side or usual_size(polys)
    cells, inside = edge_index(polys, side)
    asked = points.select(F.col(id_).alias("_id"), "x", "y")
    return points_in_index(asked, cells, inside, side, crowded).withColumnRenamed("_id", id_)


def erase_points(points: DataFrame, polys: DataFrame, id_: str = "fid", side: float | None = None) -> DataFrame:
    """Points outside every polygon."""
    return points.join(points_inside(points.select(id_, "x", "y"), polys, id_, side), id_, "left_anti")


def erase_regions(cells: DataFrame, polys: DataFrame, meta: DataFrame) -> DataFrame:
    """Region cells whose centre is outside every exclude polygon; places come from each raster's ``meta``."""
    frame = meta.select("raster_id", F.col("xmin").alias("_x"), F.col("ymax").alias("_y"), F.col("px_size").alias("_px"))
    centred = cells.join(frame, "raster_id").withColumn("x", F.col("_x") + (F.col("col") + 0.5) * F.col("_px")).withColumn("y", F.col("_y") - (F.col("row") + 0.5) * F.col("_px"))
    keyed = centred.withColumn("_id", F.struct(*CELL))
    return erase_points(keyed, polys, "_id").select(*cells.columns)


def fishnet(boxes: DataFrame, w: float = 50.0, h: float = 50.0) -> DataFrame:
    """Cells of w x h from the lower left of ``fid, xmin, ymin, xmax, ymax`` until
    the upper right corner is covered."""
    check_positive(w=w, h=h)
    cols = F.greatest(F.lit(1), F.ceil((F.col("xmax") - F.col("xmin")) / w)).cast("int")
    rows = F.greatest(F.lit(1), F.ceil((F.col("ymax") - F.col("ymin")) / h)).cast("int")
    return (
        boxes.withColumn("cell_row", F.explode(F.sequence(F.lit(0), rows - 1)))
        .withColumn("cell_col", F.explode(F.sequence(F.lit(0), cols - 1)))
        .withColumn("x0", F.col("xmin") + F.col("cell_col") * w).withColumn("y0", F.col("ymin") + F.col("cell_row") * h)
        .withColumn("x1", F.col("x0") + w).withColumn("y1", F.col("y0") + h)
    )


def clip_grid(polys: DataFrame, w: float = 50.0, h: float = 50.0) -> DataFrame:
    """The part of each polygon's fishnet that lies inside it, with its area.

    Holes are cut the same way and subtracted. Cells no edge meets are all in
    or all out; only boundary cells are cut."""
    pts = _all_points(F.col("rings"))
    boxes = pin(spread(polys.select("fid", "rings"), "fid"), **{f"{a}{n}": f(pts, a) for a in "xy" for f, n in ((low, "min"), (high, "max"))})
    biggest = F.array_max(F.transform("rings", lambda r: ring_area(r)))
    grid = fishnet(pin(boxes, _most=biggest), w, h)
    corners = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    met = F.exists("rings", lambda r: _edge_touches(r, *corners))
    inside = point_in_rings((corners[0] + corners[2]) / 2, (corners[1] + corners[3]) / 2, F.col("rings"))
    cut = F.transform("rings", lambda r: clip_to_box(r, *corners))
    signed = F.aggregate(
        F.zip_with("rings", "pieces", lambda r, c: F.when(F.size(c) < 3, 0.0).otherwise(
            let(ring_area(c), lambda area: F.when(ring_area(r) == F.col("_most"), area).otherwise(-area)))),
        F.lit(0.0), lambda acc, v: acc + v)
    full = (corners[2] - corners[0]) * (corners[3] - corners[1])
    cells = pin(pin(grid, _met=met), pieces=F.when(F.col("_met"), cut))
    return (
        pin(cells, area=F.when(F.col("_met"), signed).when(inside, full).otherwise(0.0))
        .filter("area > 0")
        .select("fid", "cell_row", "cell_col", "x0", "y0", "x1", "y1", "area", "pieces")
    )


#: Cells of a lane that one key of an overlay holds.
STRETCH = 1024


def spans_inside(polys: DataFrame, q: float) -> DataFrame:
    """``fid, i, a, b``: runs of cells of side q whose centre is inside, by scan lines."""
    s = F.lit(float(q))
    # Dealt before they grow to lanes: a small file would do all of it in one task.
    edges = edges_of(spread(polys.select("fid", "rings"), "fid")).filter("ax <> bx")
    first, last = (F.floor(f("ax", "bx") / s - 0.5) for f in (F.least, F.greatest))
    on = edges.withColumn("i", F.explode(F.sequence(first, last + 1))).withColumn("_x", (F.col("i") + 0.5) * s)
    met = on.filter((F.col("ax") > F.col("_x")) != (F.col("bx") > F.col("_x"))).select(
        "fid", "i", ((F.col("by") - F.col("ay")) * (F.col("_x") - F.col("ax")) / (F.col("bx") - F.col("ax")) + F.col("ay")).alias("_lo"))
    lane = Window.partitionBy("fid", "i").orderBy("_lo")
    paired = met.withColumn("_k", F.row_number().over(lane)).withColumn("_hi", F.lead("_lo").over(lane)).filter((F.col("_k") % 2 == 1) & F.col("_hi").isNotNull())
    return paired.select("fid", "i", F.ceil(F.col("_lo") / s - 0.5).alias("a"), (F.ceil(F.col("_hi") / s - 0.5) - 1).alias("b")).filter("a <= b")


def spans_near(segments: DataFrame, d: float, q: float) -> DataFrame:
    """``i, a, b``: runs of cells of side q whose centre is within d of a segment ``ax, ay, bx, by``.

    What lies within d of a segment is convex, so it meets a scan line in one
    stretch: the ends are those of the discs around both ends and of the band
    between them. The cells at the ends are judged by their distance. One row per
    segment and scan line, whatever d and q."""
    s, r = F.lit(float(q)), F.lit(float(d))
    ax, ay, bx, by, x = (F.col(c) for c in ("ax", "ay", "bx", "by", "_x"))
    size = distance(ax, ay, bx, by)
    # The way from the segment to the upper edge of its band.
    side = F.when(bx >= ax, r).otherwise(-r) / size
    # Each distinct segment once, dealt before it grows to lanes.
    once = spread(segments.select("ax", "ay", "bx", "by"), "ax", "ay", "bx", "by").distinct()
    moved = pin(once, _mx=F.when(size > 0, -(by - ay) * side), _my=F.when(size > 0, (bx - ax) * side))
    on = moved.withColumn("i", F.explode(F.sequence(
        F.floor((F.least(ax, bx) - d) / s - 0.5), F.floor((F.greatest(ax, bx) + d) / s - 0.5) + 1))).withColumn("_x", (F.col("i") + 0.5) * s)
    half = lambda cx: F.when(F.abs(x - cx) <= d, F.sqrt(F.greatest(F.lit(0.0), r * r - (x - cx) * (x - cx))))
    part = lambda way: F.when(bx != ax, (x - ax - way * F.col("_mx")) / (bx - ax))
    met = pin(on, _da=half(ax), _db=half(bx), _up=part(1), _down=part(-1))
    edge = lambda t, way: F.when(F.col(t).between(0, 1), ay + way * F.col("_my") + F.col(t) * (by - ay))
    # Beside an upright segment the band is the segment itself moved sideways.
    beside = F.when((ax == bx) & (F.abs(x - ax) <= d), F.lit(1))
    top = F.greatest(ay + F.col("_da"), by + F.col("_db"), edge("_up", 1), ay * beside, by * beside)
    bottom = F.least(ay - F.col("_da"), by - F.col("_db"), edge("_down", -1), ay * beside, by * beside)
    met = pin(met, _a=F.ceil(bottom / s - 0.5), _b=F.floor(top / s - 0.5)).filter("_a IS NOT NULL")
    near = lambda j: dist_point_segment(x, (j + 0.5) * s, ax, ay, bx, by) <= d
    a, b = F.col("_a"), F.col("_b")
    seen = pin(met, _a0=near(a - 1), _a1=near(a), _b0=near(b), _b1=near(b + 1))
    first = F.when(F.col("_a0"), a - 1).when(F.col("_a1"), a).otherwise(a + 1)
    last = F.when(F.col("_b1"), b + 1).when(F.col("_b0"), b).otherwise(b - 1)
    return seen.select("i", first.alias("a"), last.alias("b")).filter("a <= b")


def _cut_spans(spans: DataFrame) -> DataFrame:
    """Runs cut at stretches ``k`` of their lane."""
    k = F.explode(F.sequence(F.floor(F.col("a") / STRETCH), F.floor(F.col("b") / STRETCH)))
    return spans.withColumn("k", k).withColumn("a", F.greatest("a", F.col("k") * STRETCH)).withColumn("b", F.least("b", F.col("k") * STRETCH + STRETCH - 1))


def union_spans(spans: DataFrame) -> DataFrame:
    """``i, k, a, b``: runs that overlap become one; a stretch of a lane is a bounded group of cells."""
    lane = Window.partitionBy("i", "k").orderBy("a", "b")
    cut = _cut_spans(spans).select("i", "k", "a", "b").distinct()
    reached = F.max("b").over(lane.rowsBetween(Window.unboundedPreceding, -1))
    opened = cut.withColumn("_new", (reached.isNull() | (F.col("a") > reached + 1)).cast("int"))
    run = F.sum("_new").over(lane.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("_run", run).groupBy("i", "k", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_run")


def riparian_conflict(plans: DataFrame, river: DataFrame, d: float = 50.0, q: float = 5.0) -> DataFrame:
    """``fid, area`` of each plan within d of the river; no row means compliant.

    Areas are counted in cells of side q, so the error is at most the boundary
    length times q; overlapping buffers count once. Plans and buffers meet as runs
    of cells in scan lines, never cell by cell."""
    check_positive(buffer=d, cell=q)
    wet = union_spans(spans_near(river, d, q)).withColumnsRenamed({"a": "_a", "b": "_b"})
    both = F.least("b", "_b") - F.greatest("a", "_a") + 1
    met = meet(_cut_spans(spans_inside(plans, q)), wet, ["i", "k"]).filter(both > 0)
    return met.groupBy("fid").agg((F.sum(both) * F.lit(q * q)).alias("area"))


def check_positive(**values: float) -> None:
    for name, v in values.items():
        if not v > 0:
            raise ValueError(f"{name} must be greater than 0")
