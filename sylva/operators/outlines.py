"""Outlines of labelled regions as closed rings on cell borders.

Every side of a cell that does not meet its own region is a directed half-edge with
the region on its left; which half-edge follows is decided by the four cells around
its end, so the half-edges of a region are a set of closed rings. Tiles chain their
own half-edges into pieces; only pieces that leave a tile are put in order by pointer
doubling. Where a region touches itself at a corner the ring stays with its cell, so
a region has one outer ring, counter-clockwise on the map, and one clockwise ring for
each hole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.geometry import POINTS
from sylva.operators.graph import cycle_order
from sylva.operators.raster import in_metres
from sylva.session import materialize, spread

ROW_STRIDE = 1 << 32
# Sides in the order south, east, north, west: the cell beyond, and the way the half-edge runs.
BEYOND = ((1, 0), (0, 1), (-1, 0), (0, -1))
ALONG = ((0, 1), (-1, 0), (0, -1), (1, 0))
#: Where the half-edge of a side starts, from the cell's upper left corner.
START = ((1, 0), (1, 1), (0, 1), (0, 0))
PIECE = "raster_id string, label long, head long, follow long, cells long, sides long, corner long, rows array<int>, cols array<int>"


def in_tiles(cells: DataFrame, tile: int, halo: int = 1) -> DataFrame:
    """Cells with the tiles (``_tr, _tc``) that hold them or have them in their rim."""
    at = lambda axis: F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor((F.col(axis) - halo) / tile)).cast("int"), F.floor((F.col(axis) + halo) / tile).cast("int")))
    placed = cells.withColumn("row", F.col("row").cast("int")).withColumn("col", F.col("col").cast("int"))
    return spread(placed.withColumn("_tr", at("row")).withColumn("_tc", at("col")), "raster_id", "_tr", "_tc")


def label_window(key: tuple, pdf: pd.DataFrame, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels of a tile and one cell around it, -1 for none; rows and columns of the tile's own cells in that window)."""
    window = np.full((tile + 2, tile + 2), -1, np.int64)
    r, c = pdf["row"].to_numpy(np.int64) - key[1] * tile + 1, pdf["col"].to_numpy(np.int64) - key[2] * tile + 1
    window[r, c] = pdf["label"].to_numpy()
    own = (r >= 1) & (r <= tile) & (c >= 1) & (c <= tile)
    return window, r[own], c[own]


def chains(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements grouped by chain and in order within each, and where groups start.

    ``follow`` holds each element's successor, -1 at an end; closed chains are cut
    before their smallest element."""
    n = len(follow)
    follow = follow.copy()
    for turn in range(2):
        jump = np.where(follow < 0, np.arange(n), follow)
        steps = (follow >= 0).astype(np.int64)
        least = np.minimum(np.arange(n), jump)
        for _ in range(max(1, n).bit_length()):
            steps = steps + steps[jump]
            least = np.minimum(least, least[jump])
            jump = jump[jump]
        closed = follow[jump] >= 0
        if turn or not closed.any():
            break
        cut = closed & (least[np.maximum(follow, 0)] == follow)
        follow[cut] = -1
    order = np.lexsort((-steps, jump))
    ends = jump[order]
    return order, np.flatnonzero(np.concatenate(([True], ends[1:] != ends[:-1]))) if n else np.zeros(0, np.int64)


def pieces(cells: DataFrame, tile: int = 512) -> DataFrame:
    """Stretches of half-edges inside one tile: first half-edge, the one that follows the last, corners, counts.

    ``cells`` is the stretch's part of the ring's area, positive for outer rings."""
    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        window, r, c = label_window(key, pdf, tile)
        label = window[r, c]
        r0, c0 = key[1] * tile - 1, key[2] * tile - 1
        number = np.full((tile + 2, tile + 2, 4), -1, np.int64)
        edge_r, edge_c, edge_s, edge_l = [], [], [], []
        for s, (dr, dc) in enumerate(BEYOND):
            edge = window[r + dr, c + dc] != label
            edge_r.append(r[edge])
            edge_c.append(c[edge])
            edge_s.append(np.full(int(edge.sum()), s))
            edge_l.append(label[edge])
        r, c, s, label = (np.concatenate(x) for x in (edge_r, edge_c, edge_s, edge_l))
        if not len(r):
            return pd.DataFrame(columns=["raster_id", "label", "head", "follow", "cells", "sides", "corner", "rows", "cols"], dtype=object)
        number[r, c, s] = np.arange(len(r))
        along, beyond, start = np.array(ALONG)[s], np.array(BEYOND)[s], np.array(START)[s]
        ahead = window[r + along[:, 0], c + along[:, 1]] == label
        corner = ahead & (window[r + along[:, 0] + beyond[:, 0], c + along[:, 1] + beyond[:, 1]] == label)
        next_r = r + along[:, 0] * ahead + beyond[:, 0] * corner
        next_c = c + along[:, 1] * ahead + beyond[:, 1] * corner
        next_s = (s + np.where(corner, 3, np.where(ahead, 0, 1))) % 4
        code = lambda r, c, s: ((r + r0) * ROW_STRIDE + (c + c0)) * 4 + s
        order, first = chains(number[next_r, next_c, next_s])
        last = np.append(first[1:], len(order)) - 1
        r, c, s, start, label = r[order], c[order], s[order], start[order], label[order]
        head = np.zeros(len(order), bool)
        head[first] = True
        turn = head | (s != np.roll(s, 1))
        row, col = r + r0 + start[:, 0], c + c0 + start[:, 1]
        cuts = np.cumsum(turn)[last][:-1]
        east, west = s == 1, s == 3
        return pd.DataFrame({
            "raster_id": key[0], "label": label[first], "head": code(r, c, s)[first],
            "follow": code(next_r, next_c, next_s)[order][last],
            "cells": np.add.reduceat(col * east - col * west, first), "sides": last - first + 1,
            "corner": np.minimum.reduceat(row * ROW_STRIDE + col, first),
            "rows": np.split(row[turn].astype(np.int32), cuts), "cols": np.split(col[turn].astype(np.int32), cuts)})

    return in_tiles(cells.select("raster_id", "row", "col", "label"), tile).groupBy("raster_id", "_tr", "_tc").applyInPandas(kernel, PIECE)


def in_rings(parts: DataFrame) -> DataFrame:
    """Pieces with ``ring`` and ``place``, their order in it: those that leave a tile are linked by pointer doubling."""
    crossing = parts.filter("follow <> head").select("raster_id", F.col("head").alias("node"), F.col("follow").alias("next"))
    order = cycle_order(crossing, ["raster_id"]).withColumnRenamed("node", "head")
    return parts.join(order, ["raster_id", "head"], "left").withColumns({
        "ring": F.coalesce("ring", "head"), "place": -F.coalesce("ahead", F.lit(0))}).drop("ahead")


def outlines(cells: DataFrame, meta: DataFrame, tile: int = 512) -> DataFrame:
    """``raster_id, label, part, hole, cells, area, perimeter, pts``: the rings of labelled cells, one row each.

    ``part`` is the code of the ring's first corner (row, then column), where ``pts``
    starts too, so rings do not depend on the tile size. ``cells`` counts what the
    ring encloses; an outer ring's count less those of its holes is the region's.
    Points are map places, without the ones on straight stretches; area and perimeter
    are in metres where cells are in degrees."""
    parts = materialize(pieces(cells, tile))
    placed = in_rings(parts).select(
        "raster_id", "label", "ring", "cells", "sides", "corner", F.struct(F.col("place").alias("k"), F.arrays_zip("rows", "cols").alias("p")).alias("piece"))
    # A ring is one row of the layer, so its pieces meet here.
    rings = placed.groupBy("raster_id", "label", "ring").agg(
        F.sum("cells").alias("_n"), F.sum("sides").alias("_sides"), F.min("corner").alias("part"),
        F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["p"])).alias("_all"))
    before = F.concat(F.slice("_all", -1, 1), F.slice("_all", 1, F.size("_all") - 1))
    after = F.concat(F.slice("_all", 2, F.size("_all")), F.slice("_all", 1, 1))
    straight = lambda a, b, c, axis: (a[axis] == b[axis]) & (b[axis] == c[axis])
    marked = F.transform(F.arrays_zip(before.alias("a"), F.col("_all").alias("b"), after.alias("c")), lambda t: F.struct(
        t["b"].alias("p"), (straight(t["a"], t["b"], t["c"], "rows") | straight(t["a"], t["b"], t["c"], "cols")).alias("skip")))
    kept = rings.withColumn("_kept", F.transform(F.filter(marked, lambda t: ~t["skip"]), lambda t: t["p"]))
    first = F.array_position("_kept", F.array_min("_kept")).cast("int")
    turned = kept.withColumn("_ring", F.concat(F.slice("_kept", first, F.size("_kept")), F.slice("_kept", F.lit(1), first - 1)))
    frame = in_metres(meta).select("raster_id", F.col("xmin").alias("_x"), F.col("ymax").alias("_y"), F.col("px_size").alias("_px"), F.col("px_m").alias("_m"))
    place = F.transform("_ring", lambda p: F.struct(
        (F.col("_x") + p["cols"] * F.col("_px")).alias("x"), (F.col("_y") - p["rows"] * F.col("_px")).alias("y"))).cast(POINTS)
    n = F.abs("_n")
    return turned.join(frame, "raster_id").select(
        "raster_id", "label", "part", (F.col("_n") < 0).alias("hole"), n.alias("cells"), (n * F.col("_m") * F.col("_m")).alias("area"),
        (F.col("_sides") * F.col("_m")).alias("perimeter"), place.alias("pts"))


def measures(cells: DataFrame, tile: int = 512) -> DataFrame:
    """``raster_id, label, cells, sides, row0, row1, col0, col1`` of regions: counted in tiles, summed over them."""
    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        window, r, c = label_window(key, pdf, tile)
        label, at = np.unique(window[r, c], return_inverse=True)
        sides = sum((window[r + dr, c + dc] != window[r, c]).astype(np.int64) for dr, dc in BEYOND)
        row, col = r + key[1] * tile - 1, c + key[2] * tile - 1
        out = pd.DataFrame({"at": at, "row": row, "col": col, "sides": sides}).groupby("at").agg(
            cells=("at", "size"), sides=("sides", "sum"), row0=("row", "min"), row1=("row", "max"), col0=("col", "min"), col1=("col", "max"))
        return out.assign(raster_id=key[0], label=label)[["raster_id", "label", "cells", "sides", "row0", "row1", "col0", "col1"]]

    parts = in_tiles(cells.select("raster_id", "row", "col", "label"), tile).groupBy("raster_id", "_tr", "_tc").applyInPandas(
        kernel, "raster_id string, label long, cells long, sides long, row0 int, row1 int, col0 int, col1 int")
    return parts.groupBy("raster_id", "label").agg(
        F.sum("cells").alias("cells"), F.sum("sides").alias("sides"), *[F.min(c).alias(c) for c in ("row0", "col0")], *[F.max(c).alias(c) for c in ("row1", "col1")])
