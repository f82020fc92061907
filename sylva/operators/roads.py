"""Centre lines to polylines, and pruning of skeleton noise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.geometry import endpoints, line_length, round_mm
from sylva.operators.outlines import chains, in_rings, in_tiles
from sylva.operators.raster import in_metres
from sylva.operators.regions import CELL, ROW_STRIDE, cell_id, label_cells
from sylva.session import materialize

# Neighbours in reading order; the opposite of the k-th is the (7 - k)-th.
_EIGHT = np.array([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)])
#: Which way a closed line is walked from its first cell: straight steps before diagonal ones.
_PREFER = np.array([4, 0, 5, 1, 2, 6, 3, 7])
_STATES = ("row", "col", "to_row", "to_col", "tip")
_LINE = "raster_id string, head long, follow long, " + ", ".join(f"{c} array<int>" for c in _STATES)


def line_pieces(thin: DataFrame, tile: int = 512) -> DataFrame:
    """Cells with two neighbours, chained within tiles in both directions of travel.

    A state is a cell and the neighbour it is left for. The next state is that
    neighbour, left for its other side; where the neighbour is a node (``tip``) the
    way turns back. So all states lie on closed rings: one for a line, there and
    back, two for a line that closes on itself."""
    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[1] * tile - 2, key[2] * tile - 2
        mask = np.zeros((tile + 6, tile + 6), bool)
        r, c = pdf["row"].to_numpy(np.int64) - r0 + 1, pdf["col"].to_numpy(np.int64) - c0 + 1
        mask[r, c] = True
        inner = (r > 1) & (r < tile + 4) & (c > 1) & (c < tile + 4)
        r, c = r[inner], c[inner]
        near = mask[r[:, None] + _EIGHT[:, 0], c[:, None] + _EIGHT[:, 1]]
        line = near.sum(axis=1) == 2
        r, c, near = r[line], c[line], near[line]
        exits = np.full((tile + 6, tile + 6, 2), -1, np.int64)
        if len(r):
            exits[r, c, 0], exits[r, c, 1] = near.argmax(axis=1), 7 - near[:, ::-1].argmax(axis=1)
        own = (r > 2) & (r < tile + 3) & (c > 2) & (c < tile + 3)
        r, c = r[own], c[own]
        if not len(r):
            return pd.DataFrame(columns=["raster_id", "head", "follow", *_STATES], dtype=object)
        number = np.full(mask.shape, -1, np.int64)
        number[r, c] = np.arange(len(r))
        r, c, k = np.repeat(r, 2), np.repeat(c, 2), np.tile([0, 1], len(r))
        way = exits[r, c, k]
        to_r, to_c = r + _EIGHT[way, 0], c + _EIGHT[way, 1]
        tip = exits[to_r, to_c, 0] < 0
        # Having come from v, a cell is left for its other neighbour.
        next_r, next_c = np.where(tip, r, to_r), np.where(tip, c, to_c)
        next_k = np.where(tip, 1 - k, (exits[to_r, to_c, 0] == 7 - way).astype(int))
        code = lambda r, c, k: ((r + r0 - 1) * ROW_STRIDE + (c + c0 - 1)) * 2 + k
        order, first = chains(np.where(number[next_r, next_c] < 0, -1, 2 * number[next_r, next_c] + next_k))
        last = np.append(first[1:], len(order)) - 1
        states = (r + r0 - 1, c + c0 - 1, to_r + r0 - 1, to_c + c0 - 1, tip)
        cut = lambda v: np.split(v[order].astype(np.int32), first[1:])
        return pd.DataFrame({
            "raster_id": key[0], "head": code(r, c, k)[order][first], "follow": code(next_r, next_c, next_k)[order][last],
            **{name: cut(v) for name, v in zip(_STATES, states, strict=True)}})

    return in_tiles(thin.select(*CELL), tile, 2).groupBy("raster_id", "_tr", "_tc").applyInPandas(kernel, _LINE)


def _unrolled(row: pd.Series, col: pd.Series, to_row: pd.Series, to_col: pd.Series, tip: pd.Series) -> pd.DataFrame:
    """Each ring of states as a line from its first tip, or round from its first cell; null where the other direction is taken."""
    out = []
    for r, c, a, b, t in zip(row, col, to_row, to_col, tip, strict=True):
        ends = np.flatnonzero(t)
        if len(ends):
            # Tips in order of their own cell, then the node's cell; the way starts behind the first.
            start = ends[np.lexsort((b[ends], a[ends], c[ends], r[ends]))[0]]
            walk = (start + 1 + np.arange(len(r) // 2)) % len(r)
            end = walk[-1]
            out.append((r[walk], c[walk], a[start], b[start], a[end], b[end]))
            continue
        first = np.lexsort((c, r))[0]
        way = lambda r1, c1: _PREFER[np.flatnonzero((_EIGHT == (r1 - r[first], c1 - c[first])).all(axis=1))[0]]  # noqa: B023, E731
        walk = (first + np.arange(len(r) + 1)) % len(r)
        taken = way(a[first], b[first]) < way(r[first - 1], c[first - 1])
        out.append((r[walk], c[walk], None, None, None, None) if taken else (None,) * 6)
    return pd.DataFrame(out, columns=["rows", "cols", "r0", "c0", "r1", "c1"], dtype=object)


def trace_lines(thin: DataFrame, meta: DataFrame, min_dangle: float = 5.0, tile: int = 512) -> DataFrame:
    """Thin mask to ``raster_id, line_id, path, length``: places in map units, lengths in metres.

    Cells with two neighbours form the lines, all others the nodes; touching
    node cells are one node, placed at their first cell. A stub with one free
    end shorter than ``min_dangle`` is dropped. Tiles chain their own cells, pieces
    that leave a tile are put in order by pointer doubling; only the finished line,
    which is one output row, is put together in one place."""
    cells = materialize(thin.select(*CELL))
    parts = materialize(line_pieces(cells, tile))
    piece = F.struct(F.col("place").alias("k"), F.arrays_zip(*_STATES).alias("s"))
    rings = in_rings(parts).withColumn("piece", piece).groupBy("raster_id", "ring").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["s"])).alias("_s"))
    unroll = F.pandas_udf(_unrolled, "rows array<int>, cols array<int>, r0 int, c0 int, r1 int, c1 int")
    smallest = F.array_min(F.transform("_s", lambda s: s["row"].cast("long") * ROW_STRIDE + s["col"]))
    walked = materialize(rings.select("raster_id", smallest.alias("line_id"), unroll(*[F.col("_s")[c] for c in _STATES]).alias("w")).select(
        "raster_id", "line_id", "w.*").filter("rows is not null"))
    # Nodes are all cells that no line has.
    on_line = parts.select("raster_id", F.inline(F.arrays_zip("row", "col"))).distinct()
    nodes = materialize(label_cells(cells.join(on_line, CELL, "left_anti"), diagonal=True, tile=tile))
    ended = walked
    for k in ("0", "1"):
        at = nodes.select("raster_id", F.col("row").alias(f"r{k}"), F.col("col").alias(f"c{k}"), F.col("label").alias(f"n{k}"))
        ended = ended.join(at, ["raster_id", f"r{k}", f"c{k}"], "left")
    spot = lambda r, c: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"))
    node = lambda n: spot(F.floor(F.col(n) / ROW_STRIDE), F.col(n) % ROW_STRIDE)
    body = F.zip_with("rows", "cols", spot)
    whole = F.when(F.col("n0").isNull(), body).otherwise(F.concat(
        F.array(node("n0"), spot(F.col("r0"), F.col("c0"))), body, F.array(spot(F.col("r1"), F.col("c1")), node("n1"))))
    ended = ended.withColumn("_p", whole).withColumn("_p", F.filter("_p", lambda p, i: (i == 0) | (p != F.get("_p", i - 1))))
    walked = ended.select("raster_id", "line_id", F.col("_p.r").alias("rows"), F.col("_p.c").alias("cols"))
    lines = walked.join(in_metres(meta).select("raster_id", "xmin", "ymax", "px_size", "px_m"), "raster_id").select(
        "raster_id", "line_id", (F.col("px_m") / F.col("px_size")).alias("_m"),
        F.zip_with("cols", "rows", lambda c, r: F.struct(
            (F.col("xmin") + (c + 0.5) * F.col("px_size")).alias("x"), (F.col("ymax") - (r + 0.5) * F.col("px_size")).alias("y"))).alias("path"))
    lines = materialize(lines.withColumn("length", line_length(F.col("path")) * F.col("_m")).drop("_m"))
    return drop_dangles(lines, min_dangle)


def _end_keys(lines: DataFrame, keys: list[str]) -> DataFrame:
    ends = lines.select(*keys, F.posexplode(endpoints(F.col("path"))).alias("_which", "_p"))
    return ends.select(*keys, "_which", F.struct(round_mm(F.col("_p.x")).alias("x"), round_mm(F.col("_p.y")).alias("y")).alias("at"))


def _shared_ends(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``shared``: how many of a line's two ends are used by another end too."""
    ends = _end_keys(lines, keys)
    uses = ends.groupBy("at").agg(F.count("*").alias("_uses"))
    tally = ends.join(uses, "at").groupBy(*keys).agg(F.sum((F.col("_uses") > 1).cast("int")).alias("shared"))
    return lines.join(tally, keys)


def drop_dangles(lines: DataFrame, min_dangle: float, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["raster_id", "line_id"]
    marked = _shared_ends(lines, keys)
    return marked.filter(~((F.col("length") < min_dangle) & (F.col("shared") == 1))).drop("shared")


def drop_short_bridges(lines: DataFrame, min_length: float, passes: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Delete lines shorter than ``min_length`` with both ends in use elsewhere.

    All deletions of a pass happen together; a pass may expose more. ``passes`` is
    part of the rule: bridges that only a later pass would expose stay."""
    keys = keys or ["fid"]
    current = materialize(lines)
    size = current.count()
    for _ in range(passes):
        marked = _shared_ends(current, keys)
        current = materialize(marked.filter(~((F.col("length") < min_length) & (F.col("shared") == 2))).drop("shared"))
        after = current.count()
        if after == size:
            break
        size = after
    return current


def length_km(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("line_count"), (F.coalesce(F.sum("length"), F.lit(0.0)) / 1000.0).alias("length_km"))


__all__ = ["trace_lines", "drop_dangles", "drop_short_bridges", "length_km", "cell_id"]
