"""Raw detector boxes to tree points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.bands import CONFIDENCE_CUT, conf_filter, geo_x, geo_y
from sylva.operators.raster import DETECTOR_INPUT
from sylva.session import materialize, spread

# Overlap limit; one detector run gives at most this many boxes.
IOU_CUT = 0.45
RAW_BOXES = 8400

_BOX = ["window_id", "fid", "cx", "cy", "w", "h", "score"]
#: Windows of up to so many boxes are settled side by side.
SMALL = 64


def _greedy(cx: np.ndarray, cy: np.ndarray, w: np.ndarray, h: np.ndarray, iou: float) -> np.ndarray:
    """Sequential suppression of one bounded group in its order: which boxes stay."""
    alive = np.ones(len(cx), dtype=bool)
    for i in range(len(cx)):
        if not alive[i]:
            continue
        rest = slice(i + 1, None)
        ox = np.minimum(cx[i] + w[i] / 2, cx[rest] + w[rest] / 2) - np.maximum(cx[i] - w[i] / 2, cx[rest] - w[rest] / 2)
        oy = np.minimum(cy[i] + h[i] / 2, cy[rest] + h[rest] / 2) - np.maximum(cy[i] - h[i] / 2, cy[rest] - h[rest] / 2)
        both = np.maximum(ox, 0.0) * np.maximum(oy, 0.0)
        alive[rest] &= ~(both / (w[i] * h[i] + w[rest] * h[rest] - both) > iou)
    return alive


def _greedy_of(cx: np.ndarray, cy: np.ndarray, w: np.ndarray, h: np.ndarray, iou: float) -> np.ndarray:
    """``_greedy`` of many groups of one size side by side, (groups, boxes)."""
    alive = np.ones(cx.shape, dtype=bool)
    for i in range(cx.shape[1] - 1):
        own, rest = np.s_[:, i:i + 1], np.s_[:, i + 1:]
        ox = np.minimum(cx[own] + w[own] / 2, cx[rest] + w[rest] / 2) - np.maximum(cx[own] - w[own] / 2, cx[rest] - w[rest] / 2)
        oy = np.minimum(cy[own] + h[own] / 2, cy[rest] + h[rest] / 2) - np.maximum(cy[own] - h[own] / 2, cy[rest] - h[rest] / 2)
        both = np.maximum(ox, 0.0) * np.maximum(oy, 0.0)
        alive[rest] &= ~((both / (w[own] * h[own] + w[rest] * h[rest] - both) > iou) & alive[own])
    return alive


def _suppress(iou: float):
    """Suppression over rows sorted by window and rank; ``first`` marks a window's best box."""
    def settled(rows: pa.Table) -> pa.Table:
        box = [rows.column(c).to_numpy() for c in ("cx", "cy", "w", "h")]
        starts = np.flatnonzero(rows.column("first").to_numpy())
        sizes = np.diff(np.append(starts, rows.num_rows))
        alive = np.ones(rows.num_rows, dtype=bool)
        with np.errstate(divide="ignore", invalid="ignore"):
            for size in np.unique(sizes):
                at = starts[sizes == size][:, None] + np.arange(size)
                if size <= SMALL:
                    alive[at] = _greedy_of(*[v[at] for v in box], iou)
                else:
                    for one in at:
                        alive[one] = _greedy(*[v[one] for v in box], iou)
        return rows.drop_columns(["first"]).filter(pa.array(alive))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False))
            # The last window of a batch may go on in the next one.
            if len(starts) and (waiting or starts[-1] > 0):
                done = pa.Table.from_batches([*waiting, batch.slice(0, starts[-1])])
                yield from settled(done).to_batches()
                waiting, batch = [], batch.slice(starts[-1])
            waiting.append(batch)
        if waiting:
            yield from settled(pa.Table.from_batches(waiting)).to_batches()

    return run


def _overlap_iou():
    def one(axis: str, size: str):
        return F.greatest(F.lit(0.0), (
            F.least(F.col(f"c{axis}") + F.col(size) / 2, F.col(f"kc{axis}") + F.col(f"k{size}") / 2)
            - F.greatest(F.col(f"c{axis}") - F.col(size) / 2, F.col(f"kc{axis}") - F.col(f"k{size}") / 2)))
    both = one("x", "w") * one("y", "h")
    return both / (F.col("w") * F.col("h") + F.col("kw") * F.col("kh") - both)


def box_nms(
    boxes: DataFrame, conf: float = CONFIDENCE_CUT, iou: float = IOU_CUT, most: int = RAW_BOXES,
    cell: float = 80.0,
) -> DataFrame:
    """Greedy suppression per window: highest score first, lower fid on a tie.

    Input ``fid, window_id, cx, cy, w, h, score``. A window holds at most one
    detector run, so one bounded group settles it; windows of equally many boxes are
    settled side by side. Scores that are no number come last. Should a window
    hold more, its best ``most`` boxes are settled first, then everything they
    overlap is removed by a grid join, and the rest takes another round.
    """
    undecided = spread(boxes.filter(conf_filter(F.col("score"), conf)).select(*_BOX), "window_id")
    rank = [F.isnan("score"), F.desc("score"), F.col("fid")]
    order = Window.partitionBy("window_id").orderBy(*rank)
    schema = undecided.schema
    kept: DataFrame | None = None
    while True:
        best = undecided.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
        best = best.sortWithinPartitions("window_id", *rank).select(*_BOX, (F.col("_n") == 1).alias("first"))
        keep = best.mapInArrow(_suppress(iou), schema)
        crowded = undecided.groupBy("window_id").count().filter(F.col("count") > most).select("window_id")
        if crowded.isEmpty():
            return keep if kept is None else kept.unionByName(keep)
        keep = materialize(keep)
        kept = keep if kept is None else kept.unionByName(keep)
        rest = undecided.join(crowded, "window_id", "left_semi").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") > most).drop("_n")
        # Beyond the limit only boxes with centres this near (in sides of the kept box) can overlap enough.
        near = max(1 - iou, (1 / iou - 1) / 2)
        span = lambda c, s: F.explode(F.sequence(F.floor((F.col(c) - near * F.col(s)) / cell), F.floor((F.col(c) + near * F.col(s)) / cell)))
        strong = keep.select("window_id", F.col("cx").alias("kcx"), F.col("cy").alias("kcy"), F.col("w").alias("kw"), F.col("h").alias("kh"))
        strong = strong.withColumn("i", span("kcx", "kw")).withColumn("j", span("kcy", "kh"))
        placed = rest.withColumn("i", F.floor(F.col("cx") / cell)).withColumn("j", F.floor(F.col("cy") / cell))
        gone = placed.join(strong, ["window_id", "i", "j"]).filter(_overlap_iou() > iou).select("fid").distinct()
        undecided = materialize(rest.join(gone, "fid", "left_anti"))


def boxes_to_points(boxes: DataFrame, windows: DataFrame, meta: DataFrame) -> DataFrame:
    """Window centres to raster pixels and map coordinates.

    ``windows``: ``window_id, raster_id, x0, y0, w, h``."""
    placed = boxes.select("fid", "window_id", "cx", "cy", "score").join(
        windows.select("window_id", "raster_id", "x0", "y0", F.col("w").alias("cw"), F.col("h").alias("ch")), "window_id")
    px = F.rint(F.col("x0") + F.col("cx") * (F.col("cw") / DETECTOR_INPUT)).cast("int")
    py = F.rint(F.col("y0") + F.col("cy") * (F.col("ch") / DETECTOR_INPUT)).cast("int")
    m = meta.select("raster_id", "xmin", "ymax", "px_size")
    return (
        placed.withColumn("px", px).withColumn("py", py).join(m, "raster_id")
        .withColumn("geo_x", geo_x(F.col("px"), F.col("xmin"), F.col("px_size")))
        .withColumn("geo_y", geo_y(F.col("py"), F.col("ymax"), F.col("px_size")))
        .select("fid", "raster_id", "px", "py", "geo_x", "geo_y", "score")
    )
