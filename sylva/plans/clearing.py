"""Cleared land: mask, regions, holes, areas."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.bands import CLEARED_EXG, FRESH_BRIGHTNESS_MIN, MIN_CLEARING_M2, SMOOTH_PX, exg, fresh_color, valid_mask, water_mask
from sylva.operators.field import area_ha
from sylva.operators.outlines import outlines
from sylva.operators.raster import as_pixels, map_bands, of_cell_size, sizes_of
from sylva.operators.regions import CELL, erase_regions, fill_holes, label_cells, measure_regions
from sylva.operators.stencil import Frame, _cross, grid_objects, over_tiles, segment_mean, smooth
from sylva.operators.verdicts import apply_verdicts, crop_windows
from sylva.session import materialize

# Clean-up steps and the largest hole to fill.
OPENING = 6
CLOSING = 15
HOLE_M2 = 2000.0
OBJECT_PX = 20


def cleared_cells(
    pixels: DataFrame, meta: DataFrame, threshold: float = CLEARED_EXG, smooth_px: float = SMOOTH_PX,
    opening: int = OPENING, closing: int = CLOSING, fresh: bool = False, bright_min: float = FRESH_BRIGHTNESS_MIN, tile: int = 512,
) -> DataFrame:
    """Sparse cleared mask of a pixel or tile table: smoothing, threshold, opening and closing in one exchange.

    Validity, water and colour read the raw bands and travel as one flag."""
    def allowed(of) -> Column:
        base = valid_mask(of) & ~water_mask(of)
        return (base & fresh_color(bright_min, of) if fresh else base).cast("byte")

    slim = map_bands(pixels, exg=exg, ok=allowed)
    steps = [("erode", opening), ("dilate", opening), ("dilate", closing), ("erode", closing)]
    reach = sum(n for _, n in steps)
    if reach == 0 and smooth_px <= 1:
        return as_pixels(slim).filter((F.col("exg") < threshold) & (F.col("ok") == 1)).select(*CELL)
    radius = int(4.0 * smooth_px + 0.5) if smooth_px > 1 else 0
    halo = reach + radius

    def kernel(frame: Frame, pdf: pd.DataFrame) -> pd.DataFrame:
        green = frame.mirrored(pdf, "exg")
        if radius:
            green = smooth(green, smooth_px)
        ok = np.pad(frame.grid(pdf, "ok", bool), frame._overhang())
        inside = np.pad(np.ones_like(frame.grid(pdf, "ok", bool)), frame._overhang())
        cut = slice(radius, -radius) if radius else slice(None)
        a, inside = (green < threshold) & ok[cut, cut], inside[cut, cut]
        for what, n in steps:
            for _ in range(n):
                a = _cross(a, inside, what == "dilate")
        return frame.cells(a[reach:a.shape[0] - reach, reach:a.shape[1] - reach])

    return over_tiles(slim, meta, max(tile, 2 * halo), halo, "raster_id string, row int, col int", kernel)


def cleared_objects(pixels: DataFrame, meta: DataFrame, threshold: float = CLEARED_EXG, px: int = OBJECT_PX) -> DataFrame:
    """Cleared mask by square objects in place of single pixels."""
    labelled = grid_objects(as_pixels(map_bands(pixels, exg=exg, valid=valid_mask)), meta, px)
    return segment_mean(labelled, threshold).filter("cleared").select(*CELL)


def _cleared(
    pixels: DataFrame, meta: DataFrame, *, threshold: float = CLEARED_EXG, smooth_px: float = SMOOTH_PX,
    opening: int = OPENING, closing: int = CLOSING, min_area_m2: float = MIN_CLEARING_M2, hole_m2: float = HOLE_M2, fresh: bool = False,
    method: str = "exg", exclude: DataFrame | None = None, replies: DataFrame | None = None, tile: int = 512,
) -> tuple[DataFrame, DataFrame, int]:
    """``(labelled cells, regions, rejected)`` of the final layer."""
    if method == "objects":
        mask = cleared_objects(pixels, meta, threshold)
    else:
        mask = cleared_cells(pixels, meta, threshold, smooth_px, opening, closing, fresh, tile=tile)
    labelled = materialize(label_cells(mask, tile=tile))
    sizes = sizes_of(meta)
    parts = []
    for px_m in sizes:
        # The tile that a hole needs goes by the cell size.
        of_size = of_cell_size(meta, px_m)
        own = labelled.join(of_size.select("raster_id"), "raster_id", "left_semi") if len(sizes) > 1 else labelled
        parts.append(fill_holes(own, of_size, px_m, hole_m2, tile))
    cells = materialize(reduce(DataFrame.unionByName, parts))
    regions = materialize(measure_regions(cells, meta, tile).filter(F.col("area") >= min_area_m2))
    rejected = 0
    if replies is not None:
        frame = meta.select("raster_id", F.col("xmin").alias("_x"), F.col("ymax").alias("_y"), F.col("px_size").alias("_px"))
        extent = regions.join(frame, "raster_id").select(
            F.struct("raster_id", "label").alias("fid"), "raster_id",
            (F.col("_x") + F.col("col0") * F.col("_px")).alias("xmin"), (F.col("_x") + (F.col("col1") + 1) * F.col("_px")).alias("xmax"),
            (F.col("_y") - (F.col("row1") + 1) * F.col("_px")).alias("ymin"), (F.col("_y") - F.col("row0") * F.col("_px")).alias("ymax"))
        keyed = regions.withColumn("fid", F.struct("raster_id", "label"))
        kept, said = apply_verdicts(keyed, replies, crops=crop_windows(extent, meta))
        regions = materialize(kept.drop("fid"))
        rejected = said.first()["rejected"]
    cells = cells.join(regions.select("raster_id", "label"), ["raster_id", "label"], "left_semi")
    if exclude is not None:
        cells = materialize(erase_regions(cells, exclude, meta))
        regions = measure_regions(cells, meta, tile)
    return cells, regions, rejected


def detect_clearing(pixels: DataFrame, meta: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``(regions, summary)``: small regions go first, then the replies are applied,
    then excluded ground is cut out. Options as in ``clearing_layer``."""
    _cells, regions, rejected = _cleared(pixels, meta, **options)
    return regions, area_ha(regions).withColumn("rejected_by_ai_count", F.lit(rejected).cast("long"))


def clearing_layer(pixels: DataFrame, meta: DataFrame, *, tile: int = 512, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(layer, regions, summary)`` of cleared ground; the layer has the outlines, one ring a row, with ``fid``.

    Options: ``threshold, smooth_px, opening, closing`` of the mask, ``fresh`` colour,
    ``method`` (``exg`` or ``objects``), ``min_area_m2``, ``hole_m2``, ``replies`` of
    a vision model, ``exclude`` polygons. Cell size and corner are each raster's own,
    from ``meta``; cells in degrees count in metres for areas. ``polygons(layer)``
    gives the features for overlays, ``ring_measures(layer)`` their shapes."""
    cells, regions, rejected = _cleared(pixels, meta, tile=tile, **options)
    layer = outlines(cells, meta, tile).withColumn("fid", F.struct("raster_id", "label"))
    return layer, regions, area_ha(regions).withColumn("rejected_by_ai_count", F.lit(rejected).cast("long"))
