"""Tree detection from pixels, and clean-up of detector boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.bands import CONFIDENCE_CUT, REFERENCE_GSD_M, brightness, exg, geo_x, geo_y, valid_mask, veg_mask
from sylva.operators.detections import IOU_CUT, box_nms, boxes_to_points
from sylva.operators.graph import dedup, nms
from sylva.operators.numbering import number_rows
from sylva.operators.raster import in_metres, map_bands, of_cell_size, sizes_of
from sylva.operators.regions import CELL, erase_points, label_plateaus
from sylva.operators.stencil import BLUR_WINDOW_PX, peak_cells, refine_peaks
from sylva.operators.verdicts import apply_verdicts, tree_crops
from sylva.plans.clearing import cleared_cells
from sylva.session import materialize, materialize_counted

# Detection profiles, sizes in pixels at 5 cm.
PROFILES = {
    "forest": dict(sigma=75, exg_threshold=18, min_smooth=10, min_density=0.6, extra_scales=(), refine_radius=None),
    "palm": dict(sigma=20, exg_threshold=10, min_smooth=30, min_density=0.0, extra_scales=(12,), refine_radius=20),
}
CLEARED_FILTER_EXG = 30
DETECTOR_SIGMA = 20
DEDUP_FLOOR = 50


def scaled(size: float, px_size: float, least: int = 1) -> int:
    """Python rounding is half to even, as everywhere for sizes."""
    scale = REFERENCE_GSD_M / px_size if px_size > 0 else 1.0
    return max(least, int(round(size * scale)))


def first_per_place(candidates: DataFrame) -> DataFrame:
    """One candidate per place and scale: the first in reading order."""
    return candidates.groupBy(*CELL, "sigma").agg(F.min("label").alias("label"))


def scale_union(by_sigma: dict[int, DataFrame]) -> DataFrame:
    """The candidates of all scales, each with its ``sigma``."""
    return reduce(DataFrame.unionByName, [df.withColumn("sigma", F.lit(s)) for s, df in by_sigma.items()])


def tree_candidates(
    pixels: DataFrame, meta: DataFrame, px_size: float, sigma: float, exg_threshold: float, min_smooth: float,
    min_density: float, extra_scales: tuple, refine_radius: float | None, exclude_blurry: bool, tile: int,
) -> DataFrame:
    """Peaks of all scales, moved to their crowns: ``fid, raster_id, row, col, sigma``."""
    scales = sorted({scaled(s, px_size) for s in (sigma, *extra_scales)}, reverse=True)
    banded = map_bands(pixels, exg=exg, veg=lambda of: veg_mask(exg_threshold, of), valid=valid_mask, grey=brightness)
    blur = scaled(BLUR_WINDOW_PX, px_size, 5) if exclude_blurry else None
    peaks = materialize(peak_cells(banded, meta, scales, min_smooth, min_density, blur, tile))
    radii = {s: s if refine_radius is None else scaled(refine_radius, px_size) for s in scales}
    found = {s: label_plateaus(peaks.filter(F.col("sigma") == s)).withColumn("radius", F.lit(r)) for s, r in radii.items()}
    # All scales are moved in one exchange of the raster, which also tells whether their places are valid.
    moved = refine_peaks(scale_union(found), banded, meta, max(radii.values()), tile)
    on_valid = first_per_place(moved.filter("valid"))
    return number_rows(on_valid.withColumn("_s", -F.col("sigma")), ["raster_id", "_s", "label"], "fid", start=0).drop("_s", "label")


def detect_trees(
    pixels: DataFrame, meta: DataFrame, profile: str, *, sigma: float | None = None, exg_threshold: float | None = None,
    min_smooth: float | None = None, min_density: float | None = None, exclude_blurry: bool = False,
    exclude_cleared: bool = False, exclude: DataFrame | None = None, replies: DataFrame | None = None, tile: int = 512,
) -> tuple[DataFrame, DataFrame]:
    """``(trees, summary)`` of a pixel or tile table.

    Trees: ``fid, raster_id, px, py, geo_x, geo_y, crown_r, sigma``. Optional
    steps in this order: cleared ground, vision replies, exclude polygons."""
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {', '.join(PROFILES)}")
    p = dict(PROFILES[profile])
    given = dict(sigma=sigma, exg_threshold=exg_threshold, min_smooth=min_smooth, min_density=min_density)
    p.update({k: v for k, v in given.items() if v is not None})
    parts, sizes = [], sizes_of(meta)
    for px_size in sizes:
        of_size = of_cell_size(meta, px_size)
        own = pixels.join(of_size.select("raster_id"), "raster_id", "left_semi") if len(sizes) > 1 else pixels
        cands = tree_candidates(own, of_size, px_size, exclude_blurry=exclude_blurry, tile=tile, **p)
        parts.append(cands.withColumn("x", F.col("col").cast("double")).withColumn("y", F.col("row").cast("double")))
    # Ids are given over all cell sizes: exclusion and replies go by them.
    every = number_rows(reduce(DataFrame.unionByName, parts).withColumnRenamed("fid", "_of_size"), ["raster_id", "_of_size"], "fid", start=0).drop("_of_size")
    kept = nms(materialize(every), keys=["raster_id"])
    m = in_metres(meta).select("raster_id", "xmin", "ymax", "px_size", "px_m")
    n = F.count(F.lit(1))
    trees, found = materialize_counted(
        kept.join(m, "raster_id").select(
            "fid", "raster_id", F.col("col").alias("px"), F.col("row").alias("py"),
            geo_x(F.col("col"), F.col("xmin"), F.col("px_size")).alias("geo_x"), geo_y(F.col("row"), F.col("ymax"), F.col("px_size")).alias("geo_y"),
            F.bround(F.col("sigma") * F.col("px_m"), 2).alias("crown_r"), "sigma"), n=n)
    ground = approved = final = found
    if exclude_cleared:
        trees, ground = materialize_counted(drop_on_mask(trees, cleared_cells(pixels, meta, CLEARED_FILTER_EXG, tile=tile)), n=n)
        approved = final = ground
    rejected = 0
    if replies is not None:
        kept_, said = apply_verdicts(trees, replies, crops=tree_crops(trees, meta, int(p["sigma"])), trees=True)
        trees, approved = materialize_counted(kept_, n=n)
        final = approved
        rejected = said.first()["rejected"]
    if exclude is not None:
        placed = trees.withColumn("x", F.col("geo_x")).withColumn("y", F.col("geo_y"))
        trees, final = materialize_counted(erase_points(placed, exclude).drop("x", "y"), n=n)
    # Counts were observed while each step was written. Trees too near the rim to be shown to a model are dropped, but not as rejected.
    area = in_metres(meta).agg(F.sum(F.col("width") * F.col("height") * F.col("px_m") * F.col("px_m") / 10000.0).alias("area_ha"))
    counts = {"tree_count": final["n"], "filtered_cleared_count": found["n"] - ground["n"], "rejected_by_ai_count": rejected, "excluded_by_area_count": approved["n"] - final["n"]}
    return trees, area.select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()], "area_ha")


def detection_summary(found: DataFrame, on_ground: DataFrame, approved: DataFrame, final: DataFrame) -> DataFrame:
    """Counts after each optional step, gathered in one aggregation."""
    stages = {"_found": found, "_ground": on_ground, "_approved": approved, "_final": final}
    marked = [df.select(F.lit(name).alias("stage")) for name, df in stages.items()]
    tally = reduce(DataFrame.unionByName, marked).agg(*[F.count_if(F.col("stage") == n).alias(n) for n in stages])
    return tally.select(
        F.col("_final").alias("tree_count"), (F.col("_found") - F.col("_ground")).alias("filtered_cleared_count"),
        (F.col("_ground") - F.col("_approved")).alias("rejected_by_ai_count"), (F.col("_approved") - F.col("_final")).alias("excluded_by_area_count"))


def drop_on_mask(trees: DataFrame, mask: DataFrame) -> DataFrame:
    """Trees whose pixel is not in a sparse mask."""
    cells = mask.select("raster_id", F.col("row").alias("py"), F.col("col").alias("px"))
    return trees.join(cells, ["raster_id", "py", "px"], "left_anti").select(*trees.columns)


def dedup_detections(
    boxes: DataFrame, windows: DataFrame, meta: DataFrame, conf: float = CONFIDENCE_CUT, iou: float = IOU_CUT,
) -> DataFrame:
    """Raw boxes of overlapping windows to one point per crown."""
    parts = []
    # Windows belong to one raster, so suppression within them doesn't depend on cell sizes.
    best = materialize(box_nms(boxes, conf, iou))
    for px_size in sizes_of(meta):
        of_size = of_cell_size(meta, px_size)
        mine = windows.join(of_size.select("raster_id"), "raster_id", "left_semi")
        points = boxes_to_points(best, mine, of_size)
        s = scaled(DETECTOR_SIGMA, px_size)
        ready = materialize(points.withColumn("x", F.col("px").cast("double")).withColumn("y", F.col("py").cast("double")).withColumn("sigma", F.lit(s)))
        one = dedup(ready, factor=0.0, floor_px=scaled(DEDUP_FLOOR, px_size), keys=["raster_id"])
        parts.append(one.withColumn("crown_r", F.lit(round(s * px_size, 2))).withColumn("source", F.lit("model")).drop("x", "y"))
    return reduce(DataFrame.unionByName, parts)
