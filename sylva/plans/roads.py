"""Road and trail centre lines from pixels or a probability table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.bands import PROBABILITY_CUT, SMOOTH_PX
from sylva.operators.raster import of_cell_size, sizes_of
from sylva.operators.regions import CELL
from sylva.operators.roads import drop_short_bridges, length_km, trace_lines
from sylva.operators.stencil import remove_wide, thin
from sylva.operators.verdicts import apply_verdicts, crop_windows
from sylva.plans.clearing import cleared_cells
from sylva.session import materialize

# Fixed values.
ROAD_EXG = 8
MIN_DANGLE_M = 5.0


def extract_roads(
    pixels: DataFrame | None, meta: DataFrame, *, threshold: float = ROAD_EXG, smooth_px: float = SMOOTH_PX,
    max_width_m: float = 0.0, min_dangle_m: float = MIN_DANGLE_M, probs: DataFrame | None = None, prob_cut: float = PROBABILITY_CUT,
    replies: DataFrame | None = None, tile: int = 512,
) -> tuple[DataFrame, DataFrame]:
    """``(lines, summary)``. ``probs`` (``raster_id, row, col, prob``) replaces the
    colour mask when given. Widths and lengths are in metres, by each raster's own
    cell size, also where cells are in degrees."""
    if probs is not None:
        mask = probs.filter(F.col("prob") > prob_cut).select(*CELL)
    else:
        mask = cleared_cells(pixels, meta, threshold, smooth_px, tile=tile)
    mask = materialize(mask)
    if max_width_m > 0:
        sizes, narrow = sizes_of(meta), []
        for px_m in sizes:
            of_size = of_cell_size(meta, px_m)
            own = mask.join(of_size.select("raster_id"), "raster_id", "left_semi") if len(sizes) > 1 else mask
            narrow.append(remove_wide(own, of_size, max(1, int(round(max_width_m / px_m)))) if px_m > 0 else own)
        mask = reduce(DataFrame.unionByName, narrow)
    keys = ["raster_id", "line_id"]
    lines = drop_short_bridges(trace_lines(thin(mask, meta, tile), meta, min_dangle_m), min_dangle_m, keys=keys)
    rejected = 0
    if replies is not None:
        xs, ys = F.transform("path", lambda p: p["x"]), F.transform("path", lambda p: p["y"])
        keyed = lines.withColumn("fid", F.struct(*keys))
        extent = keyed.select("fid", "raster_id", F.array_min(xs).alias("xmin"), F.array_max(xs).alias("xmax"), F.array_min(ys).alias("ymin"), F.array_max(ys).alias("ymax"))
        kept, said = apply_verdicts(keyed, replies, crops=crop_windows(extent, meta))
        lines = materialize(kept.drop("fid"))
        rejected = said.first()["rejected"]
    return lines, length_km(lines).withColumn("rejected_by_ai_count", F.lit(rejected).cast("long"))
