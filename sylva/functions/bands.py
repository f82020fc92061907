"""Pixel expressions over ``r, g, b, alpha`` and the pixel/map transforms.

``of`` looks a band up: a column of a pixel table by default, a field of an
array element when the same expression runs over a tile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Band = Callable[[str], Column]

# Thresholds that results depend on.
REFERENCE_GSD_M = 0.05
CLEARED_EXG = 26
SMOOTH_PX = 3
WATER_BRIGHTNESS_MAX = 150.0
FRESH_BRIGHTNESS_MIN = 120.0
WHITE_PADDING_ABOVE = 240
DEGREE_M = 111320.0
DEGREE_CELL_BELOW = 0.01
PROBABILITY_CUT = 0.5
CONFIDENCE_CUT = 0.25
MIN_CLEARING_M2 = 100.0


def valid_mask(of: Band = F.col) -> Column:
    """Alpha decides if there is one; else any band lit and not white padding."""
    r, g, b, a = (of(c) for c in ("r", "g", "b", "alpha"))
    lit = (r > 0) | (g > 0) | (b > 0)
    white = (r > WHITE_PADDING_ABOVE) & (g > WHITE_PADDING_ABOVE) & (b > WHITE_PADDING_ABOVE)
    return F.when(a.isNotNull(), a > 0).otherwise(lit & ~white)


def exg(of: Band = F.col) -> Column:
    """Excess green, 2g - r - b."""
    return 2.0 * of("g") - of("r") - of("b")


def veg_mask(threshold: float, of: Band = F.col) -> Column:
    return valid_mask(of) & (exg(of) > threshold)


def brightness(of: Band = F.col) -> Column:
    return (of("r") + of("g") + of("b")) / 3.0


def water_mask(of: Band = F.col) -> Column:
    """Dark and neutral to blue."""
    return (brightness(of) < WATER_BRIGHTNESS_MAX) & (of("b") >= of("r"))


def fresh_color(bright_min: float = FRESH_BRIGHTNESS_MIN, of: Band = F.col) -> Column:
    """Bright and reddish: bare soil, not road or river."""
    return (brightness(of) > bright_min) & (of("r") >= of("b"))


def cleared_mask(
    threshold: float = CLEARED_EXG, smoothed: Column | None = None,
    fresh: bool = False, bright_min: float = FRESH_BRIGHTNESS_MIN,
) -> Column:
    """Low greenness (smoothed when given), never water; water reads raw bands."""
    greenness = exg() if smoothed is None else smoothed
    keep = valid_mask() & (greenness < threshold) & ~water_mask()
    return keep & fresh_color(bright_min) if fresh else keep


def prob_mask(logit: Column, valid: Column, threshold: float = PROBABILITY_CUT) -> Column:
    probability = 1.0 / (1.0 + F.exp(-logit))
    return probability * valid.cast("double") > threshold


def conf_filter(score: Column, cut: float = CONFIDENCE_CUT) -> Column:
    return score > cut


def min_area(area: Column, m2: float = MIN_CLEARING_M2) -> Column:
    return area >= m2


def metres_per_px(px_size: Column) -> Column:
    """Cell size for scale and area; tiny sizes are degrees."""
    return F.when(px_size < DEGREE_CELL_BELOW, px_size * DEGREE_M).otherwise(px_size)


def geo_x(col: Column, xmin: Column, px_size: Column) -> Column:
    return xmin + col * px_size


def geo_y(row: Column, ymax: Column, px_size: Column) -> Column:
    return ymax - row * px_size


def pixel_col(x: Column, xmin: Column, px_size: Column) -> Column:
    """Truncates toward zero, so a point just left of the raster lands in column 0."""
    return ((x - xmin) / px_size).cast("int")


def pixel_row(y: Column, ymax: Column, px_size: Column) -> Column:
    return ((ymax - y) / px_size).cast("int")


def scale_of(px_size: Column) -> Column:
    return F.when(px_size > 0, REFERENCE_GSD_M / px_size).otherwise(1.0)


def scaled_size(size: float, px_size: Column, least: int = 1) -> Column:
    """A size given at 5 cm/px, in pixels of this raster; half rounds to even."""
    return F.greatest(F.lit(least), F.rint(F.lit(float(size)) * scale_of(px_size)).cast("int"))
