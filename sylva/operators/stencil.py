"""Neighbourhood operators that equal one pass over the whole raster.

Separable window statistics are native window functions over stretches of pixel
rows or columns: a running sum and two offset look-ups, so the cost does not grow
with the kernel, and no group is a whole row or column of a large raster. Large kernels (Gaussian, morphology, thinning) run in numpy on
tiles; a pixel goes to every tile whose rim it reaches, one shuffle in all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.raster import TILE, is_tiles, map_bands
from sylva.session import materialize, spread

# Focus gate.
BLUR_WINDOW_PX = 25
BLUR_VARIANCE_MIN = 20.0
LEAST_MARGIN_PX = 15

AXES = {"row": ("col", "height"), "col": ("row", "width")}


def with_size(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Attach raster height and width; the metadata has one row per raster."""
    return df.join(meta.select("raster_id", "height", "width"), "raster_id")


# ---- separable window statistics -------------------------------------------

def _mirrored(df: DataFrame, axis: str, lo: int, hi: int) -> DataFrame:
    """Add mirrored copies beyond both ends of an axis, the edge pixel included."""
    size, pos = F.col(AXES[axis][1]), F.col(axis)
    turns = F.ceil((F.lit(max(lo, hi)) / size)).cast("int") + 1
    places = F.flatten(F.transform(
        F.sequence(-turns, turns), lambda t: F.array(2 * size * t + pos, 2 * size * t - 1 - pos)))
    wanted = F.filter(places, lambda p: (p >= -lo) & (p < size + hi))
    return df.withColumn(axis, F.explode(wanted))


#: Pixels of a row or column that one window group holds besides its rim.
LANE = 4096


def _stretched(df: DataFrame, axis: str, lo: int, hi: int) -> tuple[DataFrame, Column]:
    """Rows with the stretch (``_chunk``) of the axis that holds them or needs them as its rim, and which are its own.

    A stretch reaches ``lo`` before and ``hi`` behind itself; sums start anew in each.
    It is several times as long as its rims, so few pixels are in two."""
    size = max(LANE, 2 * (lo + hi))
    pos = F.col(axis)
    placed = df.withColumn("_chunk", F.explode(F.sequence(F.floor((pos - hi) / size), F.floor((pos + lo) / size))))
    return placed, F.floor(pos / size) == F.col("_chunk")


def _lane(axis: str) -> Window:
    """Along one stretch of a row or column."""
    return Window.partitionBy("raster_id", AXES[axis][0], "_chunk").orderBy(axis)


def _next_to(step: int, value: str, axis: str) -> Column:
    """The value one pixel before (-1) or behind (1); null where that pixel is missing."""
    near = F.lag if step < 0 else F.lead
    lane = _lane(axis)
    return F.when(near(axis, 1).over(lane) == F.col(axis) + step, near(value, 1).over(lane))


def _inside(axis: str) -> Column:
    return F.col(axis).between(0, F.col(AXES[axis][1]) - 1)


def _sum_along(df: DataFrame, values: list[str], axis: str, k: int) -> DataFrame:
    lo, hi = k // 2, k - 1 - k // 2
    lane = _lane(axis)
    running = lane.rowsBetween(Window.unboundedPreceding, 0)
    wide, own = _stretched(_mirrored(df, axis, lo, hi), axis, lo, hi)
    for v in values:
        wide = wide.withColumn(f"_s_{v}", F.sum(v).over(running))
    for v in values:
        before = F.coalesce(F.lag(f"_s_{v}", lo + 1).over(lane), F.lit(0.0))
        wide = wide.withColumn(v, F.lead(f"_s_{v}", hi).over(lane) - before)
    return wide.filter(_inside(axis) & own).drop("_chunk", *[f"_s_{v}" for v in values])


def box_mean(df: DataFrame, meta: DataFrame, k: int, **named: str) -> DataFrame:
    """Mean over k x k with mirrored edges; ``box_mean(df, meta, 9, density="veg")``
    adds ``density``. An even k reaches one further up and left."""
    out = df.withColumns({name: F.col(src).cast("double") for name, src in named.items()})
    out = with_size(out, meta)
    for axis in ("col", "row"):
        out = _sum_along(out, list(named), axis, k)
    # Dividing once at the end keeps sums of whole numbers exact.
    return out.withColumns({name: F.col(name) / (k * k) for name in named}).drop("height", "width")


def _max_along(df: DataFrame, v: str, axis: str, s: int) -> DataFrame:
    """Largest of 2s+1: running maxima forward and backward inside blocks of that
    length, so each pixel is touched a fixed number of times."""
    width = 2 * s + 1
    lane = _lane(axis)
    wide, own = _stretched(_mirrored(df, axis, s, s), axis, s, s)
    # A block cut by the end of a stretch still has all that the stretch's own pixels ask of it.
    wide = spread(wide, "raster_id", AXES[axis][0], "_chunk").withColumn("_blk", F.floor((F.col(axis) + s) / width))
    block = Window.partitionBy("raster_id", AXES[axis][0], "_chunk", "_blk")
    to_here = Window.unboundedPreceding, 0
    wide = wide.withColumn("_fwd", F.max(v).over(block.orderBy(axis).rowsBetween(*to_here)))
    wide = wide.withColumn("_bwd", F.max(v).over(block.orderBy(F.desc(axis)).rowsBetween(*to_here)))
    wide = wide.withColumn(v, F.greatest(F.lag("_bwd", s).over(lane), F.lead("_fwd", s).over(lane)))
    return wide.filter(_inside(axis) & own).drop("_chunk", "_blk", "_fwd", "_bwd")


def box_max(df: DataFrame, meta: DataFrame, value: str, s: int, name: str = "box_max") -> DataFrame:
    """Largest value of the (2s+1) x (2s+1) square around each pixel."""
    out = with_size(df.withColumn(name, F.col(value)), meta)
    for axis in ("col", "row"):
        out = _max_along(out, name, axis, s)
    return out.drop("height", "width")


def laplace(df: DataFrame, value: Column, name: str = "laplace") -> DataFrame:
    """Four-neighbour Laplacian; a missing neighbour counts as the pixel itself."""
    out = df.withColumn("_v", value)
    for axis in ("row", "col"):
        out, own = _stretched(out, axis, 1, 1)
        around = [F.coalesce(_next_to(step, "_v", axis), F.col("_v")) for step in (-1, 1)]
        out = out.withColumn(f"_{axis}", around[0] + around[1]).filter(own).drop("_chunk")
    return out.withColumn(name, F.col("_row") + F.col("_col") - 4 * F.col("_v")).drop("_v", "_row", "_col")


def sharp_mask(
    df: DataFrame, meta: DataFrame, grey: Column, win: int = BLUR_WINDOW_PX,
    variance_min: float = BLUR_VARIANCE_MIN,
) -> DataFrame:
    """Adds ``sharp``: the Laplacian varies enough around the pixel."""
    out = laplace(df, grey, "_lap").withColumn("_lap2", F.col("_lap") * F.col("_lap"))
    out = box_mean(out, meta, win, _m="_lap", _m2="_lap2")
    variance = F.col("_m2") - F.col("_m") * F.col("_m")
    return out.withColumn("sharp", variance > variance_min).drop("_lap", "_lap2", "_m", "_m2")


def margin_of(s: int) -> int:
    return max(LEAST_MARGIN_PX, s // 4)


def core_mask(df: DataFrame, meta: DataFrame, margin: int) -> DataFrame:
    """Pixels farther than ``margin`` from every invalid pixel and from the rim.

    Only invalid pixels that touch a valid one can be nearest, so only these
    are widened. Each is widened along its row first; the reach up and down at
    that offset then is an interval, and a running count over the column tells
    which pixels some interval covers.
    """
    sized = with_size(df, meta)
    edge = sized
    for axis in ("row", "col"):
        edge, own = _stretched(edge, axis, 1, 1)
        touches = F.coalesce(_next_to(-1, "valid", axis), F.lit(False)) | F.coalesce(_next_to(1, "valid", axis), F.lit(False))
        edge = edge.withColumn(f"_t_{axis}", touches).filter(own).drop("_chunk")
    edge = edge.filter(~F.col("valid") & (F.col("_t_row") | F.col("_t_col")))
    offsets = F.array(*[
        F.struct(F.lit(dx).alias("dx"), F.lit(math.isqrt(margin * margin - dx * dx)).alias("up"))
        for dx in range(-margin, margin + 1)
    ])
    spans = edge.select("raster_id", "row", "col", F.explode(offsets).alias("o")).select(
        "raster_id", (F.col("col") + F.col("o.dx")).alias("col"),
        F.greatest(F.lit(0), F.col("row") - F.col("o.up")).alias("first"), (F.col("row") + F.col("o.up") + 1).alias("stop"))
    # An interval is cut where a stretch of the column ends, since counts start anew there.
    size = max(LANE, 4 * margin)
    stretch = F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("stop") - 1) / size)))
    cut = spans.withColumn("_chunk", stretch)
    ends = F.array_compact(F.array(
        F.struct(F.greatest(F.col("first"), F.col("_chunk") * size).cast("int").alias("row"), F.lit(1).alias("_d")),
        F.when(F.col("stop") < (F.col("_chunk") + 1) * size, F.struct(F.col("stop").cast("int").alias("row"), F.lit(-1).alias("_d")))))
    marks = cut.select("raster_id", "col", F.inline(ends)).groupBy("raster_id", "col", "row").agg(F.sum("_d").alias("_d"))
    counted = sized.join(marks, ["raster_id", "row", "col"], "left").withColumn("_chunk", F.floor(F.col("row") / size)).withColumn(
        "_cover", F.sum(F.coalesce("_d", F.lit(0))).over(_lane("row").rowsBetween(Window.unboundedPreceding, 0)))
    rim = (
        F.col("row").between(margin, F.col("height") - margin - 1)
        & F.col("col").between(margin, F.col("width") - margin - 1)
    )
    return counted.withColumn("core", F.col("valid") & (F.col("_cover") == 0) & rim).drop("_d", "_chunk", "_cover", "height", "width")


def local_maxima(
    df: DataFrame, min_smooth: float, min_density: float, signal: str = "signal",
    box: str = "box_max", density: str = "density", sharp: str | None = None,
) -> DataFrame:
    keep = (
        (F.col(signal) == F.col(box)) & F.col("core")
        & (F.col(signal) > min_smooth) & (F.col(density) > min_density)
    )
    return df.filter(keep & F.col(sharp) if sharp else keep)


def refine_centroid(peaks: DataFrame, pixels: DataFrame, meta: DataFrame, radius: int, tile: int = 512) -> DataFrame:
    """Move ``fid, raster_id, row, col`` to the weighted vegetation centroid.

    ``pixels`` holds ``raster_id, row, col, exg, veg``. A peak without weight stays
    where it is."""
    return refine_peaks(peaks.withColumn("radius", F.lit(radius)), pixels, meta, radius, tile).drop("radius", "valid")


def refine_peaks(peaks: DataFrame, pixels: DataFrame, meta: DataFrame, most: int, tile: int = 512) -> DataFrame:
    """``refine_centroid`` with a ``radius`` (up to ``most``) for each peak, and ``valid``: whether the place moved to is.

    ``pixels``: a pixel or tile table with ``exg, veg`` and, for ``valid``, that band.
    One exchange of the raster serves all peaks: a tile has a rim as wide as the
    largest radius and meets its own peaks only."""
    tile = max(tile, 2 * most)
    bands = ["exg", "veg"] + (["valid"] if "valid" in pixels.columns else [])
    keys = ["raster_id", "_tr", "_tc", "height", "width"]
    slim = pixels.select(*(TILE if is_tiles(pixels) else ["raster_id", "row", "col"]), *bands)
    raster = tiled(slim, meta, tile, most)
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    # Written out: both sides may come from the same raster, and the cogroup must tell their columns apart.
    asked = materialize(with_size(peaks.select("raster_id", "row", "col", "radius").distinct(), meta).withColumn("_tr", at("row")).withColumn("_tc", at("col")))

    def kernel(key: tuple, own: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        frame = Frame(key, tile, most)
        exg = frame.grid(pdf, "exg", float)
        weight = np.where(frame.grid(pdf, "veg", bool) & (exg > 0), exg, 0.0)
        valid = frame.grid(pdf, "valid", bool) if "valid" in pdf.columns else None
        r0, c0 = max(0, frame.row0 - most), max(0, frame.col0 - most)
        out = []
        for row, col, radius in zip(own["row"].tolist(), own["col"].tolist(), own["radius"].tolist(), strict=True):
            top, left = max(r0, row - radius), max(c0, col - radius)
            w = weight[top - r0:row + radius + 1 - r0, left - c0:col + radius + 1 - c0]
            dr, dc = np.arange(top, top + w.shape[0]) - row, np.arange(left, left + w.shape[1]) - col
            w = w * np.exp(-(dr[:, None] ** 2 + dc[None, :] ** 2) / (2 * (radius / 2.0) ** 2)) if radius else w
            total = w.sum()
            to = (row, col) if not total > 0 else (int(np.rint((w.sum(1) @ (dr + row)) / total)), int(np.rint((w.sum(0) @ (dc + col)) / total)))
            out.append((key[0], row, col, radius, *to, bool(valid[to[0] - r0, to[1] - c0]) if valid is not None else None))
        return pd.DataFrame(out, columns=["raster_id", "row", "col", "radius", "_row", "_col", "valid"])

    moved = spread(asked, *keys).groupBy(*keys).cogroup(raster.groupBy(*keys)).applyInPandas(
        kernel, "raster_id string, row int, col int, radius int, _row int, _col int, valid boolean")
    kinds = dict(peaks.dtypes)
    place = [F.col(f"_{c}").cast(kinds[c]).alias(c) for c in ("row", "col")]
    return peaks.join(moved, ["raster_id", "row", "col", "radius"]).select(
        *[c for c in peaks.columns if c not in ("row", "col")], *place, "valid")


def slope(dem: DataFrame, px_size: float) -> DataFrame:
    """Percent rise by the 3 x 3 Horn gradient; null without eight neighbours."""
    rows, own = _stretched(dem, "col", 1, 1)
    west, east = _next_to(-1, "v", "col"), _next_to(1, "v", "col")
    rows = rows.withColumn("_dx", east - west).withColumn("_sy", west + 2 * F.col("v") + east).filter(own).drop("_chunk")
    rows, own = _stretched(rows, "row", 1, 1)
    rows = rows.withColumns({
        "_gx": _next_to(-1, "_dx", "row") + 2 * F.col("_dx") + _next_to(1, "_dx", "row"),
        "_gy": _next_to(1, "_sy", "row") - _next_to(-1, "_sy", "row")}).filter(own).drop("_chunk")
    dx, dy = F.col("_gx"), F.col("_gy")
    unit = F.lit(8.0 * px_size)
    return rows.withColumn("slope", 100.0 * F.sqrt((dx / unit) * (dx / unit) + (dy / unit) * (dy / unit))).drop("_dx", "_sy", "_gx", "_gy")


def segment_mean(df: DataFrame, threshold: float) -> DataFrame:
    """Cleared if the segment's mean greenness is low; label -1 is outside.

    ``df`` has ``raster_id, label, exg, valid``."""
    means = df.filter("label >= 0").groupBy("raster_id", "label").agg(F.avg("exg").alias("segment_exg"))
    return (
        df.join(means, ["raster_id", "label"], "left")
        .withColumn("cleared", F.col("valid") & F.coalesce(F.col("segment_exg") < threshold, F.lit(False)))
    )


def grid_objects(df: DataFrame, meta: DataFrame, px: int = 20) -> DataFrame:
    """Square objects of px x px as segment labels; invalid pixels get -1."""
    sized = with_size(df, meta)
    across = F.ceil(F.col("width") / px)
    label = F.floor(F.col("row") / px) * across + F.floor(F.col("col") / px)
    return sized.withColumn("label", F.when(F.col("valid"), label).otherwise(F.lit(-1)).cast("long")).drop("height", "width")


# ---- tiles with a halo ------------------------------------------------------

class Frame:
    """Where a tile lies: its core, its halo and the raster around it."""

    def __init__(self, key: tuple, tile: int, halo: int):
        self.raster_id, tr, tc, self.height, self.width = key
        self.row0, self.col0 = tr * tile, tc * tile
        self.row1, self.col1 = min(self.row0 + tile, self.height), min(self.col0 + tile, self.width)
        self.halo = halo

    def grid(self, pdf: pd.DataFrame, value: str | None, dtype: type) -> np.ndarray:
        """Values on the raster part of the window; missing cells are 0."""
        r0, c0 = max(0, self.row0 - self.halo), max(0, self.col0 - self.halo)
        r1, c1 = min(self.height, self.row1 + self.halo), min(self.width, self.col1 + self.halo)
        out = np.zeros((r1 - r0, c1 - c0), dtype=dtype)
        if "h" in pdf.columns:
            for r, c, h, w, v in zip(pdf["row"], pdf["col"], pdf["h"], pdf["w"], pdf[value]):
                # Nulls are cells that aren't there.
                known = np.asarray(v, dtype=float)
                out[r - r0:r - r0 + h, c - c0:c - c0 + w] = np.nan_to_num(known, nan=0.0).astype(dtype).reshape(h, w)
            return out
        out[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = 1 if value is None else pdf[value].to_numpy()
        return out

    def _overhang(self) -> tuple:
        h = self.halo
        return (
            (max(0, h - self.row0), max(0, self.row1 + h - self.height)),
            (max(0, h - self.col0), max(0, self.col1 + h - self.width)),
        )

    def mirrored(self, pdf: pd.DataFrame, value: str, dtype: type = np.float64) -> np.ndarray:
        return np.pad(self.grid(pdf, value, dtype), self._overhang(), mode="symmetric")

    def padded(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """A mask on the full window and where that window is raster."""
        mask = self.grid(pdf, None, bool)
        over = self._overhang()
        return np.pad(mask, over), np.pad(np.ones_like(mask), over)

    def core(self, window: np.ndarray) -> np.ndarray:
        h = self.halo
        return window[h:h + self.row1 - self.row0, h:h + self.col1 - self.col0]

    def cells(self, mask: np.ndarray, **values: np.ndarray) -> pd.DataFrame:
        """The true cells of a core-sized mask as rows."""
        r, c = np.nonzero(mask)
        data = {"raster_id": self.raster_id, "row": (r + self.row0).astype("int32"), "col": (c + self.col0).astype("int32")}
        data.update({k: v[r, c] for k, v in values.items()})
        return pd.DataFrame(data)


def _rectangles(tiles: DataFrame, tile: int, halo: int) -> DataFrame:
    """The part of each stored tile that a kernel tile or its halo needs."""
    def targets(first: str, size: str, end: str) -> Column:
        lo = F.greatest(F.lit(0), F.floor((F.col(first) - halo) / tile).cast("int"))
        hi = F.least(F.floor((F.col(end) - 1) / tile), F.floor((F.col(first) + F.col(size) - 1 + halo) / tile)).cast("int")
        return F.explode(F.sequence(lo, hi))

    def bounds(first: str, size: str, target: str) -> tuple[Column, Column]:
        start = F.greatest(F.col(first), F.col(target) * tile - halo)
        stop = F.least(F.col(first) + F.col(size), (F.col(target) + 1) * tile + halo)
        return start.cast("int"), stop.cast("int")

    aimed = tiles.withColumn("_tr", targets("row0", "h", "height")).withColumn("_tc", targets("col0", "w", "width"))
    (ra, rb), (ca, cb) = bounds("row0", "h", "_tr"), bounds("col0", "w", "_tc")
    cut = aimed.withColumn("_ra", ra).withColumn("_rb", rb).withColumn("_ca", ca).withColumn("_cb", cb).filter("_ra < _rb AND _ca < _cb")
    # The stored width under its own name: inside a lambda "w" would be the new column below.
    cut = cut.withColumn("_stride", F.col("w"))
    whole = (F.col("_cb") - F.col("_ca") == F.col("w")) & (F.col("_rb") - F.col("_ra") == F.col("h"))

    def part(band: str) -> Column:
        line = lambda r: F.slice(F.col(band), (r - F.col("row0")) * F.col("_stride") + (F.col("_ca") - F.col("col0")) + 1, F.col("_cb") - F.col("_ca"))
        return F.when(whole, F.col(band)).otherwise(F.flatten(F.transform(F.sequence(F.col("_ra"), F.col("_rb") - 1), line)))

    bands = [c for c in tiles.columns if c not in TILE and c not in ("height", "width")]
    return cut.select(
        "raster_id", "_tr", "_tc", "height", "width", F.col("_ra").alias("row"), F.col("_ca").alias("col"),
        (F.col("_rb") - F.col("_ra")).alias("h"), (F.col("_cb") - F.col("_ca")).alias("w"), *[part(b).alias(b) for b in bands])


def tiled(df: DataFrame, meta: DataFrame, tile: int, halo: int) -> DataFrame:
    """Cells with the tile (``_tr, _tc``) whose kernel needs them, dealt out by tile.

    A tile table is exchanged as rectangles of bare values, which is several times
    less to shuffle than rows of pixels."""
    sized = with_size(df, meta)
    keys = ["raster_id", "_tr", "_tc", "height", "width"]
    if is_tiles(df):
        return spread(_rectangles(sized, tile, halo), *keys)

    def tiles(axis: str, size: str) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(axis) - halo) / tile).cast("int"))
        last = F.least(F.floor((F.col(size) - 1) / tile), F.floor((F.col(axis) + halo) / tile)).cast("int")
        return F.explode(F.sequence(first, last))

    return spread(sized.withColumn("_tr", tiles("row", "height")).withColumn("_tc", tiles("col", "width")), *keys)


def over_tiles(
    df: DataFrame, meta: DataFrame, tile: int, halo: int, schema: str,
    kernel: Callable[[Frame, pd.DataFrame], pd.DataFrame],
) -> DataFrame:
    """Run a numpy kernel per tile on the tile's cells and those within ``halo``.

    Groups are bounded by (tile + 2 halo) squared cells whatever the raster."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return kernel(Frame(key, tile, halo), pdf)

    return tiled(df, meta, tile, halo).groupBy("raster_id", "_tr", "_tc", "height", "width").applyInPandas(run, schema)


def gaussian_taps(sigma: float) -> np.ndarray:
    """Normalised weights, cut at four sigma."""
    radius = int(4.0 * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * x * x / (sigma * sigma))
    return w / w.sum()


def band_matrix(taps: np.ndarray, out: int) -> np.ndarray:
    """Rows of shifted taps: a 'valid' convolution as one matrix product."""
    m = np.zeros((out, out + len(taps) - 1))
    for i in range(out):
        m[i, i:i + len(taps)] = taps
    return m


def smooth(window: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian that consumes its radius on each side.
    """
    taps = gaussian_taps(sigma)
    shrink = len(taps) - 1
    rows = band_matrix(taps, window.shape[0] - shrink)
    cols = rows if window.shape[0] == window.shape[1] else band_matrix(taps, window.shape[1] - shrink)
    return rows @ window @ cols.T


def gaussian(df: DataFrame, meta: DataFrame, value: str, sigma: float, tile: int = 512, name: str = "smooth") -> DataFrame:
    """``raster_id, row, col, <name>``: Gaussian of a cell value with mirrored edges."""
    halo = int(4.0 * sigma + 0.5)

    def kernel(frame: Frame, pdf: pd.DataFrame) -> pd.DataFrame:
        out = smooth(frame.mirrored(pdf, value), sigma)
        return frame.cells(np.ones(out.shape, dtype=bool), **{name: out})

    slim = map_bands(df, **{value: lambda of: of(value).cast("double")})
    return over_tiles(slim, meta, max(tile, 2 * halo), halo, f"raster_id string, row int, col int, {name} double", kernel)


def _box_sum(window: np.ndarray, k: int) -> np.ndarray:
    """k x k sums at every full placement."""
    s = np.cumsum(np.cumsum(np.pad(window, ((1, 0), (1, 0))), axis=0), axis=1)
    return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]


def _slide_max(a: np.ndarray, s: int) -> np.ndarray:
    """Largest of 2s+1 along the last axis at every full placement, by doubling."""
    width, have = 2 * s + 1, 1
    while 2 * have <= width:
        a, have = np.maximum(a[..., :-have], a[..., have:]), 2 * have
    rest = width - have
    return np.maximum(a[..., :a.shape[-1] - rest], a[..., rest:]) if rest else a


def _near_invalid(invalid: np.ndarray, margin: int) -> np.ndarray:
    """Cells within ``margin`` of an invalid cell, at every full placement."""
    rows, cols = invalid.shape[0] - 2 * margin, invalid.shape[1] - 2 * margin
    near = np.zeros((rows, cols), dtype=bool)
    if not invalid.any():
        return near
    total = np.cumsum(np.pad(invalid.astype(np.int32), ((1, 0), (0, 0))), axis=0)
    for dx in range(-margin, margin + 1):
        up = math.isqrt(margin * margin - dx * dx)
        part = total[:, margin + dx:margin + dx + cols]
        near |= part[margin + up + 1:margin + up + 1 + rows] > part[margin - up:margin - up + rows]
    return near


def peak_cells(
    pixels: DataFrame, meta: DataFrame, scales: list[int], min_smooth: float, min_density: float,
    blur_window: int | None = None, tile: int = 512,
) -> DataFrame:
    """All peak gates of all scales in one pass over haloed tiles.

    ``pixels``: a pixel or tile table of ``exg, veg, valid, grey``. Emits only the
    peaks: ``raster_id, row, col, sigma``. Same result as gaussian, box_mean,
    box_max, core_mask and local_maxima one after the other, with one shuffle.
    """
    halo = max(int(4.0 * s + 0.5) + s for s in scales)
    halo = max([halo, (blur_window or 0) + 2] + [margin_of(s) for s in scales])
    wanted = dict(
        exg=lambda of: F.when(of("veg"), of("exg")).otherwise(0.0), veg=lambda of: of("veg").cast("byte"),
        valid=lambda of: of("valid").cast("byte"))
    if blur_window:
        wanted["grey"] = lambda of: of("grey")
    slim = map_bands(pixels, **wanted)

    def inner(window: np.ndarray, frame: Frame, reach: int, odd: int = 0) -> np.ndarray:
        """The window cut down to the core plus ``reach`` cells on each side."""
        cut = frame.halo - reach
        return window[cut:window.shape[0] - cut - odd, cut:window.shape[1] - cut - odd]

    def box_mean_core(window: np.ndarray, frame: Frame, k: int) -> np.ndarray:
        lo, hi = k // 2, k - 1 - k // 2
        return _box_sum(inner(window, frame, lo, lo - hi), k) / (k * k)

    def kernel(frame: Frame, pdf: pd.DataFrame) -> pd.DataFrame:
        exg = frame.mirrored(pdf, "exg")
        veg = frame.mirrored(pdf, "veg", np.float64)
        # Beyond the raster nothing counts as invalid; the rim rule covers it.
        invalid = np.pad(frame.grid(pdf, "valid", np.uint8) == 0, frame._overhang())
        sharp = None
        if blur_window:
            grey = frame.mirrored(pdf, "grey")
            lap = np.zeros_like(grey)
            lap[1:-1, 1:-1] = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4 * grey[1:-1, 1:-1]
            mean = box_mean_core(lap, frame, blur_window)
            sharp = box_mean_core(lap * lap, frame, blur_window) - mean**2 > BLUR_VARIANCE_MIN
        rows = np.arange(frame.row0, frame.row1)[:, None]
        cols = np.arange(frame.col0, frame.col1)[None, :]
        parts = []
        for s in scales:
            # Rounded, so that equal values stay equal whatever window they were cut from.
            around = np.round(smooth(inner(exg, frame, int(4.0 * s + 0.5) + s), s), 9)
            top = _slide_max(_slide_max(around, s).T, s).T
            signal = around[s:around.shape[0] - s, s:around.shape[1] - s]
            m = margin_of(s)
            rim = (rows >= m) & (rows < frame.height - m) & (cols >= m) & (cols < frame.width - m)
            keep = (signal == top) & (signal > min_smooth) & rim & ~frame.core(invalid)
            keep &= ~_near_invalid(inner(invalid, frame, m), m)
            keep &= box_mean_core(veg, frame, 3 * s) > min_density
            if sharp is not None:
                keep &= sharp
            found = frame.cells(keep)
            found["sigma"] = np.int32(s)
            parts.append(found)
        return pd.concat(parts, ignore_index=True)

    return over_tiles(slim, meta, max(tile, 2 * halo), halo, "raster_id string, row int, col int, sigma int", kernel)


# ---- morphology on sparse masks --------------------------------------------

def _cross(a: np.ndarray, inside: np.ndarray, grow: bool) -> np.ndarray:
    """One step of a 3 x 3 cross; everything outside the raster stays 0."""
    p = np.pad(a, 1)
    near = (p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:])
    out = a.copy()
    for n in near:
        out = out | n if grow else out & n
    return out & inside


def morphology(mask: DataFrame, meta: DataFrame, steps: list[tuple[str, int]], tile: int = 512) -> DataFrame:
    """A chain such as [("erode", 6), ("dilate", 6)] on sparse mask cells.

    The halo is the sum of all steps, so the chain needs one exchange only."""
    halo = sum(n for _, n in steps)

    def kernel(frame: Frame, pdf: pd.DataFrame) -> pd.DataFrame:
        a, inside = frame.padded(pdf)
        for what, n in steps:
            for _ in range(n):
                a = _cross(a, inside, what == "dilate")
        return frame.cells(frame.core(a))

    return over_tiles(mask.select("raster_id", "row", "col"), meta, max(tile, 2 * halo), halo, "raster_id string, row int, col int", kernel)


def erode(mask: DataFrame, meta: DataFrame, n: int = 1) -> DataFrame:
    return morphology(mask, meta, [("erode", n)])


def dilate(mask: DataFrame, meta: DataFrame, n: int = 1) -> DataFrame:
    return morphology(mask, meta, [("dilate", n)])


def opening(mask: DataFrame, meta: DataFrame, n: int) -> DataFrame:
    return morphology(mask, meta, [("erode", n), ("dilate", n)])


def closing(mask: DataFrame, meta: DataFrame, n: int) -> DataFrame:
    return morphology(mask, meta, [("dilate", n), ("erode", n)])


def mask_minus(mask: DataFrame, other: DataFrame) -> DataFrame:
    return mask.join(other.select("raster_id", "row", "col"), ["raster_id", "row", "col"], "left_anti")


def remove_wide(mask: DataFrame, meta: DataFrame, width_px: int) -> DataFrame:
    """Only the parts narrower than ``width_px``; 0 leaves the mask as it is."""
    if width_px <= 0:
        return mask
    r = max(1, width_px // 2)
    wide = morphology(mask, meta, [("erode", r), ("dilate", 2 * r)])
    return mask_minus(mask, wide)


def _thin_pass(a: np.ndarray, first: bool) -> np.ndarray:
    """One half step of parallel thinning (Zhang and Suen, 1984)."""
    p = np.pad(a, 1).astype(np.int8)
    n, ne, e, se = p[:-2, 1:-1], p[:-2, 2:], p[1:-1, 2:], p[2:, 2:]
    s, sw, w, nw = p[2:, 1:-1], p[2:, :-2], p[1:-1, :-2], p[:-2, :-2]
    ring = (n, ne, e, se, s, sw, w, nw)
    count = sum(ring)
    rises = sum(((x == 0) & (y == 1)).astype(np.int8) for x, y in zip(ring, ring[1:] + ring[:1]))
    corner = (n * e * s == 0) & (e * s * w == 0) if first else (n * e * w == 0) & (n * s * w == 0)
    return a & ~((count >= 2) & (count <= 6) & (rises == 1) & corner)


def thin(mask: DataFrame, meta: DataFrame, tile: int = 512, steps: int = 32) -> DataFrame:
    """Centre lines of a mask.

    Each exchange carries a halo of two cells per full step and runs that many
    steps; the mask only shrinks, so an unchanged count means it is done."""
    halo = 2 * steps

    def kernel(frame: Frame, pdf: pd.DataFrame) -> pd.DataFrame:
        a, _ = frame.padded(pdf)
        for _ in range(steps):
            b = _thin_pass(_thin_pass(a, True), False)
            if (a == b).all():
                break
            a = b
        return frame.cells(frame.core(a))

    current = materialize(mask.select("raster_id", "row", "col"))
    size = current.count()
    while size > 0:
        current = materialize(over_tiles(current, meta, max(tile, 2 * halo), halo, "raster_id string, row int, col int", kernel))
        after = current.count()
        if after == size:
            break
        size = after
    return current
