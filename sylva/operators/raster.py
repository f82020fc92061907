"""Windows, tiles and scan grids of pixel tables ``raster_id, row, col, ...``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.bands import metres_per_px

# Detector and mask-model scan windows, in pixels.
DETECTOR_WINDOW = 1024
DETECTOR_OVERLAP = 200
DETECTOR_LEAST_WINDOW = 256
DETECTOR_LEAST_CROP = 64
DETECTOR_INPUT = 640.0
MASK_WINDOW = 512
MASK_OVERLAP = 64

BANDS = ["r", "g", "b", "alpha"]


def read_rows(pixels: DataFrame, y0: int, h: int) -> DataFrame:
    """A horizontal strip; rows below the raster simply are not there."""
    return pixels.filter(F.col("row").between(y0, y0 + h - 1))


def read_window(pixels: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    return read_rows(pixels, y0, h).filter(F.col("col").between(x0, x0 + w - 1))


def to_tiles(pixels: DataFrame, size: int = 256, bands: list[str] | None = None) -> DataFrame:
    """One row per tile with its bands as row-major arrays; a tile is a bounded group.

    Cells that aren't there, in a tile's box, are null in all bands."""
    bands = bands or BANDS
    cell = F.array_sort(F.collect_list(F.struct("row", "col", *bands)))
    tiles = (
        pixels.groupBy(
            "raster_id",
            F.floor(F.col("row") / size).cast("int").alias("tile_row"),
            F.floor(F.col("col") / size).cast("int").alias("tile_col"),
        )
        .agg(cell.alias("_cells"))
    )
    ends = lambda f, name: f(F.transform("_cells", lambda c: c[name]))
    tiles = tiles.withColumns({"_r0": ends(F.array_min, "row"), "_c0": ends(F.array_min, "col"), "_w": ends(F.array_max, "col") - ends(F.array_min, "col") + 1, "_h": ends(F.array_max, "row") - ends(F.array_min, "row") + 1})
    at = F.transform("_cells", lambda c: (c["row"] - F.col("_r0")) * F.col("_w") + c["col"] - F.col("_c0"))
    absent = F.array_except(F.sequence(F.lit(0), F.col("_h") * F.col("_w") - 1), at)
    kinds = dict(pixels.dtypes)
    blank = lambda i: F.struct(
        (F.col("_r0") + F.floor(i / F.col("_w"))).cast(kinds["row"]).alias("row"), (F.col("_c0") + i % F.col("_w")).cast(kinds["col"]).alias("col"),
        *[F.lit(None).cast(kinds[b]).alias(b) for b in bands])
    tiles = tiles.withColumn("_cells", F.when(F.size("_cells") == F.col("_h") * F.col("_w"), F.col("_cells")).otherwise(
        F.array_sort(F.concat("_cells", F.transform(absent, blank)))))
    return tiles.select(
        "raster_id", "tile_row", "tile_col",
        ends(F.array_min, "row").alias("row0"), ends(F.array_min, "col").alias("col0"),
        (ends(F.array_max, "row") - ends(F.array_min, "row") + 1).alias("h"),
        (ends(F.array_max, "col") - ends(F.array_min, "col") + 1).alias("w"),
        *[F.col("_cells")[b].alias(b) for b in bands],
    )


def to_pixels(tiles: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """Cells with a value in some band."""
    bands = bands or BANDS
    return tiles.select(
        "raster_id", "row0", "col0", "w", F.posexplode(F.arrays_zip(*bands)).alias("_i", "_v")
    ).select(
        "raster_id",
        (F.col("row0") + F.floor(F.col("_i") / F.col("w"))).cast("int").alias("row"),
        (F.col("col0") + F.col("_i") % F.col("w")).cast("int").alias("col"),
        *[F.col("_v")[b].alias(b) for b in bands],
    ).filter(F.coalesce(*[F.when(F.col(b).isNotNull(), 1) for b in bands]).isNotNull())


#: Tiles along the side of a group that is stored together.
GROUP_TILES = 16


def grouped_tiles(tiles: DataFrame, group: int = GROUP_TILES) -> DataFrame:
    """Adds ``group_row, group_col``: the squares of tiles that are stored together."""
    return tiles.withColumn("group_row", F.floor(F.col("tile_row") / group).cast("int")).withColumn("group_col", F.floor(F.col("tile_col") / group).cast("int"))


def tiles_of_window(tiles: DataFrame, x0: int, y0: int, w: int, h: int, size: int = 256, group: int = GROUP_TILES) -> DataFrame:
    """Of a ``grouped_tiles`` table those that meet a window: by folder first, then by the tile numbers in the files."""
    hit = F.lit(True)
    for axis, start, length in (("row", y0, h), ("col", x0, w)):
        first, last = start // size, (start + length - 1) // size
        hit = hit & F.col(f"group_{axis}").between(first // group, last // group) & F.col(f"tile_{axis}").between(first, last)
    return tiles.filter(hit).drop("group_row", "group_col")


TILE = ["raster_id", "tile_row", "tile_col", "row0", "col0", "h", "w"]


def is_tiles(df: DataFrame) -> bool:
    return "tile_row" in df.columns


def as_pixels(df: DataFrame) -> DataFrame:
    return to_pixels(df, [c for c in df.columns if c not in TILE]) if is_tiles(df) else df


def map_bands(df: DataFrame, **made: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """New bands from old ones, for a pixel table or, element by element, for a
    tile table. ``map_bands(df, exg=exg)`` keeps the shape of its input."""
    if not is_tiles(df):
        return df.select("raster_id", "row", "col", *[fn(F.col).alias(name) for name, fn in made.items()])
    cells = F.arrays_zip(*[c for c in df.columns if c not in TILE])

    def over(fn: Callable) -> Column:
        return F.transform(cells, lambda p: fn(lambda band: p[band]))

    return df.select(*TILE, *[over(fn).alias(name) for name, fn in made.items()])


def _starts(size: Column, window: Column, stride: Column) -> Column:
    """0, stride, ... and one last window flush to the far edge."""
    room = F.greatest(size - window, F.lit(0))
    grid = F.sequence(F.lit(0), room, stride)
    flush = size - window
    return F.when(F.element_at(grid, -1) + window < size, F.concat(grid, F.array(flush))).otherwise(grid)


def _grid(meta: DataFrame, window: Column, stride: Column, least: int) -> DataFrame:
    placed = (
        meta.withColumn("_win", window.cast("int")).withColumn("_stride", stride.cast("int"))
        .withColumn("y0", F.explode(_starts(F.col("height"), F.col("_win"), F.col("_stride"))))
        .withColumn("x0", F.explode(_starts(F.col("width"), F.col("_win"), F.col("_stride"))))
    )
    return (
        placed.withColumn("w", F.least(F.col("_win"), F.col("width") - F.col("x0")))
        .withColumn("h", F.least(F.col("_win"), F.col("height") - F.col("y0")))
        .filter((F.col("w") >= least) & (F.col("h") >= least))
        .select("raster_id", "x0", "y0", "w", "h")
    )


def scan_windows(meta: DataFrame, scale: Column) -> DataFrame:
    """Overlapping detector windows of a fixed ground size."""
    window = F.greatest(F.lit(DETECTOR_LEAST_WINDOW), F.rint(DETECTOR_WINDOW * scale))
    overlap = F.rint(DETECTOR_OVERLAP * scale)
    return _grid(meta, window, F.greatest(F.lit(1), window - overlap), DETECTOR_LEAST_CROP)


def mask_windows(meta: DataFrame, window: int = MASK_WINDOW, overlap: int = MASK_OVERLAP) -> DataFrame:
    return _grid(meta, F.lit(window), F.lit(max(1, window - overlap)), 1)


def stitch_windows(probs: DataFrame) -> DataFrame:
    """Where windows overlap the later one, in y then x order, wins."""
    return probs.groupBy("raster_id", "row", "col").agg(
        F.max_by("prob", F.struct("y0", "x0")).alias("prob")
    )


def in_metres(meta: DataFrame) -> DataFrame:
    """``meta`` with ``px_m``: the cell size for scale and area, also where cells are in degrees."""
    return meta.withColumn("px_m", metres_per_px(F.col("px_size")))


def sizes_of(meta: DataFrame) -> list[float]:
    """Distinct cell sizes in metres; each gets kernels of its own size."""
    return [r[0] for r in in_metres(meta).select("px_m").distinct().orderBy("px_m").collect()]


def of_cell_size(meta: DataFrame, px_m: float) -> DataFrame:
    return in_metres(meta).filter(F.col("px_m") == px_m).drop("px_m")
