"""Field tables: species, volume, biomass, slivers, photos, run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.geometry import pin, ring_area, ring_perimeter, signed_area, thinness
from sylva.operators.numbering import medians
from sylva.operators.raster import in_metres
from sylva.session import materialize

# Biomass and sliver factors, accessibility bands.
WOOD_DENSITY = 600.0
EXPANSION = 1.5
ROOT_SHOOT = 0.37
CARBON_FRACTION = 0.47
CARBON_TO_CO2E = 3.667
SLIVER_AREA_FRACTION = 0.1
SLIVER_THINNESS_FRACTION = 0.5
SLOPE_BANDS = ((15, "easy"), (25, "moderate"), (40, "difficult"))
STEEPEST_BAND = "restricted"
HISTORY_KEPT = 200

_LOOSE = {
    "volume": lambda n: n.startswith("volume"),
    "species": lambda n: "species" in n or "jenis" in n,
    "name": lambda n: "name" in n,
}


def find_column(df: DataFrame, kind: str) -> str | None:
    """First column whose name fits loosely, ignoring case."""
    return next((c for c in df.columns if _LOOSE[kind](c.lower())), None)


def _need(df: DataFrame, kind: str) -> str:
    found = find_column(df, kind)
    if found is None:
        raise ValueError(f"the layer has no {kind} column")
    return found


def biomass(df: DataFrame, wd: float = WOOD_DENSITY, bef: float = EXPANSION, rsr: float = ROOT_SHOOT, cf: float = CARBON_FRACTION) -> DataFrame:
    volume = F.col(_need(df, "volume"))
    kg = volume * wd * bef * (1 + rsr)
    return df.withColumn("Biomass_kg", kg).withColumn("Carbon_kg", F.col("Biomass_kg") * cf)


def biomass_total(df: DataFrame, wd: float = WOOD_DENSITY, bef: float = EXPANSION, rsr: float = ROOT_SHOOT, cf: float = CARBON_FRACTION) -> DataFrame:
    volume = F.coalesce(F.sum(_need(df, "volume")), F.lit(0.0))
    return (
        df.agg(volume.alias("volume_m3"))
        .withColumn("biomass_kg", F.col("volume_m3") * wd * bef * (1 + rsr))
        .withColumn("carbon_kg", F.col("biomass_kg") * cf)
        .withColumn("co2e_kg", F.col("carbon_kg") * CARBON_TO_CO2E)
    )


def species_summary(df: DataFrame) -> DataFrame:
    species, volume = _need(df, "species"), _need(df, "volume")
    return df.groupBy(F.col(species).alias("species")).agg(
        F.sum(volume).alias("sum_volume"), F.count(volume).alias("count_volume"))


def import_summary(df: DataFrame) -> DataFrame:
    volume = find_column(df, "volume")
    total = F.coalesce(F.sum(volume), F.lit(0.0)) if volume else F.lit(0.0)
    return df.agg(F.count("*").alias("tree_count"), total.alias("total_volume"))


def slope_class(percent: Column) -> Column:
    out = F.when(percent.isNull(), None)
    for bound, name in SLOPE_BANDS:
        out = out.when(percent <= bound, name)
    return out.otherwise(STEEPEST_BAND)


def confirmed(rows: DataFrame) -> DataFrame:
    """Reviewed photo rows that become points; Include defaults to a full fix."""
    full = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("wkid").isNotNull()
    return rows.filter(F.coalesce(F.col("include"), full) & full)


def identify(points: DataFrame, photos: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points in an envelope with the first attachment of each; none, no row."""
    hit = points.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    first = (
        hit.select("fid").join(photos, "fid").groupBy("fid")
        .agg(F.min(F.struct("attachment_id", "photo_path")).alias("_a"))
    )
    return hit.join(first, "fid").select("fid", "x", "y", F.col("_a.attachment_id").alias("attachment_id"), F.col("_a.photo_path").alias("photo_path"))


def attach_photos(points: DataFrame, photos: DataFrame) -> DataFrame:
    return points.join(photos, "photo_path", "left")


def pair_by_stem(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with the label file of the same stem; of several labels the first by name."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    firsts = labels.groupBy(stem("name").alias("stem")).agg(F.min("name").alias("label_name"))
    return images.select(stem("name").alias("stem"), F.col("name").alias("image_name")).join(firsts, "stem")


def require_pairs(pairs: DataFrame) -> DataFrame:
    if pairs.isEmpty():
        raise ValueError("no image has a label file of the same name")
    return pairs


def ring_measures(rings: DataFrame) -> DataFrame:
    """Area, length and thinness per ring; rings without length are skipped."""
    return (
        pin(rings.drop("area", "length", "thinness"), area=ring_area(F.col("pts")), length=ring_perimeter(F.col("pts")))
        .filter("length > 0").withColumn("thinness", thinness(F.col("area"), F.col("length")))
    )


def slivers(rings: DataFrame) -> DataFrame:
    """``fid, sliver_area`` of features with a suspicious part, with the medians and
    limits used. Two passes: both exact medians first, then one filter."""
    parts = materialize(ring_measures(rings).select("fid", "area", "thinness"))
    limits = medians(parts, median_area=F.col("area"), median_thinness=F.col("thinness")).select(
        F.lit(1).alias("_one"), "median_area", (F.col("median_area") * SLIVER_AREA_FRACTION).alias("area_limit"),
        "median_thinness", (F.col("median_thinness") * SLIVER_THINNESS_FRACTION).alias("thinness_limit"))
    # One row.
    judged = parts.withColumn("_one", F.lit(1)).join(F.broadcast(limits), "_one")
    found = ["median_area", "area_limit", "median_thinness", "thinness_limit"]
    return (
        judged.filter((F.col("area") < F.col("area_limit")) | (F.col("thinness") < F.col("thinness_limit")))
        .groupBy("fid").agg(F.sum("area").alias("sliver_area"), *[F.first(c).alias(c) for c in found]))


def largest_ring(rings: DataFrame) -> DataFrame:
    """Adds ``outer``: the ring with the largest absolute area of each feature."""
    sized = pin(rings.filter(F.size("pts") >= 3), _a=F.abs(signed_area(F.col("pts"))))
    top = sized.groupBy("fid").agg(F.min(F.struct((-F.col("_a")).alias("a"), "part")).alias("_t")).select("fid", F.col("_t.part").alias("_top"))
    return sized.join(top, "fid").withColumn("outer", F.col("part") == F.col("_top")).drop("_a", "_top")


def longest_part(lines: DataFrame) -> DataFrame:
    """The longest part of each multipart line, the first on a tie."""
    return lines.groupBy("fid").agg(F.min(F.struct((-F.col("length")).alias("l"), "part", "path")).alias("_b")).select(
        "fid", F.col("_b.part").alias("part"), (-F.col("_b.l")).alias("length"), F.col("_b.path").alias("path"))


def run_history(log: DataFrame, n: int = HISTORY_KEPT, tie: list[str] | None = None) -> DataFrame:
    """Newest n entries; a top-k report, so the limit is the feature."""
    shown = log.filter(F.col("message").isNotNull() & (F.col("message") != ""))
    return shown.orderBy(F.desc("ts"), *[F.desc(c) for c in tie or []]).limit(n)


def bbox(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    aggs = [f(a).alias(f"{a}{n}") for a in ("x", "y") for f, n in ((F.min, "min"), (F.max, "max"))]
    return points.groupBy(*by).agg(*aggs) if by else points.agg(*aggs)


def area_ha(regions: DataFrame) -> DataFrame:
    return regions.agg(F.count("*").alias("polygon_count"), (F.coalesce(F.sum("area"), F.lit(0.0)) / 10000.0).alias("area_ha"))


def scan_area_ha(meta: DataFrame) -> DataFrame:
    """Area of each raster; cells in degrees count in metres."""
    return in_metres(meta).select("raster_id", (F.col("width") * F.col("height") * F.col("px_m") * F.col("px_m") / 10000.0).alias("area_ha"))


def sample_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("cls").agg(F.count("*").alias("n"))


# ---- checks before a plan is built ------------------------------------------

def require_bands(bands: int) -> None:
    if bands < 3:
        raise ValueError("a raster needs at least 3 bands (RGB)")


def require_dem(bands: int) -> None:
    if bands != 1:
        raise ValueError(f"an elevation raster has one band, this one has {bands}")


def require_projected(wkid: int | None) -> None:
    if wkid is None or wkid == 4326:
        raise ValueError("distances need a projected coordinate system")


def require_different(a: str, b: str) -> None:
    if a == b:
        raise ValueError("choose two different layers")
