"""Text to coordinates, verdicts, names and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Coordinate patterns as printed by survey cameras.
UTM_WITH_ZONE = r"\b(\d{1,2})\s*([C-HJ-NP-Z])\s+(\d{5,7})\s+(\d{6,8})\b"
BARE_UTM = r"\b(\d{5,7})\s+(\d{6,8})\b"
DECIMAL_DEGREES = r"(-?\d{1,3}\.\d{3,8})\s*°?\s*([NSEW])?"

# Sample categories (code, English, Indonesian).
SAMPLE_CATEGORIES = [
    (1, "Forest canopy", "Hutan/kanopi rapat"),
    (2, "Low vegetation/regrowth", "Vegetasi rendah/regrowth"),
    (3, "Cleared/bare ground", "Bukaan/tanah terbuka"),
    (4, "Felled-tree debris", "Serpihan tebangan/kayu"),
    (5, "Road/track", "Jalan/jalur"),
    (6, "Water/river", "Sungai/air"),
    (7, "Shadow", "Bayangan"),
    (8, "Heavy equipment/vehicle", "Alat berat/kendaraan"),
    (9, "Building/roof", "Bangunan/atap"),
    (10, "Other/unsure", "Lainnya/tidak yakin"),
]


def _fix(x: Column, y: Column, wkid: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), wkid.cast("int").alias("wkid"))


def parse_utm(text: Column) -> Column:
    """First ``zone band easting northing``; bands up to M are south."""
    zone = F.regexp_extract(text, UTM_WITH_ZONE, 1)
    band = F.regexp_extract(text, UTM_WITH_ZONE, 2)
    number = zone.try_cast("int")
    base = F.when(band <= "M", 32700).otherwise(32600)
    return F.when(
        number.between(1, 60),
        _fix(
            F.regexp_extract(text, UTM_WITH_ZONE, 3).try_cast("double"),
            F.regexp_extract(text, UTM_WITH_ZONE, 4).try_cast("double"),
            base + number,
        ),
    )


def parse_bare_utm(text: Column, zone: int, south: bool) -> Column:
    """First ``easting northing`` in the zone the caller names."""
    easting = F.regexp_extract(text, BARE_UTM, 1)
    return F.when(
        easting != "",
        _fix(
            easting.try_cast("double"),
            F.regexp_extract(text, BARE_UTM, 2).try_cast("double"),
            F.lit((32700 if south else 32600) + zone),
        ),
    )


def parse_grid(text: Column, zone: int, south: bool) -> Column:
    return F.coalesce(parse_utm(text), parse_bare_utm(text, zone, south))


def parse_latlon(text: Column) -> Column:
    """First plausible latitude, then first plausible longitude, in reading order."""
    numbers = F.regexp_extract_all(text, F.lit(DECIMAL_DEGREES), F.lit(1))
    letters = F.regexp_extract_all(text, F.lit(DECIMAL_DEGREES), F.lit(2))

    def signed(number: Column, letter: Column) -> Column:
        value = number.cast("double")
        return F.when(letter.isin("S", "W"), -F.abs(value)).otherwise(value)

    none = F.lit(None).cast("double")
    start = F.struct(none.alias("lat"), none.alias("lon"))

    def take(acc: Column, v: Column) -> Column:
        is_lat = acc["lat"].isNull() & (F.abs(v) <= 90)
        is_lon = ~is_lat & acc["lon"].isNull() & (F.abs(v) <= 180)
        return F.struct(
            F.when(is_lat, v).otherwise(acc["lat"]).alias("lat"),
            F.when(is_lon, v).otherwise(acc["lon"]).alias("lon"),
        )

    def close(found: Column) -> Column:
        wkid = F.when(found["lat"].isNotNull() & found["lon"].isNotNull(), 4326)
        return _fix(found["lon"], found["lat"], wkid)

    return F.aggregate(F.zip_with(numbers, letters, signed), start, take, close)


def clean_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[\r\n]", " "))


def parse_verdicts(text: Column) -> Column:
    """``1:Y 2:n`` to map<int, boolean>; a repeated index keeps its last answer."""
    tokens = F.filter(
        F.split(F.trim(text), r"\s+"),
        lambda t: (F.instr(t, ":") > 0) & F.substring_index(t, ":", 1).try_cast("int").isNotNull(),
    )

    def fold(acc: Column, token: Column) -> Column:
        index = F.substring_index(token, ":", 1).try_cast("int")
        rest = F.trim(F.substr(token, F.instr(token, ":") + 1))
        return F.map_concat(
            F.map_filter(acc, lambda k, _: k != index),
            F.create_map(index, F.upper(rest).startswith("Y")),
        )

    return F.aggregate(tokens, F.create_map().cast("map<int,boolean>"), fold)


def safe_name(text: Column) -> Column:
    kept = F.regexp_replace(text, r"[^\p{L}\p{Nd}]", "")
    return F.when(kept != "", kept).otherwise(F.lit("Uncategorized"))


def category_codes(spark: SparkSession) -> DataFrame:
    """Ten categories in two languages: a fixed lookup, small by definition."""
    rows = [(code, name) for code, en, idn in SAMPLE_CATEGORIES for name in (en, idn)]
    return spark.createDataFrame(rows, "code int, label string")


def category_label(samples: DataFrame, label: str = "cls", lang: str = "en") -> DataFrame:
    """Put both languages of a category under one label; free text stays as it is."""
    spark = samples.sparkSession
    target = spark.createDataFrame(
        [(c, en if lang == "en" else idn) for c, en, idn in SAMPLE_CATEGORIES],
        "code int, _canonical string",
    )
    lookup = category_codes(spark).join(target, "code").select(
        F.col("label").alias("_known"), "code", "_canonical"
    )
    return (
        samples.join(F.broadcast(lookup), F.col(label) == F.col("_known"), "left")
        .withColumn(label, F.coalesce("_canonical", F.col(label)))
        .withColumnRenamed("code", "category_code")
        .drop("_known", "_canonical")
    )


def split_camel(name: Column) -> Column:
    """LandClearing -> Land Clearing."""
    return F.regexp_replace(name, r"(?<!^)(\p{Lu})", " $1")


def feature_of(property_name: Column) -> Column:
    base = F.regexp_replace(property_name, "Status$", "")
    return F.when(base == "", F.lit("General")).otherwise(split_camel(base))
