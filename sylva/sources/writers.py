"""Layers, masks, samples, missions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.operators.raster import GROUP_TILES, grouped_tiles
from sylva.session import spread

# Mission text formats and drone presets
# (label, drone code, drone sub code, payload code).
CSV_HEADER = "latitude,longitude,altitude(m)"
DRONE_PRESETS = [
    ("Mavic 3 Enterprise (M3E)", 77, 0, 66),
    ("Mavic 3 Enterprise (M3T)", 77, 1, 67),
    ("Mavic 3 Enterprise (M3M)", 77, 2, 68),
    ("Matrice 3D", 91, 0, 80),
    ("Matrice 3TD", 91, 1, 81),
    ("Matrice 30", 67, 0, 52),
    ("Matrice 30T", 67, 1, 53),
    ("Matrice 300 RTK + Zenmuse H20", 60, None, 42),
    ("Matrice 300 RTK + Zenmuse H20T", 60, None, 43),
    ("Matrice 350 RTK + Zenmuse H20", 89, None, 42),
    ("Matrice 350 RTK + Zenmuse H20T", 89, None, 43),
]
WPML_NAMESPACES = 'xmlns="http://www.opengis.net/kml/2.2" xmlns:wpml="http://www.dji.com/wpmz/1.0.2"'


def tree_layer(trees: DataFrame) -> DataFrame:
    """The typed tree-point layer with its defaults."""
    has = lambda c, kind, default: (F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in trees.columns else F.lit(default)).cast(kind)
    return trees.select(
        F.col("geo_x").alias("x"), F.col("geo_y").alias("y"), has("crown_r", "double", 0.0).alias("crown_r"),
        has("sigma", "int", 0).alias("sigma_px"), has("score", "double", 0.0).alias("score"),
        has("source", "string", "exg").alias("source"))


def write_points(trees: DataFrame, path: str) -> None:
    tree_layer(trees).write.mode("overwrite").parquet(path)


def write_raster(tiles: DataFrame, path: str, group: int = GROUP_TILES) -> None:
    """A tile table in folders of tile groups, from which ``read_raster_window`` reads only what a window needs."""
    keys = ["group_row", "group_col"]
    placed = spread(grouped_tiles(tiles, group), "raster_id", *keys)
    placed.sortWithinPartitions(*keys, "raster_id", "tile_row", "tile_col").write.mode("overwrite").partitionBy(*keys).parquet(path)


def sparse_mask(cells: DataFrame) -> DataFrame:
    """A 0/1 raster without its 0 cells, which read back as no data."""
    return cells.filter(F.col("v") == 1).select("raster_id", "row", "col", F.lit(1).alias("v"))


def write_mask(cells: DataFrame, path: str) -> None:
    sparse_mask(cells).write.mode("overwrite").parquet(path)


def sample_layer(samples: DataFrame) -> DataFrame:
    return samples.select(
        "x", "y", F.lit("").alias("Label"), F.coalesce("cls", F.lit("")).alias("Class"), F.col("r").cast("int").alias("R"),
        F.col("g").cast("int").alias("G"), F.col("b").cast("int").alias("B"), F.col("exg").cast("double").alias("ExG"))


def write_samples(samples: DataFrame, path: str) -> None:
    sample_layer(samples).write.mode("overwrite").parquet(path)


def write_by_wkid(points: DataFrame, path: str) -> None:
    """One output layer per coordinate system."""
    points.write.mode("overwrite").partitionBy("wkid").parquet(path)


def write_report(summary: DataFrame, path: str) -> None:
    """A small spreadsheet: one row per species, one file."""
    # A shuffle, so that only the finished rows meet in one task.
    summary.repartition(1).write.mode("overwrite").option("header", True).csv(path)


# ---- missions ----------------------------------------------------------------

def mission_layer(waypoints: DataFrame) -> DataFrame:
    return waypoints.select(
        "x", "y", F.col("part").cast("int").alias("MissionPart"), F.col("sequence").cast("int").alias("Sequence"),
        F.col("altitude").cast("double").alias("Altitude_m"))


def mission_csv(waypoints: DataFrame) -> DataFrame:
    """``fid, part, line_no, line``: header and one line per waypoint, per part."""
    line = F.format_string("%.7f,%.7f,%.1f", "lat", "lon", "altitude")
    rows = waypoints.select("fid", "part", (F.col("sequence") + 1).alias("line_no"), line.alias("line"))
    heads = waypoints.select("fid", "part").distinct().select("fid", "part", F.lit(0).alias("line_no"), F.lit(CSV_HEADER).alias("line"))
    return heads.unionByName(rows)


def mission_file_names(waypoints: DataFrame, base: str, extension: str) -> DataFrame:
    """``fid, part, name``: a part suffix only if a plan has more than one."""
    parts = waypoints.groupBy("fid").agg(F.count_distinct("part").alias("_n"), F.collect_set("part").alias("_p"))
    return parts.select("fid", "_n", F.explode("_p").alias("part")).select(
        "fid", "part", F.when(F.col("_n") > 1, F.format_string(f"{base}_part%d.{extension}", "part")).otherwise(F.lit(f"{base}.{extension}")).alias("name"))


def write_mission_csv(waypoints: DataFrame, path: str) -> None:
    """One folder per plan and part; a part lands in one task, in line order."""
    lines = mission_csv(waypoints)
    (
        lines.repartition("fid", "part").sortWithinPartitions("fid", "part", "line_no")
        .select("fid", "part", "line").write.mode("overwrite").partitionBy("fid", "part").text(path)
    )


def _tag(name: str, value: Column | str) -> list[Column]:
    inner = F.lit(value) if isinstance(value, str) else value.cast("string")
    return [F.lit(f"<wpml:{name}>"), inner, F.lit(f"</wpml:{name}>\n")]


def _block(name: str, *inside: list[Column], prefix: str = "wpml:") -> list[Column]:
    flat = [c for part in inside for c in part]
    return [F.lit(f"<{prefix}{name}>\n"), *flat, F.lit(f"</{prefix}{name}>\n")]


def _placemark(index: Column, lat: Column, lon: Column, altitude: Column) -> Column:
    height = F.format_string("%.1f", altitude)
    action = _block(
        "action", _tag("actionId", "0"), _tag("actionActuatorFunc", "takePhoto"),
        _block("actionActuatorFuncParam", _tag("fileSuffix", F.concat(F.lit("wp"), index.cast("string"))), _tag("payloadPositionIndex", "0")))
    group = _block(
        "actionGroup", _tag("actionGroupId", index), _tag("actionGroupStartIndex", index), _tag("actionGroupEndIndex", index),
        _tag("actionGroupMode", "sequence"),
        [F.lit("<wpml:actionTrigger><wpml:actionTriggerType>reachPoint</wpml:actionTriggerType></wpml:actionTrigger>\n")], action)
    point = [F.format_string("<Point><coordinates>%.7f,%.7f</coordinates></Point>\n", lon, lat)]
    switches = [_tag("useGlobalHeight", "0"), _tag("useGlobalSpeed", "1"), _tag("useGlobalHeadingParam", "1"), _tag("useGlobalTurnParam", "1")]
    return F.concat(*_block("Placemark", point, _tag("index", index), _tag("ellipsoidHeight", height), _tag("height", height), *switches, group, prefix=""))


def wpml_text(waypoints: DataFrame, drone: str, created_ms: int, author: str = "sylva") -> DataFrame:
    """``fid, part, xml``: one mission template per part.

    ``waypoints``: ``fid, part, sequence, lat, lon, altitude, speed``. A part is
    one battery's flight, so the text of a part is bounded. Parts without
    waypoints do not exist here; ``require_waypoints`` rejects an empty table."""
    preset = next((p for p in DRONE_PRESETS if p[0] == drone), DRONE_PRESETS[0])
    _, code, sub, payload = preset
    speed = F.format_string("%.1f", F.greatest(F.lit(1.0), F.col("speed")))
    marks = waypoints.select("fid", "part", "speed", F.struct("sequence", _placemark(F.col("sequence"), F.col("lat"), F.col("lon"), F.col("altitude")).alias("xml")).alias("_m"))
    bodies = marks.groupBy("fid", "part").agg(F.max("speed").alias("speed"), F.array_sort(F.collect_list("_m")).alias("_m"))
    now = str(created_ms)
    config = _block(
        "missionConfig", _tag("flyToWaylineMode", "safely"), _tag("finishAction", "goHome"), _tag("exitOnRCLost", "goContinue"),
        _tag("executeRCLostAction", "hover"), _tag("takeOffSecurityHeight", "20"), _tag("globalTransitionalSpeed", speed),
        _block("droneInfo", _tag("droneEnumValue", str(code)), *([_tag("droneSubEnumValue", str(sub))] if sub is not None else [])),
        _block("payloadInfo", _tag("payloadEnumValue", str(payload)), _tag("payloadPositionIndex", "0")))
    frame = _block("waylineCoordinateSysParam", _tag("coordinateMode", "WGS84"), _tag("heightMode", "relativeToStartPoint"), _tag("positioningType", "GPS"))
    folder = _block(
        "Folder", _tag("templateType", "waypoint"), _tag("templateId", "0"), frame, _tag("autoFlightSpeed", speed), _tag("gimbalPitchMode", "manual"),
        _tag("globalWaypointTurnMode", "toPointAndStopWithDiscontinuityCurvature"), _tag("globalUseStraightLine", "0"),
        [F.array_join(F.col("_m")["xml"], "")], prefix="")
    document = _block("Document", _tag("author", author), _tag("createTime", now), _tag("updateTime", now), config, folder, prefix="")
    opening = F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<kml {WPML_NAMESPACES}>\n')
    return bodies.select("fid", "part", F.concat(opening, *document, F.lit("</kml>\n")).alias("xml"))


def require_waypoints(waypoints: DataFrame) -> DataFrame:
    if waypoints.isEmpty():
        raise ValueError("a mission needs at least one waypoint")
    return waypoints


# ---- GPX ---------------------------------------------------------------------

def gpx_points(points: DataFrame) -> DataFrame:
    """``fid, gpx``: a waypoint element per ``fid, lat, lon, name``."""
    return points.select("fid", F.format_string('<wpt lat="%.7f" lon="%.7f"><name>%s</name></wpt>', "lat", "lon", "name").alias("gpx"))


def gpx_tracks(lines: DataFrame) -> DataFrame:
    """``fid, gpx``: a track per ``fid, path`` with x = longitude, y = latitude."""
    point = lambda p: F.format_string('<trkpt lat="%.7f" lon="%.7f"/>', p["y"], p["x"])
    return lines.select("fid", F.concat(F.lit("<trk><trkseg>"), F.array_join(F.transform("path", point), ""), F.lit("</trkseg></trk>")).alias("gpx"))


def boundary_lines(rings: DataFrame) -> DataFrame:
    """Polygon rings as closed lines, one per part."""
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    closed = (first["x"] == last["x"]) & (first["y"] == last["y"])
    return rings.select("fid", "part", F.when(closed, F.col("pts")).otherwise(F.concat("pts", F.slice("pts", 1, 1))).alias("path"))


def job_summary(counts: DataFrame) -> DataFrame:
    """One JSON object from a one-row table of counts."""
    return counts.select(F.to_json(F.struct(*counts.columns)).alias("summary"))
