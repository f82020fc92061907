"""Queries over survey blocks, lanes, waypoints and mission files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.operators import mission
from sylva.plans.missions import corridor_plan, coverage_plan
from sylva.session import materialize
from sylva.sources import writers
from sylva.workload import inputs as I
from sylva.workload.registry import query

SPACED = I.BLOCKS + """, sp AS (SELECT *, greatest(0.5, gsd / 100 * img_w * (1 - least(side, 95) / 100)) AS ls, greatest(0.5, gsd / 100 * img_h * (1 - least(front, 95) / 100)) AS ws FROM blocks)"""

TURNED = SPACED + """, pv AS (SELECT b.*, v.pts, x0 + w / 2 AS px, y0 + h / 2 AS py FROM sp b JOIN verts v USING (fid)),
vt AS (SELECT fid, px, py, ls, ws, direction, unnest(pts) AS p, generate_subscripts(pts, 1) AS i, len(pts) AS n FROM pv),
rot AS (SELECT fid, i, n, ls, ws, px, py, direction, px + (p.x - px) * cos(-direction * pi() / 180) - (p.y - py) * sin(-direction * pi() / 180) AS x,
  py + (p.x - px) * sin(-direction * pi() / 180) + (p.y - py) * cos(-direction * pi() / 180) AS y FROM vt)"""

LANES = TURNED + """, ext AS (SELECT fid, any_value(ls) AS ls, any_value(ws) AS ws, min(x) AS lo, max(x) AS hi FROM rot GROUP BY fid),
ln AS (SELECT fid, ws, k AS line, lo + ls / 2 + k * ls AS x FROM (SELECT *, unnest(range(0, greatest(1, floor((hi - lo - ls / 2) / ls)::BIGINT + 1))) AS k FROM ext) WHERE (hi - lo - ls / 2) >= 0
  UNION ALL SELECT fid, ws, 0, (lo + hi) / 2 FROM ext WHERE (hi - lo - ls / 2) < 0)"""

RUNS = LANES + """, edge AS (SELECT a.fid, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM rot a JOIN rot b ON a.fid = b.fid AND b.i = a.i % a.n + 1),
cr AS (SELECT l.fid, l.line, l.x, l.ws, (b_y - ay) * (l.x - ax) / (bx - ax) + ay AS y FROM ln l JOIN edge e ON e.fid = l.fid AND (ax > l.x) <> (bx > l.x)),
cn AS (SELECT *, row_number() OVER (PARTITION BY fid, line ORDER BY y) AS rn FROM cr),
sp2 AS (SELECT a.fid, a.line, CAST((a.rn - 1) // 2 AS INT) AS part, a.x, a.ws, a.y AS lo, b.y AS hi FROM cn a JOIN cn b ON a.fid = b.fid AND a.line = b.line AND b.rn = a.rn + 1 WHERE a.rn % 2 = 1 AND b.y - a.y >= 0.000001),
ins AS (SELECT *, least(2, (hi - lo) / 2 - 0.000001) AS t FROM sp2),
run AS (SELECT fid, line, part, x, ws, CASE WHEN hi - lo - 2 * t < 0.000001 THEN (lo + hi) / 2 ELSE lo + t END AS y0, CASE WHEN hi - lo - 2 * t < 0.000001 THEN (lo + hi) / 2 ELSE hi - t END AS y1 FROM ins)"""


@query("m1_spacing", "WITH " + SPACED + " SELECT fid, ls::DOUBLE AS line_spacing, ws::DOUBLE AS waypoint_spacing FROM sp")
def _(spark, sf):
    return mission.spacing(I.blocks(spark, sf)).select("fid", "line_spacing", "waypoint_spacing")


@query("m2_coverage_lines", "WITH " + LANES + " SELECT fid, line::INT AS line, round(x, 5) AS x FROM ln")
def _(spark, sf):
    return mission.coverage_lines(I.blocks(spark, sf)).select("fid", "line", F.round("x", 5).alias("x"))


@query("m3_coverage_runs", "WITH " + RUNS + " SELECT fid, line::INT AS line, part, round(x, 5) AS x, round(y0, 5) AS y0, round(y1, 5) AS y1, CAST(greatest(0, ceil((y1 - 0.000001 - y0) / ws) - 1) + 2 AS INT) AS n FROM run")
def _(spark, sf):
    runs = mission.coverage_runs(I.blocks(spark, sf))
    return runs.select("fid", "line", "part", *[F.round(c, 5).alias(c) for c in ("x", "y0", "y1")], "n")


@query("m4_order_runs")
def _(spark, sf):
    points = mission.coverage_points(I.blocks(spark, sf))
    return points.groupBy("fid").agg(F.count("*").alias("waypoints"), F.max("off_polygon_legs").alias("off_polygon_legs"))


@query("m5_coverage_plan")
def _(spark, sf):
    _waypoints, plans = coverage_plan(I.blocks(spark, sf), crosshatch=True)
    return plans.select("fid", "parts", "waypoints", F.round("total_distance_m", 4).alias("total_distance_m"), F.round("total_minutes", 6).alias("total_minutes"), "off_polygon_legs")


@query("m6_suggest_direction", "WITH " + SPACED + """, a AS (SELECT b.fid, b.ls, b.direction, d, v.pts FROM sp b JOIN verts v USING (fid), (SELECT unnest(range(0, 180)) AS d)),
x AS (SELECT fid, ls, direction, d, list_transform(pts, lambda p: (p.x - pts[1].x) * cos(-d * pi() / 180) - (p.y - pts[1].y) * sin(-d * pi() / 180)) AS xs FROM a),
wd AS (SELECT fid, ls, direction, d, round(list_max(xs) - list_min(xs), 6) AS w FROM x)
SELECT fid, first(w ORDER BY w, d) AS best_width, CAST(greatest(1, ceil(first(w ORDER BY w, d) / any_value(ls))) AS INT) AS lines_at_best,
  CAST(greatest(1, ceil(first(w) FILTER (d = direction) / any_value(ls))) AS INT) AS lines_at_current FROM wd GROUP BY fid""")
def _(spark, sf):
    from sylva.functions.geometry import rotate_x

    b = I.blocks(spark, sf)
    s = mission.suggest_direction(b).join(b.select("fid", "rings"), "fid")
    # A rectangle has equal widths a half turn apart, so the width is what both engines can compare.
    o = F.element_at("rings", 1)
    xs = F.transform(o, lambda p: rotate_x(p["x"] - o[0]["x"], p["y"] - o[0]["y"], F.lit(0.0), F.lit(0.0), -F.col("best_degrees")))
    return s.withColumn("_xs", xs).select("fid", F.round(F.array_max("_xs") - F.array_min("_xs"), 6).alias("best_width"), "lines_at_best", "lines_at_current")


def _corridors(spark, sf):
    """A straight centre line per customer in a rectangle of 48 m."""
    return I.table(spark, sf, "customer").selectExpr("c_custkey AS fid", "CAST(c_custkey % 40 * 512 AS DOUBLE) AS x0", "CAST(c_custkey div 40 * 512 AS DOUBLE) AS y0").selectExpr(
        "fid", "array(struct(x0 AS x, y0 AS y), struct(x0 + 200 AS x, y0 AS y)) AS path",
        "array(array(struct(x0 - 1 AS x, y0 - 17 AS y), struct(x0 + 81 AS x, y0 - 17 AS y), struct(x0 + 81 AS x, y0 + 3 AS y), struct(x0 + 119 AS x, y0 + 3 AS y), struct(x0 + 119 AS x, y0 - 17 AS y), struct(x0 + 161 AS x, y0 - 17 AS y), struct(x0 + 161 AS x, y0 + 31 AS y), struct(x0 - 1 AS x, y0 + 31 AS y))) AS rings",
        "50D AS altitude", "2D AS gsd", "1000 AS img_w", "1000 AS img_h", "50D AS front", "50D AS side", "0D AS direction", "8D AS speed", "1D AS minutes")


CORRIDOR = """co AS (SELECT c_custkey AS fid, CAST(c_custkey % 40 * 512 AS DOUBLE) AS x0, CAST(c_custkey // 40 * 512 AS DOUBLE) AS y0 FROM customer),
pt AS (SELECT fid, x0, y0, k, lane, x0 + k * 10 AS x, y0 + lane * 10 AS y FROM co, (SELECT unnest(range(0, 21)) AS k), (SELECT unnest(range(-30, 31)) AS lane)),
ins AS (SELECT *, x > x0 - 1 AND x < x0 + 161 AND y > y0 - 17 AND y < y0 + 31 AND NOT (x > x0 + 81 AND x < x0 + 119 AND y < y0 + 3) AS inside FROM pt),
st AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER (PARTITION BY fid, lane ORDER BY k), false) THEN 1 ELSE 0 END AS s FROM ins),
rn AS (SELECT *, sum(s) OVER (PARTITION BY fid, lane ORDER BY k) AS run FROM st)"""


@query("m7_corridor_lanes", "WITH " + CORRIDOR + " SELECT fid, lane::INT AS lane, k::INT AS k, run::BIGINT AS run, round(x, 6) AS x, round(y, 6) AS y FROM rn WHERE inside")
def _(spark, sf):
    lanes = mission.corridor_lanes(_corridors(spark, sf))
    return lanes.select("fid", "lane", "k", "run", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("m7_corridor_plan")
def _(spark, sf):
    _waypoints, plans = corridor_plan(_corridors(spark, sf))
    return plans.select("fid", "parts", "waypoints", F.round("total_distance_m", 4).alias("total_distance_m"), "off_polygon_legs")


@query("w5_runs", "WITH " + CORRIDOR + " SELECT fid, lane::INT AS lane, k::INT AS k, run::BIGINT AS run FROM rn WHERE inside AND lane = -1")
def _(spark, sf):
    lane = I.table(spark, sf, "customer").selectExpr("c_custkey AS fid", "-1 AS lane", "explode(sequence(0, 20)) AS k")
    inside = (F.col("k") <= 8) | F.col("k").between(12, 16)
    return mission.runs(lane, inside, ["fid", "lane"], "k").select("fid", "lane", "k", "run")


@query("m8_coverage_failure", "WITH " + TURNED + """, e AS (SELECT fid, any_value(ls) AS ls, any_value(ws) AS ws, max(x) - min(x) AS w, max(y) - min(y) AS h FROM rot GROUP BY fid)
SELECT fid, round(w, 5) AS width, round(h, 5) AS height, ls::DOUBLE AS line_spacing, ws::DOUBLE AS waypoint_spacing, w < ls OR h < ws AS too_small,
  CASE WHEN w < ls OR h < ws THEN 'smaller than the spacing' ELSE 'no sampled point inside' END AS cause FROM e""")
def _(spark, sf):
    return mission.coverage_failure(I.blocks(spark, sf)).withColumns({c: F.round(c, 5) for c in ("width", "height")})


# ---- lines and parts ---------------------------------------------------------

RESAMPLED = "WITH " + I.ZIGZAGS + ", rs AS (SELECT fid, k::INT AS k, CASE WHEN k <= 4 THEN x0 + k * 3 ELSE x0 + 12 END AS x, CASE WHEN k <= 4 THEN y0 ELSE y0 + k * 3 - 12 END AS y FROM zig, (SELECT unnest(range(0, 10)) AS k))"


@query("w3_resample_line", RESAMPLED + " SELECT fid, k, round(x, 6) AS x, round(y, 6) AS y FROM rs")
def _(spark, sf):
    return mission.resample_line(I.zigzags(spark, sf), 3.0).select("fid", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("w4_smooth_tangent", RESAMPLED + """, d AS (SELECT fid, k, last(x) OVER w - first(x) OVER w AS dx, last(y) OVER w - first(y) OVER w AS dy FROM rs WINDOW w AS (PARTITION BY fid ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT fid, k, round(dx / sqrt(dx * dx + dy * dy), 6) AS dx, round(dy / sqrt(dx * dx + dy * dy), 6) AS dy FROM d""")
def _(spark, sf):
    pts = mission.smooth_tangent(mission.resample_line(I.zigzags(spark, sf), 3.0))
    return pts.select("fid", "k", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


FLIGHT = """fl AS (SELECT p_partkey // 40 AS fid, p_partkey % 40 AS seq, 500000.0::DOUBLE + (p_partkey % 40) * 30 + (p_partkey % 3) * 4 AS x, 9500000.0::DOUBLE + (p_partkey % 40) * 40 AS y, CASE WHEN p_partkey // 40 % 5 = 0 THEN 0.0::DOUBLE ELSE 8.0::DOUBLE END AS speed,
  0.25::DOUBLE + (p_partkey // 40 % 4) * 0.5 AS minutes FROM part)"""


def _flight(spark, sf):
    return I.table(spark, sf, "part").selectExpr(
        "p_partkey div 40 AS fid", "p_partkey % 40 AS seq", "500000D + (p_partkey % 40) * 30 + (p_partkey % 3) * 4 AS x", "9500000D + (p_partkey % 40) * 40 AS y",
        "CASE WHEN p_partkey div 40 % 5 = 0 THEN 0D ELSE 8D END AS speed", "0.25D + (p_partkey div 40 % 4) * 0.5D AS minutes")


PARTS = "WITH RECURSIVE " + FLIGHT + """, lg AS (SELECT *, CASE WHEN speed > 0 THEN sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) / speed ELSE 0 END AS sec FROM fl WINDOW w AS (PARTITION BY fid ORDER BY seq)),
walk(fid, seq, part, used, sequence, cut) AS (SELECT fid, seq, 1, 0.0::DOUBLE, 0, -1 FROM lg WHERE seq = 0
  UNION ALL SELECT w.fid, l.seq, CASE WHEN w.used + l.sec > l.minutes * 60 THEN w.part + 1 ELSE w.part END, CASE WHEN w.used + l.sec > l.minutes * 60 THEN 0 ELSE w.used + l.sec END,
    CASE WHEN w.used + l.sec > l.minutes * 60 THEN 0 ELSE w.sequence + 1 END, CASE WHEN w.used + l.sec > l.minutes * 60 THEN w.sequence + 1 ELSE -1 END FROM walk w JOIN lg l ON l.fid = w.fid AND l.seq = w.seq + 1),
parts AS (SELECT fid, part, sequence, seq FROM walk UNION ALL SELECT fid, part - 1, cut, seq FROM walk WHERE cut >= 0)"""


@query("w6_split_by_budget", PARTS + " SELECT p.fid, part, sequence, seq, x, y FROM parts p JOIN fl USING (fid, seq)")
def _(spark, sf):
    return mission.split_by_budget(_flight(spark, sf)).select("fid", "part", "sequence", "seq", "x", "y")


@query("w6_plan_totals", "WITH " + FLIGHT + """, lg AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS leg FROM fl WINDOW w AS (PARTITION BY fid ORDER BY seq))
SELECT fid, round(coalesce(sum(leg), 0), 6) AS total_distance_m, round(CASE WHEN max(speed) > 0 THEN coalesce(sum(leg), 0) / max(speed) / 60 ELSE 0 END, 6) AS total_minutes FROM lg GROUP BY fid""")
def _(spark, sf):
    return mission.plan_totals(_flight(spark, sf)).select("fid", F.round("total_distance_m", 6).alias("total_distance_m"), F.round("total_minutes", 6).alias("total_minutes"))


@query("w8_path_lines", "WITH " + I.WAYPOINTS + """, kept AS (SELECT * REPLACE (CASE WHEN k % 40 = 39 THEN 100 + part ELSE part END AS part) FROM wp) SELECT fid, part, count(*)::INT AS vertices, string_agg(printf('%.1f %.1f', x, y), ';' ORDER BY sequence) AS wkt FROM kept GROUP BY fid, part HAVING count(*) >= 2""")
def _(spark, sf):
    # The last waypoint of each plan is a part of its own, which is no line.
    lines = mission.path_lines(I.waypoints(spark, sf).withColumn("part", F.expr("CASE WHEN k % 40 = 39 THEN 100 + part ELSE part END")))
    wkt = F.array_join(F.transform("path", lambda p: F.format_string("%.1f %.1f", p["x"], p["y"])), ";")
    return lines.select("fid", "part", F.size("path").alias("vertices"), wkt.alias("wkt"))


@query("a16_counts_by_part", "WITH " + I.WAYPOINTS + """, lg AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS leg FROM wp WINDOW w AS (PARTITION BY fid, part ORDER BY sequence))
SELECT fid, part, count(*) AS waypoints, round(coalesce(sum(leg), 0), 6) AS distance_m, round(CASE WHEN max(speed) > 0 THEN coalesce(sum(leg), 0) / max(speed) / 60 ELSE 0 END, 6) AS minutes FROM lg GROUP BY fid, part""")
def _(spark, sf):
    c = mission.counts_by_part(I.waypoints(spark, sf))
    return c.select("fid", "part", "waypoints", F.round("distance_m", 6).alias("distance_m"), F.round("minutes", 6).alias("minutes"))


@query("u1_cross_hatch", "WITH " + I.WAYPOINTS + " SELECT fid, part, sequence, x, y FROM wp UNION ALL SELECT fid, part + max(part) OVER (PARTITION BY fid), sequence, y, x FROM wp")
def _(spark, sf):
    w = materialize(I.waypoints(spark, sf).select("fid", "part", "sequence", "x", "y"))
    return mission.cross_hatch(w, w.selectExpr("fid", "part", "sequence", "y AS x", "x AS y"))


# ---- mission files -----------------------------------------------------------

@query("s10_mission_csv", "WITH " + I.WAYPOINTS + """ SELECT DISTINCT fid, part, 0 AS line_no, 'latitude,longitude,altitude(m)' AS line FROM wp
UNION ALL SELECT fid, part, sequence + 1, printf('%.7f,%.7f,%.1f', lat, lon, altitude) FROM wp""")
def _(spark, sf):
    return writers.mission_csv(I.waypoints(spark, sf))


@query("s10_mission_files", "WITH " + I.WAYPOINTS + """, w1 AS (SELECT fid, CASE WHEN fid % 3 = 0 THEN 1 ELSE part END AS part FROM wp) SELECT fid, part, CASE WHEN n > 1 THEN concat('mission_part', part, '.csv') ELSE 'mission.csv' END AS name
FROM (SELECT DISTINCT fid, part FROM w1) JOIN (SELECT fid, count(DISTINCT part) AS n FROM w1 GROUP BY fid) USING (fid)""")
def _(spark, sf):
    one_part = I.waypoints(spark, sf).withColumn("part", F.expr("CASE WHEN fid % 3 = 0 THEN 1 ELSE part END"))
    return writers.mission_file_names(one_part, "mission", "csv")


def _wpml_sql() -> str:
    t = lambda n, v: f"<wpml:{n}>{v}</wpml:{n}>\n"
    head = ('<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2" xmlns:wpml="http://www.dji.com/wpmz/1.0.2">\n<Document>\n' + t("author", "sylva") + t("createTime", 1700000000000)
            + t("updateTime", 1700000000000) + "<wpml:missionConfig>\n" + t("flyToWaylineMode", "safely") + t("finishAction", "goHome") + t("exitOnRCLost", "goContinue") + t("executeRCLostAction", "hover")
            + t("takeOffSecurityHeight", 20) + t("globalTransitionalSpeed", "@S") + "<wpml:droneInfo>\n" + t("droneEnumValue", 67) + t("droneSubEnumValue", 0) + "</wpml:droneInfo>\n<wpml:payloadInfo>\n"
            + t("payloadEnumValue", 52) + t("payloadPositionIndex", 0) + "</wpml:payloadInfo>\n</wpml:missionConfig>\n<Folder>\n" + t("templateType", "waypoint") + t("templateId", 0) + "<wpml:waylineCoordinateSysParam>\n"
            + t("coordinateMode", "WGS84") + t("heightMode", "relativeToStartPoint") + t("positioningType", "GPS") + "</wpml:waylineCoordinateSysParam>\n" + t("autoFlightSpeed", "@S") + t("gimbalPitchMode", "manual")
            + t("globalWaypointTurnMode", "toPointAndStopWithDiscontinuityCurvature") + t("globalUseStraightLine", 0))
    mark = ("<Placemark>\n<Point><coordinates>@X,@Y</coordinates></Point>\n" + t("index", "@I") + t("ellipsoidHeight", "@H") + t("height", "@H") + t("useGlobalHeight", 0) + t("useGlobalSpeed", 1)
            + t("useGlobalHeadingParam", 1) + t("useGlobalTurnParam", 1) + "<wpml:actionGroup>\n" + t("actionGroupId", "@I") + t("actionGroupStartIndex", "@I") + t("actionGroupEndIndex", "@I")
            + t("actionGroupMode", "sequence") + "<wpml:actionTrigger><wpml:actionTriggerType>reachPoint</wpml:actionTriggerType></wpml:actionTrigger>\n<wpml:action>\n" + t("actionId", 0)
            + t("actionActuatorFunc", "takePhoto") + "<wpml:actionActuatorFuncParam>\n" + t("fileSuffix", "wp@I") + t("payloadPositionIndex", 0) + "</wpml:actionActuatorFuncParam>\n</wpml:action>\n</wpml:actionGroup>\n</Placemark>\n")
    return "WITH " + I.WAYPOINTS + f""", m AS (SELECT fid, part, sequence, speed, replace(replace(replace(replace('{mark}', '@X', printf('%.7f', lon)), '@Y', printf('%.7f', lat)), '@I', sequence::VARCHAR), '@H', printf('%.1f', altitude)) AS xml FROM wp)
SELECT fid, part, concat(replace('{head}', '@S', printf('%.1f', greatest(1, max(speed)))), string_agg(xml, '' ORDER BY sequence), '</Folder>\n</Document>\n</kml>\n') AS xml FROM m GROUP BY fid, part"""


@query("s11_wpml_text", _wpml_sql())
def _(spark, sf):
    return writers.wpml_text(I.waypoints(spark, sf), "Matrice 30", 1700000000000)


@query("s12_gpx_text", "WITH " + I.WAYPOINTS + """ SELECT k AS fid, printf('<wpt lat="%.7f" lon="%.7f"><name>tree %d</name></wpt>', lat, lon, k) AS gpx FROM wp
UNION ALL SELECT fid, concat('<trk><trkseg>', string_agg(printf('<trkpt lat="%.7f" lon="%.7f"/>', lat, lon), '' ORDER BY k), '</trkseg></trk>') FROM wp GROUP BY fid
UNION ALL SELECT p_partkey, printf('<trk><trkseg><trkpt lat="%.7f" lon="%.7f"/><trkpt lat="%.7f" lon="%.7f"/><trkpt lat="%.7f" lon="%.7f"/><trkpt lat="%.7f" lon="%.7f"/><trkpt lat="%.7f" lon="%.7f"/></trkseg></trk>',
  y, x, y, x + w, y + h, x + w, y + h, x, y, x) FROM (SELECT p_partkey, CAST((p_partkey % 50) * 100 AS DOUBLE) AS x, CAST((p_partkey // 50) * 100 AS DOUBLE) AS y, CAST(1 + p_size AS DOUBLE) AS w, CAST(1 + p_partkey % 7 AS DOUBLE) AS h FROM part)""")
def _(spark, sf):
    w = I.waypoints(spark, sf)
    points = writers.gpx_points(w.withColumn("fid", F.col("k")).withColumn("name", F.concat(F.lit("tree "), F.col("k").cast("string"))))
    track = w.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("k", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("path"))
    bounds = writers.boundary_lines(I.rectangles(spark, sf))
    return points.unionByName(writers.gpx_tracks(track)).unionByName(writers.gpx_tracks(bounds.select("fid", "path")))
