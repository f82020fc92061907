"""Queries over points, boxes, graphs and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.functions.geometry import line_length
from sylva.operators import compare, detections, evaluate, field, graph, regions, roads, verdicts
from sylva.plans.trees import dedup_detections, detection_summary, drop_on_mask
from sylva.sources import readers, writers
from sylva.streaming import history, sampling
from sylva.workload import inputs as I
from sylva.workload.registry import query


@query("j1_compare_detections", "WITH " + I.MATCHED + " SELECT status, fid, x, y, partner FROM changes")
def _(spark, sf):
    return compare.compare_detections(I.old_points(spark, sf), I.new_points(spark, sf))


@query("a10_change_summary", "WITH " + I.MATCHED + """ SELECT count(*) FILTER (status = 'lost') AS lost_count, count(*) FILTER (status = 'new') AS new_count,
  count(*) FILTER (status = 'matched') AS matched_count FROM changes""")
def _(spark, sf):
    return compare.change_summary(compare.compare_detections(I.old_points(spark, sf), I.new_points(spark, sf)))


@query("s14_job_summary", "WITH " + I.MATCHED + """ SELECT CAST(json_object('lost_count', count(*) FILTER (status = 'lost'), 'new_count', count(*) FILTER (status = 'new'),
  'matched_count', count(*) FILTER (status = 'matched')) AS VARCHAR) AS summary FROM changes""")
def _(spark, sf):
    return writers.job_summary(compare.change_summary(compare.compare_detections(I.old_points(spark, sf), I.new_points(spark, sf))))


@query("e4_point_score", "WITH " + I.MATCHED + """, c AS (SELECT count(*) FILTER (status = 'matched') AS tp, count(*) FILTER (status = 'new') AS fp, count(*) FILTER (status = 'lost') AS fn FROM changes)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def _(spark, sf):
    s = evaluate.point_score(I.new_points(spark, sf), I.old_points(spark, sf), 3.0)
    return s.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


ERASED = "WITH " + I.POINTS + ", " + I.FRAMED.replace("framed AS", "f AS")


@query("j2_erase_points", ERASED + " SELECT fid, x, y FROM allp p WHERE NOT EXISTS (SELECT 1 FROM f WHERE " + I.IN_FRAME + ")")
def _(spark, sf):
    return regions.erase_points(I.all_points(spark, sf), I.framed(spark, sf)).select("fid", "x", "y")


@query("g1_point_in_rings", ERASED + " SELECT fid FROM allp p WHERE EXISTS (SELECT 1 FROM f WHERE " + I.IN_FRAME + ")")
def _(spark, sf):
    return regions.points_inside(I.all_points(spark, sf), I.framed(spark, sf))


SAMPLED = "WITH " + I.PIX + ", " + I.CLICKS + """, hit AS (SELECT c.fid, c.x, c.y, c.cls, p.r::INT AS r, p.g::INT AS g, p.b::INT AS b FROM clickcell c LEFT JOIN pix p ON p.row = c.pr AND p.col = c.pc)"""


@query("j5_sample_pixels", SAMPLED + " SELECT fid, r AS px_r, g AS px_g, b AS px_b FROM hit")
def _(spark, sf):
    got = sampling.sample_pixels(I.clicks(spark, sf), I.pixels(spark, sf), I.meta(spark, sf))
    return got.select("fid", "px_r", "px_g", "px_b")


REQUESTS = """CASE WHEN event_id % 50 = 0 THEN 'not a point' WHEN event_id % 51 = 0 THEN '1,2,3' WHEN event_id % 52 = 0 THEN '' ELSE concat({x}, ',', {y}) END"""


@query("t1_sample_stream", "WITH " + I.PIX + ", " + I.CLICKS + """, rq AS (SELECT fid AS event_id, x, y, pr, pc, """ + REQUESTS.format(x="x", y="y") + """ AS line FROM clickcell)
SELECT event_id, CASE WHEN event_id % 50 = 0 OR event_id % 51 = 0 THEN 'ERROR' WHEN p.row IS NULL THEN 'NODATA' ELSE concat(p.r::INT, ',', p.g::INT, ',', p.b::INT) END AS reply
FROM rq LEFT JOIN pix p ON p.row = rq.pr AND p.col = rq.pc WHERE line <> ''""")
def _(spark, sf):
    ev = I.table(spark, sf, "events")
    events = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    x, y = "CAST(500000 + (event_id % 220) * 0.25D - 1.25D AS STRING)", "CAST(9500000 - (event_id % 700) * 0.25D + 1.25D AS STRING)"
    asked = events.selectExpr("event_id", I.raster_a("event_id"), REQUESTS.format(x=x, y=y) + " AS line")
    out = I.scratch(spark, "replies")
    sampling.sample_stream(asked, I.pixels(spark, sf), I.meta(spark, sf), out, I.scratch(spark, "ck")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "reply")


@query("t2_history_stream", "WITH " + I.STATUS + " SELECT ts, feature, message FROM entries")
def _(spark, sf):
    ev = I.table(spark, sf, "events")
    stream = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(sf).selectExpr(
        "ts", "CASE event_id % 4 WHEN 0 THEN 'LandClearingStatus' WHEN 1 THEN 'Status' WHEN 2 THEN 'FlightMissionStatus' ELSE 'GpxStatus' END AS property",
        "CASE WHEN event_id % 10 = 0 THEN '' ELSE props END AS message")
    out = I.scratch(spark, "log")
    history.history_stream(stream, out, I.scratch(spark, "ck")).awaitTermination()
    return spark.read.parquet(out)


@query("t3_collect_samples", SAMPLED + """ SELECT x, y, '' AS "Label", cls AS "Class", r AS "R", g AS "G", b AS "B", CAST(2 * g - r - b AS DOUBLE) AS "ExG" FROM hit WHERE r IS NOT NULL""")
def _(spark, sf):
    ev = I.table(spark, sf, "events")
    stream = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(sf).selectExpr(
        I.raster_a("event_id"), "500000 + (event_id % 220) * 0.25D - 1.25D AS x", "9500000 - (event_id % 700) * 0.25D + 1.25D AS y",
        "CASE WHEN event_id % 3 = 0 THEN 'Water/river' WHEN event_id % 3 = 1 THEN 'Sungai/air' ELSE 'my own' END AS cls")
    out = I.scratch(spark, "clicks")
    sampling.collect_samples(stream, I.pixels(spark, sf), I.meta(spark, sf), out, I.scratch(spark, "ck")).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query("j6_nms", "WITH RECURSIVE " + I.CLUSTERED + """, rk AS (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY sigma DESC, fid) AS rn FROM clustered),
step(raster_id, rn, kept) AS (SELECT raster_id, 1::BIGINT, [{'fid': fid, 'x': x, 'y': y, 's': sigma}] FROM rk WHERE rn = 1
  UNION ALL SELECT s.raster_id, r.rn, CASE WHEN len(list_filter(s.kept, lambda k: (k.x - r.x) * (k.x - r.x) + (k.y - r.y) * (k.y - r.y) <= k.s * k.s)) > 0 THEN s.kept
    ELSE list_append(s.kept, {'fid': r.fid, 'x': r.x, 'y': r.y, 's': r.sigma}) END FROM step s JOIN rk r ON r.raster_id = s.raster_id AND r.rn = s.rn + 1)
SELECT unnest(kept).fid AS fid FROM step QUALIFY rn = max(rn) OVER (PARTITION BY raster_id)""")
def _(spark, sf):
    return graph.nms(I.clustered(spark, sf), keys=["raster_id"]).select("fid")


_I = "(greatest(0, least(k.x + k.w / 2, r.cx + r.w / 2) - greatest(k.x - k.w / 2, r.cx - r.w / 2)) * greatest(0, least(k.y + k.h / 2, r.cy + r.h / 2) - greatest(k.y - k.h / 2, r.cy - r.h / 2)))"


KEPT_BOXES = "WITH RECURSIVE " + I.BOXES + """, rk AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY score DESC, fid) AS rn FROM boxes WHERE score > 0.25),
step(window_id, rn, kept) AS (SELECT window_id, 1::BIGINT, [{'fid': fid, 'x': cx, 'y': cy, 'w': w, 'h': h}] FROM rk WHERE rn = 1
  UNION ALL SELECT s.window_id, r.rn, CASE WHEN len(list_filter(s.kept, lambda k: """ + f"{_I} / (k.w * k.h + r.w * r.h - {_I})" + """ > 0.45)) > 0 THEN s.kept
    ELSE list_append(s.kept, {'fid': r.fid, 'x': r.cx, 'y': r.cy, 'w': r.w, 'h': r.h}) END FROM step s JOIN rk r ON r.window_id = s.window_id AND r.rn = s.rn + 1),
kept AS (SELECT window_id, unnest(kept).fid AS fid FROM step QUALIFY rn = max(rn) OVER (PARTITION BY window_id))"""


@query("j7_box_nms", KEPT_BOXES + " SELECT fid FROM kept")
def _(spark, sf):
    return detections.box_nms(I.boxes(spark, sf)).select("fid")


WINDOWS = """wins AS (SELECT window_id, (window_id % 7) * 100 AS x0, (window_id % 11) * 90 AS y0, 320 + (window_id % 3) * 160 AS cw, 320 + (window_id % 2) * 320 AS ch FROM (SELECT DISTINCT window_id FROM boxes))"""


def _windows(spark, sf):
    return I.boxes(spark, sf).select("window_id").distinct().selectExpr(
        "window_id", I.raster_a("window_id"), "(window_id % 7) * 100 AS x0", "(window_id % 11) * 90 AS y0", "320 + (window_id % 3) * 160 AS w", "320 + (window_id % 2) * 320 AS h")


@query("j8_boxes_to_points", "WITH " + I.BOXES + ", " + WINDOWS + """, p AS (SELECT fid, score, CAST(round_even(x0 + cx * (cw / 640.0::DOUBLE), 0) AS INT) AS px, CAST(round_even(y0 + cy * (ch / 640.0::DOUBLE), 0) AS INT) AS py FROM boxes JOIN wins USING (window_id))
SELECT fid, 'A' AS raster_id, px, py, 500000 + px * 0.5::DOUBLE AS geo_x, 9500000 - py * 0.5::DOUBLE AS geo_y, score FROM p""")
def _(spark, sf):
    return detections.boxes_to_points(I.boxes(spark, sf), _windows(spark, sf), I.meta(spark, sf))


@query("c4_dedup_detections", KEPT_BOXES + ", " + WINDOWS + """, pts AS (SELECT b.fid, concat('A', b.window_id) AS raster_id, b.score, CAST(round_even(x0 + cx * (cw / 640.0::DOUBLE), 0) AS INT) AS px,
  CAST(round_even(y0 + cy * (ch / 640.0::DOUBLE), 0) AS INT) AS py FROM kept JOIN boxes b USING (fid) JOIN wins ON wins.window_id = b.window_id),
e AS (SELECT a.fid AS a, b.fid AS b FROM pts a JOIN pts b ON a.raster_id = b.raster_id AND a.fid <> b.fid WHERE sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) < 5),
reach(node, id) AS (SELECT fid, fid FROM pts UNION SELECT e.b, r.id FROM reach r JOIN e ON e.a = r.node), comp AS (SELECT node, min(id) AS c FROM reach GROUP BY node),
best AS (SELECT pts.* FROM comp JOIN pts ON fid = node QUALIFY row_number() OVER (PARTITION BY c ORDER BY score DESC, fid) = 1)
SELECT fid, raster_id, px, py, 500000 + px * 0.5::DOUBLE AS geo_x, 9500000 - py * 0.5::DOUBLE AS geo_y, score, 2 AS sigma, 1.0::DOUBLE AS crown_r, 'model' AS source FROM best""")
def _(spark, sf):
    # Each group of windows is its own raster, so that points do not pile up.
    windows = _windows(spark, sf).withColumn("raster_id", F.concat(F.lit("A"), F.col("window_id").cast("string")))
    meta = windows.select("raster_id").distinct().selectExpr("raster_id", "500000D AS xmin", "9500000D AS ymax", "0.5D AS px_size", "1280 AS width", "1540 AS height")
    return dedup_detections(I.boxes(spark, sf), windows, meta)


@query("j9_connected_components", """WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT o_orderkey, o_orderkey + 27 FROM orders WHERE o_orderkey % 108 = 4),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(node, id) AS (SELECT a, a FROM s UNION SELECT s.b, r.id FROM reach r JOIN s ON s.a = r.node)
SELECT node, min(id) AS component FROM reach GROUP BY node""")
def _(spark, sf):
    o = I.table(spark, sf, "orders")
    edges = o.filter("o_orderkey % 9 <> 0").selectExpr("o_orderkey AS src", "o_orderkey + 1 AS dst").unionByName(
        o.filter("o_orderkey % 108 = 4").selectExpr("o_orderkey AS src", "o_orderkey + 27 AS dst"))
    return graph.connected_components(edges)


@query("j10_dedup", "WITH RECURSIVE " + I.CLUSTERED + """, e AS (SELECT a.fid AS a, b.fid AS b FROM clustered a JOIN clustered b ON a.raster_id = b.raster_id AND a.fid <> b.fid
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < greatest(least(a.sigma, b.sigma) * 0.5, 7)),
reach(node, id) AS (SELECT fid, fid FROM clustered UNION SELECT e.b, r.id FROM reach r JOIN e ON e.a = r.node), comp AS (SELECT node, min(id) AS c FROM reach GROUP BY node)
SELECT fid FROM comp JOIN clustered ON fid = node QUALIFY row_number() OVER (PARTITION BY c ORDER BY score DESC, fid) = 1""")
def _(spark, sf):
    return graph.dedup(I.clustered(spark, sf), 0.5, 7.0, keys=["raster_id"]).select("fid")


def _bridges_sql() -> str:
    sql = "WITH " + I.LINES + ", l0 AS (SELECT fid, ax, ay, bx, b_y, length FROM lines)"
    for i in range(5):
        sql += f""", u{i} AS (SELECT x, y, count(*) AS n FROM (SELECT ax AS x, ay AS y FROM l{i} UNION ALL SELECT bx, b_y FROM l{i}) GROUP BY ALL),
l{i + 1} AS (SELECT l.* FROM l{i} l JOIN u{i} p ON p.x = l.ax AND p.y = l.ay JOIN u{i} q ON q.x = l.bx AND q.y = l.b_y WHERE NOT (length < 40 AND p.n > 1 AND q.n > 1))"""
    return sql + " SELECT fid, round(length, 6) AS length FROM l5"


@query("j11_drop_short_bridges", _bridges_sql())
def _(spark, sf):
    return roads.drop_short_bridges(I.lines(spark, sf).select("fid", "path", "length"), 40.0).select("fid", F.round("length", 6).alias("length"))


@query("j12_riparian_conflict", "WITH " + I.RECT + """, river AS (SELECT CAST((s_suppkey * 37) % 100 * 50 AS DOUBLE) AS ax, CAST((s_suppkey * 53) % 40 * 100 AS DOUBLE) AS ay,
  CAST((s_suppkey * 37) % 100 * 50 + 300 AS DOUBLE) AS bx, CAST((s_suppkey * 53) % 40 * 100 + 25 AS DOUBLE) AS b_y FROM supplier),
cells AS (SELECT fid, i + 0.5 AS x, j + 0.5 AS y FROM (SELECT fid, y0, h, unnest(range(x0::BIGINT, (x0 + w)::BIGINT)) AS i FROM rect), LATERAL (SELECT unnest(range(y0::BIGINT, (y0 + h)::BIGINT)) AS j)),
near AS (SELECT fid, x, y FROM cells c WHERE EXISTS (SELECT 1 FROM (SELECT *, greatest(0, least(1, ((c.x - ax) * (bx - ax) + (c.y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS t FROM river
   WHERE c.x BETWEEN ax - 20 AND bx + 20 AND c.y BETWEEN ay - 20 AND b_y + 20) r
  WHERE sqrt((c.x - ax - t * (bx - ax)) * (c.x - ax - t * (bx - ax)) + (c.y - ay - t * (b_y - ay)) * (c.y - ay - t * (b_y - ay))) <= 20))
SELECT fid, CAST(count(*) AS DOUBLE) AS area FROM near GROUP BY fid""")
def _(spark, sf):
    river = I.table(spark, sf, "supplier").selectExpr(
        "CAST((s_suppkey * 37) % 100 * 50 AS DOUBLE) AS ax", "CAST((s_suppkey * 53) % 40 * 100 AS DOUBLE) AS ay",
        "CAST((s_suppkey * 37) % 100 * 50 + 300 AS DOUBLE) AS bx", "CAST((s_suppkey * 53) % 40 * 100 + 25 AS DOUBLE) AS by")
    plans = I.rectangles(spark, sf).select("fid", F.array("pts").alias("rings"))
    return regions.riparian_conflict(plans, river, 20.0, 1.0)


@query("j13_clip_grid", "WITH " + I.RECT + """, g AS (SELECT fid, x0, y0, w, h, unnest(range(0, greatest(1, ceil(w / 8))::BIGINT)) AS c FROM rect), gg AS (SELECT *, unnest(range(0, greatest(1, ceil(h / 4))::BIGINT)) AS r FROM g)
SELECT fid, r::INT AS cell_row, c::INT AS cell_col, round(least(8, w - c * 8) * least(4, h - r * 4), 6) AS area FROM gg""")
def _(spark, sf):
    polys = I.rectangles(spark, sf).select("fid", F.array("pts").alias("rings"))
    return regions.clip_grid(polys, 8.0, 4.0).select("fid", "cell_row", "cell_col", F.round("area", 6).alias("area"))


@query("g5_clip_to_box", "WITH " + I.RECT + """ SELECT fid, (least(x0 + w, x0 + 20) - greatest(x0, x0 + 4)) * (least(y0 + h, y0 + 5) - greatest(y0, y0 + 0.5::DOUBLE)) AS area FROM rect WHERE w > 4 AND h > 0.5""")
def _(spark, sf):
    from sylva.functions.geometry import clip_to_box, pin, ring_area

    x0, y0 = F.col("x0"), F.col("y0")
    cut = pin(I.rectangles(spark, sf), cut=clip_to_box(F.col("pts"), x0 + 4, y0 + 0.5, x0 + 20, y0 + 5))
    return cut.withColumn("area", F.when(F.size("cut") >= 3, ring_area(F.col("cut"))).otherwise(0.0)).filter("area > 0").select("fid", "area")


@query("g6_fishnet", "WITH " + I.RECT + """, g AS (SELECT *, unnest(range(0, greatest(1, ceil(w / 8))::BIGINT)) AS c FROM rect), gg AS (SELECT *, unnest(range(0, greatest(1, ceil(h / 4))::BIGINT)) AS r FROM g)
SELECT fid, x0 + c * 8 AS x0, y0 + r * 4 AS y0, x0 + c * 8 + 8 AS x1, y0 + r * 4 + 4 AS y1 FROM gg""")
def _(spark, sf):
    boxes = I.rectangles(spark, sf).selectExpr("fid", "x0 AS xmin", "y0 AS ymin", "x0 + w AS xmax", "y0 + h AS ymax")
    return regions.fishnet(boxes, 8.0, 4.0).select("fid", "x0", "y0", "x1", "y1")


@query("j14_attach_photos", "WITH " + I.PHOTOS + " SELECT p.fid, CASE WHEN p.fid % 3 = 0 THEN NULL ELSE p.file_name END AS file_name FROM photos p")
def _(spark, sf):
    p = I.photos(spark, sf)
    return p.select("fid", "photo_path").transform(lambda d: field.attach_photos(d, p.filter("k % 3 <> 0").select("photo_path", "file_name"))).select("fid", "file_name")


@query("j15_pair_by_stem", """WITH img AS (SELECT concat('tile_', p_partkey % 700, '_', p_partkey, '.tiff') AS name, concat('tile_', p_partkey % 700, '_', p_partkey) AS stem FROM part),
lab AS (SELECT concat('tile_', p_partkey % 700, '_', p_partkey) AS stem, concat('tile_', p_partkey % 700, '_', p_partkey, e) AS name FROM part, (SELECT unnest(['.tif', '.png']) AS e) WHERE p_partkey % 3 <> 0)
SELECT img.stem, img.name AS image_name, min(lab.name) AS label_name FROM img JOIN lab ON img.stem = lab.stem GROUP BY ALL""")
def _(spark, sf):
    p = I.table(spark, sf, "part").withColumn("stem", F.expr("concat('tile_', p_partkey % 700, '_', p_partkey)"))
    images = p.select(F.concat("stem", F.lit(".tiff")).alias("name"))
    labels = p.filter("p_partkey % 3 <> 0").select(F.explode(F.array(*[F.concat("stem", F.lit(e)) for e in (".tif", ".png")])).alias("name"))
    return field.pair_by_stem(images, labels)


JUDGED = "WITH " + I.REPLIES + """, stop AS (SELECT coalesce((SELECT max(batch) - 4 FROM replies), 999999) AS q),
st AS (SELECT batch, CASE WHEN batch = (SELECT q FROM stop) THEN 'quota' ELSE status END AS status, text FROM replies),
tok AS (SELECT batch, unnest(string_split(text, ' ')) AS t FROM st, stop WHERE status = 'ok' AND batch < q),
ans AS (SELECT batch, CAST(split_part(t, ':', 1) AS INT) AS i, upper(split_part(t, ':', 2)) LIKE 'Y%' AS yes FROM tok)"""


def _judged_replies(spark, sf):
    rep = I.replies(spark, sf)
    last = rep.agg(F.max("batch") - 4).first()[0]
    return rep.withColumn("status", F.when(F.col("batch") == last, "quota").otherwise(F.col("status")))


@query("j16_apply_verdicts", JUDGED + """ SELECT event_id AS fid FROM events e LEFT JOIN ans ON ans.batch = e.event_id // 16 AND ans.i = e.event_id % 16 + 1 WHERE coalesce(yes, true)""")
def _(spark, sf):
    kept, _counts = verdicts.apply_verdicts(I.table(spark, sf, "events").selectExpr("event_id AS fid"), _judged_replies(spark, sf))
    return kept


@query("j16_verdict_counts", JUDGED + """ SELECT (SELECT count(*) FROM events e JOIN ans ON ans.batch = e.event_id // 16 AND ans.i = e.event_id % 16 + 1 WHERE NOT yes) AS rejected,
  (SELECT count(*) FROM st, stop WHERE status <> 'ok' AND batch <= q) AS api_errors, (SELECT text FROM st, stop WHERE status <> 'ok' AND batch <= q ORDER BY batch DESC LIMIT 1) AS last_error""")
def _(spark, sf):
    _kept, counts = verdicts.apply_verdicts(I.table(spark, sf, "events").selectExpr("event_id AS fid"), _judged_replies(spark, sf))
    return counts


@query("f5_parse_verdicts", "WITH " + I.REPLIES + """, tok AS (SELECT batch, unnest(string_split(text, ' ')) AS t FROM replies WHERE status = 'ok')
SELECT batch, CAST(split_part(t, ':', 1) AS INT) AS idx, upper(split_part(t, ':', 2)) LIKE 'Y%' AS yes FROM tok""")
def _(spark, sf):
    from sylva.functions.text import parse_verdicts

    return I.replies(spark, sf).filter("status = 'ok'").select("batch", F.explode(parse_verdicts(F.col("text"))).alias("idx", "yes"))


@query("a9_detection_summary", "WITH " + I.POINTS + ", " + I.FRAMED.replace("framed AS", "f AS") + """, a AS (SELECT * FROM allp WHERE fid % 5 <> 0), b AS (SELECT * FROM a WHERE fid % 7 <> 0),
c AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE """ + I.IN_FRAME + """))
SELECT (SELECT count(*) FROM c) AS tree_count, (SELECT count(*) FROM allp) - (SELECT count(*) FROM a) AS filtered_cleared_count,
  (SELECT count(*) FROM a) - (SELECT count(*) FROM b) AS rejected_by_ai_count, (SELECT count(*) FROM b) - (SELECT count(*) FROM c) AS excluded_by_area_count""")
def _(spark, sf):
    found = I.all_points(spark, sf).withColumn("raster_id", F.lit("A")).withColumn("py", F.col("fid")).withColumn("px", F.lit(0).cast("long"))
    mask = found.filter("fid % 5 = 0").select("raster_id", F.col("py").alias("row"), F.col("px").alias("col"))
    ground = drop_on_mask(found, mask)
    seen = ground.filter("fid % 7 <> 0")
    return detection_summary(found, ground, seen, regions.erase_points(seen, I.framed(spark, sf)))


@query("a14_crop_windows", "WITH " + I.RECT + """, p AS (SELECT fid, (x0 / 8) / 0.5 AS l, (x0 / 8 + w) / 0.5 AS r, (y0 / 8) / 0.5 AS t, (y0 / 8 + h * 20) / 0.5 AS b FROM rect),
q AS (SELECT *, least(greatest((r - l) / 2 + 20, 60), 400) AS hw, least(greatest((b - t) / 2 + 20, 60), 400) AS hh FROM p),
o AS (SELECT *, greatest(0, least(CAST(trunc((l + r) / 2 - hw) AS INT), 1279)) AS x_off, greatest(0, least(CAST(trunc((t + b) / 2 - hh) AS INT), 1539)) AS y_off FROM q)
SELECT fid, x_off, y_off, least(CAST(trunc(hw * 2) AS INT), 1280 - x_off) AS w, least(CAST(trunc(hh * 2) AS INT), 1540 - y_off) AS h FROM o""")
def _(spark, sf):
    feats = I.rectangles(spark, sf).selectExpr(
        "fid", I.raster_a("fid"), "500000 + x0 / 8 AS xmin", "500000 + x0 / 8 + w AS xmax", "9500000 - (y0 / 8 + h * 20) AS ymin", "9500000 - y0 / 8 AS ymax")
    meta = spark.range(1).selectExpr("'A' AS raster_id", "500000D AS xmin", "9500000D AS ymax", "0.5D AS px_size", "1280 AS width", "1540 AS height")
    return verdicts.crop_windows(feats, meta).drop("raster_id")


@query("e1_threshold_sweep", "WITH " + I.SAMPLES + """, t AS (SELECT unnest([0, 8, 18, 26, 30, 40]) AS threshold), c AS (SELECT threshold, count(*) FILTER (exg < threshold AND cls = 'bare') AS tp, count(*) FILTER (exg < threshold AND cls <> 'bare') AS fp,
  count(*) FILTER (exg >= threshold AND cls = 'bare') AS fn FROM samples, t GROUP BY threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""")
def _(spark, sf):
    s = evaluate.threshold_sweep(I.samples(spark, sf), [0, 8, 18, 26, 30, 40], "bare")
    return s.select("threshold", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


E2PTS = """ap AS (SELECT fid, k, CASE WHEN k <= 6 THEN x0 + k * 2 ELSE x0 + 12 END AS x, CASE WHEN k <= 6 THEN y0 ELSE y0 + (k - 6) * 2 END AS y FROM zig, (SELECT unnest(range(0, 15)) AS k)),
bp AS (SELECT fid, k, x + 3 + fid % 5 AS x, y + 1 AS y FROM ap WHERE fid % 4 <> 0)"""


@query("e2_buffer_score", "WITH " + I.ZIGZAGS + ", " + E2PTS + """, a AS (SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM bp WHERE bp.x BETWEEN ap.x - 4 AND ap.x + 4 AND bp.y BETWEEN ap.y - 4 AND ap.y + 4
    AND (bp.x - ap.x) * (bp.x - ap.x) + (bp.y - ap.y) * (bp.y - ap.y) <= 16)) AS m FROM ap),
b AS (SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM ap WHERE ap.x BETWEEN bp.x - 4 AND bp.x + 4 AND ap.y BETWEEN bp.y - 4 AND bp.y + 4
    AND (bp.x - ap.x) * (bp.x - ap.x) + (bp.y - ap.y) * (bp.y - ap.y) <= 16)) AS m FROM bp)
SELECT a.n AS found_all, a.m AS found_near, b.n AS truth_all, b.m AS truth_near, round(a.m / a.n, 6) AS correctness, round(b.m / b.n, 6) AS completeness,
  round(2 * (a.m / a.n) * (b.m / b.n) / (a.m / a.n + b.m / b.n), 6) AS f1 FROM a, b""")
def _(spark, sf):
    found = I.zigzags(spark, sf)
    truth = found.filter("fid % 4 <> 0").selectExpr("fid", "transform(path, p -> struct(p.x + 3 + fid % 5 AS x, p.y + 1 AS y)) AS path")
    s = evaluate.buffer_score(found, truth, 4.0, 2.0)
    return s.select("found_all", "found_near", "truth_all", "truth_near", *[F.round(c, 6).alias(c) for c in ("correctness", "completeness", "f1")])


# Two legs each, the true ones moved by (3 + fid % 5, 1): what lies within 4 m in closed form.
@query("e2_buffer_lengths", "WITH " + I.ZIGZAGS + """, m AS (SELECT fid % 4 <> 0 AS kept, 3 + fid % 5 AS s FROM zig),
l AS (SELECT sum(28.0::DOUBLE) AS fl, sum(CASE WHEN kept THEN 12 - greatest(0, s - sqrt(15)) + CASE WHEN s <= 4 THEN 16 ELSE 5 END ELSE 0 END) AS fn, sum(CASE WHEN kept THEN 28.0::DOUBLE ELSE 0 END) AS tl,
  sum(CASE WHEN kept THEN least(12, 16 - s) + CASE s WHEN 3 THEN 16 WHEN 4 THEN 15 ELSE 0 END ELSE 0 END)::DOUBLE AS tn FROM m)
SELECT fl AS found_length, round(fn, 6) AS found_near, tl AS truth_length, round(tn, 6) AS truth_near, round(fn / fl, 9) AS correctness, round(tn / tl, 9) AS completeness, round(2 * (fn / fl) * (tn / tl) / (fn / fl + tn / tl), 9) AS f1 FROM l""")
def _(spark, sf):
    found = I.zigzags(spark, sf)
    truth = found.filter("fid % 4 <> 0").selectExpr("fid", "transform(path, p -> struct(p.x + 3 + fid % 5 AS x, p.y + 1 AS y)) AS path")
    s = evaluate.buffer_lengths(found, truth, 4.0)
    return s.select("found_length", F.round("found_near", 6).alias("found_near"), "truth_length", F.round("truth_near", 6).alias("truth_near"), *[F.round(c, 9).alias(c) for c in ("correctness", "completeness", "f1")])


@query("e3_mask_score", "WITH " + I.MASK + """, t AS (SELECT row, col FROM pix WHERE kind = 'crown' AND k % 5 <> 0), c AS (SELECT count(*) FILTER (m.row IS NOT NULL AND t.row IS NOT NULL) AS tp, count(*) FILTER (t.row IS NULL) AS fp,
  count(*) FILTER (m.row IS NULL) AS fn FROM mask m FULL OUTER JOIN t ON m.row = t.row AND m.col = t.col)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + 0.000001) / (tp + fp + fn + 0.000001), 6)::DOUBLE AS iou FROM c""")
def _(spark, sf):
    truth = I.pixels(spark, sf).filter("kind = 'crown' AND k % 5 <> 0")
    s = evaluate.mask_score(I.crown_mask(spark, sf), truth)
    return s.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "iou")])


@query("e5_dice", "WITH " + I.TILES + """, d AS (SELECT raster_id, 1 - (2 * sum(CASE WHEN v > 0 THEN abs(v) ELSE 0 END) + 0.000001::DOUBLE) / (sum(abs(v)) + count(*) FILTER (v > 0) + 0.000001::DOUBLE) AS l FROM tiles8 GROUP BY raster_id)
SELECT round(avg(l), 6) AS dice_loss, count(*) AS images FROM d""")
def _(spark, sf):
    df = I.small_tiles(spark, sf).select("raster_id", F.abs("v").alias("prob"), F.when(F.col("v") > 0, 1.0).otherwise(0.0).alias("truth"))
    return evaluate.dice(df).select(F.round("dice_loss", 6).alias("dice_loss"), "images")


@query("a7_length_km", "WITH " + I.LINES + " SELECT count(*) AS line_count, round(sum(length) / 1000, 6) AS length_km FROM lines")
def _(spark, sf):
    return roads.length_km(I.lines(spark, sf)).select("line_count", F.round("length_km", 6).alias("length_km"))


@query("g4_line_length", "WITH " + I.ZIGZAGS + " SELECT fid, 28.0::DOUBLE AS length, x0 AS ax, y0 AS ay, x0 + 12 AS bx, y0 + 16 AS by FROM zig")
def _(spark, sf):
    from sylva.functions.geometry import endpoints

    return I.zigzags(spark, sf).withColumn("_e", endpoints(F.col("path"))).select(
        "fid", line_length(F.col("path")).alias("length"), F.col("_e")[0]["x"].alias("ax"), F.col("_e")[0]["y"].alias("ay"), F.col("_e")[1]["x"].alias("bx"), F.col("_e")[1]["y"].alias("by"))


@query("s6_read_photo_points", "WITH " + I.PHOTOS + " SELECT fid, lon AS x, lat AS y FROM photos WHERE lat IS NOT NULL AND lon IS NOT NULL")
def _(spark, sf):
    return readers.read_photo_points(I.photos(spark, sf)).select("fid", "x", "y")
