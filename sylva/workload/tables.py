"""Queries over field tables, texts and scalar functions."""

from __future__ import annotations


from pyspark.sql import functions as F

from sylva.functions import geometry as geo
from sylva.functions import projection, text
from sylva.operators import field, numbering
from sylva.plans.trees import first_per_place, scale_union
from sylva.sources import readers, writers
from sylva.workload import inputs as I
from sylva.workload.registry import query

CRUISE = "WITH " + I.CRUISE + " "


@query("s5_read_cruise", CRUISE + """SELECT Species AS "Species", Diameter_cm AS "Diameter_cm", Volume_m3_ AS "Volume_m3_", X AS "X", Y AS "Y", 32750 AS wkid FROM cruise""")
def _(spark, sf):
    # Only the second of the two known table names exists here.
    folder = I.scratch(spark, "cruise")
    I.cruise(spark, sf).write.option("header", True).csv(f"{folder}/{readers.CRUISE_TABLES[1]}.csv")
    return readers.read_cruise(spark, folder, 32750)


@query("p15_biomass", CRUISE + """SELECT Species AS "Species", X AS "X", Y AS "Y", round(Volume_m3_ * 600 * 1.5 * 1.37::DOUBLE, 6) AS "Biomass_kg", round(Volume_m3_ * 600 * 1.5 * 1.37::DOUBLE * 0.47::DOUBLE, 6) AS "Carbon_kg" FROM cruise""")
def _(spark, sf):
    return field.biomass(I.cruise(spark, sf)).select("Species", "X", "Y", F.round("Biomass_kg", 6).alias("Biomass_kg"), F.round("Carbon_kg", 6).alias("Carbon_kg"))


@query("a1_species_summary", CRUISE + "SELECT Species AS species, sum(Volume_m3_) AS sum_volume, count(Volume_m3_) AS count_volume FROM cruise GROUP BY Species")
def _(spark, sf):
    return field.species_summary(I.cruise(spark, sf))


@query("s13_write_report", CRUISE + "SELECT Species AS species, sum(Volume_m3_) AS sum_volume, count(Volume_m3_)::INT AS count_volume FROM cruise GROUP BY Species")
def _(spark, sf):
    path = I.scratch(spark, "report")
    writers.write_report(field.species_summary(I.cruise(spark, sf)), path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


@query("a2_import_summary", CRUISE + "SELECT count(*) AS tree_count, sum(Volume_m3_) AS total_volume FROM cruise")
def _(spark, sf):
    return field.import_summary(I.cruise(spark, sf))


@query("a3_biomass_total", CRUISE + """, v AS (SELECT sum(Volume_m3_) AS v FROM cruise) SELECT v AS volume_m3, round(v * 600 * 1.5 * 1.37::DOUBLE, 3) AS biomass_kg,
  round(v * 600 * 1.5 * 1.37::DOUBLE * 0.47::DOUBLE, 3) AS carbon_kg, round(v * 600 * 1.5 * 1.37::DOUBLE * 0.47::DOUBLE * 3.667::DOUBLE, 3) AS co2e_kg FROM v""")
def _(spark, sf):
    t = field.biomass_total(I.cruise(spark, sf))
    return t.select("volume_m3", *[F.round(c, 3).alias(c) for c in ("biomass_kg", "carbon_kg", "co2e_kg")])


@query("a4_median", "SELECT median(l_extendedprice) AS median_price FROM lineitem")
def _(spark, sf):
    df = I.table(spark, sf, "lineitem")
    return numbering.median_frame(df, F.col("l_extendedprice"), "median_price")


MEASURED = "WITH " + I.RECT + """, m AS (SELECT fid, w * h AS area, 2 * (w + h) AS length, 4 * pi() * (w * h) / (2 * (w + h) * (2 * (w + h))) AS thin FROM rect)"""


@query("a5_slivers", MEASURED + """, q AS (SELECT median(area) AS ma, median(thin) AS mt FROM m)
SELECT fid, area AS sliver_area, ma AS median_area, ma * 0.1::DOUBLE AS area_limit, round(mt, 6) AS median_thinness, round(mt * 0.5, 6) AS thinness_limit FROM m, q WHERE area < ma * 0.1::DOUBLE OR thin < mt * 0.5""")
def _(spark, sf):
    s = field.slivers(I.rectangles(spark, sf))
    return s.select("fid", "sliver_area", "median_area", "area_limit", F.round("median_thinness", 6).alias("median_thinness"), F.round("thinness_limit", 6).alias("thinness_limit"))


@query("g2_ring_measures", MEASURED + " SELECT fid, area, length, round(thin, 6) AS thinness FROM m")
def _(spark, sf):
    return field.ring_measures(I.rectangles(spark, sf)).select("fid", "area", "length", F.round("thinness", 6).alias("thinness"))


@query("a6_area_ha", MEASURED + " SELECT count(*) AS polygon_count, round(sum(area) / 10000, 6) AS area_ha FROM m")
def _(spark, sf):
    return field.area_ha(field.ring_measures(I.rectangles(spark, sf))).select("polygon_count", F.round("area_ha", 6).alias("area_ha"))


@query("a13_bbox", "WITH " + I.POINTS + " SELECT fid % 7 AS block, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM allp GROUP BY 1")
def _(spark, sf):
    return field.bbox(I.all_points(spark, sf).withColumn("block", F.col("fid") % 7), ["block"])


@query("a15_sample_counts", "WITH " + I.SAMPLES + " SELECT cls, count(*) AS n FROM samples GROUP BY cls")
def _(spark, sf):
    return field.sample_counts(I.samples(spark, sf))


@query("f12_category_label", "WITH " + I.CLICKS + " SELECT fid, CASE WHEN cls = 'my own' THEN cls ELSE 'Water/river' END AS cls, CASE WHEN cls = 'my own' THEN NULL ELSE 6 END AS category_code FROM clicks")
def _(spark, sf):
    return text.category_label(I.clicks(spark, sf)).select("fid", "cls", "category_code")


@query("p14_confirmed", "WITH " + I.PHOTOS + " SELECT fid FROM photos WHERE lat IS NOT NULL AND lon IS NOT NULL AND (k % 3 = 0 OR k % 5 <> 0)")
def _(spark, sf):
    rows = I.photos(spark, sf).selectExpr("fid", "lon AS x", "lat AS y", "4326 AS wkid", "CASE WHEN k % 3 = 0 THEN NULL WHEN k % 5 = 0 THEN false ELSE true END AS include")
    return field.confirmed(rows).select("fid")


@query("p16_slope_class", "WITH " + I.DEM + """ SELECT row, col, CASE WHEN v <= 15 THEN 'easy' WHEN v <= 25 THEN 'moderate' WHEN v <= 40 THEN 'difficult' ELSE 'restricted' END AS slope_class FROM dem""")
def _(spark, sf):
    return I.dem(spark, sf).select("row", "col", field.slope_class(F.col("v")).alias("slope_class"))


@query("p18_identify", "WITH " + I.POINTS + """, hit AS (SELECT * FROM allp WHERE x BETWEEN 500100 AND 500400 AND y BETWEEN 9500050 AND 9500900),
att AS (SELECT o_orderkey AS fid, c AS attachment_id, concat('/p/', o_orderkey, '_', c) AS photo_path FROM orders, (SELECT unnest([3, 1, 2]) AS c) WHERE (o_orderkey + c) % 3 <> 0)
SELECT fid, x, y, min(attachment_id) AS attachment_id, min_by(photo_path, attachment_id) AS photo_path FROM hit h JOIN att USING (fid) GROUP BY fid, x, y""")
def _(spark, sf):
    att = I.table(spark, sf, "orders").selectExpr("o_orderkey AS fid", "explode(array(3, 1, 2)) AS attachment_id").filter("(fid + attachment_id) % 3 <> 0").withColumn(
        "photo_path", F.expr("concat('/p/', fid, '_', attachment_id)"))
    return field.identify(I.all_points(spark, sf), att, 500100, 9500050, 500400, 9500900)


# ---- order and numbering -----------------------------------------------------

@query("o1_run_history", "WITH " + I.STATUS + " SELECT ts, feature, message, event_id FROM entries ORDER BY ts DESC, event_id DESC LIMIT 200")
def _(spark, sf):
    log = I.status_log(spark, sf).select("ts", text.feature_of(F.col("property")).alias("feature"), "message", "event_id")
    return field.run_history(log, tie=["event_id"])


@query("o2_largest_ring", """WITH r AS (SELECT p_partkey // 4 AS fid, CAST(p_partkey % 4 AS INT) AS part, (1 + p_size) * (1 + p_partkey % 7) AS a FROM part)
SELECT fid, part, row_number() OVER (PARTITION BY fid ORDER BY a DESC, part) = 1 AS "outer" FROM r""")
def _(spark, sf):
    rings = I.rectangles(spark, sf).selectExpr("fid div 4 AS fid", "CAST(fid % 4 AS INT) AS part", "pts")
    return field.largest_ring(rings).select("fid", "part", "outer")


@query("o3_longest_part", "WITH " + I.LINES + """, p AS (SELECT fid // 5 AS fid, CAST(fid % 5 AS INT) AS part, length FROM lines)
SELECT fid, part, round(length, 6) AS length FROM p QUALIFY row_number() OVER (PARTITION BY fid ORDER BY length DESC, part) = 1""")
def _(spark, sf):
    parts = I.lines(spark, sf).selectExpr("fid div 5 AS fid", "CAST(fid % 5 AS INT) AS part", "path").withColumn("length", geo.line_length(F.col("path")))
    return field.longest_part(parts).select("fid", "part", F.round("length", 6).alias("length"))


@query("w7_cell_ids", "WITH " + I.POINTS + """ SELECT fid, row_number() OVER (ORDER BY y, x, fid) AS "Cell_ID", row_number() OVER (PARTITION BY fid % 5 ORDER BY y, x, fid) AS in_block FROM allp""")
def _(spark, sf):
    numbered = numbering.cell_ids(I.all_points(spark, sf), ["y", "x", "fid"]).withColumn("block", F.col("fid") % 5)
    return numbering.cell_ids(numbered, ["y", "x", "fid"], ["block"], "in_block").select("fid", "Cell_ID", "in_block")


@query("u3_seen_set", "WITH " + I.CLICKS + " SELECT DISTINCT pc AS px, pr AS py, CAST(fid % 2 AS INT) AS sigma FROM clickcell")
def _(spark, sf):
    c = I.clicks(spark, sf).select(
        ((F.col("x") - I.XMIN) / I.PX).cast("int").alias("px"), ((I.YMAX - F.col("y")) / I.PX).cast("int").alias("py"), (F.col("fid") % 2).cast("int").alias("sigma"))
    seen = c.select(F.lit("A").alias("raster_id"), F.col("py").alias("row"), F.col("px").alias("col"), "sigma", F.lit(0).cast("long").alias("label"))
    return first_per_place(seen).select(F.col("col").alias("px"), F.col("row").alias("py"), "sigma")


@query("u4_multi_scale_union", "WITH " + I.CLUSTERED + " SELECT fid, 20 AS sigma FROM clustered WHERE sigma = 20 UNION ALL SELECT fid, 12 FROM clustered WHERE fid % 2 = 0")
def _(spark, sf):
    c = I.clustered(spark, sf)
    return scale_union({20: c.filter("sigma = 20").select("fid"), 12: c.filter("fid % 2 = 0").select("fid")})


@query("u5_group_by_crs", "WITH " + I.POINTS + " SELECT fid, x, y, CAST(32700 + 46 + fid % 9 AS INT) AS wkid FROM allp")
def _(spark, sf):
    path = I.scratch(spark, "by_wkid")
    writers.write_by_wkid(I.all_points(spark, sf).withColumn("wkid", (F.col("fid") % 9 + 32746).cast("int")), path)
    return spark.read.parquet(path).select("fid", "x", "y", "wkid")


@query("p13_find_column", """SELECT l_orderkey * 8 + l_linenumber AS fid, l_quantity / 10.0 AS volume, p_type AS species FROM lineitem JOIN part ON p_partkey = l_partkey""")
def _(spark, sf):
    lines = I.table(spark, sf, "lineitem").join(I.table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    layer = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fid"), F.col("p_type").alias("Jenis_Pohon"), (F.col("l_quantity") / 10.0).alias("VOLUME_m3_"))
    return layer.select("fid", F.col(field.find_column(layer, "volume")).alias("volume"), F.col(field.find_column(layer, "species")).alias("species"))


# ---- text --------------------------------------------------------------------

@query("f1_parse_utm", "WITH " + I.PHOTOS + f""", z AS (SELECT fid, utm_text, regexp_extract(utm_text, '{text.UTM_WITH_ZONE}', 1) AS zone, regexp_extract(utm_text, '{text.UTM_WITH_ZONE}', 2) AS band FROM photos)
SELECT fid, CASE WHEN zone <> '' THEN regexp_extract(utm_text, '{text.UTM_WITH_ZONE}', 3)::DOUBLE END AS x, CASE WHEN zone <> '' THEN regexp_extract(utm_text, '{text.UTM_WITH_ZONE}', 4)::DOUBLE END AS y,
  CASE WHEN zone <> '' THEN (CASE WHEN band <= 'M' THEN 32700 ELSE 32600 END) + zone::INT END AS wkid FROM z""")
def _(spark, sf):
    return I.photos(spark, sf).withColumn("_u", text.parse_utm(F.col("utm_text"))).select("fid", "_u.x", "_u.y", "_u.wkid")


@query("f2_parse_bare_utm", "WITH " + I.PHOTOS + f""", z AS (SELECT fid, utm_text, regexp_extract(utm_text, '{text.UTM_WITH_ZONE}', 1) AS zone, regexp_extract(utm_text, '{text.UTM_WITH_ZONE}', 2) AS band FROM photos)
SELECT fid, regexp_extract(utm_text, '{text.BARE_UTM}', 1)::DOUBLE AS x, regexp_extract(utm_text, '{text.BARE_UTM}', 2)::DOUBLE AS y,
  CASE WHEN zone <> '' THEN (CASE WHEN band <= 'M' THEN 32700 ELSE 32600 END) + zone::INT ELSE 32750 END AS wkid FROM z""")
def _(spark, sf):
    return I.photos(spark, sf).withColumn("_u", text.parse_grid(F.col("utm_text"), 50, True)).select("fid", "_u.x", "_u.y", "_u.wkid")


@query("f3_parse_latlon", "WITH " + I.PHOTOS + """ SELECT fid, regexp_extract(dec_text, '([0-9]+\\.[0-9]+) E', 1)::DOUBLE AS x,
  regexp_extract(dec_text, 'at ([0-9]+\\.[0-9]+)', 1)::DOUBLE * (CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END) AS y, 4326 AS wkid FROM photos""")
def _(spark, sf):
    return I.photos(spark, sf).withColumn("_u", text.parse_latlon(F.col("dec_text"))).select("fid", "_u.x", "_u.y", "_u.wkid")


@query("f3_parse_latlon_noise")
def _(spark, sf):
    return I.table(spark, sf, "conversations").withColumn("_u", text.parse_latlon(F.col("text"))).select("conv_id", "turn", "_u.x", "_u.y", "_u.wkid")


@query("f4_clean_text", "SELECT doc_id, trim(regexp_replace(text, '[\r\n]', ' ', 'g'), ' ') AS cleaned FROM documents")
def _(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("f6_safe_name", r"SELECT conv_id, turn, role, CASE WHEN regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g') = '' THEN 'Uncategorized' ELSE regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g') END AS name FROM conversations")
def _(spark, sf):
    return I.table(spark, sf, "conversations").select("conv_id", "turn", "role", text.safe_name(F.col("text")).alias("name"))


# ---- numbers -----------------------------------------------------------------

@query("f8_rotate", "WITH " + I.POINTS + """, a AS (SELECT fid, x - 500000 AS dx, y - 9500000 AS dy, (fid % 360) * pi() / 180.0 AS r FROM allp)
SELECT fid, round(500000 + dx * cos(r) - dy * sin(r), 5) AS x, round(9500000 + dx * sin(r) + dy * cos(r), 5) AS y FROM a""")
def _(spark, sf):
    p, deg = I.all_points(spark, sf), F.col("fid") % 360
    args = (F.col("x"), F.col("y"), F.lit(500000.0), F.lit(9500000.0), deg)
    return p.select("fid", F.round(geo.rotate_x(*args), 5).alias("x"), F.round(geo.rotate_y(*args), 5).alias("y"))


def _series(terms, fn_a: str, fn_b: str, xi: str, eta: str, sign: str) -> str:
    return "".join(f" {sign} {c!r}::DOUBLE * {fn_a}({2 * j} * {xi}) * {fn_b}({2 * j} * {eta})" for j, c in enumerate(terms, 1))


_K = projection.SCALE * projection.RECTIFYING
_E = projection.ECCENTRICITY


@query("f9_utm_to_wgs84", "WITH " + I.POINTS + f""", a AS (SELECT fid, 46 + fid % 9 AS zone, (y - 10000000) / {_K!r}::DOUBLE AS xi, (x - 500000) / {_K!r}::DOUBLE AS eta FROM allp),
b AS (SELECT fid, zone, xi {_series(projection.BETA, 'sin', 'cosh', 'xi', 'eta', '-')} AS xi0, eta {_series(projection.BETA, 'cos', 'sinh', 'xi', 'eta', '-')} AS eta0 FROM a),
c AS (SELECT fid, zone, xi0, eta0, asin(sin(xi0) / cosh(eta0)) AS chi FROM b)
SELECT fid, round(degrees(chi {''.join(f" + {d!r}::DOUBLE * sin({2 * j} * chi)" for j, d in enumerate(projection.DELTA, 1))}), 8) AS lat, round(zone * 6 - 183 + degrees(atan2(sinh(eta0), cos(xi0))), 8) AS lon FROM c""")
def _(spark, sf):
    g = projection.utm_to_wgs84(F.col("x"), F.col("y"), (F.col("fid") % 9 + 32746).cast("int"))
    return I.all_points(spark, sf).withColumn("_g", g).select("fid", F.round("_g.lat", 8).alias("lat"), F.round("_g.lon", 8).alias("lon"))


@query("f9_wgs84_to_utm", f"""WITH p AS (SELECT o_orderkey AS fid, -5 + (o_orderkey % 1024) / 128.0::DOUBLE AS lat, 117 + (o_orderkey % 768 - 384) / 128.0::DOUBLE AS lon FROM orders),
a AS (SELECT fid, lat, sinh(atanh(sin(radians(lat))) - {_E!r}::DOUBLE * atanh({_E!r}::DOUBLE * sin(radians(lat)))) AS t, radians(lon - 117) AS dl FROM p),
b AS (SELECT fid, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM a)
SELECT fid, round(500000 + {_K!r}::DOUBLE * (eta {_series(projection.ALPHA, 'cos', 'sinh', 'xi', 'eta', '+')}), 4) AS x,
  round(10000000 + {_K!r}::DOUBLE * (xi {_series(projection.ALPHA, 'sin', 'cosh', 'xi', 'eta', '+')}), 4) AS y FROM b""")
def _(spark, sf):
    p = I.table(spark, sf, "orders").selectExpr("o_orderkey AS fid", "-5 + (o_orderkey % 1024) / 128D AS lat", "117 + (o_orderkey % 768 - 384) / 128D AS lon")
    return p.withColumn("_u", projection.wgs84_to_utm(F.col("lat"), F.col("lon"), F.lit(32750))).select("fid", F.round("_u.x", 4).alias("x"), F.round("_u.y", 4).alias("y"))


@query("f10_round_mm", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(l_quantity / 16, 3) AS mm FROM lineitem")
def _(spark, sf):
    return I.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", geo.round_mm(F.col("l_quantity") / 16).alias("mm"))


@query("g3_dist_point_segment", "WITH " + I.LINES + """, p AS (SELECT *, CAST(fid % 50 AS DOUBLE) AS px, CAST(fid % 70 AS DOUBLE) AS py, (bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay) AS l2 FROM lines),
q AS (SELECT *, CASE WHEN l2 > 0 THEN greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / l2)) ELSE 0 END AS t FROM p)
SELECT fid, round(sqrt((ax + t * (bx - ax) - px) * (ax + t * (bx - ax) - px) + (ay + t * (b_y - ay) - py) * (ay + t * (b_y - ay) - py)), 6) AS d FROM q""")
def _(spark, sf):
    px, py = (F.col("fid") % 50).cast("double"), (F.col("fid") % 70).cast("double")
    return I.lines(spark, sf).select("fid", F.round(geo.dist_point_segment(px, py, *[F.col(c) for c in ("ax", "ay", "bx", "by")]), 6).alias("d"))


@query("g7_vertical_crossings", "WITH " + I.FRAMED + """, c AS (SELECT fid, unnest(CASE WHEN s = 16 THEN [y0, y0 + 4, y0 + 12, y0 + 16] ELSE [y0, y0 + 2, y0 + 6, y0 + 8] END) AS y FROM framed) SELECT fid, y FROM c""")
def _(spark, sf):
    f = I.framed(spark, sf).withColumn("ys", geo.vertical_crossings(F.col("x0") + F.col("s") / 2, F.col("rings")))
    return f.select("fid", F.explode("ys").alias("y"))


