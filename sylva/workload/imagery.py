"""Queries over pixel tables: sources, predicates, neighbourhoods, regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.functions import bands as B
from sylva.operators import raster as R
from sylva.operators import regions as G
from sylva.operators import stencil as S
from sylva.operators.outlines import outlines
from sylva.operators.roads import trace_lines
from sylva.plans.clearing import cleared_cells, detect_clearing
from sylva.plans.roads import extract_roads
from sylva.plans.terrain import slope_map
from sylva.plans.trees import detect_trees, drop_on_mask
from sylva.session import materialize
from sylva.sources import readers, writers
from sylva.workload import inputs as I
from sylva.workload.registry import query

WITH = "WITH " + I.PIX + " "
RECURSIVE = "WITH RECURSIVE "
VALID = "(CASE WHEN r > 240 AND g > 240 AND b > 240 THEN false ELSE r > 0 OR g > 0 OR b > 0 END)"
EXG = "(2 * g - r - b)"


# ---- sources -----------------------------------------------------------------

@query("s1_read_raster", WITH + "SELECT row, col, r, g, b FROM pix")
def _(spark, sf):
    path = I.scratch(spark, "raster")
    I.pixels(spark, sf).select("raster_id", "row", "col", "r", "g", "b").write.parquet(path)
    return readers.read_raster(spark, path).select("row", "col", "r", "g", "b")


@query("s2_read_rows", WITH + "SELECT row, col, r, g, b FROM pix WHERE row >= 30 AND row < 80")
def _(spark, sf):
    return R.read_rows(I.pixels(spark, sf), 30, 50).select("row", "col", "r", "g", "b")


@query("s3_read_window", WITH + "SELECT row, col, r, g, b FROM pix WHERE col >= 10 AND col < 45 AND row >= 20 AND row < 60")
def _(spark, sf):
    return R.read_window(I.pixels(spark, sf), 10, 20, 35, 40).select("row", "col", "r", "g", "b")


@query("s3_window_of_tiles", WITH + "SELECT row, col, r, g, b, alpha FROM pix WHERE col >= 10 AND col < 45 AND row >= 20 AND row < 60")
def _(spark, sf):
    path = I.scratch(spark, "tiles")
    writers.write_raster(R.to_tiles(I.pixels(spark, sf, alpha=True), 16), path, 2)
    return readers.read_raster_window(spark, path, 10, 20, 35, 40, 16, 2).select("row", "col", "r", "g", "b", "alpha")


@query("s4_tiles", WITH + "SELECT row, col, r, g, b, alpha FROM pix")
def _(spark, sf):
    return R.to_pixels(R.to_tiles(I.pixels(spark, sf, alpha=True), 32)).select("row", "col", "r", "g", "b", "alpha")


@query("s4_tiles_with_gaps", "WITH " + I.PIX + " SELECT row, col, r, g, b FROM pix WHERE (row * 3 + col) % 7 <> 0 AND row % 50 < 47")
def _(spark, sf):
    holed = I.pixels(spark, sf).filter("(row * 3 + col) % 7 <> 0 AND row % 50 < 47")
    return R.to_pixels(R.to_tiles(holed, 32)).select("row", "col", "r", "g", "b")


@query("s7_write_points", """SELECT 500000.0::DOUBLE + o_orderkey % 100 AS x, 9500000.0::DOUBLE AS y, 0.0::DOUBLE AS crown_r, CAST(o_orderkey % 7 AS INT) AS sigma_px,
  CASE WHEN o_orderkey % 2 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS score, 'exg' AS source FROM orders""")
def _(spark, sf):
    trees = I.table(spark, sf, "orders").selectExpr(
        "500000D + o_orderkey % 100 AS geo_x", "9500000D AS geo_y", "CAST(o_orderkey % 7 AS INT) AS sigma", "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 0.5D END AS score")
    path = I.scratch(spark, "trees")
    writers.write_points(trees, path)
    return spark.read.parquet(path)


@query("s8_write_mask", WITH + "SELECT raster_id, row, col, 1 AS v FROM pix WHERE kind = 'bare'")
def _(spark, sf):
    path = I.scratch(spark, "mask")
    writers.write_mask(I.pixels(spark, sf).withColumn("v", (F.col("kind") == "bare").cast("int")), path)
    return spark.read.parquet(path)


@query("s9_write_samples", "WITH " + I.SAMPLES + """ SELECT x, y, '' AS "Label", cls AS "Class", r AS "R", g AS "G", b AS "B", exg AS "ExG" FROM samples""")
def _(spark, sf):
    path = I.scratch(spark, "samples")
    writers.write_samples(I.samples(spark, sf), path)
    return spark.read.parquet(path)


# ---- predicates --------------------------------------------------------------

@query("p1_valid_mask", WITH + f"""SELECT row, col, {VALID} AS valid, alpha > 0 AS valid_alpha FROM pix""")
def _(spark, sf):
    plain = I.pixels(spark, sf).withColumn("valid", B.valid_mask())
    alpha = I.pixels(spark, sf, alpha=True).withColumn("valid_alpha", B.valid_mask()).select("row", "col", "valid_alpha")
    return plain.select("row", "col", "valid").join(alpha, ["row", "col"])


@query("p2_exg", WITH + f"SELECT row, col, {EXG} AS exg FROM pix")
def _(spark, sf):
    return I.pixels(spark, sf).select("row", "col", B.exg().alias("exg"))


@query("p3_veg_mask", WITH + f"SELECT row, col, {VALID} AND {EXG} > 18 AS veg FROM pix")
def _(spark, sf):
    return I.pixels(spark, sf).select("row", "col", B.veg_mask(18).alias("veg"))


@query("p4_brightness", WITH + "SELECT row, col, round((r + g + b) / 3.0::DOUBLE, 6) AS brightness FROM pix")
def _(spark, sf):
    return I.pixels(spark, sf).select("row", "col", F.round(B.brightness(), 6).alias("brightness"))


@query("p5_water_mask", WITH + "SELECT row, col FROM pix WHERE (r + g + b) / 3.0 < 150 AND b >= r")
def _(spark, sf):
    return I.pixels(spark, sf).filter(B.water_mask()).select("row", "col")


@query("p6_cleared_mask", WITH + f"SELECT row, col FROM pix WHERE {VALID} AND {EXG} < 26 AND NOT ((r + g + b) / 3.0 < 150 AND b >= r)")
def _(spark, sf):
    return cleared_cells(I.pixels(spark, sf), I.meta(spark, sf), 26, smooth_px=0, opening=0, closing=0).select("row", "col")


@query("p7_fresh_color", WITH + f"""SELECT row, col FROM pix WHERE {VALID} AND {EXG} < 26 AND NOT ((r + g + b) / 3.0 < 150 AND b >= r)
  AND (r + g + b) / 3.0 > 110 AND r >= b""")
def _(spark, sf):
    return I.pixels(spark, sf).filter(B.cleared_mask(26, fresh=True, bright_min=110.0)).select("row", "col")


@query("p8_geo_pixel", "WITH " + I.CLICKS + """ SELECT fid, pr AS row, pc AS col, 500000 + pc * 0.5::DOUBLE AS x, 9500000 - pr * 0.5::DOUBLE AS y FROM clickcell""")
def _(spark, sf):
    p = I.clicks(spark, sf).withColumn("row", B.pixel_row(F.col("y"), F.lit(I.YMAX), F.lit(I.PX))).withColumn("col", B.pixel_col(F.col("x"), F.lit(I.XMIN), F.lit(I.PX)))
    return p.select("fid", "row", "col", B.geo_x(F.col("col"), F.lit(I.XMIN), F.lit(I.PX)).alias("x"), B.geo_y(F.col("row"), F.lit(I.YMAX), F.lit(I.PX)).alias("y"))


@query("p9_scale_params", """WITH p AS (SELECT p_partkey AS fid, (1 + p_partkey % 64) / 256.0::DOUBLE AS px FROM part)
SELECT fid, greatest(1, CAST(round_even(75.0::DOUBLE * (0.05::DOUBLE / px), 0) AS INT)) AS sigma, greatest(5, CAST(round_even(25.0::DOUBLE * (0.05::DOUBLE / px), 0) AS INT)) AS blur_window FROM p""")
def _(spark, sf):
    px = F.col("px")
    return I.table(spark, sf, "part").selectExpr("p_partkey AS fid", "(1 + p_partkey % 64) / 256D AS px").select(
        "fid", B.scaled_size(75, px).alias("sigma"), B.scaled_size(25, px, 5).alias("blur_window"))


@query("p11_conf_filter", "WITH " + I.BOXES + " SELECT fid, score FROM boxes WHERE score > 0.25")
def _(spark, sf):
    return I.boxes(spark, sf).filter(B.conf_filter(F.col("score"))).select("fid", "score")


@query("p12_prob_mask", "SELECT event_id FROM events WHERE 1 / (1 + exp(-((value - 16) / 8))) * (CASE WHEN event_id % 7 <> 0 THEN 1 ELSE 0 END) > 0.5")
def _(spark, sf):
    logit = (F.col("value") - 16) / 8
    return I.table(spark, sf, "events").filter(B.prob_mask(logit, F.col("event_id") % 7 != 0)).select("event_id")


@query("f11_metres_per_px", """WITH p AS (SELECT p_partkey AS fid, (1 + p_partkey % 64) / 1024.0::DOUBLE AS px FROM part)
SELECT fid, round(CASE WHEN px < 0.01 THEN px * 111320 ELSE px END, 6) AS metres FROM p""")
def _(spark, sf):
    return I.table(spark, sf, "part").selectExpr("p_partkey AS fid", "(1 + p_partkey % 64) / 1024D AS px").select(
        "fid", F.round(B.metres_per_px(F.col("px")), 6).alias("metres"))


# ---- neighbourhoods ----------------------------------------------------------

def _mirror(i: str, n: str) -> str:
    return f"(CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END)"


@query("r1_gaussian", "WITH " + I.TILES + f""", o AS (SELECT unnest(range(-4, 5)) AS o), w AS (SELECT o, exp(-0.5 * o * o) AS w FROM o), wn AS (SELECT o, w / (SELECT sum(w) FROM w) AS w FROM w),
a AS (SELECT t.raster_id, t.row, t.col, t.h, sum(n.v * wn.w) AS v FROM tiles8 t, wn JOIN tiles8 n ON n.raster_id = t.raster_id AND n.row = t.row AND n.col = {_mirror('t.col + wn.o', '8')} GROUP BY ALL),
c AS (SELECT t.raster_id, t.row, t.col, sum(n.v * wn.w) AS v FROM a t, wn JOIN a n ON n.raster_id = t.raster_id AND n.col = t.col AND n.row = {_mirror('t.row + wn.o', 't.h')} GROUP BY ALL)
SELECT raster_id, row, col, round(v, 6) AS smooth FROM c""")
def _(spark, sf):
    tiles = I.small_tiles(spark, sf)
    meta = readers.raster_meta(tiles, 0.0, 8.0, 1.0, I.WKID)
    return S.gaussian(tiles, meta, "v", 1.0).select("raster_id", "row", "col", F.round("smooth", 6).alias("smooth"))


def _box_sql(value: str, k: int, source: str = "pix") -> str:
    lo, hi = k // 2, k - 1 - k // 2
    return f"""bo AS (SELECT unnest(range({-lo}, {hi + 1})) AS o), bv AS (SELECT row, col, CAST({value} AS DOUBLE) AS v FROM {source}),
ba AS (SELECT t.row, t.col, sum(n.v) AS v FROM bv t, bo JOIN bv n ON n.row = t.row AND n.col = {_mirror('t.col + bo.o', '100')} GROUP BY ALL),
bc AS (SELECT t.row, t.col, sum(n.v) / {k * k} AS v FROM dims, ba t, bo JOIN ba n ON n.col = t.col AND n.row = {_mirror('t.row + bo.o', 'dims.height')} GROUP BY ALL)"""


@query("r2_box_mean", WITH + ", " + _box_sql(f"CASE WHEN {EXG} > 18 THEN 1 ELSE 0 END", 6) + " SELECT row, col, round(v, 6) AS density FROM bc")
def _(spark, sf):
    veg = I.pixels(spark, sf).select("raster_id", "row", "col", B.veg_mask(18).cast("int").alias("veg"))
    return S.box_mean(veg, I.meta(spark, sf), 6, density="veg").select("row", "col", F.round("density", 6).alias("density"))


@query("r3_box_max", WITH + f""", a AS (SELECT row, col, max({EXG}) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS v FROM pix)
SELECT row, col, max(v) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS box_max FROM a""")
def _(spark, sf):
    exg = I.pixels(spark, sf).select("raster_id", "row", "col", B.exg().alias("exg"))
    return S.box_max(exg, I.meta(spark, sf), "exg", 6).select("row", "col", "box_max")


LAPLACE = """lap AS (SELECT raster_id, row, col, coalesce(lag(s) OVER rw, s) + coalesce(lead(s) OVER rw, s) + coalesce(lag(s) OVER cw, s) + coalesce(lead(s) OVER cw, s) - 4 * s AS v
  FROM (SELECT *, r + g + b AS s FROM pix) WINDOW rw AS (PARTITION BY row ORDER BY col), cw AS (PARTITION BY col ORDER BY row))"""


@query("r4_laplace", WITH + ", " + LAPLACE + " SELECT row, col, v AS laplace FROM lap")
def _(spark, sf):
    return S.laplace(I.pixels(spark, sf), F.col("r") + F.col("g") + F.col("b")).select("row", "col", "laplace")


@query("r5_sharp_mask", WITH + ", " + LAPLACE + ", " + _box_sql("v", 5, "lap") + ", " + _box_sql("v * v", 5, "lap").replace("bo AS", "bo2 AS").replace("bo JOIN", "bo2 JOIN").replace("bo.o", "bo2.o").replace("bv AS", "bv2 AS").replace("bv ", "bv2 ").replace("bv2 2", "bv2").replace("ba AS", "ba2 AS").replace("ba ", "ba2 ").replace("bc AS", "bc2 AS")
       + " SELECT bc.row, bc.col, bc2.v - bc.v * bc.v > 20 AS sharp FROM bc JOIN bc2 ON bc.row = bc2.row AND bc.col = bc2.col")
def _(spark, sf):
    grey = F.col("r") + F.col("g") + F.col("b")
    return S.sharp_mask(I.pixels(spark, sf), I.meta(spark, sf), grey, 5, 20.0).select("row", "col", "sharp")


@query("r6_core_mask", WITH + """, bad AS (SELECT row AS r0, col AS c0 FROM pix WHERE alpha = 0)
SELECT row, col FROM pix, dims WHERE alpha > 0 AND row BETWEEN 15 AND height - 16 AND col BETWEEN 15 AND width - 16
  AND NOT EXISTS (SELECT 1 FROM bad WHERE (row - r0) * (row - r0) + (col - c0) * (col - c0) <= 225)""")
def _(spark, sf):
    df = I.pixels(spark, sf, alpha=True).select("raster_id", "row", "col", B.valid_mask().alias("valid"))
    return S.core_mask(df, I.meta(spark, sf), 15).filter("core").select("row", "col")


@query("r7_local_maxima", WITH + ", " + _box_sql(EXG, 5) + """, hi AS (SELECT row, col, v, max(v) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m FROM bc),
top AS (SELECT row, col, v, max(m) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS box_max FROM hi)
SELECT row, col, round(v, 6) AS signal FROM top, dims WHERE v = box_max AND row BETWEEN 15 AND height - 16 AND col BETWEEN 15 AND width - 16 AND v > 30""")
def _(spark, sf):
    meta = I.meta(spark, sf)
    df = I.pixels(spark, sf).select("raster_id", "row", "col", B.exg().alias("exg"), B.valid_mask().alias("valid"), F.lit(1.0).alias("density"))
    df = materialize(S.box_mean(df, meta, 5, signal="exg"))
    df = S.core_mask(S.box_max(df, meta, "signal", 6), meta, 15)
    return S.local_maxima(df, 30, 0.0).select("row", "col", F.round("signal", 6).alias("signal"))


@query("r8_label_plateaus", RECURSIVE + I.LABELS + " SELECT CAST(trunc(avg(row)) AS INT) AS row, CAST(trunc(avg(col)) AS INT) AS col FROM labels_ GROUP BY label")
def _(spark, sf):
    return G.label_plateaus(I.crown_mask(spark, sf)).select("row", "col")


@query("r9_refine_centroid", WITH + f""", pk AS (SELECT k AS fid, row AS prow, col AS pcol FROM pix WHERE kind = 'crown' AND row % 20 = 8 AND col % 20 = 9),
w AS (SELECT fid, prow, pcol, row, col, {EXG} * exp(-((row - prow) * (row - prow) + (col - pcol) * (col - pcol)) / 18.0) AS w
  FROM pk JOIN pix ON row BETWEEN prow - 6 AND prow + 6 AND col BETWEEN pcol - 6 AND pcol + 6 WHERE {EXG} > 18)
SELECT fid, CAST(round_even(sum(row * w) / sum(w), 0) AS INT) AS row, CAST(round_even(sum(col * w) / sum(w), 0) AS INT) AS col FROM w GROUP BY fid""")
def _(spark, sf):
    px = I.pixels(spark, sf)
    peaks = px.filter("kind = 'crown' AND row % 20 = 8 AND col % 20 = 9").select(F.col("k").alias("fid"), "raster_id", "row", "col")
    banded = px.select("raster_id", "row", "col", B.exg().alias("exg"), B.veg_mask(18).alias("veg"))
    return S.refine_centroid(peaks, banded, I.meta(spark, sf), 6).select("fid", "row", "col")


def _ball(name: str, source: str, n: int, grow: bool) -> str:
    """Erosion or dilation by an L1 ball inside the raster, in SQL."""
    size = 2 * n * n + 2 * n + 1
    ball = f"(SELECT a, b FROM (SELECT unnest(range({-n}, {n + 1})) AS a), (SELECT unnest(range({-n}, {n + 1})) AS b) WHERE abs(a) + abs(b) <= {n})"
    if grow:
        return f"{name} AS (SELECT DISTINCT s.row + a AS row, s.col + b AS col FROM dims, {source} s, {ball} WHERE s.row + a BETWEEN 0 AND height - 1 AND s.col + b BETWEEN 0 AND width - 1)"
    return f"{name} AS (SELECT s.row, s.col FROM {source} s, {ball} JOIN {source} n ON n.row = s.row + a AND n.col = s.col + b GROUP BY ALL HAVING count(*) = {size})"


@query("r10_erode", "WITH " + I.MASK + ", " + _ball("e1", "mask", 1, False) + " SELECT row, col FROM e1")
def _(spark, sf):
    return S.erode(I.crown_mask(spark, sf), I.meta(spark, sf), 1).select("row", "col")


@query("r10_dilate", "WITH " + I.MASK + ", " + _ball("d1", "mask", 3, True) + " SELECT row, col FROM d1")
def _(spark, sf):
    return S.dilate(I.crown_mask(spark, sf), I.meta(spark, sf), 3).select("row", "col")


@query("r10_opening", "WITH " + I.MASK + ", " + _ball("e1", "mask", 1, False) + ", " + _ball("o1", "e1", 1, True) + " SELECT row, col FROM o1")
def _(spark, sf):
    return S.opening(I.crown_mask(spark, sf), I.meta(spark, sf), 1).select("row", "col")


@query("r10_closing", "WITH " + I.MASK + ", " + _ball("d1", "mask", 3, True) + ", " + _ball("c1", "d1", 3, False) + " SELECT row, col FROM c1")
def _(spark, sf):
    return S.closing(I.crown_mask(spark, sf), I.meta(spark, sf), 3).select("row", "col")


WIDE = I.PIX + ", wmask AS (SELECT row, col FROM pix WHERE kind = 'crown' OR col // 20 = 2 OR row % 25 = 3)"


@query("r11_remove_wide", "WITH " + WIDE + ", " + _ball("e4", "wmask", 4, False) + ", " + _ball("f8", "e4", 8, True)
       + " SELECT row, col FROM wmask m WHERE NOT EXISTS (SELECT 1 FROM f8 WHERE f8.row = m.row AND f8.col = m.col)")
def _(spark, sf):
    mask = I.pixels(spark, sf).filter("kind = 'crown' OR col div 20 = 2 OR row % 25 = 3").select("raster_id", "row", "col")
    return S.remove_wide(mask, I.meta(spark, sf), 9).select("row", "col")


@query("r12_thin")
def _(spark, sf):
    mask = I.pixels(spark, sf).filter("row % 25 < 5 OR col % 33 < 4").select("raster_id", "row", "col")
    return S.thin(mask, I.meta(spark, sf)).select("row", "col")


@query("r13_slope", "WITH " + I.DEM + """, g AS (SELECT row, col, lag(v) OVER rw AS w, v, lead(v) OVER rw AS e FROM dem WINDOW rw AS (PARTITION BY row ORDER BY col)),
h AS (SELECT row, col, e - w AS dx, w + 2 * v + e AS sy FROM g),
s AS (SELECT row, col, (lag(dx) OVER cw + 2 * dx + lead(dx) OVER cw) / 4.0 AS gx, (lead(sy) OVER cw - lag(sy) OVER cw) / 4.0 AS gy FROM h WINDOW cw AS (PARTITION BY col ORDER BY row))
SELECT row, col, round(100.0::DOUBLE * sqrt(gx * gx + gy * gy), 6) AS slope FROM s""")
def _(spark, sf):
    return S.slope(I.dem(spark, sf), 0.5).select("row", "col", F.round("slope", 6).alias("slope"))


@query("p17_slope_map", "WITH " + I.DEM + """, g AS (SELECT row, col, lag(v) OVER rw AS w, v, lead(v) OVER rw AS e FROM dem WINDOW rw AS (PARTITION BY row ORDER BY col)),
h AS (SELECT row, col, e - w AS dx, w + 2 * v + e AS sy FROM g),
s AS (SELECT row, col, (lag(dx) OVER cw + 2 * dx + lead(dx) OVER cw) / 4.0 AS gx, (lead(sy) OVER cw - lag(sy) OVER cw) / 4.0 AS gy FROM h WINDOW cw AS (PARTITION BY col ORDER BY row)),
p AS (SELECT row, col, 100.0::DOUBLE * sqrt(gx * gx + gy * gy) AS slope FROM s)
SELECT row, col, round(slope, 6) AS slope, CASE WHEN slope IS NULL THEN NULL WHEN slope <= 15 THEN 'easy' WHEN slope <= 25 THEN 'moderate' WHEN slope <= 40 THEN 'difficult' ELSE 'restricted' END AS slope_class FROM p""")
def _(spark, sf):
    """The whole job: the raster must have one band, cell sizes come from its metadata."""
    meta = I.meta(spark, sf).withColumn("bands", F.lit(1))
    return slope_map(I.dem(spark, sf), meta).select("row", "col", F.round("slope", 6).alias("slope"), "slope_class")


SEGMENT = WITH + f""", lab AS (SELECT row, col, CASE WHEN alpha > 0 THEN (row // 20) * 5 + col // 20 ELSE -1 END AS label, {EXG} AS exg, alpha > 0 AS valid FROM pix),
m AS (SELECT label, avg(exg) AS m FROM lab WHERE label >= 0 GROUP BY label)"""


@query("r14_segment_mean", SEGMENT + " SELECT row, col, valid AND coalesce(m < 26, false) AS cleared FROM lab LEFT JOIN m USING (label)")
def _(spark, sf):
    df = I.pixels(spark, sf, alpha=True).select("raster_id", "row", "col", B.exg().alias("exg"), B.valid_mask().alias("valid"))
    return S.segment_mean(S.grid_objects(df, I.meta(spark, sf)), 26).select("row", "col", "cleared")


@query("r15_grid_objects", SEGMENT + " SELECT row, col, label::BIGINT AS label FROM lab")
def _(spark, sf):
    df = I.pixels(spark, sf, alpha=True).select("raster_id", "row", "col", B.valid_mask().alias("valid"))
    return S.grid_objects(df, I.meta(spark, sf)).select("row", "col", "label")


METAS = """metas AS (SELECT CAST(p_partkey AS VARCHAR) AS raster_id, 50 + (p_partkey * 37) % 3000 AS width, 50 + (p_partkey * 53) % 2500 AS height,
  greatest(256, CAST(round_even(1024 * (0.5 + p_partkey % 3 * 0.5), 0) AS INT)) AS win, CAST(round_even(200 * (0.5 + p_partkey % 3 * 0.5), 0) AS INT) AS ov FROM part)"""


@query("r16_scan_windows", "WITH " + METAS + """, st AS (SELECT *, greatest(1, win - ov) AS stride FROM metas),
xs AS (SELECT raster_id, unnest(range(0, greatest(width - win, 0) + 1, stride)) AS x0 FROM st),
xa AS (SELECT raster_id, x0 FROM xs UNION SELECT raster_id, width - win FROM st JOIN (SELECT raster_id, max(x0) AS m FROM xs GROUP BY 1) USING (raster_id) WHERE m + win < width),
ys AS (SELECT raster_id, unnest(range(0, greatest(height - win, 0) + 1, stride)) AS y0 FROM st),
ya AS (SELECT raster_id, y0 FROM ys UNION SELECT raster_id, height - win FROM st JOIN (SELECT raster_id, max(y0) AS m FROM ys GROUP BY 1) USING (raster_id) WHERE m + win < height)
SELECT raster_id, x0, y0, least(win, width - x0) AS w, least(win, height - y0) AS h FROM st JOIN xa USING (raster_id) JOIN ya USING (raster_id) WHERE w >= 64 AND h >= 64""")
def _(spark, sf):
    meta = I.table(spark, sf, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS raster_id", "CAST(50 + (p_partkey * 37) % 3000 AS INT) AS width", "CAST(50 + (p_partkey * 53) % 2500 AS INT) AS height", "0.5D + p_partkey % 3 * 0.5D AS scale")
    return R.scan_windows(meta, F.col("scale")).selectExpr("raster_id", "CAST(x0 AS BIGINT) AS x0", "CAST(y0 AS BIGINT) AS y0", "CAST(w AS BIGINT) AS w", "CAST(h AS BIGINT) AS h")


@query("r17_stitch_windows", WITH + """, pr AS (SELECT row, col, 0 AS y0, 0 AS x0, (k % 97) / 128.0::DOUBLE AS prob FROM pix WHERE col < 60
  UNION ALL SELECT row, col, 0, 40, (k % 89) / 128.0::DOUBLE FROM pix WHERE col >= 40 UNION ALL SELECT row, col, 5, 0, (k % 83) / 128.0::DOUBLE FROM pix WHERE row >= 5 AND col < 60)
SELECT row, col, prob FROM pr QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY y0 DESC, x0 DESC) = 1""")
def _(spark, sf):
    px = I.pixels(spark, sf)
    part = lambda where, y0, x0, m: px.filter(where).select("raster_id", "row", "col", F.lit(y0).alias("y0"), F.lit(x0).alias("x0"), (F.col("k") % m / F.lit(128.0)).alias("prob"))
    probs = part("col < 60", 0, 0, 97).unionByName(part("col >= 40", 0, 40, 89)).unionByName(part("row >= 5 AND col < 60", 5, 0, 83))
    return R.stitch_windows(probs).select("row", "col", "prob")


@query("r18_trace_lines")
def _(spark, sf):
    meta = I.meta(spark, sf)
    mask = I.pixels(spark, sf).filter("row % 25 < 5 OR col % 33 < 4").select("raster_id", "row", "col")
    return trace_lines(S.thin(mask, meta), meta, 5.0).select("line_id", F.round("length", 6).alias("length"), F.size("path").alias("vertices"))


# A drawn net of thin lines: what a line is made of, without its order; a wrong order would have another length.
DRAWN = I.PIX + """, thin AS (SELECT row, col FROM pix WHERE row % 25 = 2 OR col % 33 = 2 OR (row % 25 = 12 AND col BETWEEN 5 AND 20) OR (row % 25 IN (14, 18) AND col BETWEEN 6 AND 9) OR (row % 25 BETWEEN 15 AND 17 AND col IN (5, 10))),
nb AS (SELECT a.row, a.col, b.row AS nr, b.col AS nc FROM thin a JOIN thin b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND (a.row <> b.row OR a.col <> b.col)),
line AS (SELECT row, col FROM nb GROUP BY row, col HAVING count(*) = 2),
node AS (SELECT row, col FROM thin EXCEPT SELECT row, col FROM line),
lr(row, col, id) AS (SELECT row, col, row::BIGINT * 4294967296 + col FROM line UNION SELECT n.nr, n.nc, r.id FROM lr r JOIN nb n ON n.row = r.row AND n.col = r.col JOIN line l ON l.row = n.nr AND l.col = n.nc),
lid AS (SELECT row, col, min(id) AS line_id FROM lr GROUP BY row, col),
nr_(row, col, id) AS (SELECT row, col, row::BIGINT * 4294967296 + col FROM node UNION SELECT n.nr, n.nc, r.id FROM nr_ r JOIN nb n ON n.row = r.row AND n.col = r.col JOIN node l ON l.row = n.nr AND l.col = n.nc),
nid AS (SELECT row, col, min(id) AS node FROM nr_ GROUP BY row, col),
step AS (SELECT l.line_id, sqrt((n.nr - l.row) * (n.nr - l.row) + (n.nc - l.col) * (n.nc - l.col)) / 2 AS len, 0 AS more FROM lid l JOIN nb n ON n.row = l.row AND n.col = l.col JOIN lid m ON m.row = n.nr AND m.col = n.nc
  UNION ALL SELECT l.line_id, sqrt((n.nr - l.row) * (n.nr - l.row) + (n.nc - l.col) * (n.nc - l.col)) + sqrt((d.node // 4294967296 - n.nr) * (d.node // 4294967296 - n.nr) + (d.node % 4294967296 - n.nc) * (d.node % 4294967296 - n.nc)),
    1 + (d.node <> n.nr::BIGINT * 4294967296 + n.nc)::INT FROM lid l JOIN nb n ON n.row = l.row AND n.col = l.col JOIN nid d ON d.row = n.nr AND d.col = n.nc),
sums AS (SELECT line_id, sum(len) AS len, sum(more) AS more, count(*) FILTER (more > 0) AS tips FROM step GROUP BY line_id)"""


@query("r18_trace_drawn", RECURSIVE + DRAWN + """ SELECT line_id, round(len * 0.5, 6) AS length, CAST(n + more + (tips = 0)::INT AS INT) AS vertices FROM sums JOIN (SELECT line_id, count(*) AS n FROM lid GROUP BY line_id) USING (line_id)""")
def _(spark, sf):
    mask = I.pixels(spark, sf).filter(
        "row % 25 = 2 OR col % 33 = 2 OR (row % 25 = 12 AND col BETWEEN 5 AND 20) OR (row % 25 IN (14, 18) AND col BETWEEN 6 AND 9) OR (row % 25 BETWEEN 15 AND 17 AND col IN (5, 10))")
    lines = trace_lines(mask.select("raster_id", "row", "col"), I.meta(spark, sf), 0.0)
    return lines.select("line_id", F.round("length", 6).alias("length"), F.size("path").alias("vertices"))


# ---- regions -----------------------------------------------------------------

@query("a11_label_regions", RECURSIVE + I.LABELS + """, adj AS (SELECT a.label, count(*) AS n FROM labels_ a JOIN labels_ b ON (b.row = a.row AND b.col = a.col + 1) OR (b.col = a.col AND b.row = a.row + 1) GROUP BY 1)
SELECT l.label, count(*) AS cells, count(*) * 0.25::DOUBLE AS area, min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1, (4 * count(*) - 2 * any_value(adj.n)) * 0.5::DOUBLE AS perimeter
FROM labels_ l JOIN adj USING (label) GROUP BY l.label""")
def _(spark, sf):
    return G.label_regions(G.label_cells(I.crown_mask(spark, sf)), I.PX).drop("raster_id")


# Half-edges of cells (0 south, 1 east, 2 north, 3 west) with the region on the left, walked from each ring's first corner.
RINGS = I.LABELS + """, lab AS (SELECT row, col, label FROM labels_),
e AS (SELECT l.row, l.col, s, l.label, CASE s WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN 0 ELSE 1 END AS fr, CASE s WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 0 END AS fc,
    CASE s WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 0 END AS br, CASE s WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END AS bc,
    l.row + CASE WHEN s < 2 THEN 1 ELSE 0 END AS vr, l.col + CASE WHEN s IN (1, 2) THEN 1 ELSE 0 END AS vc FROM lab l, (SELECT unnest(range(4)) AS s)
  WHERE NOT EXISTS (SELECT 1 FROM lab n WHERE n.label = l.label AND n.row = l.row + CASE s WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AND n.col = l.col + CASE s WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END)),
f AS (SELECT e.*, a.label IS NOT NULL AS ahead, a.label IS NOT NULL AND d.label IS NOT NULL AS corner FROM e
  LEFT JOIN lab a ON a.label = e.label AND a.row = e.row + fr AND a.col = e.col + fc LEFT JOIN lab d ON d.label = e.label AND d.row = e.row + fr + br AND d.col = e.col + fc + bc),
nx AS (SELECT row, col, s, label, vr, vc, row + CASE WHEN ahead THEN fr ELSE 0 END + CASE WHEN corner THEN br ELSE 0 END AS nr, col + CASE WHEN ahead THEN fc ELSE 0 END + CASE WHEN corner THEN bc ELSE 0 END AS nc,
  (s + CASE WHEN corner THEN 3 WHEN ahead THEN 0 ELSE 1 END) % 4 AS ns FROM f),
walk(r0, c0, s0, row, col, s, vr, vc, nr, nc, ns, k) AS (SELECT row, col, s, row, col, s, vr, vc, nr, nc, ns, 0 FROM nx
  UNION ALL SELECT w.r0, w.c0, w.s0, n.row, n.col, n.s, n.vr, n.vc, n.nr, n.nc, n.ns, w.k + 1 FROM walk w JOIN nx n ON n.row = w.nr AND n.col = w.nc AND n.s = w.ns
    WHERE NOT (w.nr = w.r0 AND w.nc = w.c0 AND w.ns = w.s0)),
ring AS (SELECT *, min(vr::BIGINT * 4294967296 + vc) OVER (PARTITION BY r0, c0, s0) AS part, lag(s) OVER (PARTITION BY r0, c0, s0 ORDER BY k) AS before FROM walk),
own AS (SELECT r.*, b.label, b.vr::BIGINT * 4294967296 + b.vc AS first FROM ring r JOIN nx b ON b.row = r0 AND b.col = c0 AND b.s = s0),
rings AS (SELECT label, part, sum(CASE s WHEN 1 THEN vc WHEN 3 THEN -vc ELSE 0 END) AS n, count(*) AS sides,
  string_agg((500000 + vc * 0.5)::DOUBLE || ' ' || (9500000 - vr * 0.5)::DOUBLE, ',' ORDER BY k) FILTER (k = 0 OR s <> before) AS pts FROM own WHERE first = part GROUP BY label, part)"""


@query("c2_outlines", RECURSIVE + RINGS + """ SELECT label, part, n < 0 AS hole, abs(n)::BIGINT AS cells, abs(n) * 0.25::DOUBLE AS area, sides * 0.5::DOUBLE AS perimeter,
  len(string_split(pts, ',')) AS corners, md5(pts) AS pts_md5 FROM rings""")
def _(spark, sf):
    rings = outlines(G.label_cells(I.crown_mask(spark, sf)), I.meta(spark, sf))
    # Whole and half metres: the same digits in both engines.
    digits = lambda v: F.format_string("%.1f", v)
    text = F.array_join(F.transform("pts", lambda p: F.concat(digits(p["x"]), F.lit(" "), digits(p["y"]))), ",")
    return rings.select("label", "part", "hole", "cells", "area", "perimeter", F.size("pts").alias("corners"), F.md5(text).alias("pts_md5"))


@query("c2_outlines_erase", RECURSIVE + I.LABELS + """, big AS (SELECT label FROM labels_ GROUP BY label HAVING count(*) >= 60), pts AS (SELECT row, col FROM pix)
SELECT row, col FROM pts p WHERE NOT EXISTS (SELECT 1 FROM labels_ l JOIN big USING (label) WHERE l.row = p.row AND l.col = p.col)""")
def _(spark, sf):
    """Outlines of the larger regions as polygons that erase cell centres: only the regions' own cells go."""
    cells = G.label_cells(I.crown_mask(spark, sf))
    big = G.label_regions(cells, I.PX).filter("cells >= 60").select("label")
    layer = outlines(cells.join(big, "label", "left_semi"), I.meta(spark, sf)).withColumn("fid", F.struct("raster_id", "label"))
    return G.erase_regions(I.pixels(spark, sf).select("raster_id", "row", "col"), G.polygons(layer), I.meta(spark, sf)).select("row", "col")


HOLES = I.LABELS + """, bg AS (SELECT p.row, p.col FROM pix p WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.row = p.row AND m.col = p.col)),
outside(row, col) AS (SELECT bg.row, bg.col FROM bg, dims WHERE bg.row = 0 OR bg.col = 0 OR bg.row = height - 1 OR bg.col = width - 1
  UNION SELECT b.row, b.col FROM outside o JOIN bg b ON abs(b.row - o.row) + abs(b.col - o.col) = 1 AND b.row BETWEEN o.row - 1 AND o.row + 1 AND b.col BETWEEN o.col - 1 AND o.col + 1),
inner_ AS (SELECT row, col FROM bg EXCEPT SELECT row, col FROM outside),
hreach(row, col, id) AS (SELECT row, col, row::BIGINT * 4294967296 + col FROM inner_ UNION SELECT b.row, b.col, h.id FROM hreach h JOIN inner_ b
  ON abs(b.row - h.row) + abs(b.col - h.col) = 1 AND b.row BETWEEN h.row - 1 AND h.row + 1 AND b.col BETWEEN h.col - 1 AND h.col + 1),
hole AS (SELECT row, col, min(id) AS hole FROM hreach GROUP BY ALL),
ok AS (SELECT hole, min(l.label) AS label FROM hole h JOIN labels_ l ON abs(l.row - h.row) + abs(l.col - h.col) = 1 AND l.row BETWEEN h.row - 1 AND h.row + 1 AND l.col BETWEEN h.col - 1 AND h.col + 1
  GROUP BY hole HAVING count(DISTINCT l.label) = 1),
size_ AS (SELECT hole, count(*) * 0.25 AS m2 FROM hole GROUP BY hole)"""


@query("a12_fill_holes", RECURSIVE + HOLES + """ SELECT row, col, label FROM labels_
UNION ALL SELECT h.row, h.col, ok.label FROM hole h JOIN ok USING (hole) JOIN size_ USING (hole) WHERE m2 < 50""")
def _(spark, sf):
    return G.fill_holes(G.label_cells(I.crown_mask(spark, sf)), I.meta(spark, sf), I.PX, 50.0).select("row", "col", "label")


@query("p10_min_area", RECURSIVE + I.LABELS + " SELECT label, count(*) * 0.25::DOUBLE AS area FROM labels_ GROUP BY label HAVING count(*) * 0.25 >= 15")
def _(spark, sf):
    regions = G.label_regions(G.label_cells(I.crown_mask(spark, sf)), I.PX)
    return regions.filter(B.min_area(F.col("area"), 15.0)).select("label", "area")


@query("j4_erase_regions", RECURSIVE + I.LABELS + ", " + I.FRAMED.replace("framed AS", "f AS") + """, cen AS (SELECT label, row, col, 500000 + (col + 0.5) * 0.5::DOUBLE AS x, 9500000 - (row + 0.5) * 0.5::DOUBLE AS y FROM labels_),
kept AS (SELECT label FROM cen c WHERE NOT EXISTS (SELECT 1 FROM (SELECT x0, y0 - 100 AS y0, s FROM f) f WHERE """ + I.IN_FRAME + """))
SELECT label, count(*) * 0.25::DOUBLE AS area FROM kept GROUP BY label""")
def _(spark, sf):
    polys = I.framed(spark, sf).selectExpr("fid", "transform(rings, r -> transform(r, p -> struct(p.x AS x, p.y - 100 AS y))) AS rings")
    cells = G.label_cells(I.crown_mask(spark, sf))
    left = G.erase_regions(cells, polys, I.meta(spark, sf))
    return left.groupBy("label").agg((F.count("*") * F.lit(I.PX * I.PX)).alias("area"))


@query("u2_mask_difference", "WITH " + I.MASK + " SELECT row, col FROM mask EXCEPT SELECT row, col FROM pix WHERE k % 3 = 0")
def _(spark, sf):
    return S.mask_minus(I.crown_mask(spark, sf), I.pixels(spark, sf).filter("k % 3 = 0")).select("row", "col")


@query("j3_drop_on_mask", WITH + f""", cleared AS (SELECT row, col FROM pix WHERE {VALID} AND {EXG} < 30 AND NOT ((r + g + b) / 3.0 < 150 AND b >= r)),
trees AS (SELECT k AS fid, row AS py, col AS px FROM pix WHERE (row + col) % 5 = 0)
SELECT fid, py, px FROM trees t WHERE NOT EXISTS (SELECT 1 FROM cleared c WHERE c.row = t.py AND c.col = t.px)""")
def _(spark, sf):
    px = I.pixels(spark, sf)
    trees = px.filter("(row + col) % 5 = 0").select(F.col("k").alias("fid"), "raster_id", F.col("row").alias("py"), F.col("col").alias("px"))
    return drop_on_mask(trees, cleared_cells(px, I.meta(spark, sf), 30, smooth_px=0, opening=0, closing=0)).select("fid", "py", "px")


# ---- whole jobs --------------------------------------------------------------

@query("c1_detect_trees")
def _(spark, sf):
    trees, _summary = detect_trees(I.pixels(spark, sf), I.meta(spark, sf), "palm", sigma=60, exclude_cleared=False)
    return trees.select("px", "py", "geo_x", "geo_y", "crown_r", "sigma")


@query("c2_detect_clearing")
def _(spark, sf):
    regions, _summary = detect_clearing(I.pixels(spark, sf), I.meta(spark, sf), smooth_px=1, opening=2, closing=3)
    return regions


@query("c3_extract_roads")
def _(spark, sf):
    mask = I.pixels(spark, sf).selectExpr("raster_id", "row", "col", "CASE WHEN row % 25 < 5 OR col % 33 < 4 THEN 0.875D ELSE 0.125D END AS prob")
    lines, _summary = extract_roads(None, I.meta(spark, sf), probs=mask)
    return lines.select("line_id", F.round("length", 6).alias("length"), F.size("path").alias("vertices"))


@query("a8_scan_area_ha", WITH + "SELECT 'A' AS raster_id, round(width * height * 0.25::DOUBLE / 10000, 6) AS area_ha FROM dims")
def _(spark, sf):
    from sylva.operators.field import scan_area_ha

    return scan_area_ha(I.meta(spark, sf)).select("raster_id", F.round("area_ha", 6).alias("area_ha"))
