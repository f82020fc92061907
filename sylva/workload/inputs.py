"""Survey inputs derived from the driver's tables, in Spark and as SQL.

Only whole numbers and binary fractions, so both engines agree exactly. Each
Spark function has a SQL common table expression of the same name below it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.session import checkpoint_folder
from sylva.sources.readers import raster_meta

XMIN, YMAX, PX, WKID = 500000.0, 9500000.0, 0.5, 32750


def raster_a(k: str) -> str:
    """The one raster's id, as a value of the row: a literal would turn the join
    with the metadata into one without a key."""
    return f"CASE WHEN {k} < 0 THEN 'B' ELSE 'A' END AS raster_id"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def pixels(spark: SparkSession, sf: str, alpha: bool = False) -> DataFrame:
    """Crowns, bare ground and water, one pixel per order, 100 columns wide."""
    k = "o_orderkey"
    a = f"CASE WHEN {k} % 613 = 7 THEN 0D ELSE 255D END" if alpha else "CAST(NULL AS DOUBLE)"
    return table(spark, sf, "orders").selectExpr(
        raster_a(k), f"CAST({k} div 100 AS INT) AS row", f"CAST({k} % 100 AS INT) AS col", f"{k} AS k"
    ).withColumn(
        "_kind", F.expr("CASE WHEN col div 20 = 2 THEN 'bare' WHEN col div 20 = 4 THEN 'water' "
                        "WHEN (row % 20 - 10) * (row % 20 - 10) + (col % 20 - 10) * (col % 20 - 10) < 36 THEN 'crown' ELSE 'other' END")
    ).selectExpr(
        "raster_id", "row", "col",
        "CAST(CASE _kind WHEN 'bare' THEN 150 WHEN 'water' THEN 25 ELSE 40 + (k * 7) % 16 END AS DOUBLE) AS r",
        "CAST(CASE _kind WHEN 'bare' THEN 110 WHEN 'water' THEN 30 WHEN 'crown' THEN 180 ELSE 60 END AS DOUBLE) AS g",
        "CAST(CASE _kind WHEN 'bare' THEN 90 WHEN 'water' THEN 35 ELSE 40 + (k * 11) % 16 END AS DOUBLE) AS b",
        a.replace(k, "k") + " AS alpha", "_kind AS kind", "k")


PIX = """pix0 AS (SELECT o_orderkey AS k, CAST(o_orderkey // 100 AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col FROM orders),
pix1 AS (SELECT *, CASE WHEN col // 20 = 2 THEN 'bare' WHEN col // 20 = 4 THEN 'water'
  WHEN (row % 20 - 10) * (row % 20 - 10) + (col % 20 - 10) * (col % 20 - 10) < 36 THEN 'crown' ELSE 'other' END AS kind FROM pix0),
pix AS (SELECT 'A' AS raster_id, row, col, k, kind,
  CAST(CASE kind WHEN 'bare' THEN 150 WHEN 'water' THEN 25 ELSE 40 + (k * 7) % 16 END AS DOUBLE) AS r,
  CAST(CASE kind WHEN 'bare' THEN 110 WHEN 'water' THEN 30 WHEN 'crown' THEN 180 ELSE 60 END AS DOUBLE) AS g,
  CAST(CASE kind WHEN 'bare' THEN 90 WHEN 'water' THEN 35 ELSE 40 + (k * 11) % 16 END AS DOUBLE) AS b,
  CASE WHEN k % 613 = 7 THEN 0.0::DOUBLE ELSE 255.0::DOUBLE END AS alpha FROM pix1),
dims AS (SELECT max(row) + 1 AS height, max(col) + 1 AS width FROM pix)"""


def meta(spark: SparkSession, sf: str) -> DataFrame:
    return raster_meta(pixels(spark, sf), XMIN, YMAX, PX, WKID)


def crown_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Discs with a hole in the middle: small regions, each with an island."""
    ring = "(row % 20 - 10) * (row % 20 - 10) + (col % 20 - 10) * (col % 20 - 10)"
    return pixels(spark, sf).filter(f"kind = 'crown' AND {ring} >= 9").select("raster_id", "row", "col")


MASK = PIX + """, mask AS (SELECT row, col FROM pix WHERE kind = 'crown'
  AND (row % 20 - 10) * (row % 20 - 10) + (col % 20 - 10) * (col % 20 - 10) >= 9)"""

# Labels of mask cells: the first cell of the region, by closure of 4-neighbour steps.
LABELS = MASK + """, reach(row, col, id) AS (SELECT row, col, row::BIGINT * 4294967296 + col FROM mask
  UNION SELECT m.row, m.col, r.id FROM reach r JOIN mask m ON (abs(m.row - r.row) + abs(m.col - r.col)) = 1
    AND m.row BETWEEN r.row - 1 AND r.row + 1 AND m.col BETWEEN r.col - 1 AND r.col + 1),
labels_ AS (SELECT row, col, min(id) AS label FROM reach GROUP BY row, col)"""


def dem(spark: SparkSession, sf: str) -> DataFrame:
    """Heights in longs: the square of a row number above 46,340 is beyond an int."""
    v = "CAST(CAST(row AS BIGINT) * (row + col) + 3 * col * col AS DOUBLE) / 64 AS v"
    return pixels(spark, sf).selectExpr("raster_id", "row", "col", v)


DEM = PIX + ", dem AS (SELECT raster_id, row, col, CAST(row * row + 3 * col * col + row * col AS DOUBLE) / 64 AS v FROM pix)"


def small_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """One raster of 8 columns per embedding."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("raster_id"), F.posexplode("embedding").alias("i", "v")
    ).selectExpr("raster_id", "CAST(i div 8 AS INT) AS row", "CAST(i % 8 AS INT) AS col", "CAST(v AS DOUBLE) AS v")


TILES = """tiles8 AS (SELECT CAST(vec_id AS VARCHAR) AS raster_id, CAST((i - 1) // 8 AS INT) AS row, CAST((i - 1) % 8 AS INT) AS col,
  CAST(ceil(len(embedding) / 8) AS INT) AS h, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def old_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS fid",
        "CAST(500000 + (o_orderkey % 100) * 10 + CASE WHEN o_orderkey % 29 = 0 THEN 8 ELSE 0 END AS DOUBLE) AS x",
        "CAST(9500000 + (o_orderkey div 100) * 10 AS DOUBLE) AS y")


def all_points(spark: SparkSession, sf: str) -> DataFrame:
    """One point for every order."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS fid",
        "500000 + (o_orderkey % 100) * 10 + ((o_orderkey * 37) % 13) * 0.25D - 1.5D + CASE WHEN o_orderkey % 17 = 0 THEN 5 ELSE 0 END AS x",
        "9500000 + (o_orderkey div 100) * 10 + ((o_orderkey * 11) % 7) * 0.25D - 0.75D AS y")


def new_points(spark: SparkSession, sf: str) -> DataFrame:
    """The second survey: every eleventh place is gone."""
    return all_points(spark, sf).filter("fid % 11 <> 0")


POINTS = """oldp AS (SELECT o_orderkey AS fid, CAST(500000 + (o_orderkey % 100) * 10 + CASE WHEN o_orderkey % 29 = 0 THEN 8 ELSE 0 END AS DOUBLE) AS x,
  CAST(9500000 + (o_orderkey // 100) * 10 AS DOUBLE) AS y FROM orders),
allp AS (SELECT o_orderkey AS fid, (500000 + (o_orderkey % 100) * 10 + ((o_orderkey * 37) % 13) * 0.25 - 1.5 + CASE WHEN o_orderkey % 17 = 0 THEN 5 ELSE 0 END)::DOUBLE AS x,
  (9500000 + (o_orderkey // 100) * 10 + ((o_orderkey * 11) % 7) * 0.25 - 0.75)::DOUBLE AS y FROM orders),
newp AS (SELECT * FROM allp WHERE fid % 11 <> 0)"""

# Nearest new point per old point below 3 m, then first claim wins.
MATCHED = POINTS + """, offs AS (SELECT a, b FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)),
newc AS (SELECT n.*, floor(n.x / 3) + a AS i, floor(n.y / 3) + b AS j FROM newp n, offs),
pairs AS (SELECT o.fid, n.fid AS partner, sqrt((n.x - o.x) * (n.x - o.x) + (n.y - o.y) * (n.y - o.y)) AS dist
  FROM (SELECT *, floor(x / 3) AS i, floor(y / 3) AS j FROM oldp) o JOIN newc n USING (i, j)),
nearest AS (SELECT fid, partner FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY dist, partner) AS rn FROM pairs WHERE dist < 3) WHERE rn = 1),
claims AS (SELECT partner, min(fid) AS fid FROM nearest GROUP BY partner),
changes AS (SELECT CASE WHEN c.fid IS NULL THEN 'lost' ELSE 'matched' END AS status, o.fid, o.x, o.y, c.partner FROM oldp o LEFT JOIN claims c ON o.fid = c.fid
  UNION ALL SELECT 'new', n.fid, n.x, n.y, NULL FROM newp n WHERE n.fid NOT IN (SELECT partner FROM claims))"""


def rectangles(spark: SparkSession, sf: str) -> DataFrame:
    """One rectangle per part, as rings ``fid, part, pts``."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS fid", "CAST((p_partkey % 50) * 100 AS DOUBLE) AS x0", "CAST((p_partkey div 50) * 100 AS DOUBLE) AS y0",
        "CAST(1 + p_size AS DOUBLE) AS w", "CAST(1 + p_partkey % 7 AS DOUBLE) AS h").selectExpr(
        "fid", "1 AS part", "array(struct(x0 AS x, y0 AS y), struct(x0 + w AS x, y0 AS y), struct(x0 + w AS x, y0 + h AS y), struct(x0 AS x, y0 + h AS y)) AS pts",
        "x0", "y0", "w", "h")


RECT = """rect AS (SELECT p_partkey AS fid, CAST((p_partkey % 50) * 100 AS DOUBLE) AS x0, CAST((p_partkey // 50) * 100 AS DOUBLE) AS y0,
  CAST(1 + p_size AS DOUBLE) AS w, CAST(1 + p_partkey % 7 AS DOUBLE) AS h FROM part)"""


def framed(spark: SparkSession, sf: str) -> DataFrame:
    """A square with a square hole per part, one side a power of two: ``fid, rings``."""
    sq = "array(struct({x} AS x, {y} AS y), struct({x} + {s} AS x, {y} AS y), struct({x} + {s} AS x, {y} + {s} AS y), struct({x} AS x, {y} + {s} AS y))"
    outer, hole = sq.format(x="x0", y="y0", s="s"), sq.format(x="x0 + s / 4", y="y0 + s / 4", s="s / 2")
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS fid", "CAST((p_partkey % 50) * 20 + 500000.125D AS DOUBLE) AS x0", "CAST((p_partkey div 50) * 40 + 9500000.125D AS DOUBLE) AS y0",
        "CASE WHEN p_partkey % 3 = 0 THEN 8D ELSE 16D END AS s").selectExpr("fid", f"array({outer}, {hole}) AS rings", "x0", "y0", "s")


FRAMED = """framed AS (SELECT p_partkey AS fid, CAST((p_partkey % 50) * 20 + 500000.125 AS DOUBLE) AS x0, CAST((p_partkey // 50) * 40 + 9500000.125 AS DOUBLE) AS y0,
  CASE WHEN p_partkey % 3 = 0 THEN 8.0::DOUBLE ELSE 16.0::DOUBLE END AS s FROM part)"""

# Even-odd membership of a point (x, y) in a framed square f.
IN_FRAME = """(x > f.x0 AND x < f.x0 + f.s AND y > f.y0 AND y < f.y0 + f.s
  AND NOT (x > f.x0 + f.s / 4 AND x < f.x0 + 3 * f.s / 4 AND y > f.y0 + f.s / 4 AND y < f.y0 + 3 * f.s / 4))"""


def cruise(spark: SparkSession, sf: str) -> DataFrame:
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return line.join(part, line.l_partkey == part.p_partkey).selectExpr(
        "p_type AS Species", "CAST(p_size AS DOUBLE) AS Diameter_cm",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 8 END AS Volume_m3_",
        "CAST(500000 + l_suppkey AS DOUBLE) AS X", "CAST(9500000 + l_linenumber * 10 AS DOUBLE) AS Y")


CRUISE = """cruise AS (SELECT p_type AS Species, CAST(p_size AS DOUBLE) AS Diameter_cm, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 8 END AS Volume_m3_,
  CAST(500000 + l_suppkey AS DOUBLE) AS X, CAST(9500000 + l_linenumber * 10 AS DOUBLE) AS Y FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def photos(spark: SparkSession, sf: str) -> DataFrame:
    """Photo rows with watermark texts in several forms."""
    utm = "concat('x ', CASE WHEN k % 5 = 0 THEN '' ELSE concat(CAST(46 + k % 9 AS STRING), CASE WHEN k % 2 = 0 THEN 'M' ELSE 'S' END) END, ' ', CAST(200000 + k * 13 % 700000 AS STRING), ' ', CAST(9000000 + k * 7 AS STRING))"
    dec = "concat('at ', CAST(1 + k % 80 AS STRING), '.', lpad(CAST(k % 1000 AS STRING), 4, '0'), CASE WHEN k % 2 = 0 THEN ' S ' ELSE ', ' END, CAST(95 + k % 80 AS STRING), '.', lpad(CAST(k % 777 AS STRING), 4, '0'), ' E')"
    return table(spark, sf, "part").selectExpr("p_partkey AS k").selectExpr(
        "k AS fid", "concat('IMG_', CAST(k AS STRING), '.jpg') AS file_name", "concat('/photos/', CAST(k AS STRING), '.jpg') AS photo_path",
        "CASE WHEN k % 4 = 0 THEN NULL ELSE -2.5D + (k % 64) / 64D END AS lat", "CASE WHEN k % 7 = 0 THEN NULL ELSE 113D + (k % 32) / 32D END AS lon",
        f"{utm} AS utm_text", f"{dec} AS dec_text", "k")


PHOTOS = """photos AS (SELECT p_partkey AS fid, p_partkey AS k, concat('IMG_', p_partkey, '.jpg') AS file_name, concat('/photos/', p_partkey, '.jpg') AS photo_path,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE -2.5 + (p_partkey % 64) / 64.0::DOUBLE END AS lat, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 113.0 + (p_partkey % 32) / 32.0::DOUBLE END AS lon,
  concat('x ', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(46 + p_partkey % 9, CASE WHEN p_partkey % 2 = 0 THEN 'M' ELSE 'S' END) END, ' ', 200000 + p_partkey * 13 % 700000, ' ', 9000000 + p_partkey * 7) AS utm_text,
  concat('at ', 1 + p_partkey % 80, '.', lpad(CAST(p_partkey % 1000 AS VARCHAR), 4, '0'), CASE WHEN p_partkey % 2 = 0 THEN ' S ' ELSE ', ' END, 95 + p_partkey % 80, '.', lpad(CAST(p_partkey % 777 AS VARCHAR), 4, '0'), ' E') AS dec_text
  FROM part)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("event_id AS k", "value").selectExpr(
        "k AS fid", "k div 16 AS window_id", "CAST((k * 37) % 640 AS DOUBLE) AS cx", "CAST((k * 53) % 640 AS DOUBLE) AS cy",
        "CAST(CASE WHEN k % 3 = 0 THEN 256 ELSE 192 END AS DOUBLE) AS w", "CAST(CASE WHEN k % 5 = 0 THEN 256 ELSE 192 END AS DOUBLE) AS h", "value / 128 AS score")


BOXES = """boxes AS (SELECT event_id AS fid, event_id // 16 AS window_id, CAST((event_id * 37) % 640 AS DOUBLE) AS cx, CAST((event_id * 53) % 640 AS DOUBLE) AS cy,
  CAST(CASE WHEN event_id % 3 = 0 THEN 256 ELSE 192 END AS DOUBLE) AS w, CAST(CASE WHEN event_id % 5 = 0 THEN 256 ELSE 192 END AS DOUBLE) AS h, value / 128 AS score FROM events)"""


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen candidates per small raster, two crown sizes."""
    return table(spark, sf, "events").selectExpr(
        "event_id AS fid", "event_id div 16 AS raster_id", "CAST((event_id * 37) % 101 AS DOUBLE) AS x", "CAST((event_id * 53) % 67 AS DOUBLE) AS y",
        "CASE WHEN event_id % 3 = 0 THEN 20 ELSE 12 END AS sigma", "value AS score")


CLUSTERED = """clustered AS (SELECT event_id AS fid, event_id // 16 AS raster_id, CAST((event_id * 37) % 101 AS DOUBLE) AS x, CAST((event_id * 53) % 67 AS DOUBLE) AS y,
  CASE WHEN event_id % 3 = 0 THEN 20 ELSE 12 END AS sigma, value AS score FROM events)"""


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """One model reply per batch of sixteen events."""
    ev = table(spark, sf, "events").selectExpr(
        "CAST(event_id div 16 AS INT) AS batch", "concat(CAST(event_id % 16 + 1 AS STRING), ':', CASE WHEN event_type = 'view' THEN 'no' WHEN event_type = 'click' THEN 'yes' ELSE 'Y' END) AS token", "event_id AS k")
    text = ev.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda t: t["token"]), " ").alias("_t"))
    return text.selectExpr(
        "batch", "CASE WHEN batch % 7 = 3 THEN 'error' ELSE 'ok' END AS status", "CASE WHEN batch % 7 = 3 THEN concat('HTTP 500 in ', batch) ELSE _t END AS text")


REPLIES = """reply0 AS (SELECT CAST(event_id // 16 AS INT) AS batch, string_agg(concat(event_id % 16 + 1, ':', CASE WHEN event_type = 'view' THEN 'no' WHEN event_type = 'click' THEN 'yes' ELSE 'Y' END), ' ' ORDER BY event_id) AS t FROM events GROUP BY 1),
replies AS (SELECT batch, CASE WHEN batch % 7 = 3 THEN 'error' ELSE 'ok' END AS status, CASE WHEN batch % 7 = 3 THEN concat('HTTP 500 in ', batch) ELSE t END AS text FROM reply0)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """A road graph: one straight line per order."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS fid", "CAST(o_orderkey % 97 AS DOUBLE) AS ax", "CAST(o_orderkey % 89 AS DOUBLE) AS ay",
        "CAST((o_orderkey * 7) % 197 AS DOUBLE) AS bx", "CAST((o_orderkey * 5) % 189 AS DOUBLE) AS by").selectExpr(
        "fid", "array(struct(ax AS x, ay AS y), struct(bx AS x, by AS y)) AS path", "ax", "ay", "bx", "by",
        "sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)) AS length")


LINES = """lines0 AS (SELECT o_orderkey AS fid, CAST(o_orderkey % 97 AS DOUBLE) AS ax, CAST(o_orderkey % 89 AS DOUBLE) AS ay,
  CAST((o_orderkey * 7) % 197 AS DOUBLE) AS bx, CAST((o_orderkey * 5) % 189 AS DOUBLE) AS b_y FROM orders),
lines AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS length FROM lines0)"""


def zigzags(spark: SparkSession, sf: str) -> DataFrame:
    """A three-point line per customer: 12 across, then 16 up."""
    return table(spark, sf, "customer").selectExpr("c_custkey AS fid", "CAST(c_custkey % 40 * 64 AS DOUBLE) AS x0", "CAST(c_custkey div 40 * 64 AS DOUBLE) AS y0").selectExpr(
        "fid", "x0", "y0", "array(struct(x0 AS x, y0 AS y), struct(x0 + 12 AS x, y0 AS y), struct(x0 + 12 AS x, y0 + 16 AS y)) AS path")


ZIGZAGS = "zig AS (SELECT c_custkey AS fid, CAST(c_custkey % 40 * 64 AS DOUBLE) AS x0, CAST(c_custkey // 40 * 64 AS DOUBLE) AS y0 FROM customer)"


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    """Sample points in and around the raster, on pixel borders too."""
    return table(spark, sf, "events").selectExpr(
        "event_id AS fid", raster_a("event_id"), "500000 + (event_id % 220) * 0.25D - 1.25D AS x",
        "9500000 - (event_id % 700) * 0.25D + 1.25D AS y", "CASE WHEN event_id % 3 = 0 THEN 'Water/river' WHEN event_id % 3 = 1 THEN 'Sungai/air' ELSE 'my own' END AS cls")


CLICKS = """clicks AS (SELECT event_id AS fid, (500000 + (event_id % 220) * 0.25 - 1.25)::DOUBLE AS x, (9500000 - (event_id % 700) * 0.25 + 1.25)::DOUBLE AS y,
  CASE WHEN event_id % 3 = 0 THEN 'Water/river' WHEN event_id % 3 = 1 THEN 'Sungai/air' ELSE 'my own' END AS cls FROM events),
clickcell AS (SELECT *, CAST(trunc((x - 500000) / 0.5) AS INT) AS pc, CAST(trunc((9500000 - y) / 0.5) AS INT) AS pr FROM clicks)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).selectExpr("500000 + col * 0.5D AS x", "9500000 - row * 0.5D AS y", "CAST(r AS INT) AS r", "CAST(g AS INT) AS g", "CAST(b AS INT) AS b", "2 * g - r - b AS exg", "kind AS cls")


SAMPLES = PIX + ", samples AS (SELECT (500000 + col * 0.5)::DOUBLE AS x, (9500000 - row * 0.5)::DOUBLE AS y, r::INT AS r, g::INT AS g, b::INT AS b, 2 * g - r - b AS exg, kind AS cls FROM pix)"


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """One survey block per part: a rectangle, for each third an L, with settings."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS fid", "500000D + (p_partkey % 50) * 512 AS x0", "9500000D + (p_partkey div 50) * 512 AS y0",
        "CAST(96 + p_size * 2 AS DOUBLE) AS w", "CAST(64 + p_partkey % 9 * 8 AS DOUBLE) AS h", "p_partkey % 3 = 0 AS ell",
        "50D AS altitude", "2D AS gsd", "1000 AS img_w", "1000 AS img_h", "50D AS front", "CAST(20 + p_partkey % 4 * 10 AS DOUBLE) AS side",
        "CAST(p_partkey % 4 * 30 AS DOUBLE) AS direction", "CASE WHEN p_partkey % 11 = 0 THEN 0D ELSE 8D END AS speed", "CAST(1 + p_partkey % 2 AS DOUBLE) AS minutes"
    ).selectExpr(
        "*", "CASE WHEN ell THEN array(array(struct(x0 AS x, y0 AS y), struct(x0 + w AS x, y0 AS y), struct(x0 + w AS x, y0 + h / 2 AS y), struct(x0 + w / 2 AS x, y0 + h / 2 AS y), struct(x0 + w / 2 AS x, y0 + h AS y), struct(x0 AS x, y0 + h AS y))) "
             "ELSE array(array(struct(x0 AS x, y0 AS y), struct(x0 + w AS x, y0 AS y), struct(x0 + w AS x, y0 + h AS y), struct(x0 AS x, y0 + h AS y))) END AS rings")


BLOCKS = """blocks AS (SELECT p_partkey AS fid, 500000.0::DOUBLE + (p_partkey % 50) * 512 AS x0, 9500000.0::DOUBLE + (p_partkey // 50) * 512 AS y0,
  CAST(96 + p_size * 2 AS DOUBLE) AS w, CAST(64 + p_partkey % 9 * 8 AS DOUBLE) AS h, p_partkey % 3 = 0 AS ell, 50.0::DOUBLE AS altitude, 2.0::DOUBLE AS gsd, 1000 AS img_w, 1000 AS img_h,
  50.0::DOUBLE AS front, CAST(20 + p_partkey % 4 * 10 AS DOUBLE) AS side, CAST(p_partkey % 4 * 30 AS DOUBLE) AS direction,
  CASE WHEN p_partkey % 11 = 0 THEN 0.0::DOUBLE ELSE 8.0::DOUBLE END AS speed, CAST(1 + p_partkey % 2 AS DOUBLE) AS minutes FROM part),
verts AS (SELECT fid, CASE WHEN ell THEN [{'x': x0, 'y': y0}, {'x': x0 + w, 'y': y0}, {'x': x0 + w, 'y': y0 + h / 2}, {'x': x0 + w / 2, 'y': y0 + h / 2}, {'x': x0 + w / 2, 'y': y0 + h}, {'x': x0, 'y': y0 + h}]
  ELSE [{'x': x0, 'y': y0}, {'x': x0 + w, 'y': y0}, {'x': x0 + w, 'y': y0 + h}, {'x': x0, 'y': y0 + h}] END AS pts FROM blocks)"""


def waypoints(spark: SparkSession, sf: str) -> DataFrame:
    """Four parts of ten waypoints per plan."""
    return table(spark, sf, "part").selectExpr("p_partkey AS k").selectExpr(
        "k div 40 AS fid", "CAST(k div 10 % 4 + 1 AS INT) AS part", "CAST(k % 10 AS INT) AS sequence", "500000D + (k % 10) * 3 AS x", "9500000D + (k % 10) * 4 + (k div 10) AS y",
        "-4.5D + (k % 128) / 128D AS lat", "113D + (k % 128) / 128D AS lon", "50D + (k % 4) * 12.5D AS altitude", "CAST(k div 40 % 3 * 4 AS DOUBLE) AS speed", "k")


WAYPOINTS = """wp AS (SELECT p_partkey // 40 AS fid, CAST(p_partkey // 10 % 4 + 1 AS INT) AS part, CAST(p_partkey % 10 AS INT) AS sequence, 500000.0::DOUBLE + (p_partkey % 10) * 3 AS x,
  9500000.0::DOUBLE + (p_partkey % 10) * 4 + (p_partkey // 10) AS y, -4.5::DOUBLE + (p_partkey % 128) / 128.0::DOUBLE AS lat, 113.0::DOUBLE + (p_partkey % 128) / 128.0::DOUBLE AS lon,
  50.0::DOUBLE + (p_partkey % 4) * 12.5::DOUBLE AS altitude, CAST(p_partkey // 40 % 3 * 4 AS DOUBLE) AS speed, p_partkey AS k FROM part)"""


def status_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id", "ts", "CASE event_id % 4 WHEN 0 THEN 'LandClearingStatus' WHEN 1 THEN 'Status' WHEN 2 THEN 'FlightMissionStatus' ELSE 'GpxStatus' END AS property",
        "CASE WHEN event_id % 10 = 0 THEN '' ELSE props END AS message")


STATUS = """status AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'LandClearingStatus' WHEN 1 THEN 'Status' WHEN 2 THEN 'FlightMissionStatus' ELSE 'GpxStatus' END AS property,
  CASE WHEN event_id % 10 = 0 THEN '' ELSE props END AS message FROM events),
entries AS (SELECT event_id, ts, CASE property WHEN 'LandClearingStatus' THEN 'Land Clearing' WHEN 'Status' THEN 'General' WHEN 'FlightMissionStatus' THEN 'Flight Mission' ELSE 'Gpx' END AS feature, message FROM status WHERE message <> '')"""
