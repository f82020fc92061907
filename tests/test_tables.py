import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.functions import geometry as geo
from sylva.functions import text
from sylva.operators import field, regions
from sylva.operators.numbering import median, number_rows
from sylva.operators.verdicts import apply_verdicts
from sylva.sources import readers
from sylva.streaming.sampling import sample_stream


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def ring(*pts):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])


@pytest.mark.parametrize("values,want", [([3, 1, 2], 2.0), ([1, 2, 3, 4], 2.5), ([7], 7.0), ([], None)])
def test_median(spark, values, want):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert median(df, F.col("v")) == want


def test_median_narrows_down_when_values_are_many(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0, 1, 4000), np.full(2001, 0.25)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert median(df, F.col("v")) == float(np.median(v))


def test_biomass(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", None)], "species string, Volume_m3_ double")
    t = field.biomass_total(df).first()
    assert abs(t["biomass_kg"] - 12330) < 1e-6 and abs(t["carbon_kg"] - 5795.1) < 1e-6 and abs(t["co2e_kg"] - 21250.6317) < 1e-3
    none = field.biomass_total(df.filter("false")).first()
    assert none["biomass_kg"] == 0.0
    assert abs(field.biomass(df).filter("species = 'a'").first()["Carbon_kg"] - 5795.1) < 1e-6
    with pytest.raises(ValueError):
        field.biomass(df.drop("Volume_m3_"))


def test_find_column(spark):
    df = spark.createDataFrame([(1, 2, 3)], "No int, `Jenis Pohon` int, VOLUME_m3 int")
    assert field.find_column(df, "volume") == "VOLUME_m3" and field.find_column(df, "species") == "Jenis Pohon"
    assert field.find_column(df.select("No"), "volume") is None


def test_thinness_and_rings(spark):
    circle = [(10 * np.cos(a), 10 * np.sin(a)) for a in np.linspace(0, 2 * np.pi, 720, endpoint=False)]
    c = ring(*circle)
    assert abs(one(spark, geo.thinness(geo.ring_area(c), geo.ring_perimeter(c))) - 1) < 1e-3
    r = ring((0, 0), (100, 0), (100, 1), (0, 1))
    assert one(spark, geo.thinness(geo.ring_area(r), geo.ring_perimeter(r))) < 0.1
    assert one(spark, geo.thinness(F.lit(1.0), F.lit(0.0))) == 0
    rings = F.array(ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((3, 3), (7, 3), (7, 7), (3, 7)))
    inside = lambda x, y: one(spark, geo.point_in_rings(F.lit(float(x)), F.lit(float(y)), rings))
    assert not inside(5, 5) and inside(1, 1) and not inside(50, 50)


def test_clip_of_a_concave_ring(spark):
    u = ring((0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10))
    box = [F.lit(float(v)) for v in (2, 2, 8, 8)]
    assert abs(one(spark, geo.ring_area(geo.clip_to_box(u, *box))) - (6 * 1 + 1 * 5 * 2)) < 1e-9
    assert one(spark, F.size(geo.clip_to_box(u, *[F.lit(float(v)) for v in (4, 5, 6, 8)]))) in (0, 4)


def test_points_inside_against_brute_force(spark):
    rng = np.random.default_rng(2)
    polys, raw = [], []
    for i in range(25):
        cx, cy, n = rng.uniform(0, 100), rng.uniform(0, 100), 9
        r = rng.uniform(3, 14, n)
        pts = [(cx + r[k] * np.cos(2 * np.pi * k / n), cy + r[k] * np.sin(2 * np.pi * k / n)) for k in range(n)]
        raw.append(pts)
        polys.append((i, [[dict(x=float(x), y=float(y)) for x, y in pts]]))
    p = rng.uniform(0, 100, (400, 2))
    want = set()
    for k, (x, y) in enumerate(p):
        for pts in raw:
            odd = False
            for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    odd = not odd
            if odd:
                want.add(k)
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p)], "fid long, x double, y double")
    pdf = spark.createDataFrame(polys, "fid long, rings array<array<struct<x:double,y:double>>>")
    for side, crowded in ((None, 100_000), (3.0, 100_000), (64.0, 20)):
        assert {r["fid"] for r in regions.points_inside(df, pdf, side=side, crowded=crowded).collect()} == want
    assert regions.erase_points(df, pdf).count() == 400 - len(want)


def test_coordinates_from_text(spark):
    utm = lambda s: one(spark, text.parse_utm(F.lit(s)))
    assert tuple(utm("x 50M 264156 9987378")) == (264156.0, 9987378.0, 32750)
    assert tuple(utm("50 N 264156 0987378")) == (264156.0, 987378.0, 32650)
    assert utm("61M 264156 9987378") is None and utm("nothing") is None
    assert tuple(one(spark, text.parse_grid(F.lit("264156 9987378"), 50, True))) == (264156.0, 9987378.0, 32750)
    ll = lambda s: one(spark, text.parse_latlon(F.lit(s)))
    assert tuple(ll("-2.123456, 113.456789")) == (113.456789, -2.123456, 4326)
    assert tuple(ll("2.123456 S 113.456789 E")) == (113.456789, -2.123456, 4326)
    assert tuple(ll("113.456 2.123 9.999")) == (113.456, 2.123, 4326)
    assert tuple(ll("2.123 S")) == (None, -2.123, None) and tuple(ll("")) == (None, None, None)
    assert one(spark, text.clean_text(F.lit(" a\r\nb "))) == "a  b"


def test_verdict_text_names_and_features(spark):
    assert one(spark, text.parse_verdicts(F.lit(" 1:Y 2:no x:Y 3 1:n 4:yes\n5:Y:N"))) == {1: False, 2: False, 4: True, 5: True}
    assert one(spark, text.safe_name(F.lit("Bukaan/tanah 2"))) == "Bukaantanah2" and one(spark, text.safe_name(F.lit(" /"))) == "Uncategorized"
    assert one(spark, text.feature_of(F.lit("LandClearingStatus"))) == "Land Clearing" and one(spark, text.feature_of(F.lit("Status"))) == "General"


def replies(spark, *rows):
    return spark.createDataFrame(list(rows), "batch int, status string, text string")


def test_verdicts(spark):
    c = spark.range(4).select(F.col("id").alias("fid"))
    kept, n = apply_verdicts(c, replies(spark, (0, "ok", "1:Y 2:N 3:Y 4:N")))
    assert {r["fid"] for r in kept.collect()} == {0, 2} and n.first()["rejected"] == 2
    kept, n = apply_verdicts(c, replies(spark, (0, "error", "boom")))
    assert kept.count() == 4 and n.first()["api_errors"] == 1 and n.first()["last_error"] == "boom"
    kept, n = apply_verdicts(c, replies(spark, (0, "quota", "QUOTA"), (1, "ok", "1:N 2:N")), batch=2)
    assert kept.count() == 4 and n.first()["rejected"] == 0
    crops = spark.createDataFrame([(0, 9, 50), (1, 50, 50), (2, 50, 50), (3, 50, 50)], "fid long, w int, h int")
    ok = replies(spark, (0, "ok", "1:Y 2:N 3:Y"))
    assert {r["fid"] for r in apply_verdicts(c, ok, crops=crops, trees=True)[0].collect()} == {1, 3}
    assert {r["fid"] for r in apply_verdicts(c, ok, crops=crops)[0].collect()} == {0, 1, 3}


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k"))
    for parts in (1, 7):
        got = number_rows(df.repartition(parts), ["k"], "n", start=0)
        assert got.filter("n <> k").count() == 0 and got.count() == 500


def test_readers(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_cruise(spark, str(tmp_path), 32750)
    df = spark.createDataFrame([("1.5", "bad")], "X string, Y string")
    df.write.option("header", True).csv(str(tmp_path / "DATA POHON.csv"))
    row = readers.read_cruise(spark, str(tmp_path), 32750).first()
    assert row["X"] == 1.5 and row["Y"] is None and row["wkid"] == 32750
    spark.createDataFrame([("A", 0, 0, 1.0)], "raster_id string, row int, col int, r double").write.parquet(str(tmp_path / "gray"))
    with pytest.raises(ValueError):
        readers.read_raster(spark, str(tmp_path / "gray"))
    with pytest.raises(ValueError):
        readers.require_photo_points(spark.createDataFrame([(None, 1.0)], "lat double, lon double"))


def test_registry_names_match():
    from sylva.workload import ORACLE, QUERIES
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 100


def test_a_running_sample_stream_answers_later_requests(spark, tmp_path):
    import time

    pixels = spark.createDataFrame([("A", 0, 0, 1.0, 2.0, 3.0), ("A", 0, 1, 4.0, 5.0, 6.0)], "raster_id string, row int, col int, r double, g double, b double")
    meta = spark.createDataFrame([("A", 0.0, 1.0, 1.0, 2, 1)], "raster_id string, xmin double, ymax double, px_size double, width int, height int")
    asked = f"{tmp_path}/asked"

    def ask(*lines):
        spark.createDataFrame([("A", x) for x in lines], "raster_id string, line string").write.mode("append").parquet(asked)

    ask("0.5,0.5")
    stream = spark.readStream.schema("raster_id string, line string").parquet(asked)
    running = sample_stream(stream, pixels, meta, f"{tmp_path}/out", f"{tmp_path}/at", {"processingTime": "200 milliseconds"})
    try:
        running.processAllAvailable()
        ask("1.5,0.5", "oops", "9,9")
        until = time.time() + 60
        while time.time() < until and spark.read.schema("reply string").parquet(f"{tmp_path}/out").count() < 4:
            time.sleep(0.5)
        assert running.isActive
    finally:
        running.stop()
    got = {(r["line"], r["reply"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("0.5,0.5", "1,2,3"), ("1.5,0.5", "4,5,6"), ("oops", "ERROR"), ("9,9", "NODATA")}


def test_medians_of_skewed_values_in_one_pass(spark):
    from sylva.operators.numbering import medians

    rng = np.random.default_rng(31)
    v, w = np.concatenate([np.full(400, 7.25), rng.normal(size=601)]), rng.integers(-5, 5, 1001).astype(float)
    df = spark.createDataFrame([(float(a), float(b) if k % 7 else None) for k, (a, b) in enumerate(zip(v, w, strict=True))], "v double, w double")
    out = medians(df, one=F.col("v"), two=F.col("w"), three=F.col("v") * 0, none=F.lit(None))
    got = out.first()
    want = float(np.median(v)), float(np.median([b for k, b in enumerate(w) if k % 7]))
    assert (got["one"], got["two"], got["three"], got["none"]) == (*want, 0.0, None)
    assert tuple(medians(df.filter("false"), one=F.col("v")).first()) == (None,)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
