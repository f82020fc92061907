import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.operators import mission
from sylva.plans.missions import corridor_plan, coverage_plan, to_wgs84
from sylva.sources import writers

SQUARE = [(0, 0), (100, 0), (100, 100), (0, 100)]
NOTCHED = [(0, 0), (240, 0), (240, 60), (150, 60), (130, 25), (110, 60), (60, 60), (0, 40)]


def blocks(spark, *shapes, **settings):
    base = dict(altitude=50.0, gsd=2.0, img_w=1000, img_h=1000, front=50.0, side=50.0, direction=0.0, speed=8.0, minutes=20.0)
    base.update(settings)
    path = base.pop("path", None)
    rows = [(i, [[dict(x=float(x), y=float(y)) for x, y in ring] for ring in rings]) for i, rings in enumerate(shapes)]
    df = spark.createDataFrame(rows, "fid long, rings array<array<struct<x:double,y:double>>>").withColumns({k: F.lit(v) for k, v in base.items()})
    if path:
        df = df.withColumn("path", F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in path]))
    return df


def test_square(spark):
    w, plans = coverage_plan(blocks(spark, [SQUARE]))
    rows = w.collect()
    assert 90 <= len(rows) <= 121 and {r["altitude"] for r in rows} == {50.0}
    assert sum(r["sequence"] == 0 for r in rows) == plans.first()["parts"] == 1
    assert plans.first()["waypoints"] == len(rows)


def test_triangle_follows_the_slope(spark):
    w, _ = coverage_plan(blocks(spark, [[(0, 0), (100, 0), (100, 100)]]))
    tops = w.groupBy(F.round("x", 6).alias("x")).agg(F.max("y").alias("y")).collect()
    assert all(abs(t["y"] - t["x"]) < 3 for t in tops if t["x"] > 5)


def test_small_block_still_has_a_line_and_a_reason(spark):
    b = blocks(spark, [[(0, 0), (20, 0), (20, 20), (0, 20)]], gsd=5.0, img_w=4000, img_h=3000, front=80.0, side=70.0)
    assert coverage_plan(b)[0].count() >= 1
    reason = mission.coverage_failure(b).first()
    assert reason["too_small"] and round(reason["line_spacing"]) == 60 and reason["width"] == 20


def test_concave_block_stays_inside(spark):
    for direction in (0.0, 90.0):
        _, plans = coverage_plan(blocks(spark, [NOTCHED], direction=direction))
        assert plans.first()["off_polygon_legs"] == 0
    s = mission.suggest_direction(blocks(spark, [NOTCHED])).first()
    assert 80 <= s["best_degrees"] <= 100 and s["angles_tested"] == 180 and s["lines_at_best"] < s["lines_at_current"]


def test_short_battery_shares_seams(spark):
    w, plans = coverage_plan(blocks(spark, [SQUARE], minutes=1.0))
    assert plans.first()["parts"] > 1
    rows = w.collect()
    for p in range(1, plans.first()["parts"]):
        last = max((r for r in rows if r["part"] == p), key=lambda r: r["sequence"])
        first = next(r for r in rows if r["part"] == p + 1 and r["sequence"] == 0)
        assert (last["x"], last["y"]) == (first["x"], first["y"])


def test_cross_hatch(spark):
    one, single = coverage_plan(blocks(spark, [SQUARE]))
    two, double = coverage_plan(blocks(spark, [SQUARE]), crosshatch=True)
    assert double.first()["parts"] == 2 * single.first()["parts"] and two.count() > 1.8 * one.count()
    assert {r["part"] for r in two.select("part").distinct().collect()} == {1, 2}


def test_corridor_round_a_corner(spark):
    ring = [(-20, -20), (20, -20), (20, 80), (120, 80), (120, 120), (-20, 120)]
    b = blocks(spark, [ring], path=[(0, 0), (0, 100), (100, 100)])
    w, plans = corridor_plan(b)
    rows = w.collect()
    assert plans.first()["off_polygon_legs"] == 0
    assert any(r["y"] < 20 for r in rows) and any(r["x"] > 80 for r in rows)


@pytest.mark.parametrize("n", [12, 70])
def test_each_step_of_a_tour_goes_to_the_nearest_open_end(n):
    rng = np.random.default_rng(n)
    ends = rng.integers(0, 40, (n, 2, 2)).astype(float)  # run, first or last, x and y
    starts = n if n <= mission.MULTI_START_RUNS else 1
    walk, back = mission._tours(ends[:, 0], ends[:, 1], starts)
    assert (np.sort(walk, axis=1) == np.arange(n)).all()
    assert (walk[:, 0] == np.arange(2 * starts) // 2).all() and (back[:, 0] == np.arange(2 * starts) % 2).all()
    for tour, turned in zip(walk, back.astype(int)):
        leave = ends[tour, 1 - turned]
        for k in range(1, n):
            gaps = np.square(ends[tour[k:]] - leave[k - 1]).sum(axis=2)
            ranked = sorted((gaps[i, side], run, side) for i, run in enumerate(tour[k:]) for side in (0, 1))
            assert ranked[0][1:] == (tour[k], turned[k])


def test_parts_of_plans_with_pauses_long_legs_and_no_minutes(spark):
    rng = np.random.default_rng(0)
    rows = []
    for fid, (speed, minutes) in enumerate([(8.0, 0.25), (8.0, 0.25), (0.0, 0.25), (8.0, 0.0), (8.0, 0.01)]):
        x = np.cumsum(rng.uniform(1, 40, 90))
        x[40:] += 500 if fid == 1 else 0  # one leg longer than a whole battery
        x[10:13] = x[10]  # three waypoints at one place
        rows += [(fid, i, float(v), 0.0, speed, minutes) for i, v in enumerate(np.maximum.accumulate(x))]
    schema = "fid long, seq long, x double, y double, speed double, minutes double"
    got = {(r["fid"], r["part"], r["sequence"], r["seq"]) for r in mission.split_by_budget(spark.createDataFrame(rows, schema)).collect()}
    want = set()
    for fid in range(5):
        own = [r for r in rows if r[0] == fid]
        clock = np.concatenate(([0.0], np.cumsum([(b[2] - a[2]) / b[4] if b[4] else 0.0 for a, b in zip(own, own[1:])])))
        opened = [0]
        while len(late := np.flatnonzero(clock > clock[opened[-1]] + own[0][5] * 60)):
            opened.append(int(late[0]))
        for part, (a, b) in enumerate(zip(opened, [*opened[1:], len(own) - 1]), 1):
            want |= {(fid, part, k - a, k) for k in range(a, b + 1)}
    assert got == want
    with pytest.raises(Exception, match="negative"):
        mission.split_by_budget(spark.createDataFrame([(*r[:5], -1.0) for r in rows], schema)).collect()


def test_mission_files(spark, tmp_path):
    w = to_wgs84(coverage_plan(blocks(spark, [[(500000 + x, 9900000 + y) for x, y in SQUARE]], minutes=1.0))[0], 32750)
    docs = writers.wpml_text(w, "Matrice 30", 1).collect()
    for d in docs:
        root = ET.fromstring(d["xml"].encode())
        tags = [e.tag.split("}")[1] for e in root.iter()]
        n = w.filter(F.col("part") == d["part"]).count()
        assert tags.count("Placemark") == tags.count("actionGroup") == n
        assert "<wpml:droneEnumValue>67<" in d["xml"] and "<wpml:payloadEnumValue>52<" in d["xml"]
    assert "droneSubEnumValue" not in writers.wpml_text(w, "Matrice 300 RTK + Zenmuse H20", 1).first()["xml"]
    with pytest.raises(ValueError):
        writers.require_waypoints(w.filter("part > 99"))
    writers.write_mission_csv(w, str(tmp_path / "csv"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "csv" / "fid=0" / "part=1")).collect()]
    assert lines[0] == writers.CSV_HEADER and len(lines) == 1 + w.filter("part = 1").count()


def test_utm_round_trip(spark):
    from sylva.functions.projection import utm_to_wgs84, wgs84_to_utm
    df = spark.createDataFrame([(500000.0, 9500000.0), (264156.0, 9987378.0), (700000.0, 100.0)], "x double, y double")
    for wkid in (32750, 32650):
        g = df.withColumn("g", utm_to_wgs84(F.col("x"), F.col("y"), F.lit(wkid)))
        u = g.withColumn("u", wgs84_to_utm(F.col("g.lat"), F.col("g.lon"), F.lit(wkid)))
        for r in u.collect():
            assert abs(r["u"]["x"] - r["x"]) < 1e-3 and abs(r["u"]["y"] - r["y"]) < 1e-3
    # Zone 50 has its middle at 117 degrees east.
    one = spark.range(1).select(utm_to_wgs84(F.lit(500000.0), F.lit(10000000.0), F.lit(32750)).alias("g")).first()["g"]
    assert abs(one["lat"]) < 1e-9 and abs(one["lon"] - 117) < 1e-9
    with pytest.raises(Exception, match="only UTM"):
        df.select(utm_to_wgs84(F.col("x"), F.col("y"), F.lit(3857))).collect()


@pytest.mark.parametrize("n", [2, 12, 70, 5000])
def test_tours_by_cells_equal_the_full_search(n):
    rng = np.random.default_rng(n)
    for shape in ("spread", "lanes", "line", "heap"):
        if shape == "spread":
            first, last = rng.uniform(0, 900, (n, 2)), rng.uniform(0, 900, (n, 2))
        elif shape == "lanes":
            x = np.repeat(np.arange(n), 1) * 7.0
            first, last = np.column_stack([x, np.zeros(n)]), np.column_stack([x, 50.0 + np.arange(n) % 5])
        elif shape == "line":
            first = np.column_stack([rng.permutation(n) * 1.0, np.zeros(n)])
            last = first + [0.5, 0.0]
        else:
            first = np.floor(rng.uniform(0, 4, (n, 2)))
            last = np.where(rng.random((n, 1)) < 0.01, 5000.0, first)
        a, b = mission._tours(first, last, 1), mission._long_tours(first, last)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
