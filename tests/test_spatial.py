import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sylva.operators import compare, detections, graph
from sylva.operators.spatial import nearest_within


def points(spark, xy, **extra):
    df = pd.DataFrame({"fid": np.arange(len(xy)), "x": [float(p[0]) for p in xy], "y": [float(p[1]) for p in xy], **extra})
    return spark.createDataFrame(df)


def brute_nearest(a, b, d):
    out = {}
    for i, (x, y) in enumerate(a):
        best = min(((np.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, (u, v) in enumerate(b)), default=None)
        if best and best[0] < d:
            out[i] = best[1]
    return out


@pytest.mark.parametrize("leaf", [64, 3])
def test_nearest_is_exact_in_crowded_cells(spark, leaf):
    """A third of all points in one cell, many at one place."""
    rng = np.random.default_rng(1)
    spread = rng.uniform(0, 60, (150, 2))
    crowd = np.round(rng.uniform(30, 31, (60, 2)), 2)
    a = np.vstack([spread, crowd, np.full((30, 2), 40.5)])
    b = np.vstack([rng.uniform(0, 60, (150, 2)), np.round(rng.uniform(30.5, 32, (60, 2)), 2), np.full((40, 2), 41.25)])
    got = {r["qid"]: r["rid"] for r in nearest_within(points(spark, a), points(spark, b), 3.0, leaf=leaf).collect()}
    assert got == brute_nearest(a, b, 3.0)


def test_two_surveys(spark):
    x, y = 500000.0, 9200000.0
    old = points(spark, [(x, y), (x + 100, y + 100), (x + 50, y + 50)])
    new = points(spark, [(x + 0.5, y + 0.5), (x + 100, y + 99.5), (x + 200, y + 200)])
    s = compare.change_summary(compare.compare_detections(old, new)).first()
    assert (s["matched_count"], s["lost_count"], s["new_count"]) == (2, 1, 1)


def test_later_claimant_is_lost_and_empty_sides(spark):
    old = points(spark, [(0, 0), (0.5, 0), (9, 9)])
    new = points(spark, [(0.4, 0), (1.6, 0)])
    rows = {(r["status"], r["fid"]) for r in compare.compare_detections(old, new).collect()}
    # Point 1 is nearer to new 0, but point 0 claims it first.
    assert rows == {("matched", 0), ("lost", 1), ("lost", 2), ("new", 1)}
    none = old.filter("fid < 0")
    assert {r["status"] for r in compare.compare_detections(old, none).collect()} == {"lost"}
    assert {r["status"] for r in compare.compare_detections(none, new).collect()} == {"new"}


def test_distance_joins_plan_as_equi_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2000).select(F.col("id").alias("fid"), (F.rand(1) * 1000).alias("x"), (F.rand(2) * 1000).alias("y"))
        other = df.select("fid", (F.col("x") + 0.5).alias("x"), "y")
        # The search itself, before its claims are written out.
        plans = [nearest_within(df, other, 3.0, leaf=10_000), nearest_within(df, other, 3.0, leaf=2), compare.compare_detections(df, df)]
        plan = "".join(p._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) for p in plans)
        assert "Join" in plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def brute_nms(pts, radius=None):
    order = sorted(range(len(pts)), key=lambda i: (-pts[i][2], i))
    keep = []
    for i in order:
        x, y, s = pts[i]
        if all((x - pts[k][0]) ** 2 + (y - pts[k][1]) ** 2 > (radius or pts[k][2]) ** 2 for k in keep):
            keep.append(i)
    return set(keep)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.booleans())
def test_nms_equals_the_sequential_pass(spark, seed, fixed):
    rng = np.random.default_rng(seed)
    pts = [(int(x), int(y), int(s)) for x, y, s in zip(rng.integers(0, 60, 120), rng.integers(0, 60, 120), rng.choice([12, 5], 120))]
    pts += [(7, 7, 5)] * 60
    df = points(spark, [p[:2] for p in pts], sigma=[p[2] for p in pts])
    got = {r["fid"] for r in graph.nms(df, 6.0 if fixed else None).collect()}
    assert got == brute_nms(pts, 6.0 if fixed else None)


def brute_components(pts, near):
    parent = list(range(len(pts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pts)):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(pts)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


@pytest.mark.parametrize("factor,floor", [(0.0, 4.0), (0.5, 3.0)])
def test_dedup_keeps_the_best_of_each_cluster(spark, factor, floor):
    rng = np.random.default_rng(3)
    xy = np.vstack([rng.uniform(0, 120, (200, 2)), np.full((80, 2), 50.0), rng.uniform(60, 61, (80, 2))])
    sigma, score = rng.choice([4, 20], len(xy)), np.round(rng.uniform(0, 1, len(xy)), 2)

    def near(i, j):
        return np.hypot(*(xy[i] - xy[j])) < max(min(sigma[i], sigma[j]) * factor, floor)

    want = {max(g, key=lambda k: (score[k], -k)) for g in brute_components(xy, near)}
    got = {r["fid"] for r in graph.dedup(points(spark, xy, sigma=sigma, score=score), factor, floor).collect()}
    assert got == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(61)} == {100}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("most", [8400, 25])
def test_box_nms_equals_the_sequential_pass(spark, most):
    rng = np.random.default_rng(5)
    n = 160
    df = pd.DataFrame({
        "fid": np.arange(n), "window_id": np.where(np.arange(n) < 140, 0, 1), "cx": rng.integers(0, 300, n).astype(float), "cy": rng.integers(0, 300, n).astype(float),
        "w": rng.choice([60.0, 90.0], n), "h": rng.choice([60.0, 80.0], n), "score": np.round(rng.uniform(0, 1, n), 2)})
    keep = []
    for r in df[df.score > 0.25].sort_values(["score", "fid"], ascending=[False, True]).itertuples():
        clear = True
        for k in keep:
            if k.window_id != r.window_id:
                continue
            ox = max(0.0, min(r.cx + r.w / 2, k.cx + k.w / 2) - max(r.cx - r.w / 2, k.cx - k.w / 2))
            oy = max(0.0, min(r.cy + r.h / 2, k.cy + k.h / 2) - max(r.cy - r.h / 2, k.cy - k.h / 2))
            clear &= not ox * oy / (r.w * r.h + k.w * k.h - ox * oy) > 0.45
        if clear:
            keep.append(r)
    got = {r["fid"] for r in detections.box_nms(spark.createDataFrame(df), most=most).collect()}
    assert got == {k.fid for k in keep}


def test_suppression_along_a_chain_takes_few_rounds(spark, monkeypatch):
    """10,000 points that each overlap the next, in order of rank; then radii that all differ."""
    rounds = []
    settle = graph._settle
    monkeypatch.setattr(graph, "_settle", lambda *a: rounds.append(1) or settle(*a))
    chain = [(0.6 * i, 0.0, 1) for i in range(10_000)]
    got = {r["fid"] for r in graph.nms(points(spark, [p[:2] for p in chain], sigma=[p[2] for p in chain]), tile=2048).collect()}
    assert got == set(range(0, 10_000, 2)) and len(rounds) < 20
    rounds.clear()
    rng = np.random.default_rng(8)
    sigma = rng.permutation(np.linspace(2.0, 30.0, 1500))
    pts = [(float(x), float(y), float(s)) for (x, y), s in zip(rng.uniform(0, 400, (1500, 2)), sigma, strict=True)]
    pts += [(200.0 + float(x), 200.0 + float(y), 3.5) for x, y in rng.uniform(0, 2, (120, 2))] + [(200.5, 200.5, 3.0)] * 40
    got = {r["fid"] for r in graph.nms(points(spark, [p[:2] for p in pts], sigma=[p[2] for p in pts]), tile=16).collect()}
    assert got == brute_nms(pts) and len(rounds) < 20


def test_suppression_of_odd_points(spark):
    rows = [(0, 0.0, 0.0, 5.0), (1, 3.0, 0.0, -1.0), (2, 9.0, 0.0, -1.0), (3, 9.0, 0.0, 0.0), (4, 20.0, 0.0, 0.0), (5, 20.0, 0.0, 0.0), (6, None, 0.0, 5.0), (7, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "fid long, x double, y double, sigma double")
    # 2 lies where 3 is, and radius 0 reaches its own place; 6 has no place, 7 no radius.
    assert {r["fid"] for r in graph.nms(df).collect()} == {0, 3, 4, 6, 7}
    assert graph.nms(df.filter("false")).count() == 0


def test_dedup_with_limits_that_all_differ(spark):
    rng = np.random.default_rng(9)
    xy = np.vstack([rng.uniform(0, 300, (500, 2)), rng.uniform(100, 104, (90, 2)), np.full((40, 2), 50.0)])
    sigma, score = rng.permutation(np.linspace(4.0, 40.0, len(xy))), np.round(rng.uniform(0, 1, len(xy)), 2)

    def near(i, j):
        return np.hypot(*(xy[i] - xy[j])) < max(min(sigma[i], sigma[j]) * 0.5, 3.0)

    want = {max(g, key=lambda k: (score[k], -k)) for g in brute_components(xy, near)}
    got = {r["fid"] for r in graph.dedup(points(spark, xy, sigma=sigma, score=score), 0.5, 3.0).collect()}
    assert got == want


def test_weighted_nearest_in_crowded_cells(spark):
    from sylva.operators.spatial import nearest_in_cells

    rng = np.random.default_rng(10)
    xy, w = rng.uniform(0, 1, (300, 2)), rng.uniform(1, 2, 300)
    pts = points(spark, xy, weight=w).withColumnRenamed("fid", "rid")
    q, limit, need = rng.uniform(0, 1, (60, 2)), rng.uniform(0.01, 0.2, 60), rng.uniform(1, 2, 60)
    asked = points(spark, q, limit=limit, need=need).select(F.col("fid").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), "limit", "need", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    want = {}
    for k in range(60):
        best = min(((np.sqrt((q[k, 0] - a) ** 2 + (q[k, 1] - b) ** 2), i) for i, (a, b) in enumerate(xy) if w[i] >= need[k]), default=None)
        if best and best[0] < limit[k]:
            want[k] = best[1]
    for leaf in (1000, 5):
        got = {r["qid"]: r["rid"] for r in nearest_in_cells(asked, pts, 1.0, 1.0, leaf=leaf, weighted=True).collect()}
        assert got == want


def odd(rings, x, y):
    hit = False
    for pts in rings:
        for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
    return hit


def test_points_in_a_ring_of_ten_thousand_vertices(spark):
    """One long ragged ring with a hole among small ones; points on corners and grid lines too."""
    from sylva.operators.edges import edge_index
    from sylva.operators.regions import points_inside

    rng = np.random.default_rng(11)
    n = 10_000
    a = 2 * np.pi * np.arange(n) / n
    r = 60 + rng.uniform(-8, 8, n)
    big = [[(64 + r[k] * np.cos(a[k]), 64 + r[k] * np.sin(a[k])) for k in range(n)], [(60.0, 60.0), (60.0, 70.0), (70.0, 70.0), (70.0, 60.0)]]
    small = [[[(x, y), (x + 4, y), (x + 4, y + 4), (x, y + 4)]] for x, y in rng.integers(0, 140, (30, 2)).astype(float).tolist()]
    star = [[(200.0, 200.0) if k % 2 else (200 + 4 * np.cos(k / 90), 200 + 4 * np.sin(k / 90)) for k in range(560)]]
    polys = [big, *small, star]
    df = spark.createDataFrame([(i, [[dict(x=float(x), y=float(y)) for x, y in ring] for ring in p]) for i, p in enumerate(polys)], "fid long, rings array<array<struct<x:double,y:double>>>")
    xy = rng.uniform(-5, 140, (400, 2)).tolist() + [[float(x), float(y)] for x in range(56, 74, 4) for y in range(56, 74, 4)] + rng.uniform(196, 204, (80, 2)).tolist() + [[200.0, 200.0]]
    want = {k for k, (x, y) in enumerate(xy) if any(odd(p, x, y) for p in polys)}
    for side, crowded in ((None, 100_000), (32.0, 300)):
        assert {v["fid"] for v in points_inside(points(spark, xy), df, side=side, crowded=crowded).collect()} == want
    cells, inside = edge_index(df, 4.0)
    assert "rings" not in cells.columns and cells.agg(F.max(F.size("edges"))).first()[0] <= 64
    # Edges are listed once for each cell they cross, insides as runs.
    assert cells.agg(F.sum(F.size("edges"))).first()[0] < 3 * (n + 700) and inside.count() < 900
    plan = points_inside(points(spark, xy), df)._jdf.queryExecution().toString()
    assert "rings" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_spans_near_segments_equal_the_distance_test(spark):
    from sylva.operators.regions import riparian_conflict, spans_near, union_spans

    rng = np.random.default_rng(12)
    seg = [(*rng.uniform(-20, 60, 4),) for _ in range(25)] + [(5, 5, 5, 30), (5, 30, 5, 5), (8, 8, 8, 8), (0, 3, 40, 3), (40, 50, 0, 50)]
    river = spark.createDataFrame([tuple(map(float, s)) for s in seg], "ax double, ay double, bx double, by double")

    def near(x, y, s, d):
        ax, ay, bx, by = s
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0.0
        return np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) <= d

    for d, q in ((6.0, 1.5), (0.7, 2.0)):
        got = {(r["i"], j) for r in union_spans(spans_near(river, d, q)).collect() for j in range(r["a"], r["b"] + 1)}
        want = {(i, j) for i in range(-30, 60) for j in range(-30, 60) if any(near((i + 0.5) * q, (j + 0.5) * q, s, d) for s in seg)}
        assert got == want
    ring = lambda *p: [dict(x=float(x), y=float(y)) for x, y in p]
    plans = spark.createDataFrame([
        (1, [ring((0, 0), (30, 0), (30, 30), (0, 30)), ring((10, 10), (20, 10), (20, 20), (10, 20))]), (2, [ring((500, 500), (510, 500), (505, 510))])],
        "fid long, rings array<array<struct<x:double,y:double>>>")
    cells = {(i, j) for i in range(20) for j in range(20) if not (10 <= (i + 0.5) * 1.5 < 20 and 10 <= (j + 0.5) * 1.5 < 20)}
    want = len([c for c in cells if any(near((c[0] + 0.5) * 1.5, (c[1] + 0.5) * 1.5, s, 6.0) for s in seg)]) * 1.5 * 1.5
    assert {r["fid"]: r["area"] for r in riparian_conflict(plans, river, 6.0, 1.5).collect()} == {1: want}
    # A band along one straight line, in closed form up to its rim.
    line = spark.createDataFrame([(0.0, 500.0, 1000.0, 500.0)], "ax double, ay double, bx double, by double")
    field = spark.createDataFrame([(1, [ring((0, 0), (1000, 0), (1000, 1000), (0, 1000))])], plans.schema)
    assert riparian_conflict(field, line, 20.0, 1.0).first()["area"] == 1000 * 40


def test_long_rivers_cost_rows_by_scan_lines(spark):
    from sylva.operators.regions import spans_near

    line = spark.createDataFrame([(0.0, 0.0, 20_000.0, 20_000.0)], "ax double, ay double, bx double, by double")
    assert spans_near(line, 50.0, 5.0).count() <= 20_000 / 5 + 2 * 50 / 5 + 2


def test_lengths_within_a_buffer_equal_dense_sampling(spark):
    from sylva.operators.evaluate import buffer_lengths, length_within

    rng = np.random.default_rng(14)
    paths = lambda n, k: [rng.uniform(0, 60, (k, 2)).tolist() for _ in range(n)]
    a = paths(12, 4) + [[[5, 5], [5, 5]], [[10, 50], [50, 50]], [[7, 7]]]
    b = paths(5, 3) + [[[20, 53], [30, 53]], [[20, 53], [30, 53]], [[40, 48], [40, 48]], [[12, 2], [12, 40]]]
    frame = lambda ps: spark.createDataFrame([(i, [dict(x=float(x), y=float(y)) for x, y in p]) for i, p in enumerate(ps)], "fid long, path array<struct<x:double,y:double>>")
    d = 3.5
    segs = [(np.array(p[k]), np.array(p[k + 1])) for p in b for k in range(len(p) - 1) if p[k] != p[k + 1]]
    length = near = 0.0
    for p in a:
        for s, e in zip(p, p[1:], strict=False):
            s, e = np.array(s, float), np.array(e, float)
            size = float(np.hypot(*(e - s)))
            t = (np.arange(20_000) + 0.5) / 20_000
            pts = s + t[:, None] * (e - s)
            hit = np.zeros(len(t), bool)
            for c, f in segs:
                v = f - c
                u = np.clip(((pts - c) @ v) / (v @ v), 0, 1)
                hit |= np.hypot(*(pts - c - u[:, None] * v).T) <= d
            length += size
            near += size * hit.mean()
    got = length_within(frame(a), frame(b), d).first()
    assert abs(got["length"] - length) < 1e-6 and abs(got["near"] - near) < 1e-3 * near
    # In closed form: 40 m along y = 50, within 3.5 of a stretch 3 m beside it.
    alone = length_within(frame([[[10, 50], [50, 50]]]), frame([[[20, 53], [30, 53]]]), d).first()
    assert abs(alone["near"] - (10 + 2 * np.sqrt(d * d - 9))) < 1e-9
    none = buffer_lengths(frame(a).filter("false"), frame(b), d).first()
    assert (none["found_length"], none["found_near"], none["truth_near"], none["f1"]) == (0.0, 0.0, 0.0, 0.0)
