import numpy as np
from pyspark.sql import functions as F

from sylva.operators import regions
from sylva.operators.field import ring_measures, slivers
from sylva.operators.graph import cycle_order
from sylva.operators.outlines import chains, outlines
from sylva.plans.clearing import clearing_layer, detect_clearing

PX = 0.5


def sparse(spark, masks):
    rows = [(k, int(r), int(c)) for k, a in masks.items() for r, c in zip(*np.nonzero(a), strict=True)]
    return spark.createDataFrame(rows, "raster_id string, row int, col int")


def frame(spark, masks, px=PX):
    return spark.createDataFrame([(k, 100.0, 900.0, px, a.shape[1], a.shape[0], 3, 32750) for k, a in masks.items()],
                                 "raster_id string, xmin double, ymax double, px_size double, width int, height int, bands int, wkid int")


def signed(pts):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1], strict=True)) / 2


def spiral(n):
    a = np.zeros((n, n), bool)
    r, c, dr, dc, left, top = 0, 0, 0, 1, n, 0
    r0, r1, c0, c1 = 0, n - 1, 0, n - 1
    while r0 <= r1 and c0 <= c1:
        a[r0, c0:c1 + 1] = True
        a[r0:r1 + 1, c1] = True
        a[r1, c0:c1 + 1] = True
        a[r0 + 2:r1 + 1, c0] = True
        if r0 + 2 <= r1:
            a[r0 + 2, c0:c0 + 2] = True
        r0, r1, c0, c1 = r0 + 2, r1 - 2, c0 + 2, c1 - 2
    return a


def rows_of(df):
    return sorted((r["raster_id"], r["label"], r["part"], r["hole"], r["cells"], r["area"], r["perimeter"], tuple((p["x"], p["y"]) for p in r["pts"])) for r in df.collect())


def test_rings_enclose_their_cells_and_do_not_depend_on_tiles(spark, tile=3):
    rng = np.random.default_rng(1)
    masks = {"a": rng.random((33, 41)) < 0.62, "b": spiral(27), "c": np.ones((4, 5), bool)}
    cells = regions.label_cells(sparse(spark, masks)).cache()
    meta = frame(spark, masks)
    got = rows_of(outlines(cells, meta, tile))
    assert got == rows_of(outlines(cells, meta, 512))
    per = {}
    for raster, label, part, hole, n, area, length, pts in got:
        s = signed(list(pts))
        assert (s < 0) == hole and abs(s) == area == n * PX * PX
        assert pts[0] == (100 + (part % (1 << 32)) * PX, 900 - (part >> 32) * PX)
        assert length == sum(abs(x0 - x1) + abs(y0 - y1) for (x0, y0), (x1, y1) in zip(pts, pts[1:] + pts[:1], strict=True))
        # No point lies on a straight stretch.
        assert all(not (a[0] == b[0] == c[0] or a[1] == b[1] == c[1]) for a, b, c in zip(pts, pts[1:] + pts[:1], pts[2:] + pts[:2], strict=True))
        e = per.setdefault((raster, label), [0, 0, 0.0])
        e[0] += not hole
        e[1] += -n if hole else n
        e[2] += length
    facts = {(r["raster_id"], r["label"]): r for r in regions.label_regions(cells, PX, tile).collect()}
    assert per.keys() == facts.keys()
    for k, (outer, n, length) in per.items():
        assert (outer, n, length) == (1, facts[k]["cells"], facts[k]["perimeter"])
    # Overlay: exactly the regions' own cells lie inside their outlines.
    layer = outlines(cells, meta, tile).withColumn("fid", F.struct("raster_id", "label"))
    for name in masks:
        own = layer.filter(F.col("raster_id") == name)
        every = sparse(spark, {name: np.ones_like(masks[name])})
        left = regions.erase_regions(every, regions.polygons(own), meta).count()
        assert left == int((~masks[name]).sum())


def test_measures_of_regions(spark):
    rng = np.random.default_rng(2)
    a = rng.random((20, 30)) < 0.55
    cells = regions.label_cells(sparse(spark, {"a": a}))
    label = {(r["row"], r["col"]): r["label"] for r in cells.collect()}
    want = {}
    for (r, c), k in label.items():
        w = want.setdefault(k, [0, 0, r, r, c, c])
        w[0] += 1
        w[1] += sum(label.get((r + i, c + j)) != k for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        w[2:] = [min(w[2], r), max(w[3], r), min(w[4], c), max(w[5], c)]
    for tile in (4, 64):
        got = {r["label"]: [r["cells"], r["perimeter"] / PX, r["row0"], r["row1"], r["col0"], r["col1"]] for r in regions.label_regions(cells, PX, tile).collect()}
        assert got == want
    plan = regions.label_regions(cells, PX)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_chains_in_order():
    order, first = chains(np.array([3, 4, -1, 2, 5, 1, 6]))
    groups = [g.tolist() for g in np.split(order, first[1:])]
    assert sorted(groups) == [[0, 3, 2], [1, 4, 5], [6]]
    order, first = chains(np.zeros(0, int))
    assert not len(order) and not len(first)


def test_order_of_cycles(spark):
    rng = np.random.default_rng(3)
    rows, want, at = [], {}, 0
    for n in [1, 2, 3, 4, 5, 8, 12, 16, 31, 64, 100]:
        nodes = (at + rng.permutation(n)).tolist()
        least = nodes.index(min(nodes))
        for k, v in enumerate(nodes):
            rows.append((n % 2, v, nodes[(k + 1) % n]))
            want[n % 2, v] = (min(nodes), (least - k) % n)
        at += n
    got = cycle_order(spark.createDataFrame(rows, "g int, node long, next long"), ["g"])
    assert {(r["g"], r["node"]): (r["ring"], r["ahead"]) for r in got.collect()} == want
    assert cycle_order(spark.createDataFrame([], "g int, node long, next long"), ["g"]).count() == 0


def test_cleared_layer_goes_into_overlay_and_slivers(spark):
    green, bare = (40.0, 180.0, 40.0), (150.0, 110.0, 90.0)
    ground = np.zeros((40, 60), bool)
    ground[4:30, 5:40] = True
    ground[12:20, 15:25] = False
    ground[33:36, 45:48] = True
    masks = {"m": ground, "d": ground}
    rows = [(k, r, c, *(bare if ground[r, c] else green), None) for k in masks for r in range(40) for c in range(60)]
    px = spark.createDataFrame(rows, "raster_id string, row int, col int, r double, g double, b double, alpha double")
    meta = frame(spark, {"m": ground}).unionByName(frame(spark, {"d": ground}, PX / 111_320.0))
    options = dict(smooth_px=1, opening=0, closing=0, hole_m2=0.0, min_area_m2=1.0)
    layer, found, summary = clearing_layer(px, meta, tile=16, **options)
    rings = layer.collect()
    want = {(False, 26 * 35), (True, 8 * 10), (False, 9)}
    assert {(r["hole"], r["cells"]) for r in rings if r["raster_id"] == "m"} == want
    # Cells in degrees: the same areas in metres, places in degrees.
    assert sorted(round(r["area"], 6) for r in rings if r["raster_id"] == "d") == sorted(n * 0.25 for _, n in want)
    assert max(p["x"] for r in rings if r["raster_id"] == "d" for p in r["pts"]) < 100.1
    whole = detect_clearing(px, meta, tile=16, **options)[1].first()
    assert summary.first() == whole and found.count() == 4
    m = layer.filter("raster_id = 'm'")
    inside = regions.points_inside(spark.createDataFrame([(1, 105.1, 895.1), (2, 110.1, 892.9), (3, 122.9, 883.1), (4, 100.1, 899.9)], "fid long, x double, y double"), regions.polygons(m))
    assert {r["fid"] for r in inside.collect()} == {1, 3}
    assert ring_measures(m).agg(F.sum("area")).first()[0] == (26 * 35 + 80 + 9) * 0.25
    assert slivers(m.withColumn("fid", F.col("part"))).count() >= 0
    erased, left, _ = clearing_layer(px, meta, tile=16, exclude=regions.polygons(m.filter("cells = 9")), **options)
    assert {(r["hole"], r["cells"]) for r in erased.filter("raster_id = 'm'").collect()} == {(False, 26 * 35), (True, 80)}
