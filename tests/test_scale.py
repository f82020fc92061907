"""What only larger tables show: numbers beyond an int, plans whose sizes Spark can't know."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sylva.operators import detections, mission
from sylva.operators.evaluate import length_within
from sylva.operators.mission import corridor_points
from sylva.operators.regions import spans_near
from sylva.operators.spatial import nearest_within
from sylva.workload import inputs


def test_heights_beyond_the_square_root_of_an_int(spark, tmp_path):
    rows = [46_340, 46_341, 90_000]
    spark.createDataFrame([(row * 100 + 7,) for row in rows], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["row"]: r["v"] for r in inputs.dem(spark, str(tmp_path)).collect()}
    assert got == {row: (row * row + 3 * 7 * 7 + row * 7) / 64 for row in rows}


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def generated(spark, n=50):
    """Points that Spark takes for as small as the rows they are made from."""
    df = spark.range(n).selectExpr("id AS fid", "explode(sequence(0, 20)) AS k")
    return df.selectExpr("fid * 100 + k AS fid", "CAST(fid * 64 + k AS DOUBLE) AS x", "CAST(k AS DOUBLE) AS y")


def test_points_made_by_rows_are_not_broadcast(spark):
    a = generated(spark)
    assert broadcasts(nearest_within(a, a, 4.0, inclusive=True)) == 0
    assert broadcasts(nearest_within(a, a, 4.0, leaf=2)) == 0


def test_segments_are_not_broadcast(spark):
    lines = spark.range(50).selectExpr("id AS fid", "array(struct(id * 64D AS x, 0D AS y), struct(id * 64D + 12 AS x, 0D AS y)) AS path")
    # What is left are the joins of one row with one row.
    assert broadcasts(length_within(lines, lines, 4.0)) <= 1


def test_blocks_side_by_side_equal_blocks_one_by_one():
    """Blocks of several sizes and ring counts in one batch, in the order they came in."""
    rng = np.random.default_rng(4)
    blocks = []
    for k in range(60):
        n = int(rng.integers(1, 9)) if k % 10 else 70
        xy = rng.integers(0, 12, (4, n)).astype(float)
        rings = [rng.integers(0, 12, (int(rng.integers(3, 6)), 2)).astype(float) for _ in range(1 + k % 2)]
        flat = np.concatenate(rings)
        blocks.append((*xy, rng.integers(0, 2, n), rng.uniform(0, 3, n), flat[:, 0], flat[:, 1], np.array([len(r) for r in rings])))
    both = mission._best_walks(60, *[pd.Series(list(c)) for c in zip(*blocks, strict=True)])
    for b, got in zip(blocks, both.itertuples(index=False), strict=True):
        first, last, rings = np.column_stack(b[0:2]), np.column_stack(b[2:4]), np.split(np.column_stack(b[6:8]), np.cumsum(b[8])[:-1])
        walk, back = mission._tours(first, last, len(first)) if len(first) <= 60 else mission._long_tours(first, last)
        tries = []
        for w in range(len(walk)):
            off, longest = int(b[4].sum()), b[5].max()
            for p, q, rp, rq in zip(walk[w], walk[w][1:], back[w], back[w][1:]):
                leave, enter = first[p] if rp else last[p], last[q] if rq else first[q]
                longest = max(longest, float(np.sqrt(((enter - leave) ** 2).sum())))
                x, y = (leave + enter) / 2
                odd = sum((r[k][1] > y) != (r[k - 1][1] > y) and x < (r[k - 1][0] - r[k][0]) * (y - r[k][1]) / (r[k - 1][1] - r[k][1]) + r[k][0] for r in rings for k in range(len(r)))
                off += odd % 2 == 0
            tries.append((off, longest, w))
        off, _, w = min(tries)
        assert (got.off, got.walk.tolist(), got.back.tolist()) == (off, walk[w].tolist(), back[w].tolist())


def test_a_batch_of_blocks_takes_few_steps(monkeypatch):
    """The walks of equally many runs are searched together, not block by block."""
    calls = []
    monkeypatch.setattr(mission, "_tours_of", lambda f, s, real=mission._tours_of: calls.append(len(f)) or real(f, s))
    one = [np.arange(4.0), np.zeros(4), np.arange(4.0), np.ones(4), np.zeros(4), np.ones(4), np.array([0.0, 5, 5]), np.array([0.0, 0, 5]), np.array([3])]
    mission._best_walks(60, *[pd.Series([c] * 500) for c in one])
    assert calls == [500]


def corridor(spark, n, x, y):
    """Straight centre lines in boxes of their own, one line not level."""
    return spark.range(n).selectExpr(
        "id AS fid", f"array(struct(0D AS x, 0D AS y), struct({x} AS x, {y} AS y)) AS path",
        "array(array(struct(-5D AS x, -25D AS y), struct(95D AS x, -25D AS y), struct(95D AS x, 45D AS y), struct(-5D AS x, 45D AS y))) AS rings",
        "50D AS altitude", "2D AS gsd", "1000 AS img_w", "1000 AS img_h", "50D AS front", "50D AS side", "0D AS direction", "8D AS speed", "1D AS minutes")


@pytest.mark.parametrize("x, y", [("100D", "0D"), ("0D", "100D"), ("60D", "80D"), ("-30D", "40D")])
def test_lanes_in_the_box_are_all_there(spark, x, y):
    ux, uy = float(x[:-1]), float(y[:-1])
    size = (ux * ux + uy * uy) ** 0.5
    ux, uy = ux / size, uy / size
    want = set()
    for k in range(int(size / 10) + 1):
        for lane in range(-30, 31):
            px, py = k * 10 * ux - uy * lane * 10, k * 10 * uy + ux * lane * 10
            if -5 < px < 95 and -25 < py < 45:
                want.add((lane, k))
    got = {(r["lane"], r["k"]) for r in mission.corridor_lanes(corridor(spark, 1, x, y)).collect()}
    used = {abs(lane) for lane, _ in want}
    flown = next(m for m in range(100) if m + 1 not in used)
    assert got == {(lane, k) for lane, k in want if abs(lane) <= flown}


def test_corridors_are_not_broadcast(spark):
    points = corridor_points(corridor(spark, 40, "100D", "0D"))
    assert broadcasts(points) == 0


def test_copies_of_a_segment_are_spread_and_count_once(spark):
    one = spark.createDataFrame([(0.0, 0.0, 300.0, 25.0)], "ax double, ay double, bx double, by double").coalesce(1)
    copies = one.crossJoin(spark.range(50)).drop("id").coalesce(1)
    got = spans_near(copies, 20.0, 1.0)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(got.collect()) == sorted(spans_near(one, 20.0, 1.0).collect())


def test_windows_side_by_side_equal_windows_one_by_one():
    """Windows of several sizes, cut anywhere into batches, one far larger than a batch."""
    rng = np.random.default_rng(5)
    sizes = [*rng.integers(1, 9, 60).tolist(), 150, 3, 1, 64, 65]
    first = np.concatenate([np.arange(n) == 0 for n in sizes])
    xy = rng.uniform(0, 40, (2, len(first)))
    wh = rng.uniform(10, 30, (2, len(first)))
    rows = pa.table({"fid": np.arange(len(first)), "cx": xy[0], "cy": xy[1], "w": wh[0], "h": wh[1], "first": first})
    ends = np.cumsum(sizes)
    want = []
    for a, b in zip(ends - sizes, ends, strict=True):
        kept = []
        for k in range(a, b):
            def iou(j, k=k):
                both = np.prod([max(0.0, min(xy[c][j] + wh[c][j] / 2, xy[c][k] + wh[c][k] / 2) - max(xy[c][j] - wh[c][j] / 2, xy[c][k] - wh[c][k] / 2)) for c in (0, 1)])
                return both / (wh[0][j] * wh[1][j] + wh[0][k] * wh[1][k] - both)
            if all(iou(j) <= 0.45 for j in kept):
                kept.append(k)
        want += kept
    for size in (1, 7, 64, 10_000):
        out = detections._suppress(0.45)(iter(rows.to_batches(max_chunksize=size)))
        got = [v for batch in out for v in batch.column("fid").to_pylist()]
        assert sorted(got) == want
