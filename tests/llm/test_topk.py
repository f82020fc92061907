import math

import numpy as np

from sylva.llm.topk import best, choose_pivots, distances, highest, upper_bounds


def brute(rows, every, k, scale):
    kept = sorted({(i, tuple(math.floor(scale * float(c)) for c in x)) for i, x in rows
                   if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)})
    out = []
    turns = {}
    for i, x in kept:
        if i % every == 0:
            turns[i] = turns.get(i, 0) + 1
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in kept if j != i and len(y) == len(x))
            out += [(i, turns[i], r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_awkward_vectors_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=5) * r.choice([0.1, 1, 30])]) for i in range(300)]
    rows += [(1000 + i, rows[10][1]) for i in range(60)] + [rows[20]] * 3 + [(40, rows[41][1])]
    rows += [(2000 + 20 * i, x) for i, x in enumerate([None, [0.0] * 5, [float("nan")] * 5, [None] + [1.0] * 4, [float("inf")] + [1.0] * 4, [], [], [1.0], [2.0], [-3.0]])]
    rows += [(None, [9.0] * 5), (-20, rows[3][1])]
    df = spark.createDataFrame([(i, x, "e", 1) for i, x in rows], "vec_id long, embedding array<float>, score string, shard int")
    for shard_points, pivots in ((50, 4), (1000, 32)):
        got = highest(df, every=20, k=10, scale=16, shard_points=shard_points, pivots=pivots)
        assert sorted((q["query_id"], q["turn"], q["rank"], q["vec_id"], q["score"]) for q in got.collect()) == brute(rows, 20, 10, 16)
    assert highest(df.where("false")).count() == 0
    assert highest(df.where("vec_id = 20")).count() == 0
    assert [(q["query_id"], q["vec_id"]) for q in highest(df.where("vec_id in (0, 1)"), every=100).collect()] == [(0, 1)]


def test_bounds_hold_and_stop_early():
    r = np.random.default_rng(5)
    centres = r.integers(-500, 500, (20, 16))
    v = (centres[r.integers(0, 20, 4000)] + r.integers(-20, 20, (4000, 16))).astype(np.int64)
    x = v.astype(float)
    p = choose_pivots(x, 32)
    assert p.shape == (32, 16) and not p[0].any()
    bounds = upper_bounds(x[:50], (x * x).sum(1), p, distances(x, p))
    exact = v[:50] @ v.T
    assert (bounds >= exact).all()
    ids = np.arange(4000)
    seen = 0
    for i in range(50):
        scores, found, n = best(v[i], bounds[i], v, ids, i)
        want = sorted((-exact[i, j], j) for j in range(4000) if j != i)[:10]
        assert list(zip((-scores).tolist(), found.tolist(), strict=True)) == want
        seen += n
    assert seen < 0.5 * 50 * 4000


def test_ties_of_copies():
    v = np.ones((500, 3), np.int64)
    ids = np.arange(500)[::-1].copy()
    p = choose_pivots(v.astype(float))
    assert len(p) == 2
    bounds = upper_bounds(v[:1].astype(float), np.full(500, 3.0), p, distances(v.astype(float), p))
    scores, found, _ = best(v[0], bounds[0], v, ids, 3)
    assert found.tolist() == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10] and set(scores.tolist()) == {3}
