import hashlib
import math

import numpy as np
import pytest

from sylva.llm.centroids import cluster, digest


def brute(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * float(c)) for c in x]) for i, x in rows
            if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x)]
    ranked = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centres = [x for _, x in ranked[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        homes = [near(x)[1] for _, x in kept]
        for j in range(len(centres)):
            own = [x for (_, x), h in zip(kept, homes, strict=True) if h == j]
            if own:
                centres[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted(((-1 if i is None else i), *near(x)[::-1]) for i, x in kept), centres


def awkward_rows(dims):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=dims)]) for i in range(150)]
    rows += [(500 + i, rows[7][1]) for i in range(60)] + [rows[9]] * 20
    rows += [(None, rows[3][1]), (None, None), (900, None), (901, []), (902, [1.0] * (dims + 1)), (903, [None] + [1.0] * (dims - 1)),
             (904, [float("nan")] * dims), (905, [float("-inf")] + [0.0] * (dims - 1)), (906, [0.0] * dims), (907, [-50.0] * dims)]
    return rows


@pytest.mark.parametrize("k,rounds,dims", [(5, 3, 6), (16, 3, 64), (3, 0, 2)])
def test_against_brute_force(spark, k, rounds, dims):
    rows = awkward_rows(dims)
    df = spark.createDataFrame([(i, x, 1, "d") for i, x in rows], "vec_id long, embedding array<float>, cluster int, v string")
    got, centres = cluster(df, k=k, rounds=rounds, dims=dims, scale=64)
    want, want_centres = brute(rows, k, rounds, dims, 64)
    assert centres.tolist() == want_centres
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == want
    # Stored products are still those of the final centroids.
    for r in got.limit(20).collect():
        assert r["dots"] == (centres @ np.array(r["v"])).tolist()


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    got, centres = cluster(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], schema), k=5, dims=2)
    assert len(centres) == 2 and [r["distance"] for r in got.collect()] == [0, 0]
    empty, none = cluster(spark.createDataFrame([], schema), k=5, dims=2)
    assert empty.count() == 0 and none.shape == (0, 2)
    assert digest(np.array([1, -2])) == hashlib.sha256(b"1,-2").hexdigest()


def test_all_rows_equal(spark):
    got, centres = cluster(spark.createDataFrame([(i, [0.5, -0.25]) for i in range(40)], "vec_id long, embedding array<float>"), k=4, dims=2, scale=4)
    assert centres.tolist() == [[2, -1]] * 4
    assert {(r["cluster"], r["distance"]) for r in got.collect()} == {(0, 0)}
