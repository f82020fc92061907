import numpy as np

from sylva.llm.hnsw import build_graph, nearest, search_graph


def test_graph_recall():
    r = np.random.default_rng(1)
    v = r.normal(size=(1500, 24))
    top, layers = build_graph(v)
    assert layers[0].shape == (1500, 24) and layers[0].dtype == np.int32
    hits = 0
    for q in r.normal(size=(40, 24)):
        best = set(np.argsort(((v - q) ** 2).sum(1))[:10].tolist())
        hits += len(best & {i for _, i in search_graph(v, top, layers, q)[:10]})
    assert hits >= 380


def brute(rows, every, k):
    fit = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x) and any(x):
            fit.setdefault((i, tuple(x)))
    out = {}
    for i, x in fit:
        if i % every == 0:
            near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, y in fit if j != i and len(y) == len(x))
            out[i] = near[:k]
    return out


def test_awkward_vectors_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=6).astype(np.float32)]) for i in range(260)]
    rows += [(1000 + i, rows[10][1]) for i in range(40)] + [(1100, rows[10][1])]
    rows += [(2000, None), (2100, [0.0] * 6), (2200, [float("nan")] * 6), (2300, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (2400, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (2500, [])]
    # Other lengths meet only each other.
    rows += [(3000 + i, [float(x) for x in r.normal(size=2 + i % 3)]) for i in range(30)]
    rows += [rows[20]] * 3
    df = spark.createDataFrame([(i, x, "e") for i, x in rows], "vec_id long, embedding array<float>, point string")
    got = {}
    for q in nearest(df, every=20, k=10, shard_points=60).orderBy("query_id", "rank").collect():
        got.setdefault(q["query_id"], []).append((q["score"], q["vec_id"]))
    want = brute(rows, 20, 10)
    assert got.keys() == want.keys()
    right = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert right >= 0.97 * sum(map(len, want.values()))
    assert got[1000][:9] == [(0.0, 10)] + [(0.0, 1000 + i) for i in range(1, 9)]
    assert nearest(df.where("false")).count() == 0
    few = nearest(df.where("vec_id in (0, 1, 2)"), every=100).collect()
    assert sorted((r["rank"], r["query_id"]) for r in few) == [(1, 0), (2, 0)]
