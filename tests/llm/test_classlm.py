import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylva.llm.classlm import exchange, frequent, learn, pack, score, tokens, unpack
from tests.llm.fixtures import awkward, prose


def likelihood(pairs, cls):
    one = np.eye(cls.max() + 1)[cls]
    m = one.T @ pairs @ one
    phi = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return phi(m) - phi(m.sum(0)) - phi(m.sum(1))


def test_exchange_finds_planted_classes():
    r = np.random.default_rng(0)
    kind = np.arange(24) % 3
    pairs = np.zeros((26, 26))
    for a in range(24):
        for b in range(24):
            pairs[a, b] = r.poisson(60 if kind[b] == (kind[a] + 1) % 3 else 2)
    cls = exchange(pairs, 3)
    assert len({(k, c) for k, c in zip(kind, cls[:24], strict=True)}) == 3


def test_exchange_ends_where_no_move_helps():
    r = np.random.default_rng(1)
    pairs = r.poisson(3, (14, 14)).astype(float)
    cls = exchange(pairs, 4, passes=50)
    best = likelihood(pairs, cls)
    for w in range(12):
        for k in range(4):
            other = cls.copy()
            other[w] = k
            assert likelihood(pairs, other) <= best + 1e-6


def test_tokens():
    assert tokens("A b\tÉC d\x1ce\x0b") == ["a", "b", "Éc d\x1ce"] or tokens("A b\tÉC d\x1ce\x0b") == [x.encode() for x in ["a", "b", "Éc d\x1ce"]]
    assert tokens(None) == [] == tokens(" \n")


def test_packed_numbers_come_back():
    for x in (np.zeros(0, np.int32), np.zeros(0, np.uint8), np.array([-1, 5, 70_000], np.int32), np.array([1, 1 << 40, -7])):
        assert unpack(pa.scalar(pack(x)), len(x), x.dtype.type).tolist() == x.tolist()


@pytest.mark.parametrize("near", [10, 100_000])
def test_base_score_and_counts(spark, near):
    rows = awkward(spark).withColumnRenamed("lang", "known")
    model = learn(rows.where("doc_id is null or doc_id <> 9"), classes=4, clustered=6, near_words=near)
    assert len(model.near) <= near
    out = score(rows, model)
    assert {*rows.columns} - {"text"} <= {*out.columns} and len(out.columns) == len({*out.columns})
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    c = Counter(w for r in rows.collect() if r["doc_id"] != 9 for w in low(r["text"]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r["doc_id"]), len(low(r["text"])), sum(c[w] > 0 for w in low(r["text"])), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in low(r["text"])), 6)) for r in rows.collect())
    got = out.collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, prose(i, 40)) for i in range(20)], "doc_id long, text string")
    model = learn(docs, classes=4, clustered=8)
    assert np.allclose((10**model.step).sum(1), 1)
    words = [w.decode() for w, _ in model.near] + ["never-seen"]
    one = score(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    # A text of one word: start to its class, the word, its class to the end.
    cls = [int(model.cls[i]) if i < len(model.cls) - 2 else len(model.step) - 2 for i in range(len(words))]
    start = len(model.step) - 1
    emitted = [r["score"] - model.step[start, k] - model.step[k, start] for r, k in zip(one, cls, strict=True)]
    for k in set(cls):
        assert sum(10**e for e, x in zip(emitted, cls, strict=True) if x == k) == pytest.approx(1, abs=1e-6)


def test_nothing_to_learn_from(spark):
    rows = awkward(spark)
    model = learn(rows.where("false"))
    got = score(rows, model).collect()
    assert len(got) == rows.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert score(rows.where("false"), model).count() == 0


@pytest.mark.parametrize("near", [12, 30, 100_000])
def test_rare_words_have_classes_too(spark, near):
    """Texts of two kinds of words in turn; only four words of each kind are clustered."""
    r = np.random.default_rng(3)
    word = lambda kind: f"{kind}{int(r.integers(4) if r.random() < 0.6 else r.integers(4, 40))}"
    texts = [" ".join(word("ab"[i % 2]) for i in range(20)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = learn(docs, classes=2, clustered=8, near_words=near)
    kind = dict(zip((w for w, _ in model.near), model.cls, strict=False)) | {bytes(x["w"]): x["k"] for x in model.counts.collect()}
    n = Counter(w for t in texts for w in tokens(t))
    assert kind.keys() == n.keys()
    assert {w[:1]: k for w, k in kind.items()}.keys() == {b"a", b"b"} and len({(w[:1], k) for w, k in kind.items()}) == 2
    size, end = Counter(), 3
    m = np.zeros((4, 4))
    for t in texts:
        k = [end, *[kind[w] for w in tokens(t)], end]
        np.add.at(m, (k[:-1], k[1:]), 1)
    for w, k in kind.items():
        size[k] += n[w]
    assert model.size.tolist() == m.sum(0).tolist()
    for x in score(spark.createDataFrame([(t,) for t in [*texts[:5], "a39 b38 b37 zz a36", "zz yy"]], "text string").withColumn("t", F.col("text")), model).collect():
        k = [end, *[kind.get(w, 2) for w in tokens(x["t"])], end]
        want = model.step[k[:-1], k[1:]].sum() + sum(math.log10(n[w] / size[kind[w]]) for w in tokens(x["t"]) if w in kind)
        assert x["score"] == pytest.approx(want)


def test_rounds_send_little(spark, monkeypatch):
    """What stands beside far words is sent once, whatever the number of rounds."""
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{min(int(x), 20_000)}" for x in r.zipf(1.2, 400)) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4).cache()
    docs.count()
    sent, models = [], []
    for rounds in (1, 3):
        monkeypatch.setattr("sylva.llm.classlm.ROUNDS", rounds)
        written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        before = written()
        models.append(learn(docs, classes=16, clustered=64, near_words=2_000))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        sent.append(written() - before)
    docs.unpersist()
    assert all(m.step.shape == (18, 18) and m.size.sum() == sum(len(t.split()) + 1 for t in texts) for m in models)
    assert sent[1] - sent[0] < sent[0] / 2, sent


def test_transitions_count_far_words(spark):
    """Transitions as a plain count has them, with far words side by side, first and last in their texts."""
    r = np.random.default_rng(6)
    texts = [" ".join(f"{'ab'[i % 2]}{min(int(x), 60)}" for i, x in enumerate(r.zipf(1.3, int(r.integers(0, 40))))) for _ in range(200)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    near = learn(docs, classes=3, clustered=6, near_words=100_000)
    model = learn(docs, classes=3, clustered=6, near_words=20)
    words = [w for w, _ in model.near]
    kind = dict(zip(words, model.cls, strict=False))
    n = Counter(w for t in texts for w in tokens(t))
    known = {bytes(x["w"]): x for x in model.counts.collect()}
    assert kind.keys() | known.keys() == n.keys() and all(x["n"] == n[w] for w, x in known.items())
    kind |= {w: x["k"] for w, x in known.items()}
    m = np.zeros((5, 5))
    for t in texts:
        k = [4, *[kind[w] for w in tokens(t)], 4]
        np.add.at(m, (k[:-1], k[1:]), 1)
    assert model.size.tolist() == m.sum(0).tolist() and near.size.sum() == m.sum() and model.ends == len(texts)
    want = (m + 5 * ((m.sum(0) + 0.1) / (m.sum() + 0.5))) / (m.sum(1, keepdims=True) + 5)
    want[:, 3] = 0
    want *= (1 - 10**model.step[:, 3:4]) / want.sum(1, keepdims=True)
    assert np.allclose(10 ** np.delete(model.step, 3, 1), np.delete(want, 3, 1))


def test_frequent_cuts_ties(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), 5 + (i == 7)) for i in range(100)], "w binary, n long")
    for most in (0, 1, 30, 99, 100, 200):
        got = frequent(counts, most)
        assert len(got) == min(most, 100) and got[:1] == [(b"w7", 6)][:most] and got == frequent(counts.repartition(3), most)
