from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm.common import shingles, word_hashes
from sylva.llm.neardup import _settled, _sign, _within, classes, drop_near_duplicates, jaccard, signature
from tests.llm.fixtures import awkward, prose


def brute(rows, similarity=0.8):
    """doc_id -> least doc_id of its class, by comparing all pairs."""
    sets = [np.unique(shingles(t)) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, t) in enumerate(rows):
        for j in range(i):
            same = (t or "") == (rows[j][1] or "") if not len(sets[i]) or not len(sets[j]) else jaccard(sets[i], sets[j]) >= similarity
            if same:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def edited(seed, words, changes):
    w = prose(seed, words).split()
    r = np.random.default_rng(seed * 100 + changes)
    for at in r.choice(words, changes, replace=False):
        w[at] = f"new{r.integers(10**6)}"
    return " ".join(w)


def test_word_hashes_are_of_words():
    a = word_hashes("The cat-hat, über  the CAT")
    assert len(a) == 6 - 0 and a[0] == a[4] and a[1] == a[5] and len(set(a.tolist())) == 4
    assert len(word_hashes(None)) == len(word_hashes(" ,.!")) == 0
    assert len(shingles("one two")) == 1 and len(shingles("a b c d e f")) == 2


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_weighted_jaccard(weighted):
    r = np.random.default_rng(3)
    errors = []
    for _ in range(120):
        n = int(r.integers(3, 400))
        u = r.integers(1, 2**62, n).astype(np.uint64)
        a = r.choice([0, 0.5, 1, 2.5], n) if weighted else (r.random(n) < 0.9).astype(float)
        b = np.where(r.random(n) < 0.8, a, r.choice([0, 0.5, 1, 2.5], n) if weighted else 1.0)
        if a.sum() and b.sum():
            errors.append((signature(u, a, 240) == signature(u, b, 240)).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045


def test_empty_set_has_no_signature():
    assert len(signature(np.zeros(0, np.uint64), None, 240)) == 0
    assert len(signature(np.array([7], np.uint64), np.array([0.0]), 240)) == 0


def test_classes_against_all_pairs(spark):
    rows = [(100 * s + c, edited(s, 80 + 30 * s, c)) for s in range(6) for c in (0, 1, 2, 3, 5, 9, 20)]
    rows += [(1000 + i, prose(40, 40)) for i in range(30)] + [(2000 + i, edited(7, 400, i)) for i in range(0, 40, 2)]
    rows += [(3000, ""), (3001, None), (3002, "!!"), (3003, "..."), (3004, "!!"), (3005, "one two"), (3006, "ONE, two")]
    rows = [(i, t) for i, t in rows]
    got = {r["doc_id"]: r["class_id"] for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_buckets_of_several_blocks(spark):
    r = np.random.default_rng(2)
    sig = r.integers(0, 65536, (60, 240)).astype("<u2")
    for i in range(0, 60, 3):
        sig[i + 1, :200] = sig[i, :200]
    reps = spark.createDataFrame([(i, bytearray(sig[i].tobytes())) for i in range(60)], "rep long, sig binary")
    members = spark.createDataFrame([(1, i, i, 60) for i in range(60)], "b long, rep long, comp long, n long")
    got = sorted(map(tuple, _within(members, reps, 0.7, block=7).collect()))
    assert got == [(i, i + 1) for i in range(0, 60, 3)]


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = classes(docs).collect()
    assert len(out) == docs.count()
    kept = drop_near_duplicates(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and {r["_key"] for r in rows} == {2}
    # The text of doc 1 is also that of doc 10 and of a row without id; null, empty and repeated rows go together.
    assert Counter(r["doc_id"] for r in rows) == Counter([1, 2, 2, 3, 5, 6, 7, 8, 9, 12])
    assert classes(docs.where("false")).count() == 0
    none = classes(spark.createDataFrame([(None, "a b"), (None, "c d")], "doc_id long, text string")).collect()
    assert len({r["class_id"] for r in none}) == 2 and all(r["class_id"] < 0 for r in none)


def test_a_block_tells_fewer_pairs_than_it_has_rows(spark):
    r = np.random.default_rng(5)
    one = r.integers(0, 65536, 240).astype("<u2")
    sig = np.stack([np.where(r.random(240) < 0.95, one, r.integers(0, 65536, 240)).astype("<u2") for _ in range(80)])
    reps = spark.createDataFrame([(i, bytearray(sig[i].tobytes())) for i in range(80)], "rep long, sig binary")
    # In each of three buckets all 80 are alike; two of each component, which aren't compared.
    members = spark.createDataFrame([(b, i, i // 2, 80) for b in range(3) for i in range(80)], "b long, rep long, comp long, n long")
    for block, most in ((1024, 79), (30, 6 * 79)):
        got = [tuple(x) for x in _within(members, reps, 0.7, block=block).collect()]
        assert len(got) <= most and all(a // 2 != b // 2 for a, b in got)
        up = list(range(80))
        for _ in up:
            for a, b in got:
                up[a] = up[b] = min(up[a], up[b])
        assert up == [0] * 80


@pytest.mark.parametrize("how", [{}, {"block": 3}, {"size": 400}])
def test_components_of_plausible_texts_are_those_of_all_pairs(spark, how):
    # Neighbours in a chain are alike, others at most plausible; the texts of a second group are plausible only.
    chain = [(i, " ".join(f"w{k}" for k in range(9 * i, 9 * i + 100))) for i in range(12)]
    apart = [(100 + i, " ".join(f"v{k}" if k % 60 != 5 * i else f"u{i}k{k}" for k in range(200))) for i in range(9)]
    rows = chain + apart + [(300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = _sign(docs, 40, 6, 5)
    reps = table.select(F.col("doc_id").alias("rep"), "k1", "k2", "sig")
    # All of a group are held together; the first two are one component from the start.
    held = spark.createDataFrame([(g, g + i) for g, n in ((0, 12), (100, 9)) for i in range(1, n)], "a long, b long")
    label = spark.createDataFrame([(0, 0), (1, 0)], "rep long, comp long")
    got = _settled(held, label, docs, reps, 0.0, 5, 0.8, **how)
    up = {i: i for i, _ in rows} | {1: 0}
    for _ in rows:
        for a, b in got.collect():
            up[a] = up[b] = min(up[a], up[b])
    assert up == brute(rows)
    if not how:
        assert got.count() < len(rows)
