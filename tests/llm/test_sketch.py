import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.llm.common import shingles
from sylva.llm.sketch import K, containment, distinct, fingerprint, merge, pack, resemblance, sketch, union_fingerprints, unpack, with_next
from tests.llm.fixtures import awkward, prose


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=300), st.lists(st.integers(0, 400), max_size=300))
def test_parts_merge_into_the_whole(a, b):
    x, y = (np.unique(np.array(v, np.uint64)) for v in (a, b))
    assert (merge(x[:K], y[:K]) == np.union1d(x, y)[:K]).all()


def test_estimates():
    r = np.random.default_rng(0)
    pool = r.integers(0, 1 << 48, 6000).astype(np.uint64)
    a, b = pool[:4000], pool[1000:]
    x, y = np.sort(a)[:K], np.sort(b)[:K]
    assert resemblance(x, y) == pytest.approx(0.5, abs=0.12)
    assert containment(x, y) == pytest.approx(0.75, abs=0.2)
    assert distinct(x) == pytest.approx(4000, rel=0.2)
    assert resemblance(x[:0], y[:0]) == 1 and resemblance(x, y[:0]) == 0 and (unpack(pack(x)) == x).all()


def test_short_texts_are_exact():
    a, b = prose(1, 90), prose(1, 90)[:300] + " other words in the end of it"
    p, q = set(shingles(a).tolist()), set(shingles(b).tolist())
    assert resemblance(sketch(a), sketch(b)) == pytest.approx(len(p & q) / len(p | q))


def test_edits_and_next_on_awkward_rows(spark):
    docs = awkward(spark)
    got = with_next(docs).collect()
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS h").collect()}
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, hashes[r["doc_id"], r["text"]]))
    want = []
    for i, r in enumerate(rows):
        t, n = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((r["doc_id"], len(t), hashlib.sha256(e.encode()).hexdigest(), pack(sketch(t)), pack(sketch(e)), round(resemblance(sketch(t), sketch(e)), 9), round(resemblance(sketch(t), sketch(n)), 9)))
    assert sorted(map(str, want)) == sorted(str((*r[:5], round(r[5], 9), round(r[6], 9))) for r in got)
    assert with_next(docs.where("false")).count() == 0
    alone = with_next(docs.where("doc_id = 1")).first()
    assert alone["near_edited"] <= 1 and alone["near_next"] == 1


def test_union_of_a_group(spark):
    docs = spark.createDataFrame([(i % 2, prose(i, 50)) for i in range(12)] + [(None, None)], "g int, text string")
    got = {r["g"]: r["fingerprint"] for r in union_fingerprints(fingerprint(docs), ["g"]).collect()}
    for g in (0, 1):
        whole = np.unique(np.concatenate([shingles(prose(i, 50)) >> np.uint64(16) for i in range(g, 12, 2)]))[:K]
        assert got[g] == pack(whole)
    assert got[None] == ""
