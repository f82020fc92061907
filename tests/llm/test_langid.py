import math

import numpy as np
import pytest

from sylva.llm.langid import code_lengths, keep_known, learn, predict
from tests.llm.fixtures import awkward

LANGS = {
    "en": ["the river of the green stone was late", "seven horses that were with the other bread", "this is what they thought of the weather"],
    "fr": ["le fleuve de la pierre était très vert", "sept chevaux qui sont avec les autres pains", "c'est ce que nous pensons de la météo"],
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(20 * i + j, t * 3, k) for i, (k, ts) in enumerate(LANGS.items()) for j, t in enumerate(ts * 5)], "doc_id long, text string, lang string")


def brute_bits(texts, text, order, least, states):
    """Code length by the definition, with dictionaries and recursion."""
    def counts(ts):
        out = {}
        for t in ts:
            b = t.encode()
            for k in range(order + 1):
                for i in range(k, len(b)):
                    c = out.setdefault(b[i - k : i], {})
                    c[b[i]] = c.get(b[i], 0) + 1
        return out

    own = counts(texts)
    kept = sorted((c for c in own if not c or sum(own[c].values()) >= least), key=lambda c: (-sum(own[c].values()), len(c), c))[:states]
    kept = set(kept) | {b""}

    def p(context, x):
        while context not in kept:
            context = context[1:]
        seen = own.get(context, {})
        below = (lambda y: p(context[1:], y)) if context else (lambda y: 1 / 256)
        n, q = sum(seen.values()), len(seen)
        if not n:
            return below(x)
        if x in seen:
            return seen[x] / (n + q)
        return q / (n + q) * below(x) / (1 - sum(below(y) for y in seen))

    b = text.encode()
    return -sum(math.log2(p(b[max(0, i - order) : i], b[i])) for i in range(len(b)))


def test_exact_code_lengths(docs):
    model = learn(docs, order=3)
    assert model.langs == ["en", "fr"]
    assert np.allclose(np.exp2(-model.bits.astype(float)).sum(1), 1, atol=1e-4)
    for text in ("the stone", "la pierre était", "xyz?", "été" * 9):
        want = [brute_bits([t * 3 for t in LANGS[k] * 5], text, 3, 16, 2048) for k in model.langs]
        assert code_lengths(model, [text])[0] == pytest.approx(want, rel=1e-4)
    # However a text is cut, its code is as long.
    long = "the green river " * 90
    assert code_lengths(model, ["ab", long], 7)[1] == pytest.approx(code_lengths(model, [long])[0], rel=1e-5)


def test_contexts_of_a_language_do_not_depend_on_the_others(spark, docs):
    alone = learn(docs.where("lang = 'fr'"), states=40)
    more = docs.unionByName(docs.selectExpr("doc_id + 100 as doc_id", "repeat(text, 20) as text", "'long' as lang"))
    both = learn(more, states=40)
    text = "les autres pierres"
    assert code_lengths(both, [text])[0][both.langs.index("fr")] == pytest.approx(code_lengths(alone, [text])[0][0])
    assert len(both.step) <= 3 * 40


def test_predictions(spark, docs):
    model = learn(docs)
    ask = spark.createDataFrame([(1, "the other horses of the river"), (2, "les autres chevaux de la pierre"), (3, None), (4, ""), (5, "123 !!"), (6, "ééé")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(ask, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "und"] and got[6][0] == "fr"
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == 0
    assert {r["doc_id"] for r in keep_known(ask, model).collect()} >= {1, 2}
    assert not {r["doc_id"] for r in keep_known(ask, model).collect()} & {3, 4, 5}


def test_awkward_rows(spark, docs):
    rows = awkward(spark)
    model = learn(rows)
    assert model.langs == ["en"] and predict(rows, model).count() == rows.count()
    kept = keep_known(rows, model)
    assert kept.columns == rows.columns and all(r["score"] == "s" for r in kept.collect())
    nothing = learn(rows.where("false"))
    assert {r["lang_pred"] for r in predict(rows, nothing).collect()} == {"und"}
