import time
from collections import Counter
from itertools import product

import numpy as np
import pytest

from sylva.llm.toxicity import _EDGE, DROP_COST, EDGE_COST, KEEP_COST, SIGN_COST, SIGNS, Letters, Restorer, drop_toxic, learn, learn_letters, score
from tests.llm.fixtures import awkward, prose

BAD = ["gromble", "snerkish"]
PLAIN = Counter({w: 50 for w in ["gromble", "snerkish", "river", "stone", "weather", "horse", "green", "summer", "winter", "letter", "apple", "street"]})


@pytest.fixture(scope="module")
def letters():
    return Letters.fit(PLAIN)


def test_letter_model_counts_every_word(spark):
    words = ["river", "stone", "ärger", "x"] * 3 + [f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    texts = [(" ".join(words[i : i + 7]).title() + " 3d, c4",) for i in range(0, len(words), 7)] + [(None,), ("",)]
    got, want = learn_letters(spark.createDataFrame(texts, "text string").repartition(5)), Letters.fit(Counter(words))
    assert got.number == want.number and np.allclose(got.logp, want.logp)
    few = learn_letters(spark.createDataFrame(texts, "text string"), most=5)
    assert few.number == Letters.fit(Counter(words), 5).number and np.allclose(few.logp, Letters.fit(Counter(words), 5).logp)


def test_reading_is_the_likeliest_of_all():
    letters = Letters.fit(PLAIN)
    number, logp = letters.number, letters.logp

    def worth(out, cost):
        x = [0, 0, *(number.get(c, 1) for c in out), 0]
        return cost + sum(logp[p, q, r] for p, q, r in zip(x, x[1:], x[2:], strict=False))

    for seen in ("5t0n3", "1!1et7er", "w|!1ter", "$$um+3r", "r!!v|1e3r", "91|!20"):
        first, last = len(seen) - len(seen.lstrip(_EDGE)), len(seen.rstrip(_EDGE))
        ways = []
        for i, c in enumerate(seen):
            way = [(x, SIGN_COST) for x in SIGNS[c]] + [(c, KEEP_COST)] if c in SIGNS else [(c, 0.0)]
            way += [("", EDGE_COST)] * (c in SIGNS and not first <= i < last) + [("", DROP_COST)] * (i > 0 and c == seen[i - 1])
            ways.append(way)
        best = max(worth("".join(x for x, _ in path), sum(c for _, c in path)) for path in product(*ways))
        got = letters.decode(seen)
        assert best == pytest.approx(max(worth("".join(x for x, _ in path), sum(c for _, c in path)) for path in product(*ways) if "".join(x for x, _ in path) == got))


def test_a_long_disguise_is_read_in_linear_time():
    start = time.monotonic()
    assert len(Letters.fit(PLAIN).decode("a" + "1!" * 100_000 + "b")) > 0
    assert time.monotonic() - start < 60


@pytest.mark.parametrize("seen, word", [("gr0mble", "gromble"), ("sn3rk!sh", "snerkish"), ("grooooomble", "gromble"), ("g.r.o.m.b.l.e", "gromble"),
                                        ("$nerkish", "snerkish"), ("gromb1e", "gromble"), ("wea7her", "weather"), ("letttter", "letter"), ("str33t", "street")])
def test_disguises_are_seen_through(letters, seen, word):
    assert Restorer(letters).token(seen) == word


@pytest.mark.parametrize("token", ["river", "letter,", "2024", "x", "(stone)", "green!!", "a-b", "%%%", ""])
def test_plain_tokens_stay(letters, token):
    assert Restorer(letters).token(token) == token


def test_spelled_out_words(letters):
    assert "gromble" in " ".join(Restorer(letters).text("the g r o m b l e there")).split()[-1]


def test_decoding_is_the_best_path(letters):
    """Against all readings of a short lattice."""
    from itertools import product

    def weight(word, cost):
        x = [0, 0, *(letters.number.get(c, 1) for c in word), 0]
        return cost + sum(letters.logp[a, b, c] for a, b, c in zip(x, x[1:], x[2:], strict=False))

    ways = [[("s", 0.0)], [("t", -1.0), ("7", -4.0)], [("o", -1.0), ("0", -4.0)], [("n", 0.0)], [("e", -1.0), ("3", -4.0)]]
    best = max(("".join(x for x, _ in w) for w in product(*ways)), key=lambda r: weight(r, sum(dict(ways[i])[c] for i, c in enumerate(r))))
    assert letters.decode("s70n3") == best == "stone"


def docs_and_labels(spark):
    rows = [(i, prose(i, 30) + (f" {BAD[i // 4 % 2]} {prose(i + 500, 5)}" if i % 4 == 0 else "")) for i in range(160)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")


def test_scores(spark):
    docs, labels = docs_and_labels(spark)
    model = learn(docs, labels)
    ask = spark.createDataFrame([(1, prose(900, 40)), (2, prose(901, 40) + " gromble"), (3, "sn3rkish " + prose(902, 20)), (4, None), (5, ""), (6, "g r o m b l e")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in score(ask, model).collect()}
    assert [got[i]["predicted"] for i in range(1, 7)] == [0, 1, 1, 0, 0, 1]
    assert got[4]["score"] == got[5]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["doc_id"] for r in drop_toxic(ask, model).collect()} == {1, 4, 5}


def test_awkward_rows(spark):
    rows = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (9, 0), (77, 1)], "doc_id long, toxic int")
    model = learn(rows, labels)
    assert score(rows, model).count() == rows.count()
    kept = drop_toxic(rows, model)
    assert kept.columns == rows.columns and {r["score"] for r in kept.collect()} <= {"s"}
    empty = learn(rows.where("false"), labels.where("false"))
    assert {r["score"] for r in score(rows, empty).collect()} == {0.5}
    assert score(rows.where("false"), model).count() == 0


@pytest.mark.parametrize("seen, word", [("sh!+", "shit"), ("!diot", "idiot"), ("!diot,", "idiot"), ("a$$", "ass"), ("a55", "ass"), ("5(um", "scum"), ("idiiot", "idiot"),
                                        ("stuppid", "stupid"), ("id-iot", "idiot"), ("stu.pid", "stupid"), ("(stu.pid)", "stupid")])
def test_weak_signs_of_disguise_are_read(seen, word):
    letters = Letters.fit(PLAIN + Counter({w: 50 for w in ["shit", "idiot", "ass", "scum", "stupid"]}))
    assert word in Restorer(letters).token(seen).split()


@pytest.mark.parametrize("token", ["river!", "(stone", "summer", "green!", "don't"])
def test_what_weak_signs_say_stays(letters, token):
    assert token in Restorer(letters).token(token).split()


def test_a_document_toxic_by_weak_signs_alone(spark):
    docs, labels = docs_and_labels(spark)
    ask = spark.createDataFrame([(i, f"{prose(910 + i, 20)} {w}") for i, w in enumerate(["grom-ble", "snerrkish", "snerk!$h", "grom.ble", "wall", "river!"])], "doc_id long, text string")
    assert {r["doc_id"] for r in drop_toxic(ask, learn(docs, labels)).collect()} == {4, 5}


def test_long_runs_of_signs_are_searched_in_linear_time():
    from sylva.llm.toxicity import _INNER

    assert not _INNER.search("a" + "!" * 1_000_000 + "5")
    assert _INNER.search("a" + ".!" * 200_000 + "5b") and _INNER.search("s!t") and _INNER.search("a.5-b") and not _INNER.search("a.-b")
