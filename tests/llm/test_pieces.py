import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.llm.pieces import Chunk, Lattice, Model, best_states, decode, encode, encode_giant, giants, product, scan
from tests.llm.fixtures import awkward, prose


@pytest.fixture(scope="module")
def model():
    return Model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def by_chunks(model, text, size):
    t, side = model.normal(text), model.lattice.most
    starts = list(range(0, max(1, len(t) - size // 2), size))
    ends = [*starts[1:], len(t)]
    chunks = [Chunk(model.lattice, t[max(0, a - side) : a], t[a:b], t[b : b + side]) for a, b in zip(starts, ends, strict=True)]
    states = best_states([c.matrix() for c in chunks])
    return [i for c, a, b in zip(chunks, states, states[1:], strict=False) for i in model.ids(c.pieces(a, b))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab eéñ漢 \n▁.,thion12=🎉", max_size=80))
def test_same_ids_as_the_library(model, library, text):
    ids = model.encode(model.normal(text))
    assert ids == library.encode(text)
    assert model.decode(ids) == model.normal(text)


@pytest.mark.parametrize("text", ["a" * 500, "ha" * 300, " " * 200 + "x" + " " * 90, "nevertheless" * 40, "日本語" * 80, prose(3, 300)])
@pytest.mark.parametrize("size", [64, 101])
def test_chunks_cut_anywhere(model, library, text, size):
    assert by_chunks(model, text, size) == library.encode(text)


def test_unigram_weights_against_all_segmentations():
    scores = {"a": -1.0, "b": -1.2, "ab": -1.5, "ba": -2.6, "aba": -2.4, "bb": -1.9}
    lattice = Lattice({p: i for i, p in enumerate(scores)}, scores, "unigram")

    def best(t):
        return 0.0 if not t else max(best(t[k:]) + (scores.get(t[:k], -99) if t[:k] in scores else -99) for k in range(1, min(3, len(t)) + 1))

    for text in ("abab", "bbaab", "abaabab", "aaaabbb"):
        assert lattice.walk(text)[-1][0] == pytest.approx(best(text))


def test_products_associate():
    r = np.random.default_rng(1)
    a, b, c = r.normal(size=(3, 4)), r.normal(size=(4, 2)), r.normal(size=(2, 5))
    assert np.allclose(product(product(a, b), c), product(a, product(b, c)))


def test_tables(spark, library):
    docs = awkward(spark)
    got = decode(encode(docs, chunk=700)).toPandas().sort_values(["row", "chunk"])
    texts = {}
    for r in got.itertuples():
        texts.setdefault(r.row, [r.doc_id, [], ""])
        texts[r.row][1] += list(r.ids)
        texts[r.row][2] += r.part
    key = lambda x: (x[0] != x[0] or x[0] is None, str(x[0]), x[1], x[2])
    have = sorted(((None if i != i else i, ids, t) for i, ids, t in texts.values()), key=key)
    want = sorted(((r["doc_id"], library.encode(r["text"] or ""), r["text"] or "") for r in docs.collect()), key=key)
    assert [x[1:] for x in have] == [x[1:] for x in want]
    assert encode(docs.where("false")).count() == 0


def test_blocks_of_any_size_find_the_best_path(spark):
    r = np.random.default_rng(4)
    rows, want = [], {}
    for row, n in ((2, 1), (4, 7), (6, 30)):
        width = [1, *r.integers(1, 5, n - 1), 1]
        ms = [r.integers(0, 1000, (a, b)) * 1.0 for a, b in zip(width, width[1:], strict=False)]
        rows += [(row, k, m.shape[1], m.ravel().tolist()) for k, m in enumerate(ms)]
        states = best_states(ms)
        want |= {(row, k): (states[k], states[k + 1]) for k in range(n)}
    table = spark.createDataFrame(rows, "row long, chunk int, width int, matrix array<double>")
    for block in (2, 3, 64):
        assert {(x["row"], x["chunk"]): (x["i"], x["j"]) for x in scan(table, block).collect()} == want
    assert scan(table.where("false")).count() == 0


def test_a_giant_in_many_blocks(spark, library):
    texts = [(1, prose(5, 2500)), (2, "nevertheless" * 400)]
    giant = giants(spark.createDataFrame(texts, "doc_id long, text string"), 100)
    got = encode_giant(giant, chunk=100, block=8)
    assert got.columns == ["row", "chunk", "ids"]
    ids = {}
    for x in sorted(got.join(giant, "row").collect(), key=lambda x: x["chunk"]):
        ids.setdefault(x["doc_id"], []).extend(x["ids"])
    assert ids == {i: library.encode(t) for i, t in texts}


def test_words_are_solved_once_and_by_need(library):
    model = Model()
    text = " ".join(f"{w}{end}" for w in ("stone", "nevertheless", "Über", "naïve") for end in (",", ".", "?!", ")", ".\n")) * 30
    normal = model.normal(text)
    assert model.encode(normal) == library.encode(text)
    # Letters and what follows them, which no piece joins, are apart.
    assert {w for w in model.word_ids if "nevertheless" in w} == {"▁nevertheless"}
    # Which pieces a chunk has is asked for after its states are known.
    Chunk(model.lattice, normal[:100], normal[100:900], normal[900:1000]).matrix()
    assert not model.lattice.words


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="▁aehinorst.,0漢é", min_size=1, max_size=40))
def test_the_path_is_that_of_all_places(model, text):
    lattice = model.lattice
    assert lattice.path(text) == lattice.back(lattice.walk(text), len(text)) == [p for x in lattice.split(text) for p in lattice.path(x)] or "▁" in text[1:]


def test_a_path_that_turns_back():
    # The merges make ab, then abc of no use: a longest piece first leads nowhere.
    scores = {"a": -9.0, "b": -9.0, "c": -9.0, "bc": -1.0, "ab": -2.0, "abb": -3.0}
    lattice = Lattice({p: i for i, p in enumerate(scores)}, scores)
    for text in ("abc", "ababc", "abbc", "abbbcab", "aabbcc", "abxbc"):
        assert lattice.path(text) == lattice.merged(text) == lattice.back(lattice.walk(text), len(text))
