import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sylva.llm.packing import byte_tokenizer, configurations, make_plan, pack, pieces
from tests.llm.fixtures import awkward


def sequences(histogram, room, **how):
    plan = make_plan(histogram, room, **how)
    out = defaultdict(list)
    for s, n in histogram.items():
        for r in range(n):
            seq, at = plan.find(s, r)
            out[seq].append((at, s))
    for own in out.values():
        end = 0
        for at, s in sorted(own):
            assert at == end
            end += s
        assert end <= room
    assert len(out) == plan.sequences
    return plan.sequences


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 40), st.sampled_from([0.1, 0.25, 0.4]))
def test_every_piece_has_a_place_of_its_own(lengths, groups, long):
    n = sequences(Counter(lengths), 64, groups=groups, long=long)
    assert -(-sum(lengths) // 64) <= n <= len(lengths)


def test_few_sizes_reach_the_optimum():
    # 300 + 350 + 374 fill a sequence; 600 and 424 do.
    assert sequences({300: 50, 350: 50, 374: 50, 600: 20, 424: 20}, 1024) == 70


def test_configurations_beat_largest_first():
    # Largest first puts 6 and 4 together and leaves the 3s alone; best is 4+3+3 and 6 + 4.
    use = configurations([3, 4, 6], [60, 60, 30], 10)
    assert sum(u for _, u in use) == pytest.approx(60)


def test_near_the_bound_on_many_lengths():
    r = np.random.default_rng(5)
    h = Counter(r.integers(1, 1025, 4000).tolist())
    assert sequences(h, 1024) <= 1.03 * sum(s * n for s, n in h.items()) / 1024 + 1


def test_no_pieces(spark):
    assert make_plan({}).sequences == 0
    assert pack(pieces(awkward(spark).where("false"))).count() == 0


def test_ids_are_those_of_the_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    own = byte_tokenizer()
    for text in ["", "a", "  two  spaces\n\n", "Niño's über-été 漢字 🎉", "<|endoftext|> x", "\x00\t", "a" * 3000, "don't 12345 !!!"]:
        assert own.encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


def test_pieces_of_awkward_rows(spark):
    docs = awkward(spark)
    got = pack(pieces(docs, with_ids=True)).toPandas()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got.itertuples())
    own = byte_tokenizer()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*own.encode_ordinary(r["text"] or ""), 2], "<u4")
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[a : first + 1024 * k]
            want[r["doc_id"] or -1, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    for _, q in got.groupby("sequence_id"):
        q = q.sort_values("offset")
        assert q.offset.tolist() == [0, *q.length.cumsum()[:-1]] and q.length.sum() <= 1024


def test_added_tokens_in_texts_are_found(spark):
    """Against the tokenizer with its default settings."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "  <|endoftext|>\n\n 's", "<|endof<|endoftext|>text|>", "<|ENDOFTEXT|> <|endoftext", "plain"]
    rows = pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {str(i): [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
