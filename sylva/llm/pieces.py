"""SentencePiece encoding and decoding as a max-plus scan.

An encoding is the best path through the lattice of vocabulary pieces. For a
unigram model a piece weighs its score. For a merge model (BPE) a piece weighs 0
after a piece it is compatible with, the merges of the two alone leaving both as
they are, and minus infinity else: the one path of weight 0 is the merges' result.

A giant text is cut into chunks anywhere. What crosses a cut is a boundary state,
the piece that covers the last character before it. A chunk gives the matrix of the
best weights from each entry state to each exit state. Matrices combine by max and
plus, which is associative: blocks of neighbours give the matrix of the block, level
by level, until one block is left; the best states then come down the same levels to
all cuts, and each chunk gives its own pieces.
A place where no vocabulary piece can cross (any character, then a word mark) has
one state whatever came before, so the words of a chunk are lattices of their own
and are solved once for each distinct word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, cached_property, reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import U, mix, query, table
from sylva.session import materialize

VOCABULARY = "piece_bpe_32k.model"
CHUNK = 32_768
MARK = "▁"
BLOCK = 64
MEMO = 300_000
PENALTY = 10.0  # fixed value: how far below the least score an unknown character is


class Lattice:
    """A vocabulary and the weights of paths.

    ``kind``: "bpe" or "unigram". ``merge``: priorities of pieces; ``ids``: their
    numbers. A character in no piece is one unknown piece."""

    def __init__(self, ids: dict[str, int], scores: dict[str, float], kind: str = "bpe"):
        self.ids, self.scores, self.kind = ids, scores, kind
        self.most = max(map(len, ids), default=1)
        self.low = min(scores.values(), default=0.0) - PENALTY
        self.letters = {p for p in ids if len(p) == 1}
        self.scan = ahocorasick.Automaton()
        for p in ids:
            self.scan.add_word(p, p)
        self.scan.make_automaton()
        self.splits = not any(MARK in p.lstrip(MARK) for p in ids)
        own = f"[{''.join(map(re.escape, self.joined()))}]" if ids else "[^\\s\\S]"
        other = own.replace("[", f"[^{MARK}", 1) if ids else f"[^{MARK}]"
        self.inner = re.compile(f"{MARK}+(?:{own}+|{other}*)|{own}+|{other}+")
        self.fit: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[list[str], float]] = {}

    def joined(self) -> list[str]:
        """The largest set of letters that pieces, marks left out, join to one another: no piece crosses from them to others or back."""
        up: dict[str, str] = {MARK: MARK}

        def root(c: str) -> str:
            while (above := up.setdefault(c, c)) != c:
                up[c] = c = up[above]
            return c

        for p in self.ids:
            inner = p.lstrip(MARK)
            for c in inner:
                up[root(c)] = root(inner[0])
        many = Counter(map(root, [*up]))
        most = max(many, key=many.get)
        return sorted(c for c in [*up] if c != MARK and root(c) == most) or [MARK]

    @cached_property
    def begins(self) -> dict[str, str]:
        """All beginnings of pieces, each with the piece that it is, else an empty string."""
        return {p[:k]: "" for p in self.ids for k in range(1, len(p))} | {p: p for p in self.ids}

    def merged(self, text: str) -> list[str]:
        """What the merges leave of a short string: always the best pair, the leftmost of equals."""
        parts, get, none = list(text), self.scores.get, -np.inf
        pair = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pair and (best := max(pair)) > none:
            at = pair.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pair[at]
            if at:
                pair[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(pair):
                pair[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def weight(self, before: str, piece: str) -> float:
        """Of a piece after another; the empty string stands before the first."""
        if self.kind == "unigram":
            return self.scores.get(piece, self.low)
        got = self.fit.get((before, piece))
        if got is None:
            got = self.merged(before + piece) == ([before, piece] if before else [piece])
            if len(self.fit) >= MEMO:
                self.fit.clear()
            self.fit[before, piece] = got
        return 0.0 if got else -np.inf

    def walk(self, text: str, first: str = "") -> list[tuple[float, str]]:
        """For each place in ``text`` the best weight of a path that ends there, and its last piece; none: minus infinity."""
        size, weight, merges = len(text), self.weight, self.kind == "bpe"
        fit, none = self.fit, -np.inf
        best, last = [none] * (size + 1), [""] * (size + 1)
        best[0], last[0] = 0.0, first
        if merges and self.letters.issuperset(text):
            # All pieces in the text by one scan, by where they end.
            for e, piece in self.scan.iter(text):
                j = e + 1 - len(piece)
                if best[e + 1] == none and best[j] == 0.0:
                    ok = fit.get((last[j], piece))
                    if ok or ok is None and weight(last[j], piece) == 0.0:
                        best[e + 1], last[e + 1] = 0.0, piece
            return list(zip(best, last, strict=True))
        begins = self.begins
        for j in range(size):
            so_far, before = best[j], last[j]
            if so_far == none:
                continue
            for i in range(j + 1, size + 1):
                piece = text[j:i]
                whole = begins.get(piece)
                if whole is None and i > j + 1:
                    break
                # A character is a piece, known or not. Of merges one path at most comes to a place.
                if (whole or i == j + 1) and not (merges and best[i] == 0.0):
                    if merges:
                        ok = fit.get((before, piece))
                        if ok or ok is None and weight(before, piece) == 0.0:
                            best[i], last[i] = 0.0, piece
                    elif (w := so_far + weight(before, piece)) > best[i]:
                        best[i], last[i] = w, piece
                if whole is None:
                    break
        return list(zip(best, last, strict=True))

    def path(self, text: str) -> list[str]:
        """The pieces of the best path through a string between two places that nothing crosses.

        Of merges one path at most comes to a place, and weighs 0: it is looked for
        from its beginning, longest pieces first, and a place that it can't go on from
        is not tried again. Other models need all places' weights."""
        size = len(text)
        if self.kind != "bpe":
            return self.back(self.walk(text), size)
        begins, fit, weight = self.begins.get, self.fit.get, self.weight
        out, open_, dead = [], [], set()
        at, before, follow = 0, "", None
        while at < size:
            if follow is None:
                # What may follow, longest last.
                follow, end = [text[at]], at + 2
                while end <= size and (whole := begins(text[at:end])) is not None:
                    if whole:
                        follow.append(whole)
                    end += 1
            while follow:
                piece = follow.pop()
                if not dead or at + len(piece) not in dead:
                    ok = fit((before, piece))
                    if ok or ok is None and weight(before, piece) == 0.0:
                        open_.append(follow)
                        out.append(piece)
                        at += len(piece)
                        before, follow = piece, None
                        break
            else:
                if not out:
                    return self.back(self.walk(text), size)
                dead.add(at)
                at -= len(out.pop())
                before, follow = out[-1] if out else "", open_.pop()
        return out

    @staticmethod
    def back(found: list[tuple[float, str]], end: int) -> list[str]:
        """The pieces of the best path to a place."""
        out = []
        while end > 0:
            out.append(found[end][1])
            end -= len(found[end][1])
        return out[::-1]

    def word(self, text: str) -> tuple[list[str], float]:
        """The pieces and weight of a string between two places that nothing crosses."""
        got = self.words.get(text)
        if got is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            pieces = [p for part in self.split(text) for p in self.path(part)]
            weight = 0.0 if self.kind == "bpe" else sum(self.weight("", p) for p in pieces)
            got = self.words[text] = (pieces, weight)
        return got

    def cuts(self, text: str) -> list[str]:
        """The strings between the places that no piece crosses."""
        return _PARTS.findall(text) if self.splits else [text]

    def split(self, word: str) -> list[str]:
        """One of ``cuts`` where no piece crosses from one set of letters to another."""
        return self.inner.findall(word) if self.splits else [word]

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(from, to) of all pieces that cover the character before ``at``."""
        out = []
        for a in range(max(0, at - self.most), at):
            for b in range(at, min(len(text), a + self.most) + 1):
                if text[a:b] in self.ids or b - a == 1:
                    out.append((a - at, b - at))
        return out


_PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus: the best weights over two chunks, one after the other."""
    return (a[:, :, None] + b[None]).max(1)


class Chunk:
    """A piece of a text with what it needs of its surroundings: ``left`` before it and ``right`` after it, empty at a text's ends."""

    def __init__(self, lattice: Lattice, left: str, body: str, right: str):
        self.lattice, self.text = lattice, left + body + right
        self.start, self.end = len(left), len(left) + len(body)
        self.entries = lattice.states(self.text, self.start) if left else [(0, 0)]
        self.exits = lattice.states(self.text, self.end) if right else [s for s in lattice.states(self.text, self.end) if s[1] == 0] or [(0, 0)]
        # Between the first and the last place that nothing crosses, the pieces are the same from any entry.
        firm = [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", self.text)] if lattice.splits else []
        firm = [p for p in firm if self.start + lattice.most <= p < self.end]
        self.head, self.tail = (firm[0], firm[-1]) if firm else (None, None)
        if firm:
            self.last = lattice.walk(self.text[self.tail : self.end])

    def _piece(self, at: int, state: tuple[int, int]) -> str:
        return self.text[at + state[0] : at + state[1]]

    def _out(self, found: list[tuple[float, str]], base: int, state: tuple[int, int]) -> float:
        """The weight of going on from a walk, begun at ``base``, to an exit state."""
        at = self.end + state[0] - base
        if state == (0, 0):
            return found[-1][0]
        if at < 0 or found[at][0] == -np.inf:
            return -np.inf
        return found[at][0] + self.lattice.weight(found[at][1], self._piece(self.end, state))

    def _walks(self, entry: tuple[int, int]):
        p = self.start + entry[1]
        stop = self.end if self.head is None else self.head
        return p, self.lattice.walk(self.text[p:stop], self._piece(self.start, entry))

    def matrix(self) -> np.ndarray:
        out = np.full((len(self.entries), len(self.exits)), -np.inf)
        if self.head is not None:
            ends = np.array([self._out(self.last, self.tail, s) for s in self.exits])
            # The one path of merges weighs 0.
            middle = 0.0 if self.lattice.kind == "bpe" else sum(self.lattice.word(w)[1] for w in self.lattice.cuts(self.text[self.head : self.tail]))
        for i, entry in enumerate(self.entries):
            p, found = self._walks(entry)
            if self.head is None:
                out[i] = [self._out(found, p, s) for s in self.exits]
            else:
                out[i] = found[-1][0] + middle + ends
        return out

    def parts(self, i: int, j: int) -> tuple[list[str], str, list[str]]:
        """What begins in the chunk, given its entry and exit states: pieces, the text between the firm places, pieces."""
        p, found = self._walks(self.entries[i])
        state = self.exits[j]
        end = self.end + state[0]
        last = [self._piece(self.end, state)] if state != (0, 0) else []
        if self.head is None:
            return self.lattice.back(found, end - p) + last, "", []
        return self.lattice.back(found, self.head - p), self.text[self.head : self.tail], self.lattice.back(self.last, end - self.tail) + last

    def pieces(self, i: int, j: int) -> list[str]:
        """The pieces that begin in the chunk, given its entry and exit states."""
        head, middle, tail = self.parts(i, j)
        return head + [p for w in self.lattice.cuts(middle) for p in self.lattice.word(w)[0]] + tail


def best_states(matrices: list[np.ndarray], first: int = 0, last: int = -1) -> list[int]:
    """The state at each boundary of neighbouring chunks on the best path from state ``first`` to ``last`` (-1: the best); of equals the first."""
    ahead = [matrices[0][first]]
    for m in matrices[1:]:
        ahead.append(product(ahead[-1][None], m)[0])
    states = [int(ahead[-1].argmax()) if last < 0 else last]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int((ahead[k - 1] + matrices[k][:, states[-1]]).argmax()))
    return [first, *states[::-1]]


class Model:
    """A SentencePiece model file: its lattice, normalization and ids."""

    def __init__(self, name: str = VOCABULARY, kind: str = "bpe"):
        import os

        import public_tokenizers
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=name if os.path.exists(name) else public_tokenizers.path(name))
        self.kind = kind
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.by_id = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.word_ids: dict[str, tuple[int, ...]] = {}

    def longest(self) -> int:
        """The characters of the longest piece."""
        return max(map(len, self.by_id), default=1)

    @cached_property
    def lattice(self) -> Lattice:
        sp = self.sp
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        return Lattice({sp.id_to_piece(i): i for i in plain}, {sp.id_to_piece(i): sp.get_score(i) for i in plain}, self.kind)

    def normal(self, text: str | None) -> str:
        return self.sp.normalize(text) if text else ""

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.lattice.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "replace")]
            else:
                out.append(self.sp.unk_id())
        return out

    def encode(self, normal: str) -> list[int]:
        """A text of one chunk: one entry state, one exit state, and words between."""
        out: list[int] = []
        known = self.word_ids
        for w in self.lattice.cuts(normal):
            got = known.get(w)
            if got is None:
                if len(known) >= MEMO:
                    known.clear()
                got = ()
                for part in self.lattice.split(w):
                    have = known.get(part)
                    if have is None:
                        have = known[part] = tuple(self.ids(self.lattice.path(part)))
                    got += have
            out += got
        return out

    def decode(self, ids) -> str:
        """The text of ids, in the form before the first mark is dropped; runs of byte pieces are UTF-8, damaged bytes become U+FFFD."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(map(self.by_id.__getitem__, ids))
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.by_id[i])
        return "".join(out) + held.decode("utf-8", "replace")


@cache
def shared(vocabulary: str, kind: str) -> Model:
    """The model of a worker process: what it has found of words and pairs serves its later tasks too."""
    return Model(vocabulary, kind)


def plain(marked: str, first: bool = True) -> str:
    """Marks become spaces; the one that normalization puts first goes."""
    out = marked.replace(MARK, " ")
    return out[1:] if first and out[:1] == " " else out


ENCODED = "row long, chunk int, ids array<int>"


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, kind: str = "bpe", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with row, chunk and ids (columns of these names are replaced) in place of the text: a row for each chunk of each text, in order of ``chunk``.

    Texts of at most ``chunk`` characters are one chunk. Others are dealt out chunk
    by chunk; only their matrices meet, ``BLOCK`` neighbours at a time, and entry
    states go back to the chunks. A null or empty text is one chunk without ids.
    Every row comes back, repeated ones too."""
    docs = docs.drop("row", "chunk", "ids")
    # Ids of rows are odd for whole texts and even for giant ones, so that they don't clash.
    row = F.monotonically_increasing_id() * 2 + 1
    whole = encode_whole(docs, vocabulary, kind, chunk).select(*[c for c in docs.columns if c != "text"], row.alias("row"), F.lit(0).alias("chunk"), "told.ids")
    giant = giants(docs, chunk)
    return whole.unionByName(giant.drop("text").join(encode_giant(giant, vocabulary, kind, chunk), "row"))


def _ids(model: Model, text: str | None, ids: np.ndarray) -> tuple:
    return (ids,)


def encode_whole(docs: DataFrame, vocabulary: str = VOCABULARY, kind: str = "bpe", chunk: int = CHUNK, tell=_ids, schema: str = "ids array<int>") -> DataFrame:
    """The texts of one chunk with ``told``, a struct of what ``tell`` makes of the model, a text and its ids."""

    names = [f.split()[0] for f in schema.split(", ")]

    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared(vocabulary, kind)
        for texts in batches:
            for at in range(0, len(texts), 1024):
                out = [tell(model, t, np.array(model.encode(model.normal(t)), np.int32)) for t in texts.iloc[at : at + 1024]]
                yield pd.DataFrame(out, columns=names)

    return docs.where(_size() <= chunk).withColumn("told", F.pandas_udf(whole, schema)(F.col("text")))


def _size():
    return F.coalesce(F.length("text"), F.lit(0))


def giants(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The longer texts of ``docs``, written once, with ``row``."""
    return materialize(docs.where(_size() > chunk).withColumn("row", F.monotonically_increasing_id() * 2))


def _matrices(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(m).reshape(-1, w) for m, w in zip(pdf["matrix"], pdf["width"], strict=True)]


def _combined(pdf: pd.DataFrame) -> pd.DataFrame:
    """The matrix of a block of neighbours."""
    m = reduce(product, _matrices(pdf.sort_values("chunk")))
    return pd.DataFrame({"row": pdf["row"].iloc[:1], "chunk": pdf["block"].iloc[:1], "width": [m.shape[1]], "matrix": [m.ravel()]})


def _inside(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states of a block's members, given the block's own."""
    pdf = pdf.sort_values("chunk")
    states = best_states(_matrices(pdf), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]))
    return pd.DataFrame({"row": pdf["row"], "chunk": pdf["chunk"], "i": states[:-1], "j": states[1:]})


def scan(matrices: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, chunk, i, j): the states at both ends of every chunk, from (row, chunk, width, matrix).

    Up and down over blocks of ``block`` neighbours: no group has more, and a text of
    n chunks takes log n levels."""
    most = matrices.agg(F.max("chunk")).first()[0] or 0
    of_block = F.expr(f"cast(chunk div {block} as int)")
    levels = [matrices]
    while most >= block:
        up = levels[-1].withColumn("block", of_block).groupBy("row", "block").applyInPandas(_combined, "row long, chunk int, width int, matrix array<double>")
        levels.append(materialize(up))
        most //= block
    states = levels[-1].select("row").distinct().withColumns({"block": F.lit(0), "i": F.lit(0), "j": F.lit(-1)})
    for level in levels[::-1]:
        told = level.withColumn("block", of_block).join(states, ["row", "block"]).groupBy("row", "block")
        states = materialize(told.applyInPandas(_inside, "row long, chunk int, i int, j int")).withColumnRenamed("chunk", "block")
    return states.withColumnRenamed("block", "chunk")


def encode_giant(giant: DataFrame, vocabulary: str = VOCABULARY, kind: str = "bpe", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(row, chunk, ids) of the texts of ``giants``. The text itself isn't carried along: a chunk has its own part of it only."""
    parts = materialize(_cut(giant.select("row", "text"), vocabulary, kind, chunk).repartition(F.col("row"), F.col("chunk")))

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = shared(vocabulary, kind).lattice
        for batch in batches:
            found = [Chunk(lattice, *x).matrix() for x in zip(batch["left"], batch["body"], batch["right"], strict=True)]
            yield pd.DataFrame({"row": batch["row"], "chunk": batch["chunk"], "width": [m.shape[1] for m in found], "matrix": [m.ravel() for m in found]})

    def of(model: Model, parts: tuple[list[str], str, list[str]]) -> np.ndarray:
        head, middle, tail = parts
        return np.array(model.ids(head) + model.encode(middle) + model.ids(tail), np.int32)

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared(vocabulary, kind)
        for batch in batches:
            ids = [of(model, Chunk(model.lattice, a, b, c).parts(i, j))
                   for a, b, c, i, j in zip(*(batch[x] for x in ("left", "body", "right", "i", "j")), strict=True)]
            yield pd.DataFrame({"row": batch["row"], "chunk": batch["chunk"], "ids": ids})

    states = scan(materialize(parts.mapInPandas(transfer, "row long, chunk int, width int, matrix array<double>")), block)
    traced = parts.join(states, ["row", "chunk"]).select("row", "chunk", "left", "body", "right", "i", "j").mapInPandas(trace, ENCODED)
    return materialize(traced)


def _cut(giant: DataFrame, vocabulary: str, kind: str, chunk: int) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared(vocabulary, kind)
        side = model.longest()
        size = max(chunk, 4 * side)
        for batch in batches:
            for row, text in batch.itertuples(index=False):
                t = model.normal(text)
                # The last chunk takes what is left over, so none is short.
                starts = list(range(0, max(1, len(t) - size // 2), size))
                ends = [*starts[1:], len(t)]
                yield pd.DataFrame({
                    "row": row, "chunk": range(len(starts)), "left": [t[max(0, a - side) : a] for a in starts],
                    "body": [t[a:b] for a, b in zip(starts, ends, strict=True)], "right": [t[b : b + side] for b in ends]})

    return giant.mapInPandas(cut, "row long, chunk int, left string, body string, right string")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` with ``part``: the text of each chunk's ids. A text is its chunks' parts in order."""

    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = shared(vocabulary, "bpe")
        for ids, k in batches:
            yield pd.Series([plain(model.decode(x.tolist()), first == 0) for x, first in zip(ids, k, strict=True)], dtype=object)

    return encoded.withColumn("part", F.pandas_udf(of, "string")("ids", "chunk"))


def digest(ids: np.ndarray) -> int:
    """An order-bound sum over ids and their places in the chunk, which adds up over chunks."""
    with np.errstate(over="ignore"):
        return int((mix((np.arange(len(ids)).astype(U) << U(32)) + ids.astype(U)) >> U(32)).sum())


def _told(model: Model, text: str | None, ids: np.ndarray) -> tuple:
    part = plain(model.decode(ids.tolist()))
    return len(ids), digest(ids), len(part), part == (text or "")


@query("op2_sentencepiece")
def op2_sentencepiece(spark, sf_dir):
    """doc_id, n_tokens, ids_digest, n_chars_decoded and round_trip: whether decoding the ids gives the text, chunk by chunk of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["n_tokens", "ids_digest", "n_chars_decoded", "round_trip"]
    one = encode_whole(docs, tell=_told, schema="n_tokens long, ids_digest long, n_chars_decoded long, round_trip boolean")

    def told(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = shared(VOCABULARY, "bpe")
        for ids, k in batches:
            yield pd.DataFrame({"n": [len(x) for x in ids], "d": [digest(x) for x in ids], "part": [plain(model.decode(x.tolist()), first == 0) for x, first in zip(ids, k, strict=True)]})

    giant = giants(docs)
    tell = F.pandas_udf(told, "n long, d long, part string")("ids", "chunk").alias("x")
    many = encode_giant(giant).select("row", "chunk", tell).groupBy("row").agg(
        F.sum("x.n").alias("n_tokens"), F.sum("x.d").alias("ids_digest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "x.part"))), lambda x: x["part"]), "").alias("all")).join(giant, "row")
    return one.select("doc_id", "told.*").unionByName(many.select(
        "doc_id", "n_tokens", "ids_digest", F.length("all").cast("long").alias("n_chars_decoded"), (F.col("all") == F.col("text")).alias("round_trip")).select("doc_id", *names))
