"""Language model scoring with Brown word classes.

Exchange clustering assigns the commonest words to classes so that the class bigram
likelihood of the corpus grows with each move. Then, in rounds, every other word
takes the class in which its own neighbours are likeliest. Texts are turned to
numbers once. A round counts the classes beside the near words, which travel with
the tasks, in one array a task; what stands beside all other words is gathered by
word once, and rounds only read it.
The end of a text and the words never met have classes of their own. A token's
probability is that of its class after the class before it, times that of the word
in its class. Counts cover every training text and every word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import box, query, remainder, table, unbox
from sylva.session import materialize, meet, spread

CLASSES = 64
CLUSTERED = 1024
NEAR_WORDS = 100_000
FLUSH = 250_000
PASSES = 12
ROUNDS = 2
WORDS = 256
SMOOTH, BACK = 0.1, 5.0


def tokens(text: str | None) -> list[bytes]:
    """Words between spaces and \\x09-\\x0d, A-Z lowered; nothing else is split or lowered."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(w binary, n) over all texts. A task sums as many words as it can hold before it sends them on."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(tokens(text))
                if len(seen) >= FLUSH:
                    yield pd.DataFrame({"w": list(seen), "n": list(seen.values())})
                    seen = Counter()
        yield pd.DataFrame({"w": list(seen), "n": list(seen.values())})

    return docs.select("text").mapInPandas(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` commonest words, commonest first; ties in a fixed order of the words.

    Counts are first put in a histogram of logarithmic steps, and the words of the
    step that passes ``most`` in one by count and hash, so that no task or driver
    gathers many more than ``most`` words."""
    step, part = F.floor(F.log2("n") * 64), F.pmod(F.xxhash64("w"), F.lit(4096))
    bins = sorted(counts.groupBy(step.alias("b")).count().collect(), key=lambda r: -r["b"])
    total, wanted = 0, F.lit(False)
    for r in bins:
        if total + r["count"] > most:
            for x in sorted(counts.where(step == r["b"]).groupBy("n", part.alias("p")).count().collect(), key=lambda x: (-x["n"], x["p"])):
                last, total = (x["n"], x["p"]), total + x["count"]
                if total >= most:
                    break
            wanted = (step > r["b"]) | ((step == r["b"]) & ((F.col("n") > last[0]) | ((F.col("n") == last[0]) & (part <= last[1]))))
            break
        total += r["count"]
        wanted = step >= r["b"]
    rows = sorted(((bytes(r["w"]), r["n"], r["p"]) for r in counts.where(wanted).select("w", "n", part.alias("p")).collect()), key=lambda x: (-x[1], x[2], x[0]))
    return sorted(((w, n) for w, n, _ in rows[:most]), key=lambda x: (-x[1], x[0]))


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """A class for each word from the counts ``pairs[before, after]``.

    The last two words are the rest and the end; they keep classes of their own,
    ``classes`` and ``classes + 1``. Words go in turn to where the class bigram
    likelihood gains most, ties to the lower class, until none moves."""
    n = len(pairs)
    kinds = classes + 2
    cls = np.append(np.arange(n - 2) % classes, [classes, classes + 1])
    one = np.eye(kinds)[cls]
    m = one.T @ pairs @ one
    out, into = pairs.sum(1), pairs.sum(0)
    left, right = m.sum(1), m.sum(0)
    for _ in range(passes):
        moved = 0
        for w in range(n - 2):
            g, own = cls[w], pairs[w, w]
            r = np.bincount(cls, pairs[w], kinds)
            c = np.bincount(cls, pairs[:, w], kinds)
            m[g] -= r
            m[:, g] -= c
            m[g, g] += own
            r[g] -= own
            c[g] -= own
            left[g] -= out[w]
            right[g] -= into[w]
            d = np.diag(m)
            row = _phi(m + r) - _phi(m)
            col = _phi(m + c[:, None]) - _phi(m)
            gain = row.sum(1) - np.diag(row) + col.sum(0) - np.diag(col) + _phi(d + r + c + own) - _phi(d)
            gain -= _phi(left + out[w]) - _phi(left) + _phi(right + into[w]) - _phi(right)
            k = int(gain[:classes].argmax())
            if gain[k] <= gain[g] + 1e-9:
                k = g
            moved += k != g
            cls[w] = k
            m[k] += r
            m[:, k] += c
            m[k, k] += own
            left[k] += out[w]
            right[k] += into[w]
        if not moved:
            break
    return cls


@dataclass
class Model:
    """``near``: frequent words and their counts; ``cls``: their classes, that of unknown words and that of the end."""

    near: list[tuple[bytes, int]]
    cls: np.ndarray
    step: np.ndarray  # log10 P(class | class before)
    size: np.ndarray  # tokens of each class
    total: int
    distinct: int
    ends: int
    counts: DataFrame | None = None  # (w, n, k): count and class of all words but those of ``near``


_END = np.full(1, -1, np.int32)
_PAIR, _AFTER = 1 << 61, 1 << 60


def _lists(owner: np.ndarray, owners: int, values: pa.Array) -> pa.ListArray:
    """For each of ``owners`` owners the list of its values; ``owner`` ascends."""
    at = np.searchsorted(owner, np.arange(owners + 1))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)


def pack(x: np.ndarray) -> bytes:
    """All lowest bytes first, then all second ones and so on, which takes less room."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), "zstd", asbytes=True)


def unpack(x: pa.Scalar, n: int, kind: type = np.int32) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(x.as_buffer(), n * size, "zstd"), np.uint8).reshape(size, n).T).view(kind).ravel()


class Numbers(dict):
    """Numbers of words; a word met for the first time gets the next one."""

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self)
        return n

    def forget(self, n: int) -> list[bytes]:
        """Drops and returns all words but the first ``n``."""
        return [self.popitem()[0] for _ in range(len(self) - n)][::-1]


def coded(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(x, m, w, bytes): blocks of whole texts as m numbers, those of ``words`` and, from there on, of the block's other words w, with spaces between; -1 ends a text."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers(zip(words, range(len(words)), strict=True))
        held: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            x = np.concatenate(held)
            w = np.frombuffer(b" ".join(number.forget(len(words))), np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([pack(x)]), pa.array([len(x)]), pa.array([pack(w)]), pa.array([len(w)])], ["x", "m", "w", "bytes"])

        for batch in batches:
            for text in batch.column(0):
                t = tokens(text.as_py())
                held += [np.fromiter(map(number.__getitem__, t), np.int32, len(t)), _END]
                size += len(t) + 1
                if size >= 4 * FLUSH:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return materialize(docs.select("text").mapInArrow(code, "x binary, m long, w binary, bytes long"))


def cell_counts(blocks: DataFrame, cells: Callable[[np.ndarray], np.ndarray], total: int, width: int) -> DataFrame:
    """(s, x): how often ``cells`` names each of ``total`` cells, in slices of ``width``; ``cells`` gets a block's numbers after a -1.

    A task holds one count a cell and sends what isn't 0, by slices."""

    def told(held: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, total, width):
            part = held[s : s + width]
            at = np.flatnonzero(part)
            if len(at):
                i = np.diff(at, prepend=0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([s // width], pa.int32()), pa.array([len(at)]), pa.array([pack(i)]), pa.array([pack(part[at])])], ["s", "m", "i", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = np.zeros(total, np.int32), 0
        for batch in batches:
            for x, m in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if size + 3 * m >= 1 << 31:
                    yield from told(held)
                    held, size = np.zeros(total, np.int32), 0
                np.add.at(held, cells(np.concatenate((_END, unpack(x, m)))), 1)
                size += 3 * m
        yield from told(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, m, i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if s not in held:
                    held[s] = np.zeros(width, np.int64)
                held[s][np.cumsum(unpack(i, m))] += unpack(n, m)
        for s, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pack(x)])], ["s", "x"])

    each = blocks.select("x", "m").mapInArrow(count, "s int, m long, i binary, n binary")
    return materialize(spread(each, "s").mapInArrow(add, "s int, x binary"))


def dense(slices: DataFrame, total: int, width: int) -> np.ndarray:
    """The counts of ``total`` cells, from slices that are numbered from 0 on."""
    out = np.zeros(-(-total // width) * width, np.int64)
    for s, x in slices.collect():
        out[s * width : (s + 1) * width] = unpack(pa.scalar(bytes(x)), width, np.int64)
    return out[:total].astype(float)


def contexts(blocks: DataFrame, far: int) -> DataFrame:
    """(w, x): each word from number ``far`` on with what all texts have beside it.

    x holds (number before + 1) * (``far`` + 2) + number after + 1 for each place of
    the word, any neighbour from ``far`` on as ``far``. Where two such words meet,
    the x of both have the place's own number, with ``_PAIR`` and, after it, ``_AFTER``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = TaskContext.get().partitionId() << 36
        for batch in batches:
            for x, m, w, size in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                names = unpack(w, size, np.uint8).tobytes().split()
                x = np.concatenate((_END, unpack(x, m))).astype(np.int64)
                at = np.flatnonzero(x >= far)
                w, after = x[at] - far, x[at + 1]
                both = after >= far
                place = _PAIR + met + np.arange(both.sum())
                met += len(place)
                owner = np.concatenate((w, w[both], after[both] - far))
                value = np.concatenate(((np.minimum(x[at - 1], far) + 1) * (far + 2) + np.minimum(after, far) + 1, place, place + _AFTER))
                order = np.argsort(owner, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), _lists(owner[order], len(names), pa.array(value[order]))], ["w", "x"])

    found = blocks.where("bytes > 0").mapInArrow(find, "w binary, x array<long>")
    # A word is rarer than all that have smaller numbers, so its places are a small part of all.
    return materialize(spread(found, "w").groupBy("w").agg(F.sort_array(F.flatten(F.collect_list("x"))).alias("x")))


def _weights(step: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a class before, a class after and each place add for each class a word may have."""
    classes = len(step) - 2
    return step[:, :classes], step[:classes].T, np.log10(size[:classes] + SMOOTH)


class Assigned:
    """Words of a batch of ``contexts`` in the classes in which their neighbours are likeliest, ties to the lower class.

    n, k: places and class of each; owner, before, after: word and neighbours of each
    place; pair, pair_owner: places where two such words meet."""

    def __init__(self, x: pa.ListArray, far: int, cls: np.ndarray, weights: tuple[np.ndarray, np.ndarray, np.ndarray]):
        value, owner = x.flatten().to_numpy(), x.value_parent_indices().to_numpy()
        place = value < _PAIR
        self.pair, self.pair_owner = value[~place] - _PAIR, owner[~place]
        self.owner, value = owner[place], value[place]
        self.before, self.after = value // (far + 2) - 1, value % (far + 2) - 1
        self.n = np.bincount(self.owner, minlength=len(x))
        into, out, cost = weights
        gain = -self.n[:, None] * cost
        for i in range(0, len(value), 10_000):
            part = slice(i, i + 10_000)
            o = self.owner[part]
            first = np.flatnonzero(np.diff(o, prepend=-1))
            gain[o[first]] += np.add.reduceat(into[cls[self.before[part]]] + out[cls[self.after[part]]], first)
        self.k = gain.argmax(1)


def assign(found: DataFrame, far: int, cls: np.ndarray, step: np.ndarray, size: np.ndarray) -> DataFrame:
    """(w, n, k): the words of ``contexts``, their counts and classes. ``cls``: of the words with smaller numbers, of all others and of the end."""
    weights = _weights(step, size)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = Assigned(batch.column(1), far, cls, weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a.n), pa.array(a.k, pa.int32())], ["w", "n", "k"])

    return materialize(found.mapInArrow(best, "w binary, n long, k int"))


def beside(found: DataFrame, far: int, cls: np.ndarray, step: np.ndarray, size: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Counts of class after class where a word of ``contexts`` stands, in the class ``assign`` gives it; its neighbours have classes ``later``."""
    kinds, weights = len(step), _weights(step, size)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(p: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64))], ["p", "c", "n"])

        m = np.zeros(kinds * kinds, np.int64)
        for batch in batches:
            a = Assigned(batch.column(1), far, cls, weights)
            k, before, after = a.k[a.owner], a.before != far, a.after != far
            m += np.bincount(later[a.before[before]] * kinds + k[before], minlength=kinds * kinds)
            m += np.bincount(k[after] * kinds + later[a.after[after]], minlength=kinds * kinds)
            second, k = a.pair >= _AFTER, a.k[a.pair_owner]
            yield rows(a.pair - second * _AFTER, np.where(second, k, k * kinds), np.zeros(len(k)))
        cell = np.flatnonzero(m)
        yield rows(-1 - cell, np.zeros(len(cell)), m[cell])

    # Two rows of each place where two far words meet add up to the cell of their classes.
    met = found.mapInArrow(tell, "p long, c long, n long").groupBy("p").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    cell, n = F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("c")), F.when(F.col("p") < 0, F.col("n")).otherwise(1)
    out = np.zeros(kinds * kinds)
    for c, n in met.groupBy(cell.alias("c")).agg(F.sum(n).alias("n")).collect():
        out[c] = n
    return out.reshape(kinds, kinds)


def near_counts(blocks: DataFrame, cls: np.ndarray, kinds: int, first: int) -> tuple[DataFrame, np.ndarray]:
    """Counts of classes before and after each word with a number from ``first`` on that has a class, and of class after class where neither word is far.

    Words are dealt in turn to slices of ``WORDS``; ``near_classes`` reads them. ``cls`` ends with the class of far words and that of the end."""
    far, width = len(cls) - 2, WORDS * 2 * kinds
    slices = -(-(far - first) // WORDS)
    i = np.arange(far - first)
    place = np.full(far + 2, -1)
    place[first:far] = i % max(slices, 1) * width + i // max(slices, 1) * 2 * kinds

    def cells(x: np.ndarray) -> np.ndarray:
        x = np.minimum(x, far)
        k, at, near = cls[x], place[x], x < far
        before, after = at[1:] >= 0, at[:-1] >= 0
        both = near[1:] & near[:-1]
        return np.concatenate(((at[1:] + k[:-1])[before], (at[:-1] + kinds + k[1:])[after], (slices * width + k[:-1] * kinds + k[1:])[both]))

    found = cell_counts(blocks, cells, slices * width + kinds * kinds, width)
    steps = found.where(F.col("s") >= slices).select(F.col("s") - slices, "x")
    return found.where(F.col("s") < slices), dense(steps, kinds * kinds, width).reshape(kinds, kinds)


def near_classes(found: DataFrame, far: int, first: int, step: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Classes of the words ``near_counts`` counts beside, as ``assign`` takes them."""
    kinds = len(step)
    slices, (into, out, cost) = -(-(far - first) // WORDS), _weights(step, size)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen = unpack(x, WORDS * 2 * kinds, np.int64).reshape(-1, 2 * kinds)[: len(range(first + s, far, slices))]
                k = (seen[:, :kinds] @ into + seen[:, kinds:] @ out - seen[:, :kinds].sum(1)[:, None] * cost).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(range(first + s, far, slices), pa.int32()), pa.array(k, pa.int32())], ["i", "k"])

    got = found.mapInArrow(best, "i int, k int").toPandas()
    cls = np.zeros(far - first, int)
    cls[got["i"].to_numpy(int) - first] = got["k"].to_numpy(int)
    return cls


def _steps(m: np.ndarray) -> np.ndarray:
    """P(class | class before), drawn to that of the class alone."""
    size = m.sum(0)
    single = (size + SMOOTH) / (size.sum() + SMOOTH * len(size))
    return (m + BACK * single) / (m.sum(1, keepdims=True) + BACK)


def learn(docs: DataFrame, classes: int = CLASSES, clustered: int = CLUSTERED, near_words: int = NEAR_WORDS) -> Model:
    """A model of all texts of ``docs``; a null text is empty.

    ``clustered`` words have classes found by exchange, which bounds the bigram
    table of words; all others are assigned in ``ROUNDS`` rounds. The ``near_words``
    commonest words travel with the tasks; what stands beside the others (far words)
    is gathered once for all rounds. While words are assigned, far neighbours count as one class."""
    counts = materialize(word_counts(docs))
    said = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    near = frequent(counts, near_words)
    rest, far = min(clustered, len(near)), len(near)
    width = rest + 2
    blocks = coded(docs, [w for w, _ in near])

    def pairs_of(x: np.ndarray) -> np.ndarray:
        x = np.where(x < 0, rest + 1, np.minimum(x, rest)).astype(np.int64)
        return x[:-1] * width + x[1:]

    pairs = dense(cell_counts(blocks, pairs_of, width * width, 1 << 15), width * width, 1 << 15).reshape(width, width)
    cls = exchange(pairs, classes)
    one = np.eye(classes + 2)[cls]
    m, ends = one.T @ pairs @ one, int(pairs[-1].sum())
    kinds, end = classes + 2, classes + 1
    own = np.append(np.full(far + 1, classes), end)
    own[:rest] = cls[:rest]
    found = contexts(blocks, far)
    beside_near, _ = near_counts(blocks, own, kinds, rest)
    for i in range(ROUNDS):
        before, step, size = own, np.log10(_steps(m)), m.sum(0)
        own = own.copy()
        own[rest:far] = near_classes(beside_near, far, rest, step, size)
        beside_near, m = near_counts(blocks, own, kinds, rest if i < ROUNDS - 1 else far)
        m = m + beside(found, far, before, step, size, own)
    known = assign(found, far, before, step, size)
    total, distinct = int(said["n"]) + ends, int(said["v"]) + (ends > 0)
    # A word never met is as likely as in the base model, whatever comes before it.
    step, new = _steps(m), SMOOTH / (total + SMOOTH * (distinct + 2))
    step[:, classes] = 0
    step *= (1 - new) / step.sum(1, keepdims=True)
    step[:, classes] = new
    return Model(near, np.append(own[:-2], [classes, end]), np.log10(step), m.sum(0), total, distinct, ends, known)


_SCORED = "n_tokens long, n_known long, base_score double, score double, far array<binary>, places array<long>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score, log10 probabilities of the whole text, in place of the text (columns of these names are replaced).

    ``base_score`` is that of a smoothed unigram model. Words that don't travel with
    the tasks are looked up by a join on the word, in which no word is common; every
    row is kept, repeated ones too."""
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    near, kinds = model.near, len(model.step)
    rest, end = kinds - 2, kinds - 1
    n_end, step = model.ends, model.step
    base_low = model.total + SMOOTH * (model.distinct + 1)
    c = np.array([n for _, n in near], float)
    cls = np.append(model.cls[:-2], rest)
    size = np.log10(np.maximum(model.size, 1))
    base = np.append(np.log10(c + SMOOTH) - np.log10(base_low), 0.0)  # words beyond the near ones: added after the join
    emit = np.append(np.log10(c) - size[model.cls[:-2]], 0.0)
    base_end = float(np.log10(n_end + SMOOTH) - np.log10(base_low))
    words = [w for w, _ in near]

    of_number = np.append(cls[:-1], -1)  # words beyond the near ones: not known before the join
    kinds1 = kinds + 1

    def told(held: list[np.ndarray], met: list[bytes]) -> pa.StructArray:
        """What several texts are told by, each given by its words' numbers and -1 at its end."""
        far, texts = len(words), len(held)
        size = np.array([len(x) for x in held])
        row = np.repeat(np.arange(texts), size)
        x = np.concatenate([np.full(1, -1), *held])
        k = np.where(x < 0, end, of_number[np.minimum(x, far)])
        p, q, this = k[:-1], k[1:], x[1:]
        both, word = (p >= 0) & (q >= 0), this >= 0
        total = np.bincount(row[both], step[p[both], q[both]], texts) + np.bincount(row[word], emit[np.minimum(this[word], far)], texts).astype(float)
        plain = np.bincount(row[word], base[np.minimum(this[word], far)], texts) + base_end
        at = np.flatnonzero(this >= far)
        many = max(1, len(met))
        # Each text's far words, and for each of their places the word's number among them, the class before and the class after, both + 1.
        w, j = np.unique(row[at] * many + this[at] - far, return_inverse=True)
        j -= np.searchsorted(w, row[at] * many)
        one = _lists(w // many, texts, pa.array(met, pa.binary()).take(pa.array(w % many)))
        two = _lists(row[at], texts, pa.array((j * kinds1 + k[at] + 1) * kinds1 + k[at + 2] + 1))
        known = size - 1 - np.bincount(row[at], minlength=texts) + (n_end > 0)
        fields = {"n_tokens": pa.array(size), "n_known": pa.array(known), "base_score": pa.array(plain), "score": pa.array(total), "far": one, "places": two}
        return pa.StructArray.from_arrays(list(fields.values()), list(fields))

    @F.arrow_udf(_SCORED)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number = Numbers(zip(words, range(len(words)), strict=True))
        for texts in batches:
            held, size = [], 0
            for text in texts:
                t = tokens(text.as_py())
                held.append(np.append(np.fromiter(map(number.__getitem__, t), np.int64, len(t)), -1))
                size += len(t) + 1
                if size >= FLUSH:
                    yield told(held, number.forget(len(words)))
                    held, size = [], 0
            if held:
                yield told(held, number.forget(len(words)))

    @F.arrow_udf("known long, logs double, more double")
    def rest_of(places: pa.Array, many: pa.Array, found: pa.Array) -> pa.Array:
        """What far words add, from their places and the number, count and class of those the model has."""
        texts = len(places)
        start = np.append(0, np.cumsum(many.to_numpy(zero_copy_only=False)))
        n, kind = np.zeros(start[-1]), np.full(start[-1], rest)
        x = found.flatten()
        at = start[found.value_parent_indices().to_numpy()] + x.field("j").to_numpy()
        n[at], kind[at] = x.field("c").to_numpy(), x.field("k").to_numpy()
        row, code = places.value_parent_indices().to_numpy(), places.flatten().to_numpy()
        at, a, b = start[row] + code // kinds1**2, code // kinds1 % kinds1 - 1, code % kinds1 - 1
        c, k = n[at], kind[at]
        # Where the class after is not known, the next place is that of the next far word.
        b = np.where(b < 0, np.append(k[1:], 0), b)
        more = np.where(c > 0, np.log10(np.maximum(c, 1)) - size[k], 0.0) + np.where(a < 0, 0.0, step[a, k]) + step[k, b]
        sums = [np.bincount(row[c > 0], minlength=texts), np.bincount(row, np.log10(c + SMOOTH) - np.log10(base_low), texts).astype(float), np.bincount(row, more, texts).astype(float)]
        return pa.StructArray.from_arrays([pa.array(y) for y in sums], ["known", "logs", "more"])

    row = F.monotonically_increasing_id()
    part = materialize(docs.select(box(docs, "text"), row.alias("_row"), of("text").alias("_x")))
    # Only words that are not near meet the table of counts and classes.
    names = part.select("_row", F.posexplode("_x.far").alias("j", "w"))
    found = meet(names, model.counts.select("w", F.col("n").alias("c"), "k"), "w", unique=True)
    found = spread(found, "_row").groupBy("_row").agg(F.collect_list(F.struct("j", "c", "k")).alias("f"))
    part = part.select("doc", "_row", *[F.col("_x")[x].alias(f"_{x}") for x in ("n_tokens", "n_known", "base_score", "score", "places")], F.size("_x.far").alias("_many"))
    out = meet(part, found, "_row", "left", unique=True)
    out = out.withColumn("_f", rest_of("_places", "_many", F.coalesce("f", F.array().cast("array<struct<j: int, c: long, k: int>>"))))
    return out.select(
        *unbox(docs, "text"), F.col("_n_tokens").alias("n_tokens"), (F.col("_n_known") + F.col("_f.known")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("_base_score") + F.col("_f.logs")).alias("base_score"), (F.col("_score") + F.col("_f.more")).alias("score"))


@query("op6_class_lm")
def op6_class_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 10) == 0
    model = learn(docs.where(~held))
    return score(docs.withColumn("held_out", held), model)
