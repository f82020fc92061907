"""Toxicity of texts whose words may be disguised.

A disguised token is the output of a noisy channel: letters written as digits or
signs, letters repeated, letters set apart. Its readings make a character
lattice, and the Viterbi path under a character trigram model, learned from the
corpus, is the restored token. Tokens without a sign of disguise have a lattice of
one path and stay as they are; where the sign is weak (a separator, a doubled letter,
a sign at an end), the token stays beside its readings. The restored text is scored by a logistic model of
its words and word beginnings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import query, remainder, table
from sylva.session import materialize

SAMPLE_ROWS = 20_000
FEATURES = 1500
LEAST_DOCS = 7
LETTERS = 96
THRESHOLD = 0.7
MEMO = 400_000
FLUSH = 250_000

# What a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
APART = frozenset(".-_*~'/ ")
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"([^\W\d_])\1\1")
# A letter, other marks, the first sign, marks and digits, a letter; runs are not given back, so a search is linear.
_INNER = re.compile(r"[^\W\d_][^\w\s@$!|+(€£]*+[0-9@$!|+(€£](?:[^\w\s]|[0-9])*+[^\W\d_]|^[0-9@$|€£][^\W\d_]{2}|[^\W\d_]{2}[0-9@$|€£]$")
_SPELLED = re.compile(r"[^\W_](?:[.\-_*~'/]+[^\W_]){2,}")
_DOUBLE = re.compile(r"([^\W\d_]|[0-9@$!|+(€£])\1")
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$|")
_OUTER = "".join(c for c in _EDGE if c not in SIGNS)
SIGN_COST, DROP_COST, APART_COST, KEEP_COST, EDGE_COST = -1.0, -0.7, -0.5, -4.0, -2.0


def trigrams(words: Counter) -> Counter:
    """Counts of three letters in a row; blanks stand for the edges of a word, two of them before it."""
    if not words:
        return Counter()
    letter = np.frombuffer("".join(f"  {w} " for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    word = np.repeat(np.arange(len(words)), [len(w) + 3 for w in words])
    at = np.flatnonzero(word[:-2] == word[2:])
    key, place = np.unique(letter[at] << 42 | letter[at + 1] << 21 | letter[at + 2], return_inverse=True)
    n = np.bincount(place, np.array(list(words.values()), float)[word[at]])
    return Counter({chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF): int(m) for k, m in zip(key.tolist(), n, strict=True)})


def _numbers(letters: list[str]) -> dict[str, int]:
    """Numbers from 2 on; 0 is the edge of a word, 1 any other sign."""
    return {" ": 0} | {c: i + 2 for i, c in enumerate(sorted(letters))}


@dataclass
class Letters:
    """log P(letter | two before); 0 is the edge of a word, 1 any other sign."""

    number: dict[str, int]
    logp: np.ndarray

    @classmethod
    def fit(cls, counts: Counter, most: int = LETTERS) -> Letters:
        """``counts`` of words. Letters beyond the ``most`` most frequent are other signs."""
        freq: Counter = Counter()
        tri = trigrams(counts)
        for g, n in tri.items():
            freq[g[2]] += n
        del freq[" "]
        number = _numbers(sorted(freq, key=lambda c: (-freq[c], c))[:most])
        cells = np.zeros([len(number) + 1] * 3)
        for (p, q, r), n in tri.items():
            cells[number.get(p, 1), number.get(q, 1), number.get(r, 1)] += n
        return cls.of_cells(number, cells)

    @classmethod
    def of_cells(cls, number: dict[str, int], tri: np.ndarray) -> Letters:
        """``tri[p, q, r]``: how often letter r follows p and q, by numbers."""
        a = len(tri)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 0.5) / (uni.sum() + 0.5 * a)
        p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
        return cls({c: i for c, i in number.items() if i}, np.log(p3))

    def decode(self, seen: str, doubled: bool = False) -> str:
        """The likeliest reading of a disguised string; words in it are set apart by spaces.

        Signs at its ends that are common punctuation may be dropped; with ``doubled``,
        repeated characters may not."""
        logp, number = self.logp, self.number
        first = len(seen) - len(seen.lstrip(_EDGE))
        last = len(seen.rstrip(_EDGE))
        # The best way to each pair of last letters, with its characters as a chain; the pairs are few, since a sign has two letters at most.
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i, c in enumerate(seen):
            if c in APART:
                ways = [("", APART_COST), (" ", APART_COST)]
            elif c in SIGNS:
                ways = [(x, SIGN_COST) for x in SIGNS[c]] + [(c, KEEP_COST)]
            else:
                ways = [(c, 0.0)]
            if c in SIGNS and not first <= i < last:
                ways.append(("", EDGE_COST))
            if i and c == seen[i - 1] and c not in APART and not doubled:
                ways.append(("", DROP_COST))
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (p, q), (score, out) in paths.items():
                for x, cost in ways:
                    if not x:
                        state, s = (p, q), score + cost
                    elif x == " ":
                        state, s = (0, 0), score + cost + logp[p, q, 0]
                    else:
                        r = number.get(x, 1)
                        state, s = (q, r), score + cost + logp[p, q, r]
                    if state not in after or s > after[state][0]:
                        after[state] = (s, (out, x) if x else out)
            paths = after
        chain = max(((s + logp[p, q, 0], (p, q), out) for (p, q), (s, out) in paths.items()), key=lambda e: e[:2])[2]
        read = []
        while chain:
            chain, x = chain
            read.append(x)
        return "".join(reversed(read))


@dataclass
class Restorer:
    """Restores tokens, remembering those met."""

    letters: Letters
    memo: dict[str, str] = field(default_factory=dict)

    def token(self, t: str) -> str:
        got = self.memo.get(t)
        if got is None:
            core = t.strip(_EDGE)
            odd = _INNER.search(core) or _RUN.search(core) or _SPELLED.fullmatch(core)
            got = self.letters.decode(core) if odd else t
            seen = t.strip(_OUTER)
            # Weak signs of disguise: what the token says otherwise stays.
            if sum(c.isalpha() or c in SIGNS for c in seen) > 2 and _WORD.search(seen) and (_DOUBLE.search(seen) or any(c in SIGNS or c in APART for c in seen)):
                said = set(_WORD.findall(got))
                for own in [self.letters.decode(seen)] + [self.letters.decode(seen, True)] * (not odd):
                    if not said.issuperset(_WORD.findall(own)):
                        got += " " + own
                        said.update(_WORD.findall(own))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[t] = got
        return got

    def text(self, text: str) -> list[str]:
        """The restored tokens of a text, with spelled-out words joined."""
        tokens = text.lower().split()
        return [self.token(t) for t in tokens] + spelled(tokens, self.letters)


def spelled(tokens: list[str], letters: Letters) -> list[str]:
    """Readings of runs of three or more tokens of one character each."""
    single = [i for i, t in enumerate(tokens) if len(t) == 1 and (t.isalpha() or t in SIGNS)]
    out = []
    for _, run in groupby(enumerate(single), key=lambda x: x[1] - x[0]):
        run = [i for _, i in run]
        if len(run) >= 3:
            out.append(letters.decode(" ".join(tokens[i] for i in run)))
    return out


def features(restored: str) -> list[str]:
    """Words of a restored token, and the beginnings of longer ones."""
    out = []
    for w in _WORD.findall(restored):
        out.append(w)
        if len(w) > 4:
            out.append(w[:4] + "*")
        if len(w) > 6:
            out.append(w[:6] + "*")
    return out


@dataclass
class Model:
    letters: Letters
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """A function from text to score."""
        restorer = Restorer(self.letters)
        hits: dict[str, list[str] | None] = {}
        weights = self.weights

        def of_token(t: str) -> list[str] | None:
            got = [f for f in features(restorer.token(t)) if f in weights] or None
            if len(hits) >= MEMO:
                hits.clear()
            hits[t] = got
            return got

        def score(text: str | None) -> float:
            tokens = (text or "").lower().split()
            found: set[str] = set()
            for t in set(tokens):
                got = hits[t] if t in hits else of_token(t)
                if got:
                    found.update(got)
            for s in spelled(tokens, self.letters):
                found.update(f for f in features(s) if f in weights)
            z = self.bias + sum(weights[f] for f in sorted(found))
            return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

        return score


def learn_letters(docs: DataFrame, most: int = LETTERS) -> Letters:
    """The letter model of all words of all texts.

    Its counts are made where the texts are; a table of at most (``most`` + 2)**3
    numbers comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            tri = trigrams(words)
            return pa.RecordBatch.from_arrays([pa.array(list(tri), pa.string()), pa.array(list(tri.values()), pa.int64())], ["g", "n"])

        words: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                words.update([w for w in t.as_py().lower().split() if w.isalpha()])
                if len(words) >= FLUSH:
                    yield told()
                    words = Counter()
        yield told()

    found = docs.where("text is not null").select("text").mapInArrow(count, "g string, n long")
    tri = materialize(found.groupBy("g").agg(F.sum("n").alias("n")))
    last = tri.groupBy(F.substring("g", 3, 1).alias("c")).agg(F.sum("n").alias("n")).where("c <> ' '")
    number = _numbers([r["c"] for r in last.orderBy(F.desc("n"), "c").limit(most).collect()])
    code = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    of = [F.coalesce(code[F.substring("g", i, 1)], F.lit(1)).alias(k) for i, k in ((1, "p"), (2, "q"), (3, "r"))]
    cells = np.zeros([len(number) + 1] * 3)
    for r in tri.groupBy(*of).agg(F.sum("n").alias("n")).collect():
        cells[r["p"], r["q"], r["r"]] = r["n"]
    return Letters.of_cells(number, cells)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES) -> Model:
    """A model from documents with a label.

    It is fitted on a sample: labelled rows whose id hash falls under
    ``sample_rows`` divided by their number, so about ``sample_rows`` whole texts
    or all there are; the letter model counts all texts. Of several labels of an id
    the highest counts; null ids and labels teach nothing. Without rows every text
    scores 0.5."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = marked.count()
    draw = F.pmod(F.xxhash64(F.lit("tox"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = marked.where(draw < min(1.0, sample_rows / max(total, 1)))
    # About sample_rows pairs of numbers, whatever the input.
    rows = materialize(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"))

    letters = learn_letters(docs)

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(letters)
        for batch in batches:
            out = [sorted({f for t in set(restorer.text(x)) for f in features(t)}) for x in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"].to_numpy(), "f": out})

    held = materialize(rows.mapInPandas(present, "toxic int, f array<string>").withColumn("row", F.monotonically_increasing_id()))
    base = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, pos = base["n"], base["pos"]
    if not n:
        return Model(letters, {}, 0.0)
    each = held.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("a"))
    expected = F.col("n") * (pos / n)
    gain = F.pow(F.col("a") - expected, F.lit(2)) / F.sqrt(expected + F.lit(1.0))
    best = [r["f"] for r in each.where(F.col("n") >= LEAST_DOCS).orderBy(F.desc(gain), "f").limit(n_features).collect()]
    place = {f: i for i, f in enumerate(best)}

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"].to_numpy(), "i": [[place[f] for f in x if f in place] for x in batch["f"]]})

    data = held.select("toxic", "f").mapInPandas(indexed, "toxic int, i array<int>").toPandas()
    weights, bias = _logistic(data["i"].tolist(), data["toxic"].to_numpy(float), len(best))
    return Model(letters, {f: float(w) for f, w in zip(best, weights, strict=True)}, float(bias))


def _logistic(rows: list, y: np.ndarray, n: int, ridge: float = 3.0, trust: float = 0.12, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features, by Adam.

    A feature counts with its log odds ratio, as far as it is trusted; the ridge
    draws trust to ``trust``. So a word that marks toxic texts keeps its weight also
    where other words of the same texts would do."""
    size = np.array([len(r) for r in rows])
    col = np.concatenate([np.asarray(r, int) for r in rows]) if size.sum() else np.zeros(0, int)
    row = np.repeat(np.arange(len(rows)), size)
    bad, all_ = np.bincount(col, y[row], n), np.bincount(col, minlength=n)
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((all_ - bad + 0.5) / (len(y) - y.sum() + 1))
    w, m, v = np.full(n + 1, trust), np.zeros(n + 1), np.zeros(n + 1)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[n] = np.log(rate / (1 - rate))
    for k in range(1, steps + 1):
        z = w[n] + np.bincount(row, (w[:n] * odds)[col], len(rows))
        d = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.append(np.bincount(col, d[row], n) * odds + ridge * (w[:n] - trust), d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.03 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w[:n] * odds, w[n]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (columns of these names are replaced).

    A null or empty text has the score of no words. Only the text is looked at."""
    docs = docs.drop("score", "predicted")
    return _scored(docs, model, "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    own = "_toxicity_of_text"
    return _scored(docs, model, own).where(F.col(own) < threshold).select(*docs.columns)


def _scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype=float)

    return docs.withColumn(name, F.pandas_udf(of, "double")(F.col("text")))


def learn_rows(docs: DataFrame, m: int = 3, held: int = 1) -> DataFrame:
    return docs.where(remainder(F.col("doc_id"), m) != held)


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = learn(docs, learn_rows(labels))
    held = (remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", "predicted")
