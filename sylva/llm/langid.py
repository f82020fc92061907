"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts. In a context that
occurred n times and was followed by q different bytes, a byte that followed it c
times has probability c / (n + q); the escape, q / (n + q), is shared out among
the other bytes in proportion to what the next shorter context gives them, and
below the empty context evenly. So every context has a proper distribution, and
minus its logarithm is an exact code length. The statistics are frozen: the
contexts of all languages make one automaton whose state is the longest known
context, and a text is scored by walking it once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.common import query, remainder, table
from sylva.session import materialize

ORDER = 4
STATES = 2048
SAMPLE_DOCS = 1000
LEAST_CONTEXT = 16
STEP = 256
UNKNOWN = "und"
PREDICTED = "lang_pred string, score double, bits_per_byte double"


@dataclass
class Model:
    """``step[s, b]``: the next state; ``bits[s, b]``: code length of byte b in state s; ``first``: each language's first state."""

    langs: list[str]
    first: np.ndarray
    step: np.ndarray
    bits: np.ndarray


def _grams(texts, lang_codes, order: int, n_langs: int):
    """(language, context length, context and next byte as one number, count) in these texts."""
    out = []
    for lang in range(n_langs):
        own = [t.encode("utf-8", "replace") for t, k in zip(texts, lang_codes, strict=True) if k == lang]
        for k in range(order + 1):
            # Texts are put apart so that no context reaches from one into another.
            codes = []
            for b in own:
                x = np.frombuffer(b, np.uint8).astype(np.int64)
                if len(x) > k:
                    code = np.zeros(len(x) - k, np.int64)
                    for j in range(k + 1):
                        code = code * 256 + x[j : len(x) - k + j]
                    codes.append(code)
            if codes:
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                out.append(pd.DataFrame({"lang_no": lang, "k": k, "code": code, "n": n}))
    return pd.concat(out) if out else None


def learn(docs: DataFrame, order: int = ORDER, states: int = STATES, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from rows with text and lang.

    It is fitted on a sample: of each language, those rows whose id hash falls
    under ``sample_docs`` divided by the language's row count, so about
    ``sample_docs`` whole texts or all there are. A language's contexts that it met
    less than ``LEAST_CONTEXT`` times are dropped, and its ``states`` most frequent
    ones are kept, which bounds the model at 2 kB a context, however many texts the
    other languages have. Without any row the model knows no language."""
    rows = docs.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    langs = [r["lang"] for r in sizes]
    if not langs:
        return Model([], np.zeros(0, np.int32), np.zeros((0, 256), np.int32), np.zeros((0, 256), np.float32))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_docs / r["count"]))])
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    draw = F.pmod(F.xxhash64(F.lit("ppm"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < share[F.col("lang")]).select("text", number[F.col("lang")].alias("lang_no"))
    n_langs = len(langs)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = _grams(batch["text"], batch["lang_no"], order, n_langs)
            if got is not None:
                yield got

    grams = sample.mapInPandas(count, "lang_no int, k int, code long, n long").groupBy("lang_no", "k", "code").agg(F.sum("n").alias("n"))
    context = F.shiftright("code", 8)
    grams = materialize(grams.withColumn("context", context))
    best = grams.groupBy("lang_no", "k", "context").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST_CONTEXT) | (F.col("k") == 0))
    place = F.row_number().over(Window.partitionBy("lang_no").orderBy(F.desc("n"), "k", "context"))
    kept = best.withColumn("place", place).where(F.col("place") <= states)  # the model's size, not a cap on data
    own = ["lang_no", "k", "context"]
    rows = grams.join(F.broadcast(kept.select(*own)), own).select(*own, "code", "n").toPandas()
    trees = [_tree(rows[rows["lang_no"] == i]) for i in range(n_langs)]
    first = np.cumsum([0, *[len(step) for step, _ in trees]])[:-1].astype(np.int32)
    step = np.concatenate([step + at for (step, _), at in zip(trees, first, strict=True)])
    return Model(langs, first, step, np.concatenate([bits for _, bits in trees]))


def _tree(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Next states and code lengths of one language, from its counts of contexts and next bytes."""
    contexts = sorted({(int(k), int(c)) for k, c in zip(rows["k"], rows["context"], strict=True)} | {(0, 0)})
    place = {x: i for i, x in enumerate(contexts)}

    def shorter(k: int, c: int) -> int:
        """The longest known proper suffix of a context."""
        while k > 0:
            k -= 1
            c &= (1 << 8 * k) - 1
            if (k, c) in place:
                return place[k, c]
        return 0

    size = len(contexts)
    step = np.zeros((size, 256), np.int32)
    up = [shorter(k, c) for k, c in contexts]
    top = max(k for k, _ in contexts)
    for i, (k, c) in enumerate(contexts):
        for b in range(256):
            kk, cc = k + 1, c * 256 + b
            if kk > top:
                kk, cc = top, cc & ((1 << 8 * top) - 1)
            step[i, b] = place[kk, cc] if (kk, cc) in place else shorter(kk, cc)
    p, seen = np.zeros((size, 256)), np.zeros((size, 256))
    at = np.array([place[int(k), int(c)] for k, c in zip(rows["k"], rows["context"], strict=True)], int)
    np.add.at(seen, (at, rows["code"].to_numpy(np.int64) & 255), rows["n"].to_numpy(float))
    for i, (k, _) in enumerate(contexts):  # shorter contexts come first
        below = p[up[i]] if k else np.full(256, 1 / 256)
        n, q = seen[i].sum(), (seen[i] > 0).sum()
        free = np.where(seen[i] > 0, 0.0, below)
        rest = free.sum()
        # Where all bytes have followed, or nothing is known, nothing or all is shared out.
        escape = 1.0 if n == 0 else q / (n + q) if rest > 0 else 0.0
        own = seen[i] / max(n + q if rest > 0 else n, 1)
        p[i] = own + free * (escape / max(rest, 1e-300))
    return step, (-np.log2(p)).astype(np.float32)


def code_lengths(model: Model, texts: list[str], step_bytes: int = STEP) -> np.ndarray:
    """Bits of each text under each language.

    Texts are cut into pieces that are walked side by side. A piece begins its
    walk as many bytes early as the longest context has, by when the state no
    longer depends on where the walk began, so the cut changes nothing."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    out = np.zeros((len(raw), len(model.langs)))
    early = 8
    starts, owners, joined = [], [], b"".join(raw)
    base = 0
    for i, b in enumerate(raw):
        cuts = np.arange(0, len(b), step_bytes)
        starts.append(cuts + base)
        owners.append(np.full(len(cuts), i))
        base += len(b)
    if not base:
        return out
    start, owner = np.concatenate(starts), np.concatenate(owners)
    lengths = np.array([len(b) for b in raw])
    begin = np.cumsum(lengths) - lengths
    end = np.minimum(start + step_bytes, (begin + lengths)[owner])
    begin = begin[owner]
    data = np.frombuffer(joined, np.uint8)
    state = np.tile(model.first, (len(start), 1))
    total = np.zeros((len(start), len(model.langs)))
    place = start - early
    flat_step, flat_bits = model.step.reshape(-1), model.bits.reshape(-1)
    for t in range(early + step_bytes):
        live = (place >= begin) & (place < end)
        at = np.flatnonzero(live)
        if len(at):
            cell = state[at].astype(np.int64) * 256 + data[place[at], None]
            if t >= early:
                total[at] += flat_bits[cell]
            state[at] = flat_step[cell]
        place = place + 1
    np.add.at(out, owner, total)
    return out


def _letters(texts: pd.Series) -> np.ndarray:
    return np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte (columns of these names are replaced).

    The language with the shortest code, ties to the earlier name; the score is
    its posterior under even odds. ``und``, 0 and no bits for a null text, one
    without a letter, or a model without languages. Only the text is looked at."""
    docs = docs.drop("lang_pred", "score", "bits_per_byte")
    return _scored(docs, model).select(*docs.columns, f"{_OWN}.*")


_OWN = "_lang_of_text"


def _scored(docs: DataFrame, model: Model) -> DataFrame:

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "bits_per_byte": np.nan}, index=range(len(texts)))
            known = np.flatnonzero(_letters(texts)) if model.langs else []
            # Some texts at a time, so that a batch of long ones stays small.
            for part in _parts([texts.iloc[i] for i in known]):
                own = known[part]
                bits = code_lengths(model, [texts.iloc[i] for i in own])
                best = bits.argmin(1)
                low = bits[np.arange(len(own)), best]
                out.loc[own, "lang_pred"] = np.array(model.langs, object)[best]
                out.loc[own, "score"] = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
                out.loc[own, "bits_per_byte"] = low / [len(texts.iloc[i].encode("utf-8", "replace")) for i in own]
            yield out

    return docs.withColumn(_OWN, F.pandas_udf(of, PREDICTED)(F.col("text")))


def _parts(texts: list[str], most: int = 2_000_000) -> Iterator[slice]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0


def learn_rows(docs: DataFrame, m: int = 4, held: int = 2) -> DataFrame:
    return docs.where(remainder(F.col("doc_id"), m) != held)


def keep_known(docs: DataFrame, model: Model, least_score: float = 0.5, most_bits: float = 8.0) -> DataFrame:
    """Rejects what is in no known language: ``und``, an undecided score, or a best code that isn't shorter than the bytes themselves."""
    x = _scored(docs, model)
    known = (x[_OWN]["lang_pred"] != UNKNOWN) & (x[_OWN]["score"] >= least_score) & (x[_OWN]["bits_per_byte"] < most_bits)
    return x.where(known).select(*docs.columns)


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(learn_rows(docs))
    held = (remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")
