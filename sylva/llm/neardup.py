"""Near-duplicates by DartMinHash signatures and banded joining.

Every element of a weighted set has a board of its own: weight along one side,
rank along the other. Board cells hold hashed darts, as many as a Poisson draw for
the cell's area says; number, places and the coordinate a dart counts for come from
the element's and cell's hash alone. A set throws the darts that lie under its
elements' weights and keeps, for each coordinate, the one of least rank. Two sets
agree in a coordinate with probability equal to their weighted Jaccard similarity.
Only as much of the ranks is thrown as fills all coordinates, so a signature of k
coordinates takes about k log k darts besides one look at each element.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from math import exp, factorial, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import U, box, mix, query, shingles, table, unbox
from sylva.operators.graph import connected_components
from sylva.session import materialize

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6
#: Four standard deviations of the estimate at the threshold: what lies further below isn't compared.
PLAUSIBLE = 0.7
BLOCK = 1024
BLOCK_SIZE = 1 << 23  # characters
_STEPS = [0.0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0]
_MANY = 1 << 18


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(float) / float(1 << 53)


def _slab(s: int) -> tuple[float, float]:
    """Ranks from, to of the s-th slab: doubling up to 1, then of height 1."""
    return (_STEPS[s], _STEPS[s + 1]) if s < 5 else (s - 4.0, s - 3.0)


def _poisson(height: float) -> np.ndarray:
    return np.cumsum([exp(-height) * height**i / factorial(i) for i in range(24)])


#: By slab; all from the last on are of height 1.
_DRAWS = [_poisson(_slab(s)[1] - _slab(s)[0]) for s in range(6)]


def darts(elements: np.ndarray, weights: np.ndarray, slabs: range, k: int):
    """(rank, coordinate, name) of the darts in some slabs that lie under the elements' weights."""
    whole = np.ceil(weights).astype(int)
    cell_of = np.repeat(np.arange(len(elements)), whole)
    level = np.arange(len(cell_of)) - np.repeat(np.cumsum(whole) - whole, whole)
    s = np.arange(slabs.start, slabs.stop)
    with np.errstate(over="ignore"):
        place = (level.astype(U) << U(20))[None, :] + (s + 1).astype(U)[:, None]
        cell = mix(elements[cell_of][None, :] + U(0x9E3779B97F4A7C15) * place)
        u = _unit(cell)
        n = np.zeros(cell.shape, int)
        own = min(max(0, 5 - slabs.start), len(s))  # slabs with a draw of their own
        for i in range(own):
            n[i] = np.searchsorted(_DRAWS[s[i]], u[i], side="right")
        n[own:] = np.searchsorted(_DRAWS[5], u[own:], side="right")
        n = n.ravel()
        at = np.repeat(np.arange(len(n)), n)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        name = mix(cell.ravel()[at] + U(0xD1342543DE82EF95) * (turn.astype(U) + U(1)))
        low = np.array([_slab(x)[0] for x in s])[at // len(cell_of)]
        tall = np.array([_slab(x)[1] - _slab(x)[0] for x in s])[at // len(cell_of)]
        rank = low + tall * _unit(mix(name + U(1)))
        at %= len(cell_of)
        coordinate = (mix(name + U(3)) % U(k)).astype(int)
        if whole.max() == 1 and (weights == 1).all():
            return rank, coordinate, name
        height = level[at] + _unit(mix(name + U(2)))
    under = height < weights[cell_of[at]]
    return rank[under], coordinate[under], name[under]


def signature(elements: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """The names of the earliest darts, k of them; no elements: none.

    ``elements``: distinct 64-bit hashes; ``weights``: positive, about 1 each for
    speed; none: all 1."""
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, float)
    elements, weights = elements[weights > 0], weights[weights > 0]
    out = np.zeros(k, U)
    if not len(elements):
        return out[:0]
    best = np.full(k, np.inf)
    enough, done = k * (log(k) + 1) / weights.sum(), 0
    # So many slabs as will likely fill all coordinates, then twice as many, and so on; ranks only grow.
    more = 1
    while _slab(more)[0] < enough:
        more += 1
    while True:
        for start in range(done, done + more, step := max(1, _MANY // len(elements))):
            rank, coordinate, name = darts(elements, weights, range(start, min(start + step, done + more)), k)
            order = np.argsort(-rank)
            c, r = coordinate[order], rank[order]
            new, got = np.full(k, np.inf), np.zeros(k, U)
            new[c], got[c] = r, name[order]  # the last to be put is the least
            better = new < best
            best[better], out[better] = new[better], got[better]
        done += more
        if np.isfinite(best).all():
            return out
        more = max(1, done // 2)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays without repeats; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 1.0


ROW = "key binary, sig binary, bands array<long>"


def _sign(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """(doc_id, k1, k2, key, sig, bands) of every row.

    ``k1, k2`` name the row by id and text; ``key`` names its shingle set, or its
    text if that has no word; ``sig``: 16 bits of each coordinate; ``bands``: a
    hash of each band's whole coordinates, none without words."""
    k = bands * rows

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            keys, sigs, found = [], [], []
            for text in texts:
                h = np.unique(shingles(text, width))
                s = signature(h, None, k)
                keys.append(blake2b(h.tobytes() if len(h) else b"text" + (text or "").encode("utf-8", "replace"), digest_size=16).digest())
                sigs.append((s & U(0xFFFF)).astype("<u2").tobytes())
                with np.errstate(over="ignore"):
                    b = np.arange(bands if len(s) else 0).astype(U)
                    for j in range(rows if len(s) else 0):
                        b = mix(b * U(31) + s[j::rows])
                found.append(b.astype(np.int64))
            yield pd.DataFrame({"key": keys, "sig": sigs, "bands": found})

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_names(docs), F.pandas_udf(of, ROW)("text").alias("x"))
    return named.select("doc_id", "k1", "k2", "x.*")


def _names(docs: DataFrame) -> list:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.col("doc_id"), F.lit("k2")).alias("k2")]


def _plausible(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Those of (a, b) whose signatures agree in ``least`` of the coordinates."""

    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float((np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2")).mean()) for x, y in zip(a, b, strict=True)], dtype=float)

    own = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    other = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    both = pairs.join(other, "b").join(own, "a")
    return both.where(F.pandas_udf(agree, "double")("sig_a", "sig_b") >= least).select("a", "b")


def _texts(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text) of each ``rep`` of ``wanted``."""
    named = docs.select("text", *_names(docs))
    texts = named.join(reps.join(wanted, "rep").select("rep", "k1", "k2"), ["k1", "k2"])
    # A row of the same id and text may be there more than once.
    return texts.groupBy("rep").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of (a, b) whose shingle sets have that Jaccard similarity, exactly; written."""

    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        last, out = (None, None), []
        for x, y in zip(a, b, strict=True):
            if last[0] != x:
                last = (x, np.unique(shingles(x, width)))
            out.append(jaccard(last[1], np.unique(shingles(y, width))))
        return pd.Series(out, dtype=float)

    texts = materialize(_texts(docs, reps, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()))
    own = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(other, "b").join(own, "a")
    return materialize(both.where(F.pandas_udf(similar, "double")("text_a", "text_b") >= similarity).select("a", "b"))


def _labels(links: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """(rep, comp) of every linked text; with ``label``, that of the links before, only its components are joined by new ``links``."""
    if label is not None:
        for side in ("a", "b"):
            known = label.select(F.col("rep").alias(side), F.col("comp").alias("comp"))
            links = links.join(known, side, "left").withColumn(side, F.coalesce("comp", side)).drop("comp")
    found = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    found = found.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    if label is not None:
        found = materialize(found)
        # A component is named by its least text, so what is joined keeps that.
        moved = label.join(found.select(F.col("rep").alias("comp"), F.col("comp").alias("now")), "comp", "left").select("rep", F.coalesce("now", "comp").alias("comp"))
        found = moved.unionByName(found.join(label.select("rep"), "rep", "left_anti"))
    return materialize(found)


def _by_blocks(members: DataFrame, block: int) -> DataFrame:
    """(b, i, j, own, rep, comp): each of (b, rep, comp, n) once for every pair i, j of blocks of its b that holds its ``own``.

    A group of n is dealt into blocks of about ``block``."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = members.withColumns({"m": blocks, "own": own}).select(
        "b", "rep", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    return dealt.select("b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "comp")


def _forest(group: list[tuple], label: np.ndarray, alike: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what is alike in a pair of blocks, fewer than it has rows.

    A row is compared with those that have another ``label``, which is changed;
    each pair of rows is looked at once: within a block by place, else from block i to
    block j. ``alike``: which of some rows are like one."""
    rep, own = np.array([r[4] for r in group]), np.array([r[3] for r in group])
    comp, (i, j) = np.array([r[5] for r in group]), group[0][1:3]
    out = []
    for x in range(len(group)):
        at = np.arange(x + 1, len(group)) if i == j else np.flatnonzero(own == j) if own[x] == i else np.zeros(0, int)
        at = at[(label[at] != label[x]) & (comp[at] != comp[x])]
        if len(at):
            at = at[alike(x, at)]
            tree, first = np.unique(label[at], return_index=True)
            out += [(min(rep[x], rep[y]), max(rep[x], rep[y])) for y in at[first]]
            label[np.isin(label, tree)] = label[x]
    return out


def _walked(ordered: DataFrame, compare: Callable[[list[tuple]], list[tuple[int, int]]]) -> DataFrame:
    """(a, b): what ``compare`` finds in each run of rows with the same (b, i, j)."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False, name=None):
                if group and row[:3] != group[0][:3]:
                    found += compare(group)
                    group = []
                group.append(row)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        if group:
            yield pd.DataFrame(compare(group), columns=["a", "b"], dtype="int64")

    ordered = ordered.select(F.xxhash64("b", "i", "j").alias("g"), "*").repartition("g").sortWithinPartitions("b", "i", "j")
    return ordered.drop("g").mapInPandas(walk, "a long, b long").distinct()


def _agree(group: list[tuple], at: int, least: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whose signatures, in column ``at``, agree in ``least`` of the coordinates."""
    sig = np.stack([np.frombuffer(r[at], "<u2") for r in group])
    return lambda x, rows: (sig[rows] == sig[x]).mean(1) >= least


def _within(members: DataFrame, reps: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b) of different components and plausible signatures that hold together all such pairs within each bucket of (b, rep, comp, n).

    Each pair of blocks is compared by one task; a task holds two blocks and tells
    fewer pairs than it has rows: a forest of what is plausible there."""

    def compare(group: list[tuple]) -> list[tuple[int, int]]:
        if len({r[5] for r in group}) == 1:
            return []
        return _forest(group, np.arange(len(group)), _agree(group, 6, least))

    return _walked(_by_blocks(members, block).join(reps.select("rep", "sig"), "rep").select("b", "i", "j", "own", "rep", "comp", "sig"), compare)


def _settled(pairs: DataFrame, label: DataFrame, docs: DataFrame, reps: DataFrame, least: float, width: int, similarity: float, block: int = BLOCK, size: int = BLOCK_SIZE) -> DataFrame:
    """Links between components among texts that ``pairs`` hold together: the components that they join are those that all links there join; written.

    Texts go along with their blocks, of about ``block`` texts or ``size`` characters,
    and are compared in the task: plausible pairs exactly, and none whose components
    the task has joined. So the pairs of a group are never rows."""
    group = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    group = materialize(group.select(F.col("node").alias("rep"), F.col("component").alias("b")))
    texts = materialize(_texts(docs, reps, group.select("rep")).withColumn("text", F.coalesce("text", F.lit(""))))
    sizes = group.join(texts, "rep").groupBy("b").agg(F.greatest(F.count(F.lit(1)), F.ceil(F.sum(F.length("text")) * block / size)).alias("n"))
    members = group.join(sizes, "b").join(label, "rep", "left").select("b", "rep", F.coalesce("comp", "rep").alias("comp"), "n")

    def compare(group: list[tuple]) -> list[tuple[int, int]]:
        label = np.unique([r[5] for r in group], return_inverse=True)[1]
        if not label.any():
            return []
        plausible = _agree(group, 6, least)
        sets = [np.unique(shingles(r[7], width)) for r in group]
        long = np.array([len(h) for h in sets])
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        sets = np.split(flat, np.cumsum(long)[:-1])
        has = np.zeros(len(names), bool)

        def similar(x: int, rows: np.ndarray) -> np.ndarray:
            out = plausible(x, rows)
            near = rows[out]
            if len(near):
                has[sets[x]] = True
                both = np.array([np.count_nonzero(has[sets[y]]) for y in near])
                has[sets[x]] = False
                out[out] = both / (long[x] + long[near] - both) >= similarity
            return out

        return _forest(group, label, similar)

    full = _by_blocks(members, block).join(reps.select("rep", "sig"), "rep").join(texts, "rep")
    return materialize(_walked(full.select("b", "i", "j", "own", "rep", "comp", "sig", "text"), compare))


def classes(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, plausible: float = PLAUSIBLE) -> DataFrame:
    """(doc_id, k1, k2, class_id, keep) for every row of ``docs``.

    Two texts are linked if the Jaccard similarity of their sets of ``width``-word
    shingles is ``similarity`` or more; a class is a component of links. Equal sets
    are one text from the start. A text of fewer words is one shingle; texts without
    words (a null one is empty) are alike only if equal. ``class_id``: the least
    doc_id of the class, or a negative number if none has one. ``keep``: on the rows
    of one (doc_id, text) in each class.

    A bucket's least text is its hub. A text is first compared with the hub it shares
    most bands with, then with hubs that are still in other components, so a large
    group becomes one component without its pairs. Buckets of three or more
    that then still hold several components have all pairs across these compared by
    signature, in blocks; no bucket is capped. A block tells only a forest of what is
    plausible. The texts that these forests hold together meet in blocks again, where
    plausible pairs between components are verified on the whole texts. A pair at the threshold meets in no band with probability
    (1 - 0.8**6)**40 < 1e-5."""
    table_ = materialize(_sign(docs, bands, rows, width))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("r")
    texts = table_.groupBy("key").agg(least, F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = materialize(texts.select(F.monotonically_increasing_id().alias("rep"), "key", "r.doc_id", "r.k1", "r.k2", "sig", "bands"))
    each = reps.select("rep", F.explode("bands").alias("b"))
    buckets = materialize(each.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("hub")).where("n > 1"))
    members = materialize(each.join(buckets, "b"))
    # First each text against the one hub it shares most bands with: most of a group is then one component.
    shared = members.where("rep <> hub").groupBy("hub", "rep").agg(F.count(F.lit(1)).alias("n"))
    nearest = shared.groupBy("rep").agg(F.max(F.struct("n", (-F.col("hub")).alias("o"))).alias("m"))
    once = materialize(nearest.select((-F.col("m.o")).alias("a"), F.col("rep").alias("b")))
    label = _labels(_verified(materialize(_plausible(once, reps, plausible)), docs, reps, width, similarity))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(label, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    # Then against the hubs of other components.
    of_hub = placed(members.where("rep = hub")).select("b", F.col("comp").alias("of_hub"))
    other = placed(members.where("rep <> hub")).join(of_hub, "b").where("comp <> of_hub")
    again = materialize(other.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct().join(once, ["a", "b"], "left_anti"))
    label = _labels(_verified(materialize(_plausible(again, reps, plausible)), docs, reps, width, similarity), label)
    # Last within buckets: what holds plausible pairs between components together, then these exactly.
    open_ = placed(members.where("n > 2"))
    mixed = open_.groupBy("b").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("b")
    rest = materialize(_within(open_.join(mixed, "b", "left_semi"), reps, plausible))
    label = _labels(_settled(rest, label, docs, reps, plausible, width, similarity), label)
    named = reps.join(label, "rep", "left").select("key", "doc_id", "k1", "k2", F.coalesce("comp", "rep").alias("comp"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("r")
    heads = materialize(named.groupBy("comp").agg(best).select("comp", F.coalesce(F.col("r.doc_id"), -1 - F.col("comp")).alias("class_id"), F.col("r.k1").alias("h1"), F.col("r.k2").alias("h2")))
    places = materialize(named.select("key", "comp").join(heads, "comp").select("key", "class_id", "h1", "h2"))
    out = table_.select("doc_id", "k1", "k2", "key").join(places, "key")
    return out.select("doc_id", "k1", "k2", "class_id", ((F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))).alias("keep"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each class; see ``classes``."""
    kept = materialize(classes(docs, **how).where("keep").select("k1", "k2").distinct())
    one = docs.select(box(docs), *_names(docs)).join(kept, ["k1", "k2"], "left_semi")
    return one.dropDuplicates(["k1", "k2"]).select(*unbox(docs))


@query("op10_near_duplicates")
def op10_near_duplicates(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")
