"""Packing of documents into sequences by linear grouping and best fit.

A packing is decided from the histogram of piece lengths alone, which has at most
as many entries as a sequence has tokens. Long lengths, in descending order, are
grouped by equal cardinality and rounded up to their group's largest. For these few
sizes the number of sequences is minimised over configurations by column
generation. Whole multiples of the configurations take actual pieces in place of
the rounded ones; what is left over and the short pieces are then put where they
fit best. All this moves runs of equal pieces and runs of equal sequences, so the
plan is small whatever the corpus. A piece finds its place in the plan by its
length and its rank among pieces of that length.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.common import query, table
from sylva.session import materialize

TOKENS = 1024
GROUPS = 192
#: Lengths above these shares of a sequence are grouped; of the plans the shortest is taken.
LONG = (1 / 4, 2 / 5)
VOCABULARY = "byte_bpe_50k.json"
END = 2
# How byte-level vocabularies write bytes as characters.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_PIECE = "doc_id string, piece int, start long, length long, ids_crc32 long, local_rank long"


def byte_tokenizer(name: str = VOCABULARY):
    """The byte-level vocabulary of a tokenizers JSON file in tiktoken's merge engine, which gives the same ids several times faster.

    ``name``: a path, or the name of an installed public vocabulary. ``encode`` with
    ``allowed_special="all"`` finds added tokens in a text, as tokenizers does by
    default; for ``encode_ordinary`` they are ordinary text."""
    import os

    import public_tokenizers
    import tiktoken

    path = name if os.path.exists(name) else public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    hidden = [b for b in range(256) if b not in _SHOWN]
    byte = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"]) or any(a != b and b.startswith(a) for a in special for b in special):
        raise ValueError(f"{path}: added tokens that take in spaces, hold for single words or begin another are not supported")
    ranks = {bytes(byte[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, tokens: int = TOKENS, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, local_rank) of all documents' pieces, ``with_ids`` also their ids; a null text is empty.

    A longer document's first piece holds what is left over from whole sequences.
    ``local_rank`` counts the pieces of one length in one partition ``part``."""

    schema = _PIECE + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = partial(byte_tokenizer(vocabulary).encode, allowed_special="all")
        seen = np.zeros(tokens + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(text), END], "<u4")
                start, end = 0, len(ids) % tokens or tokens
                k = 0
                while start < len(ids):
                    own = ids[start:end]
                    rows.append((doc_id, k, start, len(own), zlib.crc32(own.tobytes()), seen[len(own)], own.astype(np.int32))[: 6 + with_ids])
                    seen[len(own)] += 1
                    k, start, end = k + 1, end, end + tokens
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    text = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInPandas(cut, schema).withColumn("part", F.spark_partition_id())


def configurations(sizes: list[int], demand: list[int], room: int) -> list[tuple[list[int], float]]:
    """Configurations (how many of each size fit together) and how often each is used, at the fewest sequences; fractions are allowed.

    Column generation: the basis has one configuration for each size; one that
    would pay at the current prices, found by a knapsack over lengths, comes in
    while there is any."""
    m, size = len(sizes), np.array(sizes)
    basis = np.diag([float(room // s) for s in sizes])
    use = np.array(demand, float) / np.diag(basis)
    for _ in range(200 * m):
        price = np.linalg.solve(basis.T, np.ones(m))
        # Places below 0 stand for sizes that don't fit.
        value, last = np.full(2 * room + 1, -np.inf), np.full(room + 1, -1)
        value[room] = 0
        for c in range(1, room + 1):
            v = value[room + c - size] + price
            i = v.argmax()
            if v[i] > value[room + c - 1] + 1e-12:
                value[room + c], last[c] = v[i], i
            else:
                value[room + c] = value[room + c - 1]
        if value[2 * room] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), room
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                column[last[c]] += 1
                c -= sizes[last[c]]
        step = np.linalg.solve(basis, column)
        ratio = np.full(m, np.inf)
        positive = step > 1e-9
        ratio[positive] = use[positive] / step[positive]
        out = int(ratio.argmin())
        use = np.maximum(use - ratio[out] * step, 0)
        basis[:, out], use[out] = column, ratio[out]
    return [([int(round(x)) for x in basis[:, j]], float(use[j])) for j in range(m) if use[j] > 1e-9]


@dataclass
class Plan:
    """``runs[length]``: (first rank, count, sequence of the first, pieces to a sequence, offset), by first rank."""

    room: int
    runs: dict[int, list[tuple[int, int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))
    sequences: int = 0

    def put(self, length: int, rank: int, count: int, first: int, to_each: int, offset: int) -> None:
        self.runs[length].append((rank, count, first, to_each, offset))

    def find(self, length: int, rank: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        own = self.runs[length]
        start, _, first, each, offset = own[bisect.bisect_right(own, rank, key=lambda r: r[0]) - 1]
        return first + (rank - start) // each, offset + (rank - start) % each * length


def make_plan(histogram: dict[int, int], room: int = TOKENS, groups: int = GROUPS, long: float = LONG[0]) -> Plan:
    """Places for all pieces, given how many there are of each length."""
    plan = Plan(room)
    lengths = sorted((s for s, n in histogram.items() if n), reverse=True)
    queue = {s: [0, histogram[s]] for s in lengths}  # next rank, how many are left
    if room in queue:
        plan.put(room, 0, queue[room][1], 0, 1, 0)
        plan.sequences = queue.pop(room)[1]
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, how many)

    def take(s: int, n: int, first: int, each: int, used: int) -> None:
        plan.put(s, queue[s][0], n, first, each, used)
        queue[s][0] += n
        queue[s][1] -= n

    big = [s for s in lengths if long * room < s < room]
    total = sum(queue[s][1] for s in big)
    if total:
        share = -(-total // groups)
        members: list[list[list[int]]] = [[]]  # of each group: [length, how many]
        for s in big:
            left = queue[s][1]
            while left:
                space = share - sum(n for _, n in members[-1])
                if not space:
                    members.append([])
                    space = share
                members[-1].append([s, min(left, space)])
                left -= min(left, space)
        sizes: dict[int, list[list[int]]] = defaultdict(list)  # groups of one rounded size are one
        for g in members:
            sizes[g[0][0]] += g
        order = sorted(sizes)
        for counts, use in configurations(order, [sum(n for _, n in sizes[s]) for s in order], room):
            n = int(use + 1e-6)
            n = min([n, *(sum(x for _, x in sizes[s]) // c for s, c in zip(order, counts, strict=True) if c)])
            if not n:
                continue
            rows = [(plan.sequences, n, 0)]  # first sequence, how many, tokens used: alike within a row
            plan.sequences += n
            for s, c in zip(order, counts, strict=True):
                for _ in range(c):
                    rows = _fill(rows, sizes[s], take)
            for first, k, used in rows:
                free[room - used].append((first, k))
    open_ = sorted(k for k, v in free.items() if v and k)
    for s in (s for s in lengths if s < room):
        while queue[s][1]:
            at = bisect.bisect_left(open_, s)
            if at == len(open_):
                n = -(-queue[s][1] // (room // s))
                f, (first, k) = room, (plan.sequences, n)
                plan.sequences += n
            else:
                f = open_[at]
                first, k = free[f].pop()
                if not free[f]:
                    del open_[at]
            each = min(f // s, queue[s][1])
            full = min(k, queue[s][1] // each)
            take(s, full * each, first, each, room - f)
            for rest, start, many in ((f - each * s, first, full), (f, first + full, k - full)):
                if many and rest:
                    if not free[rest]:
                        bisect.insort(open_, rest)
                    free[rest].append((start, many))
    for runs in plan.runs.values():
        runs.sort()
    return plan


def _fill(rows: list[tuple[int, int, int]], stock: list[list[int]], take) -> list[tuple[int, int, int]]:
    """Gives every sequence of ``rows`` one piece of a group's stock, longest first."""
    out = []
    for first, n, used in rows:
        while n:
            s, left = stock[0]
            k = min(n, left)
            take(s, k, first, 1, used)
            out.append((first, k, used + s))
            first, n = first + k, n - k
            stock[0][1] -= k
            if not stock[0][1]:
                stock.pop(0)
    return out


def pack(cut: DataFrame, tokens: int = TOKENS, groups: int = GROUPS, long: tuple[float, ...] = LONG) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset.

    The histogram (at most ``tokens`` rows) comes to the driver, and the plan goes
    out with the tasks: a few runs for each length. Counts by partition and length
    make ranks global; no piece is shuffled otherwise. No pieces give no rows."""
    written = materialize(cut)
    counts = written.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = materialize(counts.withColumn("before", before))
    histogram = {r["length"]: r["n"] for r in shifts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = min((make_plan(histogram, tokens, groups, share) for share in long), key=lambda p: p.sequences)
    runs = dict(plan.runs)

    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        arrays = {s: np.array(r) for s, r in runs.items()}
        for length, rank in batches:
            s, r = length.to_numpy(), rank.to_numpy()
            seq, off = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
            for one in np.unique(s):
                at = np.flatnonzero(s == one)
                own = arrays[one][np.searchsorted(arrays[one][:, 0], r[at], side="right") - 1]
                turn = r[at] - own[:, 0]
                seq[at] = own[:, 2] + turn // own[:, 3]
                off[at] = own[:, 4] + turn % own[:, 3] * one
            yield pd.DataFrame({"sequence_id": seq, "offset": off})

    ranked = written.join(shifts.select("part", "length", "before"), ["part", "length"])
    out = ranked.withColumn("x", F.pandas_udf(place, "sequence_id long, offset long")("length", F.col("local_rank") + F.col("before")))
    ids = ["ids"] if "ids" in cut.columns else []
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "piece", "start", "length", "ids_crc32", "x.sequence_id", "x.offset", *ids)


@query("op1_packing")
def op1_packing(spark, sf_dir):
    return pack(pieces(table(spark, sf_dir, "documents")))
