"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's pattern, read as a parse tree, a Boolean trigram query is derived:
any of some alternatives, each the conjunction of its trigrams. Documents are dealt into
shards of bounded size; a shard's postings list, for each trigram that some query
names, the texts that hold it. Intersecting and uniting postings leaves the
candidates of a rule, and only those meet its pattern. A rule without a mandatory
trigram scans every text.
"""

from __future__ import annotations

import re._parser as tree
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import box, query, table, unbox
from sylva.session import materialize


@dataclass(frozen=True)
class Rule:
    """A match counts if group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds, in their order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Public token formats beyond the base.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE
SHARD_TEXTS = 4096


MOST_STRINGS, MOST_SIGNS = 64, 8
BLOCK = 256


def trigrams(literal: str) -> list[str]:
    low = literal.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def _each(a: set[str], b: set[str]) -> set[str]:
    return {x + y for x in a for y in b}


def _strings(node) -> tuple[set[str] | None, list[set[str]]]:
    """(all strings a parsed pattern can match, if these are few; else None, and sets of which every match holds a member)."""
    now: set[str] = {""}
    held: list[set[str]] = []
    whole = True

    def stop():
        nonlocal now, whole
        held.append(now)
        now, whole = {""}, False

    for op, arg in node:
        name = str(op)
        inner: list[set[str]] = []
        exact = None
        again = False
        if name == "AT":
            continue
        if name == "LITERAL":
            exact = {chr(arg)}
        elif name == "IN" and all(str(x) in ("LITERAL", "RANGE") for x, _ in arg):
            spans = [(y, y) if str(x) == "LITERAL" else y for x, y in arg]
            if sum(y - x + 1 for x, y in spans) <= MOST_SIGNS:
                exact = {chr(c) for x, y in spans for c in range(x, y + 1)}
        elif name == "SUBPATTERN":
            exact, inner = _strings(arg[-1])
        elif name == "BRANCH":
            parts = [_strings(x) for x in arg[1]]
            if all(x is not None for x, _ in parts):
                exact = set().union(*[x for x, _ in parts])
            else:
                # Of each branch the set with the longest short string; a match holds a member of one.
                best = [max([x] if x is not None else y, key=lambda z: min(map(len, z)), default={""}) for x, y in parts]
                inner = [set().union(*best)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, what = arg
            exact, inner = _strings(what)
            if low == 0:
                inner = []
                exact = exact | {""} if exact is not None and high == 1 else None
            else:
                again = (low, high) != (1, 1)
        if exact is not None and len(now) * len(exact) <= MOST_STRINGS:
            now = _each(now, exact)
            if again:
                stop()
        else:
            stop()
            held += [exact] if exact is not None else inner
    return (now if whole else None), [*held, now]


def trigram_query(rule: Rule) -> list[list[str]]:
    """Alternatives, each a list of trigrams that must all be there; empty: scan fully.

    Derived from the pattern: a match holds a member of each of some sets of strings,
    so their trigrams are joined set by set; an alternative that asks for all that
    another asks for is left out."""
    every: set[frozenset[str]] = {frozenset()}
    for strings in _strings(tree.parse(rule.pattern))[1]:
        asked = {frozenset(trigrams(x)) for x in strings}
        if all(asked) and len(every) * len(asked) <= MOST_STRINGS:
            every = {x | y for x in every for y in asked}
    every = {x for x in every if not any(y < x for y in every)}
    return sorted(sorted(x) for x in every if x)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(box(docs), F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("_key", F.xxhash64("_text"))


def build_index(docs: DataFrame, rules=RULES, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """(_shard, posting_0, posting_1, ...): a list of text keys for every trigram asked for.

    A key is the hash of a text, so copies are one entry; two texts that share a
    key share its postings, which can only add candidates. About ``shard_texts``
    texts make a shard, whatever the number of texts."""
    grams = sorted({g for r in rules for x in trigram_query(r) for g in x})
    low = _keyed(docs).select("_key", F.lower("_text").alias("_low"))
    held = materialize(low.select("_key", *[F.contains("_low", F.lit(g)).alias(f"g{i}") for i, g in enumerate(grams)]))
    shards = max(1, -(-held.count() // shard_texts))
    lists = [F.collect_set(F.when(F.col(f"g{i}"), F.col("_key"))).alias(f"posting_{i}") for i in range(len(grams))]
    return held.groupBy(F.pmod(F.xxhash64("_key"), F.lit(shards)).alias("_shard")).agg(*lists)


def _tagged(keys: Column, kind: str) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("_key"), F.lit(kind).alias("kind")))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(_key, cand_<kind> ...) for every text that is a candidate of an indexed rule."""
    grams = sorted({g for r in rules for x in trigram_query(r) for g in x})
    place = {g: F.col(f"posting_{i}") for i, g in enumerate(grams)}
    found = []
    for r in rules:
        if asked := trigram_query(r):
            hits = reduce(F.array_union, [reduce(F.array_intersect, [place[g] for g in x]) for x in asked])
            found.append(_tagged(hits, r.kind))
    each = index.select(F.explode(F.concat(*found)).alias("c")).select("c.*")
    return each.groupBy("_key").agg(*[F.bool_or(F.col("kind") == r.kind).alias(f"cand_{r.kind}") for r in rules if trigram_query(r)])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _blocks(items: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of each stretch of ``BLOCK`` items of a bound array."""
    from_block = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    return F.when(F.size(items) > 0, F.transform(from_block, lambda i: use(F.slice(items, i * BLOCK + 1, F.lit(BLOCK))))).otherwise(F.array())


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The running sums (or other joins) of an array of integers not below 0, in blocks: a list of n takes n ** 1.5 steps, not its square."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def within(block: Column) -> Column:
        return F.aggregate(block, start, lambda acc, x: F.struct(
            join(acc["at"], x).alias("at"), F.array_append(acc["out"], join(acc["at"], x)).alias("out")))["out"]

    def before(blocks: Column) -> Column:
        return F.aggregate(blocks, start, lambda acc, x: F.struct(
            join(acc["at"], F.element_at(x, -1)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    return _let(values, lambda v: _let(_blocks(v, within), lambda b: F.flatten(
        F.zip_with(b, before(b), lambda x, y: F.transform(x, lambda z: join(y, z))))))


def _spans(rule: Rule) -> Column:
    """array<struct<start, rank, kind, end>> of a rule's matches in ``_text``.

    Split by the pattern, a text is the matches' surroundings in order, so the
    places are running sums of lengths, in code points."""
    got = F.regexp_extract_all("_text", F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all("_text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else got
    gaps = F.split("_text", rule.pattern, -1)
    rank = RULES.index(rule) if rule in RULES else len(RULES)
    each = F.zip_with(F.arrays_zip(gaps.alias("gap"), got.alias("hit")), part, lambda x, y: F.struct(
        (F.length(x["gap"]) + F.length(x["hit"])).alias("both"), F.length(x["hit"]).alias("len"), F.length(y).alias("kept")))
    # The last gap has no match after it.
    hits = F.filter(each, lambda x: x["len"].isNotNull())
    placed = _let(hits, lambda h: F.zip_with(h, running(F.transform(h, lambda x: x["both"]), lambda a, b: a + b), lambda x, end: F.struct(
        (end - x["len"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"), x["kept"].alias("kept"))))
    counted = F.filter(placed, lambda x: x["kept"] >= rule.least)
    return F.transform(counted, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "kind", "end")]))


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with ``spans``: array<struct<start, rank, kind, end>> by start, then kind.

    Places are code points, the end exclusive. A null text is empty. A text may hold
    any number of matches. Every row
    comes back, repeated rows too; other columns stay as they are, but a column
    ``spans`` is replaced."""
    docs = docs.drop("spans")
    texts = _keyed(docs)
    if any(trigram_query(r) for r in rules):
        wanted = materialize(candidates(build_index(docs.select("text"), rules), rules))
        texts = texts.join(wanted, "_key", "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    lists = []
    for r in rules:
        here = F.coalesce(F.col(f"cand_{r.kind}"), F.lit(False)) if trigram_query(r) else F.col("_text").rlike(r.pattern)
        lists.append(F.when(here, _spans(r)).otherwise(none))
    out = texts.withColumn("spans", F.array_sort(F.concat(*lists)))
    return out.select(*unbox(docs), "spans")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span of ``find_secrets`` in ``text``, overlapping ones together; drops ``spans``."""

    def gaps(spans: Column) -> Column:
        """What is left between spans: array<struct<a, b>>."""
        # A span that begins beyond all ends before it begins a stretch; the stretch before it ends at the last of these.
        ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        last = _let(ends, lambda e: F.zip_with(spans, F.concat(F.array(F.lit(-1)), F.slice(e, F.lit(1), F.size(e) - 1)), lambda s, x: F.struct(
            s["start"].alias("b"), x.alias("a"))))
        firsts = F.filter(last, lambda x: x["b"] > x["a"])
        tail = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("a"), F.length("text").alias("b"))
        return F.concat(F.transform(firsts, lambda x: F.struct(F.greatest(x["a"], F.lit(0)).alias("a"), x["b"].alias("b"))), F.array(tail))

    def cut(block: Column) -> Column:
        first = block[0]["a"]
        own = F.substring(F.col("text"), first + 1, F.element_at(block, -1)["b"] - first)
        return _let(own, lambda t: F.transform(block, lambda g: F.substring(t, g["a"] - first + 1, g["b"] - g["a"])))

    left = _let(gaps(F.col("spans")), lambda g: F.flatten(_blocks(g, lambda x: _let(x, cut))))
    masked = F.when(F.size("spans") > 0, F.array_join(left, mark)).otherwise(F.col("text"))
    done = found.select(box(found, "spans"), "text", "spans")
    return done.select(*[masked.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in found.columns if c != "spans"])


def _sql() -> str:
    """The same spans by plain regular expressions."""
    keyword = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    pattern = {r.kind: r.pattern.replace("'", "''") for r in RULES}
    pattern["assign"] = pattern["assign"].replace("(?i:password|passwd|secret|token|api_?key)", keyword)
    parts = []
    for rank, r in enumerate(RULES):
        p = pattern[r.kind]
        parts.append(f"""
            SELECT rid, {rank} AS rank, '{r.kind}' AS kind, unnest(regexp_extract_all(t, '{p}', 0)) AS hit,
                   unnest(regexp_extract_all(t, '{p}', {r.group})) AS kept,
                   unnest(list_slice(string_split_regex(t, '{p}'), 1, -2)) AS gap, generate_subscripts(regexp_extract_all(t, '{p}', 0), 1) AS i
            FROM d WHERE regexp_matches(t, '{p}')""")
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        m AS ({' UNION ALL '.join(parts)}),
        p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, rank ORDER BY i)::BIGINT AS e FROM m),
        s AS (SELECT rid, rank, kind, e - length(hit) AS a, e FROM p WHERE length(kept) >= CASE kind {least} END),
        g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                     string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank) AS spans,
                     string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank) FILTER (kind IN ({base})) AS base FROM s GROUP BY rid)
        SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


@query("op3_secrets", _sql())
def op3_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
