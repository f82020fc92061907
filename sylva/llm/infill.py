"""Fill-in-the-middle transformation of texts, cut at token boundaries.

The boundaries of a text are a set of code point positions, kept in containers of
65,536 positions each: an array, a bitmap or a list of runs, whichever is smallest,
with cumulative cardinalities over the containers. The k-th boundary is found by a
search over these and a selection within one container. A set is built from one
slice of the text after another, so beside the text itself it takes at most an
eighth of a byte for each code point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import box, query, table

SEED = "1"
PLAIN_FROM = 90
SUFFIX_FIRST = 20
SPAN = 1 << 16
ARRAY_MOST = 4096
_BITS = np.array([[i >> b & 1 for b in range(8)] for i in range(256)], np.uint8)
_ONES = _BITS.sum(axis=1)


class Container:
    """Sorted positions below 65,536 as an array, a bitmap or runs of (first, last, members before)."""

    __slots__ = ("data", "kind", "size")

    def __init__(self, low: np.ndarray):
        self.size = len(low)
        gaps = np.flatnonzero(np.diff(low) != 1)
        bytes_of = {"runs": 4 * (len(gaps) + min(1, self.size)), "bitmap": SPAN // 8}
        if self.size <= ARRAY_MOST:
            bytes_of["array"] = 2 * self.size
        self.kind = min(bytes_of, key=bytes_of.get)
        if self.kind == "array":
            self.data = low.astype(np.uint16)
        elif self.kind == "runs":
            first = np.concatenate((low[:1], low[gaps + 1])).astype(np.int64)
            last = np.concatenate((low[gaps], low[-1:])).astype(np.int64)
            self.data = (first, np.concatenate(([0], np.cumsum(last - first + 1))))
        else:
            on = np.zeros(SPAN, np.uint8)
            on[low] = 1
            self.data = np.packbits(on, bitorder="little")

    def select(self, k: int) -> int:
        """The ``k``-th member, from 0."""
        if self.kind == "array":
            return int(self.data[k])
        if self.kind == "runs":
            first, before = self.data
            r = int(np.searchsorted(before, k, "right")) - 1
            return int(first[r] + k - before[r])
        upto = np.cumsum(_ONES[self.data])
        at = int(np.searchsorted(upto, k, "right"))
        left = k - (int(upto[at - 1]) if at else 0)
        return 8 * at + int(np.flatnonzero(_BITS[self.data[at]])[left])


class BoundarySet:
    """The last code points of a text's tokens ``[A-Za-z]+|[^A-Za-z]``."""

    def __init__(self, text: str):
        self.containers = []
        for at in range(0, len(text), SPAN):
            # One code point more tells whether a run of letters goes on.
            c = np.frombuffer(text[at : at + SPAN + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = ((c | 32) >= 97) & ((c | 32) <= 122)
            here = letter[:SPAN]
            goes_on = np.append(letter[1:], False)[:SPAN]
            self.containers.append(Container(np.flatnonzero(~(here & goes_on))))
        self.upto = np.cumsum([c.size for c in self.containers], dtype=np.int64)

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def cut(self, units: int) -> int:
        """The offset behind the first ``units`` tokens."""
        if units <= 0:
            return 0
        c = int(np.searchsorted(self.upto, units - 1, "right"))
        before = int(self.upto[c - 1]) if c else 0
        return c * SPAN + self.containers[c].select(units - 1 - before) + 1


def cuts(text: str, one: int, two: int) -> tuple[int, int, int]:
    """(tokens, prefix end, middle end) for two draws, each taken modulo one more than the tokens."""
    ends = BoundarySet(text)
    n = len(ends)
    a, b = sorted((one % (n + 1), two % (n + 1)))
    return n, ends.cut(a), ends.cut(b)


def _cuts(text: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cuts(*x) for x in zip(text, one, two, strict=True)], columns=["n", "first", "second"], dtype="int64")


def fill_in_middle(docs: DataFrame, seed: str = SEED, plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc, text, n, form, first, second, output): each row's own columns boxed, its text as used, and the transformed text.

    Draws are hashed from ``seed`` and ``doc_id``, so rows with equal ids and texts
    get equal outputs; a null id counts as empty text. ``plain_from`` of 100 draws
    and above leave the text plain, as do empty and null texts and those that hold a
    marker; below ``suffix_first`` the suffix comes first. Cuts fall at 0, at the end
    or between tokens, and any part may be empty. An empty table gives no rows."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring("h", 8 * i - 7, 8), 16, 10).cast("long")
    cut = F.pandas_udf(_cuts, "n long, first long, second long")
    rows = docs.select(box(docs), F.coalesce("text", F.lit("")).alias("text"), h.alias("h"))
    rows = rows.select("doc", "text", "h", cut("text", draw(1), draw(2)).alias("cut"))
    marked = F.col("text").contains("<P>") | F.col("text").contains("<S>") | F.col("text").contains("<M>")
    plain = (F.col("text") == "") | marked | (draw(3) % 100 >= plain_from)
    form = F.when(plain, "plain").when(draw(4) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc", "text", form.alias("form"), "cut.n", "cut.first", "cut.second")

    def part(mark: str, start: Column, end: Column) -> Column:
        return F.concat(F.lit(mark), F.substr("text", (start + 1).cast("int"), (end - start).cast("int")))

    prefix = part("<P>", F.lit(0), F.col("first"))
    middle = part("<M>", F.col("first"), F.col("second"))
    suffix = part("<S>", F.col("second"), F.length("text"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(prefix, suffix, middle))
    return rows.withColumn("output", output.otherwise(F.concat(suffix, prefix, middle)))


def restore(output: Column, form: Column) -> Column:
    """The text behind an output: its parts, which hold no marker, in their old order."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


SQL = f"""
WITH h AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (
    SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tok,
           list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS d FROM h),
c AS (
    SELECT doc_id, text, tok, len(tok) AS n, least(d[1] % (len(tok) + 1), d[2] % (len(tok) + 1)) AS a,
           greatest(d[1] % (len(tok) + 1), d[2] % (len(tok) + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= {PLAIN_FROM} THEN 'plain'
                WHEN d[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
    SELECT doc_id, text, n, form, array_to_string(tok[1:a], '') AS pre, array_to_string(tok[a + 1:b], '') AS mid,
           array_to_string(tok[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""


@query("op12_fill_in_middle", SQL)
def op12_fill_in_middle(spark, sf_dir):
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    cut = F.col("form") != "plain"
    return rows.select(
        F.col("doc.doc_id").alias("doc_id"), "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"),
        F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
