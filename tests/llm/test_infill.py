import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sylva.llm.infill import BoundarySet, Container, fill_in_middle, restore
from tests.llm.fixtures import awkward

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def test_containers_select():
    r = np.random.default_rng(1)
    cases = {
        "array": np.arange(0, 9000, 3), "bitmap": np.sort(r.choice(65536, 30000, replace=False)),
        "runs": np.concatenate((np.arange(5, 20000), np.arange(30000, 65536)))}
    for kind, low in cases.items():
        c = Container(low)
        assert c.kind == kind and c.size == len(low)
        for k in [0, 1, len(low) // 2, len(low) - 1, *r.integers(0, len(low), 50).tolist()]:
            assert c.select(k) == low[k]
    assert Container(np.zeros(0, int)).size == 0


def test_cuts_of_any_text():
    r = random.Random(2)
    texts = ["", "a", "é", "ab c", "\n", "𝔘nicode 🙂🙂 x", "a" * 65536 + "b", "a" * 200000, "." * 140000, "ab " * 50000 + "z" * 70000 + "é!" * 40000]
    texts += ["".join(r.choice("ab é\U0001f642.<") for _ in range(n)) for n in (1, 7, 300, 65535, 65536, 65537, 131073)]
    for t in texts:
        ends = [m.end() for m in TOKEN.finditer(t)]
        s = BoundarySet(t)
        assert len(s) == len(ends)
        for k in {0, 1, len(ends), len(ends) - 1, *[r.randint(0, len(ends)) for _ in range(40)]}:
            if 0 <= k <= len(ends):
                assert s.cut(k) == (ends[k - 1] if k else 0)


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = TOKEN.findall(text)
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", text
    return (len(tokens), "spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(tokens), "psm", f"<P>{p}<S>{s}<M>{m}")


def test_against_brute_force(spark):
    df = awkward(spark, "doc_id long, text string, form string, output string, h int, n int, cut long, doc string")
    more = [(100 + i, t, "f", "o", 1, 2, 3, "d") for i, t in enumerate(
        ["<P>", "a<S>b", "x<M>", "<P<S", "< S>", "P>", "tail <", "<P", ">", "🙂 é ß", "a\x00b c", "line\r\nline"] * 9)]
    df = df.unionByName(spark.createDataFrame(more, df.schema))
    rows = fill_in_middle(df)
    back = rows.select("doc.doc_id", "doc.form", "text", "n", "first", "second", rows["form"].alias("shape"), "output", restore(F.col("output"), rows["form"]).alias("back"))
    got = back.collect()
    assert len(got) == df.count()
    shapes = set()
    for r in got:
        assert (r["n"], r["shape"], r["output"]) == brute(r["doc_id"], r["text"])
        assert r["back"] == r["text"]
        shapes.add(r["shape"])
    assert shapes == {"plain", "psm", "spm"}
    assert fill_in_middle(df.where("false")).count() == 0
    assert fill_in_middle(df, plain_from=0).where("form <> 'plain'").count() == 0
    assert fill_in_middle(df, plain_from=100, suffix_first=100).where("form = 'psm'").count() == 0
