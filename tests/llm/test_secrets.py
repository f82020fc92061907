import hashlib
import re

from sylva.llm.secrets import RULES, SHARD_TEXTS, Rule, build_index, candidates, find_secrets, redact, span_text, trigram_query
from tests.llm.fixtures import awkward

TEXTS = [
    "password=hunter22 and PASSWD: 'abcdef' token=ab", "AKIA" + "A" * 16 + " AKIAAKIA short", "deadbeef" * 4 + " é secret : \"" + "f" * 30 + '"',
    "token=token: abcdefg", None, "", "ſecret=abcdef apiKey=zzzzzzzz api_key==1234567", "x " * 3000 + "secret=longlonglong", "ghp_" + "a" * 36,
    "-----BEGIN RSA PRIVATE KEY-----", "password=hunter22 and PASSWD: 'abcdef' token=ab", "token\t=abcdefgh token = a.b-c_d/e+f=", "xoxb-1234567890ab"]


def brute(text):
    out = []
    for rank, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), rank, f"{rule.kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_spans_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in find_secrets(docs).select("doc_id", span_text("spans").alias("s")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert hashlib.sha256(b"").hexdigest()  # an empty digest is that of no span


def test_candidates_miss_no_match(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    index = build_index(docs, shard_texts=4)
    assert index.count() > 1 and SHARD_TEXTS > 4
    keys = {r["_key"] for r in candidates(index).where("cand_assign").collect()}
    rows = docs.selectExpr("text", "xxhash64(coalesce(text, '')) AS k").collect()
    assert {r["k"] for r in rows if "assign" in brute(r["text"])} <= keys
    assert not {r["k"] for r in rows if r["text"] == ""} & keys


def test_queries_of_rules():
    by = {r.kind: trigram_query(r) for r in RULES}
    assert by["hex"] == [] and by["access"] == [["aki", "kia"]] and ["ken", "oke", "tok"] in by["assign"]


def test_redaction_and_awkward_rows(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefab" + "c" * 24 + " z"), (2, None), (3, "clean")], "id int, text string")
    got = {r["id"]: r["text"] for r in redact(find_secrets(docs)).collect()}
    assert got == {1: "a [SECRET] z", 2: None, 3: "clean"}
    rows = awkward(spark)
    out = redact(find_secrets(rows))
    assert out.columns == [c for c in rows.columns if c != "spans"] and out.count() == rows.count()
    assert {r["_key"] for r in out.collect()} == {2}
    assert find_secrets(rows.where("false")).count() == 0


def test_native_plan(spark):
    plan = find_secrets(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_queries_come_from_patterns():
    of = lambda p: trigram_query(Rule("x", p))
    assert of("abc(d|ef)g") == [["abc", "bcd", "cdg"], ["abc", "bce", "cef", "efg"]]
    assert of("ab?cd") == [["abc", "bcd"], ["acd"]] and of("(?i:KEY)[0-9]+end") == [["end", "key"]]
    assert of("a.b") == [] and of("(abc)*x") == [] and of("(abc|d.e)") == [] and of("(abc)+xyz") == [["abc", "xyz"]]
    assert of("^(foo.*bar|quux)$") == [["foo"], ["quu", "uux"]] or of("^(foo.*bar|quux)$") == [["bar"], ["quu", "uux"]]


def test_index_of_each_rule_against_a_full_scan(spark):
    extra = ["xoxs-ABCDEFGHIJK", "gho_" + "Z9" * 20, "eyJabcdefgh.eyJabcdefgh.abcdefgh", "-----BEGIN PRIVATE KEY-----", 'API_KEY":"abcdefg', "PassWd=abcdefg", "secret'=abcdefg"]
    texts = [(t,) for t in TEXTS + extra]
    for rule in RULES:
        got = find_secrets(spark.createDataFrame(texts, "text string"), (rule,)).select("text", "spans").collect()
        for r in got:
            assert len(r["spans"]) == sum(len(m[rule.group]) >= rule.least for m in re.finditer(rule.pattern, r["text"] or "", re.ASCII))


def test_very_many_matches_in_a_text(spark):
    n = 100_000
    text = "é token=abcdef" * n
    docs = spark.createDataFrame([(text,)], "text string")
    found = find_secrets(docs)
    spans = found.selectExpr("size(spans) AS n", "element_at(spans, -1).end AS e", "element_at(spans, 257).start AS s").first()
    assert (spans["n"], spans["e"], spans["s"]) == (n, len(text), 256 * 14 + 2)
    assert redact(found).first()["text"] == "é [SECRET]" * n


def test_overlapping_and_touching_spans(spark):
    spans = "array<struct<start:int,rank:int,kind:string,end:int>>"
    rows = [("0123456789", [(0, 0, "a", 3), (1, 1, "b", 2), (3, 0, "a", 4), (6, 0, "a", 7)]), ("abc", [(0, 0, "a", 3)]), ("abc", [])]
    got = redact(spark.createDataFrame(rows, f"text string, spans {spans}"), "#")
    assert sorted(r["text"] for r in got.collect()) == ["#", "#45#789", "abc"]
