"""Contract columns of whole tables against plain Python, and clashing columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gaugeloom.llm import fingerprint, language, secrets, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def shingles(text):
    words = re.sub(r"[\t\n\x0b\f\r]", " ", text.lower()).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints_of_a_table(spark, docs):
    order = sorted(docs, reverse=True)
    rows = {r.doc_id: r for r in fingerprint.op1_fingerprint(spark, SF).collect()}
    assert rows.keys() == docs.keys()
    for at, i in enumerate(order):
        text, after = docs[i], docs[order[(at + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for got, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got - true) < (1e-9 if max(len(a), len(b)) <= 256 and len(a | b) <= 256 else 0.15), (i, got, true)
    same = {}
    for i, text in docs.items():
        assert same.setdefault(text, rows[i].fingerprint) == rows[i].fingerprint


def test_merged_sketches_are_the_whole_text_s(spark):
    parts = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    sketch = lambda df: fingerprint.add_sketch(df, "text", "s", 64, 1)
    merged = {r.g: r.s for r in fingerprint.merge(sketch(parts), "g", "s", 64, fan=8).collect()}
    whole = {r.g: r.s for r in sketch(parts.groupBy("g").agg(F.array_join(F.collect_list("text"), " ").alias("text"))).collect()}
    assert merged == whole and all(len(s) == 64 for s in merged.values())
    clash = sketch(parts.withColumn("_s_words", F.lit("mine")))
    assert clash.select("_s_words").distinct().collect()[0][0] == "mine"


def test_secrets_of_a_table(spark, docs):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for r in secrets.op10_secrets(spark, SF).collect():
        text = docs[r.doc_id]
        found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in found) for x in ("assign", "access", "hex"))
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0]))))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= set(filter(None, r.spans.split(",")))


def test_an_owner_that_is_missing_isn_t_an_empty_one(spark):
    value = "password = Zq81mmXp03Lw77"
    rows = [(1, value, None, "r1"), (2, value, "", "r1"), (3, "token: Qw9zz81kkP", "o", None), (4, "token: Qw9zz81kkP", "o", "r")]
    found = {r.doc_id: r.found for r in secrets.find(spark.createDataFrame(rows, "doc_id int, text string, who string, repo string"), repository="repo", owner="who").collect()}
    assert [(x.standing, x.n_owners, x.n_repositories) for x in found[1]] == [("shared", 2, 1)] == [(x.standing, x.n_owners, x.n_repositories) for x in found[2]]
    assert [(x.standing, x.n_owners, x.n_repositories) for x in found[3]] == [("shared", 1, 2)]


def test_columns_named_as_results_are_replaced(spark):
    docs = spark.createDataFrame([(1, "some text of words", "mine", 7), (2, None, None, None)], "doc_id int, text string, score string, rejected int")
    for out in (language.predict(docs, None), toxicity.score(docs, None)):
        assert out.columns.count("score") == 1 and [r.score for r in out.orderBy("doc_id").collect()] == [0.0, 0.0]
