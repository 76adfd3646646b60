"""Keyed tables, a model's ledger, similarity chains and distributed ranks."""

import random
import sys
import threading

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gaugeloom.functions import slots
from gaugeloom.operators import scoring, similarity
from gaugeloom.sources import calls
from gaugeloom.sources.tables import KeyedTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SCHEMA = "k int, v string, n double"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_changes_of_a_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], parts=4)
    put = lambda *xs: t.upsert(spark.createDataFrame(list(xs), SCHEMA))
    gone = lambda *ks: t.delete(spark.createDataFrame([(k,) for k in ks], "k int"))
    assert rows(t.read()) == []
    put((1, "a", 1.0), (2, "b", None))
    opened, first = t.read(), max(t.versions())
    put((2, "B", 2.0), (3, "c", 3.0))
    gone(1, 9)
    assert rows(t.read()) == [(2, "B", 2.0), (3, "c", 3.0)]
    put((1, "again", 0.5))  # the fourth part: compacted
    assert len(t._manifest(max(t.versions()))) == 1
    assert rows(t.read()) == [(1, "again", 0.5), (2, "B", 2.0), (3, "c", 3.0)]
    # a reader that opened the table before sees what was there then
    assert rows(opened) == rows(t.read(first)) == [(1, "a", 1.0), (2, "b", None)]
    t.clear()
    assert rows(t.read()) == [] and rows(opened) == [(1, "a", 1.0), (2, "b", None)]
    put((5, None, None))
    t.sweep(keep=1)
    assert rows(t.read()) == [(5, None, None)] and len(t.versions()) == 1 and len(t._names("parts")) == 1


def test_writers_at_once_lose_nothing(spark, tmp_path):
    tables = [KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"]) for _ in range(4)]
    errors = []

    def write(i):
        try:
            for j in range(2):
                tables[i].upsert(spark.createDataFrame([(10 * i + j, f"w{i}", float(j))], SCHEMA))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not errors and len(tables[0].versions()) == 8
    assert {r.k for r in tables[0].read().collect()} == {10 * i + j for i in range(4) for j in range(2)}


def test_compaction_keeps_what_came_meanwhile(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])
    t.upsert(spark.createDataFrame([(1, "a", 1.0)], SCHEMA))
    t.upsert(spark.createDataFrame([(2, "b", 1.0)], SCHEMA))
    write = t._write

    def slow(df):
        name = write(df)
        t._write = write
        t.upsert(spark.createDataFrame([(1, "late", 9.0)], SCHEMA))
        return name

    t._write = slow
    t.compact()
    assert rows(t.read()) == [(1, "late", 9.0), (2, "b", 1.0)]
    assert [p["whole"] for p in t._manifest(max(t.versions()))] == [True, False]


def test_prompts_are_asked_once(spark, tmp_path):
    asked, broken = tmp_path / "asked", tmp_path / "broken"
    asked.mkdir()
    broken.mkdir()

    def model(prompt):
        import os
        import uuid

        open(f"{asked}/{prompt.replace(' ', '-')}-{uuid.uuid4().hex}", "w").close()
        if prompt == "never":
            raise RuntimeError("refused")
        if prompt.startswith("late") and len([x for x in os.listdir(asked) if x.startswith(prompt.replace(" ", "-") + "-")]) < 3:
            raise TimeoutError("slow")
        if prompt == "killer" and not os.path.exists(f"{broken}/mended"):
            raise SystemExit("the worker is gone")  # no Exception: the task dies
        return prompt.upper()

    prompts = [f"p{i % 40}" for i in range(120)] + ["never", "late one", None]
    df = spark.createDataFrame(list(enumerate(prompts)), "id int, p string")
    counts = lambda: pd.Series([x.name.rsplit("-", 1)[0] for x in asked.iterdir()]).value_counts().to_dict()
    ask = lambda d: calls.ask(d, "p", model, str(tmp_path / "ledger"), attempts=3, wait=0.001, flush=1)
    with pytest.raises(Exception):
        ask(df.unionByName(spark.createDataFrame([(999, "killer")], "id int, p string"))).collect()
    (broken / "mended").touch()
    got = {r.id: (r.response, r.error, r.attempts) for r in ask(df).collect()}
    assert all(got[i] == (f"P{i % 40}", None, 1) for i in range(120))
    assert got[120] == (None, "RuntimeError: refused", 3) and got[121][:2] == ("LATE ONE", None) and got[122] == (None, None, None)
    made = counts()
    assert all(made[f"p{i}"] == 1 for i in range(40)), made  # answers of the job that died were kept
    assert got[121][2] == 3 and made["late-one"] == 3
    again = {r.id: r.response for r in ask(df.where("id < 120")).collect()}
    assert again == {i: f"P{i % 40}" for i in range(120)} and counts() == made


def test_each_step_of_the_similarity_chain(spark):
    texts = [("a b", "a c"), ("boom a", "a"), ("odd a", "a"), ("none a", "a"), (None, "a"), ("x", "x")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, a string, b string")

    def caller(a, b):
        if a.str.contains("boom").any():
            raise RuntimeError("one row breaks the batch")
        return pd.Series([None if "none" in x or "odd" in x else 2.0 for x in a])

    def engine(a, b):
        return pd.Series([float("nan") if "none" in x else 0.25 for x in a])

    def embed(a):
        return pd.Series([[1.0, 0.0] if "none" in x else [1.0, 1.0] for x in a])

    def by(**steps):
        return {r.id: (round(r.similarity, 4), r.similarity_by) for r in slots.similarity_chain(df, "a", "b", **steps).collect()}

    native = {r.id: round(r.similarity, 4) for r in similarity.versus(df, ["id"], "a", "b").collect()}
    assert by() == {i: (native[i], "tfidf") for i in range(6)}
    assert by(caller=caller) == {0: (1.0, "caller"), 1: (native[1], "tfidf"), 2: (native[2], "tfidf"), 3: (native[3], "tfidf"), 4: (0.0, "tfidf"), 5: (1.0, "caller")}
    assert by(caller=caller, engine=engine) == {0: (1.0, "caller"), 1: (0.25, "engine"), 2: (0.25, "engine"), 3: (native[3], "tfidf"), 4: (0.0, "tfidf"), 5: (1.0, "caller")}
    assert by(caller=caller, engine=engine, embedder=embed)[3] == (0.7071, "embedding")


def test_row_and_table_forms_of_similarity_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("role = 'assistant'")
    pairs = docs.alias("x").join(docs.alias("y"), F.expr("x.conv_id = y.conv_id AND x.turn < y.turn")).select(F.expr("concat(x.conv_id, '-', x.turn, '-', y.turn)").alias("id"), F.col("x.text").alias("a"), F.col("y.text").alias("b"))
    table = {r.id: r.similarity for r in similarity.versus(pairs, ["id"], "a", "b").collect()}
    row = {r.id: r.similarity for r in slots.similarity_chain(pairs, "a", "b").collect()}
    assert table.keys() == row.keys() and all(row[k] == pytest.approx(table[k], abs=1e-12) for k in table)


@pytest.mark.parametrize("size", [3, 50, 1_000_000])
def test_average_ranks(spark, monkeypatch, size):
    monkeypatch.setattr(scoring, "RANGE", size)
    dice = random.Random(4)
    values = [round(dice.gauss(0, 3), 2) for _ in range(2500)] + [None] * 5 + [0.0] * 40
    got = scoring.average_ranks(spark.createDataFrame([(v,) for v in values], "x double"), "x", "r").collect()
    want = pd.Series([float("-inf") if v is None else v for v in values]).rank()
    assert sorted((v is not None, v or 0, r) for v, r in map(tuple, got)) == sorted((v is not None, v or 0, r) for v, r in zip(values, want, strict=True))


def test_ranks_are_ordered_in_many_tasks(spark):
    df = spark.range(300_000).select((F.xxhash64("id") / F.lit(2.0**63)).alias("x"))
    ranked = scoring.average_ranks(df, "x", "r")
    assert "SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert [ranked.agg(F.min("r"), F.max("r"), F.countDistinct("r")).first()[i] for i in range(3)] == [1.0, 300_000.0, 300_000]
    assert ranked.select(F.corr("x", "r")).first()[0] > 0.99
    assert scoring.average_ranks(df.limit(0), "x", "r").count() == 0
