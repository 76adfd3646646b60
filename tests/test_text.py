"""Column functions against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import text as X
from gaugeloom.functions import verdicts
from gaugeloom.operators import similarity


def cosine(a, b):
    a, b = (Counter(re.findall("[a-z0-9]+", t.lower())) for t in (a, b))
    idf = {t: math.log(1 + 2 / ((t in a) + (t in b))) for t in a | b}
    va, vb = ({t: n * idf[t] for t, n in c.items()} for c in (a, b))
    dot = sum(v * vb.get(t, 0) for t, v in va.items())
    size = math.sqrt(sum(v * v for v in va.values())) * math.sqrt(sum(v * v for v in vb.values()))
    return min(1.0, dot / size) if size else 0.0


PAIRS = [("alpha beta gamma", "delta epsilon zeta"), ("same words here", "same words here"), ("", "x"), ("", ""), ("a b b c", "b c c d"), ("Été x", "été y")]


def test_pair_similarity(spark):
    random.seed(3)
    words = "alpha beta gamma delta one two three".split()
    pairs = PAIRS + [(" ".join(random.choices(words, k=random.randint(0, 9))), " ".join(random.choices(words, k=5))) for _ in range(40)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    got = {r.id: r.similarity for r in similarity.versus(df, ["id"], "a", "b").collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(cosine(a, b), abs=1e-9)


def test_group_consistency_counts_pairs_without_common_terms(spark):
    rows = [(1, 0, "a b"), (1, 1, "a b"), (1, 2, "z"), (2, 0, "only one"), (3, 0, ""), (3, 1, "")]
    got = {r.g: r for r in similarity.group_consistency(spark.createDataFrame(rows, "g int, i int, t string"), "g", "i", "t").collect()}
    assert set(got) == {1, 3}
    assert got[1].score == pytest.approx(1 / 3) and got[1].least == 0 and got[1].most == pytest.approx(1)
    assert got[3].score == 0


def test_jaccard_tokens_and_estimates(spark):
    df = spark.createDataFrame([("", ""), ("a b", ""), ("a b", "b c"), (None, "x" * 9)], "a string, b string")
    a, b = X.token_set(F.col("a")), X.token_set(F.col("b"))
    got = df.select(X.jaccard(a, b).alias("j"), X.estimate_tokens(F.col("b")).alias("n"), X.estimate_tokens_floor(F.col("b")).alias("m")).collect()
    assert [r.j for r in got] == [1.0, 0.0, pytest.approx(1 / 3), 0.0]
    assert [(r.n, r.m) for r in got] == [(0, 1), (0, 1), (1, 1), (3, 2)]


def test_dense_cosine_and_mask(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], "the cat the", "the"), ([0.0, 0.0], [1.0, 1.0], "none", "the")], "a array<double>, b array<double>, t string, p string")
    got = df.select(X.dense_cosine(F.col("a"), F.col("b")).alias("c"), X.mask_first(F.col("t"), F.col("p"), F.lit("[X]")).alias("m"), X.pad(F.col("p"), 7).alias("pad")).collect()
    assert [r.c for r in got] == [1.0, 0.0]
    assert [r.m for r in got] == ["[X] cat the", None]
    assert got[0].pad == "thethet"


def test_verdict_edges(spark):
    df = spark.createDataFrame([(0.9,), (0.85,), (0.8499,), (0.15,), (0.2,), (0.21,)], "s double")
    got = df.select(verdicts.consistency(F.col("s")).alias("c"), verdicts.livelock(F.col("s")).alias("l"), verdicts.pressure(F.col("s")).alias("p"), verdicts.severity(F.col("s")).alias("v")).collect()
    assert [r.c for r in got[:3]] == ["CONSISTENT", "BORDERLINE", "INCONSISTENT"]
    assert [r.l for r in got[3:]] == ["LIVELOCK_FREE", "BORDERLINE", "LIVELOCK_DETECTED"]
    assert got[0].p == "STABLE" and got[2].p == "MILD" and got[3].v == "high"
