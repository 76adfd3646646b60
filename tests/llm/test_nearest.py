"""Nearest neighbours against brute force in plain numpy."""

import numpy as np
from pyspark.sql import functions as F

from gaugeloom.llm import nearest as N

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, id string, v string, cid string, list string, rank string, score string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["clash"] * 7) for i, v in rows], SCHEMA)


def brute(rows, asks, nearest=20):
    """{(query id, place among that id's vectors): its answer}"""
    rows = [(i, tuple(np.float32(v).astype(float))) for i, v in rows if i is not None and v is not None and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and any(v)]
    lengths = [len(v) for _, v in {(None, v) for _, v in rows}]
    d = max(lengths, key=lambda n: (lengths.count(n), n), default=0)
    rows = [(i, v) for i, v in rows if len(v) == d]
    out = []
    for i, v in sorted({r for r in rows if asks(r[0])}):
        others = list(rows)
        others.remove((i, v))
        answer = sorted((-float((np.array(v) * np.array(w)).sum()), j) for j, w in others)[:nearest]
        out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(answer)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_recall_on_a_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    wanted, found = brute(rows, lambda i: i % 20 == 0), got(N.op13_nearest(spark, SF))
    assert len(found) == len(wanted)
    assert [f[:2] for f in found] == [w[:2] for w in wanted]
    near = {(q, i): s for q, _, i, s in wanted}
    met = [(q, i) for q, _, i, _ in found if (q, i) in near]
    assert len(met) >= 0.95 * len(wanted)
    assert all(abs(near[q, i] - s) < 1e-12 for q, _, i, s in found if (q, i) in near)


def test_recall_with_many_lists_and_near_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST", 32)
    monkeypatch.setattr(N, "LISTS", 4)
    monkeypatch.setattr(N, "BLOCK", 200)
    random = np.random.default_rng(11)
    centres = random.normal(size=(12, 16))
    x = np.concatenate([centres[random.integers(0, 12, 1200)] + random.normal(size=(1200, 16)), centres[0] + 0.01 * random.normal(size=(600, 16))])
    x *= random.uniform(0.5, 2, size=(len(x), 1))  # lengths differ, as inner products ask
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    wanted, found = brute(rows, lambda i: i % 20 == 0), got(N.search(frame(spark, rows), F.col("id") % 20 == 0))
    assert [f[:2] for f in found] == [w[:2] for w in wanted]
    near = {(q, i) for q, _, i, _ in wanted}
    assert len({(q, i) for q, _, i, _ in found} & near) >= 0.93 * len(near)


def test_ties_copies_and_unusable_rows(spark):
    random = np.random.default_rng(2)
    rows = [(i, random.integers(-1, 2, 3).astype(float).tolist()) for i in range(90)]
    rows += [(0, [1.0, 1.0, 1.0])] * 3 + [(20, [2.0, 0.0, 0.0]), (20, [0.0, 2.0, 0.0])] + [(100 + i, [1.0, 0.0, 1.0]) for i in range(40)]
    rows += [(None, [5.0, 5.0, 5.0]), (40, None), (60, [0.0, 0.0, 0.0]), (80, [None, 9.0, 9.0]), (200, [float("nan"), 9.0, 9.0]), (220, [float("inf"), 0.0, 0.0]), (240, []), (260, [9.0, 9.0])]
    assert got(N.search(frame(spark, rows).repartition(5), F.col("id") % 20 == 0)) == brute(rows, lambda i: i % 20 == 0)
    assert got(N.search(frame(spark, rows), F.col("id") == 101, nearest=3)) == brute(rows, lambda i: i == 101, 3)


def test_few_rows_or_none(spark):
    for rows in ([], [(0, None)], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (20, [1.0, 2.0])], [(0, [1.0]), (1, [-1.0]), (2, [3.0])]):
        out = N.search(frame(spark, rows), F.col("id") % 20 == 0)
        assert out.columns == ["query_id", "rank", "vec_id", "score"]
        assert got(out) == brute(rows, lambda i: i % 20 == 0)


def test_balance_and_graph():
    random = np.random.default_rng(1)
    x = np.concatenate([random.normal(size=(900, 8)), np.ones((700, 8)) + 1e-3 * random.normal(size=(700, 8))])
    leaves = N.halved(x, 50)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(len(x)))
    assert min(map(len, leaves)) >= 25 and max(map(len, leaves)) <= 50
    index = N.Index(x, float(np.sqrt((x * x).sum(axis=1).max())), 50, 20)
    # a search that looks beyond all sees all: the graph is connected
    assert np.isfinite(index.walk(index.lift(x[:40]), lambda _: 1.0, len(index.centroids))).all()
    near = index.walk(index.lift(x), lambda _: 1.0, N.LEAST_SEEN)
    whole = N._distances(index.lift(x), index.centroids)
    assert (near.argmin(axis=1) == whole.argmin(axis=1)).mean() > 0.98


def test_asks_all_where_lists_are_short():
    x = np.random.default_rng(4).normal(size=(64, 4))
    index = N.Index(x, float(np.sqrt((x * x).sum(axis=1).max())), 4, 20)
    sizes = np.ones(len(index.centroids), np.int64)
    rows, lists = index.probes(x[:5], sizes, 10**9)
    assert len(rows) == 5 * len(index.centroids)
    rows, lists = index.probes(x[:5], sizes, 9)
    assert np.bincount(rows).min() >= 9
