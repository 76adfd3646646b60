"""Whitening against eigenvectors of the covariance matrix, in plain numpy."""

import numpy as np
import pytest

from gaugeloom.llm import whitening as W

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, component string, n string, deviation string, x string, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["clash"] * 5) for i, v in rows], SCHEMA)


def usable(rows):
    return [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]


def hold_against(out, rows, components=16):
    rows = sorted(usable(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > values[0] * 1e-12).sum()))
    assert len(out) == k * len(rows)
    deviation = dict(zip([tuple(v) for _, v in rows], ((n * x - total) ** 2).sum(axis=1).tolist(), strict=True))
    place = {d: i for i, d in enumerate(deviation[v] for v in sorted(deviation))}
    together = [out[at : at + k] for at in range(0, len(out), k)]  # an input row's rows follow each other
    got = [r for g in sorted(together, key=lambda g: (g[0]["vec_id"] is None, g[0]["vec_id"] or 0, place[g[0]["deviation"]])) for r in g]
    assert [r["component"] for r in got] == list(range(1, k + 1)) * len(rows)
    assert [r["vec_id"] for r in got] == [i for i, _ in rows for _ in range(k)]
    assert [r["deviation"] for r in got] == np.repeat(((n * x - total) ** 2).sum(axis=1), k).tolist()
    assert {r["n"] for r in got} == {n}
    made = np.array([r["whitened"] for r in got]).reshape(len(rows), k)
    wanted = (x - total / n) @ vectors[:, :k] / np.sqrt(values[:k])
    signs = np.sign((made * wanted).sum(axis=0))
    assert np.abs(made * signs - wanted).max() < 1e-8
    assert np.allclose([r["explained"] for r in got], np.tile(values[:k] / values.sum(), len(rows)), rtol=1e-9)
    assert {r["identity_error"] < 1e-10 for r in got} == {True}


def test_whole_table_is_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    hold_against(W.op11_whitening(spark, SF).collect(), rows)


def test_unusable_rows_copies_and_clashing_columns(spark):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=6).tolist()) for i in range(40)]
    rows += [(None, [0.5] * 6), (7, rows[7][1]), (7, rows[8][1]), (50, [0.5] * 6)]
    bad = [(60, None), (61, [1.0, None, 0.0]), (62, [float("nan")] * 6), (63, [0.0, float("inf")]), (64, [])]
    other_lengths = [(70, [1.0, 2.0]), (71, [2.0, 1.0])]
    hold_against(W.whiten(frame(spark, rows + bad + other_lengths).repartition(7)).collect(), rows)
    hold_against(W.whiten(frame(spark, rows), components=3).collect(), rows, 3)


def test_nothing_to_learn(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        out = W.whiten(frame(spark, rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.collect() == []


def test_fewer_directions_than_dimensions(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    hold_against(W.whiten(frame(spark, rows)).collect(), rows)


@pytest.mark.parametrize("spread", [1, 1e-5])
def test_rotations_keep_small_lengths_accurate(spread):
    random = np.random.default_rng(5)
    q, _ = np.linalg.qr(random.normal(size=(9, 9)))
    lengths = np.array([3.0**-i for i in range(9)]) * spread
    _, found = W.jacobi((random.permutation(np.eye(9)) * lengths) @ np.eye(9))
    assert np.allclose(found, lengths, rtol=1e-14)
    v, found = W.jacobi(np.diag(lengths) @ q.T)
    assert np.allclose(found, lengths, rtol=1e-13)
    assert np.allclose(v.T @ v, np.eye(9), atol=1e-14)


def test_tree_of_triangles_is_one_triangle():
    random = np.random.default_rng(7)
    rows = random.normal(size=(300, 5))
    parts = [np.linalg.qr(p, mode="r") for p in np.array_split(rows, 20)]
    one, tree = np.linalg.qr(rows, mode="r"), np.linalg.qr(np.vstack(parts), mode="r")
    assert np.allclose(one.T @ one, tree.T @ tree)
    for d in (2, 6, 7):
        rounds = W._rounds(d)
        assert sorted((int(a), int(b)) for p, q in rounds for a, b in zip(p, q, strict=True)) == [(a, b) for a in range(d) for b in range(a + 1, d)]
        assert all(len({*p, *q}) == 2 * len(p) for p, q in rounds)


def test_large_deviations_are_exact_or_null():
    centre = W.Centre(3, [3_000_000_000, 7])
    assert centre.deviation(np.array([[1_000_000_001, 2], [1_000_000_000, 3]])) == [9 + 1, 0 + 4]
    far = W.Centre(1 << 40, [0, 0])
    assert far.deviation(np.array([[1, 0], [0, 0]])) == [None, 0]
