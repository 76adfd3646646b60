"""Embedding whitening: principal components and standard deviations by a one-sided Jacobi SVD.

Entries become whole numbers, x = floor(64 * c) + 1000000, and each distinct vector of them counts once: the fit list.

* The centred rows of the fit list are compressed to a triangle R by QR, block after block within a task, then task after task
  in a tree of FAN_IN (TSQR); no more than d x d numbers leave a task.
* Plane rotations, d / 2 disjoint ones at a time, make R's columns orthogonal.  The rotations accumulated are the
  components, the lengths of the columns over sqrt(n) the standard deviations: no covariance matrix is formed, so that small ones are
  as accurate as large ones.
* All rows are projected.

Rows with a null vector, or with null or non-finite entries, or with one of 2^47 and more, whose x isn't exact, are left out, as are
those whose length isn't the one that most distinct vectors have (of several such, the longest).  An empty table, or one vector alone,
gives no rows: there are no more components than directions in which the fit list varies.  Rows that repeat a vector or an id, or
have a null id, each get their own rows.  A `deviation` beyond a long is null.  Only the two named columns are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, scratch, table

#: Fixed by the contract: how an entry becomes a whole number.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows of a block of the QR, and triangles that a task of the tree joins.
BLOCK, FAN_IN = 4096, 16
SWEEPS = 60
LARGEST = float(1 << 53)
EPS = np.finfo(float).eps


def quantised(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): whole numbers for the vectors whose entries are all there and finite."""
    entries = F.col(vector).cast("array<double>")
    fine = F.forall(entries, lambda c: F.abs(c * SCALE) < LARGEST)  # NaN counts as larger
    return df.where(fine).select(F.col(key).alias(key), F.transform(entries, lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches):
    """Per task, for each dimension, sums of x's lower 32 bits and of the rest; the count of rows as dimension -1."""
    low = high = np.int64(0)
    rows = 0
    for batch in batches:
        x = _matrix(batch.column(0))
        low, high, rows = low + (x & 0xFFFFFFFF).sum(axis=0), high + (x >> 32).sum(axis=0), rows + len(x)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(low)), pa.int32()), pa.array(np.concatenate([[rows], low])), pa.array(np.concatenate([[0], high]))], ["i", "low", "high"])


class Centre:
    """The fit list's mean as S / n = base + rest / n, with whole base and 0 <= rest < n."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.base = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact."""
        away = x - self.base
        most = self.n * (int(np.abs(away).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * away - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * away.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact.tolist()]


def _square(r: np.ndarray, d: int) -> np.ndarray:
    return np.vstack([r, np.zeros((max(0, d - len(r)), d))])[:d]


def _one_row(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ravel(v)], pa.list_(pa.float64())) for v in columns.values()], list(columns))


def _triangle(centre: Centre, d: int):
    """The R of a task's rows."""
    def run(batches):
        r, some = np.zeros((0, d)), False
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), BLOCK):
                r, some = np.linalg.qr(np.vstack([r, centre.of(x[at : at + BLOCK])]), mode="r"), True
        if some:
            yield _one_row(r=_square(r, d))

    return run


def _joined(d: int):
    """The R of several."""
    def run(batches):
        r, some = np.zeros((0, d)), False
        for batch in batches:
            for own in _matrix(batch.column(0)):
                r, some = np.linalg.qr(np.vstack([r, own.reshape(d, d)]), mode="r"), True
        if some:
            yield _one_row(r=_square(r, d))

    return run


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d columns as rounds of disjoint ones: one place stands, the others go round."""
    ring = list(range(d + d % 2))
    out = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(p), max(p)) for p in zip(ring[:half], ring[: half - 1 : -1], strict=True) if max(p) < d]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(V, lengths): r @ V has orthogonal columns of these lengths, longest first."""
    d = r.shape[1]
    u, v = r.astype(float), np.eye(d)
    rounds = _rounds(d)
    for _ in range(SWEEPS):
        order = np.argsort(-(u * u).sum(axis=0), kind="stable")
        u, v, turned = u[:, order], v[:, order], False
        for p, q in rounds:
            a, b = u[:, p], u[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            turn = np.abs(ab) > EPS * np.sqrt(aa) * np.sqrt(bb)
            if not turn.any():
                continue
            turned = True
            p, q, aa, bb, ab = p[turn], q[turn], aa[turn], bb[turn], ab[turn]
            z = (bb - aa) / (2 * ab)
            t = np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1, z))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (u, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        if not turned:
            break
    lengths = np.sqrt((u * u).sum(axis=0))
    order = np.argsort(-lengths, kind="stable")
    return v[:, order], lengths[order]


def _decomposed(d: int):
    def run(batches):
        for batch in batches:
            for own in _matrix(batch.column(0)):
                v, lengths = jacobi(own.reshape(d, d))
                yield _one_row(v=v, lengths=lengths)

    return run


class Whitening:
    """What fit() learns: the centre and, for each component, direction, standard deviation and share of the variance."""

    def __init__(self, centre: Centre, v: np.ndarray, lengths: np.ndarray, components: int) -> None:
        sure = lengths > lengths.max(initial=0) * len(lengths) * 8 * EPS
        k = min(components, int(sure.sum()))
        self.centre, self.v, self.deviations = centre, v[:, :k], lengths[:k] / np.sqrt(centre.n)
        self.explained = lengths[:k] ** 2 / max((lengths**2).sum(), np.finfo(float).tiny)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.centre.of(x) @ self.v / self.deviations


def _moments(model: Whitening):
    """Per task, what covariances of the whitened rows add up from: rows are centred within their batch before multiplying."""
    def run(batches):
        for batch in batches:
            w = model.of(_matrix(batch.column(0)))
            mean = w.mean(axis=0)
            inner = (w - mean).T @ (w - mean)
            values = np.concatenate([(inner + len(w) * np.outer(mean, mean)).ravel(), len(w) * mean])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["i", "value"])

    return run


def fit(fit_list: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Learns from a written table of distinct vectors x of length d.  Only sums, of d numbers, and the last R's components reach the driver."""
    totals = {r.i: r.low + (r.high << 32) for r in fit_list.mapInArrow(_sums, "i int, low bigint, high bigint").groupBy("i").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).collect()}
    if not totals or d == 0:
        return None
    centre = Centre(totals[-1], [totals[i] for i in range(d)])
    triangles = keep(fit_list.mapInArrow(_triangle(centre, d), "r array<double>"), "triangles")
    many = triangles.count()
    while many > 1:
        many = -(-many // FAN_IN)
        triangles = triangles.repartition(many).mapInArrow(_joined(d), "r array<double>")
    # where fewer rows came than parts, some parts had none
    found = triangles.mapInArrow(_decomposed(d), "v array<double>, lengths array<double>").first()
    model = Whitening(centre, np.array(found.v).reshape(d, d), np.array(found.lengths), components)
    return model if len(model.deviations) else None


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k, n = len(model.deviations), model.centre.n
    sums = {r.i: r.value for r in fit_list.mapInArrow(_moments(model), "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()}
    values = np.array([sums[i] for i in range(k * k + k)])
    mean = values[k * k :] / n
    return float(np.abs(values[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def _projected(model: Whitening, error: float):
    k = len(model.deviations)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            rows = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(model.centre.deviation(x), pa.int64()).take(pa.array(rows))
            columns = [batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), model.centre.n)), deviation, pa.array(model.of(x).ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(rows), error))]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each row with a usable vector and each component: key, component (from 1), n, deviation, whitened, explained, identity_error."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = quantised(df, key, vector)
    with scratch(df.sparkSession):
        all_lengths = keep(rows.select("x").distinct(), "fit-list")
        commonest = all_lengths.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        d = commonest.d if commonest else 0
        fit_list = all_lengths.where(F.size("x") == d)
        model = fit(fit_list, d, components)
        if model is None:
            return df.sparkSession.createDataFrame([], schema)
        error = identity_error(fit_list, model)
    return rows.where(F.size("x") == d).mapInArrow(_projected(model, error), schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
