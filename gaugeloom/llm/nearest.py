"""Approximate nearest neighbours by largest inner product: balanced posting lists.

* Distinct vectors are classes; a class needs its least ids only, one more than are asked for, as no answer holds more.
* Inner products become distances: with M the longest vector's length, x gets one more entry, sqrt(M^2 - |x|^2), and a query
  is scaled to length M.
* A sample of up to SAMPLE classes is halved again and again, each time into equal numbers between two means, down to
  about LIST classes a list.  The leaves' means are the centroids, at most SAMPLE / LEAST_LEAF.
* The centroids are searched by an in-memory graph: neighbours that are nearer to the centroid than to each other, and the leaves beside it.
  From some entries spread over the tree the search goes on until no centroid within the bound has neighbours not seen.
* Boundary classes are replicated: to up to REPLICAS lists whose centroid is at most CLOSURE times as far as the nearest.
* A query's lists are those within a ratio of its distance to the nearest centroid.  The ratios, one for each BANDS-th of the sample's queries
  by that distance, are those that find RECALL of the sample's own neighbours.  Nearest lists are added until they must hold enough classes.
* Lists are kept in groups of LISTS, which are cut into blocks of about BLOCK entries when there are more.  Each block meets the queries
  that probe it, streamed; its best answers are measured again on the original vectors, and each query's are merged.

Only the sample, the centroids and counts of lists are on the driver, all bounded.  Every class is in a list.

Vectors that are null, zero, or hold null or non-finite entries take no part, nor do rows with a null id or whose length isn't the one that most
classes have (of several such, the longest).  A query's own row isn't a candidate; rows that repeat an id are candidates each, and a query
whose id and vector are repeated is one query, with its other rows as candidates.  Ties go to the smaller id.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, scratch, table

NEAREST = 20
#: Classes that the index learns from, by rows and by entries of their vectors.
SAMPLE, SAMPLE_ENTRIES = 65_536, 8_000_000
LIST, LEAST_LEAF = 256, 16
REPLICAS, CLOSURE = 3, 1.1
LISTS, BLOCK = 32, 16_384
DEGREE, NEIGHBOURS, ENTRIES = 12, 24, 16
#: Centroids that a search looks beyond at least: of a class to be listed, of a query.
LEAST_SEEN, LEAST_ASKED = 8, 16
BANDS, CALIBRATED, RECALL = 4, 512, 0.98
#: Rows searched or answered at a time.
SEARCHED, ANSWERED = 128, 128
SCHEMA = "g int, b int, kind int, key bigint, id bigint, list int, ids array<bigint>, v array<double>"


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: F.abs(c) < float("inf")) & F.exists(v, lambda c: c != 0)  # NaN counts as larger
    return df.where(fine & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0)


def halved(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Rows of x in leaves of up to `leaf`, neighbours in the tree side by side.  Each cut is at the median between two means."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        own, half = x[rows], len(rows) // 2
        a = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
        b = own[np.argmax(((own - a) ** 2).sum(axis=1))]
        for _ in range(5):
            order = np.argsort(own @ (a - b), kind="stable")
            a, b = own[order[half:]].mean(axis=0), own[order[:half]].mean(axis=0)
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


def graph(c: np.ndarray) -> np.ndarray:
    """Neighbours of each centroid: of the nearest those that are nearer to it than to a neighbour chosen before, and the leaves beside it."""
    k, many = len(c), min(NEIGHBOURS, len(c) - 1)
    out = np.tile(np.arange(k)[:, None], (1, DEGREE + 2))
    out[1:, -2], out[:-1, -1] = np.arange(k - 1), np.arange(1, k)
    for at in range(0, k if many else 0, 256):
        own = np.arange(at, min(at + 256, k))
        d = _distances(c[own], c)
        d[np.arange(len(own)), own] = np.inf
        near = np.argpartition(d, many - 1, axis=1)[:, :many]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
        to = np.take_along_axis(d, near, axis=1)
        chosen, count = np.zeros((len(own), many), bool), np.zeros(len(own), int)
        for j in range(many):
            between = ((c[near[:, : j + 1]] - c[near[:, j]][:, None, :]) ** 2).sum(axis=2)[:, :j]
            good = ~(chosen[:, :j] & (between < to[:, j, None])).any(axis=1) & (count < DEGREE)
            chosen[:, j] = good
            rows = np.flatnonzero(good)
            out[own[rows], count[rows]] = near[rows, j]
            count += good
    return out


class Index:
    """Centroids, their graph, and how far a query looks."""

    def __init__(self, x: np.ndarray, longest: float, leaf: int, nearest: int) -> None:
        self.longest = longest
        lifted = self.lift(x)
        self.centroids = np.array([lifted[rows].mean(axis=0) for rows in halved(lifted, leaf)])
        self.squares = (self.centroids**2).sum(axis=1)
        self.graph = graph(self.centroids)
        self.entries = np.unique(np.linspace(0, len(self.centroids) - 1, ENTRIES).astype(int))
        self.calibrate(x, lifted, nearest)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1, keepdims=True), 0))])

    def asking(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q * (self.longest / np.sqrt((q * q).sum(axis=1, keepdims=True))), np.zeros((len(q), 1))])

    def walk(self, x: np.ndarray, ratio, least: int) -> np.ndarray:
        """Squared distances to the centroids seen, infinite for the others: all within ratio (a function of the distance to the nearest) and the `least` nearest are looked beyond."""
        k = len(self.centroids)
        d = np.full((len(x), k), np.inf)
        d[:, self.entries] = _distances(x, self.centroids[self.entries])
        fresh = np.isfinite(d)
        squares, least = (x * x).sum(axis=1), min(least, k) - 1
        while True:
            nearest = d.min(axis=1)
            bound = np.maximum(ratio(np.sqrt(nearest)) ** 2 * nearest, np.partition(d, least, axis=1)[:, least])
            rows, at = np.nonzero(fresh & (d <= bound[:, None]))
            if not len(rows):
                return d
            fresh[rows, at] = False
            code = np.unique((rows[:, None] * k + self.graph[at]).ravel())
            rows, at = np.divmod(code[~np.isfinite(d.ravel()[code])], k)
            d[rows, at] = np.maximum(squares[rows] + self.squares[at] - 2 * np.einsum("ij,ij->i", x[rows], self.centroids[at]), 0)
            fresh[rows, at] = True

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): up to REPLICAS lists of each vector."""
        d = self.walk(self.lift(x), lambda _: 1.0, LEAST_SEEN)
        many = min(REPLICAS, d.shape[1])
        near = np.argpartition(d, many - 1, axis=1)[:, :many]
        own = np.take_along_axis(d, near, axis=1)
        return (r := np.nonzero(own <= CLOSURE**2 * own.min(axis=1, keepdims=True)))[0], near[r]

    def ratio(self, nearest: np.ndarray) -> np.ndarray:
        return self.ratios[np.searchsorted(self.edges, nearest)]

    def calibrate(self, x: np.ndarray, lifted: np.ndarray, nearest: int) -> None:
        """The ratios that find RECALL of the sample's neighbours, by the distance of queries to the nearest centroid."""
        some = np.unique(np.linspace(0, len(x) - 1, CALIBRATED).astype(int))
        many = min(nearest, len(x) - 1)
        best = np.zeros((len(some), many), int)
        for at in range(0, len(some) if many else 0, 16):
            met = x[some[at : at + 16]] @ x.T
            met[np.arange(len(met)), some[at : at + 16]] = -np.inf
            best[at : at + 16] = np.argpartition(met, met.shape[1] - many, axis=1)[:, -many:]
        away = np.sqrt(_distances(self.asking(x[some]), self.centroids))
        first = away.min(axis=1)
        needed = np.full(best.size, np.inf)
        wanted = best.ravel()
        for at in range(0, len(wanted), SEARCHED):
            rows, lists = self.lists_of(x[wanted[at : at + SEARCHED]])
            np.minimum.at(needed, at + rows, away[(at + rows) // max(1, many), lists])
        needed = needed.reshape(best.shape) / np.maximum(first, 1e-12)[:, None]
        self.edges = np.quantile(first, np.arange(1, BANDS) / BANDS)
        band = np.searchsorted(self.edges, first)
        self.ratios = np.array([max(1.0, np.quantile(own, RECALL)) if (own := needed[band == i]).size else 1.0 for i in range(BANDS)])

    def probes(self, q: np.ndarray, sizes: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists that each query looks at, which hold `enough` entries if all do."""
        x = self.asking(q)
        d = self.walk(x, self.ratio, LEAST_ASKED)
        nearest = d.min(axis=1)
        take = d <= (self.ratio(np.sqrt(nearest)) ** 2 * nearest)[:, None]
        for row in np.flatnonzero(take @ sizes < min(enough, sizes.sum())):
            order = np.argsort(_distances(x[row : row + 1], self.centroids)[0], kind="stable")
            take[row, order[: 1 + np.searchsorted(np.cumsum(sizes[order]), min(enough, sizes.sum()))]] = True
        return np.nonzero(take)


def _listed(index):
    """Entries of the posting lists."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SEARCHED):
                part = batch.slice(at, SEARCHED)
                rows, lists = index.value.lists_of(_matrix(part.column("v")))
                rows, lists = pa.array(rows), pa.array(lists, pa.int32())
                yield pa.RecordBatch.from_arrays([lists, part.column("cid").take(rows), part.column("ids").take(rows), part.column("v").take(rows)], ["list", "cid", "ids", "v"])

    return run


def _asked(index, sizes: np.ndarray, blocks: np.ndarray, enough: int):
    """A row for each query and each block of the groups that it probes, with the lists."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SEARCHED):
                part = batch.slice(at, SEARCHED)
                rows, lists = index.value.probes(_matrix(part.column("v")), sizes, enough)
                groups = lists // LISTS
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (groups[1:] != groups[:-1])  # lists come in order
                begin = np.flatnonzero(new)
                probed = pa.ListArray.from_arrays(pa.array(np.append(begin, len(rows)), pa.int32()), pa.array(lists, pa.int64()))
                times = blocks[groups[begin]]
                each = np.repeat(np.arange(len(begin)), times)
                block = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                row, n = pa.array(rows[begin][each]), len(each)
                yield pa.RecordBatch.from_arrays([pa.array(groups[begin][each], pa.int32()), pa.array(block, pa.int32()), pa.array(np.ones(n, np.int32)), part.column("uid").take(row), part.column("id").take(row), pa.nulls(n, pa.int32()), probed.take(pa.array(each)), part.column("v").take(row)], ["g", "b", "kind", "key", "id", "list", "ids", "v"])

    return run


class _Block:
    """Entries of a block, in order of their lists."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        whole = pa.Table.from_batches(parts).combine_chunks()
        whole = whole.take(np.argsort(whole["list"].to_numpy(), kind="stable"))
        self.lists, self.v = whole["list"].to_numpy(), _matrix(whole["v"].combine_chunks())
        self.cid, ids = whole["key"].to_numpy(), whole["ids"].combine_chunks()
        self.counts, self.ids = ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
        self.first = np.cumsum(self.counts) - self.counts
        self.longest = np.sqrt((self.v**2).sum(axis=1).max(initial=0))

    def answers(self, q: np.ndarray, own_id: np.ndarray, probes: pa.ListArray, nearest: int) -> tuple[np.ndarray, ...]:
        """(row, score, id, class, place in the class) of each query's best, in order of rows."""
        met = np.full((len(q), len(self.v)), -np.inf)
        row, probed = np.repeat(np.arange(len(q)), probes.value_lengths().to_numpy()), probes.flatten().to_numpy()
        order = np.argsort(probed, kind="stable")
        row, probed = row[order], probed[order]
        for each in np.unique(probed):
            of, at = row[slice(*np.searchsorted(probed, [each, each + 1]))], slice(*np.searchsorted(self.lists, [each, each + 1]))
            met[of, at] = q[of] @ self.v[at].T
        many = (nearest + 1) * REPLICAS
        if met.shape[1] > many:
            least = np.partition(met, met.shape[1] - many, axis=1)[:, -many]
            slack = 1e-9 * self.longest * np.sqrt((q * q).sum(axis=1))
            met[met < (least - slack)[:, None]] = -np.inf
        r, c = np.nonzero(met > -np.inf)
        score = (q[r] * self.v[c]).sum(axis=1)  # in one order of the dimensions, wherever the vector is
        same = (q[r] == self.v[c]).all(axis=1)
        n = self.counts[c]
        each = np.repeat(np.arange(len(r)), n)
        place = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        r, c, score, same = r[each], c[each], score[each], same[each]
        ids = self.ids[self.first[c] + place]
        mine = np.flatnonzero(same & (ids == own_id[r]))
        keep_ = np.ones(len(r), bool)
        keep_[mine[np.unique(each[mine], return_index=True)[1]]] = False  # the query's own row; one that repeats it stays
        r, score, ids, cid, place = (x[keep_] for x in (r, score, ids, self.cid[c], place))
        order = np.lexsort([place, cid, ids, -score, r])
        r, score, ids, cid, place = (x[order] for x in (r, score, ids, cid, place))
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (cid[1:] != cid[:-1]) | (place[1:] != place[:-1])  # replicas of a class follow each other
        r, score, ids, cid, place = (x[new] for x in (r, score, ids, cid, place))
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        return tuple(x[rank < nearest] for x in (r, score, ids, cid, place))


def _answered(nearest: int):
    """Of rows sorted by block, entries before queries: the best of the block for each query."""
    def run(batches):
        at, parts, block = None, [], None
        for batch in batches:
            g, b, kind = (batch.column(c).to_numpy() for c in ("g", "b", "kind"))
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(g)], strict=True):
                if start == stop:
                    continue
                if at != (g[start], b[start]):
                    at, parts, block = (g[start], b[start]), [], None
                part = batch.slice(start, stop - start)
                if kind[start] == 0:
                    parts.append(part)
                    continue
                if block is None and parts:
                    block, parts = _Block(parts), []
                for i in range(0, part.num_rows if block else 0, ANSWERED):
                    some = part.slice(i, ANSWERED)
                    r, *hits = block.answers(_matrix(some.column("v")), some.column("id").to_numpy(), some.column("ids"), nearest)
                    hits = pa.StructArray.from_arrays([pa.array(0.0 - hits[0]), pa.array(hits[1]), pa.array(hits[2]), pa.array(hits[3], pa.int64())], ["far", "vec_id", "cid", "place"])
                    edges = pa.array(np.searchsorted(r, np.arange(some.num_rows + 1)), pa.int32())
                    yield pa.RecordBatch.from_arrays([some.column("key"), some.column("id"), pa.ListArray.from_arrays(edges, hits)], ["uid", "query_id", "hits"])

    return run


def classes(rows: DataFrame, nearest: int) -> DataFrame:
    """(v, ids, cid): distinct vectors with their least ids.  Spark keeps the first rows of a group before it shuffles."""
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    some = rows.withColumn("n", first).where(F.col("n") <= nearest + 1)
    return some.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cid", F.monotonically_increasing_id())


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of the rows for which `queries` (on the column `id`) holds."""
    with scratch(df.sparkSession) as hold:
        return hold(_search(df, queries, key, vector, nearest), "nearest")


def _search(df: DataFrame, queries: Column, key: str, vector: str, nearest: int) -> DataFrame:
    spark = df.sparkSession
    rows = usable(df, key, vector)
    all_classes = keep(classes(rows, nearest), "classes")
    lengths = all_classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("longest"))
    commonest = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if commonest is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    d, n = commonest.d, commonest.n
    own = all_classes.where(F.size("v") == d)
    wanted = max(1, min(SAMPLE, SAMPLE_ENTRIES // d))
    share = min(wanted, n) * ((1 << 63) - 1) // n
    x = _matrix(own.where(F.xxhash64("v").bitwiseAND(F.lit((1 << 63) - 1)) <= share).orderBy(F.xxhash64("v")).select("v").toArrow()["v"].combine_chunks())
    index = spark.sparkContext.broadcast(Index(x, float(np.sqrt(commonest.longest)), max(LEAST_LEAF, LIST * len(x) // n) if len(x) < n else LIST, nearest))
    del x

    listed = keep(own.mapInArrow(_listed(index), "list int, cid bigint, ids array<bigint>, v array<double>"), "postings")
    sizes = np.zeros(len(index.value.centroids), np.int64)
    for r in listed.groupBy("list").count().collect():
        sizes[r.list] = r["count"]
    blocks = np.maximum(1, -(-np.add.reduceat(sizes, np.arange(0, len(sizes), LISTS)) // BLOCK))
    asked = keep(rows.where(queries & (F.size("v") == d)).distinct().withColumn("uid", F.monotonically_increasing_id()), "queries")
    probing = asked.mapInArrow(_asked(index, sizes, blocks, REPLICAS * (nearest + 1)), SCHEMA)

    group = F.floor(F.col("list") / LISTS).cast("int")
    of_group = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), group + 1)
    entries = listed.select(group.alias("g"), F.pmod(F.xxhash64("cid"), of_group).cast("int").alias("b"), F.lit(0).alias("kind"), F.col("cid").alias("key"), F.lit(None).cast("bigint").alias("id"), "list", "ids", "v")
    met = entries.unionByName(probing).repartition("g", "b").sortWithinPartitions("g", "b", "kind")
    found = met.mapInArrow(_answered(nearest), "uid bigint, query_id bigint, hits array<struct<far double, vec_id bigint, cid bigint, place bigint>>")
    best = found.groupBy("uid", "query_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))), 1, nearest).alias("hits"))
    return best.select("query_id", F.posexplode("hits").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", (F.lit(0.0) - F.col("hit.far")).alias("score"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


QUERIES = {"op13_nearest": op13_nearest}
