"""Best-fit packing of documents into sequences of at most `capacity` tokens, by minimum bin slack.

Documents longer than that are cut into whole pieces; what is over is the first piece.  Packing
depends on lengths alone, so it is planned on the number of pieces of each length: a table of at most
`capacity` rows, whatever the input.  Each bin takes the longest piece left; a subset-sum over a bitset of
the lengths left finds the fullest combination that goes with it.  The same combination is used as often as
the lengths last, so every pattern uses up at least one length's share.  Then pieces are numbered within their
length, over hashed parts so that a frequent length is split too, and a number tells the sequence and place.

Null and empty texts are the end id alone.  Repeated rows are packed each.  An empty table gives no
rows.  Only the named columns are looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import batches as B
from .common import keep, table, whole_text
from .tokens import LETTERS, default_vocabulary, encoder

CAPACITY = 2048
END_ID = 0
#: About how many pieces a hashed part has.
PART = 20_000


def fullest(counts: dict[int, int], order: list[int], space: int) -> list[int]:
    """The lengths, each at most as often as counted, whose sum is largest within space."""
    reach, steps, full = 1, [], (1 << space + 1) - 1
    for length in order:
        if length > space:
            continue
        for _ in range(min(counts[length], space // length)):
            more = reach | reach << length & full
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach >> space & 1:
            break
    left, taken = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            taken.append(length)
            left -= length
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (how often each length) and how many sequences have each."""
    left = {n: k for n, k in counts.items() if k}
    order, out = sorted(left, reverse=True), []
    while order:
        longest = order[0]
        left[longest] -= 1
        pattern = Counter([longest, *fullest(left, order, capacity - longest)])
        left[longest] += 1
        times = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
        order = [n for n in order if left[n]]
        out.append((dict(pattern), times))
    return out


class Places:
    """Where the pieces of each length go, by their number within the length."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]) -> None:
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        used: Counter = Counter()
        sequence = 0
        for pattern, times in patterns:
            offset = 0
            for length, k in pattern.items():
                runs.setdefault(length, []).append((used[length], sequence, k, offset))
                used[length] += k * times
                offset += k * length
            sequence += times
        self.runs = {n: np.array(x, np.int64).T for n, x in runs.items()}
        self.sequences = sequence

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            mine = np.flatnonzero(length == n)
            first, base, k, at = self.runs[int(n)]
            i = np.searchsorted(first, number[mine], "right") - 1
            turn, slot = np.divmod(number[mine] - first[i], k[i])
            sequence[mine], offset[mine] = base[i] + turn, at[i] + slot * n
        return sequence, offset


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n else []


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each document, the end id included."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        encode, end = encoder(vocabulary), np.array([end_id], np.uint32)
        for batch in batches:
            for part, _, _ in B.chunks(batch, text, LETTERS):
                rows, numbers = [], []
                for i, ids in enumerate(encode.encode(part.column(1).to_pylist())):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    for p, (start, n) in enumerate(cut(len(ids), capacity)):
                        numbers.append(i)
                        rows.append((p, start, n, zlib.crc32(ids[start : start + n])))
                p, start, n, crc = np.array(rows, np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(numbers, pa.int64())), pa.array(p, pa.int32()), pa.array(start), pa.array(n), pa.array(crc)], [key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, whole_text(text).alias(text)).mapInArrow(B.giving_back(run), f"{key} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def assign(found: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (key, piece, length, ids_crc32 and others), which must be a kept table."""
    parts = max(1, -(-found.count() // PART))
    placed = keep(found.withColumn("part", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(parts))), "pieces")
    counts = keep(placed.groupBy("length", "part").count(), "lengths")  # at most capacity rows for each part
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most capacity rows
    places = found.sparkSession.sparkContext.broadcast(Places(plan(totals, capacity)))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy(key, "piece", "ids_crc32")) - 1
    numbered = placed.withColumn("number", within).join(before, ["length", "part"]).withColumn("number", F.col("number") + F.col("before")).drop("before", "part")

    def run(batches):
        for batch in batches:
            sequence, offset = places.value.of(*[batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number")])
            kept = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number")
    return numbered.mapInArrow(B.giving_back(run), f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    out = assign(keep(pieces(docs, key, text, capacity, vocabulary, end_id), "cut"), key, capacity)
    return out.select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_pack": op7_pack}
