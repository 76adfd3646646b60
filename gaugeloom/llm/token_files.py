"""Token-id files: every id in the fewest bits that hold the vocabulary, in blocks for random access.

A file, all numbers little-endian: the 8 bytes MAGIC; blocks of BLOCK ids (the last may be
shorter), bit i of an id at bit i after the id before it, each block padded to whole bytes; then
the index: int64 block offsets (one more than blocks), int64 document starts (one more than
documents), int64 document ids, uint8 marks of null ids; then the footer FOOTER.  A file is written under
another name and moved, so a task that runs again replaces its file and no reader sees a part.

Documents are range-partitioned and sorted by id, a file for each partition; a manifest
has a row for each file.  Null and empty texts have only the end id.  Null ids come first, repeated
ids in the order of their texts' hashes; each row is one document.  An empty table gives no file, and no rows.
Only the named columns are looked at.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches as B
from .common import fresh_path, keep, table, whole_text
from .tokens import LETTERS, default_vocabulary, encoder

MAGIC = b"GLTOKEN1"
BLOCK = 1 << 16
FOOTER = struct.Struct("<qqqqq")  # bits, ids, blocks, documents, where the index begins
END_ID = 2
MANIFEST = "first bigint, shard int, path string, n_docs bigint, n_tokens bigint"


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flags @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    def __init__(self, path: str, bits: int) -> None:
        self.fs, self.path = _filesystem(path)
        self.temporary = f"{self.path}.{os.getpid()}.part"
        self.bits, self.held, self.n_held, self.n = bits, [], 0, 0
        self.offsets, self.starts, self.keys, self.nulls = [len(MAGIC)], [0], [], []
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(0 if key is None else key)
        self.nulls.append(key is None)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        self.starts.append(self.n)
        if self.n_held >= BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate([*self.held, np.empty(0, np.uint32)])
        stop = len(ids) if last else len(ids) - len(ids) % BLOCK
        for at in range(0, stop, BLOCK):
            data = pack_bits(ids[at : min(at + BLOCK, stop)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._blocks(True)
        for values, kind in ((self.offsets, "<i8"), (self.starts, "<i8"), (self.keys, "<i8"), (self.nulls, "<u1")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(FOOTER.pack(self.bits, self.n, len(self.offsets) - 1, len(self.keys), self.offsets[-1]))
        self.out.close()
        self.fs.move(self.temporary, self.path)


class Reader:
    def __init__(self, path: str) -> None:
        where, name = _filesystem(path)
        self.file = where.open_input_file(name)
        if self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.bits, self.n_tokens, blocks, self.n_docs, index = FOOTER.unpack(self._read(self.file.size() - FOOTER.size, FOOTER.size))
        data = self._read(index, self.file.size() - FOOTER.size - index)
        self.offsets = np.frombuffer(data, "<i8", blocks + 1)
        self.starts = np.frombuffer(data, "<i8", self.n_docs + 1, 8 * (blocks + 1))
        self.keys = np.frombuffer(data, "<i8", self.n_docs, 8 * (blocks + self.n_docs + 2))
        self.nulls = np.frombuffer(data, "<u1", self.n_docs, 8 * (blocks + 2 * self.n_docs + 2)).astype(bool)
        self.last = -1, np.empty(0, np.uint32)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> np.ndarray:
        if self.last[0] != i:
            data = self._read(int(self.offsets[i]), int(self.offsets[i + 1] - self.offsets[i]))
            self.last = i, unpack_bits(data, min(BLOCK, self.n_tokens - i * BLOCK), self.bits)
        return self.last[1]

    def pieces(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids from start to stop, block by block."""
        while start < stop:
            i, at = divmod(start, BLOCK)
            ids = self.block(i)[at : at + stop - start]
            yield ids
            start += len(ids)

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint32), *self.pieces(start, stop)])

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files and gives their manifest, kept in the shared folder."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        shard = TaskContext.get().partitionId()
        to, first = f"{path}/part-{shard:06d}.tokens", None
        end, out, n_docs = np.array([end_id], np.uint32), None, 0
        encode = encoder(vocabulary)
        for batch in batches:
            for part, _, _ in B.chunks(batch, text, LETTERS):
                for k, ids in zip(part.column(0).to_pylist(), encode.encode(part.column(1).to_pylist()), strict=True):
                    if out is None:
                        out, first = Writer(to, bits_for(max(encode.size, end_id + 1))), k
                    out.add(k, np.concatenate([ids, end]))
                    n_docs += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int64()), "shard": pa.array([shard], pa.int32()), "path": [to], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([out.n], pa.int64())})

    rows = docs.select(F.col(key).cast("bigint").alias(key), whole_text(text).alias(text))
    ordered = rows.repartitionByRange(key).sortWithinPartitions(F.col(key).asc_nulls_first(), F.xxhash64(text))
    return keep(ordered.mapInArrow(B.giving_back(run), MANIFEST), "manifest")


def read(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    files = sorted(manifest.collect(), key=lambda r: (r.first is not None, r.first, r.shard))  # a row for each file
    before, rows = 0, []
    for r in files:
        rows.append((r.path, before))
        before += r.n_tokens

    def run(batches):
        for batch in batches:
            for path, base in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                file = Reader(path)
                for at in range(0, file.n_docs, 10_000):
                    starts, crcs = file.starts[at : at + 10_001], []
                    for a, b in zip(starts[:-1], starts[1:], strict=True):
                        crc = 0
                        for ids in file.pieces(int(a), int(b)):
                            crc = zlib.crc32(ids.astype("<u4"), crc)
                        crcs.append(crc)
                    keys = pa.array(file.keys[at : at + 10_000], mask=file.nulls[at : at + 10_000])
                    yield pa.RecordBatch.from_arrays([keys, pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "path string, base bigint").repartition(max(1, len(rows)))
    return listed.mapInArrow(B.giving_back(run), f"{key} bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens")))


QUERIES = {"op3_token_files": op3_token_files}
