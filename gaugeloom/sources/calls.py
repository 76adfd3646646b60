"""Answers of a model to prompts, kept in a ledger: a prompt that was answered isn't asked again, whatever is retried.

Distinct prompts are dealt to buckets by their hash.  A task asks a few prompts of a bucket at once, tries again with growing pauses, and adds answers to
the bucket's files as it goes; it begins by reading them, so that a task that starts anew, or another run, goes on where the last one stopped.  No more than `flush`
answers of a task are lost with it.  A prompt that can't be answered is an error in its rows, and is asked again by the next run.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER = "key string, response string, attempts int"
_ARROW = pa.schema([("key", pa.string()), ("response", pa.string()), ("attempts", pa.int32())])


def tried(f: Callable[[str], str], prompt: str, attempts: int, wait: float) -> tuple[str | None, str | None, int]:
    """(response, error, attempts made): pauses double, from `wait` seconds, with up to half of each added at random."""
    for n in range(1, attempts + 1):
        try:
            return str(f(prompt)), None, n
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if n < attempts and wait > 0:
                time.sleep(wait * 2 ** (n - 1) * (1 + random.random() / 2))
    return None, error, attempts


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _answered(files: fs.FileSystem, folder: str) -> set[str]:
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return {k for x in found if x.base_name.endswith(".parquet") for k in pq.read_table(x.path, filesystem=files, columns=["key"], partitioning=None)["key"].to_pylist()}


def _asking(f: Callable[[str], str], ledger: str, at_once: int, attempts: int, wait: float, flush: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _store(ledger)
        bucket, known = None, set()
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for own, rows in batch.groupby("bucket", sort=False):
                    folder = f"{root}/bucket={own}"
                    if own != bucket:
                        bucket, known = own, _answered(files, folder)
                    rows = rows[~rows["key"].isin(known)]
                    for at in range(0, len(rows), flush):
                        some = rows.iloc[at : at + flush]
                        got = list(pool.map(lambda p: tried(f, p, attempts, wait), some["prompt"]))
                        good = [(k, r, n) for k, (r, e, n) in zip(some["key"], got, strict=True) if e is None]
                        if good:
                            files.create_dir(folder, recursive=True)
                            to = f"{folder}/.{uuid.uuid4().hex}"
                            pq.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*good, strict=True), _ARROW.types, strict=True)], schema=_ARROW), to, filesystem=files)
                            files.move(to, to.replace("/.", "/part-") + ".parquet")  # whole, or not there
                        yield pd.DataFrame([(k, e, n) for k, (_, e, n) in zip(some["key"], got, strict=True) if e is not None], columns=["key", "error", "attempts"])

    return run


def ask(df: DataFrame, prompt: str, f: Callable[[str], str], ledger: str, at_once: int = 4, attempts: int = 3, wait: float = 0.5, flush: int = 32, out: str = "response") -> DataFrame:
    """df with `out`, `error` and `attempts` for each prompt; f is asked once for each distinct prompt that the ledger, a folder that all
    executors and the driver can write, has no answer to.  Null prompts have neither."""
    spark = df.sparkSession
    files, root = _store(ledger)
    files.create_dir(root, recursive=True)
    uri = ledger if "://" in ledger or ledger.startswith("file:") else f"file://{root}"
    key = F.sha2(F.col(prompt), 256)
    read = lambda: spark.read.schema(LEDGER).option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.parquet").parquet(uri)
    wanted = df.where(F.col(prompt).isNotNull()).groupBy(key.alias("key")).agg(F.first(prompt).alias("prompt")).join(read().select("key"), "key", "left_anti")
    bucket = F.substring("key", 1, 4)  # a bucket of its own for each 65,536th of all keys keeps its name, however many prompts there are
    dealt = wanted.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket")
    failed_at = f"{uri}/_failed/{uuid.uuid4().hex}"
    dealt.mapInPandas(_asking(f, ledger, at_once, attempts, wait, flush), "key string, error string, attempts int").write.parquet(failed_at)
    failed = spark.read.schema("key string, error string, attempts int").parquet(failed_at).select("key", F.lit(None).cast("string").alias("response"), "error", "attempts")
    answers = read().dropDuplicates(["key"]).select("key", "response", F.lit(None).cast("string").alias("error"), "attempts")
    told = answers.unionByName(failed).select(F.col("key").alias("_key"), F.col("response").alias(out), "error", "attempts")
    return df.withColumn("_asked", key).join(told, F.col("_asked") == F.col("_key"), "left").drop("_asked", "_key")
