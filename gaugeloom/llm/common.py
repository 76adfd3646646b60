"""What the operators of this subpackage share: tables, shared folders, batches of texts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local session may lack the setting."""
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    global _own
    _own = _own or f"file://{tempfile.mkdtemp(prefix='gaugeloom-')}"
    return _own


_own = ""
_kept: dict[str, SparkSession] = {}
_open: list[set[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends, if not before."""
    path = f"{shared_dir(spark)}/gaugeloom-{name}-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(_drop_all)
    _kept[path] = spark
    if _open:
        _open[-1].add(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _kept.pop(path, None)


def _drop_all() -> None:
    for path, spark in list(_kept.items()):
        if spark._sc._jsc is None:
            continue
        try:
            drop_path(spark, path)
        except Exception as e:  # the session may be gone by now; the files are only temporary
            print(f"{path} stays: {type(e).__name__}")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here and a
    lost executor costs nothing that was written.  The shuffles that made it go: Spark removes
    them once the driver has collected what refers to them, which it is asked to do here."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    df.sparkSession._jvm.System.gc()
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._gaugeloom_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Removes tables that keep() gave and that nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t._gaugeloom_path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Removes at its end, or at an error, all that was kept within, but for what was passed to the function it gives."""
    own: set[str] = set()
    results: set[str] = set()
    _open.append(own)

    def hold(df: DataFrame, name: str) -> DataFrame:
        out = keep(df, name)
        results.add(out._gaugeloom_path)
        return out

    try:
        yield hold
    finally:
        _open.remove(own)
        if _open:
            _open[-1] |= results
        for path in own - results:
            if path in _kept:
                drop_path(spark, path)


def sampled(key: Column, group: Column, sizes: dict, wanted: int) -> Column:
    """Whether a row is in the sample of about `wanted` rows of its group, or all if there are fewer.  sizes: rows of each group.
    A key's 64-bit hash decides, so it holds for groups of any size."""
    share = F.lit(-1).cast("bigint")
    for name, n in sorted(sizes.items()):
        share = F.when(group == name, F.lit(min(1, Fraction(wanted, n)) * ((1 << 63) - 1) // 1).cast("bigint")).otherwise(share)
    return F.xxhash64(key).bitwiseAND(F.lit((1 << 63) - 1)) <= share


def whole_text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
