"""Sinks: append-only ledgers, upserts resolved when read, deletes, reports as JSON and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeloom.operators.ledger import delete_keys, latest_per_key

SHORT = 500


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Adds rows to a ledger."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def append_evals(df: DataFrame, path: str) -> None:
    """Adds evaluation runs; inputs and outputs are cut at SHORT characters."""
    append(df.withColumns({c: F.left(F.col(c), F.lit(SHORT)) for c in ("input", "output") if c in df.columns}), path)


def upsert(df: DataFrame, path: str, seq: str = "_seq") -> None:
    """Adds rows whose keys may be there already; read_upserted() gives the last ones.  seq tells which are last."""
    append(df if seq in df.columns else df.withColumn(seq, F.unix_micros(F.current_timestamp())), path)


def read_upserted(spark: SparkSession, path: str, keys: list[str], seq: str = "_seq") -> DataFrame:
    return latest_per_key(spark.read.parquet(path), keys, F.desc(seq)).drop(seq)


def delete(spark: SparkSession, path: str, gone: DataFrame, key: str, to: str) -> None:
    """Writes the ledger without some keys to another path; a table isn't read and overwritten at once."""
    delete_keys(spark.read.parquet(path), gone, key).write.mode("overwrite").parquet(to)


def as_json(df: DataFrame, out: str = "report") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def from_json(df: DataFrame, schema: str, column: str = "report") -> DataFrame:
    return df.select(F.from_json(column, schema).alias("_r")).select("_r.*")


def bars(df: DataFrame, label: str, score: str, width: int = 10) -> DataFrame:
    """(label, line): a bar of blocks for each score by the largest, for a heat map in text."""
    most = df.agg(F.max(score).alias("_most"))
    n = F.when(F.col("_most") > 0, F.round(width * F.col(score) / F.col("_most"))).otherwise(0).cast("int")
    return df.crossJoin(F.broadcast(most)).select(label, F.concat_ws(" ", F.col(label).cast("string"), F.repeat(F.lit("█"), n), F.format_number(score, 3)).alias("line"))


def report_text(title: str, df: DataFrame, most: int = 50) -> str:
    """A report of at most `most` rows as text, for the console."""
    rows = df.limit(most).collect()
    return "\n".join([title, *["  " + ", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows]])


def report_markdown(title: str, df: DataFrame, most: int = 50) -> str:
    """A report of at most `most` rows as a table in Markdown; bars and line breaks within cells don't break it."""
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    rows = [[cell(r[c]) for c in df.columns] for r in df.limit(most).collect()]
    lines = ["| " + " | ".join(x) + " |" for x in ([*map(cell, df.columns)], ["---"] * len(df.columns), *rows)]
    return "\n".join([f"## {title}", "", *lines])


def save_report(df: DataFrame, path: str) -> None:
    """A report's rows as JSON lines; load_report() reads them."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
