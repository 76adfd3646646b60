"""Sources whose bad rows come back named by file and line, with a reason, instead of failing the job.

Lines are numbered across the splits of a file: a scan counts each split's rows, their prefix sums say where a split begins, and a second scan numbers
its rows from there.  Any store that Spark reads will do.  Suites in YAML or JSON are parsed on the workers, one file at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, line from 1, blank ones counted."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    splits = read.groupBy("file", "block").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = splits.select("file", "block", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return read.join(begin, ["file", "block"]).select("file", (F.col("place") + F.col("shift")).alias("line"), "value")


def checked_json(spark: SparkSession, path: str, schema: str, required: list[str], rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): rows of JSON lines with file and line; rejected (file, line, reason, value).

    A line is rejected if it isn't a JSON object, lacks a required key, or fails a rule: reason -> condition on `raw`, a function of a key's text.
    Blank lines are passed over."""
    lines = numbered_lines(spark, path).where(F.btrim("value", F.lit(" \t\r\n")) != "")
    keys = F.json_object_keys("value")
    parsed = F.try_parse_json("value")
    missing = F.array_except(F.array(*map(F.lit, required)), F.coalesce(keys, F.array().cast("array<string>")))
    reason = F.when(parsed.isNull(), F.lit("invalid JSON")).when(keys.isNull(), F.lit("not an object")).when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    for why, holds in (rules or {}).items():
        reason = reason.when(~F.coalesce(holds, F.lit(False)), F.lit(why))
    told = lines.withColumn("reason", reason)
    good = told.where("reason IS NULL").select("file", "line", F.from_json("value", schema).alias("row")).select("file", "line", "row.*")
    return good, told.where("reason IS NOT NULL").select("file", "line", "reason", "value")


def key_text(key: str) -> Column:
    """What a line's key holds, as text."""
    return F.get_json_object("value", f"$.{key}")


def checked_entries(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of JSON files that each hold an object or an array of objects; rows come with file and entry, from 0; rejected (file, entry, reason).
    A file that is no JSON, or whose JSON is neither, is rejected whole, its entry null."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    kind = F.substring(F.btrim("value", F.lit(" \t\r\n")), 1, 1)
    broken = F.when(F.try_parse_json("value").isNull(), F.lit("invalid JSON")).when(~kind.isin("{", "["), F.lit("neither an object nor an array"))
    files = files.withColumn("broken", broken)
    listed = F.when(kind == "{", F.concat(F.lit("["), F.col("value"), F.lit("]"))).otherwise(F.col("value"))
    each = files.where("broken IS NULL").select("file", F.posexplode(F.from_json(listed, "array<string>")).alias("entry", "value"))
    keys = F.json_object_keys("value")
    missing = F.array_except(F.array(*map(F.lit, required)), F.coalesce(keys, F.array().cast("array<string>")))
    each = each.withColumn("reason", F.when(keys.isNull(), F.lit("not an object")).when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))))
    good = each.where("reason IS NULL").select("file", "entry", F.from_json("value", schema).alias("row")).select("file", "entry", "row.*")
    whole = files.where("broken IS NOT NULL").select("file", F.lit(None).cast("int").alias("entry"), F.col("broken").alias("reason"))
    return good, each.where("reason IS NOT NULL").select("file", "entry", "reason").unionByName(whole)


def _fits(value, kind: T.DataType) -> bool:
    if value is None:
        return True
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(_fits(v, kind.elementType) for v in value)
    if isinstance(kind, (T.MapType, T.StructType)):
        return isinstance(value, dict)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, T.NumericType):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, (str, int, float, bool))


def _suite_rows(text: str, cases: str, kinds: T.StructType, required: list[str]) -> Iterator[tuple]:
    """(line, settings, case, reason) of a suite's cases; a suite that has none of that shape gives one reason."""
    import yaml

    try:
        node, found = yaml.compose(text, yaml.SafeLoader), yaml.safe_load(text)
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        yield (mark.line + 1 if mark else None), None, None, "invalid YAML"
        return
    if not isinstance(found, dict):
        yield 1, None, None, "not a mapping"
        return
    listed = found.get(cases, [])
    at = next((v for k, v in node.value if k.value == cases), None)
    if not isinstance(listed, list):
        yield at.start_mark.line + 1, None, None, f"{cases} is not a list"
        return
    settings = json.dumps({k: v for k, v in found.items() if k != cases}, default=str)
    for own, case in zip(at.value if at else [], listed, strict=True):
        line = own.start_mark.line + 1
        if not isinstance(case, dict):
            yield line, settings, None, "not a mapping"
            continue
        lacking = [f for f in required if f not in case]
        wrong = [f.name for f in kinds if f.name in case and not _fits(case[f.name], f.dataType)]
        reason = f"missing {', '.join(lacking)}" if lacking else f"{', '.join(wrong)}: not {', '.join(kinds[w].dataType.simpleString() for w in wrong)}" if wrong else None
        yield line, settings, json.dumps(case, default=str), reason


def suites(spark: SparkSession, path: str, case_schema: str, required: list[str], settings_schema: str = "suite string, threshold double", cases: str = "cases") -> tuple[DataFrame, DataFrame]:
    """(cases, rejected) of suites in YAML or JSON: cases with file, line and the suite's settings; rejected (file, line, reason).

    A case is rejected if it isn't a mapping, lacks a required field, or has one of another type than case_schema says; a file if it doesn't parse or has no list of cases."""
    kinds = T.StructType.fromDDL(case_schema)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, text in zip(batch["file"], batch["value"], strict=True):
                yield pd.DataFrame([(file, *r) for r in _suite_rows(text, cases, kinds, required)], columns=["file", "line", "settings", "case", "reason"]).astype({"line": "Int64"})

    rows = files.mapInPandas(parse, "file string, line bigint, settings string, case string, reason string")
    good = rows.where("reason IS NULL").select("file", "line", F.from_json("settings", settings_schema).alias("s"), F.from_json("case", case_schema).alias("c"))
    return good.select("file", "line", "s.*", "c.*"), rows.where("reason IS NOT NULL").select("file", "line", "reason")
