"""Scans: JSON lines of cases and labels, messages, traces, text lines, suites; bad rows are kept apart, not lost."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import checked

CASE = "input string, output string, expected_output string"
LABEL = "input string, output string, human_score double"
PAIR = "prompt string, cot_chain string, with_cot_output string, without_cot_output string"
COHERENCE_CASE = "id string, steps array<string>, conclusion string, expect string"


def cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, rejected) of JSON lines: file, line, input, output, expected_output.  Rejected lines don't parse or lack an input."""
    return checked.checked_json(spark, path, CASE, ["input"])


def human_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, rejected) of JSON lines: labels have an input, an output and a score within 0 and 1."""
    score = checked.key_text("human_score").try_cast("double")
    good, bad = checked.checked_json(spark, path, "input string, output string, human_score string", ["input", "output", "human_score"], {"human_score is no number": score.isNotNull() & ~F.isnan(score), "human_score must be between 0 and 1": score.between(0, 1)})
    return good.withColumn("human_score", F.col("human_score").cast("double")), bad


def messages(spark: SparkSession, path: str) -> DataFrame:
    """(conv, turn, role, content) of JSON files, each an array of messages; conv is the file's path."""
    rows = spark.read.text(path, wholetext=True)
    parsed = rows.select(F.input_file_name().alias("conv"), F.from_json("value", "array<struct<role:string,content:string>>").alias("m"))
    return parsed.select("conv", F.posexplode("m").alias("turn", "m")).select("conv", "turn", "m.role", "m.content")


def step_traces(spark: SparkSession, path: str) -> DataFrame:
    """(run, step, output, goal) of JSON files {"goal": .., "steps": [..]}; steps are strings or objects with an output."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("run"), F.from_json("value", "goal string, steps array<string>").alias("t"))
    each = rows.select("run", F.col("t.goal").alias("goal"), F.posexplode("t.steps").alias("step", "raw"))
    return each.select("run", "step", F.coalesce(F.get_json_object("raw", "$.output"), F.col("raw")).alias("output"), "goal")


def fidelity_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, rejected) of JSON files, each an object or an array of them: file, entry, prompt, cot_chain (empty if not there), with_cot_output, without_cot_output."""
    good, bad = checked.checked_entries(spark, path, PAIR, ["prompt", "with_cot_output", "without_cot_output"])
    return good.withColumn("cot_chain", F.coalesce("cot_chain", F.lit(""))), bad


def coherence_suites(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, rejected) of reasoning suites: file, line, suite (the file's name if not given), threshold (0.55), id (`?`), steps, conclusion, expect (COHERENT)."""
    good, bad = checked.suites(spark, path, COHERENCE_CASE, ["steps", "conclusion"])
    given = {"suite": F.element_at(F.split("file", "/"), -1), "threshold": F.lit(0.55), "id": F.lit("?"), "expect": F.lit("COHERENT")}
    return good.withColumns({c: F.coalesce(c, v) for c, v in given.items()}), bad


def output_lines(spark: SparkSession, path: str) -> DataFrame:
    """(output): the lines of text files, trimmed, without blank ones."""
    return spark.read.text(path).select(F.btrim("value", F.lit(" \t\r")).alias("output")).where("output <> ''")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("text"))


def glob_regex(pattern: str) -> str:
    """A regular expression for a path pattern with **, * and ?."""
    out = ""
    for part in re.split(r"(\*\*/?|\*|\?)", pattern):
        out += {"**": ".*", "**/": "(?:.*/)?", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def matching_files(df: DataFrame, path: str, patterns: list[str]) -> DataFrame:
    """(path): the distinct changed files that match any pattern."""
    return df.where(F.col(path).rlike("|".join(map(glob_regex, patterns)))).select(path).distinct()
