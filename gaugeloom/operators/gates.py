"""Reads of a ledger, joins of runs with what they are held against, rollups of suites, and gates on their figures.

A gate adds `passed`; `errors.require` raises where it is false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import top_per_group


def where_equal(df: DataFrame, column: str, value, *order: Column) -> DataFrame:
    """The rows with such a value, in the order given."""
    rows = df.where(F.col(column) == F.lit(value))
    return rows.orderBy(*order) if order else rows


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The rows with this id: none or one where ids are distinct."""
    return df.where(F.col(key) == F.lit(value))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def at_least(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.where(F.col(score) >= threshold)


def split_rules(rules: Column, passed: str, severity: str, critical: float = 0.7) -> dict[str, Column]:
    """Of an array of results: those that failed, that passed, and that failed with a severity of at least `critical`."""
    return {
        "failed": F.filter(rules, lambda r: ~r[passed]),
        "succeeded": F.filter(rules, lambda r: r[passed]),
        "critical": F.filter(rules, lambda r: ~r[passed] & (r[severity] >= critical)),
    }


def zipped(a: Column, b: Column) -> Column:
    """Array of (a, b) by position; lists of different lengths are an error."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("a"), b.alias("b"))).otherwise(F.raise_error(F.lit("lists differ in length")))


def clause_of(verdicts: DataFrame, clauses: DataFrame, keys: list[str], index: str, text: str, out: str = "clause") -> DataFrame:
    """verdicts with the clause that their index names, `unknown` where there is none."""
    return verdicts.join(clauses.select(*keys, index, F.col(text).alias(out)), [*keys, index], "left").withColumn(out, F.coalesce(out, F.lit("unknown")))


def paired(baseline: DataFrame, candidate: DataFrame, keys: list[str], response: str) -> DataFrame:
    """(keys, baseline, candidate) of the tests that both have answered."""
    return baseline.select(*keys, F.col(response).alias("baseline")).join(candidate.select(*keys, F.col(response).alias("candidate")), keys)


def expanded(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """The children of those parents."""
    return children.join(parents.select(F.col(parent_key).alias("_parent")).distinct(), F.col(child_key) == F.col("_parent"), "left_semi")


def suite_counts(df: DataFrame, keys: list[str], actual: Column, expected: Column) -> DataFrame:
    """(keys, total, n_passed, n_failed): how many came out as expected."""
    same = F.coalesce(actual.eqNullSafe(expected), F.lit(False))
    return df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(same).alias("n_passed"), F.count_if(~same).alias("n_failed"))


# fixed value: what is said of a case that couldn't be evaluated
CASE_FAILED = "Calibration case '%s' failed: %s"


def calibration(cases: DataFrame, keys: list[str], original: str, mutant: str, changed: Column, severity: str, advice: str, delta: float = 0.15, order: str | None = None, error: str | None = None, description: str | None = None) -> DataFrame:
    """(keys, calibration_score, total, caught, missed, warnings): the share of applicable cases whose score falls by `delta`, and, in the order of the cases (of the advice
    without one), the advice of the HIGH ones missed and what failed.  Cases that change nothing or failed don't count; without any, the score is 0."""
    broke = F.col(error).isNotNull() if error else F.lit(False)
    caught = F.col(original) - F.col(mutant) >= delta
    rows = cases.where(changed).withColumns({"_broke": broke, "_caught": F.coalesce(caught, F.lit(False))}).withColumn("_counts", ~F.col("_broke"))
    said = F.format_string(CASE_FAILED, F.col(description or advice), F.col(error)) if error else F.lit(None).cast("string")
    told = F.when(F.col("_broke"), said).when(~F.col("_caught") & (F.col(severity) == "HIGH"), F.col(advice))
    warning = F.when(told.isNotNull(), F.struct(F.col(order or advice).alias("at"), told.alias("text")))
    counted = F.col("_counts") & F.col("_caught")
    sums = rows.groupBy(*keys).agg(F.avg(F.when(F.col("_counts"), F.col("_caught").cast("int"))).alias("calibration_score"), F.count_if("_counts").alias("total"), F.count_if(counted).alias("caught"), F.transform(F.sort_array(F.collect_list(warning)), lambda w: w["text"]).alias("warnings"))
    every = cases.select(*keys).distinct() if keys else cases.sparkSession.range(1).drop("id")
    whole = every.join(sums, keys, "left") if keys else sums
    zero = {"calibration_score": F.lit(0.0), "total": F.lit(0).cast("bigint"), "caught": F.lit(0).cast("bigint"), "warnings": F.array().cast("array<string>")}
    return whole.withColumns({c: F.coalesce(c, v) for c, v in zero.items()}).withColumn("missed", F.col("total") - F.col("caught"))


def trend(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows, oldest first."""
    return df.orderBy(*order).limit(n)


def best(df: DataFrame, keys: list[str], score: str, *order: Column) -> DataFrame:
    """Of each key the row with the largest score; `order` decides among equals."""
    return top_per_group(df, keys, 1, F.desc(score), *order)


def last_n_gate(df: DataFrame, keys: list[str], passed: str, n: int, *order: Column) -> DataFrame:
    """(keys, n, n_failed, passed): whether none of the last n runs failed."""
    rows = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(passed), F.lit(False))).alias("n_failed"))
    return out.withColumn("passed", F.col("n_failed") == 0)


def share_gate(df: DataFrame, keys: list[str], holds: Column, least: float | None = None, most: float | None = None) -> DataFrame:
    """(keys, n, rate, passed): the share of rows for which something holds, at least `least` and at most `most`.  Faithful verdicts, passes and
    violations are gated in this way.  Without rows and keys the rate is null, and it doesn't pass."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.coalesce(holds, F.lit(False)).cast("int")).alias("rate"))
    ok = F.lit(True)
    if least is not None:
        ok &= F.col("rate") >= least
    if most is not None:
        ok &= F.col("rate") <= most
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))


def score_gate(df: DataFrame, score: str, least: float | None = None, most: float | None = None) -> DataFrame:
    """df with passed: whether a stored score is within bounds.  A drift score passes up to its threshold, a mutation, calibration, stability or
    attribution score from its threshold on; a missing score doesn't pass."""
    ok = F.col(score).isNotNull()
    if least is not None:
        ok &= F.col(score) >= least
    if most is not None:
        ok &= F.col(score) <= most
    return df.withColumn("passed", F.coalesce(ok, F.lit(False)))
