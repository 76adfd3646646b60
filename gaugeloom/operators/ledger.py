"""Append-only run ledgers: recent rows, baselines, differences, pass rates, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.functions import verdicts


def recent(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in the order given, whose last column must tell rows apart."""
    return df.orderBy(*order).limit(n)


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of each key the first row in the order given: what an upsert by key would have left."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def top_per_group(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def since(df: DataFrame, ts: str, as_of: Column, interval: str, n: int | None = None) -> DataFrame:
    """Rows of the trailing interval up to as_of; with n, the newest n of them, newest first."""
    rows = df.where((F.col(ts) > as_of - F.expr(f"INTERVAL {interval}")) & (F.col(ts) <= as_of))
    return rows if n is None else rows.orderBy(F.desc(ts), *df.columns).limit(n)


def baseline(df: DataFrame, keys: list[str], score: str, passed: str, order: Column, n: int = 5) -> DataFrame:
    """(keys, baseline): the mean of the n most recent passing scores."""
    return top_per_group(df.where(passed), keys, n, order).groupBy(*keys).agg(F.avg(score).alias("baseline"))


def diff(df: DataFrame, keys: list[str], commit: str, score: str, a: str, b: str) -> DataFrame:
    """(keys, score_a, score_b, delta): mean scores of two commits side by side, in one scan; delta is null unless both are there."""
    of = lambda c: F.avg(F.when(F.col(commit) == c, F.col(score)))
    both = df.where(F.col(commit).isin(a, b)).groupBy(*keys).agg(of(a).alias("score_a"), of(b).alias("score_b"))
    return both.withColumn("delta", F.col("score_b") - F.col("score_a"))


def gate(df: DataFrame, score: str, base: str, mode: str, hard: float = 0.70, drop: float = 0.05) -> DataFrame:
    """df with should_fail and reason.  hard: below a floor; regression: more than `drop` below the baseline, if there is one; soft: never."""
    s, b = F.col(score), F.col(base)
    if mode == "hard":
        fail, why = s < hard, F.format_string(f"score %.3f, floor {hard}", s)
    elif mode == "regression":
        fail = F.coalesce(b - s > drop, F.lit(False))
        why = F.when(b.isNull(), F.format_string("score %.3f, no baseline yet", s)).otherwise(F.format_string("score %.3f, baseline %.3f", s, b))
    elif mode == "soft":
        fail, why = F.lit(False), F.format_string("score %.3f, warning only", s)
    else:
        raise ValueError(f"no such mode: {mode}")
    return df.withColumns({"should_fail": fail, "reason": why})


def half_drift(df: DataFrame, keys: list[str], ts: str, passed: str, as_of: Column, days: int = 30, points: float = 5.0) -> DataFrame:
    """(keys, current, prior, drift_pp, has_drift, n): pass rates of the later and the earlier half of the last days, in one scan."""
    begin, middle = as_of - F.expr(f"INTERVAL {days} DAYS"), as_of - F.expr(f"INTERVAL {days // 2} DAYS")
    ok = F.col(passed).cast("int")
    rates = df.where(F.col(ts) >= begin).groupBy(*keys).agg(F.avg(F.when(F.col(ts) >= middle, ok)).alias("current"), F.avg(F.when(F.col(ts) < middle, ok)).alias("prior"), F.count("*").alias("n"))
    change = (F.col("current") - F.col("prior")) * 100
    return rates.withColumns({"drift_pp": change, "has_drift": F.coalesce(F.round(F.abs(change), 9) >= points, F.lit(False))})


def fidelity_drift(df: DataFrame, keys: list[str], score: str, order: Column, window: int = 50, base: int = 200) -> DataFrame:
    """(keys, n, mean, std, drift_detected, trend): the recent mean against the longer baseline's mean less its standard deviation, and
    the newer half of the recent rows against the older."""
    rows = top_per_group(df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))), keys, base, order)
    size = F.least(F.count("*").over(Window.partitionBy(*keys)), F.lit(window))
    rows = rows.withColumn("_mid", F.floor(size / 2))
    new = F.col("_n") <= F.least(F.lit(window), F.col("_mid"))
    old = (F.col("_n") > F.col("_mid")) & (F.col("_n") <= window)
    in_window = F.col("_n") <= window
    s = F.col(score)
    out = rows.groupBy(*keys).agg(F.count_if(in_window).alias("n"), F.avg(F.when(in_window, s)).alias("mean"), F.stddev_pop(F.when(in_window, s)).alias("std"), F.avg(s).alias("_base"), F.stddev_pop(s).alias("_std"), F.avg(F.when(new, s)).alias("_new"), F.avg(F.when(old, s)).alias("_old"))
    enough = F.col("n") >= 3
    change = F.col("_new") - F.col("_old")
    trend = F.when(F.col("n") < 10, "INSUFFICIENT_DATA").when(F.abs(change) < 0.02, "STABLE").when(change < 0, "DEGRADING").otherwise("IMPROVING")
    return out.select(*keys, "n", F.when(enough, F.col("mean")).otherwise(0.0).alias("mean"), F.when(enough, F.col("std")).otherwise(0.0).alias("std"), (enough & (F.col("mean") < F.col("_base") - F.col("_std")) & (F.col("_std") > 1e-6)).alias("drift_detected"), trend.alias("trend"))


def contract_list(df: DataFrame, keys: list[str], ts: str, passed: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col(passed)).alias("passed_count"), F.max(ts).alias("last_seen"), F.avg(F.col(passed).cast("int")).alias("pass_rate"))


def violation_rates(df: DataFrame, keys: list[str], passed: str) -> DataFrame:
    """(keys, n, rate, severity)"""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.count_if(~F.col(passed)) / F.count("*")).alias("rate"))
    return out.withColumn("severity", verdicts.severity(F.col("rate")))


def pass_rates(df: DataFrame, keys: list[str], ts: str, passed: str, as_of: Column | None = None, days: int | None = None) -> DataFrame:
    """(keys, pass_rate, n): of all rows, or of the last days up to as_of; null for a key of the ledger that has none there."""
    within = F.lit(True) if days is None else (F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= as_of)
    return df.groupBy(*keys).agg(F.avg(F.when(within, F.col(passed).cast("int"))).alias("pass_rate"), F.count_if(within).alias("n"))


def recent_violation_rates(df: DataFrame, keys: list[str], ts: str, passed: str, as_of: Column, hours: float = 24.0) -> DataFrame:
    """(keys, n, rate) of the trailing hours; a key of the ledger without rows there has rate 0."""
    within = (F.col(ts) > as_of - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")) & (F.col(ts) <= as_of)
    out = df.groupBy(*keys).agg(F.count_if(within).alias("n"), F.count_if(within & ~F.col(passed)).alias("_failed"))
    return out.select(*keys, "n", F.when(F.col("n") > 0, F.col("_failed") / F.col("n")).otherwise(0.0).alias("rate"))


def trim_history(runs: DataFrame, keys: list[str], ratio: str, dropped: str, within: str, *order: Column, n: int = 1000) -> DataFrame:
    """(keys, total_runs, over_budget_runs, avg_trim_ratio, avg_dropped_count) of each key's last n runs, rounded to 4 and 2 digits."""
    last = top_per_group(runs, keys, n, *order)
    sums = last.groupBy(*keys).agg(F.count("*").alias("total_runs"), F.count_if(~F.col(within)).alias("over_budget_runs"), F.avg(ratio).alias("_ratio"), F.avg(dropped).alias("_dropped"))
    return sums.select(*keys, "total_runs", "over_budget_runs", F.round("_ratio", 4).alias("avg_trim_ratio"), F.round("_dropped", 2).alias("avg_dropped_count"))


def field_rates(df: DataFrame, results: str) -> DataFrame:
    """(field, n, rate): share of failures of each field of a map of results."""
    each = df.select(F.explode(results).alias("field", "ok"))
    return each.groupBy("field").agg(F.count("*").alias("n"), F.round(F.count_if(~F.col("ok")) / F.count("*"), 4).alias("rate"))


def compare_maps(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """(key, score_a, score_b, delta): full outer join, missing scores 0."""
    both = a.select(key, F.col(score).alias("score_a")).join(b.select(key, F.col(score).alias("score_b")), key, "full_outer")
    filled = both.select(key, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("score_a", "score_b")])
    return filled.withColumn("delta", F.col("score_b") - F.col("score_a"))


def largest_changes(compared: DataFrame, n: int, key: str) -> DataFrame:
    """The n largest changes either way of compare_maps(), largest first."""
    return compared.orderBy(F.desc(F.abs("delta")), key).limit(n)


def side_by_side(df: DataFrame, keys: list[str], label: str, score: str, a: str, b: str) -> DataFrame:
    """(keys, a, b, winner): mean scores of two labels; a missing one counts as 0, and a tie goes to the first."""
    of = lambda v: F.avg(F.when(F.col(label) == v, F.col(score)))
    both = df.where(F.col(label).isin(a, b)).groupBy(*keys).agg(of(a).alias("a"), of(b).alias("b"))
    return both.withColumn("winner", F.when(F.coalesce("a", F.lit(0.0)) >= F.coalesce("b", F.lit(0.0)), F.lit(a)).otherwise(F.lit(b)))


def average_scores(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(keys, score, n): the mean of each prompt's runs of an evaluation, for gate()."""
    return df.groupBy(*keys).agg(F.avg(score).alias("score"), F.count("*").alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values of a column that there are, sorted."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def delete_keys(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")
