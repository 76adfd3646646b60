"""Progress towards a goal, stuck steps, and their longest run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.functions import verdicts

from .similarity import versus


def steps(df: DataFrame, run: str, step: str, text: str, goal: str, epsilon: float = 0.05) -> DataFrame:
    """(run, step, progress, delta, stuck).  The first step's delta is its progress; a step is stuck if its delta is less than epsilon
    either way."""
    progress = versus(df, [run, step], text, goal, "progress").drop("progress_counts")
    order = Window.partitionBy(run).orderBy(step)
    delta = F.col("progress") - F.coalesce(F.lag("progress").over(order), F.lit(0.0))
    return progress.withColumn("delta", delta).withColumn("stuck", F.abs("delta") < epsilon)


def longest_runs(df: DataFrame, run: str, step: str, flag: str) -> DataFrame:
    """(run, longest, start, end): the first longest run of true flags by step numbers, ends included; 0 and nulls if there is none."""
    order = Window.partitionBy(run).orderBy(step)
    numbered = df.select(run, step, flag, F.row_number().over(order).alias("_n")).withColumn("_island", F.col("_n") - F.row_number().over(Window.partitionBy(run, flag).orderBy(step)))
    islands = numbered.where(flag).groupBy(run, "_island").agg(F.count("*").alias("len"), F.min(step).alias("start"), F.max(step).alias("end"))
    best = islands.groupBy(run).agg(F.max_by(F.struct("len", "start", "end"), F.struct(F.col("len"), -F.col("start"))).alias("b"))
    return df.select(run).distinct().join(best, run, "left").select(run, F.coalesce("b.len", F.lit(0)).cast("bigint").alias("longest"), F.col("b.start").alias("start"), F.col("b.end").alias("end"))


def report(made: DataFrame, run: str, step: str, tier: str = "HIGH", k: int = 5, band: float = verdicts.BAND) -> DataFrame:
    """One row per run of steps(): score (share of stuck steps), mean delta, longest stuck run, whether it is a livelock, verdict, gate,
    recommendation."""
    sums = made.groupBy(run).agg(F.count("*").alias("n_steps"), F.count_if("stuck").alias("n_stuck"), F.avg("delta").alias("mean_progress"))
    both = sums.join(longest_runs(made, run, step, "stuck"), run)
    score = F.col("n_stuck") / F.col("n_steps")
    out = both.withColumn("score", score).withColumn("detected", F.col("longest") >= k)
    calm = F.when(F.col("score") < 0.05, F.lit("progressing")).otherwise(F.format_string("mostly progressing, score %.3f", "score"))
    advice = F.when(~F.col("detected"), calm).otherwise(F.format_string("stuck from step %d for %d steps, score %.3f", "start", "longest", "score"))
    return out.select(run, "n_steps", "n_stuck", "score", "mean_progress", "longest", "start", "end", "detected", verdicts.livelock(F.col("score"), tier, band).alias("verdict"), (F.col("score") <= verdicts.LIVELOCK[tier]).alias("gate_passed"), advice.alias("recommendation"))
