"""Attribution of an output to context chunks by masking, from vectors or similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attribution(df: DataFrame, keys: list[str], similarity: str) -> DataFrame:
    """(keys, score, mean_similarity, std_similarity, runs): how far the output moves when the chunk is masked."""
    out = df.groupBy(*keys).agg(F.avg(similarity).alias("mean_similarity"), F.stddev_pop(similarity).alias("std_similarity"), F.count("*").alias("runs"))
    return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("mean_similarity"))))


def gate(scores: DataFrame, keys: list[str], chunk: str, score: str, must: str | None = None, least: float = 0.30, most: float | None = None, contributing: int | None = None) -> DataFrame:
    """(keys, violations, passed): a chunk that must reach `least`, a limit for every chunk, a number of chunks that must contribute."""
    s = F.col(score)
    sums = scores.groupBy(*keys).agg(F.max(F.when(F.col(chunk) == must, s)).alias("_must"), F.max(s).alias("_most"), F.count_if(s >= least).alias("_many"))
    rules = []
    if must is not None:
        rules.append(F.when(F.coalesce(F.col("_must") < least, F.lit(True)), F.lit(f"{must} below {least}")))
    if most is not None:
        rules.append(F.when(F.col("_most") > most, F.lit(f"a chunk above {most}")))
    if contributing is not None:
        rules.append(F.when(F.col("_many") < contributing, F.lit(f"fewer than {contributing} contribute")))
    found = F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")
    return sums.select(*keys, found.alias("violations"), (F.size(found) == 0).alias("passed"))


def calls(n_chunks: int, runs: int, most_calls: int = 500, cost: float = 0.001, most_cost: float | None = None) -> tuple[int, float]:
    """How many calls an attribution takes and what they cost; raises if that is beyond the budget."""
    n = n_chunks * runs
    if n > most_calls or (most_cost is not None and n * cost > most_cost):
        raise ValueError(f"{n} calls for {n * cost:.3f} are over the budget")
    return n, n * cost
