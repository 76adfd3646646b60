"""Pathologies of agent runs, step by step: futile cycles, oscillation, stalls, drift, abandonment.

Every step gets the report that the steps up to it allow.  One window, by run and step, serves all detectors: similarities to the
one, two, three or four steps before are computed once for each step and then looked up from later ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.functions import text as X


@dataclass(frozen=True)
class Thresholds:
    cycle: float
    window: int
    oscillation: float
    stall: float
    drift: float
    abandon: float


# fixed values: thresholds by sensitivity
SENSITIVITY = {
    "LOW": Thresholds(0.90, 5, 0.80, 0.85, 0.15, 0.10),
    "MEDIUM": Thresholds(0.80, 4, 0.70, 0.75, 0.25, 0.15),
    "HIGH": Thresholds(0.65, 3, 0.55, 0.60, 0.35, 0.25),
}
#: In the order in which ties of confidence are settled.
PATHOLOGIES = ("cycle", "oscillation", "stall", "drift", "abandonment")


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def detect(df: DataFrame, run: str, step: str, tokens: str, task: list[str], milestones: list[str], sensitivity: str = "MEDIUM") -> DataFrame:
    """df's run and step with a confidence for each pathology (null: not found), the best one, its severity and confidence.

    tokens: a column of token sets.  task, milestones: distinct tokens.
    """
    t = SENSITIVITY[sensitivity]
    w = Window.partitionBy(run).orderBy(step)
    words = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    back = lambda c, k: F.lag(c, k).over(w) if k else F.col(c)
    reach = t.window - 1
    rows = df.select(run, step, F.col(tokens).alias("_t")).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumns({f"_b{d}": F.lag("_t", d).over(w) for d in range(1, max(reach, 2) + 1)})
    rows = rows.withColumns({f"_s{d}": F.when(F.col(f"_b{d}").isNotNull(), X.jaccard(F.col("_t"), F.col(f"_b{d}"))) for d in range(1, max(reach, 2) + 1)} | {"_task": X.jaccard(F.col("_t"), words(task))})

    enough = F.col("_n") >= t.window
    similar = _sum([back(f"_s{d}", k) for d in range(1, reach + 1) for k in range(t.window - d)]) / (t.window * reach // 2)
    steady = _sum([back("_s1", k) for k in range(reach)]) / reach
    recent = F.flatten(F.array("_t", *[F.coalesce(F.col(f"_b{d}"), F.array().cast("array<string>")) for d in range(1, reach + 1)]))
    overlap = F.size(F.array_intersect(words(milestones), recent)) / F.lit(max(len(milestones), 1))
    alternates = (back("_s2", 1) >= t.oscillation) & (F.col("_s2") >= t.oscillation) & (back("_s1", 2) < t.oscillation)
    early = (F.nth_value("_task", 1).over(w) + F.nth_value("_task", 2).over(w) + F.nth_value("_task", 3).over(w)) / 3
    late = (F.col("_task") + back("_task", 1) + back("_task", 2)) / 3
    rows = rows.withColumns({"_similar": F.when(enough, similar), "_steady": F.when(enough, steady), "_overlap": overlap, "_osc": F.when(alternates, (back("_s2", 1) + F.col("_s2")) / 2), "_late": late, "_fall": early - late, "_held": (F.col("_s1") + back("_s1", 1)) / 2})

    # the first alternation within the last six steps
    first = F.first("_osc", ignorenulls=True).over(w.rowsBetween(-2, 0))
    over = lambda x, limit: F.least(F.lit(1.0), (x - limit) / (1.0 - limit) + 0.5)
    has_task = F.lit(bool(task))
    found = {
        "cycle": F.when(F.col("_similar") >= t.cycle, over(F.col("_similar"), t.cycle)),
        "oscillation": F.when(first.isNotNull(), over(first, t.oscillation)),
        "stall": F.when((F.col("_steady") >= t.stall) & (F.col("_overlap") < 0.3), F.least(F.lit(1.0), F.col("_steady") * 0.7 + (1 - F.col("_overlap")) * 0.3)),
        "drift": F.when(has_task & (F.col("_n") >= 3) & (F.col("_fall") > t.drift) & (F.col("_late") < 0.3), F.least(F.lit(1.0), F.col("_fall") / 0.5 * 0.7 + 0.3)),
        "abandonment": F.when(has_task & (F.col("_n") >= 5) & (F.col("_late") < t.abandon) & (F.col("_held") > 0.5), F.least(F.lit(1.0), (1 - F.col("_late")) * 0.5 + F.col("_held") * 0.5)),
    }
    rows = rows.withColumns(found)
    critical = {"cycle": F.col("_similar") > 0.9, "oscillation": F.lit(True), "stall": F.lit(False), "drift": F.col("_fall") > 0.5, "abandonment": F.lit(True)}
    best = F.array_max(F.array_compact(F.array(*[F.when(F.col(p).isNotNull(), F.struct(F.col(p).alias("confidence"), F.lit(-i).alias("rank"), F.lit(p).alias("pathology"), F.when(critical[p], "critical").otherwise("warning").alias("severity"))) for i, p in enumerate(PATHOLOGIES)])))
    return rows.withColumn("_best", best).select(run, step, *PATHOLOGIES, F.col("_best.pathology").alias("pathology"), F.col("_best.severity").alias("severity"), F.col("_best.confidence").alias("confidence"))


def summary(reports: DataFrame, run: str) -> DataFrame:
    """One row per run: steps, reports, health (1 less the share of steps with a report), verdict."""
    sums = reports.groupBy(run).agg(F.count("*").alias("n_steps"), F.count("pathology").alias("n_reports"), F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).alias("critical"))
    return sums.select(run, "n_steps", "n_reports", F.greatest(F.lit(0.0), 1 - F.col("n_reports") / F.col("n_steps")).alias("health"), F.when(F.col("n_reports") == 0, "healthy").when(F.col("critical"), "critical").otherwise("degraded").alias("verdict"))
