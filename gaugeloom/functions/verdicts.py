"""Threshold ladders as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: thresholds of the criticality tiers
CONSISTENCY = {"CRITICAL": 0.99, "HIGH": 0.90, "MEDIUM": 0.75, "LOW": 0.60}
LIVELOCK = {"CRITICAL": 0.05, "HIGH": 0.15, "MEDIUM": 0.30, "LOW": 0.50}
PRESSURE = {"CRITICAL": 0.95, "HIGH": 0.85, "MEDIUM": 0.75, "LOW": 0.65}
BAND = 0.05


def ladder(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first step that the value reaches, else rest."""
    out = F.lit(rest)
    for least, name in reversed(steps):
        out = F.when(value >= least, F.lit(name)).otherwise(out)
    return out


def consistency(score: Column, tier: str = "HIGH", band: float = BAND) -> Column:
    t = CONSISTENCY[tier]
    return ladder(score, [(t, "CONSISTENT"), (t - band, "BORDERLINE")], "INCONSISTENT")


def livelock(score: Column, tier: str = "HIGH", band: float = BAND) -> Column:
    t = LIVELOCK[tier]
    return F.when(score <= t, "LIVELOCK_FREE").when(score <= t + band, "BORDERLINE").otherwise("LIVELOCK_DETECTED")


def pressure(score: Column, tier: str = "HIGH") -> Column:
    t = PRESSURE[tier]
    return ladder(score, [(t, "STABLE"), (t - 0.10, "MILD"), (t - 0.20, "MODERATE")], "SEVERE")


def fidelity(score: Column, faithful: float = 0.15, unfaithful: float = 0.08) -> Column:
    return F.when(score >= faithful, "FAITHFUL").when(score < unfaithful, "UNFAITHFUL").otherwise("INCONCLUSIVE")


def severity(rate: Column) -> Column:
    return F.when(rate == 0, "none").when(rate < 0.05, "low").when(rate < 0.15, "medium").when(rate < 0.30, "high").otherwise("critical")


def mutation(score: Column) -> Column:
    return ladder(score, [(0.90, "STRONG"), (0.80, "ADEQUATE"), (0.70, "MARGINAL"), (0.60, "WEAK")], "DANGEROUS")


def coherence(score: Column) -> Column:
    return ladder(score, [(0.80, "COHERENT"), (0.55, "DEGRADED")], "INCOHERENT")
