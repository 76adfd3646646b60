"""Assertions for test suites: reports are worked out by Spark, and what fails is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hold(df: DataFrame, ok: Column, what: str, shown: int = 10) -> DataFrame:
    failing = [r.asDict() for r in df.where(~F.coalesce(ok, F.lit(False))).limit(shown).collect()]
    assert not failing, f"{what} failed for {len(failing)}{' or more' if len(failing) == shown else ''}: {failing}"
    return df


def assert_consistent(df: DataFrame, verdict: str = "verdict", borderline_passes: bool = True) -> DataFrame:
    """Outputs are consistent; BORDERLINE passes unless it is told not to."""
    return _hold(df, F.col(verdict).isin("CONSISTENT", *(["BORDERLINE"] if borderline_passes else [])), "consistency")


def assert_no_livelock(df: DataFrame, gate: str = "gate_passed", detected: str | None = None) -> DataFrame:
    ok = F.col(gate) & ~F.col(detected) if detected else F.col(gate)
    return _hold(df, ok, "livelock gate")


def assert_stable(df: DataFrame, least: float, score: str = "score", onset: str | None = None) -> DataFrame:
    """Under pressure the score stays at `least` or above, and, if asked, no onset is found."""
    ok = F.col(score) >= least
    return _hold(df, ok & F.col(onset).isNull() if onset else ok, "stability")


def assert_attributed(df: DataFrame, chunk: str, score: str, must: str, least: float = 0.30) -> DataFrame:
    """The chunk is there and contributes at least that much."""
    own = df.where(F.col(chunk) == must)
    assert not own.isEmpty(), f"no chunk {must}"
    _hold(own, F.col(score) >= least, f"attribution to {must}")
    return df


def assert_dominated_by_none(df: DataFrame, score: str, most: float) -> DataFrame:
    return _hold(df, F.col(score) <= most, "largest attribution")


def assert_passed(df: DataFrame, passed: str = "passed") -> DataFrame:
    return _hold(df, F.col(passed), "gate")
