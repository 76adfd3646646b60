"""What gates raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(Exception):
    """A gate that failed; `rows` holds the first failing rows as dictionaries."""

    def __init__(self, message: str, rows: list[dict]) -> None:
        super().__init__(message)
        self.rows = rows


def require(df: DataFrame, passed: str, message: str, shown: int = 20) -> DataFrame:
    """df, or GateError if a row doesn't pass."""
    failing = [r.asDict() for r in df.where(~F.coalesce(F.col(passed), F.lit(False))).limit(shown).collect()]
    if failing:
        raise GateError(f"{message}: {len(failing)}{'+' if len(failing) == shown else ''} rows fail", failing)
    return df


def handle(df: DataFrame, passed: str, how: str, fallback: dict | None = None, quarantine: str | None = None) -> DataFrame:
    """What happens to rows that don't pass: raise, warn (mark them), log (write them to the quarantine path and drop them), fallback (replace
    columns by given values)."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    if how == "raise":
        return require(df, passed, "violation")
    if how == "warn":
        return df.withColumn("warning", F.when(~ok, F.lit("violation")))
    if how == "log":
        if quarantine:
            df.where(~ok).write.mode("append").parquet(quarantine)
        return df.where(ok)
    if how == "fallback":
        return df.withColumns({c: F.when(ok, F.col(c)).otherwise(F.lit(v)) for c, v in (fallback or {}).items()})
    raise ValueError(f"no such way: {how}")
