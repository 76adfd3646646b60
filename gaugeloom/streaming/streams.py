"""Structured Streaming forms of the incremental operators.

A patrol run keeps its last six token sets and its first three task similarities, until it has been idle for long.  Rows of a key are taken in
the order of their step within a batch; batches are assumed to bring steps in order.  Gates, baselines and alerts are in `state`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeloom.functions import verdicts
from gaugeloom.operators.patrol import PATHOLOGIES, SENSITIVITY


def violation_rates(df: DataFrame, ts: str, keys: list[str], passed: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window, keys, n, rate, severity) by event time; rows later than `late` are left out once their window is closed."""
    timed = df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    window = F.window("_ts", length, slide) if slide else F.window("_ts", length)
    out = timed.groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n"), (F.count_if(~F.col(passed)) / F.count("*")).alias("rate"))
    return out.withColumn("severity", verdicts.severity(F.col("rate")))


def sessions(df: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(session, key, n): runs told apart by pauses."""
    return df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).groupBy(F.session_window("_ts", gap).alias("session"), key).agg(F.count("*").alias("n"))


def trailing_report(df: DataFrame, id: str, ts: str, keys: list[str], failed: str, fields: list[str], length: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window, keys, field, n, rate, severity) over hopping windows: of all observations (field `*`: any failure) and of each field.

    Rows that come again with the same id within `late` count once.  failed: a column of the names of the fields that failed."""
    once = df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([id])
    lost = F.coalesce(F.col(failed), F.array().cast("array<string>"))
    each = [F.struct(F.lit("*").alias("field"), (F.size(lost) > 0).alias("lost")), *[F.struct(F.lit(f).alias("field"), F.array_contains(lost, f).alias("lost")) for f in fields]]
    rows = once.select("_ts", *keys, F.inline(F.array(*each)))
    out = rows.groupBy(F.window("_ts", length, slide).alias("window"), *keys, "field").agg(F.count("*").alias("n"), (F.count_if("lost") / F.count("*")).alias("rate"))
    return out.withColumn("severity", verdicts.severity(F.col("rate")))


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def step_report(sets: list[set], n: int, early: list[float], task: set, milestones: set, sensitivity: str) -> tuple[str, str, float] | None:
    """The best report for the last of up to six token sets, of n steps so far."""
    t = SENSITIVITY[sensitivity]
    found = []
    over = lambda x, limit: min(1.0, (x - limit) / (1 - limit) + 0.5)
    if n >= t.window:
        last = sets[-t.window :]
        pairs = [_jaccard(last[i], last[i - d]) for d in range(1, t.window) for i in range(len(last) - 1, d - 1, -1)]
        mean = sum(pairs) / len(pairs)
        if mean >= t.cycle:
            found.append((over(mean, t.cycle), 0, "critical" if mean > 0.9 else "warning"))
    for i in range(len(sets) - 3):
        ac, bd, ab = (_jaccard(sets[i + x], sets[i + y]) for x, y in ((0, 2), (1, 3), (0, 1)))
        if ac >= t.oscillation and bd >= t.oscillation and ab < t.oscillation:
            found.append((over((ac + bd) / 2, t.oscillation), 1, "critical"))
            break
    if n >= t.window:
        last = sets[-t.window :]
        steady = sum(_jaccard(a, b) for a, b in zip(last[1:], last[:-1], strict=True)) / (t.window - 1)
        overlap = len(milestones & set().union(*last)) / max(len(milestones), 1)
        if steady >= t.stall and overlap < 0.3:
            found.append((min(1.0, steady * 0.7 + (1 - overlap) * 0.3), 2, "warning"))
    if task and n >= 3:
        late = sum(_jaccard(s, task) for s in sets[-3:]) / 3
        fall = sum(early) / 3 - late
        if fall > t.drift and late < 0.3:
            found.append((min(1.0, fall / 0.5 * 0.7 + 0.3), 3, "critical" if fall > 0.5 else "warning"))
        held = sum(_jaccard(a, b) for a, b in zip(sets[-2:], sets[-3:-1], strict=True)) / 2
        if n >= 5 and late < t.abandon and held > 0.5:
            found.append((min(1.0, (1 - late) * 0.5 + held * 0.5), 4, "critical"))
    if not found:
        return None
    confidence, which, severity = max(found, key=lambda x: (x[0], -x[1]))
    return PATHOLOGIES[which], severity, confidence


def patrol(df: DataFrame, run: str, step: str, tokens: str, ts: str, task: list[str], milestones: list[str], sensitivity: str = "MEDIUM", idle: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """One row per step with a report: run, step, pathology, severity, confidence.  A run without steps for `idle` of event time is forgotten."""
    goal, marks, idle_ms = set(task), set(milestones), int(pd.Timedelta(idle).total_seconds() * 1000)

    def report(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, sets, early = state.get if state.exists else (0, "[]", "[]")
        sets, early, out = [set(x) for x in json.loads(sets)], json.loads(early), []
        frames = list(batches)
        rows = (frames[0] if len(frames) == 1 else pd.concat(frames)).sort_values(step)
        for s, words in zip(rows[step].tolist(), rows[tokens].tolist(), strict=True):
            n += 1
            sets = [*sets, set(words)][-6:]
            if len(early) < 3:
                early.append(_jaccard(sets[-1], goal))
            if got := step_report(sets, n, early, goal, marks, sensitivity):
                out.append((key[0], s, *got))
        state.update((n, json.dumps([sorted(x) for x in sets]), json.dumps(early)))
        state.setTimeoutTimestamp(max(int(rows["_ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        if out:
            yield pd.DataFrame(out, columns=[run, step, "pathology", "severity", "confidence"])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (run, step)}
    timed = df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(run).applyInPandasWithState(report, f"{run} {kinds[run]}, {step} {kinds[step]}, pathology string, severity string, confidence double", "n long, sets string, early string", "append", GroupStateTimeout.EventTimeTimeout)


def from_files(spark, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
