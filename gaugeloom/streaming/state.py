"""Keyed state of streams: a livelock gate within the run, a rolling baseline, alerts over a trailing period.

Each is a processor of transformWithStateInPandas: what a key has is a few values, a list of a given length or a ring of counters, so state doesn't
grow with a key's rows.  Every access to state is a call of the JVM: a key's state is read and written once for each micro-batch, not for each row.  Keys that are idle for long leave, by event-time timers.  A key's rows are taken in the order of a column within a micro-batch;
micro-batches are taken as they come.  The state store is RocksDB, set while the query starts.
"""

from __future__ import annotations

import contextlib
import math
import sys
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gaugeloom.functions import verdicts

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# these processors go to workers whole: Spark's first worker of a query doesn't get the files added to the session
cloudpickle.register_pickle_by_value(sys.modules[__name__])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that these processors need, for queries started within."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def into_folder(df: DataFrame, path: str, checkpoint: str, mode: str = "update", notify: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Runs df over what there is; each micro-batch is written to a folder of its own under path, named by its number.

    A micro-batch that runs again writes the same folder again, so that the result is the same.  notify is given the rows as
    written, once for each number: a folder that notify has had is marked."""

    def each(batch: DataFrame, i: int) -> None:
        spark, to = batch.sparkSession, f"{path}/batch={i}"
        batch.write.mode("overwrite").parquet(to)
        if notify is None:
            return
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_told/{i}")
        files = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(mark):
            notify(spark.read.schema(batch.schema).parquet(to), i)
            files.create(mark, True).close()

    with rocksdb(df.sparkSession):
        return df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _values(column: pd.Series) -> np.ndarray:
    """A column as an array; time stamps as milliseconds."""
    if pd.api.types.is_datetime64_any_dtype(column):
        return column.to_numpy("datetime64[ns]").view(np.int64) // 1_000_000
    return column.to_numpy()


def _rows_in_order(rows: Iterator[pd.DataFrame], columns: list[str], *order: str) -> Iterator[tuple]:
    """The columns' values, row by row: most keys have a few rows, for which a sorted frame costs more than what is done with it."""
    frames = list(rows)
    whole = frames[0] if len(frames) == 1 else pd.concat(frames)
    by = [whole[c].to_numpy() for c in reversed(order)]
    if any(x.dtype == object for x in by):
        whole = whole.sort_values(list(order), kind="stable")
        return zip(*(_values(whole[c]).tolist() for c in columns), strict=True)
    at = np.lexsort(by)
    return zip(*(_values(whole[c])[at].tolist() for c in columns), strict=True)


def _fields(df: DataFrame, *columns: str) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in columns]


def _with(fields: list[T.StructField], more: str) -> T.StructType:
    return T.StructType([*fields, *T.StructType.fromDDL(more)])


REPORT = "n_steps bigint, n_stuck bigint, score double, mean_progress double, longest bigint, detected boolean, verdict string, gate_passed boolean, over_budget boolean, computed bigint"


class RunGate(StatefulProcessor):
    """Steps of a run (op `step`), questions (`report`) and new beginnings (`reset`).

    Told at once: the step at which the gate first fails or the budget is reached, and steps out of order.  A report is computed when it is asked
    for and kept until the next step; `computed` counts how often it was."""

    def __init__(self, epsilon: float, k: int, threshold: float, band: float, first: int, budget: int | None, idle_ms: int, each_batch: bool, columns: list[str]) -> None:
        self.epsilon, self.k, self.threshold, self.band, self.first, self.budget, self.idle_ms, self.each_batch, self.columns = epsilon, k, threshold, band, first, budget, idle_ms, each_batch, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "n bigint, last double, made double, stuck bigint, now bigint, longest bigint, failed boolean, over boolean, computed bigint, until bigint")
        self.kept = handle.getValueState("report", REPORT)

    def _report(self, s: dict, kept: list) -> tuple:
        """kept: of none or one report; the report is put there."""
        if kept:
            return kept[0]
        s["computed"] += 1
        t = self.threshold
        score = s["stuck"] / s["n"]
        verdict = "LIVELOCK_FREE" if score <= t else "BORDERLINE" if score <= t + self.band else "LIVELOCK_DETECTED"
        # the deltas are added up one by one: the last step's progress, their exact sum, rounds otherwise at the seventh digit
        made = (s["n"], s["stuck"], score, s["made"] / s["n"], s["longest"], s["longest"] >= self.k, verdict, score <= t, bool(s["over"]), s["computed"])
        kept.append(made)
        return made

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ("n", "last", "made", "stuck", "now", "longest", "failed", "over", "computed", "until")
        empty = dict(zip(names, (0, 0.0, 0.0, 0, 0, 0, False, False, 0, -1), strict=True))
        before, had = self.run.get(), self.kept.get()
        s = dict(zip(names, before, strict=True)) if before is not None else dict(empty)
        out, latest, kept = [], -1, [tuple(had)] if had is not None else []
        for op, step, progress, ts in _rows_in_order(rows, ["row_op", "row_step", "row_progress", "row_ts"], "row_ts", "row_step"):
            latest = max(latest, ts)
            if op == "reset":
                s = empty | {"until": s["until"]}
                kept = []
            elif op == "report":
                if s["n"]:
                    out.append((*key, "report", s["n"], *self._report(s, kept)))
            elif not math.isnan(step) and int(step) != s["n"] + self.first:
                out.append((*key, "rejected", int(step), *[None] * 10))
            else:
                still = abs(progress - s["last"]) < self.epsilon
                s |= {"n": s["n"] + 1, "made": s["made"] + (progress - s["last"]), "last": float(progress), "stuck": s["stuck"] + still, "now": s["now"] + 1 if still else 0}
                s["longest"] = max(s["longest"], s["now"])
                kept = []
                fails = s["stuck"] / s["n"] > self.threshold
                over = self.budget is not None and s["n"] >= self.budget
                news = [kind for kind, was, now in (("gate", s["failed"], fails), ("budget", s["over"], over)) if now and not was]
                s |= {"failed": s["failed"] or fails, "over": over}
                out += [(*key, kind, s["n"], *self._report(s, kept)) for kind in news]
        if self.each_batch and s["n"]:
            out.append((*key, "report", s["n"], *self._report(s, kept)))
        if latest + self.idle_ms > s["until"]:
            if s["until"] >= 0:
                self.handle.deleteTimer(s["until"])
            s["until"] = latest + self.idle_ms
            self.handle.registerTimer(s["until"])
        self.run.update(tuple(s[c] for c in names))
        if kept:
            self.kept.update(kept[0])
        elif had is not None:
            self.kept.clear()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = ("n", "last", "made", "stuck", "now", "longest", "failed", "over", "computed", "until")
        s = dict(zip(names, self.run.get(), strict=True))
        had = self.kept.get()
        out = [(*key, "closed", s["n"], *self._report(s, [tuple(had)] if had is not None else []))] if s["n"] else []
        self.run.clear()
        self.kept.clear()
        yield pd.DataFrame(out, columns=self.columns)


def run_gate(df: DataFrame, run: str, step: str, progress: str, ts: str, op: str | None = None, epsilon: float = 0.05, k: int = 5, tier: str = "HIGH", first: int = 1, budget: int | None = None, idle: str = "1 day", late: str = "10 minutes", each_batch: bool = True) -> DataFrame:
    """(run, event, step, report): events are `gate`, `budget`, `rejected`, `report` (asked for, or at each micro-batch's end) and `closed` (idle for long, and gone).

    Steps count from `first`; a null step is the next one.  op: a column of step, report or reset, all steps if not given."""
    asked = F.coalesce(F.col(op), F.lit("step")) if op else F.lit("step")
    rows = df.select(run, asked.alias("row_op"), F.col(step).cast("double").alias("row_step"), F.col(progress).cast("double").alias("row_progress"), F.col(ts).cast("timestamp").alias("row_ts")).withWatermark("row_ts", late)
    schema = _with(_fields(df, run), f"event string, step bigint, {REPORT}")
    return rows.groupBy(run).transformWithStateInPandas(RunGate(epsilon, k, verdicts.LIVELOCK[tier], verdicts.BAND, first, budget, int(pd.Timedelta(idle).total_seconds() * 1000), each_batch, schema.names), schema, "Update", "EventTime")


def _plain_sum(values: Iterable[float]) -> float:
    """Added one after the other, as SQL does; Python's own sum compensates, which decides otherwise where a score is at the threshold."""
    return reduce(add, values, 0.0)


class RollingBaseline(StatefulProcessor):
    """The last n passing scores of a key, against whose mean, added up newest first, each new score is held."""

    def __init__(self, n: int, drop: float, columns: list[str]) -> None:
        self.n, self.drop, self.columns = n, drop, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scores = handle.getListState("scores", "score double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = [x[0] for x in self.scores.get()] if self.scores.exists() else []
        out = []
        for seq, score, passed in _rows_in_order(rows, ["row_seq", "row_score", "row_passed"], "row_seq"):
            base = _plain_sum(reversed(last)) / len(last) if last else None
            fail = base is not None and base - score > self.drop
            reason = f"score {score:.3f}, no baseline yet" if base is None else f"score {score:.3f}, baseline {base:.3f}"
            out.append((*key, seq, score, base, fail, reason))
            if passed:
                last = [*last, float(score)][-self.n :]
        if last:
            self.scores.put([(x,) for x in last])
        yield pd.DataFrame(out, columns=self.columns)


def baseline_gate(df: DataFrame, keys: list[str], score: str, passed: str, seq: str, n: int = 5, drop: float = 0.05) -> DataFrame:
    """(keys, seq, score, baseline, should_fail, reason): each score against the mean of the key's last n passing ones before it, kept as state: no ledger is read."""
    rows = df.where(F.col(score).isNotNull()).select(*keys, F.col(seq).alias("row_seq"), F.col(score).cast("double").alias("row_score"), F.coalesce(F.col(passed), F.lit(False)).alias("row_passed"))
    schema = _with(_fields(df, *keys, seq), "score double, baseline double, should_fail boolean, reason string")
    return rows.groupBy(*keys).transformWithStateInPandas(RollingBaseline(n, drop, schema.names), schema, "Update", "None")


class FirstField(StatefulProcessor):
    """A ring of counters by ticks of event time: observations, violations, and failures of each field."""

    def __init__(self, thresholds: dict[str, float], tick_ms: int, ticks: int, columns: list[str]) -> None:
        self.thresholds, self.tick_ms, self.ticks, self.columns = thresholds, tick_ms, ticks, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "tick array<bigint>, n array<bigint>, violations array<bigint>, fails array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, fields = [], list(self.thresholds)
        ticks, ns, bads, fails = self.ring.get() or ((), (), (), ())
        ring = {t % self.ticks: [t, n, bad, list(fails[i * len(fields) : (i + 1) * len(fields)])] for i, (t, n, bad) in enumerate(zip(ticks, ns, bads, strict=True))}
        for seq, ts, failed in _rows_in_order(rows, ["row_seq", "row_ts", "row_failed"], "row_ts", "row_seq"):
            tick = ts // self.tick_ms
            place = tick % self.ticks
            held = ring.get(place)
            if held is None or held[0] < tick:
                held = ring[place] = [tick, 0, 0, [0] * len(fields)]
            if held[0] == tick:  # else the row is older than the ring
                held[1] += 1
                held[2] += bool(len(failed))
                for i, f in enumerate(fields):
                    held[3][i] += f in failed
            within = [h for h in ring.values() if tick - self.ticks < h[0] <= tick]
            n, bad = sum(h[1] for h in within), sum(h[2] for h in within)
            rate = bad / n if n else 0.0
            for i, f in enumerate(fields):
                if rate > self.thresholds[f]:
                    out.append((*key, seq, f, rate, sum(h[3][i] for h in within) / n, self.thresholds[f], n))
                    break
        held = list(ring.values())
        self.ring.update(tuple([h[i] for h in held] for i in range(3)) + ([x for h in held for x in h[3]],))
        if out:
            yield pd.DataFrame(out, columns=self.columns)


def first_field_alerts(df: DataFrame, keys: list[str], seq: str, ts: str, failed: str, thresholds: dict[str, float], period: str = "1 hour", tick: str = "1 minute") -> DataFrame:
    """(keys, seq, field, rate, field_rate, threshold, n): for each observation after which the key's violation rate of the trailing period is over a
    field's threshold, the first such field, in the order given.  No window needs to close for it.

    failed: a column of the names of the fields that failed.  The period is counted in whole ticks, the observation's own the last; rows older than the ring only ask."""
    tick_ms = int(pd.Timedelta(tick).total_seconds() * 1000)
    ticks = max(1, int(pd.Timedelta(period).total_seconds() * 1000) // tick_ms)
    rows = df.select(*keys, F.col(seq).alias("row_seq"), F.col(ts).cast("timestamp").alias("row_ts"), F.coalesce(F.col(failed), F.array().cast("array<string>")).alias("row_failed"))
    schema = _with(_fields(df, *keys, seq), "field string, rate double, field_rate double, threshold double, n bigint")
    return rows.groupBy(*keys).transformWithStateInPandas(FirstField(dict(thresholds), tick_ms, ticks, schema.names), schema, "Update", "None")
