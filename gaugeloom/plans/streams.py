"""Queries that run a stream over `events` or `conversations` to its end, in several micro-batches, and give what it wrote."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeloom.functions import text as X
from gaugeloom.streaming import state, streams

from . import agents
from .agents import MILESTONES, TASK

#: Arrivals that a table is dealt out to, in the order of time; each is a micro-batch at least.
ARRIVALS = 3
#: An alert's fields in their order, with their thresholds.
FIELDS = {"status": 0.6, "value": 0.4, "kind": 0.2}


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='gaugeloom-')}/stream-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def _state_partitions(spark: SparkSession) -> Iterator[None]:
    """No more partitions of state than twice the cores: each is a store of its own, opened and committed by every micro-batch."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), 2 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arriving(df: DataFrame, arrival: str, run: Callable[[DataFrame, str, str], object]) -> DataFrame:
    """What run(stream, out, checkpoint) writes under out when df's rows arrive one value of `arrival` after the other, with the number of the
    micro-batch.  The input and the checkpoint are removed."""
    spark, to = df.sparkSession, _folder(df.sparkSession)
    df.write.partitionBy(arrival).parquet(f"{to}/all")
    rows = df.drop(arrival)
    for i in range(ARRIVALS):
        part = spark.read.parquet(f"{to}/all").where(F.col(arrival) == i).select(*rows.columns)
        part.write.mode("append").parquet(f"{to}/in")
        with _state_partitions(spark):
            run(streams.from_files(spark, f"{to}/in", rows.schema, 1_000_000), f"{to}/out", f"{to}/state").awaitTermination()
    for name in ("all", "in", "state"):
        _remove(spark, f"{to}/{name}")
    return spark.read.option("basePath", f"{to}/out").parquet(f"{to}/out/batch=*")


def _last_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group what the last micro-batch that changed it wrote."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))).where("_rank = 1").drop("_rank", "batch")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Steps are numbered in a batch job, as a stream has no order of its own; arrivals are thirds of the time that the table spans."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    span = e.agg(F.min("ts").cast("double").alias("_lo"), F.max("ts").cast("double").alias("_hi"))
    part = F.least(F.lit(ARRIVALS - 1), F.floor((F.col("ts").cast("double") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1.0)) * ARRIVALS)).cast("int")
    numbered = e.select("user_id", "event_id", "ts", "event_type", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"))
    return numbered.crossJoin(F.broadcast(span)).withColumn("_arrival", part).drop("_lo", "_hi")


def _failed() -> Column:
    """The fields of an event that fail: errors, large values, views."""
    named = lambda ok, f: F.when(ok, F.lit(f))
    return F.array_compact(F.array(named(F.col("event_type") == "error", "status"), named(F.col("value") > 450, "value"), named(F.col("event_type") == "view", "kind")))


def stream_patrol(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("user_id", "step", "ts", X.token_set(agents.event_words()).alias("tokens"), "_arrival")
    run = lambda s, out, at: state.into_folder(streams.patrol(s, "user_id", "step", "tokens", "ts", TASK, MILESTONES, idle="3650 days"), out, at, "append")
    return arriving(e, "_arrival", run).drop("batch").withColumn("confidence", F.round("confidence", 6))


def stream_livelock(spark: SparkSession, sf: str) -> DataFrame:
    """The last report of each run of events."""
    e = _events(spark, sf).select("user_id", "step", "ts", (F.col("value") / 500).alias("progress"), "_arrival")
    run = lambda s, out, at: state.into_folder(state.run_gate(s, "user_id", "step", "progress", "ts", idle="3650 days"), out, at)
    last = _last_of(arriving(e, "_arrival", run).where("event = 'report'"), ["user_id"])
    return last.select("user_id", "n_steps", "n_stuck", F.round("score", 6).alias("score"), F.round("mean_progress", 6).alias("mean_progress"), "longest", "detected", "verdict", "gate_passed")


def stream_livelock_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The steps at which a conversation's gate first fails, told within the run."""
    made = agents.livelock_made(spark, sf).select("conv_id", "turn", "progress")
    steps = made.withColumn("step", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("ts", F.timestamp_seconds(F.col("step") * 60))
    steps = steps.withColumn("_arrival", F.least(F.lit(ARRIVALS - 1), F.floor(F.col("step") / 2)).cast("int"))
    run = lambda s, out, at: state.into_folder(state.run_gate(s, "conv_id", "step", "progress", "ts", k=2, each_batch=False), out, at)
    return arriving(steps, "_arrival", run).where("event = 'gate'").select("conv_id", "step", "n_stuck", F.round("score", 6).alias("score"), "verdict")


def stream_baseline_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's value against the user's last five that were no errors."""
    e = _events(spark, sf).select("user_id", "event_id", "step", F.col("value").alias("score"), (F.col("event_type") != "error").alias("passed"), "_arrival")
    run = lambda s, out, at: state.into_folder(state.baseline_gate(s, ["user_id"], "score", "passed", "step", drop=100.0), out, at)
    return arriving(e, "_arrival", run).select("user_id", F.col("step").cast("bigint").alias("step"), F.round("baseline", 6).alias("baseline"), "should_fail")


def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The first field over its threshold after each event, by the user's violations of the last two days, in hours."""
    e = _events(spark, sf).select("user_id", "event_id", "ts", _failed().alias("failed"), "_arrival")
    run = lambda s, out, at: state.into_folder(state.first_field_alerts(s, ["user_id"], "event_id", "ts", "failed", FIELDS, "2 days", "1 hour"), out, at)
    return arriving(e, "_arrival", run).select("user_id", "event_id", "field", F.round("rate", 6).alias("rate"), F.round("field_rate", 6).alias("field_rate"), "threshold", "n")


def stream_trailing_report(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of the last seven days as of each day; events whose id is divisible by seven are delivered twice."""
    e = _events(spark, sf).select("event_id", "ts", "event_type", _failed().alias("failed"), "_arrival")
    twice = e.withColumn("_times", F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 7 == 0, 2).otherwise(1)))).drop("_times")
    run = lambda s, out, at: state.into_folder(streams.trailing_report(s, "event_id", "ts", ["event_type"], "failed", ["status", "value"]), out, at)
    last = _last_of(arriving(twice, "_arrival", run), ["window", "event_type", "field"])
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "field", "n", F.round("rate", 6).alias("rate"), "severity")


def stream_violation_rate(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("passed", F.col("event_type") != "error")
    run = lambda s, out, at: state.into_folder(streams.violation_rates(s, "ts", ["event_type"], "passed", "1 day"), out, at)
    r = _last_of(arriving(e, "_arrival", run), ["window", "event_type"])
    return r.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("rate", 6).alias("rate"), "severity")


_SEVERITY = "CASE WHEN {0} = 0 THEN 'none' WHEN {0} < 0.05 THEN 'low' WHEN {0} < 0.15 THEN 'medium' WHEN {0} < 0.30 THEN 'high' ELSE 'critical' END"
_FAILED = "list_filter([CASE WHEN event_type = 'error' THEN 'status' END, CASE WHEN value > 450 THEN 'value' END, CASE WHEN event_type = 'view' THEN 'kind' END], lambda x: x IS NOT NULL)"
_STUCK = """
ev AS (SELECT user_id, row_number() OVER w AS n, value / 500 AS p, value / 500 - coalesce(lag(value / 500) OVER w, 0) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
st AS (SELECT *, abs(delta) < 0.05::DOUBLE AS stuck FROM ev),
isl AS (SELECT user_id, n - row_number() OVER (PARTITION BY user_id, stuck ORDER BY n) AS g, stuck FROM st),
ln AS (SELECT user_id, max(c)::BIGINT AS longest FROM (SELECT user_id, g, count(*) AS c FROM isl WHERE stuck GROUP BY ALL) GROUP BY user_id)
"""
QUERIES = {f.__name__: f for f in (stream_patrol, stream_livelock, stream_violation_rate, stream_livelock_gate, stream_baseline_gate, stream_alerts, stream_trailing_report)}
ORACLES = {
    "stream_patrol": agents.ORACLES["patrol_best"],
    "stream_livelock": f"WITH {_STUCK}, s AS (SELECT user_id, count(*)::BIGINT AS n_steps, count_if(stuck)::BIGINT AS n_stuck, count_if(stuck)::DOUBLE / count(*) AS score, avg(delta) AS m FROM st GROUP BY user_id) SELECT s.user_id, n_steps, n_stuck, round(score, 6) AS score, round(m, 6) AS mean_progress, coalesce(longest, 0)::BIGINT AS longest, coalesce(longest, 0) >= 5 AS detected, CASE WHEN score <= 0.15::DOUBLE THEN 'LIVELOCK_FREE' WHEN score <= 0.15::DOUBLE + 0.05::DOUBLE THEN 'BORDERLINE' ELSE 'LIVELOCK_DETECTED' END AS verdict, score <= 0.15::DOUBLE AS gate_passed FROM s LEFT JOIN ln ON s.user_id = ln.user_id",
    "stream_livelock_gate": f"WITH {agents._LIVELOCK}, r AS (SELECT conv_id, row_number() OVER w AS n, count_if(stuck) OVER w AS k FROM st WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), f AS (SELECT conv_id, n::BIGINT AS step, k::BIGINT AS n_stuck, k::DOUBLE / n AS score FROM r WHERE k::DOUBLE / n > 0.15::DOUBLE QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n) = 1) SELECT conv_id, step, n_stuck, round(score, 6) AS score, CASE WHEN score <= 0.15::DOUBLE + 0.05::DOUBLE THEN 'BORDERLINE' ELSE 'LIVELOCK_DETECTED' END AS verdict FROM f",
    "stream_baseline_gate": """
WITH e AS (SELECT user_id, event_type <> 'error' AS ok, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
c AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY step) AS k FROM e WHERE ok),
b AS (SELECT c.user_id, c.step, any_value(c.value) AS value, avg(p.value) AS baseline FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.k > c.before - 5 AND p.k <= c.before GROUP BY ALL)
SELECT user_id, step::BIGINT AS step, round(baseline, 6) AS baseline, coalesce(baseline - value > 100, false) AS should_fail FROM b""",
    "stream_alerts": f"""
WITH e AS (SELECT user_id, event_id, ts, floor(epoch(ts) / 3600)::BIGINT AS h, {_FAILED} AS f FROM events),
c AS (SELECT *, row_number() OVER w AS n, count_if(len(f) > 0) OVER w AS bad, count_if(list_contains(f, 'status')) OVER w AS s, count_if(list_contains(f, 'value')) OVER w AS v, count_if(list_contains(f, 'kind')) OVER w AS k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, count(*) OVER g AS n0, count_if(len(f) > 0) OVER g AS bad0, count_if(list_contains(f, 'status')) OVER g AS s0, count_if(list_contains(f, 'value')) OVER g AS v0, count_if(list_contains(f, 'kind')) OVER g AS k0 FROM c WINDOW g AS (PARTITION BY user_id ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND 48 PRECEDING)),
r AS (SELECT user_id, event_id, (n - n0)::BIGINT AS n, (bad - coalesce(bad0, 0))::DOUBLE / (n - n0) AS rate, (s - coalesce(s0, 0))::DOUBLE / (n - n0) AS s, (v - coalesce(v0, 0))::DOUBLE / (n - n0) AS v, (k - coalesce(k0, 0))::DOUBLE / (n - n0) AS k FROM o)
SELECT user_id, event_id, CASE WHEN rate > 0.6::DOUBLE THEN 'status' WHEN rate > 0.4::DOUBLE THEN 'value' ELSE 'kind' END AS field, round(rate, 6) AS rate, round(CASE WHEN rate > 0.6::DOUBLE THEN s WHEN rate > 0.4::DOUBLE THEN v ELSE k END, 6) AS field_rate, CASE WHEN rate > 0.6::DOUBLE THEN 0.6 WHEN rate > 0.4::DOUBLE THEN 0.4 ELSE 0.2 END::DOUBLE AS threshold, n FROM r WHERE rate > 0.2::DOUBLE""",
    "stream_trailing_report": f"""
WITH e AS (SELECT date_trunc('day', ts)::TIMESTAMP - to_days(d::INT) AS start, event_type, unnest([{{'field': '*', 'lost': len(f) > 0}}, {{'field': 'status', 'lost': list_contains(f, 'status')}}, {{'field': 'value', 'lost': list_contains(f, 'value')}}]) AS x FROM (SELECT ts, event_type, {_FAILED} AS f FROM events), unnest(generate_series(0, 6)) AS u(d)),
s AS (SELECT start, event_type, x.field AS field, count(*)::BIGINT AS n, avg(x.lost::INT) AS rate FROM e GROUP BY ALL)
SELECT start, event_type, field, n, round(rate, 6) AS rate, {_SEVERITY.format('rate')} AS severity FROM s""",
    "stream_violation_rate": f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n, round(avg((event_type = 'error')::INT), 6) AS rate, {_SEVERITY.format('''avg((event_type = 'error')::INT)''')} AS severity FROM events GROUP BY ALL",
}
