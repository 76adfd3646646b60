"""Streams over several micro-batches, against plain Python, and what a replay leaves."""

import datetime
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeloom.plans import agents, streams as plans
from gaugeloom.streaming import state, streams

SF = "/root/testdata/sf0.001"
T0 = datetime.datetime(2024, 1, 1)


def feed(spark, path, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return streams.from_files(spark, path, schema, 1_000_000)


def drain(spark, tmp, schema, batches, build, mode="update", **more):
    """Feeds one batch after the other; the rows written, with the micro-batch's number."""
    for rows in batches:
        state.into_folder(build(feed(spark, f"{tmp}/in", schema, rows)), f"{tmp}/out", f"{tmp}/state", mode, **more).awaitTermination()
    return spark.read.option("basePath", f"{tmp}/out").parquet(f"{tmp}/out/batch=*")


def test_stream_equals_batch(spark):
    stream = {(r.user_id, r.step, r.pathology, r.severity, r.confidence) for r in plans.stream_patrol(spark, SF).collect()}
    batch = {(r.user_id, r.step, r.pathology, r.severity, r.confidence) for r in agents.patrol_best(spark, SF).collect()}
    assert stream == batch and stream


STEPS = "run string, step int, progress double, ts timestamp, op string"


def step(run, n, progress, minute, op=None):
    return run, n, progress, T0 + datetime.timedelta(minutes=minute), op


def test_gate_fires_within_the_run_and_reports_are_kept(spark, tmp_path):
    first = [step("a", 1, 0.3, 0), step("a", 2, 0.6, 1), step("a", 3, 0.61, 2), step("b", None, 0.5, 0), step("b", 7, 0.9, 1), step("b", None, 0.9, 2)]
    ask = [step("a", None, None, 3, "report"), step("a", None, None, 4, "report"), step("b", None, None, 5, "report")]
    more = [step("a", 4, 0.62, 5), step("a", None, None, 6, "report"), step("b", None, None, 7, "reset"), step("b", 1, 0.2, 8), step("b", None, None, 9, "report")]
    build = lambda s: state.run_gate(s, "run", "step", "progress", "ts", "op", k=2, tier="MEDIUM", budget=4, idle="1 hour", each_batch=False)
    out = drain(spark, tmp_path, STEPS, [first, ask, more], build)
    rows = out.collect()
    place = {b: i for i, b in enumerate(sorted({r.batch for r in rows}))}  # micro-batches without rows move timers only
    got = sorted((place[r.batch], r.run, r.event, r.step, r.n_stuck, r.longest, r.gate_passed, r.over_budget, r.computed) for r in rows)
    assert got == [
        (0, "a", "gate", 3, 1, 1, False, False, 1),
        (0, "b", "rejected", 7, None, None, None, None, None),
        (1, "a", "report", 3, 1, 1, False, False, 1),  # kept since the gate told it
        (1, "a", "report", 3, 1, 1, False, False, 1),
        (1, "b", "report", 2, 0, 0, True, False, 1),
        (2, "a", "budget", 4, 2, 2, False, True, 2),
        (2, "a", "report", 4, 2, 2, False, True, 2),
        (2, "b", "report", 1, 0, 0, True, False, 1),
    ]


def test_idle_runs_leave(spark, tmp_path):
    batches = [[step("a", 1, 0.3, 0), step("b", 1, 0.01, 0)], [step("b", 2, 0.02, 59), step("c", 1, 0.5, 75)], [step("c", 2, 0.6, 100)], [step("a", 1, 0.4, 101)]]
    build = lambda s: state.run_gate(s, "run", "step", "progress", "ts", idle="1 hour", each_batch=False)
    out = drain(spark, tmp_path, STEPS, batches, build).where("event = 'closed'")
    assert [(r.run, r.n_steps, r.detected) for r in out.collect()] == [("a", 1, False)]  # b went on, c is young; a's second run begins anew, so step 1 isn't out of order
    left = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out/batch=*").where("event = 'rejected'")
    assert left.count() == 0


def test_many_runs_equal_the_batch_report(spark, tmp_path):
    import random

    dice = random.Random(5)
    runs = {f"r{i}": [round(dice.random(), 1) for _ in range(dice.randrange(1, 12))] for i in range(20)}
    batches = [[step(r, n + 1, p, n) for r, ps in runs.items() for n, p in enumerate(ps) if n % 12 // 4 == b] for b in range(3)]
    out = drain(spark, tmp_path, STEPS, [b for b in batches if b], lambda s: state.run_gate(s, "run", "step", "progress", "ts", k=2, idle="30 days"))
    last = plans._last_of(out.where("event = 'report'"), ["run"])
    for r in last.collect():
        ps = runs[r.run]
        stuck = [abs(p - q) < 0.05 for p, q in zip(ps, [0.0, *ps], strict=False)]
        longest = max(len(x) for x in "".join("x" if s else " " for s in stuck).split(" "))
        assert (r.n_steps, r.n_stuck, r.longest, r.detected) == (len(ps), sum(stuck), longest, longest >= 2)
        assert r.mean_progress == pytest.approx(ps[-1] / len(ps))
    assert last.count() == len(runs)


SCORES = "prompt string, kind string, seq long, score double, passed boolean"


def test_rolling_baseline_and_its_replay(spark, tmp_path):
    import random

    dice = random.Random(3)
    rows = [(f"p{i % 3}", "exact", i, round(dice.random(), 3), dice.random() < 0.6) for i in range(90)]
    batches = [rows[:31], rows[31:32], rows[32:]]
    told = []
    build = lambda s: state.baseline_gate(s, ["prompt", "kind"], "score", "passed", "seq", drop=0.05)
    tell = lambda df, i: told.extend((i, r.seq) for r in df.where("should_fail").collect())
    got = {r.seq: (r.baseline, r.should_fail) for r in drain(spark, tmp_path, SCORES, batches, build, notify=tell).collect()}
    kept = defaultdict(list)
    for prompt, _, seq, score, passed in rows:
        last = kept[prompt][-5:]
        base = sum(last) / len(last) if last else None
        assert got[seq] == (pytest.approx(base) if last else None, bool(last) and base - score > 0.05)
        if passed:
            kept[prompt].append(score)
    assert sorted(seq for _, seq in told) == sorted(s for s, (_, fail) in got.items() if fail)

    # the last micro-batch runs again: its commit is gone, as if the driver had died before it
    before, told_before = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/batch=*").collect())), list(told)
    commits = sorted((p for p in (tmp_path / "state/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (crc := commits[-1].with_name(f".{commits[-1].name}.crc")).exists() and crc.unlink()
    again = build(streams.from_files(spark, f"{tmp_path}/in", SCORES, 1_000_000))
    state.into_folder(again, f"{tmp_path}/out", f"{tmp_path}/state", notify=tell).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/batch=*").collect())) == before
    assert told == told_before


SEEN = "spec string, id long, ts timestamp, failed array<string>"


def test_first_field_over_its_threshold(spark, tmp_path):
    import random

    dice = random.Random(7)
    at, rows = 0, []
    for i in range(400):
        at += dice.choice([0, 5, 40, 300, 4000]) if i % 50 else 9000
        rows.append(("s" if i % 4 else "t", i, T0 + datetime.timedelta(seconds=at), [f for f in ("a", "b", "c") if dice.random() < 0.15] or (None if i % 9 == 0 else [])))
    limits = {"a": 0.6, "b": 0.25, "c": 0.4}
    build = lambda s: state.first_field_alerts(s, ["spec"], "id", "ts", "failed", limits)
    out = drain(spark, tmp_path, SEEN, [rows[:150], rows[150:170], rows[170:]], build)
    got = sorted((r.spec, r.id, r.field, round(r.rate, 9), round(r.field_rate, 9), r.threshold, r.n) for r in out.collect())
    want = []
    for spec, i, ts, _ in rows:
        minute = ts.replace(second=0)
        near = [f or [] for s, j, t, f in rows if s == spec and (t, j) <= (ts, i) and minute - t.replace(second=0) < datetime.timedelta(hours=1)]
        rate = sum(bool(f) for f in near) / len(near)
        field = next((f for f, limit in limits.items() if rate > limit), None)
        if field:
            want.append((spec, i, field, round(rate, 9), round(sum(field in f for f in near) / len(near), 9), limits[field], len(near)))
    assert got == sorted(want) and len(want) > 110


def test_trailing_windows_count_deliveries_once(spark, tmp_path):
    rows = [("k", i, T0 + datetime.timedelta(hours=7 * i), ["a"] if i % 3 == 0 else None) for i in range(40)]
    batches = [rows[:15], rows[12:25] + rows[10:12], rows[24:]]
    build = lambda s: streams.trailing_report(s, "id", "ts", ["spec"], "failed", ["a", "b"], "3 days", "1 day", "2 days")
    out = plans._last_of(drain(spark, tmp_path, SEEN, batches, build), ["window", "spec", "field"])
    got = {(r.window.start, r.field): (r.n, round(r.rate, 9)) for r in out.collect()}
    want = {}
    for d in range(-2, 13):
        start = T0 + datetime.timedelta(days=d)
        within = [f or [] for _, _, ts, f in rows if start <= ts < start + datetime.timedelta(days=3)]
        for field in ("*", "a", "b") if within else ():
            want[start, field] = (len(within), round(sum(bool(f) if field == "*" else field in f for f in within) / len(within), 9))
    assert got == want


def test_reports_of_streams_have_their_columns(spark):
    out = streams.violation_rates(spark.readStream.format("rate").load().withColumn("ok", F.lit(True)), "timestamp", ["value"], "ok", "1 hour", "10 minutes")
    assert out.columns == ["window", "value", "n", "rate", "severity"]


class Counted:
    """A state variable that counts how often it is asked or told."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "update":
                self.value = args[0]
            elif name == "clear":
                self.value = None
            elif name == "updateValue":
                self.map[args[0]] = args[1]
            return {"get": self.value, "exists": self.value is not None, "iterator": iter(self.map.items())}.get(name)

        return call


class Handle(Counted):
    def __init__(self):
        super().__init__()
        self.made = []

    def getValueState(self, *_):  # noqa: N802
        self.made.append(Counted())
        return self.made[-1]

    getMapState = getValueState  # noqa: N815


def test_calls_to_state_do_not_grow_with_a_batch():
    import pandas as pd

    def calls(make, rows):
        processor, handle = make(), Handle()
        processor.init(handle)
        for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
            list(processor.handleInputRows(("a",), iter([part]), None))
        return handle.calls + sum(x.calls for x in handle.made)

    def rows(n):
        ts = pd.to_datetime("2024-01-01") + pd.to_timedelta(range(n), unit="h")
        return pd.DataFrame({"row_op": "step", "row_step": [float(i + 1) for i in range(n)], "row_progress": 0.5, "row_ts": ts, "row_seq": range(n), "row_failed": [["x"]] * n})

    gate = lambda: state.RunGate(0.05, 5, 0.15, 0.05, 1, None, 1000, True, ["run", "event", "step", *state.REPORT.replace(" bigint", "").replace(" double", "").replace(" boolean", "").replace(" string", "").split(", ")])
    first = lambda: state.FirstField({"x": 0.2}, 3_600_000, 48, ["a", "seq", "field", "rate", "field_rate", "threshold", "n"])
    for make in (gate, first):
        assert calls(make, rows(200)) == calls(make, rows(20))


def test_mean_progress_is_the_mean_of_the_deltas():
    import pandas as pd

    processor = state.RunGate(0.05, 5, 0.15, 0.05, 1, None, 1000, True, ["run", "event", "step", *[x.split(" ")[0] for x in state.REPORT.split(", ")]])
    processor.init(Handle())
    progress = [0.1, 0.7, 0.3, 0.9]
    rows = pd.DataFrame({"row_op": "step", "row_step": [1.0, 2.0, 3.0, 4.0], "row_progress": progress, "row_ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(range(4), unit="h")})
    (out,) = processor.handleInputRows(("a",), iter([rows]), None)
    assert out["mean_progress"].tolist() == [sum(b - a for a, b in zip([0.0, *progress], progress)) / 4] * len(out)


def test_baseline_at_the_threshold_as_in_sql(spark, tmp_path):
    cases = {"a": ([286.53, 440.01, 149.8, 282.86, 167.45], 165.33, False), "b": ([214.69, 233.45, 232.56, 29.68, 240.32], 90.14, True)}
    rows = [(k, "exact", i, x, True) for k, (before, score, _) in cases.items() for i, x in enumerate([*before, score])]
    build = lambda s: state.baseline_gate(s, ["prompt", "kind"], "score", "passed", "seq", drop=100.0)
    got = {(r.prompt, r.seq): r.should_fail for r in drain(spark, tmp_path, SCORES, [[r for r in rows if r[2] < 3], [r for r in rows if r[2] >= 3]], build).collect()}
    assert all(got[k, 5] == fail for k, (_, _, fail) in cases.items())
