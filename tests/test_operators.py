"""Operators on small fixtures and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeloom import errors
from gaugeloom.operators import gates, ledger, livelock, mutation, parsing, patrol, scoring, trim
from gaugeloom.streaming.streams import step_report


def longest(mask):
    best, start, i = (0, None, None), None, 0
    for i, m in enumerate([*mask, False]):
        if m and start is None:
            start = i
        if not m and start is not None:
            if i - start > best[0]:
                best = (i - start, start, i - 1)
            start = None
    return best


def test_longest_runs(spark):
    random.seed(5)
    masks = [[random.random() < 0.6 for _ in range(random.randint(1, 12))] for _ in range(60)] + [[False], [True]]
    df = spark.createDataFrame([(r, i, m) for r, mask in enumerate(masks) for i, m in enumerate(mask)], "r int, i int, m boolean")
    got = {x.r: (x.longest, x.start, x.end) for x in livelock.longest_runs(df, "r", "i", "m").collect()}
    assert got == {r: longest(m) for r, m in enumerate(masks)}


def test_patrol_is_alike_in_batch_and_step_by_step(spark):
    random.seed(7)
    words = "search gdp ghana approve reject write report".split()
    runs = {r: [random.sample(words, random.randint(0, 3)) if random.random() < 0.5 else [words[r % 4]] for _ in range(14)] for r in range(25)}
    runs[99] = [["search", "for", "gdp", "data"]] * 4
    runs[98] = [["approve"], ["reject"]] * 3
    task, marks = ["search", "gdp", "data"], ["report"]
    df = spark.createDataFrame([(r, i, t) for r, x in runs.items() for i, t in enumerate(x)], "r int, i int, t array<string>")
    for level in ("LOW", "MEDIUM", "HIGH"):
        got = {(x.r, x.i): (x.pathology, x.severity, x.confidence) for x in patrol.detect(df, "r", "i", "t", task, marks, level).collect()}
        for r, x in runs.items():
            sets, early = [set(t) for t in x], []
            for i in range(len(x)):
                a, b = sets[i], set(task)
                early = [*early, len(a & b) / len(a | b)][:3]
                want = step_report(sets[max(0, i - 5) : i + 1], i + 1, early, set(task), set(marks), level)
                assert (got[r, i][0] is None) == (want is None), (level, r, i, got[r, i], want)
                if want:
                    assert got[r, i][:2] == want[:2] and got[r, i][2] == pytest.approx(want[2], abs=1e-9)
    best = patrol.detect(df.where("r >= 98"), "r", "i", "t", task, marks, "MEDIUM").where("pathology IS NOT NULL")
    assert {x.pathology for x in best.where("r = 98").collect()} == {"oscillation"}
    assert {x.verdict for x in patrol.summary(patrol.detect(df, "r", "i", "t", [], []), "r").collect()} <= {"healthy", "degraded", "critical"}


def messages(spark):
    rows = [(1, 0, "system", "s" * 40), (1, 1, "user", "x" * 400), (1, 2, "assistant", "is it important?"), (1, 3, "user", "y" * 100), (2, 0, "user", "short"), (3, 0, "system", "z" * 4000), (3, 1, "user", "hi")]
    return trim.costs(spark.createDataFrame(rows, "c int, t int, role string, text string"), "c", "t", "role", "text")


def test_trim_strategies(spark):
    kept = {n: {(r.c, r.t) for r in f(messages(spark), "c", 612, 512).where("kept").collect()} for n, f in trim.STRATEGIES.items()}
    assert kept["recency"] == {(1, 0), (1, 2), (1, 3), (2, 0), (3, 0)}
    assert kept["hybrid"] >= {(1, 0), (1, 3), (2, 0), (3, 0)} and (1, 1) not in kept["hybrid"] and (3, 1) not in kept["hybrid"]
    stats = {r.c: r for r in trim.stats(trim.keep_recent(messages(spark), "c", 612, 512), "c", 612, 512).collect()}
    assert stats[2].trim_ratio == 0 and not stats[3].fits and stats[1].fits


def test_trim_documents(spark):
    text = "\n\n".join(["first part " * 5, "the important result", "last part " * 3])
    df = spark.createDataFrame([(1, text), (2, "fits")], "id int, text string")
    out = {s: {r.id: r.trimmed for r in trim.trim_documents(df, "text", s, 12).collect()} for s in ("tail", "important", "hybrid", "summary")}
    assert all(v[2] == "fits" for v in out.values())
    assert out["tail"][1] == ("last part " * 3).strip()
    assert out["important"][1].startswith("the important result")
    assert out["summary"][1].endswith("budget ...]")


def test_ledger(spark):
    rows = [("p", "e", i, s, ok) for i, (s, ok) in enumerate([(0.80, True), (0.10, False), (0.90, True), (0.85, True)])]
    df = spark.createDataFrame(rows, "prompt string, eval string, seq int, score double, passed boolean")
    assert ledger.baseline(df, ["prompt"], "score", "passed", F.desc("seq")).first().baseline == pytest.approx(0.85)
    g = ledger.gate(spark.createDataFrame([(0.7, 0.85), (0.82, 0.85), (0.1, None)], "score double, base double"), "score", "base", "regression").collect()
    assert [r.should_fail for r in g] == [True, False, False]
    with pytest.raises(ValueError):
        ledger.gate(df, "score", "score", "other")
    drift = ledger.fidelity_drift(df.limit(2), ["prompt"], "score", F.desc("seq")).first()
    assert drift.trend == "INSUFFICIENT_DATA" and not drift.drift_detected and drift["mean"] == 0


def test_scores(spark):
    df = spark.createDataFrame([("a, b, c", ["exactly 3 items"]), ("a, b", ["exactly 3 items", "at least 2 items"]), ("the ledger", ['must contain "ledger"']), ("x", None)], "r string, c array<string>")
    assert [r.s for r in df.select(scoring.instruction_adherence(F.col("r"), F.col("c")).alias("s")).collect()] == [1.0, 0.5, 1.0, 1.0]
    df = spark.createDataFrame([("I cannot do it", True), ("I cannot do it", False), ("perhaps so", True), ("", True), ("x" * 50, True)], "r string, q boolean")
    assert [r.s for r in df.select(scoring.task_completion(F.col("r"), F.col("q")).alias("s")).collect()] == pytest.approx([0.0, 0.1, 0.7, 0.0, 1.0])
    raw = spark.createDataFrame([('{"score": 1.7}',), ("I give 0.4 here",), ("nothing",)], "t string")
    assert [r.s for r in raw.select(scoring.judge_score(F.col("t")).alias("s")).collect()] == [1.0, 0.4, 0.5]
    rules = scoring.rule_verdicts(spark.createDataFrame([(1, 0.95, 0.7, True, 1.0), (1, 0.1, 0.6, True, 0.5), (2, 0.1, 0.7, True, 1.0), (3, 0.0, 0.7, False, 1.0)], "k int, c double, t double, e boolean, w double"), "c", "t", "e")
    got = {r.k: (r.score, r.passed) for r in scoring.contract_scores(rules, ["k"], "w", 0.6).collect()}
    assert got == {1: (pytest.approx(0.95 / 1.5), True), 2: (0.0, False), 3: (1.0, True)}


def test_calibration(spark):
    import pandas as pd

    random.seed(1)
    rows = [(round(random.random(), 1), round(random.random(), 1)) for _ in range(60)]
    got = scoring.calibration(spark.createDataFrame(rows, "j double, h double"), "j", "h").first()
    want = pd.DataFrame(rows).rank().corr().iloc[0, 1]
    assert got.spearman == pytest.approx(want) and got.n == 60
    assert scoring.calibration(spark.createDataFrame([(0.5, 0.5)] * 4, "j double, h double"), "j", "h").first().passed is False


def test_parsing(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a\n+b\n+c\n@@ -9 +10 @@\n-d\n--- a/y.py\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-gone"
    df = spark.createDataFrame([(1, diff)], "k int, d string")
    assert [(r.hunk, r.file, r.added, r.removed) for r in parsing.hunks(df, "k", "d").orderBy("hunk").collect()] == [(1, "x.py", 2, 0), (2, "x.py", 0, 1), (3, "y.py", 0, 1)]
    steps = spark.createDataFrame([("1. first thing\n2. second thing\n3. third thing",), ("one para\n\ntwo para\n\nthree",), ("just one sentence",)], "t string").select(parsing.reasoning_steps(F.col("t")).alias("s")).collect()
    assert [len(r.s) for r in steps] == [3, 3, 1]
    js = spark.createDataFrame([('x ```json\n{"a": 1}\n``` y',), ("[1, 2]",), ("{broken",), ("no",)], "t string").select(parsing.extract_json(F.col("t")).alias("j")).collect()
    assert [r.j for r in js] == ['{"a": 1}', "[1, 2]", None, None]
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "string"}}}
    got = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "no", "b": "x"}',), ('{"b": "x"}',), ("[1]",), ("no",)], "t string").select(parsing.structured_output(F.col("t"), schema).alias("s")).collect()
    assert [r.s for r in got] == [1.0, 0.5, 0.5, 0.0, 0.0]


def test_mutants(spark):
    prompt = "You are a Formal assistant.\nNever share secrets.\nAlways cite sources.\nIf asked twice, be brief."
    got = mutation.generate(spark.createDataFrame([(1, prompt), (2, "nothing to change")], "k int, t string"), "k", "t").collect()
    assert {r.k for r in got} == {1}
    by = {r.operator: r for r in got}
    assert "secrets" not in by["NegateConstraint"].mutated and by["NegateConstraint"].removed == "Never share secrets."
    assert "cite" not in by["DropClause"].mutated and "twice" not in by["ConditionInvert"].mutated
    assert {"Casual", "detailed"} <= {w for r in got if r.operator == "PhraseSwap" for w in r.mutated.replace(".", "").split()}
    scores = scoring.mutation_scores(spark.createDataFrame([(1, 0.9, [0.4, 0.4]), (1, 0.9, [0.9]), (1, 0.9, [])], "k int, o double, r array<double>"), ["k"], "o", "r").first()
    assert (scores.killed, scores.survived, scores.skipped, scores.score) == (1, 1, 1, 0.5)


def test_gates_raise(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    with pytest.raises(errors.GateError) as e:
        errors.require(df, "ok", "gate")
    assert {r["id"] for r in e.value.rows} == {2, 3}
    assert errors.handle(df, "ok", "log").count() == 1
    assert {r.id for r in errors.handle(df, "ok", "fallback", {"id": 0}).collect()} == {1, 0}


def test_mutants_lose_the_line_that_matched(spark):
    texts = ["Please Never lie.\nNever lie.", "Never lie.\nNever lie.\nAlways cite.", "nothing here"]
    got = mutation.generate(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()
    assert [r.mutated for r in got if r.id == 0] == ["Please Never lie."]
    assert {r.mutated for r in got if r.id == 1} == {"Never lie.\nAlways cite.", "Never lie.\n\nAlways cite.", "Never lie.\nNever lie."}
    assert not [r for r in got if r.id == 2]


def test_steps_after_a_leading_connector_count_from_one(spark):
    texts = ["First do this. Then do that thing.", "However it stays one", "Do this now. Then do that thing."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", parsing.reasoning_steps(F.col("text")).alias("s"))
    assert {r.id: [x["index"] for x in r.s] for r in df.collect()} == {0: [1, 2], 1: [1], 2: [0, 1]}


def test_summaries_stand_for_the_oldest_messages(spark):
    rows = trim.keep_summary(messages(spark), "c", "role", "text", 600, reserved=450)
    got = {r.c: (r.n_dropped, r.summary) for r in rows.collect()}
    assert got[1] == (1, "[Context summary — 1 earlier messages]\n• User: " + "x" * 120)
    assert got[2] == (0, None)
    assert got[3] == (1, None)  # the system messages alone are too many
    tight = {r.c: (r.n_dropped, r.summary) for r in trim.keep_summary(messages(spark), "c", "role", "text", 60, reserved=0).collect()}
    assert tight[1] == (3, "[Summary: 3 msgs]\n• Assistant: is it important?\n• User: " + "y" * 60)


def test_gates(spark):
    runs = spark.createDataFrame([("a", 1, True, 0.9), ("a", 2, False, 0.2), ("a", 3, True, 0.8), ("b", 1, True, None)], "k string, t int, ok boolean, s double")
    last = {r.k: (r.n, r.passed) for r in gates.last_n_gate(runs, ["k"], "ok", 2, F.desc("t")).collect()}
    assert last == {"a": (2, False), "b": (1, True)}
    assert [r.passed for r in gates.share_gate(runs, [], F.col("ok"), least=0.75).collect()] == [True]
    assert [r.passed for r in gates.share_gate(runs.limit(0), [], F.col("ok"), least=0.1).collect()] == [False]
    assert [r.passed for r in gates.score_gate(runs, "s", least=0.5).orderBy("k", "t").collect()] == [True, False, True, False]
    with pytest.raises(errors.GateError):
        errors.require(gates.score_gate(runs, "s", most=0.5), "passed", "drift")
    assert [(r.t, r.s) for r in gates.best(runs, ["k"], "s", F.asc("t")).where("k = 'a'").collect()] == [(1, 0.9)]
    with pytest.raises(Exception, match="differ in length"):
        spark.range(1).select(gates.zipped(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))).collect()
    cases = spark.createDataFrame([(1, 0.9, 0.9, True, "HIGH", "x"), (1, 0.9, 0.1, True, "HIGH", "y"), (2, 0.9, 0.9, False, "HIGH", "z")], "p int, o double, m double, changed boolean, severity string, advice string")
    got = {r.p: (r.calibration_score, r.total, r.caught, r.missed, r.warnings) for r in gates.calibration(cases, ["p"], "o", "m", F.col("changed"), "severity", "advice").collect()}
    assert got == {1: (0.5, 2, 1, 1, ["x"]), 2: (0.0, 0, 0, 0, [])}
