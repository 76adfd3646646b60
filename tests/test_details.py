"""Assertions, settings, the trim facade, reports as files and Markdown, call estimates, and reasoning steps in plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from gaugeloom import config, testing
from gaugeloom.functions import text as X
from gaugeloom.operators import attribution, gates, ledger, parsing, scoring, trim
from gaugeloom.sources import sinks


def test_assertions(spark):
    df = spark.createDataFrame([("a", "CONSISTENT", 0.9, True, False, None), ("b", "BORDERLINE", 0.7, True, True, 3)], "k string, verdict string, score double, gate_passed boolean, detected boolean, onset int")
    assert testing.assert_consistent(df) is df
    with pytest.raises(AssertionError, match="BORDERLINE"):
        testing.assert_consistent(df, borderline_passes=False)
    testing.assert_no_livelock(df)
    with pytest.raises(AssertionError, match="livelock"):
        testing.assert_no_livelock(df, detected="detected")
    testing.assert_stable(df, 0.7)
    for more in ({"least": 0.8}, {"least": 0.5, "onset": "onset"}):
        with pytest.raises(AssertionError):
            testing.assert_stable(df, **more)
    testing.assert_attributed(df, "k", "score", "a")
    with pytest.raises(AssertionError, match="no chunk"):
        testing.assert_attributed(df, "k", "score", "z")
    testing.assert_dominated_by_none(df, "score", 0.95)
    with pytest.raises(AssertionError):
        testing.assert_passed(df.withColumn("passed", F.lit(None).cast("boolean")))


def test_settings():
    prompts, gate = config.loaded({"prompts": [{"path": "p/*.txt", "evals": [{"type": "regex", "pattern": "x", "threshold": 0.5}, {"type": "exact_match"}]}], "gate": {"mode": "hard"}})
    assert prompts[0].evals[0].threshold == 0.5 and prompts[0].evals[1].threshold == 0.7 and gate == config.Gate("hard")
    for bad in (lambda: config.Eval("regex"), lambda: config.Eval("other"), lambda: config.Eval("exact_match", 1.5), lambda: config.Gate("strict"), lambda: config.Eval("custom"), lambda: config.Eval("llm_judge")):
        with pytest.raises(ValueError):
            bad()
    own = config.Contract(judge_model="m", path="p").from_environment("X_", {"X_PATH": "q", "PATH": "no"})
    assert (own.judge_model, own.path, own.threshold) == ("m", "q", 0.9)


MESSAGES = [(1, 0, "system", "s" * 40), (1, 1, "user", "x" * 400), (1, 2, "assistant", "is it important?"), (1, 3, "user", "y" * 100), (2, 0, "user", "short"), (None, 0, "user", "no id")]


def test_trim_facade(spark):
    df = spark.createDataFrame(MESSAGES, "c int, t int, role string, text string")
    assert {(r.c, r.t) for r in trim.trim(df, "c", "t", "role", "text", 600, reserved=530).collect()} == {(1, 0), (1, 2), (1, 3), (2, 0), (None, 0)}
    assert trim.DEFAULT == "hybrid" and trim.trim(df, "c", "t", "role", "text", 10**6).count() == len(MESSAGES)
    got = sorted((r.c or 0, r.t, r.role, r.text[:22]) for r in trim.trim(df, "c", "t", "role", "text", 600, "summary", reserved=450).collect())
    assert got == [(0, 0, "user", "no id"), (1, 0, "system", "s" * 22), (1, 1, "system", "[Context summary — 1 e"), (1, 2, "assistant", "is it important?"), (1, 3, "user", "y" * 22), (2, 0, "user", "short")]
    with pytest.raises(ValueError):
        trim.trim(df, "c", "t", "role", "text", 600, "other")
    sums = {r.c: (r.tokens, r.tokens_over, r.fits) for r in trim.budget(df, "c", "role", "text", 520).collect()}
    assert sums[1] == (16 + 105 + 11 + 30, 154, False) and sums[2][2] is True


def test_reports_as_files_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", 0.5), (2, None, None)], "id int, name string, score double").orderBy("id")
    assert sinks.report_markdown("Scores", df) == "## Scores\n\n| id | name | score |\n| --- | --- | --- |\n| 1 | a\\|b | 0.5 |\n| 2 |  |  |"
    sinks.save_report(df, str(tmp_path / "r"))
    assert sinks.load_report(spark, str(tmp_path / "r"), "id int, name string, score double").exceptAll(df).count() == 0


def test_call_estimates():
    assert attribution.calls(5, 3) == (15, pytest.approx(0.015))
    with pytest.raises(ValueError):
        attribution.calls(500, 2)
    with pytest.raises(ValueError):
        attribution.calls(5, 3, most_cost=0.01)


def test_attribution_gate_names_what_fails(spark):
    scores = spark.createDataFrame([("t", "a", 0.2), ("t", "b", 0.99)], "trace string, chunk string, score double")
    got = attribution.gate(scores, ["trace"], "chunk", "score", must="a", least=0.3, most=0.95, contributing=2).first()
    assert got.violations == ["a below 0.3", "a chunk above 0.95", "fewer than 2 contribute"] and not got.passed
    assert attribution.gate(scores, ["trace"], "chunk", "score").first().passed
    assert attribution.gate(scores, ["trace"], "chunk", "score", must="absent").first().violations == ["absent below 0.3"]


def test_windows_without_rows(spark):
    rows = spark.createDataFrame([("a", "2024-01-30 12:00:00", False), ("a", "2024-01-01 00:00:00", True), ("b", "2024-01-01 00:00:00", False)], "k string, ts string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    assert sorted(map(tuple, ledger.recent_violation_rates(rows, ["k"], "ts", "ok", as_of).collect())) == [("a", 1, 1.0), ("b", 0, 0.0)]
    assert sorted(map(tuple, ledger.pass_rates(rows, ["k"], "ts", "ok", as_of, 7).collect()), key=str) == [("a", 0.0, 1), ("b", None, 0)]
    assert sorted(map(tuple, ledger.pass_rates(rows, ["k"], "ts", "ok").collect())) == [("a", 0.5, 2), ("b", 0.0, 1)]


def test_small_columns(spark):
    df = spark.createDataFrame([("Adds the upload client function to it",), ("!!! ???",), ("Fixes a thing",)], "t string")
    assert [r.s for r in df.select(parsing.clause_subject(F.col("t")).alias("s")).collect()] == [re.search(parsing.SUBJECT, t).group(1).strip() if re.search(parsing.SUBJECT, t) else t[:40] for (t,) in df.collect()]
    one = spark.range(1)
    assert one.select(X.padded_context(F.lit("base text"), F.lit(1), F.lit("pad"))).first()[0] == "base text"
    assert one.select(X.padded_context(F.lit("base text"), F.lit(5), F.lit("pad"))).first()[0] == "padpadpadpad\n\nbase text"
    assert one.select(scoring.correlated(F.lit(None).cast("double"))).first()[0] is True
    raw = spark.createDataFrame([('{"score": 0.7, "why": "x"}',), ("I give 0.2",), ("none",)], "r string")
    assert [(r.e.score, r.e.passed) for r in raw.select(scoring.judge_eval(F.col("r")).alias("e")).collect()] == [(0.7, True), (0.2, False), (0.5, False)]
    diff = "--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n" + "\n".join(f"+a{i}\n-r{i}\n same" for i in range(30))
    summary = parsing.hunk_summaries(spark.createDataFrame([(1, diff)], "k int, d string"), "k", "d").first().summary.split("\n")
    assert summary == ["File: x", *[f"- r{i}" for i in range(20)], *[f"+ a{i}" for i in range(20)]]


def plain_steps(text):
    raw = text.strip(" \t\r\n")
    numbered = re.split(parsing.NUMBERED, raw)
    if len(numbered) > 1:
        return [(i, s.strip(" \t\r\n")) for i, s in enumerate(numbered) if len(s.strip(" \t\r\n")) > 5]
    blank = [p.strip(" \t\r\n") for p in re.split(r"\n\n+", raw) if p.strip(" \t\r\n")]
    if len(blank) > 1:
        return list(enumerate(blank))
    words = re.split(parsing.CONNECTORS, raw)
    if len(words) > 1:
        return [(i, s.strip(" \t\r\n")) for i, s in enumerate(words) if len(s.strip(" \t\r\n")) > 5]
    return [(0, raw)]


def test_reasoning_steps_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    made = docs.unionByName(docs.select(-F.col("doc_id") - 1, F.concat(F.lit("1. "), F.replace("text", F.lit("\n"), F.lit("\n2) ")))).toDF("doc_id", "text"))
    made = made.unionByName(docs.select(F.col("doc_id") + 10**6, F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(". "), F.lit(". Then "))).toDF("doc_id", "text"))
    for r in made.select("text", parsing.reasoning_steps(F.col("text")).alias("s")).collect():
        assert [(s["index"], s["text"]) for s in r.s] == plain_steps(r.text), r.text[:200]


def test_calibration_warnings_keep_the_order_of_cases(spark):
    rows = [(1, i, 0.9, m, True, s, a, e) for i, (m, s, a, e) in enumerate([(0.9, "HIGH", "z", None), (None, "LOW", "y", "gone"), (0.1, "HIGH", "x", None), (0.9, "HIGH", "a", None), (0.9, "LOW", "b", None)])]
    cases = spark.createDataFrame(rows, "p int, at int, o double, m double, changed boolean, severity string, advice string, error string")
    got = gates.calibration(cases, ["p"], "o", "m", F.col("changed"), "severity", "advice", order="at", error="error").first()
    assert got.warnings == ["z", "Calibration case 'y' failed: gone", "a"] and (got.total, got.caught, got.missed, got.calibration_score) == (4, 1, 3, 0.25)


def test_regex_eval_reads_a_text_once(spark, tmp_path):
    import re
    import time

    from gaugeloom.plans import ledgers

    texts = ["the thing\n", "\nthe thing", "ing the\n", "theing\n", "th\neing\n", "", None, "the sing song\nthe", "thethe ing ing \n\n"]
    rows = [*enumerate(texts), (99, "the ing " * 4000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    got = {r.doc_id: r.passed for r in ledgers.regex_eval(spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else bool(re.search(r"(?s)the.*ing.*\n", t)) if i != 99 else False for i, t in rows}
    assert time.monotonic() - began < 20


def test_a_score_halfway_between_two_hundredths_is_told_as_in_sql(spark, tmp_path):
    from gaugeloom.plans import details

    spark.createDataFrame([(47476, "x" * 18)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (got,) = details.parity_explanations(spark, str(tmp_path)).collect()  # "Short." and 18 letters: 25 of 50, 0.925
    assert (got.dimension, got.candidate) == ("task_completion", 0.925) and "candidate=0.93 parity=0.93" in got.explanation
