"""Mutants and evaluators against plain Python, with evaluators that fail."""

import random
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeloom.operators import evaluation, mutation

cloudpickle.register_pickle_by_value(sys.modules[__name__])
PROMPTS = [
    "You are a Formal assistant.\nNever share secrets.\nAlways cite sources.\nIf the user asks twice, answer briefly.\nKeep it concise.",
    "Be friendly and brief.\n  Avoid jargon!\nYou must answer any question.\nEnsure totals agree.\n\n\n\nWhen in doubt, ask.",
    "Never lie.\nNever lie.\nAnswer in English only.\nReply about all topics broadly.",
    "mark ﷐ and ﷑ stay.\nNever drop ﷐ marks.\nAlways keep ﷑ them.",
    "Nothing of the kind",
    "",
    None,
]


def plain_mutants(text, most=20):
    out, seen = [], {text.strip()} if text is not None else set()
    found = []
    for operator, order, pattern in mutation.REMOVED:
        for i, m in enumerate(re.finditer(pattern, text or ""), 1):
            found.append((order * 1000 + i, operator, re.sub("\n{3,}", "\n\n", text[: m.start()] + text[m.end() :]).strip(), m.group().strip(), None))
    for operator, order, pattern, new in mutation.REPLACED:
        if m := re.search(pattern, text or ""):
            put = new.capitalize() if operator == "PhraseSwap" and m.group()[0].isupper() else new
            found.append((order * 1000, operator, text[: m.start()] + put + text[m.end() :], m.group(), put))
    for _, operator, mutated, removed, _ in sorted(found, key=lambda f: f[0]):
        if mutated.strip() not in seen:
            seen.add(mutated.strip())
            out.append((operator, mutated, removed))
    return out[:most]


def made(spark, texts, how):
    got = how(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()
    return {i: [(r.operator, r.mutated, r.removed) for r in got if r.id == i] for i in range(len(texts))}, got


def test_mutants_are_plain_python(spark):
    dice = random.Random(9)
    lines = [p for t in PROMPTS if t for p in t.split("\n")] + ["x" * 30, "do not", "Never ", "always  be formal and Casual", "anything you like", "topics related to maths", "if a, b"]
    texts = PROMPTS + ["\n".join(dice.choices(lines, k=dice.randrange(1, 9))) for _ in range(60)]
    got, rows = made(spark, texts, mutation.generate)
    for i, text in enumerate(texts):
        assert sorted(got[i]) == sorted(plain_mutants(text)), text
    advice = {r.operator: r.recommendation for r in rows if r.id == 0}
    assert advice["NegateConstraint"] == "Add test case where user attempts to: share secrets. Expected: LLM refuses/redirects."
    assert advice["DropClause"] == "Add test case verifying the LLM does: cite sources. Expected: behavior present in every response."
    assert 'output style matches "Formal" (not the mutated "Casual")' in " ".join(r.recommendation for r in rows if r.id == 0)
    assert all(r.recommendation for r in rows)


def test_both_forms_agree_on_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    texts = docs.select(F.concat(F.lit("Never "), F.translate("text", ".", "\n"), F.lit("\nAlways be concise.\nIf so, "), F.left("text", F.lit(40))).alias("t")).distinct()
    rows = texts.withColumn("id", F.row_number().over(Window.orderBy("t")))
    a, b = mutation.generate(rows, "id", "t"), mutation.generate_by_columns(rows, "id", "t")
    assert a.count() > 100
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def plain_calibration(text):
    strip = lambda starts: re.sub("\n{3,}", "\n\n", re.sub(rf"(?m)^[ \t]*(?:{starts})\s+.+[.!]?\s*$", "", text)).strip() or text
    lines = text.strip().split("\n")
    return [mutation.GENERIC, *[strip(s) for s in mutation.STRIPPED.values()], "\n".join(lines[1:]).strip() if len(lines) > 1 else text, "\n".join(lines[:-1]).strip() or text]


def test_calibration_mutants_are_plain_python(spark):
    texts = [p for p in PROMPTS if p is not None] + ["Never do.\n", "\n one line \n\n", "a\n\nb\n \nAlways c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mutation.calibration_mutants(F.col("t")).alias("m"))
    for r in df.collect():
        assert [m.text for m in r.m] == plain_calibration(r.t), r.t
        assert [m.kind for m in r.m] == [c[0] for c in mutation.CALIBRATION]


def judge(prompt, cases):
    """Fails, or leaves the range, by what the prompt says."""
    if "boom" in prompt:
        raise RuntimeError("no model")
    if "value" in prompt:
        raise ValueError("bad value")
    if "large" in prompt:
        return 1.5
    if "nan" in prompt:
        return float("nan")
    return sum(c["word"] in prompt for c in cases) / len(cases) if cases else 0.0


CASES = [("s", 1, "Never"), ("s", 2, "cite"), ("s", 3, "Formal"), ("t", 1, "brief")]


def test_scores_out_of_range_are_rows(spark):
    cases = spark.createDataFrame(CASES, "suite string, n int, word string")
    rows = [(i, "s" if i % 2 else "t", p) for i, p in enumerate(["be brief", "Never cite Formal", "boom", "large", "value", "nan", None, "Never"])] + [(9, "none", "x"), (10, None, "x")]
    out = evaluation.evaluate(spark.createDataFrame(rows, "id int, suite string, p string").repartition(3), cases, "suite", "p", judge, order="n", runs=3, at_once=4)
    got = {r.id: (r.score, r.error) for r in out.collect()}
    assert got == {
        0: (1.0, None), 1: (1.0, None), 2: (None, "eval_fn raised an exception: no model"), 3: (None, "eval_fn returned 1.5 — must be between 0.0 and 1.0"), 4: (None, "bad value"),
        5: (None, "eval_fn returned nan — must be between 0.0 and 1.0"), 6: (None, "no prompt"), 7: (pytest.approx(1 / 3), None), 9: (0.0, None), 10: (0.0, None),
    }
    with pytest.raises(ValueError):
        evaluation.evaluate(out, cases, "suite", "p", judge, runs=0)
    assert [r.id for r in evaluation.best_of(out, ["suite"], "score", "id").where("suite = 's'").collect()] == [1]


def test_mutants_are_killed_survive_or_are_skipped(spark):
    cases = spark.createDataFrame(CASES, "suite string, n int, word string")
    prompts = spark.createDataFrame([(1, "s", "You are Formal.\nNever cite large secrets."), (2, "s", "You are Formal.\nNever share.\nAlways cite.\nKeep it brief."), (3, "s", "boom\nNever cite.")], "id int, suite string, p string")
    mutants = mutation.generate(prompts, "id", "p").withColumn("mutated", F.when(F.col("operator") == "PhraseSwap", F.concat("mutated", F.when(F.col("id") == 2, F.lit("")).otherwise(F.lit(" nan")))).otherwise(F.col("mutated")))
    out = evaluation.run_mutants(prompts, mutants, cases, "suite", "id", "p", "mutated", judge, order="n")
    rows = {(r.id, r.operator, r.removed): (r.verdict, r.error) for r in out.collect()}
    assert rows[2, "NegateConstraint", "Never share."] == ("KILLED", None)
    assert rows[2, "PhraseSwap", "brief"] == ("SURVIVED", None)
    assert rows[3, "NegateConstraint", "Never cite."][0] == "SKIPPED" and "no model" in rows[3, "NegateConstraint", "Never cite."][1]
    report = {r.id: r for r in evaluation.mutation_report(out, "id").collect()}
    assert (report[2].total, report[2].killed, report[2].survived, report[2].skipped) == (4, 3, 1, 0) and report[2].score == 0.75 and report[2].verdict == "MARGINAL"
    assert report[2].recommendations == ['Test that the LLM output style matches "brief" (not the mutated "detailed") — verify style constraint is enforced.']
    assert (report[3].killed, report[3].survived, report[3].score) == (0, 0, 0.0)


def test_calibration_names_cases_in_order_and_those_that_failed(spark):
    cases = spark.createDataFrame(CASES, "suite string, n int, word string")
    prompts = spark.createDataFrame([(1, "s", "You are Formal boss.\nNever share.\nAlways cite."), (2, "t", "brief nan\nNever large"), (3, "t", "x")], "id int, suite string, p string")

    def picky(prompt, given):
        if prompt == mutation.GENERIC:
            raise RuntimeError("offline")
        return 0.5 if "Never" in prompt or "Formal" in prompt else 0.45

    got = {r.id: r for r in evaluation.calibrate(prompts, cases, "suite", "id", "p", picky).collect()}
    told = {c[0]: c for c in mutation.CALIBRATION}
    assert got[1].warnings == [f"Calibration case '{told['generic'][2]}' failed: eval_fn raised an exception: offline", told["no_prohibitions"][3]]
    assert (got[1].total, got[1].caught, got[1].missed, got[1].calibration_score) == (4, 0, 4, 0.0)
    good = {r.id: r for r in evaluation.calibrate(prompts.where("id = 1"), cases, "suite", "id", "p", judge).collect()}
    assert good[1].calibration_score == 1.0 and good[1].warnings == []
