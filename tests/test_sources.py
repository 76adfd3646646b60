import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import slots
from gaugeloom.sources import checked, scans, sinks


def told(df):
    return sorted((r.file.rsplit("/", 1)[-1], r.line, r.reason) for r in df.collect())


def test_rejected_lines_are_named(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"input": "a", "output": "b"}\n\n{"output": "no input"}\nbroken\n[1]\n  \n{"input": null, "more": 1}\n')
    good, bad = scans.cases(spark, str(tmp_path / "c.jsonl"))
    assert [(r.line, r.input, r.output) for r in good.orderBy("line").collect()] == [(1, "a", "b"), (7, None, None)]
    assert told(bad) == [("c.jsonl", 3, "missing input"), ("c.jsonl", 4, "invalid JSON"), ("c.jsonl", 5, "not an object")]
    (tmp_path / "h.jsonl").write_text('{"input": "a", "output": "b", "human_score": 0.5}\n{"input": "a", "output": "b", "human_score": 1.5}\n{"input": "a", "output": "b", "human_score": "0.25"}\n{"input": "a", "human_score": "x"}\n{"input": "a", "output": "b", "human_score": "x"}\n')
    good, bad = scans.human_labels(spark, str(tmp_path / "h.jsonl"))
    assert [(r.line, r.human_score) for r in good.orderBy("line").collect()] == [(1, 0.5), (3, 0.25)]
    assert told(bad) == [("h.jsonl", 2, "human_score must be between 0 and 1"), ("h.jsonl", 4, "missing output"), ("h.jsonl", 5, "human_score is no number")]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a", 400), ("b", 3), ("c", 1000)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i}{'x' * (i % 50)}\n" if i % 7 else "\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = checked.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = sorted((r.file[-5], r.line, r.value) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((p.name[0], i, line) for p in tmp_path.glob("*.txt") for i, line in enumerate(p.read_text().split("\n")[:-1], 1))


def test_entries_and_suites(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"prompt": "p", "with_cot_output": "w", "without_cot_output": "o"}')
    (tmp_path / "many.json").write_text('[{"prompt": "q", "cot_chain": "c",\n "with_cot_output": "w", "without_cot_output": "o"}, {"prompt": "lost"}, 7]')
    (tmp_path / "bad.json").write_text("{nothing")
    (tmp_path / "word.json").write_text('"text"')
    good, bad = scans.fidelity_pairs(spark, str(tmp_path / "*.json"))
    assert sorted((r.entry, r.prompt, r.cot_chain) for r in good.collect()) == [(0, "p", ""), (0, "q", "c")]
    assert sorted((r.file.rsplit("/", 1)[-1], -1 if r.entry is None else r.entry, r.reason) for r in bad.collect()) == [("bad.json", -1, "invalid JSON"), ("many.json", 1, "missing with_cot_output, without_cot_output"), ("many.json", 2, "not an object"), ("word.json", -1, "neither an object nor an array")]
    suites = tmp_path / "suites"
    suites.mkdir()
    (suites / "a.yaml").write_text("suite: mine\nthreshold: 0.7\ncases:\n  - id: one\n    steps: [x, y]\n    conclusion: z\n    expect: DEGRADED\n  - steps: [x]\n  - just text\n  - steps: not a list\n    conclusion: z\n  - {steps: [], conclusion: w}\n")
    (suites / "b.yaml").write_text("cases:\n- steps: [1, two]\n  conclusion: z\n")
    (suites / "c.yaml").write_text("- a list\n")
    (suites / "d.yaml").write_text("suite: x\ncases: 3\n")
    (suites / "e.yaml").write_text("suite: [x\n  y: {\n")
    (suites / "f.json").write_text('{"suite": "json", "cases": [{"steps": ["s"], "conclusion": "c"}]}')
    good, bad = scans.coherence_suites(spark, str(suites))
    assert sorted((r.suite, r.line, r.threshold, r.id, r.steps, r.conclusion, r.expect) for r in good.collect()) == [("b.yaml", 2, 0.55, "?", ["1", "two"], "z", "COHERENT"), ("json", 1, 0.55, "?", ["s"], "c", "COHERENT"), ("mine", 4, 0.7, "one", ["x", "y"], "z", "DEGRADED"), ("mine", 12, 0.7, "?", [], "w", "COHERENT")]
    reasons = told(bad)
    assert [r for r in reasons if r[0] != "e.yaml"] == [("a.yaml", 8, "missing conclusion"), ("a.yaml", 9, "not a mapping"), ("a.yaml", 10, "steps: not array<string>"), ("c.yaml", 1, "not a mapping"), ("d.yaml", 2, "cases is not a list")]
    assert [r[2] for r in reasons if r[0] == "e.yaml"] == ["invalid YAML"]


def test_scans(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]))
    assert [(r.turn, r.role) for r in scans.messages(spark, str(tmp_path / "m.json")).orderBy("turn").collect()] == [(0, "user"), (1, "assistant")]
    (tmp_path / "t.json").write_text(json.dumps({"goal": "g", "steps": ["one", {"output": "two"}]}))
    assert [r.output for r in scans.step_traces(spark, str(tmp_path / "t.json")).orderBy("step").collect()] == ["one", "two"]
    (tmp_path / "l.txt").write_text(" a \n\n b\n")
    assert sorted(r.output for r in scans.output_lines(spark, str(tmp_path / "l.txt")).collect()) == ["a", "b"]
    assert {(r.name.rsplit("/", 1)[-1], r.text) for r in scans.whole_texts(spark, str(tmp_path / "*.txt")).collect()} == {("l.txt", " a \n\n b\n")}
    files = spark.createDataFrame([("prompts/a.txt",), ("prompts/x/b.txt",), ("src/c.py",), ("prompts/a.txt",)], "p string")
    assert {r.p for r in scans.matching_files(files, "p", ["prompts/**/*.txt"]).collect()} == {"prompts/a.txt", "prompts/x/b.txt"}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "ledger")
    sinks.append_evals(spark.createDataFrame([(1, "x" * 900)], "id int, input string"), path)
    sinks.append_evals(spark.createDataFrame([(2, "y")], "id int, input string"), path)
    assert {len(r.input) for r in spark.read.parquet(path).collect()} == {500, 1}
    sinks.delete(spark, path, spark.createDataFrame([(1,)], "id int"), "id", str(tmp_path / "after"))
    assert spark.read.parquet(str(tmp_path / "after")).count() == 1
    up = str(tmp_path / "up")
    for seq, v in ((1, "a"), (2, "b")):
        sinks.upsert(spark.createDataFrame([(7, v, seq)], "id int, v string, _seq int"), up)
    assert [r.v for r in sinks.read_upserted(spark, up, ["id"]).collect()] == ["b"]
    df = spark.createDataFrame([(1, 0.5), (2, 1.0)], "id int, s double")
    assert sinks.from_json(sinks.as_json(df), "id int, s double").exceptAll(df).count() == 0
    assert sinks.bars(df, "id", "s").orderBy("id").collect()[0].line.count("█") == 5


def test_slots(spark):
    @slots.register_eval("length")
    def length(a: pd.Series, b: pd.Series) -> pd.Series:
        return b.str.len() / 2

    df = spark.createDataFrame([("a", "b"), ("a", "bbbb")], "x string, y string")
    assert [r.s for r in df.select(slots.custom_eval("length", F.col("x"), F.col("y")).alias("s")).collect()] == [0.5, 1.0]
    v = [r.v for r in df.select(slots.embed(F.col("x")).alias("v")).collect()]
    assert v[0] == v[1] and sum(x * x for x in v[0]) == pytest.approx(1)
    out = slots.run_agent(df, "x", lambda p: p.str.upper(), runs=3)
    assert out.count() == 6 and {r.output for r in out.collect()} == {"A"}
