"""Queries on run logs, scores, gates, mutants and parsing.

`events` stands for a run log: an event passes unless it is an error.  Responses, prompts, changes and judges' answers are made of the tables' whole texts, with
phrases of the lists below, dealt out by id, for the evaluators to find.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeloom.functions import text as X
from gaugeloom.functions import verdicts
from gaugeloom.operators import attribution, ledger, mutation, parsing, scoring

AS_OF = "2024-01-31 00:00:00"
RESPONSES = [
    "I cannot help with that request.",
    "I think the answer is possibly twelve, but I am not certain about it at all.",
    "Alpha, beta, gamma",
    "",
    "The quarterly report is finished and the totals agree with the ledger in every line.",
    "Traceback (most recent call last): Error in line 4",
    "I'm sorry, but I won't do that.",
    "Short.",
]
CONSTRAINTS = ["exactly 3 items", "at least 2 items", 'must contain "ledger"', "include the report"]
INTENTS = [
    "Adds a retry to the upload client. Fixes the timeout of slow links.",
    "Removes the legacy exporter\nUpdates the configuration of the nightly job",
    "Ensures that totals are checked! Does not touch the reader",
    "Reworks naming in the module. ok",
]
SCHEMA = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "n": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}}


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sql_list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in xs) + "]"


def _dealt(id_col: str, xs: list[str]):
    return F.get(F.array(*map(F.lit, xs)), F.pmod(F.col(id_col), F.lit(len(xs))).cast("int"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props", F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("event_type") != "error").alias("passed"))


def ledger_recent(spark, sf):
    return ledger.recent(events(spark, sf).select("event_id", "user_id", "event_type"), 20, F.desc("event_id"))


def latest_per_key(spark, sf):
    return ledger.latest_per_key(events(spark, sf), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


def trailing_window(spark, sf):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return ledger.since(events(spark, sf), "ts", as_of, "7 DAYS").select("event_id", "user_id", "passed")


def distinct_specs(spark, sf):
    return ledger.distinct_values(events(spark, sf), "event_type")


def _order():
    return F.struct("ts", "event_id")


def ledger_baseline(spark, sf):
    return ledger.baseline(events(spark, sf), ["user_id"], "value", "passed", F.desc(_order())).select("user_id", F.round("baseline", 6).alias("baseline"))


def regression_gate(spark, sf):
    e = events(spark, sf)
    last = ledger.latest_per_key(e, ["user_id"], F.desc(_order())).select("user_id", "event_id", "value")
    before = ledger.baseline(e.join(last.select("event_id"), "event_id", "left_anti"), ["user_id"], "value", "passed", F.desc(_order()))
    return ledger.gate(last.join(before, "user_id", "left"), "value", "baseline", "regression").select("user_id", "value", F.round("baseline", 6).alias("baseline"), "should_fail")


def _average_gate(spark, sf, mode):
    e = ledger.average_scores(events(spark, sf).withColumn("value", F.col("value") / 100), ["event_type"], "value")
    return ledger.gate(e.withColumns({"score": F.round("score", 6), "baseline": F.lit(None).cast("double")}), "score", "baseline", mode, hard=0.5)


def hard_gate(spark, sf):
    return _average_gate(spark, sf, "hard").select("event_type", "score", "should_fail")


def soft_gate(spark, sf):
    return _average_gate(spark, sf, "soft").select("event_type", "n", "should_fail", "reason")


def ledger_diff_commits(spark, sf):
    d = ledger.diff(_read(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", "F", "O")
    return d.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("score_a", "score_b", "delta")])


def contract_pass_rate(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"), F.count("*").alias("n"))


def contract_list(spark, sf):
    return ledger.contract_list(events(spark, sf), ["user_id", "event_type"], "ts", "passed").select("user_id", "event_type", "total", "passed_count", F.col("last_seen").cast("string").alias("last_seen"), F.round("pass_rate", 6).alias("pass_rate"))


def contract_half_drift(spark, sf):
    d = ledger.half_drift(events(spark, sf), ["user_id"], "ts", "passed", F.lit(AS_OF).cast("timestamp_ntz"))
    return d.select("user_id", F.round("current", 6).alias("current"), F.round("prior", 6).alias("prior"), F.round("drift_pp", 6).alias("drift_pp"), "has_drift", "n")


def fidelity_drift(spark, sf):
    e = events(spark, sf).withColumn("score", F.col("value") / 100)
    d = ledger.fidelity_drift(e, ["user_id"], "score", F.desc(_order()))
    return d.select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "drift_detected", "trend")


def spec_checks(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", scoring.authorized(F.col("event_type"), ["view", "click", "purchase"]).alias("authorized"), scoring.three_sigma(F.col("value"), F.lit(50.0), F.lit(49.0)).alias("three_sigma"), scoring.pattern(F.col("props"), r'"k": \d{2}').alias("pattern"), scoring.word_bounds(F.col("props"), 1, 2).alias("length"))


def spec_violation_rate(spark, sf):
    return ledger.violation_rates(events(spark, sf), ["user_id"], "passed").withColumn("rate", F.round("rate", 6))


def spec_field_rates(spark, sf):
    c = spec_checks(spark, sf)
    return ledger.field_rates(c.select(F.create_map(*[x for n in ("authorized", "three_sigma", "pattern", "length") for x in (F.lit(n), F.col(n))]).alias("r")), "r")


def contract_score(spark, sf):
    l = _read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("confidence"), F.lit(0.3).alias("threshold"), (F.col("l_linestatus") == "O").alias("enabled"), F.when(F.col("l_linenumber") == 1, 1.0).otherwise(0.5).alias("weight"))  # noqa: E741
    s = scoring.contract_scores(scoring.rule_verdicts(l, "confidence", "threshold", "enabled"), ["l_orderkey"], "weight", 0.5)
    return s.withColumn("score", F.round("score", 6))


def judge_calibration(spark, sf):
    d = _read(spark, sf, "labels").join(_read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("judge"), F.col("quality").cast("double").alias("human"))
    c = scoring.calibration(d, "judge", "human")
    return c.select("n", *[F.round(x, 6).alias(x) for x in ("agreement", "spearman", "bias")], "passed")


def exact_match_eval(spark, sf):
    c = _read(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    return c.select("doc_id", scoring.exact_match(F.get("l", F.lit(0)), F.element_at("l", -1)).alias("passed"))


def regex_eval(spark, sf):
    """The nearest of each part is as good as any: possessive parts from the text's beginning read it once, where a search for
    `(?s)the.*ing.*\\n` in a text without a match tries each pair of its words."""
    return _read(spark, sf, "documents").select("doc_id", F.col("text").rlike(r"(?s)\A(?>.*?the)(?>.*?ing)(?>.*?\n)").alias("passed"))


def semantic_accuracy(spark, sf):
    """Each document against a benchmark item: all items are dealt out."""
    b = _read(spark, sf, "benchmark").select("item_id", F.col("text").alias("golden"))
    many = b.agg(F.greatest(F.count("*"), F.lit(1)).alias("_many"))
    d = _read(spark, sf, "documents").crossJoin(F.broadcast(many)).select("doc_id", F.col("text").alias("response"), F.pmod("doc_id", "_many").alias("item_id"))
    return d.join(b, "item_id").select("doc_id", F.round(scoring.semantic_accuracy(F.col("response"), F.col("golden")), 6).alias("score"), F.round(scoring.reasoning_coherence(F.col("response"), F.lower("golden")), 6).alias("coherence"))


def templated(spark, sf):
    """Two responses made of each document's whole text, with a phrase before it or behind it; none where the phrase is empty."""
    phrase, later = _dealt("doc_id", RESPONSES), _dealt("doc_id", RESPONSES[3:] + RESPONSES[:3])
    whole = lambda p, *parts: F.when(p == "", p).otherwise(F.concat(*parts))
    d = _read(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return d.select("doc_id", whole(phrase, phrase, F.lit("\n"), "text").alias("response"), whole(later, "text", F.lit(" "), later).alias("other"), F.slice(F.array(*map(F.lit, CONSTRAINTS)), 1, (F.pmod("doc_id", F.lit(4)) + 1).cast("int")).alias("constraints"))


def task_completion(spark, sf):
    return templated(spark, sf).select("doc_id", F.round(scoring.task_completion(F.col("response"), F.pmod("doc_id", F.lit(2)) == 0), 6).alias("score"))


def safety_compliance(spark, sf):
    expected = F.when(F.pmod("doc_id", F.lit(3)) < 2, F.pmod("doc_id", F.lit(3)) == 0)
    return templated(spark, sf).select("doc_id", scoring.safety_compliance(F.col("response"), expected).alias("score"))


def edge_case_handling(spark, sf):
    return templated(spark, sf).select("doc_id", scoring.edge_case_handling(F.col("response"), F.lit(True)).alias("score"))


def instruction_adherence(spark, sf):
    return templated(spark, sf).select("doc_id", F.round(scoring.instruction_adherence(F.col("response"), F.col("constraints")), 6).alias("score"))


def parity_tests(spark, sf):
    t = templated(spark, sf)
    dims = F.get(F.array(*map(F.lit, ["adherence", "completion", "edge", "safety"])), F.pmod("doc_id", F.lit(4)).cast("int"))
    def of(response):
        r = F.col(response)
        return F.when(F.col("dimension") == "adherence", scoring.instruction_adherence(r, F.col("constraints"))).when(F.col("dimension") == "completion", scoring.task_completion(r, F.lit(True))).when(F.col("dimension") == "edge", scoring.edge_case_handling(r, F.lit(True))).otherwise(scoring.safety_compliance(r, F.lit(False)))

    t = t.withColumn("dimension", dims)
    return scoring.parity(t.select("doc_id", "dimension", of("response").alias("baseline"), of("other").alias("candidate")), "baseline", "candidate")


def parity_results(spark, sf):
    return parity_tests(spark, sf).select("doc_id", "dimension", *[F.round(c, 6).alias(c) for c in ("baseline", "candidate", "parity")], "passed", "direction")


def parity_dimensions(spark, sf):
    d = scoring.dimensions(parity_tests(spark, sf), "dimension", "baseline", "candidate")
    return d.select("dimension", "n_tests", "n_passed", *[F.round(c, 6).alias(c) for c in ("parity", "baseline_avg", "candidate_avg", "delta")])


def parity_certificate(spark, sf):
    return scoring.certificate(scoring.dimensions(parity_tests(spark, sf), "dimension", "baseline", "candidate"), "dimension").withColumn("parity", F.round("parity", 6))


def embedding_pairs(spark, sf):
    e = _read(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("base"))
    return e.join(first, "label").select("vec_id", "label", X.dense_cosine(F.col("embedding"), F.col("base")).alias("similarity"))


def embedding_cosine(spark, sf):
    return embedding_pairs(spark, sf).withColumn("similarity", F.round("similarity", 6))


def attribution_scores(spark, sf):
    a = attribution.attribution(embedding_pairs(spark, sf), ["label"], "similarity")
    return a.select("label", "runs", *[F.round(c, 6).alias(c) for c in ("score", "mean_similarity", "std_similarity")])


def attribution_gate(spark, sf):
    a = attribution.attribution(embedding_pairs(spark, sf).withColumn("trace", F.lit(1)).withColumn("chunk", F.col("label").cast("string")), ["trace", "chunk"], "similarity")
    g = attribution.gate(a, ["trace"], "chunk", "score", must="0", least=0.3, most=0.95, contributing=2)
    return g.select("trace", F.array_join("violations", "; ").alias("violations"), "passed")


def attribution_compare(spark, sf):
    p = embedding_pairs(spark, sf)
    half = lambda r: attribution.attribution(p.where(F.pmod("vec_id", F.lit(2)) == r), ["label"], "similarity")
    return ledger.compare_maps(half(0), half(1).where("label > 0"), "label", "score").select("label", *[F.round(c, 6).alias(c) for c in ("score_a", "score_b", "delta")])


def top_contributors(spark, sf):
    p = embedding_pairs(spark, sf).withColumn("score", F.round(1 - F.col("similarity"), 6))
    return ledger.top_per_group(p, ["label"], 3, F.desc("score"), F.asc("vec_id")).select("label", "vec_id", "score")


def mutation_score(spark, sf):
    e = events(spark, sf).groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list(F.col("value") / 100)).alias("runs")).withColumn("original", F.lit(0.6))
    s = scoring.mutation_scores(e.withColumn("runs", F.when(F.col("event_type") != "error", F.col("runs")).otherwise(F.array().cast("array<double>"))), ["user_id"], "original", "runs")
    return s.withColumn("score", F.round("score", 6))


def coherence_status(spark, sf):
    l = _read(spark, sf, "lineitem")  # noqa: E741
    dims = {"d1": F.col("l_discount") * 10, "d2": F.col("l_tax") * 12, "d3": F.col("l_quantity") / 50, "d4": F.lit(0.75), "d5": F.when(F.col("l_linenumber") > 2, 0.9)}
    c = scoring.coherence(l.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in dims.items()], F.lit(0.7).alias("judged")), list(dims), "judged")
    return c.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), "status", "n_passed")


def label_budget_compare(spark, sf):
    return ledger.side_by_side(events(spark, sf), ["user_id"], "event_type", "value", "click", "view").withColumns({c: F.round(c, 6) for c in ("a", "b")})


def largest_changes(spark, sf):
    """Labels whose attribution differs most between the vectors of even and odd ids."""
    return ledger.largest_changes(attribution_compare(spark, sf).withColumn("delta", F.round("delta", 6)), 3, "label")


def intent_clauses(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", F.concat(_dealt("doc_id", INTENTS), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", F.posexplode(parsing.intent_clauses(F.col("t"))).alias("n", "c")).select("doc_id", F.col("n").cast("bigint").alias("n"), F.md5("c.text").alias("clause"), F.col("c.type").alias("kind"))


def changes(spark, sf):
    """A document's lines as a change of a file: kept, added and removed in turn, a hunk for each ten lines."""
    def line(x, i):
        sign = F.get(F.array(*map(F.lit, " +-+")), F.pmod(i, F.lit(4)))
        head = F.concat(F.lit("@@ -"), (i + 1).cast("string"), F.lit(",10 +"), (i + 1).cast("string"), F.lit(",10 @@\n"))
        return F.concat(F.when(F.pmod(i, F.lit(10)) == 0, head).otherwise(""), sign, x)

    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt\n"))
    lines = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return _read(spark, sf, "documents").select("doc_id", F.concat(F.lit("--- a/"), name, F.lit("+++ b/"), name, lines).alias("d"))


def diff_stats(spark, sf):
    return parsing.diff_stats(changes(spark, sf), "doc_id", "d")


def diff_hunks(spark, sf):
    return parsing.hunks(changes(spark, sf), "doc_id", "d")


def cot_steps(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.inline(parsing.reasoning_steps(F.col("text")))).select("doc_id", "index", F.md5("text").alias("digest"))


def json_extract_score(spark, sf):
    """Turns as JSON, whole or in a fence, some with a field of another type, without one, or cut off."""
    turns = _read(spark, sf, "conversations")
    k = F.pmod(F.col("turn") + F.col("conv_id"), F.lit(5))
    tags = F.when(k == 3, F.lit("[")).otherwise(F.to_json(F.array("text")))
    name = F.when(k == 1, F.lit('"name": 7, ')).when(k == 2, F.lit("")).otherwise(F.concat(F.lit('"name": "'), F.col("role"), F.lit('", ')))
    body = F.concat(F.lit("{"), name, F.lit('"n": '), F.col("turn").cast("string"), F.lit(', "tags": '), tags, F.when(k == 3, F.lit("")).otherwise(F.lit("}")))
    text = F.when(k == 4, F.concat(F.lit("Here: ```json\n"), body, F.lit("\n``` done"))).otherwise(body)
    return turns.select("conv_id", "turn", text.alias("t")).select("conv_id", "turn", parsing.structured_output(F.col("t"), json.dumps(SCHEMA)).alias("score"), parsing.structured_output(F.col("t")).alias("valid"))


def prompts(spark, sf):
    """A prompt made of each turn's whole text."""
    return _read(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("You are a Formal assistant.\nNever "), F.translate("text", "\n", " "), F.lit("\nAlways cite "), F.col("role"), F.lit(".\nIf asked twice, be brief.\n"), F.col("text")).alias("t"))


def phrase_swap(spark, sf):
    p = prompts(spark, sf)
    return p.select("id", F.md5(mutation.phrase_swap(F.col("t"), "formal", "casual")).alias("swapped"), F.md5(mutation.phrase_swap(F.col("t"), "brief", "detailed")).alias("swapped2"))


def mutations_generate(spark, sf):
    return mutation.generate(prompts(spark, sf), "id", "t")


def calibration_mutants(spark, sf):
    return prompts(spark, sf).select("id", F.inline(mutation.calibration_mutants(F.col("t")))).select("id", "kind", F.md5("text").alias("digest"))


def flattened_messages(spark, sf):
    c = _read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", F.md5(mutation.flatten_messages(F.col("m"))).alias("digest"))


def judge_scores(spark, sf):
    """Judges' answers made of whole turns: JSON, a number in prose, or no number but what the text has."""
    c = _read(spark, sf, "conversations")
    k = F.pmod(F.col("turn") + F.col("conv_id"), F.lit(3))
    raw = F.concat(F.lit('{"score": '), (F.char_length("text") / 1000).cast("decimal(10,3)").cast("string"), F.lit(', "why": '), F.expr("substr(to_json(named_struct('t', text)), 6)"))
    said = F.concat("text", F.lit(" I say 0."), F.pmod("conv_id", F.lit(10)).cast("string"), F.lit(" of it"))
    return c.select("conv_id", "turn", scoring.judge_score(F.when(k == 0, raw).when(k == 1, said).otherwise(F.col("text"))).alias("score"))


def masked_chunks(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.md5(X.mask_first(F.col("text"), F.lit("the"), F.lit("[REMOVED]:the"))).alias("digest"))


_EV = "e AS (SELECT *, event_type <> 'error' AS passed FROM events)"
_RESP = (
    f"p AS (SELECT doc_id, coalesce(text, '') AS text, {_sql_list(RESPONSES)}[doc_id % 8 + 1] AS a, {_sql_list(RESPONSES[3:] + RESPONSES[:3])}[doc_id % 8 + 1] AS b, {_sql_list(CONSTRAINTS)}[1:doc_id % 4 + 1] AS cs FROM documents), "
    "t AS (SELECT doc_id, cs, CASE WHEN a = '' THEN a ELSE a || chr(10) || text END AS response, CASE WHEN b = '' THEN b ELSE text || ' ' || b END AS other FROM p)"
)
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def _refuses(r: str) -> str:
    return f"regexp_matches({r}, '{scoring.REFUSAL.replace(chr(39), chr(39) * 2)}')"


def _completion(r: str, required: str) -> str:
    return f"CASE WHEN trim({r}, {_BLANK}) = '' THEN 0.0::DOUBLE WHEN {_refuses(r)} AND {required} THEN 0.0::DOUBLE WHEN {_refuses(r)} THEN 0.1::DOUBLE WHEN regexp_matches({r}, '{scoring.HEDGING.replace(chr(39), chr(39) * 2)}') THEN 0.7::DOUBLE ELSE least(1.0::DOUBLE, 0.85::DOUBLE + 0.15::DOUBLE * least(1.0::DOUBLE, length(trim({r}, {_BLANK})) / 50::DOUBLE)) END"


def _safety(r: str, expected: str) -> str:
    return f"CASE WHEN {expected} IS NULL THEN CASE WHEN trim({r}, {_BLANK}) <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN {expected} = {_refuses(r)} THEN 1.0::DOUBLE WHEN {expected} THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END"


def _edge(r: str) -> str:
    return f"CASE WHEN trim({r}, {_BLANK}) = '' THEN 0.0::DOUBLE WHEN regexp_matches({r}, '{scoring.CRASH}') THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END"


def _adherence(r: str) -> str:
    items = f"len(list_filter(regexp_split_to_array({r}, '[\\n,;]'), lambda x: trim(x, {_BLANK}) <> ''))"
    bullets = rf"len(regexp_extract_all({r}, '(?:^|\n)\s*[-*•\d]+[.)]\s+\S'))"
    met = f"CASE c WHEN 'exactly 3 items' THEN CASE WHEN {bullets} > 0 THEN {bullets} ELSE {items} END = 3 WHEN 'at least 2 items' THEN {items} >= 2 WHEN 'must contain \"ledger\"' THEN contains(lower({r}), 'ledger') ELSE contains(lower({r}), 'report') END"
    return f"len(list_filter(cs, lambda c: {met}))::DOUBLE / len(cs)"


_PARITY = f"""{_RESP}, d AS (SELECT *, ['adherence', 'completion', 'edge', 'safety'][doc_id % 4 + 1] AS dimension FROM t),
sc AS (SELECT doc_id, dimension,
  CASE dimension WHEN 'adherence' THEN {_adherence('response')} WHEN 'completion' THEN {_completion('response', 'true')} WHEN 'edge' THEN {_edge('response')} ELSE {_safety('response', 'false')} END AS baseline,
  CASE dimension WHEN 'adherence' THEN {_adherence('other')} WHEN 'completion' THEN {_completion('other', 'true')} WHEN 'edge' THEN {_edge('other')} ELSE {_safety('other', 'false')} END AS candidate FROM d),
pt AS (SELECT *, 1 - abs(baseline - candidate) AS parity FROM sc),
dm AS (SELECT dimension, count(*)::BIGINT AS n_tests, count_if(parity >= 0.8::DOUBLE)::BIGINT AS n_passed, avg(parity) AS parity, avg(baseline) AS baseline_avg, avg(candidate) AS candidate_avg, avg(candidate) - avg(baseline) AS delta FROM pt GROUP BY dimension)"""
_EMB = """f AS (SELECT label, arg_min(embedding, vec_id) AS base FROM embeddings GROUP BY label),
p AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], base::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(base::DOUBLE[], base::DOUBLE[]))) AS similarity FROM embeddings JOIN f USING (label))"""

_CHANGED = "l AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS name, i, [' ', '+', '-', '+'][(i - 1) % 4 + 1] || ls[i] AS l FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents), unnest(generate_series(1, len(ls))) u(i))"
_PROMPTS = "t AS (SELECT conv_id || '-' || turn AS id, 'You are a Formal assistant.' || chr(10) || 'Never ' || replace(text, chr(10), ' ') || chr(10) || 'Always cite ' || role || '.' || chr(10) || 'If asked twice, be brief.' || chr(10) || text AS t FROM conversations)"

QUERIES = {f.__name__: f for f in (
    ledger_recent, latest_per_key, trailing_window, distinct_specs, ledger_baseline, regression_gate, hard_gate, soft_gate, largest_changes, ledger_diff_commits, contract_pass_rate, contract_list, contract_half_drift,
    fidelity_drift, spec_checks, spec_violation_rate, spec_field_rates, contract_score, judge_calibration, exact_match_eval, regex_eval, semantic_accuracy, task_completion, safety_compliance,
    edge_case_handling, instruction_adherence, parity_results, parity_dimensions, parity_certificate, embedding_cosine, attribution_scores, attribution_gate, attribution_compare, top_contributors,
    mutation_score, coherence_status, label_budget_compare, intent_clauses, diff_stats, diff_hunks, cot_steps, json_extract_score, phrase_swap, mutations_generate, calibration_mutants,
    flattened_messages, judge_scores, masked_chunks,
)}

ORACLES = {
    "ledger_recent": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 20",
    "latest_per_key": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "trailing_window": f"SELECT event_id, user_id, event_type <> 'error' AS passed FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS AND ts <= TIMESTAMP '{AS_OF}'",
    "distinct_specs": "SELECT DISTINCT event_type FROM events ORDER BY event_type",
    "ledger_baseline": f"WITH {_EV} SELECT user_id, round(avg(value), 6) AS baseline FROM (SELECT * FROM e WHERE passed QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5) GROUP BY user_id",
    "regression_gate": f"WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM e), b AS (SELECT user_id, avg(value) AS baseline FROM (SELECT * FROM r WHERE n > 1 AND passed QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n) <= 5) GROUP BY user_id) SELECT r.user_id, value, round(baseline, 6) AS baseline, coalesce(baseline - value > 0.05::DOUBLE, false) AS should_fail FROM r LEFT JOIN b USING (user_id) WHERE n = 1",
    "hard_gate": "SELECT event_type, round(avg(value) / 100, 6) AS score, round(avg(value) / 100, 6) < 0.5::DOUBLE AS should_fail FROM events GROUP BY event_type",
    "soft_gate": "SELECT event_type, count(*)::BIGINT AS n, false AS should_fail, printf('score %.3f, warning only', round(avg(value / 100), 6)) AS reason FROM events GROUP BY event_type",
    "ledger_diff_commits": "WITH a AS (SELECT o_orderpriority, avg(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_orderpriority, avg(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) SELECT coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, round(a.s, 4) AS score_a, round(b.s, 4) AS score_b, round(b.s - a.s, 4) AS delta FROM a FULL JOIN b ON a.o_orderpriority = b.o_orderpriority",
    "contract_pass_rate": f"WITH {_EV} SELECT user_id, round(avg(passed::INT), 6) AS pass_rate, count(*)::BIGINT AS n FROM e GROUP BY user_id",
    "contract_list": f"WITH {_EV} SELECT user_id, event_type, count(*)::BIGINT AS total, count_if(passed)::BIGINT AS passed_count, max(ts)::VARCHAR AS last_seen, round(avg(passed::INT), 6) AS pass_rate FROM e GROUP BY user_id, event_type",
    "contract_half_drift": f"WITH {_EV}, h AS (SELECT user_id, avg(passed::INT) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 15 DAYS) AS c, avg(passed::INT) FILTER (WHERE ts < TIMESTAMP '{AS_OF}' - INTERVAL 15 DAYS) AS p, count(*)::BIGINT AS n FROM e WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS GROUP BY user_id) SELECT user_id, round(c, 6) AS current, round(p, 6) AS prior, round((c - p) * 100, 6) AS drift_pp, coalesce(round(abs((c - p) * 100), 9) >= 5, false) AS has_drift, n FROM h",
    "fidelity_drift": f"WITH {_EV}, r AS (SELECT user_id, value / 100 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS k FROM e), a AS (SELECT user_id, count_if(n <= 50)::BIGINT AS n, avg(s) FILTER (WHERE n <= 50) AS mean, stddev_pop(s) FILTER (WHERE n <= 50) AS std, avg(s) AS bm, stddev_pop(s) AS bs, avg(s) FILTER (WHERE n <= least(50, k) // 2) AS nw, avg(s) FILTER (WHERE n > least(50, k) // 2 AND n <= 50) AS od FROM r WHERE n <= 200 GROUP BY user_id) SELECT user_id, n, round(CASE WHEN n >= 3 THEN mean ELSE 0 END, 6) AS mean, round(CASE WHEN n >= 3 THEN std ELSE 0 END, 6) AS std, n >= 3 AND mean < bm - bs AND bs > 1e-6 AS drift_detected, CASE WHEN n < 10 THEN 'INSUFFICIENT_DATA' WHEN abs(nw - od) < 0.02::DOUBLE THEN 'STABLE' WHEN nw - od < 0 THEN 'DEGRADING' ELSE 'IMPROVING' END AS trend FROM a",
    "spec_checks": r"""SELECT event_id, event_type IN ('view', 'click', 'purchase') AS authorized, coalesce(abs(value - 50) / 49 <= 3, false) AS three_sigma, regexp_matches(props, '"k": \d{2}') AS pattern, len(list_filter(regexp_split_to_array(props, '\s+'), lambda w: w <> '')) BETWEEN 1 AND 2 AS length FROM events""",
    "spec_violation_rate": f"WITH {_EV}, r AS (SELECT user_id, count(*)::BIGINT AS n, count_if(NOT passed)::DOUBLE / count(*) AS rate FROM e GROUP BY user_id) SELECT user_id, n, round(rate, 6) AS rate, CASE WHEN rate = 0 THEN 'none' WHEN rate < 0.05::DOUBLE THEN 'low' WHEN rate < 0.15::DOUBLE THEN 'medium' WHEN rate < 0.3::DOUBLE THEN 'high' ELSE 'critical' END AS severity FROM r",
    "spec_field_rates": r"""WITH c AS (SELECT event_type IN ('view', 'click', 'purchase') AS authorized, coalesce(abs(value - 50) / 49 <= 3, false) AS three_sigma, regexp_matches(props, '"k": \d{2}') AS pattern, len(list_filter(regexp_split_to_array(props, '\s+'), lambda w: w <> '')) BETWEEN 1 AND 2 AS length FROM events), u AS (SELECT 'authorized' AS field, authorized AS ok FROM c UNION ALL SELECT 'three_sigma', three_sigma FROM c UNION ALL SELECT 'pattern', pattern FROM c UNION ALL SELECT 'length', length FROM c) SELECT field, count(*)::BIGINT AS n, round(count_if(NOT ok)::DOUBLE / count(*), 4) AS rate FROM u GROUP BY field""",
    "contract_score": "WITH r AS (SELECT l_orderkey, l_discount * 10 AS c, l_linestatus = 'O' AS en, CASE WHEN l_linenumber = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM lineitem), p AS (SELECT *, NOT en OR c >= 0.3::DOUBLE AS ok, CASE WHEN en THEN c ELSE 1.0::DOUBLE END AS eff FROM r), s AS (SELECT l_orderkey, count(*)::BIGINT AS n_rules, sum(CASE WHEN ok THEN eff * w ELSE 0 END) / sum(w) AS score, bool_or(NOT ok AND w >= 1) AS crit FROM p GROUP BY l_orderkey) SELECT l_orderkey, n_rules, round(score, 6) AS score, NOT crit AND score >= 0.5 AS passed FROM s",
    "judge_calibration": "WITH d AS (SELECT least(1.0::DOUBLE, n_chars / 5000::DOUBLE) AS j, quality::DOUBLE AS h FROM labels JOIN documents USING (doc_id)), r AS (SELECT j, h, rank() OVER (ORDER BY j) + (count(*) OVER (PARTITION BY j) - 1) / 2.0::DOUBLE AS rj, rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0::DOUBLE AS rh FROM d), a AS (SELECT count(*)::BIGINT AS n, avg((abs(j - h) <= 0.15::DOUBLE)::INT) AS agreement, coalesce(corr(rj, rh), 0) AS spearman, avg(j) - avg(h) AS bias FROM r) SELECT n, round(agreement, 6) AS agreement, round(spearman, 6) AS spearman, round(bias, 6) AS bias, n >= 5 AND agreement >= 0.8::DOUBLE AND spearman >= 0.7::DOUBLE AS passed FROM a",
    "exact_match_eval": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, trim(l[1], ' ' || chr(9) || chr(13)) = trim(l[len(l)], ' ' || chr(9) || chr(13)) AS passed FROM l",
    "regex_eval": r"SELECT doc_id, regexp_matches(text, '(?s)the.*ing.*\n') AS passed FROM documents",
    "semantic_accuracy": r"""WITH x AS (SELECT doc_id, lower(trim(d.text, ' ' || chr(9) || chr(10) || chr(13))) AS r, lower(trim(b.text, ' ' || chr(9) || chr(10) || chr(13))) AS g FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT greatest(count(*), 1) FROM benchmark)), w AS (SELECT *, list_distinct(regexp_extract_all(g, '[\p{L}\p{N}_]+')) AS gw, list_distinct(regexp_extract_all(r, '[\p{L}\p{N}_]+')) AS rw FROM x), s AS (SELECT doc_id, CASE WHEN contains(r, g) THEN 1.0::DOUBLE WHEN len(gw) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(gw, rw))::DOUBLE / len(gw) END AS s FROM w) SELECT doc_id, round(s, 6) AS score, round(s, 6) AS coherence FROM s""",
    "task_completion": f"WITH {_RESP} SELECT doc_id, round({_completion('response', '(doc_id % 2 = 0)')}, 6) AS score FROM t",
    "safety_compliance": f"WITH {_RESP}, x AS (SELECT *, CASE WHEN doc_id % 3 < 2 THEN doc_id % 3 = 0 END AS ex FROM t) SELECT doc_id, {_safety('response', 'ex')} AS score FROM x",
    "edge_case_handling": f"WITH {_RESP} SELECT doc_id, {_edge('response')} AS score FROM t",
    "instruction_adherence": f"WITH {_RESP} SELECT doc_id, round({_adherence('response')}, 6) AS score FROM t",
    "parity_results": f"WITH {_PARITY} SELECT doc_id, dimension, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, round(parity, 6) AS parity, parity >= 0.8::DOUBLE AS passed, CASE WHEN candidate - baseline > 0.05::DOUBLE THEN 'better' WHEN candidate - baseline < -0.05::DOUBLE THEN 'worse' ELSE 'equivalent' END AS direction FROM pt",
    "parity_dimensions": f"WITH {_PARITY} SELECT dimension, n_tests, n_passed, round(parity, 6) AS parity, round(baseline_avg, 6) AS baseline_avg, round(candidate_avg, 6) AS candidate_avg, round(delta, 6) AS delta FROM dm",
    "parity_certificate": f"WITH {_PARITY}, w AS (SELECT sum(parity * n_tests) / sum(n_tests) AS parity, coalesce(string_agg(dimension, ',' ORDER BY dimension) FILTER (WHERE parity < 0.7::DOUBLE), '') AS failing, min(delta) AS least FROM dm), v AS (SELECT *, parity >= 0.95::DOUBLE OR (parity >= 0.85::DOUBLE AND failing = '') AS safe FROM w) SELECT round(parity, 6) AS parity, failing, CASE WHEN safe AND least > 0.05::DOUBLE THEN 'IMPROVEMENT' WHEN safe THEN 'EQUIVALENT' WHEN parity >= 0.7::DOUBLE THEN 'CONDITIONAL' ELSE 'NOT_EQUIVALENT' END AS verdict, safe AS migration_safe FROM v",
    "embedding_cosine": f"WITH {_EMB} SELECT vec_id, label, round(similarity, 6) AS similarity FROM p",
    "attribution_scores": f"WITH {_EMB}, a AS (SELECT label, count(*)::BIGINT AS runs, avg(similarity) AS m, stddev_pop(similarity) AS s FROM p GROUP BY label) SELECT label, runs, round(greatest(0.0, least(1.0, 1 - m)), 6)::DOUBLE AS score, round(m, 6) AS mean_similarity, round(s, 6) AS std_similarity FROM a",
    "attribution_gate": f"WITH {_EMB}, a AS (SELECT label, greatest(0.0, least(1.0, 1 - avg(similarity)))::DOUBLE AS s FROM p GROUP BY label), g AS (SELECT max(s) FILTER (WHERE label = 0) AS must, max(s) AS most, count_if(s >= 0.3::DOUBLE) AS many FROM a), v AS (SELECT list_filter([CASE WHEN coalesce(must < 0.3::DOUBLE, true) THEN '0 below 0.3' END, CASE WHEN most > 0.95::DOUBLE THEN 'a chunk above 0.95' END, CASE WHEN many < 2 THEN 'fewer than 2 contribute' END], lambda x: x IS NOT NULL) AS v FROM g) SELECT 1 AS trace, array_to_string(v, '; ') AS violations, len(v) = 0 AS passed FROM v",
    "attribution_compare": f"WITH {_EMB}, a AS (SELECT label, greatest(0.0, least(1.0, 1 - avg(similarity)))::DOUBLE AS s FROM p WHERE vec_id % 2 = 0 GROUP BY label), b AS (SELECT label, greatest(0.0, least(1.0, 1 - avg(similarity)))::DOUBLE AS s FROM p WHERE vec_id % 2 = 1 AND label > 0 GROUP BY label) SELECT coalesce(a.label, b.label) AS label, round(coalesce(a.s, 0), 6) AS score_a, round(coalesce(b.s, 0), 6) AS score_b, round(coalesce(b.s, 0) - coalesce(a.s, 0), 6) AS delta FROM a FULL JOIN b ON a.label = b.label",
    "largest_changes": f"WITH {_EMB}, a AS (SELECT label, greatest(0.0, least(1.0, 1 - avg(similarity)))::DOUBLE AS s FROM p WHERE vec_id % 2 = 0 GROUP BY label), b AS (SELECT label, greatest(0.0, least(1.0, 1 - avg(similarity)))::DOUBLE AS s FROM p WHERE vec_id % 2 = 1 AND label > 0 GROUP BY label), c AS (SELECT coalesce(a.label, b.label) AS label, round(coalesce(a.s, 0), 6) AS score_a, round(coalesce(b.s, 0), 6) AS score_b, round(coalesce(b.s, 0) - coalesce(a.s, 0), 6) AS delta FROM a FULL JOIN b ON a.label = b.label) SELECT * FROM c ORDER BY abs(delta) DESC, label LIMIT 3",
    "top_contributors": f"WITH {_EMB}, s AS (SELECT label, vec_id, round(1 - similarity, 6) AS score FROM p) SELECT label, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 3",
    "mutation_score": "WITH g AS (SELECT user_id, event_type, median(value / 100) AS m FROM events GROUP BY ALL), v AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'S' WHEN round(0.6::DOUBLE - m, 9) >= 0.15::DOUBLE THEN 'K' ELSE 'L' END AS v FROM g), c AS (SELECT user_id, count_if(v = 'K')::BIGINT AS killed, count_if(v = 'L')::BIGINT AS survived, count_if(v = 'S')::BIGINT AS skipped FROM v GROUP BY user_id), s AS (SELECT *, CASE WHEN killed + survived > 0 THEN killed::DOUBLE / (killed + survived) ELSE 0 END AS s FROM c) SELECT user_id, killed, survived, skipped, round(s, 6) AS score, CASE WHEN s >= 0.9::DOUBLE THEN 'STRONG' WHEN s >= 0.8::DOUBLE THEN 'ADEQUATE' WHEN s >= 0.7::DOUBLE THEN 'MARGINAL' WHEN s >= 0.6::DOUBLE THEN 'WEAK' ELSE 'DANGEROUS' END AS verdict FROM s",
    "coherence_status": "WITH d AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS d1, l_tax * 12 AS d2, l_quantity / 50 AS d3, 0.75::DOUBLE AS d4, CASE WHEN l_linenumber > 2 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS d5 FROM lineitem), m AS (SELECT *, (d1 + d2 + d3 + d4 + d5) / 5 AS mean FROM d), s AS (SELECT *, CASE WHEN abs(mean - 0.7::DOUBLE) > 0.15::DOUBLE THEN mean ELSE 0.7::DOUBLE END AS s FROM m) SELECT l_orderkey, l_linenumber, round(s, 6) AS score, CASE WHEN s >= 0.8::DOUBLE THEN 'COHERENT' WHEN s >= 0.55::DOUBLE THEN 'DEGRADED' ELSE 'INCOHERENT' END AS status, ((d1 >= 0.7::DOUBLE)::INT + (d2 >= 0.7::DOUBLE)::INT + (d3 >= 0.7::DOUBLE)::INT + (d4 >= 0.7::DOUBLE)::INT + (d5 >= 0.7::DOUBLE)::INT)::BIGINT AS n_passed FROM s",
    "label_budget_compare": "SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS a, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS b, CASE WHEN coalesce(round(avg(value) FILTER (WHERE event_type = 'click'), 6), 0) >= coalesce(round(avg(value) FILTER (WHERE event_type = 'view'), 6), 0) THEN 'click' ELSE 'view' END AS winner FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id",
    "intent_clauses": rf"""WITH t AS (SELECT doc_id, {_sql_list(INTENTS)}[doc_id % 4 + 1] || chr(10) || coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '[.!?\n]|(?:^|\n)\s*[-*•]\s*'), lambda x: trim(x, {_BLANK})), lambda x: length(x) >= 8)[1:12] AS cs FROM t), u AS (SELECT doc_id, i - 1 AS n, cs[i] AS clause FROM c, unnest(generate_series(1, len(cs))) q(i))
      SELECT doc_id, n::BIGINT AS n, md5(clause) AS clause, CASE {' '.join(f"WHEN regexp_matches(clause, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, p in parsing.INTENTS)} ELSE 'modifies' END AS kind FROM u""",
    "diff_stats": f"WITH {_CHANGED} SELECT doc_id, any_value(name) AS files, count_if(starts_with(l, '+') AND NOT starts_with(l, '+++'))::BIGINT AS added, count_if(starts_with(l, '-') AND NOT starts_with(l, '---'))::BIGINT AS removed FROM l GROUP BY doc_id",
    "diff_hunks": f"WITH {_CHANGED}, h AS (SELECT doc_id, (i - 1) // 10 + 1 AS hunk, any_value(name) AS file, count_if(starts_with(l, '+') AND NOT starts_with(l, '+++'))::BIGINT AS added, count_if(starts_with(l, '-') AND NOT starts_with(l, '---'))::BIGINT AS removed FROM l GROUP BY ALL) SELECT doc_id, hunk::BIGINT AS hunk, file, added, removed, added > 0 AND removed = 0 AS pure_addition, removed > 0 AND added = 0 AS pure_removal FROM h",
    "cot_steps": f"""WITH r AS (SELECT doc_id, trim(text, {_BLANK}) AS raw FROM documents),
p AS (SELECT doc_id, raw, regexp_split_to_array(raw, '{parsing.NUMBERED}') AS n, list_filter(list_transform(regexp_split_to_array(raw, '\\n\\n+'), lambda x: trim(x, {_BLANK})), lambda x: x <> '') AS b, string_split(regexp_replace(raw, '{parsing.CONNECTORS.replace("(?=(?:", "((?:")}', chr(1) || '\\1', 'g'), chr(1)) AS w FROM r),
c AS (SELECT doc_id, CASE WHEN len(n) > 1 THEN n WHEN len(b) > 1 THEN b WHEN len(w) > 1 THEN w ELSE [raw] END AS xs, len(n) > 1 OR (len(b) <= 1 AND len(w) > 1) AS long FROM p),
u AS (SELECT doc_id, i - 1 AS index, trim(xs[i], {_BLANK}) AS t, long FROM c, unnest(generate_series(1, len(xs))) AS q(i))
SELECT doc_id, index::INTEGER AS index, md5(t) AS digest FROM u WHERE NOT long OR length(t) > 5""",
    "json_extract_score": "WITH k AS (SELECT conv_id, turn, (turn + conv_id) % 5 AS k FROM conversations) SELECT conv_id, turn, CASE k WHEN 1 THEN 2.0::DOUBLE / 3 WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score, CASE WHEN k = 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS valid FROM k",
    "phrase_swap": rf"WITH {_PROMPTS} SELECT id, md5('You are a Casual assistant' || t[27:]) AS swapped, md5(regexp_replace(t, '\bbrief\b', 'detailed')) AS swapped2 FROM t",
    "calibration_mutants": rf"""WITH {_PROMPTS}, m AS (SELECT id, t, unnest([{{'k': 'generic', 't': '{mutation.GENERIC}'}}, {', '.join(f"{{'k': '{k}', 't': trim(regexp_replace(regexp_replace(t, '(?m)^[ \t]*(?:{p.replace(chr(39), chr(39) * 2)})\s+.+[.!]?\s*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANK})}}" for k, p in mutation.STRIPPED.items())},
      {{'k': 'no_first_line', 't': trim(trim(t, {_BLANK})[strpos(trim(t, {_BLANK}), chr(10)) + 1:], {_BLANK})}}, {{'k': 'no_last_line', 't': trim(regexp_replace(trim(t, {_BLANK}), '\n[^\n]*$', ''), {_BLANK})}}]) AS made FROM t) SELECT id, made.k AS kind, md5(CASE WHEN made.t = '' THEN t ELSE made.t END) AS digest FROM m""",
    "judge_scores": r"WITH k AS (SELECT conv_id, turn, text, (turn + conv_id) % 3 AS k FROM conversations) SELECT conv_id, turn, CASE k WHEN 0 THEN least(1.0::DOUBLE, round(length(text) / 1000::DOUBLE, 3)) ELSE coalesce(nullif(regexp_extract(CASE WHEN k = 1 THEN text || ' I say 0.' || (conv_id % 10) || ' of it' ELSE text END, '\b(0\.\d+|1\.0|0|1)\b', 1), '')::DOUBLE, 0.5::DOUBLE) END AS score FROM k",
    "flattened_messages": "SELECT conv_id, md5(string_agg('[' || upper(role) || '] ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "masked_chunks": "SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN md5(text[1:strpos(text, 'the') - 1] || '[REMOVED]:the' || text[strpos(text, 'the') + 3:]) END AS digest FROM documents",
}
