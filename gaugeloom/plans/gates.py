"""Queries of ledger reads, joins, suite rollups and gates on the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeloom.functions import verdicts
from gaugeloom.operators import gates, trim

from .agents import MOST, cost_rows
from .ledgers import _order, _read, events

LOOKED_UP = 42


def ledger_by_label(spark, sf):
    return gates.where_equal(events(spark, sf), "event_type", "purchase", F.desc("ts"), F.desc("event_id")).select("event_id", "user_id", "value")


def ledger_lookup(spark, sf):
    return gates.lookup(events(spark, sf), "event_id", LOOKED_UP).select("event_id", "user_id", "event_type", "value")


def ledger_count(spark, sf):
    return gates.count_rows(events(spark, sf))


def threshold_filter(spark, sf):
    return gates.at_least(events(spark, sf), "value", 90.0).select("event_id", "value")


def failed_rules(spark, sf):
    rules = events(spark, sf).groupBy("user_id").agg(F.collect_list(F.struct("passed", (F.col("value") / 100).alias("severity"))).alias("rules"))
    return rules.select("user_id", *[F.size(c).cast("bigint").alias(f"n_{name}") for name, c in gates.split_rules(F.col("rules"), "passed", "severity").items()])


def zipped_lists(spark, sf):
    rows = events(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value", "event_type"))).alias("x"))
    pairs = rows.select("user_id", F.posexplode(gates.zipped(F.col("x.value"), F.col("x.event_type"))).alias("at", "pair"))
    return pairs.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("pair.b") == "error", F.col("at")).otherwise(0)).alias("error_places"))


def verdict_clauses(spark, sf):
    """Verdicts on the clauses of a specification, the benchmark's items; some name a clause that it lacks."""
    clauses = _read(spark, sf, "benchmark").select(F.col("item_id").alias("clause_index"), "text")
    verdict = events(spark, sf).select("event_id", F.pmod("event_id", F.lit(60)).alias("clause_index"))
    return gates.clause_of(verdict, clauses, [], "clause_index", "text").groupBy("clause").agg(F.count("*").alias("n"))


def response_pairs(spark, sf):
    turns = _read(spark, sf, "conversations").withColumn("pair", F.floor(F.col("turn") / 2))
    both = gates.paired(turns.where("turn % 2 = 0"), turns.where("turn % 2 = 1"), ["conv_id", "pair"], "text")
    return both.select("conv_id", "pair", F.md5("baseline").alias("baseline"), F.md5("candidate").alias("candidate"))


def report_results(spark, sf):
    late = _read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return gates.expanded(late, _read(spark, sf, "lineitem"), "o_orderkey", "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def suite_counts(spark, sf):
    return gates.suite_counts(events(spark, sf), ["user_id"], F.col("event_type") == "error", F.col("value") > 60)


def calibration_score(spark, sf):
    cases = events(spark, sf).select((F.col("event_id") % 20).alias("prompt_id"), (F.col("value") / 100).alias("original"), F.lit(0.3).alias("mutant"), "event_type", F.when(F.col("passed"), "LOW").otherwise("HIGH").alias("severity"), F.col("event_id").cast("string").alias("advice"))
    out = gates.calibration(cases, ["prompt_id"], "original", "mutant", F.col("event_type") != "view", "severity", "advice")
    return out.select("prompt_id", F.round("calibration_score", 6).alias("calibration_score"), "total", "caught", "missed", F.md5(F.array_join("warnings", ",")).alias("warnings"))


def faithfulness_gate(spark, sf):
    verdict = verdicts.fidelity(F.col("value") / 100)
    out = gates.share_gate(events(spark, sf), ["user_id"], verdict == "FAITHFUL", least=0.4)
    return out.withColumn("rate", F.round("rate", 6))


def last_n_gate(spark, sf):
    return gates.last_n_gate(events(spark, sf), ["user_id"], "passed", 5, F.desc(_order()))


def score_trend(spark, sf):
    return gates.trend(events(spark, sf).select("event_id", "value"), 10, F.asc("event_id"))


def best_score(spark, sf):
    return gates.best(events(spark, sf), ["user_id"], "value", F.asc("event_id")).select("user_id", "event_id", "value")


def violation_gate(spark, sf):
    return gates.share_gate(events(spark, sf), ["user_id"], ~F.col("passed"), most=0.2).withColumn("rate", F.round("rate", 6))


def pass_rate_gate(spark, sf):
    return gates.share_gate(events(spark, sf), ["event_type"], F.col("value") < 80, least=0.5).withColumn("rate", F.round("rate", 6))


def drift_gate(spark, sf):
    scores = events(spark, sf).groupBy("user_id").agg(F.avg(F.col("value") / 100).alias("drift"))
    return gates.score_gate(scores, "drift", most=0.5).withColumn("drift", F.round("drift", 6))


def mutation_gate(spark, sf):
    killed = events(spark, sf).groupBy("user_id").agg(F.avg((F.col("value") < 70).cast("int")).alias("score"))
    return gates.score_gate(killed, "score", least=0.5).withColumn("score", F.round("score", 6))


def trim_summary(spark, sf):
    out = trim.keep_summary(cost_rows(spark, sf), "conv_id", "role", "text", MOST)
    return out.select("conv_id", "n_dropped", F.md5(F.coalesce("summary", F.lit(""))).alias("summary"))


QUERIES = {
    f.__name__: f
    for f in (ledger_by_label, ledger_lookup, ledger_count, threshold_filter, failed_rules, zipped_lists, verdict_clauses, response_pairs, report_results, suite_counts, calibration_score, faithfulness_gate, last_n_gate, score_trend, best_score, violation_gate, pass_rate_gate, drift_gate, mutation_gate, trim_summary)
}

ORACLES = {
    "ledger_by_label": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'",
    "ledger_lookup": f"SELECT event_id, user_id, event_type, value FROM events WHERE event_id = {LOOKED_UP}",
    "ledger_count": "SELECT count(*)::BIGINT AS n FROM events",
    "threshold_filter": "SELECT event_id, value FROM events WHERE value >= 90",
    "failed_rules": "SELECT user_id, count_if(event_type = 'error')::BIGINT AS n_failed, count_if(event_type <> 'error')::BIGINT AS n_succeeded, count_if(event_type = 'error' AND value / 100 >= 0.7::DOUBLE)::BIGINT AS n_critical FROM events GROUP BY user_id",
    "zipped_lists": "SELECT user_id, count(*)::BIGINT AS n, sum(CASE WHEN event_type = 'error' THEN place ELSE 0 END)::BIGINT AS error_places FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events) GROUP BY user_id",
    "verdict_clauses": "SELECT coalesce(text, 'unknown') AS clause, count(*)::BIGINT AS n FROM events LEFT JOIN benchmark ON item_id = event_id % 60 GROUP BY 1",
    "response_pairs": "SELECT conv_id, a.turn // 2 AS pair, md5(a.text) AS baseline, md5(b.text) AS candidate FROM conversations a JOIN conversations b USING (conv_id) WHERE a.turn % 2 = 0 AND b.turn = a.turn + 1",
    "report_results": "SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY l_returnflag",
    "suite_counts": "SELECT user_id, count(*)::BIGINT AS total, count_if((event_type = 'error') = (value > 60))::BIGINT AS n_passed, count_if((event_type = 'error') <> (value > 60))::BIGINT AS n_failed FROM events GROUP BY user_id",
    "calibration_score": "SELECT event_id % 20 AS prompt_id, round(coalesce(avg(CASE WHEN event_type <> 'view' THEN (value / 100 - 0.3::DOUBLE >= 0.15::DOUBLE)::INT END), 0), 6) AS calibration_score, count_if(event_type <> 'view')::BIGINT AS total, count_if(event_type <> 'view' AND value / 100 - 0.3::DOUBLE >= 0.15::DOUBLE)::BIGINT AS caught, count_if(event_type <> 'view' AND value / 100 - 0.3::DOUBLE < 0.15::DOUBLE)::BIGINT AS missed, md5(coalesce(string_agg(CASE WHEN event_type = 'error' AND value / 100 - 0.3::DOUBLE < 0.15::DOUBLE THEN event_id::VARCHAR END, ',' ORDER BY event_id::VARCHAR), '')) AS warnings FROM events GROUP BY 1",
    "faithfulness_gate": "SELECT user_id, count(*)::BIGINT AS n, round(avg((value / 100 >= 0.15::DOUBLE)::INT), 6) AS rate, avg((value / 100 >= 0.15::DOUBLE)::INT) >= 0.4::DOUBLE AS passed FROM events GROUP BY user_id",
    "last_n_gate": "SELECT user_id, count(*)::BIGINT AS n, count_if(event_type = 'error')::BIGINT AS n_failed, count_if(event_type = 'error') = 0 AS passed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY user_id",
    "score_trend": "SELECT event_id, value FROM events ORDER BY event_id LIMIT 10",
    "best_score": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1",
    "violation_gate": "SELECT user_id, count(*)::BIGINT AS n, round(avg((event_type = 'error')::INT), 6) AS rate, avg((event_type = 'error')::INT) <= 0.2::DOUBLE AS passed FROM events GROUP BY user_id",
    "pass_rate_gate": "SELECT event_type, count(*)::BIGINT AS n, round(avg((value < 80)::INT), 6) AS rate, avg((value < 80)::INT) >= 0.5::DOUBLE AS passed FROM events GROUP BY event_type",
    "drift_gate": "SELECT user_id, round(avg(value / 100), 6) AS drift, avg(value / 100) <= 0.5::DOUBLE AS passed FROM events GROUP BY user_id",
    "mutation_gate": "SELECT user_id, round(avg((value < 70)::INT), 6) AS score, avg((value < 70)::INT) >= 0.5::DOUBLE AS passed FROM events GROUP BY user_id",
    "trim_summary": r"""
WITH m AS (
  SELECT conv_id, turn, role, text, lower(role) = 'system' AS sys, (length(text) + 3) // 4 + (length(role) + 3) // 4 + 4 AS tokens FROM conversations
), s AS (
  SELECT conv_id, coalesce(sum(tokens) FILTER (WHERE sys), 0) AS systok, coalesce(sum(tokens) FILTER (WHERE NOT sys), 0) AS rest, count_if(NOT sys) AS n FROM m GROUP BY conv_id
), t AS (
  SELECT *, upper(role[1]) || lower(role[2:]) AS who, trim(text, E' \t\r\n') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS j FROM m WHERE NOT sys
), l AS (
  SELECT *, left(CASE WHEN regexp_matches(body, '(?s)^.*?[.!?]\s') THEN regexp_extract(body, '(?s)^(.*?[.!?])\s', 1) ELSE body END, 120) AS snippet FROM t
), p AS (
  SELECT *, CASE WHEN snippet <> '' THEN '• ' || who || ': ' || snippet END AS line, '• ' || who || ': ' || left(body, 60) AS short FROM l
), c AS (
  SELECT *, '[Context summary — ' || j || ' earlier messages]' || chr(10) || coalesce(string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY j), '• (no content)') AS summary,
    sum(tokens) OVER (PARTITION BY conv_id ORDER BY j) AS gone FROM p
), f AS (
  SELECT c.conv_id, min_by(j, j) AS j, min_by(summary, j) AS summary FROM c JOIN s USING (conv_id) WHERE systok + rest - gone + (length(summary) + 3) // 4 + 6 <= 488 GROUP BY c.conv_id
), k AS (
  SELECT s.conv_id, v.k, '[Summary: ' || s.n || ' msgs]' || chr(10) || (SELECT string_agg(short, chr(10) ORDER BY j) FROM p WHERE p.conv_id = s.conv_id AND p.j > s.n - v.k) AS summary, 488 - systok - 8 AS space
  FROM s, (SELECT unnest(generate_series(1, 20)) AS k) v WHERE v.k <= s.n
), g AS (
  SELECT conv_id, max_by(summary, k) AS summary FROM k WHERE (length(summary) + 3) // 4 <= space GROUP BY conv_id
)
SELECT s.conv_id, CASE WHEN systok + rest <= 488 THEN 0 ELSE coalesce(f.j, s.n) END::BIGINT AS n_dropped,
  md5(coalesce(CASE WHEN systok + rest <= 488 OR s.n = 0 THEN NULL WHEN f.j IS NOT NULL THEN f.summary WHEN 488 - systok - 8 <= 0 THEN NULL
    ELSE coalesce(g.summary, '[Summary: ' || s.n || ' earlier messages omitted to fit token budget]') END, '')) AS summary
FROM s LEFT JOIN f USING (conv_id) LEFT JOIN g USING (conv_id)
""",
}
