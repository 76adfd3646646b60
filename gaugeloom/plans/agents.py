"""Queries on outputs, trajectories and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeloom.functions import text as X
from gaugeloom.functions import verdicts
from gaugeloom.operators import livelock, patrol, similarity, trim

TIER = "LOW"
TASK, MILESTONES = ["view", "v0"], ["purchase"]
#: Values of an event that one word stands for.
VALUES = 40
LEVELS = (0.1, 0.3, 0.5, 0.7, 0.9)


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def assistant_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")


# the SQL below: pairs of a conversation's assistant turns that share a term
_TERMS = r"""
out AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
tc AS (SELECT conv_id, turn, term, count(*)::BIGINT AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM out) GROUP BY ALL),
whole AS (SELECT conv_id, turn, sum(n * n)::BIGINT AS q FROM tc GROUP BY ALL),
met AS (
  SELECT a.conv_id, a.turn AS i, b.turn AS j, sum(a.n * b.n)::BIGINT AS dot, sum(a.n * a.n)::BIGINT AS sa, sum(b.n * b.n)::BIGINT AS sb
  FROM tc a JOIN tc b ON a.conv_id = b.conv_id AND a.term = b.term AND a.turn < b.turn GROUP BY ALL),
sims AS (
  SELECT met.conv_id, i, j, least(1.0, power(ln(2::DOUBLE), 2) * dot / (sqrt(power(ln(2::DOUBLE), 2) * sa + power(ln(3::DOUBLE), 2) * (x.q - sa)) * sqrt(power(ln(2::DOUBLE), 2) * sb + power(ln(3::DOUBLE), 2) * (y.q - sb)))) AS similarity
  FROM met JOIN whole x ON met.conv_id = x.conv_id AND met.i = x.turn JOIN whole y ON met.conv_id = y.conv_id AND met.j = y.turn),
grp AS (SELECT conv_id, count(*)::BIGINT AS n_outputs, (count(*) * (count(*) - 1) // 2)::BIGINT AS n_pairs FROM out GROUP BY ALL HAVING count(*) > 1),
scored AS (
  SELECT grp.conv_id, n_outputs, n_pairs, coalesce(sum(similarity), 0) / n_pairs AS score,
    CASE WHEN count(similarity) = n_pairs THEN min(similarity) ELSE 0 END AS least, coalesce(max(similarity), 0) AS most
  FROM grp LEFT JOIN sims ON grp.conv_id = sims.conv_id GROUP BY grp.conv_id, n_outputs, n_pairs)
"""


def consistency(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.group_consistency(assistant_outputs(spark, sf), "conv_id", "turn", "text")


def consistency_score(spark: SparkSession, sf: str) -> DataFrame:
    return consistency(spark, sf).select("conv_id", "n_outputs", "n_pairs", F.round("score", 6).alias("score"), verdicts.consistency(F.col("score"), TIER).alias("verdict"))


def consistency_report(spark: SparkSession, sf: str) -> DataFrame:
    v = consistency(spark, sf).select("score", verdicts.consistency(F.col("score"), TIER).alias("v"))
    many = lambda name: F.count_if(F.col("v") == name)
    sums = v.agg(F.count("*").alias("n"), many("CONSISTENT").alias("n_consistent"), many("BORDERLINE").alias("n_borderline"), many("INCONSISTENT").alias("n_inconsistent"), F.round(F.avg("score"), 6).alias("mean_score"))
    return sums.withColumn("verdict", F.when(F.col("n_consistent") == F.col("n"), "CONSISTENT").when(F.col("n_inconsistent") == 0, "BORDERLINE").otherwise("INCONSISTENT"))


def pairwise_min_max(spark: SparkSession, sf: str) -> DataFrame:
    return consistency(spark, sf).select("conv_id", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


def fidelity_input(spark: SparkSession, sf: str) -> DataFrame:
    """Each assistant turn with the one before it as its suppressed counterpart."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return assistant_outputs(spark, sf).withColumn("suppressed", before).where("suppressed IS NOT NULL")


def fidelity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    df = fidelity_input(spark, sf)
    sims = similarity.versus(df, ["conv_id", "turn"], "text", "suppressed")
    score = 1 - F.col("similarity")
    return sims.join(df.select("conv_id", "turn", X.fingerprint(F.col("text")).alias("prompt_hash")), ["conv_id", "turn"]).select("conv_id", "turn", "prompt_hash", F.round("similarity", 6).alias("similarity"), F.round("similarity_counts", 6).alias("counts_cosine"), verdicts.fidelity(score, 0.75, 0.5).alias("verdict"))


_VERSUS = r"""
ta AS (SELECT conv_id, turn, term, count(*)::BIGINT AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(a), '[a-z0-9]+')) AS term FROM src) GROUP BY ALL),
tb AS (SELECT conv_id, turn, term, count(*)::BIGINT AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(b), '[a-z0-9]+')) AS term FROM src) GROUP BY ALL),
qa AS (SELECT conv_id, turn, sum(n * n)::BIGINT AS q FROM ta GROUP BY ALL),
qb AS (SELECT conv_id, turn, sum(n * n)::BIGINT AS q FROM tb GROUP BY ALL),
sh AS (SELECT conv_id, turn, sum(ta.n * tb.n)::BIGINT AS dot, sum(ta.n * ta.n)::BIGINT AS sa, sum(tb.n * tb.n)::BIGINT AS sb FROM ta JOIN tb USING (conv_id, turn, term) GROUP BY ALL),
sims AS (
  SELECT src.conv_id, src.turn,
    CASE WHEN dot IS NULL THEN 0 ELSE least(1.0, power(ln(2::DOUBLE), 2) * dot / (sqrt(power(ln(2::DOUBLE), 2) * sa + power(ln(3::DOUBLE), 2) * (qa.q - sa)) * sqrt(power(ln(2::DOUBLE), 2) * sb + power(ln(3::DOUBLE), 2) * (qb.q - sb)))) END AS similarity,
    CASE WHEN dot IS NULL THEN 0 ELSE least(1.0, dot / (sqrt(qa.q::DOUBLE) * sqrt(qb.q::DOUBLE))) END AS counts
  FROM src LEFT JOIN sh USING (conv_id, turn) LEFT JOIN qa USING (conv_id, turn) LEFT JOIN qb USING (conv_id, turn))
"""
_FIDELITY = r"src AS (SELECT * FROM (SELECT conv_id, turn, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations WHERE role = 'assistant') WHERE b IS NOT NULL)"
_GOAL = r"""
src AS (
  SELECT conv_id, turn, text AS a, goal AS b FROM conversations JOIN (SELECT conv_id, arg_min(text, turn) AS goal FROM conversations WHERE role = 'user' GROUP BY conv_id) USING (conv_id)
  WHERE role = 'assistant')"""


def goal_steps(spark: SparkSession, sf: str) -> DataFrame:
    c = _read(spark, sf, "conversations")
    goal = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("goal"))
    return c.where("role = 'assistant'").join(goal, "conv_id").select("conv_id", "turn", "text", "goal")


def livelock_made(spark: SparkSession, sf: str) -> DataFrame:
    return livelock.steps(goal_steps(spark, sf), "conv_id", "turn", "text", "goal")


def livelock_steps(spark: SparkSession, sf: str) -> DataFrame:
    return livelock_made(spark, sf).select("conv_id", "turn", F.round("progress", 6).alias("progress"), F.round("delta", 6).alias("delta"), "stuck")


def livelock_report(spark: SparkSession, sf: str) -> DataFrame:
    return livelock.report(livelock_made(spark, sf), "conv_id", "turn", k=2).select("conv_id", "n_steps", "n_stuck", F.round("score", 6).alias("score"), F.round("mean_progress", 6).alias("mean_progress"), "longest", "detected", "verdict", "gate_passed")


def stuck_window(spark: SparkSession, sf: str) -> DataFrame:
    return livelock.longest_runs(livelock_made(spark, sf), "conv_id", "turn", "stuck")


_LIVELOCK = (
    _GOAL
    + ","
    + _VERSUS
    + r""",
st AS (SELECT conv_id, turn, similarity AS progress, similarity - coalesce(lag(similarity) OVER w, 0) AS delta, abs(similarity - coalesce(lag(similarity) OVER w, 0)) < 0.05 AS stuck FROM sims WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
isl AS (SELECT conv_id, turn, stuck, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, stuck ORDER BY turn) AS g FROM st),
runs AS (SELECT conv_id, g, count(*)::BIGINT AS len, min(turn) AS s, max(turn) AS e FROM isl WHERE stuck GROUP BY ALL),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY len DESC, s) = 1)
"""
)


def event_words():
    """An event as words: its type, a word for its value, and one that all events share."""
    return F.concat(F.col("event_type"), F.lit(" v"), F.floor(F.col("value") / VALUES).cast("string"), F.lit(" event"))


def event_tokens(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events").withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select("user_id", "step", X.token_set(event_words()).alias("tokens"))


def patrol_reports(spark: SparkSession, sf: str) -> DataFrame:
    return patrol.detect(event_tokens(spark, sf), "user_id", "step", "tokens", TASK, MILESTONES)


def _one(pathology: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return patrol_reports(spark, sf).where(F.col(pathology).isNotNull()).select("user_id", "step", F.round(pathology, 6).alias("confidence"))

    return query


def patrol_best(spark: SparkSession, sf: str) -> DataFrame:
    return patrol_reports(spark, sf).where("pathology IS NOT NULL").select("user_id", "step", "pathology", "severity", F.round("confidence", 6).alias("confidence"))


def patrol_summary(spark: SparkSession, sf: str) -> DataFrame:
    return patrol.summary(patrol_reports(spark, sf), "user_id").select("user_id", "n_steps", "n_reports", F.round("health", 6).alias("health"), "verdict")


def jaccard_consecutive(spark: SparkSession, sf: str) -> DataFrame:
    c = _read(spark, sf, "conversations").select("conv_id", "turn", X.token_set(F.col("text")).alias("tokens"))
    return similarity.consecutive_jaccard(c, "conv_id", "turn", "tokens").select("conv_id", "turn", F.round("jaccard_1", 6).alias("similarity"))


_PATROL = r"""
ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, list_distinct(regexp_extract_all(lower(event_type || ' v' || floor(value / 40)::BIGINT || ' event'), '[\p{L}\p{N}_]+')) AS t FROM events),
lg AS (SELECT user_id, n, t, lag(t, 1) OVER w AS b1, lag(t, 2) OVER w AS b2, lag(t, 3) OVER w AS b3 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY n)),
sm AS (SELECT *,
  len(list_intersect(t, b1))::DOUBLE / len(list_distinct(list_concat(t, b1))) AS s1,
  len(list_intersect(t, b2))::DOUBLE / len(list_distinct(list_concat(t, b2))) AS s2,
  len(list_intersect(t, b3))::DOUBLE / len(list_distinct(list_concat(t, b3))) AS s3,
  len(list_intersect(t, ['view', 'v0']))::DOUBLE / len(list_distinct(list_concat(t, ['view', 'v0']))) AS task,
  CASE WHEN list_contains(list_concat(t, coalesce(b1, []), coalesce(b2, []), coalesce(b3, [])), 'purchase') THEN 1.0 ELSE 0.0 END AS overlap FROM lg),
ft AS (SELECT *,
  CASE WHEN n >= 4 THEN (s1 + lag(s1, 1) OVER w + lag(s1, 2) OVER w + s2 + lag(s2, 1) OVER w + s3) / 6 END AS simil,
  CASE WHEN n >= 4 THEN (s1 + lag(s1, 1) OVER w + lag(s1, 2) OVER w) / 3 END AS steady,
  CASE WHEN lag(s2, 1) OVER w >= 0.7::DOUBLE AND s2 >= 0.7::DOUBLE AND lag(s1, 2) OVER w < 0.7::DOUBLE THEN (lag(s2, 1) OVER w + s2) / 2 END AS osc,
  (task + lag(task, 1) OVER w + lag(task, 2) OVER w) / 3 AS late,
  (nth_value(task, 1) OVER w + nth_value(task, 2) OVER w + nth_value(task, 3) OVER w) / 3 AS early,
  (s1 + lag(s1, 1) OVER w) / 2 AS held
  FROM sm WINDOW w AS (PARTITION BY user_id ORDER BY n)),
fo AS (SELECT *, coalesce(lag(osc, 2) OVER w, lag(osc, 1) OVER w, osc) AS fosc FROM ft WINDOW w AS (PARTITION BY user_id ORDER BY n)),
rp AS (SELECT user_id, n AS step,
  CASE WHEN simil >= 0.8::DOUBLE THEN least(1.0, (simil - 0.8::DOUBLE) / (1.0::DOUBLE - 0.8::DOUBLE) + 0.5) END AS cycle,
  CASE WHEN fosc IS NOT NULL THEN least(1.0, (fosc - 0.7::DOUBLE) / (1.0::DOUBLE - 0.7::DOUBLE) + 0.5) END AS oscillation,
  CASE WHEN steady >= 0.75::DOUBLE AND overlap < 0.3 THEN least(1.0, steady * 0.7::DOUBLE + (1 - overlap) * 0.3::DOUBLE) END AS stall,
  CASE WHEN n >= 3 AND early - late > 0.25::DOUBLE AND late < 0.3::DOUBLE THEN least(1.0, (early - late) / 0.5::DOUBLE * 0.7::DOUBLE + 0.3::DOUBLE) END AS drift,
  CASE WHEN n >= 5 AND late < 0.15::DOUBLE AND held > 0.5 THEN least(1.0, (1 - late) * 0.5::DOUBLE + held * 0.5::DOUBLE) END AS abandonment,
  simil > 0.9::DOUBLE AS c_cycle, early - late > 0.5::DOUBLE AS c_drift FROM fo),
bs AS (SELECT user_id, step, confidence, pathology, CASE WHEN critical THEN 'critical' ELSE 'warning' END AS severity FROM (
  SELECT user_id, step, cycle AS confidence, 'cycle' AS pathology, c_cycle AS critical, 1 AS r FROM rp WHERE cycle IS NOT NULL
  UNION ALL SELECT user_id, step, oscillation, 'oscillation', true, 2 FROM rp WHERE oscillation IS NOT NULL
  UNION ALL SELECT user_id, step, stall, 'stall', false, 3 FROM rp WHERE stall IS NOT NULL
  UNION ALL SELECT user_id, step, drift, 'drift', c_drift, 4 FROM rp WHERE drift IS NOT NULL
  UNION ALL SELECT user_id, step, abandonment, 'abandonment', true, 5 FROM rp WHERE abandonment IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY user_id, step ORDER BY confidence DESC, r) = 1)
"""


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"), X.estimate_tokens_floor(F.col("text")).alias("tokens_floor"))


MOST = 1000


def cost_rows(spark: SparkSession, sf: str) -> DataFrame:
    return trim.costs(_read(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


def importance_score(spark: SparkSession, sf: str) -> DataFrame:
    return cost_rows(spark, sf).select("conv_id", "turn", "tokens", F.round("importance", 6).alias("importance"))


def _trim(strategy: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return trim.STRATEGIES[strategy](cost_rows(spark, sf), "conv_id", MOST).where("kept").select("conv_id", "turn")

    return query


def trim_stats(spark: SparkSession, sf: str) -> DataFrame:
    kept = trim.keep_recent(cost_rows(spark, sf), "conv_id", MOST)
    return trim.stats(kept, "conv_id", MOST).withColumn("trim_ratio", F.round("trim_ratio", 6))


def budget_gate(spark: SparkSession, sf: str) -> DataFrame:
    sums = cost_rows(spark, sf).groupBy("conv_id").agg(F.sum("tokens").cast("bigint").alias("tokens"))
    return sums.select("conv_id", "tokens", F.greatest(F.lit(0).cast("bigint"), F.col("tokens") - (MOST - trim.RESERVED)).alias("tokens_over"), (F.col("tokens") <= MOST - trim.RESERVED).alias("passed"))


_COSTS = r"""
m AS (SELECT conv_id, turn, role, text, (length(text) + 3) // 4 + (length(role) + 3) // 4 + 4 AS tokens, role = 'system' AS sys,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
mm AS (SELECT *, coalesce(sum(CASE WHEN sys THEN tokens END) OVER (PARTITION BY conv_id), 0) AS systok,
  CASE WHEN role = 'system' THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE,
    (CASE role WHEN 'user' THEN 0.7::DOUBLE WHEN 'assistant' THEN 0.5::DOUBLE WHEN 'tool' THEN 0.6::DOUBLE WHEN 'function' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END) * 0.35::DOUBLE
    + (CASE WHEN total > 1 THEN 0.1::DOUBLE + 0.9::DOUBLE * (idx::DOUBLE / (total - 1)) ELSE 1.0::DOUBLE END) * 0.35::DOUBLE
    + least(length(text) / 2000.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE
    + (CASE WHEN contains(text, '?') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) * 0.075::DOUBLE
    + (CASE WHEN regexp_matches(text, '(?i)\b(error|fail|important|critical|must|never|always|warning|exception)\b') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) * 0.075::DOUBLE) END AS imp FROM m)
"""
_RECENT = "SELECT * FROM (SELECT *, sys OR sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY idx DESC) + systok <= 488 AS kept FROM mm)"

PARAGRAPH = "\n"
AVAILABLE = 200


def _trim_doc(strategy: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        docs = _read(spark, sf, "documents").select("doc_id", "text")
        out = trim.trim_documents(docs, "text", strategy, AVAILABLE, PARAGRAPH, "(th|en)")
        return out.select("doc_id", F.md5("trimmed").alias("digest"), F.char_length("trimmed").cast("bigint").alias("n_chars"), "truncated")

    return query


def _doc_sql(order: str, stop: bool) -> str:
    going = "z.going AND " if stop else ""
    return rf"""
WITH p AS (
  SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS ps FROM documents
), q AS (SELECT doc_id, text, CASE WHEN len(ps) > 0 THEN ps ELSE [text] END AS ps FROM p),
e AS (SELECT doc_id, i - 1 AS i, ps[i] AS x, len(ps) AS n, len(regexp_extract_all(ps[i], '(th|en)'))::DOUBLE / greatest(len(list_filter(regexp_split_to_array(ps[i], '\s+'), lambda y: y <> '')), 1) AS d FROM q, unnest(generate_series(1, len(ps))) u(i)),
o AS (SELECT doc_id, list({{'i': i, 'l': length(x)}} ORDER BY {order}, i) AS items FROM e GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(list_transform(items, lambda y: {{'used': 0::BIGINT, 'going': true, 'kept': []::BIGINT[], 'i': y.i::BIGINT, 'l': y.l::BIGINT}}),
   lambda z, y: CASE WHEN {going}(z.used + y.l + CASE WHEN len(z.kept) > 0 THEN 2 ELSE 0 END + 3) // 4 <= {AVAILABLE}
     THEN {{'used': z.used + y.l + CASE WHEN len(z.kept) > 0 THEN 2 ELSE 0 END, 'going': z.going, 'kept': list_append(z.kept, y.i), 'i': 0::BIGINT, 'l': 0::BIGINT}}
     ELSE {{'used': z.used, 'going': {'false' if stop else 'z.going'}, 'kept': z.kept, 'i': 0::BIGINT, 'l': 0::BIGINT}} END,
   {{'used': 0::BIGINT, 'going': true, 'kept': []::BIGINT[], 'i': 0::BIGINT, 'l': 0::BIGINT}}).kept AS kept FROM o),
r AS (SELECT doc_id, (length(text) + 3) // 4 > {AVAILABLE} AS truncated,
  CASE WHEN (length(text) + 3) // 4 <= {AVAILABLE} THEN text WHEN len(kept) > 0 THEN array_to_string(list_transform(list_sort(kept), lambda i: ps[i + 1]), chr(10) || chr(10)) ELSE ps[len(ps)][1:{AVAILABLE * 4}] END AS t
  FROM q JOIN f USING (doc_id))
SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n_chars, truncated FROM r"""


def pressure_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns stand for fill levels; the first one is the baseline."""
    return similarity.corpus_to_first(assistant_outputs(spark, sf), "conv_id", "turn", "text").withColumn("similarity", F.round("similarity", 6))


def pressure_onset(spark: SparkSession, sf: str) -> DataFrame:
    curve = pressure_curve(spark, sf).withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    t = verdicts.PRESSURE[TIER]
    out = curve.groupBy("conv_id").agg(F.count("*").alias("n_levels"), F.round(F.coalesce(F.avg(F.when(F.col("_n") > 1, F.col("similarity"))), F.max("similarity")), 6).alias("score"), F.min(F.when((F.col("_n") > 1) & (F.col("similarity") < t), F.col("turn"))).alias("onset"))
    return out.select("conv_id", "n_levels", "score", "onset", verdicts.pressure(F.col("score"), TIER).alias("verdict"), (F.col("score") >= t).alias("gate_passed"))


_CURVE = r"""
out AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
tc AS (SELECT conv_id, turn, term, count(*)::BIGINT AS c FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS term FROM out) GROUP BY ALL),
g AS (SELECT conv_id, count(*) AS n, min(turn) AS first FROM out GROUP BY ALL),
df AS (SELECT conv_id, term, count(*) AS df FROM tc GROUP BY ALL),
w AS (SELECT tc.conv_id, turn, term, first, c * (ln((n + 1)::DOUBLE / (df + 1)) + 1) AS w FROM tc JOIN df USING (conv_id, term) JOIN g USING (conv_id)),
nm AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS size FROM w GROUP BY ALL),
f AS (SELECT conv_id, term, w AS w0 FROM w WHERE turn = first),
dt AS (SELECT conv_id, turn, sum(w * w0) AS dot FROM w JOIN f USING (conv_id, term) GROUP BY ALL),
curve AS (SELECT out.conv_id, out.turn, round(CASE WHEN nm.size > 0 AND z.size > 0 THEN least(1.0, coalesce(dot, 0) / (nm.size * z.size)) ELSE 0.0 END, 6) AS similarity
  FROM out JOIN g USING (conv_id) LEFT JOIN nm USING (conv_id, turn) LEFT JOIN nm z ON z.conv_id = out.conv_id AND z.turn = g.first LEFT JOIN dt ON dt.conv_id = out.conv_id AND dt.turn = out.turn)
"""


def fill_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's padding at each fill level of an 8192-token window."""
    base = _read(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    each = base.withColumn("level", F.explode(F.array(*map(F.lit, LEVELS))))
    target = F.floor(F.col("level") * 8192).cast("bigint")
    return each.select("conv_id", "level", target.alias("tokens"), F.md5(F.expr("substring(repeat(text, cast(ceil(floor(level * 8192) * 4 / greatest(char_length(text), 1)) as int)), 1, cast(floor(level * 8192) * 4 as int))")).alias("digest"))


QUERIES = {
    "consistency_score": consistency_score,
    "consistency_report": consistency_report,
    "pairwise_min_max": pairwise_min_max,
    "fidelity_pairs": fidelity_pairs,
    "livelock_steps": livelock_steps,
    "livelock_report": livelock_report,
    "stuck_window": stuck_window,
    "jaccard_consecutive": jaccard_consecutive,
    **{f"patrol_{p}": _one(p) for p in patrol.PATHOLOGIES},
    "patrol_best": patrol_best,
    "patrol_summary": patrol_summary,
    "token_estimate": token_estimate,
    "importance_score": importance_score,
    "trim_recency": _trim("recency"),
    "trim_importance": _trim("importance"),
    "trim_hybrid": _trim("hybrid"),
    "trim_stats": trim_stats,
    "budget_gate": budget_gate,
    "doc_trim_tail": _trim_doc("tail"),
    "doc_trim_important": _trim_doc("important"),
    "doc_trim_hybrid": _trim_doc("hybrid"),
    "doc_trim_marker": _trim_doc("summary"),
    "pressure_curve": pressure_curve,
    "pressure_onset": pressure_onset,
    "fill_levels": fill_levels,
}
ORACLES = {
    "consistency_score": f"WITH {_TERMS} SELECT conv_id, n_outputs, n_pairs, round(score, 6) AS score, CASE WHEN score >= 0.6::DOUBLE THEN 'CONSISTENT' WHEN score >= 0.55::DOUBLE THEN 'BORDERLINE' ELSE 'INCONSISTENT' END AS verdict FROM scored",
    "consistency_report": f"WITH {_TERMS}, v AS (SELECT score, CASE WHEN score >= 0.6::DOUBLE THEN 'CONSISTENT' WHEN score >= 0.55::DOUBLE THEN 'BORDERLINE' ELSE 'INCONSISTENT' END AS v FROM scored) SELECT count(*)::BIGINT AS n, count_if(v = 'CONSISTENT')::BIGINT AS n_consistent, count_if(v = 'BORDERLINE')::BIGINT AS n_borderline, count_if(v = 'INCONSISTENT')::BIGINT AS n_inconsistent, round(avg(score), 6) AS mean_score, CASE WHEN bool_and(v = 'CONSISTENT') THEN 'CONSISTENT' WHEN count_if(v = 'INCONSISTENT') = 0 THEN 'BORDERLINE' ELSE 'INCONSISTENT' END AS verdict FROM v",
    "pairwise_min_max": f"WITH {_TERMS} SELECT conv_id, round(least, 6)::DOUBLE AS least, round(most, 6) AS most FROM scored",
    "fidelity_pairs": f"WITH {_FIDELITY}, {_VERSUS} SELECT sims.conv_id, sims.turn, left(sha256(src.a), 16) AS prompt_hash, round(similarity, 6) AS similarity, round(counts, 6) AS counts_cosine, CASE WHEN 1 - similarity >= 0.75 THEN 'FAITHFUL' WHEN 1 - similarity < 0.5 THEN 'UNFAITHFUL' ELSE 'INCONCLUSIVE' END AS verdict FROM sims JOIN src USING (conv_id, turn)",
    "livelock_steps": f"WITH {_LIVELOCK} SELECT conv_id, turn, round(progress, 6) AS progress, round(delta, 6) AS delta, stuck FROM st",
    "livelock_report": f"WITH {_LIVELOCK} SELECT st.conv_id, count(*)::BIGINT AS n_steps, count_if(stuck)::BIGINT AS n_stuck, round(count_if(stuck)::DOUBLE / count(*), 6) AS score, round(avg(delta), 6) AS mean_progress, coalesce(any_value(len), 0)::BIGINT AS longest, coalesce(any_value(len), 0) >= 2 AS detected, CASE WHEN count_if(stuck)::DOUBLE / count(*) <= 0.15::DOUBLE THEN 'LIVELOCK_FREE' WHEN count_if(stuck)::DOUBLE / count(*) <= 0.15::DOUBLE + 0.05::DOUBLE THEN 'BORDERLINE' ELSE 'LIVELOCK_DETECTED' END AS verdict, count_if(stuck)::DOUBLE / count(*) <= 0.15::DOUBLE AS gate_passed FROM st LEFT JOIN best ON st.conv_id = best.conv_id GROUP BY st.conv_id",
    "stuck_window": f'WITH {_LIVELOCK} SELECT c.conv_id, coalesce(len, 0)::BIGINT AS longest, s AS start, e AS "end" FROM (SELECT DISTINCT conv_id FROM st) c LEFT JOIN best ON c.conv_id = best.conv_id',
    "jaccard_consecutive": r"WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM conversations), l AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t) SELECT conv_id, turn, round(CASE WHEN b IS NULL THEN NULL WHEN len(list_concat(t, b)) = 0 THEN 1.0 ELSE len(list_intersect(t, b))::DOUBLE / len(list_distinct(list_concat(t, b))) END, 6) AS similarity FROM l",
    **{f"patrol_{p}": f"WITH {_PATROL} SELECT user_id, step, round({p}, 6)::DOUBLE AS confidence FROM rp WHERE {p} IS NOT NULL" for p in patrol.PATHOLOGIES},
    "patrol_best": f"WITH {_PATROL} SELECT user_id, step, pathology, severity, round(confidence, 6)::DOUBLE AS confidence FROM bs",
    "patrol_summary": f"WITH {_PATROL} SELECT rp.user_id, count(*)::BIGINT AS n_steps, count(pathology)::BIGINT AS n_reports, round(greatest(0.0, 1 - count(pathology)::DOUBLE / count(*)), 6) AS health, CASE WHEN count(pathology) = 0 THEN 'healthy' WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'degraded' END AS verdict FROM rp LEFT JOIN bs USING (user_id, step) GROUP BY rp.user_id",
    "token_estimate": "SELECT doc_id, ((length(text) + 3) // 4)::BIGINT AS tokens, greatest(1, length(text) // 4)::BIGINT AS tokens_floor FROM documents",
    "importance_score": f"WITH {_COSTS} SELECT conv_id, turn, tokens::BIGINT AS tokens, round(imp, 6) AS importance FROM mm",
    "trim_recency": f"WITH {_COSTS} SELECT conv_id, turn FROM ({_RECENT}) WHERE kept",
    "trim_importance": f"WITH {_COSTS} SELECT conv_id, turn FROM (SELECT *, sys OR sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY sys DESC, imp DESC, idx DESC) + systok <= 488 AS kept FROM mm) WHERE kept",
    "trim_hybrid": f"""WITH {_COSTS}, it AS (SELECT conv_id, any_value(systok) AS systok, list({{'i': idx::BIGINT, 't': tokens::BIGINT}} ORDER BY imp DESC, idx DESC) FILTER (WHERE NOT sys) AS items FROM mm GROUP BY conv_id),
      fo AS (SELECT conv_id, list_reduce(list_transform(coalesce(items, []), lambda y: {{'used': 0::BIGINT, 'kept': []::BIGINT[], 'i': y.i, 't': y.t}}), lambda z, y: CASE WHEN z.used + y.t <= 488 - systok THEN {{'used': z.used + y.t, 'kept': list_append(z.kept, y.i), 'i': 0::BIGINT, 't': 0::BIGINT}} ELSE z END, {{'used': 0::BIGINT, 'kept': []::BIGINT[], 'i': 0::BIGINT, 't': 0::BIGINT}}).kept AS kept FROM it)
      SELECT conv_id, turn FROM mm JOIN fo USING (conv_id) WHERE sys OR list_contains(kept, idx)""",
    "trim_stats": f"WITH {_COSTS} SELECT conv_id, count(*)::BIGINT AS n_before, sum(tokens)::BIGINT AS tokens_before, count_if(kept)::BIGINT AS n_after, coalesce(sum(tokens) FILTER (WHERE kept), 0)::BIGINT AS tokens_after, round(1 - coalesce(sum(tokens) FILTER (WHERE kept), 0)::DOUBLE / sum(tokens), 6) AS trim_ratio, coalesce(sum(tokens) FILTER (WHERE kept), 0) <= 488 AS fits, greatest(0, sum(tokens) - 488)::BIGINT AS tokens_over FROM ({_RECENT}) GROUP BY conv_id",
    "budget_gate": f"WITH {_COSTS} SELECT conv_id, sum(tokens)::BIGINT AS tokens, greatest(0, sum(tokens) - 488)::BIGINT AS tokens_over, sum(tokens) <= 488 AS passed FROM mm GROUP BY conv_id",
    "doc_trim_tail": _doc_sql("-i", True),
    "doc_trim_important": _doc_sql("-d", False),
    "doc_trim_hybrid": _doc_sql("-((i + 1)::DOUBLE / n * 0.5::DOUBLE + least(d * 5, 1.0::DOUBLE) * 0.5::DOUBLE)", False),
    "doc_trim_marker": r"WITH r AS (SELECT doc_id, (length(text) + 3) // 4 > 200 AS truncated, CASE WHEN (length(text) + 3) // 4 <= 200 THEN text ELSE text[1:(200 - 12) * 4] || chr(10) || chr(10) || '[... content trimmed to fit token budget ...]' END AS t FROM documents) SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n_chars, truncated FROM r",
    "pressure_curve": f"WITH {_CURVE} SELECT conv_id, turn, similarity FROM curve",
    "pressure_onset": f"WITH {_CURVE}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM curve), s AS (SELECT conv_id, count(*)::BIGINT AS n_levels, round(coalesce(avg(similarity) FILTER (WHERE n > 1), max(similarity)), 6) AS score, min(turn) FILTER (WHERE n > 1 AND similarity < 0.65::DOUBLE) AS onset FROM n GROUP BY conv_id) SELECT conv_id, n_levels, score, onset, CASE WHEN score >= 0.65::DOUBLE THEN 'STABLE' WHEN score >= 0.65::DOUBLE - 0.1::DOUBLE THEN 'MILD' WHEN score >= 0.65::DOUBLE - 0.2::DOUBLE THEN 'MODERATE' ELSE 'SEVERE' END AS verdict, score >= 0.65::DOUBLE AS gate_passed FROM s",
    "fill_levels": "WITH b AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id), l AS (SELECT *, unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS level FROM b) SELECT conv_id, level, floor(level * 8192)::BIGINT AS tokens, md5(repeat(text, ceil(floor(level * 8192) * 4 / greatest(length(text), 1))::BIGINT)[1:(floor(level * 8192) * 4)::BIGINT]) AS digest FROM l",
}
