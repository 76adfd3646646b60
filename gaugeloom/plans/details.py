"""Queries on windows of ledgers, batch reports, dimensions of parity, subjects, summaries of changes, and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeloom.functions import text as X
from gaugeloom.operators import evaluation, ledger, livelock, mutation, parsing, scoring, similarity, trim
from gaugeloom.sources import scans

from . import agents, ledgers
from .ledgers import AS_OF, _read, _sql_list, events

DAYS, HOURS = 7, 36
LIMIT = 256
FILLER = "History of an earlier turn. "


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def pass_rate_days(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.pass_rates(events(spark, sf), ["user_id"], "ts", "passed", _as_of(), DAYS).withColumn("pass_rate", F.round("pass_rate", 6))


def recent_violations(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.recent_violation_rates(events(spark, sf), ["user_id"], "ts", "passed", _as_of(), HOURS).withColumn("rate", F.round("rate", 6))


def trim_history(spark: SparkSession, sf: str) -> DataFrame:
    """The last ten trimmed conversations of each pipeline, told by the number of a conversation."""
    runs = agents.trim_stats(spark, sf).withColumn("pipeline", F.pmod("conv_id", F.lit(7)))
    return ledger.trim_history(runs.withColumn("dropped", F.col("n_before") - F.col("n_after")), ["pipeline"], "trim_ratio", "dropped", "fits", F.desc("conv_id"), n=10)


def fidelity_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = agents.fidelity_pairs(spark, sf).withColumn("score", 1 - F.col("similarity"))
    return similarity.fidelity_report(rows, [], "score", "similarity", "verdict")


def contract_structural(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as contracts, lines as rules; one of them may be no line of an order at all."""
    l = _read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("confidence"), F.lit(0.3).alias("threshold"), F.lit(True).alias("enabled"), F.lit(0.5).alias("weight"), F.when(F.col("l_quantity") < 3, F.lit("no quantity")).alias("error"))  # noqa: E741
    s = scoring.contract_scores(scoring.rule_verdicts(l, "confidence", "threshold", "enabled"), ["l_orderkey"], "weight", 0.2, structural="error")
    return s.withColumn("score", F.round("score", 6))


def _hundredths(c: str) -> Column:
    """To two digits as SQL engines round a double, by its hundredfold; Spark rounds its shortest decimal form, in which 0.85 + 0.075 is below 0.925."""
    return F.round(F.col(c) * 100) / 100


def parity_explanations(spark: SparkSession, sf: str) -> DataFrame:
    """All seven dimensions, dealt out by id."""
    t = ledgers.templated(spark, sf).withColumn("dimension", ledgers._dealt("doc_id", list(scoring.DIMENSIONS)))
    test = {"constraints": F.col("constraints"), "required": F.lit(True), "golden": F.lit("the report and the ledger"), "refusal_expected": F.lit(False), "conclusion": F.lit("answer possibly"), "no_crash": F.lit(True)}
    of = lambda r: scoring.dimension_score(F.col("dimension"), F.col(r), test)
    scored = t.select("doc_id", "dimension", of("response").alias("b"), of("other").alias("c"))
    return scored.select("doc_id", "dimension", F.round("b", 6).alias("baseline"), F.round("c", 6).alias("candidate"), scoring.parity_explanation(F.col("dimension"), _hundredths("b"), _hundredths("c")).alias("explanation"))


def intent_subjects(spark: SparkSession, sf: str) -> DataFrame:
    d = _read(spark, sf, "documents").select("doc_id", F.concat(ledgers._dealt("doc_id", ledgers.INTENTS), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", F.posexplode(parsing.intent_clauses(F.col("t"))).alias("n", "c")).select("doc_id", F.col("n").cast("bigint").alias("n"), F.col("c.subject").alias("subject"))


def hunk_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.hunk_summaries(ledgers.changes(spark, sf), "doc_id", "d", 4).select("doc_id", "hunk", F.md5("summary").alias("digest"))


def fine_fill_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn's context at ten levels of a window: padding before it, and its tokens."""
    c = _read(spark, sf, "conversations").select("conv_id", "turn", "text", F.explode(X.fill_levels(10)).alias("level"))
    target = X.fill_tokens(F.col("level"), LIMIT)
    return c.select("conv_id", "turn", "level", target.alias("tokens"), F.md5(X.padded_context(F.col("text"), target, F.lit(FILLER))).alias("digest"))


def livelock_advice(spark: SparkSession, sf: str) -> DataFrame:
    return livelock.report(agents.livelock_made(spark, sf), "conv_id", "turn", k=2).select("conv_id", "recommendation")


def short_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", X.short(F.col("text")).alias("text"))


def message_budget(spark: SparkSession, sf: str) -> DataFrame:
    return trim.budget(_read(spark, sf, "conversations"), "conv_id", "role", "text", agents.MOST)


def unicode_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of the counts of words in any script, of each assistant turn and the one before it."""
    sims = similarity.versus(agents.fidelity_input(spark, sf), ["conv_id", "turn"], "text", "suppressed", pattern=X.UNICODE_WORD)
    return sims.select("conv_id", "turn", F.round("similarity_counts", 6).alias("cosine"))


def message_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as prompts; the content of odd turns comes as a list of blocks."""
    blocks = F.concat(F.lit('[{"type": "image", "url": "u"}, {"type": "text", "text": '), F.expr("substr(to_json(named_struct('t', text)), 6, length(to_json(named_struct('t', text))) - 6)"), F.lit("}]"))
    c = _read(spark, sf, "conversations").withColumn("content", F.when(F.col("turn") % 2 == 1, blocks).otherwise(F.col("text")))
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    return m.select("conv_id", F.md5(mutation.flatten_messages(F.col("m"))).alias("digest"))


def newest_first(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.since(events(spark, sf).select("event_id", "user_id", "ts"), "ts", _as_of(), "7 DAYS", 25).select("event_id", "user_id")


#: Words that a prompt of a role's suite must hold.
SUITES = {"user": ["Never", "Formal"], "assistant": ["Always", "brief"], "system": ["Never", "Always", "Formal", "brief"]}


def share_of_words(prompt: str, cases: list[dict]) -> float:
    """An evaluator: the share of a suite's words that a prompt holds."""
    return sum(c["word"] in prompt for c in cases) / len(cases) if cases else 0.0


def _suite_prompts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Prompts with the role whose suite they are held against, and the suites of the roles that there are."""
    roles = _read(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("suite"))
    words = F.create_map(*[x for role, ws in SUITES.items() for x in (F.lit(role), F.array(*map(F.lit, ws)))])
    cases = roles.select("suite").distinct().select("suite", F.posexplode(F.element_at(words, F.col("suite"))).alias("n", "word"))
    return ledgers.prompts(spark, sf).join(roles, "id"), cases


def prompt_calibration(spark: SparkSession, sf: str) -> DataFrame:
    prompts, cases = _suite_prompts(spark, sf)
    out = evaluation.calibrate(prompts, cases, "suite", "id", "t", share_of_words, order="n")
    return out.select("id", F.round("calibration_score", 6).alias("calibration_score"), "total", "caught", "missed", F.md5(F.array_join("warnings", "|")).alias("warnings"))


def mutation_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Mutants of each prompt, run against its suite."""
    prompts, cases = _suite_prompts(spark, sf)
    runs = evaluation.run_mutants(prompts, mutation.generate(prompts, "id", "t"), cases, "suite", "id", "t", "mutated", share_of_words, order="n", runs=1)
    out = evaluation.mutation_report(runs, "id")
    return out.select("id", "total", "killed", "survived", "skipped", F.round("score", 6).alias("score"), "verdict", F.md5(F.array_join("recommendations", "|")).alias("recommendations"))


PATTERNS = ["src1/**/*.txt", "src?/en/1*.txt", "**/7?.txt"]


def matching_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files of changes that a prompt's patterns name."""
    paths = _read(spark, sf, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return scans.matching_files(paths, "path", PATTERNS)


def short_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", *[X.fingerprint(F.col("text"), kind).alias(kind) for kind in ("sha256", "md5", "sha1")])


QUERIES = {f.__name__: f for f in (prompt_calibration, mutation_reports, matching_files, short_hashes, unicode_cosine, message_blocks, newest_first, pass_rate_days, recent_violations, trim_history, fidelity_report, contract_structural, parity_explanations, intent_subjects, hunk_summaries, fine_fill_levels, livelock_advice, short_texts, message_budget)}

_B = ledgers._BLANK


def _recall(r: str, wanted: str) -> str:
    words = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(wanted.split())) + "]"
    return rf"CASE WHEN contains(lower({r}), '{wanted}') THEN 1.0::DOUBLE ELSE len(list_intersect({words}, list_distinct(regexp_extract_all(lower({r}), '[\p{{L}}\p{{N}}_]+'))))::DOUBLE / {len(dict.fromkeys(wanted.split()))} END"


def _dimension(r: str) -> str:
    parts = {
        "structured_output": "0.0::DOUBLE", "instruction_adherence": ledgers._adherence(r), "task_completion": ledgers._completion(r, "true"), "semantic_accuracy": _recall(r, "the report and the ledger"),
        "safety_compliance": ledgers._safety(r, "false"), "reasoning_coherence": _recall(r, "answer possibly"), "edge_case_handling": ledgers._edge(r),
    }
    return "CASE dimension " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in parts.items()) + " END"


_FIDELITY_ROWS = agents.ORACLES["fidelity_pairs"]
_HOLDS = "len(list_filter(ws, lambda w: contains({0}, w)))::DOUBLE / len(ws)"
_WARNED = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{a.replace(chr(39), chr(39) * 2)}'" for k, severity, _, a in mutation.CALIBRATION if severity == "HIGH") + " END"
ORACLES = {
    "prompt_calibration": f"""{ledgers.ORACLES['calibration_mutants'].replace("SELECT id, made.k AS kind, md5(CASE WHEN made.t = '' THEN t ELSE made.t END) AS digest FROM m", "")}, e AS (SELECT m.id, made.k AS kind, t, CASE WHEN made.t = '' THEN t ELSE made.t END AS mutant, CASE role WHEN 'user' THEN {SUITES['user']} WHEN 'assistant' THEN {SUITES['assistant']} WHEN 'system' THEN {SUITES['system']} END AS ws FROM m JOIN (SELECT conv_id || '-' || turn AS id, role FROM conversations) r ON r.id = m.id),
s AS (SELECT id, kind, {_HOLDS.format('t')} - {_HOLDS.format('mutant')} >= 0.15::DOUBLE AS caught FROM e WHERE mutant <> t)
SELECT id, round(avg(caught::INT), 6) AS calibration_score, count(*)::BIGINT AS total, count_if(caught)::BIGINT AS caught, count_if(NOT caught)::BIGINT AS missed, md5(coalesce(string_agg({_WARNED}, '|' ORDER BY kind) FILTER (WHERE NOT caught AND {_WARNED} IS NOT NULL), '')) AS warnings FROM s GROUP BY id""",
    "matching_files": r"WITH p AS (SELECT concat_ws('/', source, lang, doc_id || '.txt') AS path FROM documents) SELECT DISTINCT path FROM p WHERE regexp_matches(path, '^src1/(.*/)?[^/]*\.txt$') OR regexp_matches(path, '^src[^/]/en/1[^/]*\.txt$') OR regexp_matches(path, '^(.*/)?7[^/]\.txt$')",
    "short_hashes": "SELECT doc_id, left(sha256(text), 16) AS sha256, left(md5(text), 16) AS md5, left(sha1(text), 8) AS sha1 FROM documents",
    "unicode_cosine": f"WITH {agents._FIDELITY}, {agents._VERSUS.replace('[a-z0-9]+', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')} SELECT conv_id, turn, round(counts, 6) AS cosine FROM sims",
    "message_blocks": ledgers.ORACLES["flattened_messages"],
    "newest_first": f"SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS AND ts <= TIMESTAMP '{AS_OF}' ORDER BY ts DESC, event_id LIMIT 25",
    "pass_rate_days": f"SELECT user_id, round(avg((event_type <> 'error')::INT) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAYS AND ts <= TIMESTAMP '{AS_OF}'), 6) AS pass_rate, count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAYS AND ts <= TIMESTAMP '{AS_OF}')::BIGINT AS n FROM events GROUP BY user_id",
    "recent_violations": f"WITH w AS (SELECT user_id, event_type = 'error' AS bad FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL {HOURS} HOURS AND ts <= TIMESTAMP '{AS_OF}'), s AS (SELECT user_id, count(*)::BIGINT AS n, avg(bad::INT) AS rate FROM w GROUP BY user_id) SELECT u.user_id, coalesce(n, 0)::BIGINT AS n, round(coalesce(rate, 0), 6)::DOUBLE AS rate FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s ON s.user_id = u.user_id",
    "trim_history": f"WITH t AS ({agents.ORACLES['trim_stats']}), r AS (SELECT *, conv_id % 7 AS pipeline FROM t QUALIFY row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id DESC) <= 10) SELECT pipeline, count(*)::BIGINT AS total_runs, count_if(NOT fits)::BIGINT AS over_budget_runs, round(avg(trim_ratio), 4) AS avg_trim_ratio, round(avg(n_before - n_after), 2) AS avg_dropped_count FROM r GROUP BY pipeline",
    "fidelity_report": f"WITH f AS ({_FIDELITY_ROWS}) SELECT count(*)::BIGINT AS total, count_if(verdict = 'FAITHFUL')::BIGINT AS faithful_count, count_if(verdict = 'UNFAITHFUL')::BIGINT AS unfaithful_count, count_if(verdict = 'INCONCLUSIVE')::BIGINT AS inconclusive_count, round(avg((verdict = 'FAITHFUL')::INT), 4) AS faithfulness_rate, round(avg((verdict = 'UNFAITHFUL')::INT), 4) AS unfaithfulness_rate, round(avg(1 - similarity), 4) AS mean_faithfulness_score, round(avg(similarity), 4) AS mean_similarity FROM f",
    "contract_structural": "WITH r AS (SELECT l_orderkey, l_discount * 10 AS c, l_quantity < 3 AS broken FROM lineitem), s AS (SELECT l_orderkey, count(*)::BIGINT AS n_rules, CASE WHEN bool_or(broken) THEN 0.0::DOUBLE ELSE sum(CASE WHEN c >= 0.3::DOUBLE THEN c * 0.5::DOUBLE ELSE 0 END) / (count(*) * 0.5::DOUBLE) END AS score, bool_or(broken) AS broken FROM r GROUP BY l_orderkey) SELECT l_orderkey, n_rules, round(score, 6) AS score, NOT broken AND score >= 0.2::DOUBLE AS passed FROM s",
    "parity_explanations": f"""WITH {ledgers._RESP}, d AS (SELECT *, {_sql_list(list(scoring.DIMENSIONS))}[doc_id % 7 + 1] AS dimension FROM t), s AS (SELECT doc_id, dimension, {_dimension('response')} AS b, {_dimension('other')} AS c FROM d), r AS (SELECT *, round(b, 2) AS rb, round(c, 2) AS rc FROM s)
SELECT doc_id, dimension, round(b, 6) AS baseline, round(c, 6) AS candidate, printf('[%s] baseline=%.2f candidate=%.2f parity=%.2f — candidate is %s than baseline', dimension, rb, rc, 1 - abs(rc - rb), CASE WHEN rc - rb > 0.05::DOUBLE THEN 'better' WHEN rc - rb < -0.05::DOUBLE THEN 'worse' ELSE 'equivalent' END) AS explanation FROM r""",
    "intent_subjects": rf"WITH t AS (SELECT doc_id, {_sql_list(ledgers.INTENTS)}[doc_id % 4 + 1] || chr(10) || coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '[.!?\n]|(?:^|\n)\s*[-*•]\s*'), lambda x: trim(x, {_B})), lambda x: length(x) >= 8)[1:12] AS cs FROM t), u AS (SELECT doc_id, i - 1 AS n, cs[i] AS x FROM c, unnest(generate_series(1, len(cs))) q(i)) SELECT doc_id, n::BIGINT AS n, CASE WHEN regexp_matches(x, '{parsing.SUBJECT}') THEN trim(regexp_extract(x, '{parsing.SUBJECT}', 1), {_B}) ELSE x[1:40] END AS subject FROM u",
    "hunk_summaries": f"""WITH {ledgers._CHANGED}, s AS (SELECT doc_id, (i - 1) // 10 + 1 AS hunk, name, i, l[1] AS kind, l FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hunk, kind ORDER BY i) AS n FROM s WHERE (kind = '+' AND NOT starts_with(l, '+++')) OR (kind = '-' AND NOT starts_with(l, '---'))),
g AS (SELECT doc_id, hunk, coalesce(string_agg('- ' || l[2:], chr(10) ORDER BY i) FILTER (WHERE kind = '-'), '') AS r, coalesce(string_agg('+ ' || l[2:], chr(10) ORDER BY i) FILTER (WHERE kind = '+'), '') AS a FROM k WHERE n <= 4 GROUP BY ALL), h AS (SELECT doc_id, hunk, any_value(name) AS name FROM s GROUP BY ALL)
SELECT h.doc_id, h.hunk::BIGINT AS hunk, md5(trim('File: ' || name || chr(10) || coalesce(r, '') || chr(10) || coalesce(a, ''), {_B})) AS digest FROM h LEFT JOIN g ON g.doc_id = h.doc_id AND g.hunk = h.hunk""",
    "fine_fill_levels": f"WITH l AS (SELECT conv_id, turn, text, unnest(list_transform(generate_series(1, 10), lambda i: i / 10.0::DOUBLE))::DOUBLE AS level FROM conversations), t AS (SELECT *, floor(level * {LIMIT})::BIGINT AS tokens, floor(level * {LIMIT})::BIGINT - greatest(1, length(text) // 4) AS missing FROM l) SELECT conv_id, turn, level, tokens, md5(CASE WHEN missing <= 0 THEN text ELSE repeat('{FILLER}', 1 + missing * 4 // {len(FILLER)})[1:missing * 4] || chr(10) || chr(10) || text END) AS digest FROM t",
    "livelock_advice": f"""WITH {agents._LIVELOCK}, s AS (SELECT st.conv_id, count_if(stuck)::DOUBLE / count(*) AS score, coalesce(any_value(len), 0) AS len, any_value(s) AS s FROM st LEFT JOIN best ON st.conv_id = best.conv_id GROUP BY st.conv_id) SELECT conv_id, CASE WHEN len >= 2 THEN printf('stuck from step %d for %d steps, score %.3f', s, len, score) WHEN score < 0.05::DOUBLE THEN 'progressing' ELSE printf('mostly progressing, score %.3f', score) END AS recommendation FROM s""",
    "short_texts": "SELECT doc_id, text[1:120] || CASE WHEN length(text) > 120 THEN '...' ELSE '' END AS text FROM documents",
    "message_budget": f"SELECT conv_id, sum((length(text) + 3) // 4 + (length(role) + 3) // 4 + 4)::BIGINT AS tokens, greatest(0, sum((length(text) + 3) // 4 + (length(role) + 3) // 4 + 4) - {agents.MOST - trim.RESERVED})::BIGINT AS tokens_over, sum((length(text) + 3) // 4 + (length(role) + 3) // 4 + 4) <= {agents.MOST - trim.RESERVED} AS fits FROM conversations GROUP BY conv_id",
}
