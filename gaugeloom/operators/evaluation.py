"""Evaluators of whole prompts against suites of cases, and what a suite makes of mutants.

An evaluator gets a prompt and all cases of its suite, as dictionaries, and gives a number within 0 and 1.  Prompts are spread over all tasks, whatever
suites they belong to: a suite's cases, which an evaluator holds at once anyway, travel with them.  What fails, or is out of range, is an error in its row; the job goes on.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DELTA = 0.15

# fixed values: what is said of a score out of range and of an evaluator that fails
OUT_OF_RANGE, RAISED = "eval_fn returned {!r} — must be between 0.0 and 1.0", "eval_fn raised an exception: {}"


def score_of(f: Callable[[str, list[dict]], float], prompt: str, cases: list[dict], runs: int) -> tuple[float | None, str | None]:
    """(median score, None), or (None, what went wrong)."""
    scores = []
    for _ in range(runs):
        try:
            score = float(f(prompt, cases))
        except ValueError as e:
            return None, str(e)
        except Exception as e:
            return None, RAISED.format(e)
        if math.isnan(score) or not 0 <= score <= 1:
            return None, OUT_OF_RANGE.format(score)
        scores.append(score)
    return median(scores), None


def evaluate(prompts: DataFrame, cases: DataFrame, suite: str, prompt: str, f: Callable[[str, list[dict]], float], order: str | None = None, runs: int = 1, at_once: int = 1, out: str = "score") -> DataFrame:
    """prompts with `out`, the median of the runs' scores, and `error`.  cases: a table with the suite's key; `order` is the order in which f gets them.

    at_once: prompts that a task evaluates at the same time, for evaluators that wait.  A prompt whose suite has no cases is evaluated on none; a null prompt is an error."""
    if runs < 1 or at_once < 1:
        raise ValueError("runs and at_once must be 1 or more")
    fields = [c for c in cases.columns if c != suite]
    told = F.struct(*([F.col(order).alias("at")] if order else []), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("case"))
    whole = cases.groupBy(F.col(suite).alias("_suite")).agg(F.transform(F.sort_array(F.collect_list(told)), lambda c: c["case"]).alias("_cases"))
    joined = prompts.join(whole, prompts[suite].eqNullSafe(F.col("_suite")), "left").drop("_suite")
    kinds = {x.name: x.dataType.simpleString() for x in prompts.schema}
    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + f", `{out}` double, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                suites = [[json.loads(c) for c in cs] if cs is not None else [] for cs in batch["_cases"]]
                one = lambda p, cs: (None, "no prompt") if p is None else score_of(f, p, cs, runs)
                found = list(pool.map(one, batch[prompt], suites))
                yield batch.drop(columns="_cases").assign(**{out: pd.array([s for s, _ in found], "Float64"), "error": [e for _, e in found]})

    return joined.mapInPandas(run, schema)


def run_mutants(prompts: DataFrame, mutants: DataFrame, cases: DataFrame, suite: str, key: str, prompt: str, mutated: str, f: Callable[[str, list[dict]], float], order: str | None = None, delta: float = DELTA, runs: int = 3, at_once: int = 4) -> DataFrame:
    """mutants with original_score, mutant_score, delta, verdict and error.

    KILLED: the suite's score falls by `delta`; SURVIVED: it doesn't; SKIPPED, with the original's score: the mutant, or its original, couldn't be evaluated.
    prompts: suite, key, prompt; mutants: key and the mutated text."""
    if not 0 < delta < 1:
        raise ValueError("delta must be between 0 and 1")
    scored = evaluate(prompts.select(suite, key, prompt), cases, suite, prompt, f, order, runs, at_once, "original_score").withColumnRenamed("error", "_original_error")
    both = evaluate(mutants.join(prompts.select(key, suite), key), cases, suite, mutated, f, order, runs, at_once, "mutant_score").join(scored.select(key, "original_score", "_original_error"), key)
    error = F.coalesce("_original_error", "error")
    fall = F.round(F.col("original_score") - F.col("mutant_score"), 9)
    verdict = F.when(error.isNotNull(), "SKIPPED").when(fall >= delta, "KILLED").otherwise("SURVIVED")
    out = both.withColumns({"delta": F.when(error.isNull(), F.col("original_score") - F.col("mutant_score")).otherwise(0.0), "verdict": verdict, "mutant_score": F.when(error.isNull(), F.col("mutant_score")).otherwise(F.col("original_score")), "error": error})
    return out.drop("_original_error", suite)


def mutation_report(results: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """(key, total, killed, survived, skipped, score, verdict, recommendations) of run_mutants(): the share of killed mutants of those that were evaluated, and the advice of those that survived, in order."""
    from gaugeloom.functions import verdicts

    many = lambda v: F.count_if(F.col("verdict") == v)
    advice = F.struct(F.col(order or "mutant_id").alias("at"), F.col("recommendation").alias("text"))
    listed = F.transform(F.sort_array(F.collect_list(F.when((F.col("verdict") == "SURVIVED") & (F.coalesce("recommendation", F.lit("")) != ""), advice))), lambda a: a["text"])
    sums = results.groupBy(key).agg(F.count("*").alias("total"), many("KILLED").alias("killed"), many("SURVIVED").alias("survived"), many("SKIPPED").alias("skipped"), listed.alias("recommendations"))
    score = F.coalesce(F.try_divide(F.col("killed"), F.col("killed") + F.col("survived")), F.lit(0.0))
    return sums.select(key, "total", "killed", "survived", "skipped", score.alias("score"), verdicts.mutation(score).alias("verdict"), "recommendations")


def calibrate(prompts: DataFrame, cases: DataFrame, suite: str, key: str, prompt: str, f: Callable[[str, list[dict]], float], order: str | None = None, delta: float = DELTA, runs: int = 1, at_once: int = 1) -> DataFrame:
    """(key, calibration_score, total, caught, missed, warnings): whether a suite notices mutants of known severity.

    A mutant like its prompt doesn't apply; one that can't be evaluated is a warning and doesn't count; a prompt that can't gives an error in every case's warning."""
    from gaugeloom.operators import gates, mutation

    places = F.create_map(*[x for i, (kind, *_) in enumerate(mutation.CALIBRATION) for x in (F.lit(kind), F.lit(i))])
    told = {c: F.create_map(*[x for case in mutation.CALIBRATION for x in (F.lit(case[0]), F.lit(case[i]))]) for i, c in ((1, "severity"), (2, "description"), (3, "recommendation"))}
    each = prompts.select(suite, key, prompt, F.inline(mutation.calibration_mutants(F.col(prompt)))).withColumnRenamed("text", "_mutant")
    scored = evaluate(prompts.select(suite, key, prompt), cases, suite, prompt, f, order, runs, at_once, "original_score").select(key, "original_score", F.col("error").alias("_original_error"))
    found = evaluate(each, cases, suite, "_mutant", f, order, runs, at_once, "mutant_score").join(scored, key)
    rows = found.withColumns({c: F.element_at(m, F.col("kind")) for c, m in told.items()} | {"place": F.element_at(places, F.col("kind")), "error": F.coalesce("_original_error", "error")})
    return gates.calibration(rows, [key], "original_score", "mutant_score", F.col("_mutant") != F.col(prompt), "severity", "recommendation", delta, order="place", error="error", description="description")


def best_of(df: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """Of each key's evaluated prompts the one with the best score; those with an error don't count."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), order))
    return df.where("error IS NULL").withColumn("_rank", rank).where("_rank = 1").drop("_rank")
