"""Parsing of model output and of changes: JSON, reasoning steps, intents, diffs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: words by which a clause's intent is known, in the order in which they are tried
INTENTS = [
    ("adds", r"(?i)(\badd(s|ing|ed)?\b|\bintroduc(e|es|ing|ed)\b|\bcreate(s|d)?\b|\bimplement(s|ed|ing)?\b)"),
    ("removes", r"(?i)(\bremov(e|es|ing|ed)\b|\bdelet(e|es|ing|ed)\b|\bdrop(s|ped|ping)?\b)"),
    ("modifies", r"(?i)(\bupdat(e|es|ing|ed)\b|\bmodif(y|ies|ied|ying)\b|\brefactor(s|ed|ing)?\b|\bimprove(s|d)?\b)"),
    ("fixes", r"(?i)(\bfix(es|ed|ing)?\b|\bresolv(e|es|ing|ed)\b|\bpatch(es|ed)?\b|\bcorrect(s|ed)?\b)"),
    ("ensures", r"(?i)(\bensur(e|es|ing|ed)\b|\bguarantee(s|d)?\b|\bvalidat(e|es|ing|ed)\b)"),
    ("does_not", r"(?i)(\bdoes not\b|\bshould not\b|\bwon['`]?t\b|\bnever\b)"),
]
# fixed values: words that begin a reasoning step
CONNECTORS = r"(?i)(?:^|\. |\n)(?=(?:First|Second|Third|Fourth|Next|Then|After that|Therefore|Thus|Finally|However|But|Additionally|Furthermore|Also|Moreover)\b)"
NUMBERED = r"\n\s*(?:\d+[.)]\s*|Step\s+\d+[:.—\s])"
_SPACE = " \t\r\n"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE))


def strip_fence(text: Column) -> Column:
    """The text without a code fence around it."""
    return F.regexp_replace(F.regexp_replace(_trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def extract_json(text: Column) -> Column:
    """The first that parses of: what a fenced block holds, the outermost braces, the outermost brackets; else null."""
    valid = lambda c: F.when((c != "") & F.try_parse_json(c).isNotNull(), c)
    fenced = _trim(F.regexp_extract(text, r"```(?:json)?\s*\n?([\s\S]*?)\n?```", 1))
    return F.coalesce(valid(fenced), *[valid(F.regexp_extract(text, p, 0)) for p in (r"\{[\s\S]*\}", r"\[[\s\S]*\]")])


def schema_score(value: Column, schema: dict) -> Column:
    """How far a variant fits a JSON schema known to the driver, 0 to 1: types, required, properties, items, minItems.

    The schema is turned into nested expressions, once for each of its parts.
    """
    kind = F.schema_of_variant(value)
    of = {"object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "integer": (kind == "BIGINT") | (kind == "BOOLEAN"), "number": kind.isin("BIGINT", "DOUBLE", "BOOLEAN") | kind.startswith("DECIMAL"), "boolean": kind == "BOOLEAN", "null": kind == "VOID"}
    wanted = schema.get("type")
    fits = of.get(wanted, F.lit(True))
    score = F.lit(1.0)
    if wanted == "object":
        at = lambda name: F.try_variant_get(value, f"$['{name}']", "variant")
        props = [(at(name), schema_score(at(name), part)) for name, part in schema.get("properties", {}).items()]
        if props:
            total = sum((F.when(v.isNotNull(), s).otherwise(0.0) for v, s in props[1:]), F.when(props[0][0].isNotNull(), props[0][1]).otherwise(0.0))
            n = sum((v.isNotNull().cast("int") for v, _ in props[1:]), props[0][0].isNotNull().cast("int"))
            score = F.when(n > 0, total / n).otherwise(1.0)
        for name in reversed(schema.get("required", [])):
            score = F.when(at(name).isNull(), 0.5).otherwise(score)
    elif wanted == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        n = F.size(items)
        if "minItems" in schema:
            score = F.when(n < schema["minItems"], 0.5).otherwise(score)
        if schema.get("items"):
            each = F.aggregate(items, F.lit(0.0), lambda s, x: s + schema_score(x, schema["items"]))
            score = F.when(n > 0, each / n).otherwise(score)
    return F.when(fits, score).otherwise(0.0)


def structured_output(text: Column, schema: dict | str | None = None) -> Column:
    """0 without JSON, 1 without a schema, else the schema's score."""
    found = extract_json(text)
    if schema is None:
        return F.when(found.isNotNull(), 1.0).otherwise(0.0)
    schema = json.loads(schema) if isinstance(schema, str) else schema
    return F.when(found.isNull(), 0.0).otherwise(schema_score(F.try_parse_json(found), schema) if schema else F.lit(1.0))


def reasoning_steps(text: Column) -> Column:
    """Array of (index, text): by numbered lines, else blank lines, else connecting words, else the whole."""
    raw = _trim(text)
    split = lambda p: F.transform(F.split(raw, p), lambda s, i: F.struct(i.alias("index"), _trim(s).alias("text")))
    long = lambda xs: F.filter(xs, lambda s: F.char_length(s["text"]) > 5)
    blank = F.transform(F.filter(F.transform(F.split(raw, r"\n\n+"), _trim), lambda s: s != ""), lambda s, i: F.struct(i.alias("index"), s.alias("text")))
    pieces = F.split(raw, CONNECTORS)  # a connecting word at the very beginning has an empty piece before it, which counts
    by_words = F.when(raw.rlike(CONNECTORS.replace(r"(?:^|\. |\n)", "^")), F.concat(F.array(F.lit("")), pieces)).otherwise(pieces)
    return F.when(F.size(split(NUMBERED)) > 1, long(split(NUMBERED))).when(F.size(blank) > 1, blank).when(F.size(by_words) > 1, long(F.transform(by_words, lambda s, i: F.struct(i.alias("index"), _trim(s).alias("text"))))).otherwise(F.array(F.struct(F.lit(0).alias("index"), raw.alias("text"))))


def clause_type(clause: Column) -> Column:
    out = F.lit("modifies")
    for name, p in reversed(INTENTS):
        out = F.when(clause.rlike(p), name).otherwise(out)
    return out


# fixed value: what a clause is about
SUBJECT = r"(?i)(?:the |a |an )?([A-Za-z_][A-Za-z0-9_ ]{2,40}?)(?:\s+(?:function|method|class|module|endpoint|route|field|parameter|type|check|validation|test|feature))?(?:\s|$)"


def clause_subject(clause: Column) -> Column:
    """The first words that the pattern takes for a subject, else the clause's first 40 characters."""
    found = F.regexp_extract(clause, SUBJECT, 1)
    return F.when(clause.rlike(SUBJECT), _trim(found)).otherwise(F.left(clause, F.lit(40)))


def intent_clauses(text: Column, least: int = 8, most: int = 12) -> Column:
    """Array of the first clauses: (text, type, subject)."""
    cut = F.filter(F.transform(F.split(text, r"[.!?\n]|(?:^|\n)\s*[-*•]\s*"), _trim), lambda s: F.char_length(s) >= least)
    return F.slice(F.transform(cut, lambda s: F.struct(s.alias("text"), clause_type(s).alias("type"), clause_subject(s).alias("subject"))), 1, most)


def diff_lines(df: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, line, text, file, hunk): the lines of unified diffs with the file and the running number of the hunk they are in.
    A deleted file's hunks are its own: the name before is used where the new one is /dev/null."""
    lines = df.select(key, F.posexplode(F.split(diff, r"\r?\n")).alias("line", "text"))
    w = Window.partitionBy(key).orderBy("line")
    name = F.when(F.startswith("text", F.lit("+++ b/")), F.expr("substring(text, 7)")).when(F.startswith("text", F.lit("--- a/")), F.expr("substring(text, 7)"))
    header = F.col("text").rlike(r"^@@ .*-\d+(,\d+)? \+\d+(,\d+)?")
    return lines.withColumns({"file": F.last(name, ignorenulls=True).over(w), "hunk": F.sum(header.cast("int")).over(w)})


def _signs() -> tuple[Column, Column]:
    added = F.startswith("text", F.lit("+")) & ~F.startswith("text", F.lit("+++"))
    removed = F.startswith("text", F.lit("-")) & ~F.startswith("text", F.lit("---"))
    return added, removed


def hunks(df: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, hunk, file, added, removed, pure_addition, pure_removal)"""
    added, removed = _signs()
    header = F.col("text").rlike(r"^@@ ")
    out = diff_lines(df, key, diff).where("hunk > 0").groupBy(key, "hunk").agg(F.min_by("file", "line").alias("file"), F.count_if(added & ~header).alias("added"), F.count_if(removed & ~header).alias("removed"))
    return out.withColumns({"pure_addition": (F.col("added") > 0) & (F.col("removed") == 0), "pure_removal": (F.col("removed") > 0) & (F.col("added") == 0)})


def hunk_summaries(df: DataFrame, key: str, diff: str, most: int = 20) -> DataFrame:
    """(key, hunk, file, summary): the file, then the first `most` removed lines, then the first `most` added ones."""
    added, removed = _signs()
    header = F.col("text").rlike(r"^@@ ")
    kind = F.when(added & ~header, "+").when(removed & ~header, "-")
    lines = diff_lines(df, key, diff).where("hunk > 0").withColumn("kind", kind)
    place = F.row_number().over(Window.partitionBy(key, "hunk", "kind").orderBy("line"))
    few = lines.withColumn("kept", F.when(F.col("kind").isNotNull() & (place <= most), F.struct("line", F.concat("kind", F.lit(" "), F.expr("substring(text, 2)")).alias("text"))))
    of = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("kept")))), lambda x: x["text"]), "\n")
    out = few.groupBy(key, "hunk").agg(F.min_by("file", "line").alias("file"), of("-").alias("_removed"), of("+").alias("_added"))
    return out.select(key, "hunk", "file", _trim(F.concat(F.lit("File: "), "file", F.lit("\n"), "_removed", F.lit("\n"), "_added")).alias("summary"))


def diff_stats(df: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, files, added, removed), files sorted and joined by commas."""
    added, removed = _signs()
    lines = df.select(key, F.explode(F.split(diff, r"\r?\n")).alias("text"))
    name = F.when(F.startswith("text", F.lit("+++ b/")), F.expr("substring(text, 7)"))
    return lines.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("files"), F.count_if(added).alias("added"), F.count_if(removed).alias("removed"))
