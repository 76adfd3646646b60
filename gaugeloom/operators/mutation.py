"""Mutants of prompts: clauses removed, scopes changed, phrases swapped."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# fixed values: beginnings of clauses, by operator, in the order in which they are tried
PROHIBIT = ["[Nn]ever", "[Dd]o not", "[Dd]on't", "[Aa]void", "[Yy]ou must not", "[Yy]ou should not", "[Rr]efuse"]
REQUIRE = ["[Aa]lways", "[Yy]ou must", "[Yy]ou should", "[Mm]ake sure", "[Ee]nsure", "[Rr]espond"]
CONDITION = [r"(?m)^[ \t]*[Ii]f\s+.+,\s*.+[.!]?\s*$", r"(?m)^[ \t]*[Ww]hen\s+.+,\s*.+[.!]?\s*$"]
# fixed values: scopes and what they become
EXPAND = [
    (r"\b(software\s+(?:products?\s+)?only)\b", "products and services"),
    (r"\b(in English only)\b", "in any language"),
    (r"\b(formal English)\b", "casual language"),
    (r"\b(English)\b(?=\s+only|\s+language)", "the user's preferred language"),
    (r"\b(topics? related to \w+)\b", "any relevant topic"),
    (r"\b(company products?)\b(?=\s+only)", "all available products"),
    (r"\b(technical questions?)\b(?=\s+only|\s+and)", "all questions"),
]
NARROW = [
    (r"\b(any (?:topic|question|subject|issue)s?)\b", "general topics only"),
    (r"\b(all (?:topic|question|subject)s?)\b", "common topics only"),
    (r"\b(anything)\b(?=\s+(?:the user|they|you))", "straightforward requests"),
    (r"\b(broadly)\b", "narrowly"),
]
# fixed values: phrases and what they are swapped for
SWAPS = [("concise", "comprehensive"), ("comprehensive", "concise"), ("formal", "casual"), ("casual", "formal"), ("brief", "detailed"), ("detailed", "brief"), ("professional", "informal"), ("polite", "direct"), ("friendly", "clinical"), ("structured", "free-form")]

_SPACE = " \t\r\n"


def _clauses(starts: list[str]) -> list[str]:
    return [rf"(?m)^[ \t]*{s}\s+.+[.!]?\s*$" for s in starts]


_KIND = "array<struct<operator:string,order:int,mutated:string,removed:string,put:string>>"


#: All operators in their order: patterns whose matches are removed one at a time, and those whose first match is replaced.
REMOVED = [
    *[("NegateConstraint", 100 + i, p) for i, p in enumerate(_clauses(PROHIBIT))],
    *[("DropClause", 200 + i, p) for i, p in enumerate(_clauses(REQUIRE))],
    *[("ConditionInvert", 500 + i, p) for i, p in enumerate(CONDITION)],
]
REPLACED = [
    *[("ScopeExpand", 300 + i, f"(?i){p}", r) for i, (p, r) in enumerate(EXPAND)],
    *[("ScopeNarrow", 400 + i, f"(?i){p}", r) for i, (p, r) in enumerate(NARROW)],
    *[("PhraseSwap", 600 + i, rf"(?i)\b{old}\b", new) for i, (old, new) in enumerate(SWAPS)],
]


def _struct(operator: str, order: Column, mutated: Column, removed: Column, put: Column | None = None) -> Column:
    return F.struct(F.lit(operator).alias("operator"), order.alias("order"), mutated.alias("mutated"), removed.alias("removed"), (F.lit(None).cast("string") if put is None else put).alias("put"))


#: Characters that no text interchanges, around what a pattern matches.
_OPEN, _SHUT = "\uFDD0", "\uFDD1"


def _without(text: Column, pattern: str, operator: str, order: int) -> Column:
    """For each match of the pattern, the text without it."""
    plain = F.translate(text, _OPEN + _SHUT, "")
    parts = F.split(F.regexp_replace(plain, pattern, f"{_OPEN}$0{_SHUT}"), _OPEN)
    unmarked = lambda xs: F.translate(F.array_join(xs, ""), _SHUT, "")
    clean = lambda t: F.btrim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(_SPACE))

    def mutant(i: Column) -> Column:
        own = F.split(F.get(parts, i), _SHUT)
        rest = F.concat(F.array(F.get(own, F.lit(1))), F.slice(parts, i + 2, F.size(parts)))
        return _struct(operator, F.lit(order * 1000) + i, clean(F.concat(unmarked(F.slice(parts, F.lit(1), i)), unmarked(rest))), F.btrim(F.get(own, F.lit(0)), F.lit(_SPACE)))

    none = F.array().cast(_KIND)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), mutant)).otherwise(none)


def _replaced(text: Column, pattern: str, new: Column, operator: str, order: int) -> Column:
    """The text with the pattern's first match replaced, if there is one."""
    m = F.regexp_extract(text, pattern, 0)
    at = F.regexp_instr(text, F.lit(pattern))
    mutated = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.char_length(m), F.char_length(text)))
    return F.when(at > 0, F.array(_struct(operator, F.lit(order * 1000), mutated, m, new))).otherwise(F.array().cast(_KIND))


def _swap(text: Column, old: str, new: str, order: int) -> Column:
    pattern = rf"(?i)\b{old}\b"
    upper = F.regexp_extract(text, pattern, 0).rlike("^[A-Z]")
    return _replaced(text, pattern, F.when(upper, F.lit(new[0].upper() + new[1:])).otherwise(F.lit(new)), "PhraseSwap", order)


# fixed values: what a test suite should have to kill a mutant, by operator; %s is what was removed, of a clause without its beginning
ADVICE = {
    "NegateConstraint": "Add test case where user attempts to: %s. Expected: LLM refuses/redirects.",
    "DropClause": "Add test case verifying the LLM does: %s. Expected: behavior present in every response.",
    "ScopeExpand": 'Test a request that would be rejected by the original scope restriction "%s" — verify the LLM still enforces scope.',
    "ScopeNarrow": 'Test a broad question that the original "%s" permission would have allowed — verify no over-refusal.',
    "ConditionInvert": 'Test the condition trigger described in "%s" — verify the conditional behavior is present.',
    "PhraseSwap": 'Test that the LLM output style matches "%1$s" (not the mutated "%2$s") — verify style constraint is enforced.',
}
CLAUSE_STARTS = {"NegateConstraint": r"(?i)^(never|do not|don't|avoid|you must not|you should not|refuse)\s+", "DropClause": r"(?i)^(always|you must|you should|make sure|ensure|respond)\s+"}


def recommendation(operator: Column, removed: Column, put: Column) -> Column:
    """What a test suite should have to kill the mutant; put: the phrase swapped in."""
    out = F.lit(None).cast("string")
    for name, text in ADVICE.items():
        said = F.btrim(F.rtrim(F.regexp_replace(removed, CLAUSE_STARTS[name], ""), F.lit(".!")), F.lit(_SPACE)) if name in CLAUSE_STARTS else removed
        out = F.when(operator == name, F.format_string(text, said, put)).otherwise(out)
    return out


def _once(rows: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """Each prompt's mutants that differ from it, each text once, the first `most`."""
    changed = rows.withColumn("_trimmed", F.btrim("mutated", F.lit(_SPACE))).where(F.col("_trimmed") != F.btrim(text, F.lit(_SPACE)))
    once = changed.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_trimmed").orderBy("order"))).where("_n = 1")
    few = once.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("order"))).where(F.col("_n") <= most)
    return few.select(key, F.left(F.sha1(F.concat_ws("|", "operator", "mutated")), F.lit(8)).alias("mutant_id"), "operator", "mutated", "removed", recommendation(F.col("operator"), F.col("removed"), F.col("put")).alias("recommendation"))


@udtf(returnType="operator string, order int, mutated string, removed string, put string")
class Mutants:
    """The mutants of one text, a row each, by the places of the patterns' matches: for use with LATERAL."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is None:
            return
        clean = lambda t: re.sub(r"\n{3,}", "\n\n", t).strip(_SPACE)
        for operator, order, pattern in REMOVED:
            for i, m in enumerate(re.finditer(pattern, text, re.ASCII), 1):
                yield operator, order * 1000 + i, clean(text[: m.start()] + text[m.end() :]), m.group(0).strip(_SPACE), None
        for operator, order, pattern, new in REPLACED:
            if m := re.search(pattern, text, re.ASCII):
                put = new[0].upper() + new[1:] if operator == "PhraseSwap" and "A" <= m.group(0)[0] <= "Z" else new
                yield operator, order * 1000, text[: m.start()] + put + text[m.end() :], m.group(0), put


def generate(prompts: DataFrame, key: str, text: str, most: int = 20) -> DataFrame:
    """(key, mutant_id, operator, mutated, removed, recommendation): each prompt's mutants in the order of the operators, each text once,
    `most` of them at most."""
    rows = prompts.select(key, F.col(text).alias("_text"))
    return _once(rows.lateralJoin(Mutants(F.col("_text").outer())), key, "_text", most)


def generate_by_columns(prompts: DataFrame, key: str, text: str, most: int = 20) -> DataFrame:
    """The same in columns alone, without Python; texts lose the characters U+FDD0 and U+FDD1, by which matches are marked."""
    t = F.col(text)
    parts = [_without(t, p, o, i) for o, i, p in REMOVED]
    parts += [_swap(t, a, b, 600 + i) for i, (a, b) in enumerate(SWAPS)]
    parts += [_replaced(t, p, F.lit(r), o, i) for o, i, p, r in REPLACED if o != "PhraseSwap"]
    return _once(prompts.select(key, t.alias("_text"), F.inline(F.concat(*parts))), key, "_text", most)


def phrase_swap(text: Column, old: str, new: str) -> Column:
    """The text with the first such word swapped, a capital kept; null if it isn't there."""
    return F.get(_swap(text, old, new, 0), F.lit(0))["mutated"]


# fixed values: mutants that a suite should notice: kind, severity, description, advice; and the clauses that two of them strip
CALIBRATION = [
    ("generic", "HIGH", "Complete system prompt removal (all instructions stripped)", "Your eval suite cannot detect complete prompt removal. Add a test case that would fail on a blank/generic assistant."),
    ("no_prohibitions", "HIGH", "All prohibitive clauses removed (all 'Never' / 'Do not' lines)", "Your eval suite misses prohibition removal. Add test cases that verify prohibited behaviors are actually refused."),
    ("no_requirements", "MEDIUM", "All requirement clauses removed (all 'Always' / 'You must' lines)", "Your eval suite misses requirement removal. Add test cases verifying each required behavior appears in responses."),
    ("no_first_line", "MEDIUM", "Role/persona instruction removed (first line of prompt)", "Your eval suite misses persona loss. Add a test case verifying the LLM adopts the specified role."),
    ("no_last_line", "LOW", "Single instruction clause dropped (last instruction line)", "Your eval suite misses single-clause removal. Each important instruction should have at least one dedicated test case."),
]
GENERIC = "You are a helpful assistant."
STRIPPED = {"no_prohibitions": "[Nn]ever|[Dd]o not|[Dd]on't|[Aa]void", "no_requirements": "[Aa]lways|[Yy]ou must|[Yy]ou should|[Mm]ake sure|[Ee]nsure"}


def calibration_mutants(text: Column) -> Column:
    """Array of (kind, text), in CALIBRATION's order.  A mutant that would be empty, or the first line of a text of one, is the text itself."""
    trimmed = lambda t: F.btrim(t, F.lit(_SPACE))
    or_text = lambda t: F.when(t == "", text).otherwise(t)
    strip = lambda starts: or_text(trimmed(F.regexp_replace(F.regexp_replace(text, rf"(?m)^[ \t]*(?:{starts})\s+.+[.!]?\s*$", ""), r"\n{3,}", "\n\n")))
    lines = F.split(trimmed(text), "\n")
    but_first = F.when(F.size(lines) <= 1, text).otherwise(trimmed(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n")))
    but_last = or_text(trimmed(F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), "\n")))  # the last line of a trimmed text isn't blank
    made = {"generic": F.lit(GENERIC), **{k: strip(s) for k, s in STRIPPED.items()}, "no_first_line": but_first, "no_last_line": but_last}
    return F.array(*[F.struct(F.lit(kind).alias("kind"), made[kind].alias("text")) for kind, *_ in CALIBRATION])


def content_blocks(content: Column) -> Column:
    """The texts of a message's content: itself, or, of a JSON list of blocks, those of its text blocks."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    listed = F.startswith(F.ltrim(content), F.lit("[{")) & F.try_parse_json(content).isNotNull()
    return F.when(listed, F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])).otherwise(F.array(content))


def flatten_messages(messages: Column) -> Column:
    """A prompt of an array of (role, content): `[ROLE] text` for each text of a content, a blank line between."""
    of = lambda m: F.transform(content_blocks(m["content"]), lambda t: F.concat(F.lit("["), F.upper(m["role"]), F.lit("] "), t))
    return F.array_join(F.flatten(F.transform(messages, of)), "\n\n")
