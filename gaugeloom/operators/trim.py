"""Token budgets: which messages or paragraphs stay.

System messages always stay.  A message costs its text's and role's tokens and an overhead.  Greedy packings that skip what
does not fit are folds over one conversation's messages in order, so they stay within its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.functions import text as X

RESERVED = 512
# fixed values: words that raise a paragraph's weight
KEYWORDS = r"(?i)\b(result|conclusion|therefore|however|important|key|critical|summary|finally|in conclusion)\b"


def costs(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """messages with tokens, is_system, index, total, importance, system_tokens."""
    w = Window.partitionBy(conv)
    index = F.row_number().over(w.orderBy(turn)) - 1
    rows = messages.withColumns({"tokens": X.message_tokens(F.col(role), F.col(text)), "is_system": F.lower(role) == "system", "index": index, "total": F.count("*").over(w)})
    return rows.withColumns({"importance": X.importance(F.col(role), F.col(text), F.col("index"), F.col("total")), "system_tokens": F.coalesce(F.sum(F.when(F.col("is_system"), F.col("tokens"))).over(w), F.lit(0))})


def keep_recent(rows: DataFrame, conv: str, most: int, reserved: int = RESERVED) -> DataFrame:
    """rows of costs() with kept: the newest messages that fit, all of them or none beyond the first that doesn't."""
    running = F.sum(F.when(~F.col("is_system"), F.col("tokens")).otherwise(0)).over(Window.partitionBy(conv).orderBy(F.desc("index")))
    return rows.withColumn("kept", F.col("is_system") | (running + F.col("system_tokens") <= most - reserved))


def keep_important(rows: DataFrame, conv: str, most: int, reserved: int = RESERVED) -> DataFrame:
    """kept: the most important messages; the least important go first until the rest fits."""
    order = Window.partitionBy(conv).orderBy(F.desc("is_system"), F.desc("importance"), F.desc("index"))
    running = F.sum(F.when(~F.col("is_system"), F.col("tokens")).otherwise(0)).over(order)
    return rows.withColumn("kept", F.col("is_system") | (running + F.col("system_tokens") <= most - reserved))


def greedy(items: Column, space: Column) -> Column:
    """The indexes of those of items, an array of (.., index, cost) in order, that fit one after another."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept"))
    step = lambda z, e: F.when(z["used"] + e["cost"] <= space, F.struct((z["used"] + e["cost"]).alias("used"), F.concat(z["kept"], F.array(e["index"])).alias("kept"))).otherwise(z)
    return F.aggregate(items, start, step, lambda z: z["kept"])


def keep_hybrid(rows: DataFrame, conv: str, most: int, reserved: int = RESERVED) -> DataFrame:
    """kept: by importance, newest first among equals; what doesn't fit is passed over."""
    item = F.struct((-F.col("importance")).alias("a"), (-F.col("index")).alias("b"), F.col("index").cast("int").alias("index"), F.col("tokens").alias("cost"))
    picked = rows.groupBy(conv).agg(F.array_sort(F.collect_list(F.when(~F.col("is_system"), item))).alias("items"), F.max("system_tokens").alias("_system"))
    kept = picked.select(F.col(conv).alias("_conv"), greedy(F.col("items"), F.lit(most - reserved) - F.col("_system")).alias("_kept"))
    return rows.join(kept, F.col(conv).eqNullSafe(F.col("_conv"))).withColumn("kept", F.col("is_system") | F.array_contains("_kept", F.col("index").cast("int"))).drop("_conv", "_kept")


SUMMARY_ROLE_TOKENS = 6
# fixed values: lengths of snippets, most bullets of a forced summary, and what it sets aside
SNIPPET, SHORT_SNIPPET, BULLETS, FORCED_OVERHEAD = 120, 60, 20, 8


def keep_summary(rows: DataFrame, conv: str, role: str, text: str, most: int, reserved: int = RESERVED) -> DataFrame:
    """(conv, n_dropped, summary): how many of the oldest messages a summary stands for, as few as let the rest fit.

    The summary has a line for each, its first sentence.  If no number fits, all go, and the summary has as many short lines of the latest as
    fit, or one line without them; it is null if even the system messages leave no room.
    """
    space = most - reserved
    order = Window.partitionBy(conv).orderBy("index")
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\r\n"))
    who = F.concat(F.lit("• "), F.upper(F.left(F.col(role), F.lit(1))), F.lower(F.substring(F.col(role), 2, 1 << 20)), F.lit(": "))
    first = F.left(F.get(F.split(body, r"(?<=[.!?])\s", 2), F.lit(0)), F.lit(SNIPPET))
    own = rows.where(~F.col("is_system")).withColumns({"_line": F.when(first != "", F.concat(who, first)), "_short": F.concat(who, F.left(body, F.lit(SHORT_SNIPPET)))})
    own = own.withColumns({"_j": F.row_number().over(order), "_gone": F.sum("tokens").over(order), "_chars": F.coalesce(F.sum(F.char_length("_line")).over(order), F.lit(0)), "_lines": F.count("_line").over(order), "_rest": F.sum("tokens").over(Window.partitionBy(conv))})
    header = lambda n: F.concat(F.lit("[Context summary — "), n.cast("string"), F.lit(" earlier messages]\n"))
    length = F.char_length(header(F.col("_j"))) + F.when(F.col("_lines") > 0, F.col("_chars") + F.col("_lines") - 1).otherwise(F.char_length(F.lit("• (no content)")))
    fits = F.col("system_tokens") + F.col("_rest") - F.col("_gone") + F.floor((length + 3) / 4) + SUMMARY_ROLE_TOKENS <= space
    per = own.groupBy(conv).agg(F.min(F.when(fits, F.col("_j"))).alias("_d"), F.first("_rest").alias("_rest"), F.first("system_tokens").alias("_system"), F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("_j", "_line", "_short"))).alias("_all"))
    whole = F.col("_system") + F.col("_rest") <= space
    lines = F.array_join(F.transform(F.filter("_all", lambda x: x["_j"] <= F.col("_d")), lambda x: x["_line"]), "\n")
    summary = F.concat(header(F.col("_d")), F.when(lines == "", F.lit("• (no content)")).otherwise(lines))
    room = F.lit(space - FORCED_OVERHEAD) - F.col("_system")
    forced = F.transform(F.sequence(F.least(F.col("_n"), F.lit(BULLETS)).cast("int"), F.lit(1)), lambda k: F.concat(F.lit("[Summary: "), F.col("_n").cast("string"), F.lit(" msgs]\n"), F.array_join(F.transform(F.slice("_all", -k, k), lambda x: x["_short"]), "\n")))
    fitting = F.get(F.filter(forced, lambda t: X.estimate_tokens(t) <= room), F.lit(0))
    bare = F.concat(F.lit("[Summary: "), F.col("_n").cast("string"), F.lit(" earlier messages omitted to fit token budget]"))
    made = per.select(F.col(conv).alias("_conv"), F.when(whole, 0).otherwise(F.coalesce("_d", "_n")).cast("bigint").alias("n_dropped"), F.when(whole, None).when(F.col("_d").isNotNull(), summary).when(room > 0, F.coalesce(fitting, bare)).alias("summary"))
    every = rows.select(conv).distinct()
    return every.join(made, F.col(conv).eqNullSafe(F.col("_conv")), "left").select(conv, F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"), "summary")


STRATEGIES = {"recency": keep_recent, "sliding": keep_recent, "importance": keep_important, "hybrid": keep_hybrid}
DEFAULT = "hybrid"


def trim(messages: DataFrame, conv: str, turn: str, role: str, text: str, most: int, strategy: str = DEFAULT, reserved: int = RESERVED) -> DataFrame:
    """messages that fit into each conversation's budget, by one of STRATEGIES or `summary`, in which a system message, before the first that stays, stands for those that went.

    The summary's message has the turn of the first message that it stands for; columns other than the four are null in it."""
    rows = costs(messages, conv, turn, role, text)
    if strategy in STRATEGIES:
        return STRATEGIES[strategy](rows, conv, most, reserved).where("kept").select(*messages.columns)
    if strategy != "summary":
        raise ValueError(f"no such strategy: {strategy}")
    gone = keep_summary(rows, conv, role, text, most, reserved).withColumnRenamed(conv, "_conv")
    place = F.row_number().over(Window.partitionBy(conv).orderBy(F.col("is_system"), "index"))
    both = rows.withColumn("_place", F.when(~F.col("is_system"), place)).join(gone, F.col(conv).eqNullSafe(F.col("_conv")))
    kept = both.where(F.col("is_system") | (F.col("_place") > F.col("n_dropped"))).select(*messages.columns)
    made = {conv: F.col(conv), turn: F.col("_turn"), role: F.lit("system"), text: F.col("summary")}
    first = both.where("summary IS NOT NULL AND NOT is_system").groupBy(conv).agg(F.min(turn).alias("_turn"), F.first("summary").alias("summary"))
    return kept.unionByName(first.select(*[made.get(c, F.lit(None)).cast(messages.schema[c].dataType).alias(c) for c in messages.columns]))


def budget(messages: DataFrame, conv: str, role: str, text: str, most: int, reserved: int = RESERVED) -> DataFrame:
    """(conv, tokens, tokens_over, fits): what each conversation's messages come to."""
    sums = messages.groupBy(conv).agg(F.sum(X.message_tokens(F.col(role), F.col(text))).cast("bigint").alias("tokens"))
    return sums.withColumns({"tokens_over": F.greatest(F.lit(0).cast("bigint"), F.col("tokens") - (most - reserved)), "fits": F.col("tokens") <= most - reserved})


def stats(rows: DataFrame, conv: str, most: int, reserved: int = RESERVED) -> DataFrame:
    """One row per conversation: messages and tokens before and after, share of tokens that went, whether it fits."""
    sums = rows.groupBy(conv).agg(F.count("*").alias("n_before"), F.sum("tokens").cast("bigint").alias("tokens_before"), F.count_if("kept").alias("n_after"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("tokens"))), F.lit(0)).cast("bigint").alias("tokens_after"))
    return sums.withColumns({"trim_ratio": 1 - F.col("tokens_after") / F.col("tokens_before"), "fits": F.col("tokens_after") <= most - reserved, "tokens_over": F.greatest(F.lit(0).cast("bigint"), F.col("tokens_before") - (most - reserved))})


def paragraphs(text: Column, separator: str = r"\n{2,}") -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")


def _fold(order: Column, space: int, stop: bool) -> Column:
    """Greedy by characters: (index, length) in order; joined paragraphs have two characters between them.  What is kept, and so what a
    step may copy, is bounded by the space, not by how many paragraphs there are: each takes three characters at least."""
    start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("going"), F.array().cast("array<int>").alias("kept"))
    more = lambda z, e: z["used"] + e["length"] + F.when(F.size(z["kept"]) > 0, 2).otherwise(0)
    fits = lambda z, e: z["going"] & (F.floor((more(z, e) + 3) / 4) <= space)
    step = lambda z, e: F.when(fits(z, e), F.struct(more(z, e).alias("used"), F.lit(True).alias("going"), F.concat(z["kept"], F.array(e["index"])).alias("kept"))).otherwise(F.struct(z["used"].alias("used"), (z["going"] & F.lit(not stop)).alias("going"), z["kept"].alias("kept")))
    return F.aggregate(order, start, step, lambda z: F.array_sort(z["kept"]))


def trim_documents(docs: DataFrame, text: str, strategy: str, available: int, separator: str = r"\n{2,}", keywords: str = KEYWORDS, out: str = "trimmed") -> DataFrame:
    """docs with the text cut to `available` tokens: the last paragraphs (tail), those with most keywords (important), both weighed (hybrid), or
    the beginning and a marker (summary).  A text that fits stays; if no paragraph fits, the last one is cut."""
    paras = F.when(F.size(paragraphs(F.col(text), separator)) > 0, paragraphs(F.col(text), separator)).otherwise(F.array(F.col(text)))
    marker = "\n\n[... content trimmed to fit token budget ...]"
    rows = docs.withColumn("_p", paras)
    density = lambda p: F.size(F.regexp_extract_all(p, F.lit(keywords), 0)) / F.greatest(F.size(F.filter(F.split(p, r"\s+"), lambda x: x != "")), F.lit(1))
    n = F.size("_p")
    weight = {
        "tail": lambda p, i: -i.cast("double"),
        "important": lambda p, i: -density(p),
        "hybrid": lambda p, i: -((i + 1) / n * 0.5 + F.least(density(p) * 5, F.lit(1.0)) * 0.5),
    }.get(strategy)
    if weight is None:
        cut = F.concat(F.left(F.col(text), F.lit(max(0, (available - -(-len(marker) // 4)) * 4))), F.lit(marker))
    else:
        items = F.array_sort(F.transform("_p", lambda p, i: F.struct(weight(p, i).alias("w"), i.alias("index"), F.char_length(p).alias("length"))))
        kept = _fold(items, available, strategy == "tail")
        rows = rows.withColumn("_kept", kept)
        cut = F.when(F.size("_kept") > 0, F.array_join(F.transform("_kept", lambda i: F.get("_p", i)), "\n\n")).otherwise(F.left(F.element_at("_p", -1), F.lit(available * 4)))
    whole = X.estimate_tokens(F.col(text)) <= available
    return rows.withColumn(out, F.when(whole, F.col(text)).otherwise(cut)).withColumn("truncated", ~whole).drop("_p", "_kept")
