"""Column functions over texts: tokens, similarities, token estimates, fingerprints.

All are built of Spark functions, so they stay within the JVM.  Empty texts have no tokens.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"
WORD_APOSTROPHE = "[a-z0-9']+"
UNICODE_WORD = r"[\p{L}\p{N}_]+"
CHARS_PER_TOKEN = 4
MESSAGE_OVERHEAD = 4
LN2_SQUARED, LN3_SQUARED = math.log(2) ** 2, math.log(3) ** 2


def tokens(text: Column, pattern: str = WORD) -> Column:
    """The lower-cased text's tokens, in order.  Null gives no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), 0)


def token_set(text: Column, pattern: str = UNICODE_WORD) -> Column:
    return F.array_distinct(tokens(text, pattern))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays: 1 if both are empty, 0 if one is."""
    met, total = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(total == 0, F.lit(1.0)).otherwise(met / total)


def recall(wanted: Column, given: Column) -> Column:
    """The share of the wanted tokens that are given; 1 if none are wanted.  Both are worked out once."""
    both = F.array(F.struct(wanted.alias("w"), given.alias("g")))
    return F.get(F.transform(both, lambda x: F.when(F.size(x["w"]) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x["w"], x["g"])) / F.size(x["w"]))), F.lit(0))


def pair_cosine(dot: Column, shared_a: Column, shared_b: Column, all_a: Column, all_b: Column) -> Column:
    """Cosine of two texts' smoothed TF-IDF over these two texts only, from integer sums of their term counts:
    dot over shared terms, squares over shared and over all terms.

    With two texts, a shared term's idf is ln 2 and another's ln 3, and the term frequencies' norms cancel.
    """
    norm = lambda shared, whole: F.sqrt(F.lit(LN2_SQUARED) * shared + F.lit(LN3_SQUARED) * (whole - shared))
    size = norm(shared_a, all_a) * norm(shared_b, all_b)
    return F.when((size > 0) & (dot > 0), F.least(F.lit(1.0), F.lit(LN2_SQUARED) * dot / size)).otherwise(F.lit(0.0))


def pair_similarity(a: Column, b: Column, pattern: str = WORD) -> Column:
    """pair_cosine() of two columns, row by row: for few rows, as its work is the product of a row's terms and tokens."""
    ta, tb = tokens(a, pattern), tokens(b, pattern)
    many = lambda ts, t: (F.size(ts) - F.size(F.array_remove(ts, t))).cast("bigint")
    counts = F.transform(F.array_distinct(F.concat(ta, tb)), lambda t: F.struct(many(ta, t).alias("a"), many(tb, t).alias("b")))
    total = lambda f: F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, c: s + f(c["a"], c["b"]))
    shared = lambda n: lambda x, y: F.when((x > 0) & (y > 0), n(x, y) * n(x, y)).otherwise(0)
    return pair_cosine(total(lambda x, y: x * y), total(shared(lambda x, _: x)), total(shared(lambda _, y: y)), total(lambda x, _: x * x), total(lambda _, y: y * y))


def count_cosine(dot: Column, all_a: Column, all_b: Column) -> Column:
    """Cosine of term counts."""
    size = F.sqrt(all_a.cast("double")) * F.sqrt(all_b.cast("double"))
    return F.when((size > 0) & (dot > 0), F.least(F.lit(1.0), dot / size)).otherwise(F.lit(0.0))


def dense_cosine(a: Column, b: Column) -> Column:
    """Of two vectors of numbers; 0 if one has no length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when(size > 0, total(a, b) / size).otherwise(F.lit(0.0))


def estimate_tokens(text: Column, chars: int = CHARS_PER_TOKEN) -> Column:
    """Characters by `chars`, rounded up; 0 for an empty text."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    return F.floor((n + (chars - 1)) / chars).cast("bigint")


def estimate_tokens_floor(text: Column, chars: int = CHARS_PER_TOKEN) -> Column:
    """Characters by `chars`, rounded down, 1 at least."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.coalesce(F.char_length(text), F.lit(0)) / chars).cast("bigint"))


def message_tokens(role: Column, text: Column) -> Column:
    return estimate_tokens(text) + estimate_tokens(role) + MESSAGE_OVERHEAD


def fingerprint(text: Column, kind: str = "sha256") -> Column:
    """The first characters of a hash: 16 of sha256 or md5, 8 of sha1."""
    return {"sha256": F.left(F.sha2(text, 256), F.lit(16)), "md5": F.left(F.md5(text), F.lit(16)), "sha1": F.left(F.sha1(text), F.lit(8))}[kind]


# fixed values: roles' weights and the words that raise a message's importance
ROLE_WEIGHTS = {"system": 1.0, "user": 0.7, "assistant": 0.5, "tool": 0.6, "function": 0.6}
BOOST = r"(?i)\b(error|fail|important|critical|must|never|always|warning|exception)\b"


def importance(role: Column, text: Column, index: Column, total: Column) -> Column:
    """A message's importance: role, recency (0.1 for the oldest to 1 for the newest), length up to 2000 characters, a question
    mark, a boosting word.  System messages have 1."""
    role = F.lower(F.coalesce(role, F.lit("user")))
    weight = F.lit(0.5)
    for name, w in ROLE_WEIGHTS.items():
        weight = F.when(role == name, F.lit(w)).otherwise(weight)
    text = F.coalesce(text, F.lit(""))
    recency = F.when(total > 1, F.lit(0.1) + F.lit(0.9) * (index / (total - 1))).otherwise(F.lit(1.0))
    length = F.least(F.char_length(text) / F.lit(2000.0), F.lit(1.0))
    question = F.when(F.contains(text, F.lit("?")), F.lit(0.1)).otherwise(F.lit(0.0))
    boost = F.when(text.rlike(BOOST), F.lit(0.15)).otherwise(F.lit(0.0))
    score = weight * 0.35 + recency * 0.35 + length * 0.15 + question * 0.075 + boost * 0.075
    return F.when(role == "system", F.lit(1.0)).otherwise(F.least(F.lit(1.0), score))


def mask_first(text: Column, part: Column, mask: Column) -> Column:
    """The text with the first place of the part masked; null if it has none."""
    at = F.position(part, text)
    return F.when((at > 0) & (F.length(part) > 0), F.overlay(text, mask, at, F.length(part)))


def truncate(text: Column, limit: int, marker: str = "") -> Column:
    return F.concat(F.left(text, F.lit(max(0, limit))), F.lit(marker))


def pad(base: Column, target: int) -> Column:
    """The base text, repeated and cut at `target` characters."""
    times = F.greatest(F.lit(1), F.ceil(F.lit(target) / F.greatest(F.char_length(base), F.lit(1)))).cast("int")
    return F.substring(F.repeat(base, times), 1, target)


def padded_context(context: Column, target_tokens: Column, filler: Column, chars: int = CHARS_PER_TOKEN) -> Column:
    """The context with as much filler before it, and a blank line, as brings it to about the target; as it is if it is that long already."""
    missing = target_tokens - estimate_tokens_floor(context, chars)
    size = F.greatest(F.lit(0), missing * chars).cast("int")
    times = F.greatest(F.lit(1), F.ceil(size / F.greatest(F.char_length(filler), F.lit(1)))).cast("int")
    return F.when(missing <= 0, context).otherwise(F.concat(F.substring(F.repeat(filler, times), F.lit(1), size), F.lit("\n\n"), context))


def fill_levels(granularity: int = 10) -> Column:
    """Array of evenly spaced shares of a context window: 1/g to 1."""
    return F.array(*[F.lit(i / granularity) for i in range(1, granularity + 1)])


def fill_tokens(level: Column, limit: int) -> Column:
    return F.floor(level * limit).cast("bigint")


def short(text: Column, most: int = 120) -> Column:
    """The first characters, with dots if there are more."""
    return F.concat(F.left(text, F.lit(most)), F.when(F.char_length(text) > most, "...").otherwise(""))
