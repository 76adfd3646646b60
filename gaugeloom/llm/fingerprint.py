"""Document fingerprints: bottom-k sketches of word-shingle hashes.

Native: DataFrame functions only.  A sketch is the array of the k smallest distinct 64-bit
hashes of a text's five-word shingles, ascending.  Words are split at white space after
lower-casing; a text with fewer words is one shingle, a text without words has the empty sketch.
Null counts as empty.  Equal texts have equal sketches.  The sketch of a union of parts is the
bottom k of the union of their sketches, so sketches merge across parts in any order.

With fewer than k hashes a sketch holds the whole set and its estimates are exact.  Resemblance of
two empty sketches is 1, of an empty and another one 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, whole_text

K = 256
WORDS = 5
EMPTY = "array<bigint>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def shingle_hashes(words: Column, width: int = WORDS) -> Column:
    """A 64-bit hash of each shingle.  Hash words' hash in turn, so word borders count."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))
    return F.when(F.size(words) >= width, each).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast(EMPTY))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def add_sketch(df: DataFrame, text: str, out: str, k: int = K, width: int = WORDS) -> DataFrame:
    """df with the sketch of column text as column out."""
    words = f"_gaugeloom_{out}_words"
    return df.withColumn(words, words_of(whole_text(text))).withColumn(out, bottom(shingle_hashes(F.col(words), width), k)).drop(words)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's bottom k that both sketches hold."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    kth = (F.get(sketch, F.lit(k - 1)).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a, 0 if a has none as small as both sketches reach.

    Hashes up to the smaller reach are a sample of a's, all of which b's sketch would hold.
    """
    reach = lambda s: F.when(F.size(s) >= k, F.element_at(s, -1)).otherwise(F.lit(2**63 - 1))
    sampled = F.size(F.filter(a, lambda h: h <= F.least(reach(a), reach(b))))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(sampled == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(a, b)) / sampled))


def merge(df: DataFrame, group: str, sketch: str, k: int = K, fan: int = 64) -> DataFrame:
    """One merged sketch for each group.

    Equal sketches meet first; then rounds of about `fan` sketches at a time, so that no task
    gathers a large group.
    """
    out = df.select(group, sketch).distinct()
    most = out.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    merged = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(sketch)))), 1, k).alias(sketch)
    while most > fan:
        most = math.ceil(most / fan)
        out = out.groupBy(group, F.pmod(F.xxhash64(sketch), F.lit(most)).alias("_salt")).agg(merged).drop("_salt")
    return out.groupBy(group).agg(merged)


def _ranges(docs: DataFrame, key: str, parts: int) -> Column:
    """The number of the key's range; ranges hold about equally many rows.  Null: the first."""
    found = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(found))
    step = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not blocks:
        return F.lit(0)
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col(key)))
    block = F.greatest(below(F.array(*[F.lit(b[0]) for b in blocks])) - 1, F.lit(0))
    return F.when(F.col(key).isNull(), 0).otherwise(block * step + below(F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), block)))


def with_next(docs: DataFrame, key: str, text: str, out: str, parts: int | None = None, derive=None, derived: dict[str, str] | None = None) -> DataFrame:
    """(key, text, out): each document with the text of the next one, by descending key; after the
    last comes the first.  derive(df) may add columns from these, and derived names those of them
    that are wanted from the next document too, and under which name, without a further shuffle.

    The keys' quantiles cut the documents into ranges; the first document of each range is also
    put, as a row that goes away again, after the last one of the range before it.  Texts are shuffled once.
    Rows with equal keys follow one another in the order of their texts' hashes; null keys come last.
    """
    parts = parts or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key), whole_text(text).alias(text)).withColumn("_range", _ranges(docs, key, parts))
    heads = sorted((r._range, r.head) for r in rows.groupBy("_range").agg(F.max(key).alias("head")).collect())  # a row for each range
    at = docs.schema[key].dataType.simpleString()
    ghosts = docs.sparkSession.createDataFrame([(h, heads[(i + 1) % len(heads)][0], i == len(heads) - 1) for i, (_, h) in enumerate(heads)], f"_head {at}, _to int, _wraps boolean")
    copies = rows.join(F.broadcast(ghosts), F.col(key).eqNullSafe(F.col("_head")))
    both = rows.withColumns({"_wraps": F.lit(False), "_ghost": F.lit(False)}).unionByName(copies.select(key, text, F.col("_to").alias("_range"), "_wraps", F.lit(True).alias("_ghost")))
    order = Window.partitionBy("_range").orderBy("_wraps", F.col(key).desc_nulls_last(), F.xxhash64(text))
    led = both.withColumn(out, F.lead(text).over(order))
    if derive:
        led = derive(led).withColumns({name: F.lead(c).over(order) for c, name in (derived or {}).items()})
    return led.where(~F.col("_ghost")).drop("_ghost", "_wraps", "_range")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    sketches = lambda df: add_sketch(add_sketch(df.withColumn("edited", edited), "text", "text_sketch"), "edited", "edited_sketch")
    out = with_next(table(spark, sf_dir, "documents"), "doc_id", "text", "next", derive=sketches, derived={"text_sketch": "next_sketch"})
    as_text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return out.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("text_sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        resemblance(F.col("text_sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("text_sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("text_sketch")).alias("edited_in_text"),
        distinct_shingles(F.col("text_sketch")).alias("n_shingles"),
    )


QUERIES = {"op1_fingerprint": op1_fingerprint}
