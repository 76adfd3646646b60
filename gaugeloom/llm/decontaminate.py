"""Benchmark decontamination: windows of benchmark words found in training documents.

Native: DataFrame functions only.  The hashes of the windows' first PROBE words are broadcast; their number
is counted first, and beyond `broadcast_windows` they are split into slices, each broadcast for a
scan of its own.  A scan makes the words of each document and probes one hash for each of its places.
The places hit, few as a rule, get their whole window, which counts only if its words equal those of a window of the benchmark.

Words: A-Z is lower-cased, other letters stay; a word is a run of digits, a-z and characters
above 0x7F.  A window is `n` consecutive words of an item; an item with fewer words, but not
none, is one window.

Null and empty texts, and texts without words, have 0 words and no hit.  Repeated rows give
one row each.  Repeated items count once for each distinct id; items with a null id mark words but aren't
counted or listed.  An empty benchmark leaves every document clean.  Only the named columns are
looked at, so others may clash.  Documents are told by id and text, so rows with a null or a repeated id don't
answer for each other.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, scratch, table

N = 10
#: Words of a window that are probed.
PROBE = 4
BROADCAST_WINDOWS = 1_000_000
#: Most places, and most documents, that are broadcast to fetch texts or to leave documents out; more are joined by a shuffle.
BROADCAST_PLACES = 2_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Letters other than A-Z that lower() would change.
OTHER_CAPITALS = r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]"
NO_HASH = 0
MARK = "_gaugeloom_text"
PLACES = "array<struct<hash:bigint,n_words:int>>"


def words_of(text: Column) -> Column:
    whole = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(whole.rlike(OTHER_CAPITALS), F.translate(whole, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(whole))
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(words, at + j) for j in range(n)])


def _window_hashes(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n))
    none = F.lit(None).cast("int")
    return F.coalesce(F.transform(starts, lambda i: F.struct(_hash(words, i, n).alias("hash"), none.alias("n_words"))), F.array().cast(PLACES))


def benchmark_windows(items: DataFrame, item_key: str = "item_id", item_text: str = "text", n: int = N) -> DataFrame:
    """(item, n, words): each item's distinct windows and their lengths."""
    words = items.select(F.col(item_key).cast("string").alias("item"), words_of(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.lit(n), F.size("w"))
    each = words.select("item", length.alias("n"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("at"))
    return each.select("item", "n", F.slice("w", F.col("at") + 1, F.col("n")).alias("words")).distinct()


def find(docs: DataFrame, windows: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """From docs (key, mark, text) and windows (n, words), both distinct: (key, mark, n_words, copies) of each document, and (key, mark, at, n, words) of each place of a window."""
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # n at most
    probed = sorted({min(PROBE, n) for n in lengths})
    hashed = F.lit(NO_HASH).cast("bigint")
    for p in probed:
        hashed = F.when(F.least("n", F.lit(PROBE)) == p, _hash(F.col("words"), F.lit(0), p)).otherwise(hashed)
    probes = keep(windows.select(hashed.alias("hash")).distinct(), "probes")
    slices = -(-probes.count() // broadcast_windows) or 1

    words = docs.select("key", "mark", words_of(F.col("text")).alias("words"))
    # the number of words goes with place 0: a column of its own would be worked out after the explode, whose rows would each carry all words
    own = F.struct(F.lit(NO_HASH).cast("bigint").alias("hash"), F.size("words").alias("n_words"))
    hashes = F.concat(F.array(own).cast(PLACES), *[_window_hashes(F.col("words"), p) for p in probed])
    places = words.select("key", "mark", F.posexplode(hashes).alias("p", "at")).select("key", "mark", "p", "at.hash", "at.n_words")
    spots = None
    for s in range(slices):
        some = probes.where(F.pmod(F.col("hash"), F.lit(slices)) == s)
        if s == 0:
            some = some.unionByName(docs.sparkSession.range(1).select(F.lit(NO_HASH).cast("bigint").alias("hash"))).distinct()
        got = places.join(F.broadcast(some), "hash", "left_semi").select("key", "mark", "n_words", "p")
        spots = got if spots is None else spots.unionByName(got)
    spots = keep(spots.groupBy("key", "mark").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("p") == 0).alias("copies"), F.collect_set(F.when(F.col("p") > 0, F.col("p"))).alias("spots")), "spots")

    few = spots.where(F.size("spots") > 0).select(F.col("key").alias("k"), F.col("mark").alias("m"), "spots", "n_words")
    if (few.agg(F.sum(F.size("spots") + 1)).first()[0] or 0) <= BROADCAST_PLACES:
        few = F.broadcast(few)
    back = docs.join(few, docs["key"].eqNullSafe(F.col("k")) & (docs["mark"] == F.col("m"))).select("key", "mark", "n_words", "spots", words_of(F.col("text")).alias("words"))
    first, whole = F.lit(1), []
    for p in probed:
        size = F.greatest(F.col("n_words") - p + 1, F.lit(0))
        here = F.transform(F.filter("spots", lambda x: (x >= first) & (x < first + size)), lambda x: x - first)  # noqa: B023  used before the loop goes on
        for n in (n for n in lengths if min(PROBE, n) == p):
            whole.append(F.transform(F.filter(here, lambda at: at + n <= F.col("n_words")), lambda at: F.struct(at.alias("at"), F.lit(n).alias("n"), F.slice("words", at + 1, F.lit(n)).alias("words"))))  # noqa: B023
        first = first + size
    none = F.array().cast("array<struct<at:int,n:int,words:array<string>>>")
    # words are used twice, so that the optimizer doesn't split a text anew for each place
    seen = back.withColumn("n_words", F.size("words")).select("key", "mark", F.inline(F.concat(none, *whole))).distinct()
    same = windows.select("n", "words").distinct()
    if slices == 1 and windows.count() <= broadcast_windows:
        same = F.broadcast(same)
    return spots.select("key", "mark", "n_words", "copies"), keep(seen.join(same, ["n", "words"], "left_semi"), "places")


def covered(places: Column) -> Column:
    """How many words lie in any of the places, an array of (at, n) in order."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    more = lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["n"]).alias("end"), (s["sum"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(s["end"], x["at"]))).alias("sum"))
    return F.aggregate(places, start, more, lambda s: s["sum"])


def scan(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = N, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: key, n_words, n_hit, items (sorted as strings), places (of hits, in words), mark (the text's hash).

    What is shuffled is one small row per document and one per hit; a group is one document's.
    """
    own = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").alias("text"))
    with scratch(docs.sparkSession) as hold:
        windows = keep(benchmark_windows(items, item_key, item_text, n), "windows")
        each, places = find(own, windows, broadcast_windows)
        hits = places.groupBy("key", "mark").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("places"))
        of_items = places.select("key", "mark", "n", "words").distinct().join(windows, ["n", "words"]).groupBy("key", "mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
        found = keep(_with(hits, of_items, "left").withColumn("n_hit", covered(F.col("places")).cast("bigint")), "hits")
        many = found.agg(F.sum(F.size("places") + 1)).first()[0] or 0
        whole = _with(each, F.broadcast(found) if many <= BROADCAST_PLACES else found, "left")
        out = hold(whole, "scanned")
    empty = {"items": F.array().cast("array<string>"), "places": F.array().cast(out.schema["places"].dataType), "n_hit": F.lit(0).cast("bigint")}
    filled = out.select(F.col("key").alias(key), F.col("n_words").cast("bigint").alias("n_words"), *[F.coalesce(c, empty[c]).alias(c) for c in ("n_hit", "items", "places")], F.col("mark").alias(MARK), "copies")
    return filled.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy", "copies")


def _with(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joined by key, which may be null, and mark."""
    other = right.withColumnsRenamed({"key": "_k", "mark": "_m"})
    return left.join(other, left["key"].eqNullSafe(F.col("_k")) & left["mark"].eqNullSafe(F.col("_m")), how).drop("_k", "_m")


def drop_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = N, least_share: float = 0.0) -> DataFrame:
    """The documents of whose words at most `least_share` are hit, with all their columns."""
    scanned = scan(docs, items, key, text, item_key, item_text, n).where(F.col("n_hit") > least_share * F.col("n_words"))
    gone = scanned.select(F.col(key).alias("_gaugeloom_hit"), F.col(MARK).alias("_gaugeloom_mark")).distinct()
    if gone.count() <= BROADCAST_PLACES:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[key].eqNullSafe(F.col("_gaugeloom_hit")) & (F.xxhash64(docs[text].cast("string")) == F.col("_gaugeloom_mark")), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op8_decontaminate": op8_decontaminate}

ORACLES = {
    "op8_decontaminate": r"""
WITH item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS words
  FROM item, unnest(generate_series(1, greatest(1, len(w) - 9))) AS u(i) WHERE len(w) > 0
), doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), place AS (
  SELECT doc_id, i, m.n, array_to_string(w[i : i + m.n - 1], ' ') AS words
  FROM doc, (SELECT DISTINCT n FROM win) m, unnest(generate_series(1, len(w) - m.n + 1)) AS u(i)
), hit AS (
  SELECT doc_id, i, n, item_id FROM place JOIN win USING (n, words)
), hitwords AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hit) GROUP BY doc_id
), hititems AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hitwords USING (doc_id) LEFT JOIN hititems USING (doc_id)
"""
}
