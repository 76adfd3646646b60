"""Secret scans with corpus-wide ownership frequency.

Candidates are the base kinds below and `bare`: other strings of 20 characters or more of `[A-Za-z0-9+/_=-]`
that hold a digit and at least MIN_BITS bits of entropy a character.  Of each candidate's value only a
hash is kept.  Values are counted over the whole corpus by distinct repository and by distinct owner,
and each is judged:

* example: in at least EXAMPLE_OWNERS owners, so widely copied;
* owned: in one owner only, so live-looking;
* shared: anything between.

A bare candidate is a finding, and so a span, unless its value is an example; base ones always are.  Bare
candidates that overlap a base span are left out.  Counts are reduced before the shuffle, and a value's
rows meet only as distinct (value, repository, owner).

Base kinds, leftmost and not overlapping within a kind: assign (group 2 has 6 characters or more),
access (20 or more), hex (24 or more).  Spans count code points, ends excluded.

Null and empty texts have no findings.  Repeated rows give one row each.  A null repository or owner is one
of its own.  Only the named columns are looked at, so others may clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches as B
from .common import keep, table

KINDS = ("assign", "access", "hex", "bare")
EXAMPLE_OWNERS = 5
MIN_BITS = 3.5
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HAS_DIGIT = re.compile(r"[0-9]")


def entropy(value: str) -> float:
    return -sum(k / len(value) * math.log2(k / len(value)) for k in Counter(value).values())


def spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of the base kinds, then of bare candidates."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    digits = HAS_DIGIT.search(text) is not None
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    if digits:
        taken = [(a, b) for a, _, b, _ in found]
        for m in BARE.finditer(text):
            a, b = m.span()
            if HAS_DIGIT.search(m[0]) and entropy(m[0]) >= MIN_BITS and not any(x < b and a < y for x, y in taken):
                found.append((a, 3, b, m[0]))
    return sorted(found)


def _scan(batches):
    """For each row its spans, as arrays."""
    for batch in batches:
        rows = [spans(t) for t in batch.column(0).to_pylist()]
        lists = [
            [[KINDS[k] for _, k, _, _ in r] for r in rows],
            [[a for a, _, _, _ in r] for r in rows],
            [[b for _, _, b, _ in r] for r in rows],
            [[hashlib.blake2b(v.encode(), digest_size=16).digest() for _, _, _, v in r] for r in rows],
        ]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(x, pa.list_(t)) for x, t in zip(lists, kinds, strict=True)]], [*batch.schema.names[1:], "kinds", "starts", "ends", "hashes"])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "source", owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per document: key and found, an array of (start, kind, end, standing, n_owners, n_repositories)
    by start, then kind."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(key).alias("key"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"))
    scanned = keep(rows.mapInArrow(B.giving_back(_scan), f"key {kind}, repository string, owner string, kinds array<string>, starts array<int>, ends array<int>, hashes array<binary>").withColumn("row", F.monotonically_increasing_id()), "scanned")
    some = scanned.where(F.size("kinds") > 0)
    each = some.select("row", "repository", "owner", F.explode(F.arrays_zip("kinds", "starts", "ends", "hashes")).alias("x"))
    each = each.select("row", "repository", "owner", F.col("x.kinds").alias("kind"), F.col("x.starts").alias("start"), F.col("x.ends").alias("end"), F.col("x.hashes").alias("value"))
    # distinct first, so a value in a third of all documents is a row for each owner and repository
    uses = each.select("value", "repository", "owner").distinct()
    owners, repositories = (uses.select("value", c).distinct().groupBy("value").agg(F.count("*").alias(n)) for c, n in (("owner", "n_owners"), ("repository", "n_repositories")))
    per_value = owners.join(repositories, "value")
    standing = F.when(F.col("n_owners") >= example_owners, "example").when((F.col("n_owners") == 1) & (F.col("n_repositories") == 1), "owned").otherwise("shared")
    judged = each.join(per_value, "value").withColumn("standing", standing).where("kind <> 'bare' OR standing <> 'example'")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "standing", "n_owners", "n_repositories"))).alias("found"))
    return scanned.select("row", F.col("key").alias(key)).join(per_row, "row", "left").select(key, F.coalesce("found", F.array().cast(per_row.schema["found"].dataType)).alias("found"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    many = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")
    base = F.filter("found", lambda x: x["kind"] != "bare")
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda standing: F.size(F.filter("found", lambda x: x["standing"] == standing)).cast("bigint")
    return found.select(
        "doc_id",
        many("assign").alias("n_assign"),
        many("access").alias("n_access"),
        many("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        of("owned").alias("n_owned"),
        of("shared").alias("n_shared"),
        of("example").alias("n_example"),
    )


QUERIES = {"op10_secrets": op10_secrets}
