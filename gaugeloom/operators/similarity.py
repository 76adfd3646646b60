"""Similarities of texts in groups and in pairs, from integer term counts.

Results don't depend on partitioning: all sums are of integers.  Rows with a null group are a group of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.functions import text as X


def term_counts(df: DataFrame, keys: list[str], text: str, pattern: str = X.WORD) -> DataFrame:
    """(keys, term, n)"""
    return df.select(*keys, F.explode(X.tokens(F.col(text), pattern)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def pairs(df: DataFrame, group: str, index: str, text: str, pattern: str = X.WORD) -> DataFrame:
    """(group, i, j, similarity) for i < j of a group that share a term; other pairs have similarity 0.

    The join is on group and term, so it grows with shared terms, not with all pairs.
    """
    counts = term_counts(df, [group, index], text, pattern)
    whole = counts.groupBy(group, index).agg(F.sum(F.col("n") * F.col("n")).alias("whole"))
    a, b = (counts.select(group, F.col(index).alias(i), "term", F.col("n").alias(n)) for i, n in (("i", "na"), ("j", "nb")))
    met = a.join(b, [group, "term"]).where("i < j").groupBy(group, "i", "j").agg(F.sum(F.expr("na * nb")).alias("dot"), F.sum(F.expr("na * na")).alias("sa"), F.sum(F.expr("nb * nb")).alias("sb"))
    sized = met.join(whole.select(group, F.col(index).alias("i"), F.col("whole").alias("qa")), [group, "i"]).join(whole.select(group, F.col(index).alias("j"), F.col("whole").alias("qb")), [group, "j"])
    return sized.select(group, "i", "j", X.pair_cosine(F.col("dot"), F.col("sa"), F.col("sb"), F.col("qa"), F.col("qb")).alias("similarity"))


def group_consistency(df: DataFrame, group: str, index: str, text: str, pattern: str = X.WORD) -> DataFrame:
    """(group, n_outputs, n_pairs, score, least, most): mean, smallest and largest similarity of a group's pairs.
    Groups of one output have no pair and aren't in the result."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n_outputs")).where("n_outputs > 1").withColumn("n_pairs", F.expr("n_outputs * (n_outputs - 1) div 2"))
    met = pairs(df, group, index, text, pattern).groupBy(group).agg(F.sum("similarity").alias("total"), F.min("similarity").alias("lo"), F.max("similarity").alias("hi"), F.count("*").alias("met"))
    both = sizes.join(met, group, "left")
    return both.select(group, "n_outputs", "n_pairs", (F.coalesce("total", F.lit(0.0)) / F.col("n_pairs")).alias("score"), F.when(F.col("met") == F.col("n_pairs"), F.col("lo")).otherwise(0.0).alias("least"), F.coalesce("hi", F.lit(0.0)).alias("most"))


def versus(df: DataFrame, keys: list[str], a: str, b: str, out: str = "similarity", pattern: str = X.WORD) -> DataFrame:
    """(keys, out): similarity of two text columns.  keys must tell rows apart.

    Rows are dealt out by their keys once; both aggregations then stay where they are.
    """
    dealt = df.select(*keys, X.tokens(F.col(a), pattern).alias("_a"), X.tokens(F.col(b), pattern).alias("_b")).repartition(*keys)
    sides = F.concat(F.transform("_a", lambda t: F.struct(t.alias("term"), F.lit(1).alias("na"), F.lit(0).alias("nb"))), F.transform("_b", lambda t: F.struct(t.alias("term"), F.lit(0).alias("na"), F.lit(1).alias("nb"))))
    terms = dealt.select(*keys, F.inline_outer(sides)).groupBy(*keys, "term").agg(F.coalesce(F.sum("na"), F.lit(0)).alias("na"), F.coalesce(F.sum("nb"), F.lit(0)).alias("nb"))
    shared = "na > 0 AND nb > 0"
    sums = terms.groupBy(*keys).agg(
        F.sum(F.expr("na * nb")).alias("dot"),
        F.sum(F.expr(f"if({shared}, na * na, 0)")).alias("sa"),
        F.sum(F.expr(f"if({shared}, nb * nb, 0)")).alias("sb"),
        F.sum(F.expr("na * na")).alias("qa"),
        F.sum(F.expr("nb * nb")).alias("qb"),
        F.sum(F.expr("na * nb")).alias("cdot"),
    )
    return sums.select(*keys, X.pair_cosine(F.col("dot"), F.col("sa"), F.col("sb"), F.col("qa"), F.col("qb")).alias(out), X.count_cosine(F.col("cdot"), F.col("qa"), F.col("qb")).alias(f"{out}_counts"))


def fidelity_report(df: DataFrame, keys: list[str], score: str, similarity: str, verdict: str) -> DataFrame:
    """(keys, total, counts and rates of verdicts, mean score and similarity), rounded to 4 digits; without keys one row, of zeros if there is nothing."""
    many = lambda v: F.count_if(F.col(verdict) == v)
    share = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    total = F.count("*")
    return df.groupBy(*keys).agg(
        total.alias("total"), *[many(v).alias(f"{v.lower()}_count") for v in ("FAITHFUL", "UNFAITHFUL", "INCONCLUSIVE")],
        share(F.try_divide(many("FAITHFUL"), total)).alias("faithfulness_rate"), share(F.try_divide(many("UNFAITHFUL"), total)).alias("unfaithfulness_rate"), share(F.avg(score)).alias("mean_faithfulness_score"), share(F.avg(similarity)).alias("mean_similarity"),
    )


def corpus_to_first(df: DataFrame, group: str, index: str, text: str, pattern: str = X.WORD_APOSTROPHE) -> DataFrame:
    """(group, index, similarity): of each text of a group to the group's first, by TF-IDF over the group's texts,
    idf = ln((n + 1) / (df + 1)) + 1.  Texts without terms have similarity 0."""
    counts = term_counts(df, [group, index], text, pattern)
    sizes = df.groupBy(group).agg(F.count("*").alias("n"), F.min(index).alias("first"))
    frequency = counts.groupBy(group, "term").agg(F.count("*").alias("df"))
    weighed = counts.withColumnRenamed("n", "c").join(frequency, [group, "term"]).join(sizes, group).withColumn("w", F.col("c") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    first = weighed.where(F.col(index) == F.col("first")).select(group, "term", F.col("w").alias("w0"))
    # a group has one first text, so its norm is a window's away from its terms
    norms = weighed.groupBy(group, index).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = weighed.join(first, [group, "term"]).groupBy(group, index).agg(F.sum(F.col("w") * F.col("w0")).alias("dot"))
    size0 = norms.join(sizes, group).where(F.col(index) == F.col("first")).select(group, F.col("size").alias("size0"))
    all_rows = df.select(group, index).join(norms, [group, index], "left").join(size0, group, "left").join(dots, [group, index], "left")
    return all_rows.select(group, index, F.when((F.col("size") > 0) & (F.col("size0") > 0), F.least(F.lit(1.0), F.coalesce("dot", F.lit(0.0)) / (F.col("size") * F.col("size0")))).otherwise(0.0).alias("similarity"))


def consecutive_jaccard(df: DataFrame, group: str, order: str, tokens: str, back: int = 1) -> DataFrame:
    """df with jaccard_<back>: of each row's token set and the one `back` rows before; null for the first ones."""
    before = F.lag(tokens, back).over(Window.partitionBy(group).orderBy(order))
    return df.withColumn(f"jaccard_{back}", F.when(before.isNotNull(), X.jaccard(F.col(tokens), before)))
