"""Samples and tables in the shared folder."""

import pytest
from pyspark.sql import functions as F

from gaugeloom.llm import common


def test_samples_of_very_large_groups_are_not_empty(spark):
    rows = spark.range(20_000).withColumn("g", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    got = rows.where(common.sampled(F.col("id"), F.col("g"), {"a": 10**11, "b": 10}, 10**10)).groupBy("g").count().collect()
    n = {r.g: r["count"] for r in got}
    assert 800 < n["a"] < 1200 and n["b"] == 10_000


def test_scratch_removes_what_is_not_held(spark):
    with common.scratch(spark) as hold:
        gone = common.keep(spark.range(3), "gone")
        stays = hold(spark.range(4), "stays")
    assert stays.count() == 4 and stays._gaugeloom_path in common._kept and gone._gaugeloom_path not in common._kept
    with pytest.raises(Exception):
        gone.collect()
    common.drop(stays)
