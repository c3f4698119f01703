"""Rows that are compared with figures of their own group are evaluated once."""

import random

import pytest
from pyspark.sql import functions as F

from incidex.operators import bins, impact


@pytest.fixture
def shaky(spark):
    """One row per container; its impact differs whenever it is computed again."""
    value = F.udf(lambda _: random.SystemRandom().random(), "double").asNondeterministic()
    rows = spark.range(200).select(
        F.col("id").alias("container_id"), F.lit("UNK").alias("item_key"), F.lit("k").alias("source_key"), F.lit(0.5).alias("importance"), F.lit(1.0).alias("label")
    )
    return rows.withColumn("impact", value("container_id"))


@pytest.mark.parametrize("mode, high", [("p50", True), ("p75", True), ("beat_unk", False)])
def test_a_row_alone_equals_its_threshold(shaky, mode, high):
    assert {r["is_local_hi"] for r in impact.local_high(shaky, mode).collect()} == {high}
    assert {r["h2"] for r in impact.hypotheses(shaky, mode).collect()} == {high}


def test_ratios_of_rows_alone(shaky):
    rows = impact.hypothesis_ratios(shaky.withColumn("item_key", F.lit("a")), "p75").collect()
    assert [(r["total"], r["n_h2"], r["cooc_avg_impact"]) for r in rows] == [(200, 200, 0.0)]


def test_few_bounds_are_not_dealt_by_panel(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.range(1000).select(F.lit("hot").alias("g"), (F.col("id") / 10).alias("x"))
        for out in (bins.assign_bin(df, ["g"], "x", 12), bins.minmax(df, ["g"], "x", "s")):
            assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert bins.assign_bin(df, ["g"], "x", 12).groupBy("bin").count().count() == 12
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
