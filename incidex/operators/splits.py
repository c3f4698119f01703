"""Reproducible splits and samples: draws are ordered by md5(seed|id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidex import skew


def shuffled(df: DataFrame, by: Sequence[str], key: Column, seed: str, out: str = "draw") -> DataFrame:
    """1-based position of each row in its group's random order."""
    digest = F.md5(F.concat(F.lit(seed + "|"), key.cast("string")))
    return skew.number_rows(df.withColumn("_h", digest), by, [F.col("_h"), key], out).drop("_h")


def random_split(containers: DataFrame, seed: str, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Disjoint split with exact sizes: floor(train n), floor(valid n), the rest is test."""
    n = containers.agg(F.count("*")).scalar()
    drawn = shuffled(containers.select("container_id"), [], F.col("container_id"), seed)
    n_train, n_valid = F.floor(F.lit(train) * n), F.floor(F.lit(valid) * n)
    name = F.when(F.col("draw") <= n_train, "training").when(F.col("draw") <= n_train + n_valid, "valid").otherwise("test")
    return drawn.select("container_id", name.alias("split"))


def stratified_folds(containers: DataFrame, k: int, seed: str, share: float = 0.1) -> DataFrame:
    """k independent 80/10/10 assignments, stratified by label; class counts round half to even."""
    folds = F.explode(F.array(*[F.lit(f) for f in range(k)])).alias("fold")
    rows = containers.select("container_id", "label", folds)
    size = containers.groupBy("label").agg(F.bround(F.lit(share) * F.count("*"), 0).cast("long").alias("cut"))
    key = F.concat_ws("|", F.col("fold").cast("string"), F.col("container_id").cast("string"))
    drawn = shuffled(rows, ["fold", "label"], key, seed).join(size, "label")
    name = F.when(F.col("draw") <= F.col("cut"), "test").when(F.col("draw") <= 2 * F.col("cut"), "valid").otherwise("training")
    return drawn.select("fold", "container_id", "label", name.alias("split"))


def exclude_ids(splits: DataFrame, ids: DataFrame) -> DataFrame:
    return splits.join(ids.select("container_id"), "container_id", "left_anti")


def split_of(containers: DataFrame, splits: DataFrame) -> DataFrame:
    """Split of every container; unlisted ones count as training."""
    return containers.select("container_id").join(splits, "container_id", "left").withColumn(
        "split", F.coalesce("split", F.lit("training"))
    )


def kfold(containers: DataFrame, k: int, seed: str) -> DataFrame:
    """Interleaved folds of one random order."""
    drawn = shuffled(containers.select("container_id"), [], F.col("container_id"), seed)
    return drawn.select("container_id", ((F.col("draw") - 1) % k).alias("fold"))


def cap_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return skew.top_rows(df, by, order, n)
