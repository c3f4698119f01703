"""Binning and scaled views: the data behind distribution plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidex import skew
from incidex.functions.expr import ratio


def bin_bounds(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Range of the data; a non-negative column starts at 0."""
    lo, hi = F.min(x), F.max(x)
    return df.groupBy(*by).agg(F.when(lo >= 0, F.lit(0.0)).otherwise(lo).alias("lo"), hi.alias("hi"))


def bin_edges(df: DataFrame, by: Sequence[str], x: str, n: int) -> DataFrame:
    """n + 1 equal-width edges per group."""
    b = bin_bounds(df, by, x)
    steps = F.sequence(F.lit(0), F.lit(n))
    return b.select(*by, F.posexplode(F.transform(steps, lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / n)).alias("i", "edge"))


def assign_bin(df: DataFrame, by: Sequence[str], x: str, n: int, out: str = "bin") -> DataFrame:
    """Bin number; the top edge belongs to the last bin and outliers are clipped.

    Groups are the panels of a plot, so their bounds are few and go to the rows.
    """
    b = bin_bounds(df, by, x)
    joined = df.join(F.broadcast(b), list(by)) if by else df.select("*", *[b.select(c).scalar().alias(c) for c in ("lo", "hi")])
    pos = F.floor(F.coalesce(ratio((F.col(x) - F.col("lo")) * n, F.col("hi") - F.col("lo")), F.lit(0.0)))
    return joined.withColumn(out, F.least(F.greatest(pos, F.lit(0)), F.lit(n - 1))).drop("lo", "hi")


def bin_means(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    """Mean, quartile whiskers and count per bin."""
    mean = df.groupBy(*by).agg(F.avg(y).alias("mean"), F.count("*").alias("n"))
    return mean.join(skew.quantiles(df, by, y, {"q1": 0.25, "q3": 0.75}), list(by))


def bin_quartiles(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    return skew.quantiles(df, by, y, {"q1": 0.25, "median": 0.5, "q3": 0.75})


def bin_items(df: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(item).alias("n_items"))


def minmax(df: DataFrame, by: Sequence[str], x: str, out: str) -> DataFrame:
    """Scale to [0, 1] inside the group; a constant group becomes 0."""
    b = df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    scaled = F.coalesce(ratio(F.col(x) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return df.join(F.broadcast(b), list(by)).withColumn(out, scaled).drop("_lo", "_hi")


def attach_means(base: DataFrame, others: dict[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Mean of other sources on shared keys; they are reduced first, so base rows never multiply."""
    for name, df in others.items():
        mean = df.groupBy(*keys).agg(F.avg(value).alias(name))
        base = base.join(mean, list(keys), "left")
    return base


def agnostic_points(points: DataFrame, names: DataFrame) -> DataFrame:
    """Mean over containers per item id, with the key looked up from a table beside it."""
    mean = points.groupBy("item_id").agg(F.avg("score").alias("score"), F.avg("impact").alias("impact"), F.count("*").alias("n"))
    return mean.join(names.select("item_id", "item_key"), "item_id")


def method_points(points: DataFrame, tier: str, name_part: str) -> DataFrame:
    return points.where((F.col("tier") == tier) & F.col("method").contains(name_part))


def preferred_order(column: Column, preferred: Sequence[str]) -> list[Column]:
    """Sort keys: preferred values first in their order, the rest by value."""
    pos = F.array_position(F.array(*[F.lit(p) for p in preferred]), column)
    return [F.when(pos > 0, pos).otherwise(len(preferred) + 1), column]
