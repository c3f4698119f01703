"""Ranking, numbering and quantiles that never put a whole group into one task.

A plain ``Window.partitionBy(group).orderBy(x)`` sends all rows of a group to one
task.  Here rows are first dealt to ranges of the order by Spark's range partitioner, and the
range is written down with the row.  A range holds about 1/k of *all* rows, so (group, range)
cannot hold more than that even when one group holds a third of the data.  Windows then
run inside (group, range), and the ranges of a group are linked by running totals over at
most k summary rows.  k is ``spark.sql.shuffle.partitions``, as for any other exchange of the job.

Ties are added up to one row per (group, value) before anything is dealt, so a value that
most rows share is one row.  The dealt rows are stored: they are computed once, and a float that
comes out of an aggregation has the same bits in every pass.

``number_rows`` deals only groups of more than ``WHOLE`` rows to ranges; the others are numbered by one window, in one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidex.session import cut_lineage

_RANGE = "_range"
WHOLE = 100_000  # rows of a group that one task numbers by itself
_HEAVY = 1000  # a value with more than 1/_HEAVY of all rows is joined by broadcast; there are fewer than _HEAVY of them


def in_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` stored with the number of the range of ``order`` each row lies in."""
    k = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(k, *order).withColumn(_RANGE, F.spark_partition_id()))


def split_groups(df: DataFrame, by: Sequence[str], limit: int, *tables: DataFrame, weight: str | None = None) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """``tables`` without the groups that have more than ``limit`` rows (or ``weight``) in ``df``, and those groups (None if there are none)."""
    by = list(by)
    large = cut_lineage(df.groupBy(*by).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n")).where(F.col("_n") > limit).select(*by))
    if large.isEmpty():
        return list(tables), None
    return [x.join(large, by, "left_anti") for x in tables], [x.join(large, by, "left_semi") for x in tables]


def number_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str, first: int = 1, sizes: DataFrame | None = None
) -> DataFrame:
    """``row_number`` per group over a total order.  Keys in ``by`` must not be NULL.

    ``sizes`` is a cheaper table whose groups have at least as many rows as those of ``df``.
    """
    by = list(by)
    if not by:
        return _number_ranges(df, by, order, out, first)
    (whole,), rest = split_groups(df if sizes is None else sizes, by, WHOLE, df)
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    numbered = whole.withColumn(out, number + (first - 1))
    return numbered if rest is None else numbered.unionByName(_number_ranges(rest[0], by, order, out, first))


def _number_ranges(df: DataFrame, by: list[str], order: Sequence[Column], out: str, first: int) -> DataFrame:
    tagged = in_ranges(df, [*[F.col(c) for c in by], *order])
    totals = tagged.groupBy(*by, _RANGE).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, _RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*by, _RANGE).orderBy(*order)
    return (
        tagged.join(offsets, [*by, _RANGE])
        .withColumn(out, F.row_number().over(inner) + F.col("_off") + (first - 1))
        .drop(_RANGE, "_off")
    )


def ladder(df: DataFrame, by: Sequence[str], x: str, measures: dict[str, Column] | None = None) -> DataFrame:
    """One row per (group, distinct x) with each measure's own, earlier and total sum.

    Measures are aggregate expressions that add up (counts and sums); ``n`` is always
    there.  Output: ``by, x, <m>, <m>_before, <m>_total``.  NULL x is left out.
    """
    by = list(by)
    measures = {"n": F.count("*"), **(measures or {})}
    names = list(measures)
    added = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(*[e.alias(m) for m, e in measures.items()])
    steps = in_ranges(added, [F.col(c) for c in (*by, x)])
    chunk = steps.groupBy(*by, _RANGE).agg(*[F.sum(m).alias(m) for m in names])
    prior = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    chunk = chunk.select(
        *by,
        _RANGE,
        *[F.coalesce(F.sum(m).over(prior), F.lit(0)).alias(f"{m}_off") for m in names],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in names],
    )
    inner = Window.partitionBy(*by, _RANGE).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    out = steps.join(chunk, [*by, _RANGE])
    for m in names:
        out = out.withColumn(
            f"{m}_before", F.coalesce(F.sum(m).over(inner), F.lit(0)) + F.col(f"{m}_off")
        )
    return out.drop(_RANGE, *[f"{m}_off" for m in names])


def average_rank(df: DataFrame, by: Sequence[str], x: str, out: str) -> DataFrame:
    """Adds the tie-averaged ascending rank (1-based) of ``x`` inside each group; NULL for NULL.

    Values that many rows share get their rank by broadcast (fewer than ``_HEAVY`` rows can be that
    frequent), the others by an equi-join.
    """
    return average_ranks(df, by, x, {out: F.lit(True)})


def average_ranks(df: DataFrame, by: Sequence[str], x: str, among: dict[str, Column]) -> DataFrame:
    """``average_rank`` among all rows, or those that meet a condition, for several conditions at once.

    ``among`` gives the condition to each new column; the rank in rows that do not meet it means nothing.
    """
    by = list(by)
    df = cut_lineage(df)
    flags = {f"_f{i}": c.cast("long") for i, c in enumerate(among.values())}
    steps = ladder(df.select(*by, F.col(x).alias("_x"), *[c.alias(f) for f, c in flags.items()]), by, "_x", {f: F.sum(f) for f in flags})
    ranks = [(F.col(f"{f}_before") + (F.col(f) + 1) / 2).alias(out) for f, out in zip(flags, among)]
    steps = steps.select(*by, F.col("_x").alias(x), *ranks, "n")
    heavy = F.broadcast(steps.where(F.col("n") > F.lit(df.count() / _HEAVY)).drop("n"))
    keys = [*by, x]
    light = df.join(heavy.select(*keys), keys, "left_anti").join(steps.drop("n"), keys, "left")
    return df.join(heavy, keys).select(*df.columns, *among).unionByName(light.select(*df.columns, *among))


def quantiles(df: DataFrame, by: Sequence[str], x: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group, one column per name."""
    by = list(by)
    steps = ladder(df.select(*by, F.col(x).alias("_x")), by, "_x")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("n_total") - 1)
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col("_x"))).alias(f"_{name}_{side}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_{name}_f"))
    got = steps.groupBy(*by).agg(*aggs)
    return got.select(
        *by,
        *[
            (
                F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")
            ).alias(n)
            for n in probs
        ],
    )


def roc_auc(
    df: DataFrame, by: Sequence[str], y: str, x: str, out: str = "auc", weight: str | None = None
) -> DataFrame:
    """ROC-AUC per group (Mann-Whitney with ties); NULL when a class is missing."""
    by = list(by)
    w = F.lit(1) if weight is None else F.col(weight)
    sums = {"tot": F.sum("_w"), "pos": F.sum(F.when(F.col("_y").cast("int") == 1, F.col("_w")).otherwise(0))}
    src = df.where(F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), w.alias("_w"))
    steps = ladder(src, by, "_x", sums)
    neg = F.col("tot") - F.col("pos")
    neg_before = F.col("tot_before") - F.col("pos_before")
    got = steps.groupBy(*by).agg(
        F.sum(F.col("pos") * (neg_before + neg / 2)).alias("_u"),
        F.max("pos_total").alias("n_pos"),
        F.max(F.col("tot_total") - F.col("pos_total")).alias("n_neg"),
    )
    pairs = F.col("n_pos") * F.col("n_neg")
    return got.select(*by, "n_pos", "n_neg", F.when(pairs > 0, F.col("_u") / pairs).alias(out))


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group; Spark prunes each input partition to k before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
