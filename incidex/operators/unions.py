"""Coverage of unions of clauses, by inclusion and exclusion over their intersections.

Containers become baskets of fired clauses and equal baskets are merged.  Each distinct basket gives its sets of up to ``max_size`` clauses;
added up, these are the sizes of all intersections that occur.  A union is a signed sum of at most ``2 ** max_size - 1`` of them.
Combinations are rows from beginning to end: none is listed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BITS = 15  # of a clause number in a key
MAX_SIZE = 4
MAX_CLAUSES = (1 << _BITS) - 1


def key_of(ids: Column) -> Column:
    """One number for a sorted array of at most ``MAX_SIZE`` clause numbers."""
    return F.aggregate(ids, F.lit(0).cast("long"), lambda key, c: F.shiftleft(key, _BITS) + c + 1)


def intersections(baskets: DataFrame, max_size: int) -> DataFrame:
    """``(key, n)``: groups that hold all clauses of a set, for every set of up to ``max_size`` that occurs.

    ``baskets(basket array<int>, n)`` holds sorted clause numbers.
    """
    if max_size > MAX_SIZE:
        raise ValueError(f"sets of at most {MAX_SIZE} clauses have a key")
    rows = baskets.select(F.lit(0).cast("long").alias("key"), F.col("basket").alias("rest"), "n")
    parts = None
    for _ in range(max_size):
        each = rows.select("key", "rest", "n", F.posexplode("rest").alias("pos", "c"))
        rows = each.select((F.shiftleft("key", _BITS) + F.col("c") + 1).alias("key"), F.slice("rest", F.col("pos") + 2, F.size("rest")).alias("rest"), "n")
        part = rows.groupBy("key").agg(F.sum("n").alias("n"))  # a set of k clauses comes from one level only
        parts = part if parts is None else parts.unionByName(part)
    return parts


def combinations(spark: SparkSession, width: int, max_size: int) -> DataFrame:
    """``(ids, size)``: all sets of 1 to ``max_size`` of ``width`` numbers."""
    level = spark.range(width).select(F.array(F.col("id").cast("int")).alias("ids"))
    out = level
    for _ in range(1, max_size):
        last = F.element_at("ids", -1)
        longer = level.where(last < width - 1).select("ids", F.explode(F.sequence(last + 1, F.lit(width - 1))).alias("c"))
        level = longer.select(F.concat("ids", F.array("c")).alias("ids"))
        out = out.unionByName(level)
    return out.select("ids", F.size("ids").alias("size"))


def union_sizes(sets: DataFrame, inter: DataFrame) -> DataFrame:
    """``(key, n)``: groups that hold any clause of each ``ids`` (sorted) of ``sets``."""
    some = sets.select("ids").distinct()
    parts = some.select(key_of(F.col("ids")).alias("whole"), "ids", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("ids")) - 1).cast("int"))).alias("m"))
    chosen = F.filter("ids", lambda c, i: F.getbit("m", i) == 1)
    signed = parts.select("whole", key_of(chosen).alias("key"), F.when(F.bit_count("m") % 2 == 1, 1).otherwise(-1).alias("sign"))
    total = F.coalesce(F.sum(F.col("sign") * F.col("n")), F.lit(0)).alias("n")
    return signed.join(inter, "key", "left").groupBy(F.col("whole").alias("key")).agg(total)
