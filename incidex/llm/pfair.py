"""Mixing sources to target weights with Pfair windows and earliest deadline first; DataFrame functions only.

Rows of a source, in the order of the md5 of their id, form blocks of ``block`` rows.  A source with weight q / P
(integer q, the weights of all sources adding up to the period P) gives its block k the release time floor(k P / q)
and the deadline ceil((k + 1) P / q).  Earliest deadline first over released blocks fills each slot with one block, and at any
time t each source has got q t / P blocks, give or take less than one.  At multiples of P all windows meet, so one
period is scheduled (an SQL fold over P slots) and block k of a source takes the slot of block k mod q, shifted
by k div q periods.  Slots of a source that has run out stay empty; every row keeps its place, none is dropped or repeated.

Numbering a source's rows is two-level: windows run inside (source, md5 prefix), prefixes are linked by running
totals of their counts, so a source with a third of all rows is spread over all prefixes.

There may be at most ``max_sources`` sources (else ``ValueError``): the schedule of one period, at most ``period`` plus one slot for
each source, is what is sent to all tasks.

Defined results: a NULL source is a source of its own; NULL ids come first in their source; rows that repeat an id
lie side by side; sources without a target weight raise ``ValueError``; an empty table gives an empty result; columns of the input keep
their names (the added ones begin with ``mix_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidex.llm.common import set_aside

PREFIX = 3  # hex digits of the md5: 4096 parts


def tempered(docs: DataFrame, source: str = "source", power: float = 0.5) -> DataFrame:
    """Target weights in proportion to a power of the sources' row counts: ``(source, weight)``."""
    return docs.groupBy(F.col(source).alias("source")).count().select("source", F.pow(F.col("count").cast("double"), power).alias("weight"))


def shares(weights: DataFrame, period: int = 1000) -> DataFrame:
    """``(source, q)``: whole numbers of slots, one at least."""
    total = F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return weights.select("source", F.greatest(F.lit(1), F.round(F.col("weight") * period / total)).cast("long").alias("q"))


def _ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b)


def schedule(quotas: DataFrame) -> DataFrame:
    """One period: ``(source, q, period, j, slot)`` with the slot of each source's block j."""
    listed = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "q"))).alias("s"))
    listed = listed.where(F.size("s") > 0).withColumn("q", F.transform("s", lambda x: x["q"])).withColumn("period", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x))
    period, q = F.col("period"), F.col("q")

    def step(state: Column, t: Column) -> Column:
        def window(k: Column, i: Column) -> Column:
            share = F.get(q, i)
            ready = (F.floor(k * period / share) <= t) & (k < share)
            return F.when(ready, F.struct(_ceil_div((k + 1) * period, share).alias("d"), i.alias("i")))

        pick = F.array_min(F.filter(F.transform(state["k"], window), lambda x: x.isNotNull()))["i"]
        return F.element_at(
            F.transform(F.array(pick), lambda p: F.struct(
                F.transform(state["k"], lambda k, i: F.when(i == p, k + 1).otherwise(k)).alias("k"),
                F.concat(state["out"], F.array(p)).alias("out"),
            )), 1,
        )

    start = F.struct(F.transform(q, lambda x: F.lit(0).cast("long")).alias("k"), F.array().cast("array<int>").alias("out"))
    run = listed.select("s", "period", F.aggregate(F.sequence(F.lit(0).cast("long"), period - 1), start, step, lambda x: x["out"]).alias("out"))
    slots = run.select("s", "period", F.posexplode("out").alias("slot", "i")).select("period", F.col("slot").cast("long").alias("slot"), F.get("s", F.col("i")).alias("x"))
    j = F.row_number().over(Window.partitionBy("x.none", "x.name").orderBy("slot")).cast("long") - 1
    return slots.select(F.when(F.col("x.none"), None).otherwise(F.col("x.name")).alias("source"), F.col("x.q").alias("q"), "period", j.alias("j"), "slot")


def interleave(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", source: str = "source", block: int = 32, period: int = 1000, max_sources: int = 10_000) -> DataFrame:
    """``docs`` with ``mix_block, mix_release, mix_deadline, mix_slot, mix_place``; order by the last two.

    Own columns of ``docs`` with one of these names are left out.
    """
    docs, own = set_aside(docs, (id_col, source), ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place"))
    quotas = shares(weights, period)
    if len(quotas.limit(max_sources + 1).select("q").collect()) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    have = docs.select(F.col(source).alias("have")).distinct()
    if not have.join(weights, F.col("have").eqNullSafe(F.col("source")), "left_anti").isEmpty():
        raise ValueError("a source has no target weight")
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.withColumns({"mix_md5": digest, "mix_part": F.substring(digest, 1, PREFIX), "mix_key": F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name"))})
    parts = rows.groupBy("mix_key", "mix_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_key").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("mix_key").alias("o_key"), F.col("mix_part").alias("o_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o_off"))
    inside = Window.partitionBy("mix_key", "mix_part").orderBy("mix_md5", F.col(id_col))
    plan = F.broadcast(schedule(quotas).select(  # at most period + max_sources rows
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("p_key"), F.col("q").alias("p_q"), F.col("period").alias("p_period"), F.col("j").alias("p_j"), F.col("slot").alias("p_slot")
    ))
    quota = F.broadcast(quotas.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("q_key"), F.col("q").alias("q_q")))
    numbered = rows.withColumn("mix_seq", F.row_number().over(inside).cast("long") - 1)
    numbered = numbered.join(offsets, (F.col("mix_key") == F.col("o_key")) & (F.col("mix_part") == F.col("o_part"))).withColumn("mix_seq", F.col("mix_seq") + F.col("o_off"))
    numbered = numbered.withColumns({"mix_block": F.floor(F.col("mix_seq") / block), "mix_place": F.col("mix_seq") % block})
    placed = numbered.join(quota, F.col("mix_key") == F.col("q_key")).withColumn("mix_j", F.col("mix_block") % F.col("q_q"))
    placed = placed.join(plan, (F.col("mix_key") == F.col("p_key")) & (F.col("mix_j") == F.col("p_j")))
    k, q, p = F.col("mix_block"), F.col("p_q"), F.col("p_period")
    return placed.select(
        *own, k, F.floor(k * p / q).alias("mix_release"), _ceil_div((k + 1) * p, q).alias("mix_deadline"),
        (F.floor(k / q) * p + F.col("p_slot")).alias("mix_slot"), "mix_place",
    )


def in_mixed_order(docs: DataFrame, weights: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, dealt out and sorted in mixed order, with their own columns."""
    plain, own = set_aside(docs, (options.get("id_col", "doc_id"), options.get("source", "source")))
    mixed = interleave(plain, weights, **options)
    return mixed.repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(*own)
