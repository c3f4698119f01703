"""URL filters from dated lists: entries become validity intervals, captures are judged as of their fetch day.

A list log holds ``(kind, pattern, day, listed)``: on that day the pattern was put on the list or taken off.  Kinds, from the
most special: ``path`` (host and first path part), ``host``, ``domain`` (last two labels).  Of several log rows of a
pattern on one day, a listing wins.  An entry is valid from its day until the next log row of its pattern, ``ttl`` days at most.

Log rows and captures are first reduced to one row for each (pattern, day): a pattern then has as many rows as there are
days, however hot its host is.  The as-of join is one window over the log and the asked days of a pattern (the last log
row up to the day); its answers go back to the captures by equality on (pattern, day).

Defined results: NULL urls and urls without a host match nothing (``host`` is NULL); NULL days are not blocked; rows may
repeat, each is judged; an empty list blocks nothing; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidex.llm.common import set_aside

KINDS = ("path", "host", "domain")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)"


def patterns(url: Column) -> dict[str, Column]:
    """The pattern of each kind that covers a url."""
    found = F.lower(F.regexp_extract(url, _HOST, 1))
    host = F.when(found != "", found)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return {
        "path": F.concat(host, F.lit("/"), F.regexp_extract(url, _PATH, 1)),
        "host": host,
        "domain": F.when(domain != "", domain),
    }


def intervals(log: DataFrame, ttl: int = 90) -> DataFrame:
    """``(kind, pattern, valid_from, valid_to)`` of the listed spans; ``valid_to`` is excluded."""
    daily = log.where("pattern is not null and day is not null").groupBy("kind", "pattern", "day").agg(F.max("listed").alias("listed"))
    following = F.lead("day").over(Window.partitionBy("kind", "pattern").orderBy("day"))
    end = F.least(F.date_add("day", ttl), F.coalesce(following, F.date_add("day", ttl)))
    return daily.select("kind", "pattern", "listed", F.col("day").alias("valid_from"), end.alias("valid_to")).where("listed").drop("listed")


def judge(captures: DataFrame, log: DataFrame, url: str = "url", day: str = "day", ttl: int = 90) -> DataFrame:
    """``captures`` with ``host``, ``blocked``, and kind, pattern and first day of the most special valid entry.

    Own columns of ``captures`` with one of these names are left out.
    """
    captures, own = set_aside(captures, (url, day), ("host", "blocked", "entry_kind", "entry", "entry_day"))
    keys = patterns(F.col(url))
    rows = captures.withColumns({f"_{k}": c for k, c in keys.items()})
    spans = intervals(log, ttl)
    out = rows
    for kind in KINDS:
        asked = rows.where(F.col(f"_{kind}").isNotNull() & F.col(day).isNotNull()).select(F.col(f"_{kind}").alias("pattern"), F.col(day).alias("day")).distinct()
        entries = spans.where(F.col("kind") == kind).select("pattern", F.col("valid_from").alias("day"), F.struct("valid_from", "valid_to").alias("span"))
        both = asked.withColumn("span", F.lit(None).cast("struct<valid_from:date,valid_to:date>")).withColumn("ask", F.lit(True)).unionByName(entries.withColumn("ask", F.lit(False)))
        # entries of the day itself stand before the question
        last = F.last("span", ignorenulls=True).over(Window.partitionBy("pattern").orderBy("day", "ask"))
        answers = both.withColumn("span", last).where(F.col("ask") & (F.col("day") < F.col("span.valid_to")))
        answers = answers.select(F.col("pattern").alias(f"_{kind}_p"), F.col("day").alias(f"_{kind}_d"), F.col("span.valid_from").alias(f"_{kind}_from"))
        out = out.join(answers, (F.col(f"_{kind}") == F.col(f"_{kind}_p")) & (F.col(day) == F.col(f"_{kind}_d")), "left")
    pick = lambda of: F.coalesce(*[F.when(F.col(f"_{k}_from").isNotNull(), of(k)) for k in KINDS])
    return out.select(
        *own, F.col("_host").alias("host"), F.coalesce(*[F.col(f"_{k}_from") for k in KINDS]).isNotNull().alias("blocked"),
        pick(lambda k: F.lit(k)).alias("entry_kind"), pick(lambda k: F.col(f"_{k}")).alias("entry"), pick(lambda k: F.col(f"_{k}_from")).alias("entry_day"),
    )
