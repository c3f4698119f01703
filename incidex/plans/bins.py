"""Binning queries (BIN) with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from incidex import skew
from incidex.operators import bins as bn
from incidex.plans.registry import query
from incidex.plans.scoring import POINTS, impact, points

N = 12
PTS = f"(SELECT p.*, split FROM {POINTS} p JOIN containers USING (container_id))"
BOUNDS = f"(SELECT split, CASE WHEN min(score) >= 0 THEN 0.0::DOUBLE ELSE min(score) END AS lo, max(score) AS hi FROM {PTS} GROUP BY 1)"
BINNED = f"""(SELECT p.*, least(greatest(floor(coalesce((score - lo) * {N} / nullif(hi - lo, 0), 0)), 0), {N - 1}) AS bin
   FROM {PTS} p JOIN {BOUNDS} b USING (split))"""


def _points(t):
    return points(t).join(t.containers.select("container_id", "split"), "container_id")


def _binned(t):
    return bn.assign_bin(_points(t), ["split"], "score", N)


@query("bin1_edges", "split:s i:l edge:d",
       f"SELECT split, i, lo + (hi - lo) * i / {N} AS edge FROM {BOUNDS}, (SELECT unnest(range({N + 1})) AS i)")
def _(t):
    return bn.bin_edges(_points(t), ["split"], "score", N)


@query("bin2_assign", "container_id:l item_key:s bin:l", f"SELECT container_id, item_key, bin FROM {BINNED}")
def _(t):
    return _binned(t)


@query("bin3_means", "split:s bin:l mean:d n:l q1:d q3:d",
       f"""SELECT split, bin, avg(impact) AS mean, count(*) AS n, quantile_cont(impact, 0.25) AS q1, quantile_cont(impact, 0.75) AS q3
           FROM {BINNED} GROUP BY ALL""")
def _(t):
    return bn.bin_means(_binned(t), ["split", "bin"], "impact")


@query("bin4_quartiles", "split:s bin:l q1:d median:d q3:d",
       f"""SELECT split, bin, quantile_cont(impact, 0.25) AS q1, quantile_cont(impact, 0.5) AS median, quantile_cont(impact, 0.75) AS q3
           FROM {BINNED} GROUP BY ALL""")
def _(t):
    return bn.bin_quartiles(_binned(t), ["split", "bin"], "impact")


@query("bin5_items", "split:s bin:l n_items:l",
       f"SELECT split, bin, count(DISTINCT item_key) AS n_items FROM {BINNED} GROUP BY ALL")
def _(t):
    return bn.bin_items(_binned(t), ["split", "bin"], "item_key")


@query("bin6_minmax", "container_id:l item_key:s scaled:d",
       f"""SELECT container_id, item_key, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS scaled
           FROM {PTS} WINDOW w AS (PARTITION BY split)""")
def _(t):
    return bn.minmax(_points(t), ["split"], "score", "scaled")


@query("bin7_attach_means", "container_id:l item_key:s impact:d by_quantity:d by_discount:d",
       f"""SELECT p.container_id, p.item_key, p.impact, q.v AS by_quantity, d.v AS by_discount FROM {POINTS} p
           LEFT JOIN (SELECT container_id, brand AS item_key, avg(score_b) AS v FROM lines WHERE flag <> 'A' GROUP BY ALL) q USING (container_id, item_key)
           LEFT JOIN (SELECT container_id, brand AS item_key, avg(score_c) AS v FROM lines WHERE flag <> 'R' GROUP BY ALL) d USING (container_id, item_key)""")
def _(t):
    keys = ["container_id", "item_key"]
    li = t.lines.withColumn("item_key", F.col("brand"))
    others = {
        "by_quantity": li.where("flag <> 'A'").select(*keys, F.col("score_b").alias("v")),
        "by_discount": li.where("flag <> 'R'").select(*keys, F.col("score_c").alias("v")),
    }
    return bn.attach_means(impact(t), others, keys, "v")


@query("bin8_agnostic_points", "item_id:l item_key:s score:d impact:d n:l",
       f"""SELECT rank - 1 AS item_id, item_key, avg(score) AS score, avg(impact) AS impact, count(*) AS n
           FROM {POINTS} JOIN brand_vocab USING (item_key) GROUP BY ALL""")
def _(t):
    p = points(t).join(t.brand_vocab.select("item_key", "item_id"), "item_key").select("item_id", "score", "impact")
    return bn.agnostic_points(p, t.brand_vocab)


@query("bin9_method_points", "method:s tier:s dataset:s fold:l pearson_mean:d",
       """SELECT family AS method, backbone AS tier, dataset, fold, pearson_mean FROM runs WHERE backbone = 'BUILDING' AND contains(family, 'O')""")
def _(t):
    return bn.method_points(t.runs.withColumn("method", F.col("family")).withColumn("tier", F.col("backbone")), "BUILDING", "O")


@query("bin10_preferred_order", "family:s position:l",
       """SELECT family, row_number() OVER (ORDER BY CASE family WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, family) AS position
          FROM (SELECT DISTINCT family FROM runs)""")
def _(t):
    order = bn.preferred_order(F.col("family"), ["3-MEDIUM", "1-URGENT"])
    return skew.number_rows(t.runs.select("family").distinct(), [], order, "position")
