"""Split and sample queries (SPL) with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from incidex.operators import splits as sp
from incidex.plans.registry import query

RANDOM = """SELECT container_id, CASE WHEN r <= floor(0.8::DOUBLE * n) THEN 'training'
     WHEN r <= floor(0.8::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'valid' ELSE 'test' END AS split
   FROM (SELECT container_id, row_number() OVER (ORDER BY md5('7|' || container_id), container_id) AS r, count(*) OVER () AS n FROM containers)"""


@query("spl1_random_split", "container_id:l split:s", RANDOM)
def _(t):
    return sp.random_split(t.containers, "7")


@query("spl2_stratified_folds", "fold:l container_id:l label:l split:s",
       """SELECT fold, container_id, label, CASE WHEN r <= cut THEN 'test' WHEN r <= 2 * cut THEN 'valid' ELSE 'training' END AS split FROM
          (SELECT fold, container_id, label, row_number() OVER (PARTITION BY fold, label ORDER BY md5('7|' || fold || '|' || container_id),
             fold || '|' || container_id) AS r FROM containers, (SELECT unnest([0, 1, 2]) AS fold))
          JOIN (SELECT label, round_even(0.1::DOUBLE * count(*), 0) AS cut FROM containers GROUP BY 1) USING (label)""")
def _(t):
    return sp.stratified_folds(t.containers, 3, "7")


@query("spl3_exclude_ids", "container_id:l split:s",
       f"SELECT * FROM ({RANDOM}) WHERE container_id NOT IN (SELECT container_id FROM containers WHERE price < 50000)")
def _(t):
    return sp.exclude_ids(sp.random_split(t.containers, "7"), t.containers.where("price < 50000"))


@query("spl4_split_of", "container_id:l split:s",
       """SELECT container_id, CASE WHEN label = 1 THEN split ELSE 'training' END AS split FROM containers""")
def _(t):
    return sp.split_of(t.containers, t.containers.where("label = 1").select("container_id", "split"))


@query("spl5_kfold", "container_id:l fold:l",
       "SELECT container_id, (row_number() OVER (ORDER BY md5('7|' || container_id), container_id) - 1) % 5 AS fold FROM containers")
def _(t):
    return sp.kfold(t.containers, 5, "7")


@query("spl6_cap_per_group", "custkey:l container_id:l rank:l",
       """SELECT custkey, container_id, row_number() OVER (PARTITION BY custkey ORDER BY orderdate, container_id) AS rank
          FROM containers QUALIFY rank <= 3""")
def _(t):
    return sp.cap_per_group(t.containers, ["custkey"], [F.col("orderdate"), F.col("container_id")], 3)
