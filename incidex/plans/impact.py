"""Impact, hypothesis, pooling and graph-aggregate queries (MET14-17, 34-68) with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from incidex.functions.expr import clamp
from incidex.operators import impact as im
from incidex.operators import metrics as mt
from incidex.plans.registry import query
from incidex.plans.scoring import ITEM_SCORES, UNK_RANK, impact, item_scores, node_scores, NODE_SCORES

LOO = "(SELECT container_id, item_key, abs(p_full - p_without) AS impact FROM predictions)"


@query("met14_leave_one_out", "container_id:l item_key:s impact:d", f"SELECT * FROM {LOO}")
def _(t):
    return im.leave_one_out(t.predictions)


@query("met15_item_impact", "item_key:s mean_impact:d std_impact:d n_containers:l score:d",
       f"""SELECT item_key, mean_impact, std_impact, n_containers, score FROM (SELECT item_key, avg(impact) AS mean_impact,
             stddev_pop(impact) AS std_impact, count(*) AS n_containers FROM {LOO} GROUP BY 1) JOIN {ITEM_SCORES} USING (item_key)""")
def _(t):
    return im.item_impact(im.leave_one_out(t.predictions)).join(item_scores(t), "item_key")


@query("met16_impact_cache", "method:s item_key:s mean_impact:d std_impact:d n_containers:l",
       f"""SELECT method, item_key, avg(impact) AS mean_impact, stddev_pop(impact) AS std_impact, count(*) AS n_containers
           FROM {LOO}, (SELECT unnest(['a', 'b', 'c']) AS method) GROUP BY ALL""")
def _(t):
    from incidex.session import cut_lineage

    cache = cut_lineage(im.leave_one_out(t.predictions))  # stored once, read by every method
    methods = F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("method")
    return im.item_impact(cache).select(methods, "*")


@query("met17_grouped_rows", "split:s item_key:s impact:d support:l score:d",
       f"""SELECT * FROM (SELECT split, item_key, avg(impact) AS impact, count(*) AS support FROM {LOO}
             JOIN containers USING (container_id) GROUP BY ALL) JOIN {ITEM_SCORES} USING (item_key)""")
def _(t):
    by_split = im.leave_one_out(t.predictions).join(t.containers.select("container_id", "split"), "container_id")
    return im.grouped_rows(by_split, item_scores(t), ["split"])


IMPORTANCE = "least(greatest(score / 100000, 0), 1)"


def _importance(t):
    return item_scores(t).select("item_key", clamp(F.col("score") / 100000, 0.0, 1.0).alias("score"))


@query("met34_impact_frame",
       "container_tag:s item_key:s impact:d importance:d importance_logit:d label:d",
       f"""SELECT split || ':' || container_id AS container_tag, item_key, impact, {IMPORTANCE} AS importance,
             ln({IMPORTANCE} / (1 - {IMPORTANCE})) AS importance_logit, label
           FROM {LOO} JOIN {ITEM_SCORES} USING (item_key) JOIN containers USING (container_id)""")
def _(t):
    return im.impact_frame(impact(t), _importance(t), t.containers)


FRAME = f"""(SELECT container_id, CASE WHEN rank <= {UNK_RANK} THEN item_key ELSE 'UNK' END AS item_key, item_key AS source_key,
   impact, {IMPORTANCE} AS importance, label FROM {LOO} JOIN {ITEM_SCORES} USING (item_key)
   JOIN containers USING (container_id) JOIN brand_vocab USING (item_key))"""
KNOWN = f"(SELECT * FROM {FRAME} WHERE item_key <> 'UNK')"


def _frame(t):
    ranks = t.brand_vocab.select("item_key", "rank")
    f = im.impact_frame(impact(t), _importance(t), t.containers).join(ranks, "item_key")
    return f.select(
        "container_id",
        F.when(F.col("rank") <= UNK_RANK, F.col("item_key")).otherwise(im.UNKNOWN_KEY).alias("item_key"),
        F.col("item_key").alias("source_key"),
        "impact",
        "importance",
        "label",
    )


def _local(mode: str, src: str) -> str:
    if mode == "global":
        return f"SELECT *, impact >= (SELECT avg(impact) FROM {src}) AS h2 FROM {src}"
    if mode == "beat_unk":
        return f"""SELECT f.*, impact > coalesce(u, (SELECT avg(impact) FROM {src})) AS h2 FROM {src} f LEFT JOIN
           (SELECT container_id, avg(impact) AS u FROM {src} WHERE item_key = 'UNK' GROUP BY 1) USING (container_id)"""
    q = 0.5 if mode == "p50" else 0.75
    return f"""SELECT f.*, impact >= thr AS h2 FROM {src} f JOIN
       (SELECT container_id, quantile_cont(impact, {q}) AS thr FROM {src} GROUP BY 1) USING (container_id)"""


for _mode in ("global", "p50", "p75", "beat_unk"):

    @query(f"met35_local_high_{_mode}", "container_id:l source_key:s impact:d h2:b", _local(_mode, FRAME))
    def _(t, mode=_mode):
        return im.local_high(_frame(t), mode).withColumnRenamed("is_local_hi", "h2")


HYP = """SELECT l.*, NOT h2 AND container_id IN (SELECT container_id FROM l WHERE h2 AND importance > thr) AS h1,
     NOT h2 AND container_id NOT IN (SELECT container_id FROM l WHERE h2 AND importance > thr) AS h0
   FROM l, th"""


def _hyp_with(src: str, mode: str) -> str:
    return f"WITH th AS (SELECT avg(importance) AS thr, avg(impact) AS ithr FROM {src}), l AS ({_local(mode, src)}), h AS (SELECT l.*, NOT h2 AND a.container_id IS NOT NULL AS h1, NOT h2 AND a.container_id IS NULL AS h0 FROM l LEFT JOIN (SELECT DISTINCT container_id FROM l, th WHERE h2 AND importance > thr) a USING (container_id))"


@query("met36_hypotheses", "container_id:l source_key:s h0:b h1:b h2:b",
       f"{_hyp_with(FRAME, 'p75')} SELECT container_id, source_key, h0, h1, h2 FROM h")
def _(t):
    return im.hypotheses(_frame(t), "p75")


RATIO_COLS = ("item_key:s total:l n_h2:l n_h1:l n_h0:l ratio_h2:d ratio_h1:d ratio_h0:d avg_importance:d avg_impact:d "
              "cooc_avg_impact:d purity:d category:s")
RATIOS = f"""{_hyp_with(KNOWN, 'p75')}, s AS (SELECT container_id, sum(impact) AS si, count(*) AS ci FROM {KNOWN} GROUP BY 1)
   SELECT *, n_h2 / total AS ratio_h2, n_h1 / total AS ratio_h1, n_h0 / total AS ratio_h0,
     CASE WHEN avg_importance > thr AND avg_impact > ithr THEN 'HH' WHEN avg_importance > thr THEN 'HL'
       WHEN avg_impact > ithr THEN 'LH' ELSE 'LL' END AS category FROM
   (SELECT item_key, count(*) AS total, count(*) FILTER (h2) AS n_h2, count(*) FILTER (h1) AS n_h1, count(*) FILTER (h0) AS n_h0,
      avg(importance) AS avg_importance, avg(impact) AS avg_impact, avg((si - impact) / greatest(ci - 1, 1)) AS cooc_avg_impact,
      greatest(count(*) FILTER (label >= 0.5), count(*) FILTER (label < 0.5)) / count(*) AS purity
    FROM h JOIN s USING (container_id) GROUP BY 1 HAVING count(*) >= 5), th"""


@query("met37_hypothesis_ratios", RATIO_COLS, RATIOS)
def _(t):
    return im.hypothesis_ratios(_frame(t), "p75")


@query("met38_categorise", "item_key:s category:s", f"SELECT item_key, category FROM ({RATIOS})")
def _(t):
    r = im.hypothesis_ratios(_frame(t), "p75").drop("category")
    known = _frame(t).where(F.col("item_key") != im.UNKNOWN_KEY)
    return im.categorise(r, known.agg(F.avg("importance")).scalar(), known.agg(F.avg("impact")).scalar())


@query("met39_category_summary",
       "category:s n_items:l mean_h2:d mean_h1:d mean_h0:d mean_importance:d mean_impact:d position:l",
       f"""SELECT category, count(*) AS n_items, avg(ratio_h2) AS mean_h2, avg(ratio_h1) AS mean_h1, avg(ratio_h0) AS mean_h0,
             avg(avg_importance) AS mean_importance, avg(avg_impact) AS mean_impact,
             list_position(['HH', 'HL', 'LH', 'LL'], category) AS position FROM ({RATIOS}) GROUP BY category""")
def _(t):
    return im.category_summary(im.hypothesis_ratios(_frame(t), "p75"))


@query("met40_multi_explanation", "item_key:s category:s ratio_h2:d ratio_h1:d rank:l",
       f"""SELECT item_key, category, ratio_h2, ratio_h1, row_number() OVER (PARTITION BY category ORDER BY ratio_h1 DESC, item_key) AS rank
           FROM ({RATIOS}) WHERE category IN ('HL', 'HH')""")
def _(t):
    from incidex import skew

    r = im.hypothesis_ratios(_frame(t), "p75").where(F.col("category").isin("HL", "HH"))
    return skew.number_rows(r, ["category"], [-F.col("ratio_h1"), F.col("item_key")], "rank")


ELEMENT_SCORES = "(SELECT container_id, brand AS item_key, score_b AS score FROM lines)"


def _element_scores(t):
    return t.lines.select("container_id", F.col("brand").alias("item_key"), F.col("score_b").alias("score"))


@query("met41_coherence", "n_containers:l within:d between:d",
       f"""SELECT count(*) AS n_containers, avg(w) AS within, avg(b) AS between FROM (SELECT container_id, avg(v) AS w, var_pop(m) AS b FROM
           (SELECT container_id, item_key, var_pop(score) AS v, avg(score) AS m FROM {ELEMENT_SCORES} GROUP BY ALL) GROUP BY 1)""")
def _(t):
    return im.coherence(_element_scores(t))


@query("met42_consistency", "n_groups:l mean_variance:d",
       f"""SELECT count(*) AS n_groups, avg(v) AS mean_variance FROM
           (SELECT var_samp(score) AS v FROM {ELEMENT_SCORES} GROUP BY container_id, item_key HAVING count(*) >= 2)""")
def _(t):
    return im.consistency(_element_scores(t))


ITEM_TWO = f"""SELECT item_key, avg(m) AS score_mean, avg(x) AS score_max, count(*) AS n_containers FROM
   (SELECT container_id, item_key, avg(score) AS m, max(score) AS x FROM {ELEMENT_SCORES} GROUP BY ALL) GROUP BY 1"""


@query("met43_item_scores", "item_key:s score_mean:d score_max:d n_containers:l", ITEM_TWO)
def _(t):
    return im.item_scores(_element_scores(t))


VECTORS = """(SELECT vec_id // 20 AS container_id, CASE WHEN label = 0 THEN -1 ELSE label END AS item_key, embedding AS vector FROM embeddings)"""


def _vectors(t):
    return t.raw("embeddings").select(
        F.floor(F.col("vec_id") / 20).alias("container_id"),
        F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("item_key"),
        F.col("embedding").alias("vector"),
    )


DIMS = f"(SELECT container_id, item_key, unnest(vector)::DOUBLE AS v, unnest(range(len(vector))) AS dim FROM {VECTORS})"


@query("met44_pool_parts", "container_id:l item_key:l dim:l mean:d max:d sum:d",
       f"SELECT container_id, item_key, dim, avg(v) AS mean, max(v) AS max, sum(v) AS sum FROM {DIMS} GROUP BY ALL")
def _(t):
    return im.pool_parts(_vectors(t), ["container_id", "item_key"])


@query("met44_pool_concat", "container_id:l item_key:l position:l v:d",
       f"""SELECT container_id, item_key, dim AS position, max(v) AS v FROM {DIMS} GROUP BY ALL
           UNION ALL SELECT container_id, item_key, dim + 64, avg(v) FROM {DIMS} GROUP BY ALL""")
def _(t):
    by = ["container_id", "item_key"]
    packed = im.pack(im.pool_parts(_vectors(t), by), by, ["max", "mean"])
    return packed.select(*by, F.posexplode("vector").alias("position", "v"))


@query("met45_size_weights", "container_id:l element_id:l weight:d",
       f"""SELECT container_id, element_id, CASE WHEN item_id < 0 THEN 1.0
             ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY container_id, item_key) END AS weight FROM {NODE_SCORES}""")
def _(t):
    return im.size_weights(node_scores(t), ["container_id", "item_key"], F.col("item_id") < 0)


@query("met46_rank_scale", "container_id:l element_id:l scaled:d",
       """SELECT container_id, element_id, (row_number() OVER (PARTITION BY container_id ORDER BY score_a, element_id) - 1)
            / greatest(count(*) OVER (PARTITION BY container_id) - 1, 1) AS scaled FROM elements""")
def _(t):
    e = t.brand_elements.select("container_id", "element_id", "score_a")
    return im.rank_scale(e, ["container_id"], [F.col("score_a"), F.col("element_id")])


@query("met47_collapsed", "kind:s n:l std:d collapsed:b",
       """SELECT kind, count(*) AS n, stddev_pop(s) AS std, count(*) >= 2 AND stddev_pop(s) < 1.1 AS collapsed FROM
          (SELECT kind, brand, avg(score_b) AS s FROM lines GROUP BY ALL) GROUP BY 1""")
def _(t):
    s = t.lines.groupBy("kind", "brand").agg(F.avg("score_b").alias("score"))
    return im.collapsed(s, ["kind"], 1.1)


@query("met48_occlusion", "item_key:l occlusion:d n:l",
       f"""WITH i AS (SELECT container_id, item_key, dim, sum(v) AS s FROM {DIMS} GROUP BY ALL),
           f AS (SELECT container_id, dim, sum(s) AS tot FROM i GROUP BY ALL),
           d AS (SELECT container_id, item_key, 1 - sum(tot * (tot - s)) / nullif(sqrt(sum(tot * tot)) * sqrt(sum((tot - s) * (tot - s))), 0) AS d
             FROM i JOIN f USING (container_id, dim) GROUP BY ALL)
           SELECT item_key, avg(greatest(d, 0)) AS occlusion, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY 1""")
def _(t):
    return im.occlusion(_vectors(t))


@query("met49_attention_scores", "item_key:s attention:d class_attention:d n_first_class:l n:l",
       """SELECT brand AS item_key, avg(score_c) AS attention, avg(greatest(score_b / 50, 1 - score_b / 50) * score_c) AS class_attention,
            count(*) FILTER (score_b / 50 >= 1 - score_b / 50) AS n_first_class, count(*) AS n FROM lines GROUP BY 1""")
def _(t):
    p = F.col("score_b") / 50
    return im.attention_scores(
        t.lines.select(F.col("brand").alias("item_key"), F.col("score_c").alias("alpha"), F.array(p, 1 - p).alias("probs"))
    )


ENT = "-({p} * log2({p}) + (1 - {p}) * log2(1 - {p}))"
CLAMPED = "least(greatest({x}, 1e-12), 1 - 1e-12)"


@query("met50_score_entropy", "brand:s entropy:d share_high:d",
       f"""SELECT brand, avg({ENT.format(p='p')}) AS entropy, avg(CAST(x > 0.5 AS INT)) AS share_high FROM
           (SELECT brand, score_b / 50 AS x, {CLAMPED.format(x='score_b / 50')} AS p FROM lines) GROUP BY 1""")
def _(t):
    return im.score_entropy(t.lines.select("brand", (F.col("score_b") / 50).alias("score")), ["brand"])


@query("met51_score_penalty", "size_penalty:d entropy_penalty:d",
       f"""WITH s AS (SELECT item_key, {IMPORTANCE} AS s FROM {ITEM_SCORES})
           SELECT sum(s) - (SELECT sum(s) FROM (SELECT s FROM s ORDER BY s DESC, item_key LIMIT 5)) AS size_penalty,
             avg({ENT.format(p='s')}) AS entropy_penalty FROM s""")
def _(t):
    return im.score_penalty(_importance(t), 5)


@query("met52_kl_to_prior", "brand:s kl:d",
       """SELECT brand, sum(score_b * (p * ln(p / 0.5) + (1 - p) * ln((1 - p) / 0.5))) / sum(score_b) AS kl FROM
          (SELECT brand, score_b, least(greatest(score_b / 50, 1e-6), 1 - 1e-6) AS p FROM lines) GROUP BY 1""")
def _(t):
    s = t.lines.select("brand", "score_b", (F.col("score_b") / 50).alias("score"))
    return im.kl_to_prior(s, ["brand"], 0.5, F.col("score_b"))


@query("met53_degree_histogram", "degree:l n:l",
       """SELECT coalesce(d, 0) AS degree, count(*) AS n FROM elements LEFT JOIN
          (SELECT container_id, dst AS element_id, count(*) AS d FROM edges GROUP BY ALL) USING (container_id, element_id) GROUP BY 1""")
def _(t):
    return im.degree_histogram(t.brand_elements, t.edges)


@query("met54_class_weights", "task:s n_pos:l n_neg:l pos_weight:d",
       """SELECT task, sum(y) AS n_pos, sum(1 - y) AS n_neg, least(greatest(sum(1 - y) / greatest(sum(y), 1), 0.1), 10) AS pos_weight
          FROM (SELECT 'quality' AS task, quality AS y FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY 1""")
def _(t):
    return im.class_weights(t.raw("labels").unpivot(["doc_id"], ["quality", "toxic"], "task", "y"))


@query("met55_standardise", "container_id:l z:d restored:d",
       """SELECT container_id, (price - m) / sd AS z, price AS restored FROM containers,
          (SELECT avg(price) AS m, stddev_pop(price) AS sd FROM containers WHERE split = 'training')""")
def _(t):
    return im.standardise(t.containers, "price").withColumn("restored", F.round("restored", 4))


def _x(t):
    return t.brand_elements.select("container_id", "element_id", F.col("score_b").alias("v"))


NEIGH = """SELECT x.container_id, x.element_id, {agg} AS out FROM elements x LEFT JOIN
   (SELECT g.container_id, dst, sum(score_b) AS s, avg(score_b) AS m FROM edges g JOIN elements e
      ON e.container_id = g.container_id AND e.element_id = src GROUP BY ALL) n ON n.container_id = x.container_id AND n.dst = x.element_id"""


@query("met56_neighbour_sum", "container_id:l element_id:l out:d", NEIGH.format(agg="coalesce(s, 0) + 1.1 * score_b"))
def _(t):
    return im.neighbour_aggregate(_x(t), t.edges, "sum", 0.1)


@query("met56_neighbour_mean_unit", "container_id:l element_id:l out:d",
       f"""WITH n AS ({NEIGH.format(agg='coalesce(m, 0) + score_b')})
           SELECT container_id, element_id, out / sqrt(sum(out * out) OVER (PARTITION BY container_id)) AS out FROM n""")
def _(t):
    return im.unit_length(im.neighbour_aggregate(_x(t), t.edges, "mean"), ["container_id"])


@query("met56_neighbour_norm", "container_id:l element_id:l out:d",
       """WITH l AS (SELECT * FROM edges UNION ALL SELECT container_id, element_id, element_id FROM elements),
          d AS (SELECT container_id, dst AS k, count(*) AS d FROM l GROUP BY ALL)
          SELECT l.container_id, dst AS element_id, sum(score_b / sqrt(a.d * b.d)) AS out FROM l
            JOIN elements e ON e.container_id = l.container_id AND e.element_id = src
            JOIN d a ON a.container_id = l.container_id AND a.k = src JOIN d b ON b.container_id = l.container_id AND b.k = dst GROUP BY ALL""")
def _(t):
    return im.neighbour_aggregate(_x(t), t.edges, "norm")


_AGGS = [("sum", "sum"), ("mean", "avg"), ("max", "max"), ("std", "stddev_pop")]


@query("met57_multi_aggregate", "container_id:l element_id:l " + " ".join(f"{a}:d {a}_amp:d {a}_att:d" for a, _ in _AGGS),
       "SELECT container_id, dst AS element_id, " + ", ".join(
           f"{f}(score_b) AS {a}, {f}(score_b) * ln(count(*) + 1) AS {a}_amp, {f}(score_b) / ln(count(*) + 1) AS {a}_att" for a, f in _AGGS)
       + " FROM edges JOIN (SELECT container_id, element_id AS src, score_b FROM elements) USING (container_id, src) GROUP BY ALL")
def _(t):
    return im.multi_aggregate(_x(t), t.edges, 1.0)


def _edge_scores(t):
    return mt.edge_scores(t.edges, t.brand_elements.select("container_id", "element_id", (F.col("score_b") / 50).alias("score")))


EDGE_SCORES = """(SELECT g.container_id, src, dst, a.score_b / 50 * (b.score_b / 50) AS score FROM edges g
   JOIN elements a ON a.container_id = g.container_id AND a.element_id = src JOIN elements b ON b.container_id = g.container_id AND b.element_id = dst)"""


@query("met58_edge_softmax", "container_id:l src:l dst:l alpha:d",
       f"""SELECT container_id, src, dst, exp(r) / sum(exp(r)) OVER (PARTITION BY container_id, dst) AS alpha FROM
           (SELECT *, CASE WHEN score - 0.3 > 0 THEN score - 0.3 ELSE (score - 0.3) * 0.2 END AS r FROM {EDGE_SCORES})""")
def _(t):
    return im.edge_softmax(_edge_scores(t).withColumn("score", F.col("score") - 0.3))


@query("met59_container_pool", "container_id:l add:d mean:d",
       "SELECT container_id, sum(score_b * score_c) AS add, avg(score_b * score_c) AS mean FROM lines GROUP BY 1")
def _(t):
    return im.container_pool(t.lines.withColumn("v", F.col("score_b")), F.col("score_c"))


@query("met60_pca2", "id:l pc1:d pc2:d")
def _(t):
    return im.pca2(t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


@query("met61_probe_did", "gate:s balanced_accuracy:d difference:d")
def _(t):
    e = t.raw("embeddings")
    fold = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 4), 16, 10).cast("int") % 2
    y = (F.col("label") % 2).cast("int")
    high = e.where("embedding[0] > 0").select(F.col("embedding").alias("vector"), y.alias("y"), "vec_id")
    low = e.where("embedding[0] <= 0").select(F.col("embedding").alias("vector"), y.alias("y"), "vec_id")
    a, b = im.probe(high, fold), im.probe(low, fold)
    diff = a - b if a is not None and b is not None else None
    return t.spark.createDataFrame([("high", a, diff), ("low", b, diff)], "gate string, balanced_accuracy double, difference double")


@query("met62_element_weights", "mode:s n:l w:d",
       f"""WITH n AS (SELECT item_id, {IMPORTANCE.replace('score', 's.score')} AS w FROM {NODE_SCORES} e JOIN {ITEM_SCORES} s USING (item_key)),
           iw AS (SELECT avg({IMPORTANCE}) AS m FROM {ITEM_SCORES})
           SELECT 'fixed' AS mode, count(*) AS n, sum(CASE WHEN item_id >= 0 THEN w ELSE 1 END) AS w FROM n
           UNION ALL SELECT 'shared', count(*), sum(CASE WHEN item_id >= 0 THEN w ELSE m END) FROM n, iw
           UNION ALL SELECT 'ignore', count(*), sum(w) FROM n WHERE item_id >= 0""")
def _(t):
    e = node_scores(t).drop("score")
    w = _importance(t).withColumnRenamed("score", "w")
    out = None
    for mode in ("fixed", "shared", "ignore"):
        one = im.element_weights(e, w, mode).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.sum("w").alias("w"))
        out = one if out is None else out.unionByName(one)
    return out


@query("met63_summary_fields", "split:s n_lines_all:d mean_score_all:d max_score_all:d",
       """SELECT split, count(*) AS n_lines_all, avg(score_b) AS mean_score_all, max(score_b) AS max_score_all
          FROM lines JOIN containers USING (container_id) GROUP BY 1""")
def _(t):
    j = t.lines.select("container_id", "score_b").join(t.containers.select("container_id", "split"), "container_id")
    wide = j.groupBy("split").agg(
        F.count("*").cast("double").alias("n_lines"), F.avg("score_b").alias("mean_score"), F.max("score_b").alias("max_score")
    )
    names = ["n_lines", "mean_score", "max_score"]
    return im.summary_fields(wide.unpivot(["split"], names, "metric", "value"), ["split"], names)


@query("met64_epoch_items", "epoch:l item_key:s importance:d impact:d",
       """SELECT year(orderdate) AS epoch, brand AS item_key, avg(score_b) AS importance,
            avg(CASE WHEN score_c > 0 THEN score_a END) AS impact FROM lines JOIN containers USING (container_id) GROUP BY ALL""")
def _(t):
    nan_when_free = F.when(F.col("score_c") > 0, F.col("score_a")).otherwise(F.lit(float("nan")))
    j = t.lines.join(t.containers.select("container_id", "orderdate"), "container_id")
    return im.epoch_items(j.select(F.year("orderdate").alias("epoch"), F.col("brand").alias("item_key"),
                                   F.col("score_b").alias("importance"), nan_when_free.alias("impact")))


@query("met65_edge_to_element_score", "container_id:l element_id:l score:d",
       f"""SELECT e.container_id, e.element_id, coalesce(s, 0) AS score FROM elements e LEFT JOIN
           (SELECT container_id, element_id, avg(score) AS s FROM (SELECT container_id, unnest([src, dst]) AS element_id, score FROM {EDGE_SCORES}) GROUP BY ALL) k
           ON k.container_id = e.container_id AND k.element_id = e.element_id""")
def _(t):
    return im.edge_to_element_score(t.brand_elements, _edge_scores(t))


@query("met67_snapshot", "container_id:l item_key:l dim:l mean:d importance:d impact:d",
       f"""WITH p AS (SELECT container_id, item_key, dim, avg(v) AS mean FROM {DIMS} GROUP BY ALL),
           s AS (SELECT item_key, least(greatest(avg(v) * 20 + 0.5, 0), 1) AS importance FROM {DIMS} WHERE dim = 0 AND item_key > 0 GROUP BY 1),
           i AS (SELECT container_id, item_key, sum(abs(v)) AS impact FROM {DIMS} WHERE item_key > 0 GROUP BY ALL)
           SELECT p.container_id, p.item_key, dim, mean, coalesce(importance, 0.5) AS importance, impact FROM p LEFT JOIN s USING (item_key)
             LEFT JOIN i ON i.container_id = p.container_id AND i.item_key = p.item_key""")
def _(t):
    v = _vectors(t)
    long = v.select("container_id", "item_key", F.posexplode("vector").alias("dim", "v")).where("item_key > 0")
    s = long.where("dim = 0").groupBy("item_key").agg((F.avg(F.col("v").cast("double")) * 20 + 0.5).alias("importance"))
    i = long.groupBy("container_id", "item_key").agg(F.sum(F.abs(F.col("v").cast("double"))).alias("impact"))
    pooled = im.pool_parts(v, ["container_id", "item_key"]).select("container_id", "item_key", "dim", "mean")
    return im.snapshot(pooled, s, i)


@query("met68_flatten_scores", "item_key:s score:d",
       """WITH s AS (SELECT label AS cls, item_key, avg(score_b) AS score FROM lines JOIN containers USING (container_id) GROUP BY ALL)
          SELECT item_key, avg(score) AS score FROM s WHERE item_key IN (SELECT item_key FROM s WHERE cls = 0) GROUP BY 1""")
def _(t):
    j = t.lines.join(t.containers.select("container_id", "label"), "container_id")
    return im.flatten_scores(j.groupBy(F.col("label").alias("cls"), "item_key").agg(F.avg("score_b").alias("score")))
