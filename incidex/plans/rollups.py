"""Roll-up queries (AGG) with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from incidex.operators import gates as gt
from incidex.operators import metrics as mt
from incidex.operators import rollup as ru
from incidex.operators import rules as rl
from incidex.plans.registry import query
from incidex.plans.scoring import (
    CORR_COLS, GROUPED_ROWS, NODE_SCORES, correlation_sql, dnf_sql, grouped_rows, node_scores, rank_sql,
)
from incidex.functions.expr import weighted_pearson_sql

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
FAMILIES = ["high", "low", "medium", "not_specified", "urgent"]
TIDY_KEYS = ["vocab_variant", "family", "backbone", "dataset"]


def _std(m: str) -> str:
    return f"CASE WHEN count({m}) = 1 THEN 0.0 ELSE stddev_samp({m}) END"


TIDY = f"""SELECT vocab_variant, family, backbone, dataset, count(DISTINCT fold) AS n_folds,
   string_agg(DISTINCT CAST(fold AS VARCHAR), ',' ORDER BY CAST(fold AS VARCHAR)) AS folds, avg(auc) AS auc_mean, {_std('auc')} AS auc_std,
   avg(mae) AS mae_mean, {_std('mae')} AS mae_std FROM run_fields GROUP BY ALL"""
TIDY_COLS = "vocab_variant:s family:s backbone:s dataset:s n_folds:l folds:s auc_mean:d auc_std:d mae_mean:d mae_std:d"


def _tidy(t):
    return ru.build_tidy(t.run_fields, TIDY_KEYS, ["auc", "mae"])


@query("agg1_build_tidy", TIDY_COLS, TIDY)
def _(t):
    return _tidy(t)


INJ = "CASE WHEN family = 'urgent' THEN 'na' ELSE CAST(w_feat AS INT) || '' || CAST(w_message AS INT) || '0' END"


@query("agg2_broadcast_axis", "dataset:s backbone:s family:s injection:s auc_mean:d",
       f"""WITH td AS (SELECT dataset, backbone, family, {INJ} AS injection, avg(auc) AS auc_mean FROM run_fields GROUP BY ALL)
           SELECT * FROM td UNION ALL SELECT a.dataset, a.backbone, a.family, v.injection, a.auc_mean FROM td a
             JOIN (SELECT DISTINCT dataset, backbone, injection FROM td WHERE injection <> 'na') v USING (dataset, backbone) WHERE a.injection = 'na'""")
def _(t):
    n = gt.normalise(t.run_fields, {}, ["urgent"])
    tidy = n.groupBy("dataset", "backbone", "family", "injection").agg(F.avg("auc").alias("auc_mean"))
    return ru.broadcast_axis(tidy, ["dataset", "backbone"], "injection", F.col("injection") == "na")


@query("agg3_experiment_id", "experiment:s n:l",
       "SELECT 'vocab_variant=' || vocab_variant || '|gt_tier=' || coalesce(gt_tier, 'none') AS experiment, count(*) AS n FROM run_fields GROUP BY 1")
def _(t):
    return t.run_fields.groupBy(ru.experiment_id(["vocab_variant", "gt_tier"]).alias("experiment")).agg(F.count("*").alias("n"))


KEYS = ["dataset", "backbone", "family", "fold"]


def _explainer_columns(t):
    return t.runs.select(
        *KEYS,
        F.col("pearson_mean").alias("grad_mean_pearson"),
        F.col("pearson_max").alias("grad_max_pearson"),
        F.col("gt_roc").alias("mask_mean_pearson"),
        F.col("auc").alias("grad_mean_roc"),
        F.col("mae").alias("mask_mean_roc"),
    )


EXPLAINERS = """SELECT dataset, backbone, family, fold, 'grad' AS explainer, 'mean' AS agg, pearson_mean AS pearson, auc AS roc FROM runs
   UNION ALL SELECT dataset, backbone, family, fold, 'grad', 'max', pearson_max, NULL FROM runs
   UNION ALL SELECT dataset, backbone, family, fold, 'mask', 'mean', gt_roc, mae FROM runs"""


@query("agg4_expand_explainers", "dataset:s backbone:s family:s fold:l explainer:s agg:s pearson:d roc:d", EXPLAINERS)
def _(t):
    return ru.expand_explainers(_explainer_columns(t), KEYS)


POOLED = """SELECT dataset, backbone, family, fold, 'mean' AS pooling, pearson_mean AS value FROM runs WHERE n_rows % 3 <> 0
   UNION ALL SELECT dataset, backbone, family, fold, 'max', pearson_max FROM runs WHERE n_rows % 3 <> 0
   UNION ALL SELECT dataset, backbone, family, fold, '', pearson_mean FROM runs WHERE n_rows % 3 = 0"""


def _pooled(t):
    df = t.runs.select(*KEYS, "pearson_mean", F.when(F.col("n_rows") % 3 != 0, F.col("pearson_max")).alias("pmax"))
    return ru.expand_pooling(df, "pearson_mean", "pmax", "value")


@query("agg5_expand_pooling", "dataset:s backbone:s family:s fold:l pooling:s value:d", POOLED)
def _(t):
    return _pooled(t)


def cells_sql(src: str, rows: str, metric: str) -> str:
    cols = ", ".join(
        f"""coalesce(max(CASE WHEN backbone = '{s}' THEN CASE n WHEN 0 THEN '' WHEN 1 THEN printf('%.3f', m) ELSE printf('%.3f ± %.3f', m, sd) END END), '') AS {s}"""
        for s in SEGMENTS
    )
    return f"""SELECT {rows}, {cols} FROM (SELECT {rows}, backbone, avg({metric}) AS m, stddev_samp({metric}) AS sd, count({metric}) AS n
       FROM ({src}) GROUP BY ALL) GROUP BY ALL"""


CELLS = " ".join(f"{s}:s" for s in SEGMENTS)


@query("agg6_pivot_cells", f"dataset:s family:s {CELLS}", cells_sql("SELECT * FROM runs", "dataset, family", "pearson_mean"))
def _(t):
    return ru.pivot_cells(t.runs, ["dataset", "family"], "backbone", SEGMENTS, "pearson_mean")


@query("agg7_select_pooling", "dataset:s backbone:s family:s fold:l value:d",
       f"SELECT dataset, backbone, family, fold, value FROM ({POOLED}) WHERE pooling IN ('max', '')")
def _(t):
    return ru.select_pooling(_pooled(t), "max")


@query("agg8_results_table", f"dataset:s row:s {CELLS}",
       cells_sql(f"""SELECT dataset, backbone, family AS row, pearson_mean AS v FROM runs WHERE family IN ('1-URGENT', '2-HIGH')
          UNION ALL SELECT dataset, backbone, explainer || '_' || agg, pearson FROM ({EXPLAINERS})""", "dataset, row", "v"))
def _(t):
    pred = t.runs.where(F.col("family").isin("1-URGENT", "2-HIGH")).select(
        "dataset", "backbone", F.col("family").alias("row"), F.col("pearson_mean").alias("v")
    )
    expl = ru.expand_explainers(_explainer_columns(t), KEYS).select(
        "dataset", "backbone", F.concat_ws("_", "explainer", "agg").alias("row"), F.col("pearson").alias("v")
    )
    return ru.pivot_cells(pred.unionByName(expl), ["dataset", "row"], "backbone", SEGMENTS, "v")


@query("agg9_fold_aggregate", "dataset:s family:s auc_mean:d auc_std:d auc_n:l gt_roc_mean:d gt_roc_std:d gt_roc_n:l",
       """SELECT dataset, family, avg(auc) AS auc_mean, stddev_pop(auc) AS auc_std, count(auc) AS auc_n, avg(gt_roc) AS gt_roc_mean,
            stddev_pop(gt_roc) AS gt_roc_std, count(gt_roc) AS gt_roc_n FROM runs GROUP BY ALL""")
def _(t):
    return ru.fold_aggregate(t.runs.select("dataset", "family", "fold", "auc", "gt_roc"), ["dataset", "family"], 0)


BEST = """SELECT dataset, backbone, arg_max(family, (s * v, family)) AS best_method, arg_max(v, (s * v, family)) AS best_value, count(v) AS n_methods
   FROM (SELECT dataset, backbone, family, avg({m}) AS v, {sign} AS s FROM runs GROUP BY ALL) GROUP BY ALL"""


@query("agg10_best_per_row", "dataset:s backbone:s best_method:s best_value:d n_methods:l", BEST.format(m="auc", sign=1))
def _(t):
    m = t.runs.groupBy("dataset", "backbone", "family").agg(F.avg("auc").alias("v"))
    return ru.best_per_row(m, ["dataset", "backbone"], "family", "v")


@query("agg10_best_error", "dataset:s backbone:s best_method:s best_value:d n_methods:l", BEST.format(m="mae", sign=-1))
def _(t):
    m = t.runs.groupBy("dataset", "backbone", "family").agg(F.avg("mae").alias("v"))
    return ru.best_per_row(m, ["dataset", "backbone"], "family", "v", higher=False)


SPLIT_METRIC = """(SELECT n_name AS dataset, o_orderpriority AS model, c.split, avg(c.label) AS v FROM orders JOIN containers c ON container_id = o_orderkey
   JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"""


def _split_metric(t):
    o = t.raw("orders").select(F.col("o_orderkey").alias("container_id"), F.col("o_orderpriority").alias("model"))
    n = t.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dataset"))
    c = t.raw("customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey")
    j = t.containers.select("container_id", "custkey", "split", "label").join(o, "container_id").join(c, "custkey").join(n, "c_nationkey")
    return j.groupBy("dataset", "model", "split").agg(F.avg(F.col("label").cast("double")).alias("v"))


@query("agg11_split_table", "dataset:s model:s training:d valid:d test:d best_split_model:s",
       f"""SELECT p.*, b.best_split_model FROM (SELECT dataset, model, max(v) FILTER (split = 'training') AS training, max(v) FILTER (split = 'valid') AS valid,
             max(v) FILTER (split = 'test') AS test FROM {SPLIT_METRIC} GROUP BY ALL) p
           JOIN (SELECT dataset, arg_max(model, (v, model)) AS best_split_model FROM {SPLIT_METRIC} WHERE split = 'training' GROUP BY 1) b USING (dataset)""")
def _(t):
    m = _split_metric(t)
    best = ru.best_per_row(m.where("split = 'training'"), ["dataset"], "model", "v").select(
        "dataset", F.col("best_method").alias("best_split_model")
    )
    return ru.wide_by(m, ["dataset", "model"], "split", ["training", "valid", "test"], "v").join(best, "dataset")


@query("agg12_rule_table", "rule_id:l split:s label_0:d label_1:d best_label:s",
       """WITH r AS (SELECT rule_id, split, 'label_' || l.label AS col, avg(synth) AS v FROM labelled l JOIN containers USING (container_id) GROUP BY ALL)
          SELECT rule_id, split, max(v) FILTER (col = 'label_0') AS label_0, max(v) FILTER (col = 'label_1') AS label_1,
            arg_max(col, (v, col)) AS best_label FROM r GROUP BY ALL""")
def _(t):
    lab = rl.apply_rules(t.containers, t.brand_incidence, t.rules).join(t.containers.select("container_id", "split"), "container_id")
    r = lab.groupBy("rule_id", "split", F.concat(F.lit("label_"), F.col("label").cast("string")).alias("col")).agg(
        F.avg(F.col("synth").cast("double")).alias("v")
    )
    wide = ru.wide_by(r, ["rule_id", "split"], "col", ["label_0", "label_1"], "v")
    best = ru.best_per_row(r, ["rule_id", "split"], "col", "v").select("rule_id", "split", F.col("best_method").alias("best_label"))
    return wide.join(best, ["rule_id", "split"])


@query("agg13_truth_tables", "dataset:s mean:d std:d n:l " + CELLS.replace(":s", ":d"),
       "SELECT dataset, avg(gt_roc) AS mean, stddev_samp(gt_roc) AS std, count(gt_roc) AS n, "
       + ", ".join(f"avg(gt_roc) FILTER (backbone = '{s}') AS {s}" for s in SEGMENTS) + " FROM runs GROUP BY 1")
def _(t):
    long = t.runs.groupBy("dataset").agg(
        F.avg("gt_roc").alias("mean"), F.stddev_samp("gt_roc").alias("std"), F.count("gt_roc").alias("n")
    )
    return long.join(ru.wide_by(t.runs, ["dataset"], "backbone", SEGMENTS, "gt_roc"), "dataset")


@query("agg14_per_method", "dataset:s backbone:s " + " ".join(f"{f}:d" for f in FAMILIES),
       "SELECT dataset, backbone, " + ", ".join(f"avg(gt_roc) FILTER (family = '{f}') AS {f}" for f in FAMILIES) + " FROM run_fields GROUP BY ALL")
def _(t):
    return ru.wide_by(t.run_fields, ["dataset", "backbone"], "family", FAMILIES, "gt_roc")


@query("agg15_model_performance", "dataset:s metric:s " + " ".join(f"{f}:d" for f in FAMILIES),
       "SELECT dataset, CASE WHEN dataset = 'NATION_0' THEN 'mae' ELSE 'auc' END AS metric, "
       + ", ".join(f"avg(CASE WHEN dataset = 'NATION_0' THEN mae ELSE auc END) FILTER (family = '{f}') AS {f}" for f in FAMILIES)
       + " FROM run_fields GROUP BY ALL")
def _(t):
    reg = F.col("dataset") == "NATION_0"
    df = t.run_fields.withColumn("metric", F.when(reg, "mae").otherwise("auc")).withColumn("v", F.when(reg, F.col("mae")).otherwise(F.col("auc")))
    return ru.wide_by(df, ["dataset", "metric"], "family", FAMILIES, "v")


@query("agg16_regime", "regime:s n:l",
       """SELECT CASE WHEN starts_with(coalesce(gt_tier, ''), 'dnf_') THEN 'planted' ELSE 'real' END || '_' ||
            CASE WHEN ends_with(vocab_variant, '_filter') THEN 'filtered' ELSE 'full' END AS regime, count(*) AS n FROM run_fields GROUP BY 1""")
def _(t):
    r = ru.regime(F.col("vocab_variant"), F.coalesce("gt_tier", F.lit("")))
    return t.run_fields.groupBy(r.alias("regime")).agg(F.count("*").alias("n"))


@query("agg17_metric_set", "dataset:s backbone:s family:s fold:l n_folds:l headline:d part:s",
       """SELECT dataset, backbone, family, fold, n_folds, gt_roc AS headline, CASE WHEN ends_with(vocab_variant, '_filter') THEN 'supplement' ELSE 'main' END AS part
          FROM run_fields JOIN (SELECT dataset, backbone, family, count(DISTINCT fold) AS n_folds FROM run_fields GROUP BY ALL) USING (dataset, backbone, family)""")
def _(t):
    return ru.metric_set(t.run_fields, ["dataset", "backbone", "family"], "gt_roc")


@query("agg18_inject_filtered", "dataset:s backbone:s family:s fold:l auc:d gt_roc:d injected:b",
       """SELECT a.dataset, a.backbone, a.family, a.fold, b.auc + 1 AS auc, NULL::DOUBLE AS gt_roc, true AS injected FROM run_fields a
          JOIN run_fields b USING (dataset, backbone, family, fold) WHERE NOT contains(a.vocab_variant, '_filter') AND b.n_rows % 3 = 0""")
def _(t):
    keys = ["dataset", "backbone", "family", "fold"]
    full = t.run_fields.where(~F.col("vocab_variant").contains("_filter")).select(*keys, "auc", "gt_roc")
    filtered = t.run_fields.where("n_rows % 3 = 0").select(*keys, (F.col("auc") + 1).alias("auc"))
    return ru.inject_filtered(full, filtered, keys, ["auc"], ["gt_roc"])


@query("agg19_presence", "family:s auc:d tier:d",
       "SELECT family, avg(CAST(n_rows % 4 <> 0 AS INT)) AS auc, avg(CAST(gt_tier IS NOT NULL AS INT)) AS tier FROM run_fields GROUP BY 1")
def _(t):
    df = t.run_fields.select("family", F.when(F.col("n_rows") % 4 != 0, F.col("auc")).alias("auc"), F.col("gt_tier").alias("tier"))
    return ru.presence(df, ["family"], ["auc", "tier"])


@query("agg20_coverage_report", "dataset:s family:s n_rows:l n_backbones:l n_folds:l complete:b",
       """SELECT dataset, family, count(*) AS n_rows, count(DISTINCT backbone) AS n_backbones, count(DISTINCT fold) AS n_folds,
            count(DISTINCT fold) >= 5 AS complete FROM run_fields GROUP BY ALL""")
def _(t):
    return ru.coverage_report(t.run_fields, ["dataset", "family"], 5)


@query("agg21_add_variants", "split:s n_runs:l " + CORR_COLS,
       f"""SELECT split, n_runs, c.* EXCLUDE (split) FROM (SELECT split, count(*) AS n_runs FROM containers GROUP BY 1)
           LEFT JOIN ({correlation_sql(GROUPED_ROWS, 'split')}) c USING (split)""")
def _(t):
    rows = t.containers.groupBy("split").agg(F.count("*").alias("n_runs"))
    return rows.join(mt.grouped_correlations(grouped_rows(t), ["split"]), "split", "left")


PAIRS = [("BUILDING", "MACHINERY"), ("BUILDING", "FURNITURE"), ("FURNITURE", "MACHINERY")]
PAIR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, dataset, avg(gt_roc) FILTER (backbone = '{a}') AS score, avg(gt_roc) FILTER (backbone = '{b}') AS impact FROM runs GROUP BY dataset"
    for a, b in PAIRS
)


@query("agg22_ranking_stability", "a:s b:s n:l rho:d verdict:s",
       f"""SELECT *, CASE WHEN rho IS NULL THEN 'too few' WHEN rho >= 0.8 THEN 'stable' WHEN rho >= 0.5 THEN 'mostly stable' ELSE 'unstable' END AS verdict FROM
           (SELECT a, b, count(*) AS n, {weighted_pearson_sql('rx', 'ry')} AS rho FROM
             (SELECT *, {rank_sql('a, b', 'score')} AS rx, {rank_sql('a, b', 'impact')} AS ry FROM
               (SELECT * FROM ({PAIR_SQL}) WHERE score IS NOT NULL AND impact IS NOT NULL)) GROUP BY a, b)""")
def _(t):
    return ru.ranking_stability(t.runs, "dataset", "backbone", "gt_roc", PAIRS)


@query("agg23_sweep_one_factor", "knob:s n_values:l best_value:d gain:d",
       """WITH g AS (SELECT l_linenumber AS k1, CAST(l_discount * 100 AS INT) % 3 AS k2, avg(l_quantity) AS mean, avg(l_tax) AS guard FROM lineitem GROUP BY ALL),
          c AS (SELECT mean AS cm, guard AS cg FROM g WHERE k1 = 1 AND k2 = 0),
          o AS (SELECT CASE WHEN k1 <> 1 THEN 'k1' ELSE 'k2' END AS knob, CASE WHEN k1 <> 1 THEN k1 ELSE k2 END AS value, mean, guard >= cg - 0.001 AS safe, cm
            FROM g, c WHERE (k1 <> 1)::INT + (k2 <> 0)::INT = 1)
          SELECT knob, count(*) AS n_values, arg_max(value, (mean, value)) FILTER (safe) AS best_value, max(mean) FILTER (safe) - max(cm) AS gain FROM o GROUP BY 1""")
def _(t):
    runs = t.raw("lineitem").select(
        F.col("l_linenumber").alias("k1"), (F.round(F.col("l_discount") * 100).cast("int") % 3).alias("k2"), "l_quantity", "l_tax"
    )
    return ru.sweep_one_factor(runs, {"k1": 1, "k2": 0}, "l_quantity", "l_tax", 0.001)


@query("agg24_accumulate_extremes", "side:s item_key:s n:l total:d mean:d std:d n_cells:l",
       """WITH o AS (SELECT kind, flag, brand AS item_key, avg(score_a) AS score FROM lines GROUP BY ALL),
          r AS (SELECT *, row_number() OVER (PARTITION BY kind, flag ORDER BY score DESC, item_key) AS hi,
            row_number() OVER (PARTITION BY kind, flag ORDER BY score, item_key) AS lo FROM o)
          SELECT side, item_key, count(*) AS n, sum(score) AS total, avg(score) AS mean, stddev_pop(score) AS std, count(DISTINCT kind || '|' || flag) AS n_cells
          FROM (SELECT 'top' AS side, * FROM r WHERE hi <= 5 UNION ALL SELECT 'bottom', * FROM r WHERE lo <= 5) GROUP BY ALL""")
def _(t):
    p = t.lines.groupBy("kind", "flag", F.col("brand").alias("item_key")).agg(F.avg("score_a").alias("score"))
    return ru.accumulate_extremes(p, ["kind", "flag"], 5)


@query("agg25_dataset_stats", "split:s n:l n_pos:l pos_share:d mean_elements:d mean_edges:d",
       """SELECT split, count(*) AS n, sum(label) AS n_pos, avg(label) AS pos_share, avg(coalesce(k, 0)) AS mean_elements,
            avg(greatest(2 * (coalesce(k, 0) - 1), 0)) AS mean_edges FROM containers
          LEFT JOIN (SELECT container_id, count(*) AS k FROM lines GROUP BY 1) USING (container_id) GROUP BY 1""")
def _(t):
    sizes = t.lines.groupBy("container_id").agg(F.count("*").alias("n_elements"))
    return ru.dataset_stats(t.containers, sizes, ["split"])


@query("agg26_stamp_rules", "dataset:s backbone:s family:s fold:l rule:s",
       """WITH x AS (SELECT rule_id, string_agg('(' || c || ')', ' | ' ORDER BY clause_id) AS rule FROM
            (SELECT rule_id, clause_id, string_agg(item_key, ' & ' ORDER BY item_key) AS c FROM rules GROUP BY ALL) GROUP BY 1)
          SELECT dataset, backbone, family, fold, CASE WHEN dataset = 'NATION_1' THEN 'source' ELSE rule END AS rule
          FROM run_fields LEFT JOIN x ON rule_id = fold AND gt_tier = 'dnf_k2_r1'""")
def _(t):
    source = t.raw("nation").where("n_name = 'NATION_1'").select(F.col("n_name").alias("dataset"), F.lit("source").alias("rule"))
    planted = rl.rule_text(t.rules).select(F.col("rule_id").alias("fold"), F.lit("dnf_k2_r1").alias("gt_tier"), "rule")
    return ru.stamp_rules(t.run_fields, source, planted, ["fold", "gt_tier"])


GRID = """SELECT *, row_number() OVER (ORDER BY dataset, backbone, encoder, norm) AS config_id FROM
   (SELECT DISTINCT dataset, backbone FROM run_fields), (SELECT unnest(['linear', 'onehot']) AS encoder), (SELECT unnest(['batch', 'layer', 'none']) AS norm)
   WHERE NOT (backbone = 'BUILDING' AND norm = 'layer')"""


@query("agg27_enumerate_grid", "dataset:s backbone:s encoder:s norm:s config_id:l", GRID)
def _(t):
    base = t.run_fields.select("dataset", "backbone").distinct()
    axes = {"encoder": ["linear", "onehot"], "norm": ["batch", "layer", "none"]}
    return ru.enumerate_grid(base, axes, (F.col("backbone") == "BUILDING") & (F.col("norm") == "layer"))


@query("agg28_enumerate_cells", "dataset:s tier:s",
       """WITH g AS (SELECT DISTINCT dataset, tier FROM run_fields, (SELECT unnest(['easy', 'dnf_k2_r1', 'dnf_k3_r9']) AS tier)),
          r AS (SELECT DISTINCT dataset, gt_tier AS tier FROM run_fields WHERE gt_tier IS NOT NULL AND dataset <> 'NATION_2')
          SELECT * FROM g WHERE dataset NOT IN (SELECT dataset FROM r) OR (dataset, tier) IN (SELECT (dataset, tier) FROM r)""")
def _(t):
    tiers = F.explode(F.array(F.lit("easy"), F.lit("dnf_k2_r1"), F.lit("dnf_k3_r9"))).alias("tier")
    grid = t.run_fields.select("dataset", tiers)
    rules = t.run_fields.where("gt_tier IS NOT NULL AND dataset <> 'NATION_2'").select("dataset", F.col("gt_tier").alias("tier"))
    return ru.enumerate_cells(grid, rules, ["dataset"])


@query("agg29_shard", "exp_dir:s auc:d",
       "SELECT exp_dir, auc FROM (SELECT *, row_number() OVER (ORDER BY exp_dir) AS r FROM run_fields) WHERE (r - 1) % 4 = 2")
def _(t):
    return ru.shard(t.run_fields.select("exp_dir", "auc"), [F.col("exp_dir")], 2, 4)


@query("agg30_config_hash", "dataset:s backbone:s family:s fold:l config_hash:s",
       """SELECT dataset, backbone, family, fold, substr(sha1('{"backbone":"' || backbone || '","family":"' || family || '","n_rows":' || n_rows || '}'), 1, 10) AS config_hash FROM run_fields""")
def _(t):
    return ru.config_hash(t.run_fields, ["n_rows", "backbone", "family"])


@query("agg31_evaluate_run", "rule_id:l instance_auc:d global_auc:d n_containers:l pearson_u:d spearman_u:d",
       f"""SELECT d.*, c.pearson_u, c.spearman_u FROM ({dnf_sql(NODE_SCORES)}) d,
           (SELECT pearson_u, spearman_u FROM ({correlation_sql(GROUPED_ROWS, 'split')}) WHERE split = 'test' AND unk = 'incl') c""")
def _(t):
    corr = mt.grouped_correlations(grouped_rows(t).where("split = 'test'"), ["split"]).where("unk = 'incl'")
    return mt.dnf_roc(node_scores(t), t.truth).select(
        "*", corr.select("pearson_u").scalar().alias("pearson_u"), corr.select("spearman_u").scalar().alias("spearman_u")
    )


@query("agg32_filter_runs", "dataset:s vocab_variant:s n:l",
       "SELECT dataset, vocab_variant, count(*) AS n FROM run_fields WHERE vocab_variant IN ('v1', 'v1_filter') AND dataset IN ('NATION_1', 'NATION_2') GROUP BY ALL")
def _(t):
    f = ru.filter_runs(t.run_fields, ["v1", "v1_filter"], ["NATION_1", "NATION_2"])
    return f.groupBy("dataset", "vocab_variant").agg(F.count("*").alias("n"))
