"""Quality-gate queries (FLT) with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from incidex.functions.expr import near
from incidex.operators import gates as gt
from incidex.operators import rules as rl
from incidex.operators import vocab as voc
from incidex.plans.bindings import hash_digit, hash_digit_sql
from incidex.plans.registry import query


@query("flt2_no_wildcard", "item_key:s n:l", "SELECT item_key, count(*) AS n FROM lines WHERE NOT contains(item_key, '*') GROUP BY 1")
def _(t):
    ok = gt.assert_no_wildcard(t.lines, "item_key", "container_id")
    return ok.groupBy("item_key").agg(F.count("*").alias("n"))


@query("flt3_text", "lang:s n:l", "SELECT lang, count(*) AS n FROM documents WHERE trim(text) <> '' AND lower(trim(text)) <> 'nan' GROUP BY 1")
def _(t):
    d = t.raw("documents")
    return gt.assert_text(d.where(~gt.is_blank(F.col("text"))), "text", "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query("flt4_require_column", "family:s n:l", "SELECT family, count(*) AS n FROM run_fields GROUP BY 1")
def _(t):
    return gt.require_column(t.run_fields, "vocab_variant").groupBy("family").agg(F.count("*").alias("n"))


def _broken(t):
    """Returned lines lose their part; first lines of accepted goods are listed twice."""
    e = t.elements.select("container_id", "element_id", "flag", "item_key", "part_id")
    return e.where("flag <> 'R'").unionByName(e.where("flag = 'A' AND element_id = 1"))


@query("flt5_partition_violations", "container_id:l element_id:l kind:s",
       """SELECT container_id, element_id, CASE WHEN flag = 'R' THEN 'missing' ELSE 'overlap' END AS kind FROM elements
          WHERE flag = 'R' OR (flag = 'A' AND element_id = 1)""")
def _(t):
    return gt.partition_violations(_broken(t), t.elements)


@query("flt6_verify_cover", "n_missing:l n_overlap:l n_torn:l",
       """SELECT (SELECT count(*) FROM elements WHERE flag = 'N') AS n_missing, 0 AS n_overlap,
            (SELECT count(*) FROM (SELECT container_id, item_key FROM lines GROUP BY ALL
               HAVING count(DISTINCT CASE WHEN flag <> 'N' THEN part_id END) <> 1)) AS n_torn""")
def _(t):
    e = t.elements
    blocks = e.select("container_id", "part_id", "element_id")
    chosen = e.where("flag <> 'N'").select("container_id", "part_id").distinct()
    return gt.verify_cover(blocks, chosen, e.select("container_id", "element_id", F.col("item_key").alias("set_id")))


def _sizes(t):
    return t.lines.groupBy("container_id").agg(F.count("*").alias("n_elements"))


@query("flt7_membership_state", "state:s n:l",
       """SELECT CASE WHEN hi >= 0 THEN 'known' WHEN n = m THEN 'all_unknown' ELSE 'incomplete' END AS state, count(*) AS n FROM
          (SELECT container_id, max(item_id) AS hi, count(*) AS n FROM lookup WHERE flag <> 'R' GROUP BY 1)
          JOIN (SELECT container_id, count(*) AS m FROM lines GROUP BY 1) USING (container_id) GROUP BY 1""")
def _(t):
    states = gt.membership_state(t.lookup.where("flag <> 'R'"), _sizes(t))
    return states.groupBy("state").agg(F.count("*").alias("n"))


@query("flt7_validate_membership", "state:s n:l",
       """SELECT CASE WHEN hi >= 0 THEN 'known' ELSE 'all_unknown' END AS state, count(*) AS n FROM
          (SELECT container_id, max(item_id) AS hi FROM lookup GROUP BY 1) GROUP BY 1""")
def _(t):
    return gt.validate_membership(t.lookup, _sizes(t), filtered=True).groupBy("state").agg(F.count("*").alias("n"))


@query("flt8_unknown_guard", "n:l n_unknown:l fraction:d state:s",
       """SELECT n, n_unknown, n_unknown / n AS fraction, CASE WHEN n_unknown / n > 0.9 THEN 'fail' WHEN n_unknown / n >= 0.25 THEN 'report' ELSE 'ok' END AS state
          FROM (SELECT count(*) AS n, count(*) FILTER (container_id NOT IN (SELECT container_id FROM lookup WHERE item_id >= 0)) AS n_unknown FROM containers)""")
def _(t):
    return gt.unknown_guard(t.lookup, t.containers)


FEW = "(SELECT item_key FROM brand_vocab WHERE n_containers >= (SELECT 0.145 * count(*) FROM containers))"


def _few(t):
    return t.brand_vocab.where(F.col("n_containers") >= 0.145 * t.n_containers)


@query("flt9_rule_items_dropped", "rule_id:l clause_id:l item_key:s", f"SELECT * FROM rules WHERE item_key NOT IN {FEW}")
def _(t):
    return gt.rule_items_dropped(t.rules, _few(t))


@query("flt10_rule_unknown_conflicts", "rule_id:l container_id:l element_id:l item_key:s",
       f"""SELECT rule_id, container_id, element_id, item_key FROM truth WHERE kind = 'node' AND item_key NOT IN {FEW}""")
def _(t):
    fired = rl.fired_clauses(t.brand_incidence, t.rules)
    ids = voc.build_lookup(t.brand_elements, t.brand_vocab, _few(t))
    return gt.rule_unknown_conflicts(fired, t.rules, ids)


@query("flt11_out_of_bounds", "container_id:l element_id:l",
       """SELECT container_id, l_linenumber AS element_id FROM lines JOIN
          (SELECT container_id, count(*) AS n FROM lines GROUP BY 1) USING (container_id) WHERE l_linenumber > n OR l_linenumber < 1""")
def _(t):
    # raw line numbers are no element ids: many exceed the number of lines
    return gt.out_of_bounds(t.lines.select("container_id", F.col("l_linenumber").alias("element_id")), _sizes(t))


@query("flt12_validate_splits", "check:s n:l",
       """WITH s AS (SELECT container_id, split FROM fold_splits WHERE fold = 0 AND split <> 'test'
             UNION ALL SELECT container_id, split FROM fold_splits WHERE fold = 1 AND split = 'test'),
          c AS (SELECT container_id, CAST(custkey AS VARCHAR) AS text, price > 1000 AS ok FROM containers WHERE label = 0 OR split <> 'valid'),
          m AS (SELECT CAST(c_custkey AS VARCHAR) AS text FROM customer)
          SELECT 'not_converted' AS check, count(*) AS n FROM c WHERE NOT ok
          UNION ALL SELECT 'empty_text', count(*) FROM c WHERE trim(text) = ''
          UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT 1 FROM c GROUP BY container_id HAVING count(*) > 1)
          UNION ALL SELECT 'not_disjoint', count(*) FROM (SELECT 1 FROM s GROUP BY container_id HAVING count(*) > 1)
          UNION ALL SELECT 'only_in_splits', count(DISTINCT container_id) FROM s WHERE container_id NOT IN (SELECT container_id FROM c)
          UNION ALL SELECT 'only_in_table', count(DISTINCT container_id) FROM c WHERE container_id NOT IN (SELECT container_id FROM s)
          UNION ALL SELECT 'no_map', count(DISTINCT text) FROM c WHERE text NOT IN (SELECT text FROM m)
          UNION ALL SELECT 'extra_map', count(DISTINCT text) FROM m WHERE text NOT IN (SELECT text FROM c)""")
def _(t):
    f = t.fold_splits
    s = f.where("fold = 0 AND split <> 'test'").unionByName(f.where("fold = 1 AND split = 'test'")).select("container_id", "split")
    c = t.containers.where("label = 0 OR split <> 'valid'").select(
        "container_id", F.col("custkey").cast("string").alias("text"), (F.col("price") > 1000).alias("ok")
    )
    return gt.validate_splits(c, s, t.raw("customer").select(F.col("c_custkey").cast("string").alias("text")))


@query("flt13_verify_labels", "rule_id:l n:l agreement:d false_pos:l false_neg:l neg_with_marks:l pos_mismatch:l",
       """WITH e AS (SELECT DISTINCT rule_id, container_id, element_id FROM truth WHERE kind = 'node'),
          m AS (SELECT DISTINCT rule_id, container_id, element_id FROM truth WHERE kind = 'clause' AND ordinal <= 1),
          d AS (SELECT rule_id, container_id, count(m.container_id) AS nm, count(*) FILTER (m.container_id IS NULL OR e.container_id IS NULL) AS nd
            FROM m FULL JOIN e USING (rule_id, container_id, element_id) GROUP BY ALL)
          SELECT rule_id, count(*) AS n, avg(CAST(label = synth AS INT)) AS agreement, count(*) FILTER (label = 1 AND synth = 0) AS false_pos,
            count(*) FILTER (label = 0 AND synth = 1) AS false_neg, count(*) FILTER (label = 0 AND nm > 0) AS neg_with_marks,
            count(*) FILTER (label = 1 AND nd > 0) AS pos_mismatch
          FROM labelled LEFT JOIN d USING (rule_id, container_id) GROUP BY rule_id""")
def _(t):
    lab = rl.apply_rules(t.containers, t.brand_incidence, t.rules)
    return gt.verify_labels(lab, t.truth.where("kind = 'clause' AND ordinal <= 1"), t.truth.where("kind = 'node'"))


@query("flt14_method_state", "run:s method:s state:s reason:s",
       """WITH m AS (SELECT unnest(['a', 'b', 'flat', 'part']) AS method), l AS (SELECT * FROM lines JOIN containers USING (container_id)),
          s AS (SELECT kind AS run, method, brand, avg(CASE method WHEN 'a' THEN score_a WHEN 'b' THEN score_b WHEN 'part' THEN score_c ELSE 1 END) AS score
            FROM l, m GROUP BY ALL)
          SELECT run, method, CASE WHEN method = 'part' THEN 'PARTIAL' WHEN count(DISTINCT round(score, 12)) <= 1 THEN 'DEGENERATE' ELSE 'VALID' END AS state,
            CASE WHEN method = 'part' THEN 'files absent' WHEN count(DISTINCT round(score, 12)) <= 1 THEN 'constant score' ELSE '' END AS reason FROM s GROUP BY run, method""")
def _(t):
    score = {"a": "score_a", "b": "score_b", "part": "score_c"}
    cols = [F.struct(F.lit(m).alias("method"), F.col(c).alias("score")) for m, c in score.items()]
    cols.append(F.struct(F.lit("flat").alias("method"), F.lit(1.0).alias("score")))
    long = t.lines.select(F.col("kind").alias("run"), "brand", "container_id", F.explode(F.array(*cols)).alias("m")).select(
        "run", "brand", "container_id", "m.method", "m.score"
    )
    items = long.groupBy("run", "method", "brand").agg(F.avg("score").alias("score"))
    flat = long.groupBy("run", "method", "container_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    # containers with a single line are flat by nature; the measured range is per whole run instead
    per_run = flat.groupBy("run", "method").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("container_id", F.lit(0))
    years = t.lines.select(F.col("kind").alias("run"), F.year("l_shipdate").alias("y")).distinct().groupBy("run").agg(F.count("*").alias("y"))
    methods = F.explode(F.array(*[F.lit(m) for m in ("a", "b", "flat", "part")])).alias("method")
    files = years.select("run", "y", methods).select(
        "run", "method", F.when(F.col("method") == "part", 1).otherwise(F.least("y", F.lit(3))).alias("n_files")
    )
    return gt.method_state(items, per_run, files, required=3)


@query("flt15_conflated_cells", "dataset:s backbone:s fold:l n_configs:l",
       "SELECT dataset, backbone, fold, count(DISTINCT vocab_variant) AS n_configs FROM run_fields GROUP BY ALL HAVING count(DISTINCT vocab_variant) > 1")
def _(t):
    return gt.conflated_cells(t.run_fields, ["dataset", "backbone", "fold"], "vocab_variant")


@query("flt16_fold_distribution", "n_folds:l n_cells:l",
       "SELECT n_folds, count(*) AS n_cells FROM (SELECT count(*) AS n_folds FROM runs GROUP BY dataset, backbone, family) GROUP BY 1")
def _(t):
    return gt.assert_folds(t.runs, ["dataset", "backbone", "family"])


@query("flt17_prediction_rows", "family:s dataset:s fold:l backbone:s",
       "SELECT family, dataset, fold, backbone FROM run_fields WHERE family IN ('urgent', 'low')")
def _(t):
    return t.run_fields.where(F.col("family").isin("urgent", "low"))


@query("flt18_scope", "scope:s n:l",
       r"""WITH b AS (SELECT regexp_replace(vocab_variant, '(_filter)?(_relabelled(_(easy|medium|hard))?)?$', '') AS v FROM run_fields)
           SELECT 'main' AS scope, count(*) AS n FROM b WHERE starts_with(v, 'v1') OR starts_with(v, 'v2')
           UNION ALL SELECT 'rest', count(*) FROM b WHERE v NOT IN ('v3') UNION ALL SELECT 'all', count(*) FROM b""")
def _(t):
    out = None
    for name in ("main", "rest", "all"):
        one = gt.scope(t.run_fields, name, ["v1", "v2"], ["v3"]).agg(F.lit(name).alias("scope"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


SINGLE = "(SELECT n_name AS dataset FROM nation WHERE n_regionkey = 0)"


def _single(t):
    return t.raw("nation").where("n_regionkey = 0").select(F.col("n_name").alias("dataset"))


@query("flt19_collapse_folds", "dataset:s backbone:s family:s fold:l",
       f"""SELECT dataset, backbone, family, fold FROM run_fields r WHERE dataset NOT IN {SINGLE}
           OR fold = (SELECT min(fold) FROM run_fields q WHERE q.dataset = r.dataset)""")
def _(t):
    return gt.collapse_folds(t.run_fields, _single(t))


@query("flt20_rule_tasks", "task:s n:l",
       "SELECT 'BinaryClass' AS task, count(*) AS n FROM containers WHERE label IS NOT NULL")
def _(t):
    registry = {"orders": "BinaryClass", "price": "Regression"}
    gt.assert_task(registry, "orders")
    return t.containers.where("label IS NOT NULL").agg(F.lit(registry["orders"]).alias("task"), F.count("*").alias("n"))


@query("flt21_truth_containers", "rule_id:l container_id:l",
       "SELECT DISTINCT rule_id, container_id FROM truth JOIN containers USING (container_id) WHERE split = 'test' AND label = 1")
def _(t):
    return gt.truth_containers(t.containers, t.truth)


@query("flt22_has_truth", "rule_id:l kind:s present:b",
       """SELECT rule_id, kind, EXISTS (SELECT 1 FROM truth x WHERE x.rule_id = r.rule_id AND x.kind = k.kind) AS present
          FROM (SELECT DISTINCT rule_id FROM rules) r, (SELECT unnest(['node', 'family', 'absent']) AS kind) k""")
def _(t):
    return gt.has_truth(t.rules, t.truth, ("node", "family", "absent"))


@query("flt23_scope_lists", "dataset:s backbone:s family:s fold:l",
       """SELECT dataset, backbone, family, fold FROM run_fields WHERE backbone IN ('BUILDING', 'MACHINERY') AND family IN ('urgent', 'high')
          AND fold IN (0, 1, 2) AND dataset <> 'NATION_0' AND coalesce(gt_tier, '') <> 'odd'""")
def _(t):
    c = F.col
    return t.run_fields.where(
        c("backbone").isin("BUILDING", "MACHINERY") & c("family").isin("urgent", "high") & c("fold").isin(0, 1, 2)
        & (c("dataset") != "NATION_0") & (F.coalesce("gt_tier", F.lit("")) != "odd")
    )


NORM = r"""SELECT *, CASE WHEN gt OR is_relabelled THEN 'gt' ELSE 'real' END AS synthetic FROM (
   SELECT *, tier <> 'none' OR bare <> vocab_variant AS is_relabelled, regexp_replace(bare, '_filter$', '') AS vocab_base, ends_with(bare, '_filter') AS is_filter FROM (
   SELECT *, CASE WHEN family = 'low' THEN 'medium' ELSE family END AS family_norm,
     regexp_replace(vocab_variant, '_relabelled(_(easy|medium|hard))?$', '') AS bare,
     CASE WHEN coalesce(regexp_full_match(gt_tier, 'easy|medium|hard|dnf_k[0-9]+_r[0-9]+(_rare)?'), false) THEN gt_tier
       WHEN ends_with(vocab_variant, '_relabelled_easy') THEN 'easy' ELSE 'none' END AS tier,
     use_gt IN ('true', '1') AS gt,
     CASE WHEN family = 'urgent' THEN 'na' ELSE CAST(w_feat AS INT) || '' || CAST(w_message AS INT) || '0' END AS injection,
     'runs/' || family || '/' || dataset || '/' || vocab_variant || '/bb-' || backbone || '_enc-onehot' AS config_sig FROM run_fields))"""


def _norm(t):
    return gt.normalise(t.run_fields, {"low": "medium"}, ["urgent"])


@query("flt24_normalise",
       "dataset:s backbone:s fold:l family:s family_norm:s vocab_base:s is_filter:b is_relabelled:b tier:s synthetic:s injection:s", NORM)
def _(t):
    return _norm(t)


@query("flt25_config_signature", "config_sig:s n:l", f"SELECT config_sig, count(*) AS n FROM ({NORM}) GROUP BY 1")
def _(t):
    return t.run_fields.groupBy(gt.config_signature(F.col("exp_dir")).alias("config_sig")).agg(F.count("*").alias("n"))


@query("flt26_alias_columns", "dataset:s fold:l backbone:s family:s score:d",
       "SELECT dataset, fold, backbone, family, coalesce(CASE WHEN n_rows % 2 = 0 THEN pearson_mean END, pearson_max) AS score FROM run_fields")
def _(t):
    df = t.run_fields.withColumn("score", F.when(F.col("n_rows") % 2 == 0, F.col("pearson_mean")))
    return gt.alias_columns(df, {"pearson_max": "score", "absent": "score"})


@query("flt27_performance", "dataset:s fold:l backbone:s family:s perf:d",
       """SELECT dataset, fold, backbone, family, CASE WHEN fold = 0 THEN mae WHEN n_rows % 5 <> 0 THEN auc ELSE pearson_mean END AS perf FROM run_fields""")
def _(t):
    nan = F.lit(float("nan"))
    df = t.run_fields.select(
        "dataset", "fold", "backbone", "family",
        F.when(F.col("n_rows") % 5 != 0, F.col("auc")).otherwise(nan).alias("auc"),
        F.col("pearson_mean").alias("pearson"), "mae",
        *[F.lit(None).cast("double").alias(c) for c in ("rmse_orig", "mae_orig", "rmse")],
    )
    task = F.when(F.col("fold") == 0, "Regression").otherwise("BinaryClass")
    return df.withColumn("perf", gt.performance(task))


KEYS = ["dataset", "backbone", "family", "fold"]


@query("flt28_fill_pooled", "dataset:s backbone:s family:s fold:l pooled:d",
       """SELECT dataset, backbone, family, fold, CASE WHEN n_rows % 3 = 0 THEN pearson_max WHEN n_rows % 2 = 0 THEN gt_roc ELSE pearson_mean END AS pooled FROM run_fields""")
def _(t):
    df = t.run_fields.withColumn("pooled", F.when(F.col("n_rows") % 3 == 0, F.col("pearson_max")))
    side = t.run_fields.where("n_rows % 2 = 0").select(*KEYS, F.col("gt_roc").alias("pooled"))
    return gt.fill_pooled(df, side, KEYS, "pooled", "pearson_mean")


@query("flt29_fill_diagnostics", "dataset:s backbone:s auc_0:d auc_1:d gt_roc:d",
       """SELECT dataset, backbone, max(auc) FILTER (fold = 0) AS auc_0, max(auc) FILTER (fold = 1) AS auc_1, min(gt_roc) AS gt_roc
          FROM run_fields WHERE family = 'high' GROUP BY ALL""")
def _(t):
    side = t.run_fields.where("family = 'high'").groupBy("dataset", "backbone", F.col("fold").cast("string").alias("subset")).agg(F.max("auc").alias("auc"))
    same = t.run_fields.where("family = 'high'").groupBy("dataset", "backbone").agg(F.min("gt_roc").alias("gt_roc"))
    side = side.join(same, ["dataset", "backbone"])
    base = side.select("dataset", "backbone").distinct()
    return gt.fill_diagnostics(base, side, ["dataset", "backbone"], ["0", "1"], "auc", "gt_roc")


@query("flt30_near", "close:b n:l",
       """SELECT abs(mae - mae * (1 + (n_rows % 3) * 1e-6)) <= 1e-12 + 1e-6 * abs(mae * (1 + (n_rows % 3) * 1e-6)) AS close, count(*) AS n FROM runs GROUP BY 1""")
def _(t):
    moved = F.col("mae") * (1 + (F.col("n_rows") % 3) * F.lit(1e-6))
    return t.runs.groupBy(near(F.col("mae"), moved).alias("close")).agg(F.count("*").alias("n"))


@query("flt31_selfcheck", "n:l n_ok:l worst:d n_bad:l",
       """SELECT count(*) AS n, count(*) FILTER (n_rows % 7 <> 0) AS n_ok, 0.01 AS worst, count(*) FILTER (n_rows % 7 = 0) AS n_bad FROM runs""")
def _(t):
    stored = t.runs.withColumn("auc", F.when(F.col("n_rows") % 7 == 0, F.col("auc") + 0.01).otherwise(F.col("auc")))
    return gt.selfcheck(t.runs, stored, KEYS, "auc")


@query("flt31_mismatches", "dataset:s backbone:s family:s fold:l",
       "SELECT dataset, backbone, family, fold FROM runs WHERE n_rows % 7 = 0 ORDER BY dataset, backbone, family, fold LIMIT 10")
def _(t):
    stored = t.runs.withColumn("auc", F.when(F.col("n_rows") % 7 == 0, F.col("auc") + 0.01).otherwise(F.col("auc")))
    return gt.mismatches(t.runs, stored, KEYS, "auc")


@query("flt32_report_metrics", "metric:s mean:d",
       "SELECT 'auc' AS metric, avg(auc) AS mean FROM runs UNION ALL SELECT 'score_max', avg(pearson_max) FROM runs UNION ALL SELECT 'mae', avg(mae) FROM runs")
def _(t):
    df = t.runs.select("auc", "mae", F.col("pearson_max").alias("score_max"), "dataset")
    names = gt.report_metrics(df, ["auc", "absent"])
    wide = df.agg(*[F.avg(n).alias(n) for n in names])
    return wide.unpivot([], names, "metric", "mean")


@query("flt33_alignment", "reason:s n:l",
       f"""SELECT CASE WHEN flag = 'R' THEN 'unmapped' WHEN {hash_digit_sql('container_id', 'k', 1, 10)} = 0 THEN 'unknown_kind'
             WHEN {hash_digit_sql('container_id', 'k', 1, 10)} = 1 AND kind <> 'LARGE' THEN 'kind_differs' END AS reason, count(*) AS n
           FROM elements WHERE kind <> 'SMALL' GROUP BY 1 HAVING reason IS NOT NULL""")
def _(t):
    a = t.elements.select("container_id", "element_id", "kind", "flag")
    d = hash_digit(F.col("container_id"), "k", 1, 10)
    b = a.where("flag <> 'R'").withColumn("kind", F.when(d == 0, "?").when(d == 1, "LARGE").otherwise(F.col("kind")))
    return gt.alignment(a, b, skip="SMALL").groupBy("reason").agg(F.count("*").alias("n"))


