"""Source and sink queries (SRC, SNK): Spark writes the derived files, the readers read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from incidex.plans.registry import query
from incidex.plans.scoring import POINTS, points
from incidex.session import cut_lineage, scratch_path
from incidex.sinks import writers as wr
from incidex.sources import readers as rd

KEYS = ["dataset", "backbone", "family", "fold"]


@query("src1_read_fold", "container_id:l text:s label:l split:s",
       "SELECT container_id, CAST(custkey AS VARCHAR) AS text, label, CASE WHEN label = 1 THEN split ELSE 'training' END AS split FROM containers")
def _(t):
    path = scratch_path(t.spark, "folds")
    c = t.containers.select("container_id", F.col("custkey").cast("string").alias("text"), F.col("label").alias("is_f"),
                            F.when(F.col("label") == 1, F.col("split")).alias("split"))
    c.write.csv(path, header=True)
    return rd.read_fold(t.spark, path, "is_f", "container_id long, text string, is_f int, split string")


@query("src2_read_labelled", "row_index:l label:l split:s", "SELECT container_id AS row_index, label, split FROM containers WHERE price > 200000")
def _(t):
    path = scratch_path(t.spark, "labelled")
    c = t.containers.select(F.col("container_id").alias("row_index"), F.when(F.col("price") > 200000, F.col("label")).alias("y"))
    c.write.option("compression", "gzip").csv(path, header=True)
    official = t.containers.select(F.col("container_id").alias("row_index"), "split")
    return rd.read_labelled(t.spark, path, "row_index long, y int", "y", official)


@query("src3_local_edges", "container_id:l src:l dst:l", "SELECT container_id, src - 1 AS src, dst - 1 AS dst FROM edges")
def _(t):
    node = F.col("container_id") * 1000000
    members = t.brand_elements.select((node + F.col("element_id")).alias("node"), "container_id")
    e = t.edges.select((node + F.col("src")).alias("src"), (node + F.col("dst")).alias("dst"))
    return rd.local_edges(e, members)


@query("src4_edge_truth", "container_id:l element_id:l",
       """SELECT DISTINCT container_id, unnest([src, dst]) AS element_id FROM edges JOIN containers USING (container_id) WHERE label = 0 AND (src + dst) % 4 = 1""")
def _(t):
    y = F.when((F.col("src") + F.col("dst")) % 4 == 1, 1).otherwise(0)
    return rd.edge_truth(t.edges.withColumn("y", y), t.containers)




RUN_SCHEMA = "dataset string, fold long, family string, auc double, run_timestamp string, nested struct<a:double>"


def _tree(t) -> str:
    """A tree of indented ``summary.json`` files, one folder per run; some folders are archived, some files broken."""
    root = scratch_path(t.spark, "archive-runs")  # a root that looks archived itself is no reason to skip
    body = F.to_json(F.struct("dataset", "fold", "family", "auc", F.struct(F.col("mae").alias("a")).alias("nested")), {"pretty": "true"})
    top = F.when(F.col("n_rows") % 7 == 3, F.lit("_archive_2020")).otherwise(F.lit("live"))
    path = F.concat_ws("/", top, F.col("exp_dir"), F.lit("summary.json"))
    content = F.when(F.col("n_rows") % 5 == 0, F.concat(F.lit("{"), body)).otherwise(body)
    wr.write_files(t.run_fields.select(path.alias("path"), content.alias("content")), root)
    other = t.run_fields.select(F.concat("exp_dir", F.lit("/notes.json")).alias("path"), F.lit("[]").alias("content"))
    wr.write_files(other, root)
    return root


LIVE = "FROM (SELECT * FROM run_fields QUALIFY row_number() OVER (PARTITION BY exp_dir, n_rows % 7 = 3 ORDER BY n_rows) >= 1) WHERE n_rows % 7 <> 3"


@query("src5_scan_runs", "dataset:s fold:l family:s auc:d",
       f"SELECT dataset, fold, family, auc {LIVE} AND n_rows % 5 <> 0 AND dataset IN ('NATION_1', 'NATION_2')")
def _(t):
    return rd.scan_runs(t.spark, _tree(t), datasets=["NATION_1", "NATION_2"], schema=RUN_SCHEMA)


@query("src6_flatten_summary", "family:s n:l n_stamped:l n_columns:l",
       f"SELECT family, count(*) AS n, count(*) AS n_stamped, 7 AS n_columns {LIVE} AND n_rows % 5 <> 0 GROUP BY 1")
def _(t):
    flat = rd.flatten_summary(rd.scan_runs(t.spark, _tree(t), schema=RUN_SCHEMA))
    width = F.lit(len(flat.columns))
    return flat.groupBy("family").agg(F.count("*").alias("n"), F.count("stamp").alias("n_stamped")).withColumn("n_columns", width)


@query("src7_harvest", "found:l harvested:l skipped:l",
       f"SELECT count(*) AS found, count(*) FILTER (n_rows % 5 <> 0) AS harvested, count(*) FILTER (n_rows % 5 = 0) AS skipped {LIVE}")
def _(t):
    return rd.harvest(t.spark, _tree(t), schema=RUN_SCHEMA)


@query("src8_metrics_wide", "dataset:s backbone:s family:s fold:l method:s auc_test:d auc_valid:d",
       """SELECT dataset, backbone, family, fold, 'a' AS method, auc AS auc_test, pearson_mean AS auc_valid FROM runs
          UNION ALL SELECT dataset, backbone, family, fold, 'b', gt_roc, NULL FROM runs""")
def _(t):
    one = lambda c: F.create_map(F.lit("auc"), F.col(c))
    methods = F.create_map(F.lit("a"), F.create_map(F.lit("test"), one("auc"), F.lit("valid"), one("pearson_mean")),
                           F.lit("b"), F.create_map(F.lit("test"), one("gt_roc")))
    return rd.metrics_wide(t.runs.select(*KEYS, methods.alias("methods")), KEYS, ["auc_test", "auc_valid"])


@query("src9_parse_run_path", "family:s dataset:s fold:l base:s filtered:b backbone:s tier:s",
       """SELECT family, dataset, fold, regexp_replace(vocab_variant, '_filter.*$', '') AS base, contains(vocab_variant, '_filter') AS filtered, backbone, 'none' AS tier FROM run_fields""")
def _(t):
    return t.run_fields.select(*rd.parse_run_path(F.col("exp_dir")))


@query("src10_parse_ablation", "backbone:s encoder:s n:l", "SELECT backbone, 'onehot' AS encoder, count(*) AS n FROM run_fields GROUP BY 1")
def _(t):
    return t.run_fields.select(*rd.parse_run_path(F.col("exp_dir"))).groupBy("backbone", "encoder").agg(F.count("*").alias("n"))


@query("src11_read_impact", "item_key:s container_id:l impact:d", f"SELECT item_key, container_id, impact FROM {POINTS}")
def _(t):
    entry = F.struct(F.col("item_key"), F.create_map(F.col("container_id").cast("string"), F.col("impact")))
    raw = points(t).select(F.to_json(F.map_from_entries(F.array(entry))).alias("js"))
    return rd.read_impact(raw, [], "js")


@query("src12_read_scores", "split:s container_id:l method:s n:l total:d",
       "SELECT split, container_id, 'price' AS method, count(*) AS n, sum(score_b) AS total FROM lines JOIN containers USING (container_id) GROUP BY ALL")
def _(t):
    # short arrays, so that no container has to be gathered in one place
    arr = t.lines.join(t.containers.select("container_id", "split"), "container_id").select("split", "container_id", F.array("score_b").alias("v"))
    js = F.to_json(F.create_map("split", F.create_map(F.lit("price"), F.create_map(F.col("container_id").cast("string"), F.col("v")))))
    s = rd.read_scores(arr.select(js.alias("js")), [], "js")
    return s.groupBy("split", "container_id", "method").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("src13_read_correlations", "method:s r:d", "SELECT family || dataset || backbone || fold AS method, CASE WHEN n_rows % 3 = 0 THEN NULL ELSE auc END AS r FROM runs")
def _(t):
    path = scratch_path(t.spark, "corr")
    r = F.when(F.col("n_rows") % 3 == 0, "n/a").otherwise(F.col("auc").cast("string"))
    t.runs.select(F.concat("family", "dataset", "backbone", F.col("fold").cast("string")).alias("method"), r.alias("r")).write.csv(path, header=True)
    return rd.read_correlations(t.spark, path)


@query("src15_load_incidence", "container_id:l item_key:s", "SELECT * FROM brand_incidence")
def _(t):
    cols = t.brand_vocab.select(F.col("item_id").alias("col"), "item_key")
    coo = t.brand_incidence.join(cols, "item_key").select(F.col("container_id").alias("row"), "col")
    return rd.load_incidence(coo, t.containers.select(F.col("container_id").alias("row"), "container_id"), cols)


@query("src14_collect_points", "run:s family:s dataset:s backbone:s item_key:s n:l score:d",
       """WITH f AS (SELECT *, exp_dir AS run FROM run_fields), p AS (SELECT brand AS item_key, score_a FROM lines JOIN containers USING (container_id) WHERE split = 'test'),
          i AS (SELECT item_key, count(*) AS n, avg(score_a) AS score FROM p GROUP BY 1)
          SELECT DISTINCT run, family, dataset, backbone, item_key, n, score + CASE WHEN has THEN 0 ELSE 1 END AS score
          FROM (SELECT run, family, dataset, backbone, bool_or(n_rows % 3 <> 0) AS has FROM f GROUP BY ALL), i""")
def _(t):
    runs = t.run_fields.select(F.col("exp_dir").alias("run"), "n_rows")
    test = t.lines.join(t.containers.where("split = 'test'").select("container_id"), "container_id")
    items = test.groupBy(F.col("brand").alias("item_key")).agg(F.count("*").alias("n"), F.avg("score_a").alias("score"))
    files = runs.where("n_rows % 3 <> 0").select("run", F.lit("points").alias("file")).unionByName(runs.select("run", F.lit("old_points").alias("file"))).distinct()
    kinds = F.explode(F.array(F.lit("label"), F.lit("margin"))).alias("kind")
    rows = files.select("*", kinds).join(items.withColumn("one", F.lit(1)), F.lit(1) == F.col("one")).select(
        "run", "file", "kind", "item_key", F.col("n").alias("container_id"),
        (F.col("score") + F.when(F.col("file") == "points", 0).otherwise(1)).alias("score"), F.lit(0.0).alias("impact"),
    )
    got = rd.collect_points(rows, "label", "points", "old_points")
    return got.select("run", "family", "dataset", "backbone", "item_key", F.col("container_id").alias("n"), "score")


@query("src16_read_predictions", "dataset:s backbone:s family:s fold:l split:s auc:d mae:d",
       """SELECT dataset, backbone, family, fold, 'test' AS split, auc, mae FROM runs UNION ALL SELECT dataset, backbone, family, fold, 'valid', gt_roc, NULL FROM runs""")
def _(t):
    m = lambda **kv: F.create_map(*[x for k, c in kv.items() for x in (F.lit(k), F.col(c))])
    js = F.to_json(F.create_map(F.lit("test"), m(auc="auc", mae="mae", other="pearson_max"), F.lit("valid"), m(auc="gt_roc")))
    return rd.read_predictions(t.runs.select(*KEYS, js.alias("js")), KEYS, "js", ["auc", "mae"])


@query("src17_pooled_points", "split:s item_key:s score:d impact:d",
       f"""SELECT split, item_key, avg(score) AS score, avg(impact) AS impact FROM {POINTS} JOIN containers USING (container_id) GROUP BY ALL HAVING avg(impact) IS NOT NULL""")
def _(t):
    means = _split_points(t).groupBy("split", "item_key").agg(F.avg("score").alias("score"), F.avg("impact").alias("impact"))
    means = cut_lineage(means)
    scores, impacts = scratch_path(t.spark, "scores"), scratch_path(t.spark, "impacts")
    means.select("item_key", "score", "split").write.partitionBy("split").csv(scores, header=True)
    means.where("impact is not null").select("item_key", "impact", "split").write.partitionBy("split").csv(impacts, header=True)
    return rd.pooled_points(t.spark, scores, impacts)


def _split_points(t):
    return points(t).join(t.containers.select("container_id", "split"), "container_id")


SPLIT_POINTS = f"(SELECT p.*, split FROM {POINTS} p JOIN containers USING (container_id))"


@query("snk6_write_points", "method:s split:s item_key:s n:l score:d impact:d",
       f"SELECT 'price' AS method, split, item_key, count(*) AS n, sum(score) AS score, sum(impact) AS impact FROM {SPLIT_POINTS} GROUP BY ALL")
def _(t):
    root = scratch_path(t.spark, "points")
    wr.write_points(_split_points(t).withColumn("method", F.lit("price")), root)
    s, i = t.spark.read.parquet(f"{root}/score"), t.spark.read.parquet(f"{root}/impact")
    keys = ["method", "split", "item_key", "container_id"]
    return s.join(i, keys).groupBy(*keys[:3]).agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.sum("impact").alias("impact"))


@query("snk8_write_global", "method:s split:s n:l score:d",
       f"""SELECT 'price' AS method, split, count(*) AS n, avg(score) AS score FROM {SPLIT_POINTS} GROUP BY ALL
           UNION ALL SELECT 'impact', split, count(*), avg(impact) FROM {SPLIT_POINTS} GROUP BY ALL""")
def _(t):
    path = scratch_path(t.spark, "global")
    p = _split_points(t)
    one = lambda method, c: p.select(F.lit(method).alias("method"), "split", "item_key", "container_id", F.col(c).alias("score"))
    wr.write_global([one("price", "score"), one("impact", "impact")], path)
    return t.spark.read.parquet(path).groupBy("method", "split").agg(F.count("*").alias("n"), F.avg("score").alias("score"))


@query("snk9_write_instance", "split:s container_id:l n:l pearson:d",
       f"""SELECT split, container_id, count(*) AS n, CASE WHEN count(*) > 1 AND stddev_pop(score) > 0 AND stddev_pop(impact) > 0 THEN corr(score, impact) END AS pearson
           FROM {SPLIT_POINTS} GROUP BY ALL""")
def _(t):
    path = scratch_path(t.spark, "instance")
    wr.write_instance(_split_points(t), path)
    return t.spark.read.parquet(path)


@query("snk11_log_scalars", "epoch:d name:s loss:d auc:d",
       """SELECT CAST(fold AS DOUBLE) AS epoch, dataset AS name, sum(mae) AS loss, NULL AS auc FROM runs GROUP BY ALL
          UNION ALL SELECT CAST(fold AS DOUBLE), dataset, NULL, avg(auc) FROM runs GROUP BY ALL""")
def _(t):
    path = scratch_path(t.spark, "scalars")
    per = t.runs.groupBy(F.col("fold").alias("epoch"), F.col("dataset").alias("name"))
    for part in (per.agg(F.sum("mae").alias("loss")), per.agg(F.avg("auc").alias("auc"))):
        wr.log_scalars(part, path, ["epoch", "name", "loss", "auc"])
    return t.spark.read.parquet(path)


@query("snk12_write_sheets", "regime:s sheet:s config_id:s auc:d",
       """SELECT CASE WHEN fold < 2 THEN 'early' ELSE 'late' END AS regime, family AS sheet,
            'dataset=' || dataset || ' | backbone=' || backbone || ' | none=-' AS config_id, auc FROM runs""")
def _(t):
    path = scratch_path(t.spark, "sheets")
    regime = F.when(F.col("fold") < 2, "early").otherwise("late")
    df = t.runs.select(regime.alias("regime"), F.col("family").alias("sheet"), "dataset", "backbone", F.lit(None).cast("string").alias("none"), "auc")
    wr.write_sheets(df, ["dataset", "backbone", "none"], path)
    return t.spark.read.parquet(path)


@query("snk14_result_frames", "side:s item_key:s score:d impact:d share:d n:l",
       f"""WITH i AS (SELECT item_key, avg(score) AS score, avg(impact) AS impact, count(*) AS n FROM {POINTS} GROUP BY 1),
             c AS (SELECT item_key, avg(label) AS share FROM brand_incidence JOIN containers USING (container_id) GROUP BY 1), j AS (SELECT * FROM i JOIN c USING (item_key))
           (SELECT 'top' AS side, item_key, score, impact, share, n FROM j ORDER BY score DESC, item_key LIMIT 5)
           UNION ALL (SELECT 'bottom', item_key, score, impact, share, n FROM j ORDER BY score, item_key LIMIT 5)""")
def _(t):
    p = points(t)
    labels = t.brand_incidence.join(t.containers.select("container_id", "label"), "container_id")
    share = labels.groupBy("item_key").agg(F.avg("label").alias("share"))
    return wr.result_frames(p.select("item_key", "container_id", "score"), p.select("item_key", "container_id", "impact"), share, 5)["ends"]


@query("snk15_export_folds", "dataset:s fold:l split:s n:l n_true:l",
       """WITH m AS (SELECT container_id, count(DISTINCT element_id) AS k FROM truth WHERE rule_id = 1 AND kind = 'node' GROUP BY 1)
          SELECT 'orders' AS dataset, f AS fold, CASE WHEN custkey % 5 = f THEN 'test' ELSE 'training' END AS split, count(*) AS n, coalesce(sum(k), 0) AS n_true
          FROM containers LEFT JOIN m USING (container_id), range(5) r(f) GROUP BY ALL""")
def _(t):
    path = scratch_path(t.spark, "folds")
    fold = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold")
    folds = t.containers.select("container_id", "custkey", fold).select("fold", "container_id", F.when(F.col("custkey") % 5 == F.col("fold"), "test").otherwise("training").alias("split"))
    c = t.containers.select(F.lit("orders").alias("dataset"), "container_id", "label")
    truth = t.truth.where("rule_id = 1 and kind = 'node'").select("container_id", F.col("element_id").cast("long").alias("element_id"))
    wr.export_folds(c, folds, truth, path)
    return t.spark.read.parquet(path).groupBy("dataset", "fold", "split").agg(F.count("*").alias("n"), F.sum(F.size("truth")).alias("n_true"))


@query("snk16_save_splits", "seed:s split:s overlaps:b n:l",
       """WITH s AS (SELECT container_id, split FROM containers UNION ALL SELECT container_id, 'test' FROM containers WHERE split = 'valid')
          SELECT '42' AS seed, split, n > 1 AS overlaps, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY container_id) AS n FROM s) GROUP BY ALL""")
def _(t):
    path = scratch_path(t.spark, "splits")
    s = t.containers.select("container_id", "split")
    legacy = s.unionByName(s.where("split = 'valid'").withColumn("split", F.lit("test")))
    wr.save_splits(legacy, "42", path)
    return wr.load_splits(t.spark.read.parquet(path)).groupBy("seed", "split", "overlaps").agg(F.count("*").alias("n"))


@query("snk1_write_vocab", "item_key:s n_containers:l", "SELECT item_key, n_containers FROM vocab")
def _(t):
    path = scratch_path(t.spark, "vocab")
    wr.write_partitioned(t.vocab.withColumn("dataset", F.lit("orders")), path, ["dataset"])
    return t.spark.read.parquet(path)


@query("snk2_upsert", "dataset:s backbone:s family:s fold:l auc:d", "SELECT dataset, backbone, family, fold, CASE WHEN fold = 0 THEN auc + 1 ELSE auc END AS auc FROM runs")
def _(t):
    old = t.runs.select(*KEYS, "auc")
    return wr.upsert(old, old.where("fold = 0").withColumn("auc", F.col("auc") + 1), KEYS)


@query("snk3_append_versioned", "dataset:s backbone:s family:s fold:l version:s auc:d",
       """SELECT dataset, backbone, family, fold, 'v1' AS version, auc FROM runs UNION ALL SELECT dataset, backbone, family, fold, 'v2', auc FROM runs WHERE fold = 1""")
def _(t):
    old = t.runs.select(*KEYS, F.lit("v1").alias("version"), "auc")
    new = old.withColumn("auc", F.col("auc") + 5).unionByName(old.where("fold = 1").withColumn("version", F.lit("v2")))
    return wr.append_versioned(old, new, KEYS, "version")


@query("snk4_append_new", "custkey:l container_id:l", """WITH p AS (SELECT custkey, max(container_id) AS container_id FROM containers WHERE custkey % 3 = 0 GROUP BY 1)
       SELECT * FROM p UNION ALL (SELECT custkey, container_id FROM containers WHERE custkey NOT IN (SELECT custkey FROM p)
       QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY CASE WHEN label = 1 THEN 0 ELSE 1 END, container_id) = 1)""")
def _(t):
    c = t.containers.select("custkey", "container_id", "label")
    old = c.where("custkey % 3 = 0").groupBy("custkey").agg(F.max("container_id").alias("container_id"), F.lit(0).alias("label"))
    path = scratch_path(t.spark, "appended")
    old.write.parquet(path)
    for _ in range(2):  # the second time adds nothing
        prev = t.spark.read.schema(old.schema).parquet(path)
        both = wr.append_new(prev, c, ["custkey"], F.col("label") == 1, [F.col("container_id")])
        both.join(prev.select("custkey"), "custkey", "left_anti").select(*old.columns).write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@query("snk5_merge_summary", "dataset:s backbone:s family:s fold:l x:d y:d",
       "SELECT dataset, backbone, family, fold, CASE WHEN fold = 0 THEN gt_roc ELSE auc END AS x, CASE WHEN fold = 0 THEN mae END AS y FROM runs")
def _(t):
    old = t.runs.select(*KEYS, F.create_map(F.lit("x"), F.col("auc")).alias("m"))
    new = t.runs.where("fold = 0").select(*KEYS, F.create_map(F.lit("x"), F.col("gt_roc"), F.lit("y"), F.col("mae")).alias("m"))
    m = wr.merge_summary(old, new, KEYS, "m")
    return m.select(*KEYS, F.try_element_at("m", F.lit("x")).alias("x"), F.try_element_at("m", F.lit("y")).alias("y"))


@query("snk7_pooled", "pooling:s n:l mean_impact:d pearson:d",
       f"""WITH p AS (SELECT split, score, impact FROM {POINTS} JOIN containers USING (container_id))
           SELECT 'alltest' AS pooling, count(*) AS n, avg(impact) AS mean_impact, corr(score, impact) AS pearson FROM p
           UNION ALL SELECT 'testonly', count(*), avg(impact), corr(score, impact) FROM p WHERE split = 'test'""")
def _(t):
    p = points(t).join(t.containers.select("container_id", "split"), "container_id")
    return wr.pooled(p).groupBy("pooling").agg(F.count("*").alias("n"), F.avg("impact").alias("mean_impact"), F.corr("score", "impact").alias("pearson"))


@query("snk10_epoch_log", "epoch:l side:s item_key:s r:l",
       """WITH e AS (SELECT year(orderdate) AS epoch, brand AS item_key, count(*) AS score FROM lines JOIN containers USING (container_id) GROUP BY ALL)
          SELECT epoch, 'top' AS side, item_key, row_number() OVER (PARTITION BY epoch ORDER BY score DESC, item_key) AS r FROM e WHERE epoch % 2 = 0 QUALIFY r <= 3
          UNION ALL SELECT epoch, 'bottom', item_key, row_number() OVER (PARTITION BY epoch ORDER BY score, item_key) AS r FROM e WHERE epoch % 2 = 0 QUALIFY r <= 3""")
def _(t):
    j = t.lines.join(t.containers.select("container_id", "orderdate"), "container_id")
    e = j.groupBy(F.year("orderdate").alias("epoch"), F.col("brand").alias("item_key")).agg(F.count("*").alias("score"))
    return wr.epoch_log(e, 2, 3)


@query("snk13_experiment_index", "dataset:s n_rows:l present:s", "SELECT dataset, count(*) AS n_rows, 'auc,mae' AS present FROM runs GROUP BY 1")
def _(t):
    return wr.experiment_index(t.runs.withColumn("absent", F.lit(None).cast("double")), ["dataset"], ["auc", "absent", "mae"])


@query("snk17_update_runs", "dataset:s backbone:s family:s fold:l auc:d",
       "SELECT dataset, backbone, family, fold, CASE WHEN fold = 2 THEN gt_roc ELSE auc END AS auc FROM runs")
def _(t):
    new = t.runs.where("fold = 2").select(*KEYS, F.col("gt_roc").alias("auc"))
    return wr.update_runs(t.runs, new, KEYS, ["auc"])
