"""Readers of fold tables, run summaries, scores, impacts and edge lists."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidex.functions.expr import not_nan
from incidex.operators.gates import fail_where, is_blank
from incidex.session import cut_lineage


def read_fold(spark: SparkSession, path: str, label_column: str, schema: str) -> DataFrame:
    """Fold table: label column renamed, default split ``training``, rows without text rejected."""
    df = spark.read.csv(path, header=True, schema=schema).withColumnRenamed(label_column, "label")
    split = F.coalesce("split", F.lit("training")) if "split" in df.columns else F.lit("training")
    message = F.concat(F.lit("row without text: "), F.col("container_id").cast("string"))
    return fail_where(df.withColumn("split", split), is_blank(F.col("text")), message)


def read_labelled(spark: SparkSession, path: str, schema: str, label_column: str, official: DataFrame) -> DataFrame:
    """Gzipped benchmark table with the official split attached by row index; NULL labels dropped."""
    df = spark.read.csv(path, header=True, schema=schema).withColumnRenamed(label_column, "label")
    return df.where("label IS NOT NULL").join(official.select("row_index", "split"), "row_index")


def local_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges over global node numbers to local ids; an edge across containers fails.

    ``edges(src, dst)``, ``members(node, container_id)`` with consecutive nodes per container.
    """
    first = members.groupBy("container_id").agg(F.min("node").alias("_first"))
    m = members.join(first, "container_id")
    s = m.select(F.col("node").alias("src"), F.col("container_id").alias("cs"), F.col("_first").alias("fs"))
    d = m.select(F.col("node").alias("dst"), F.col("container_id").alias("cd"))
    j = edges.join(s, "src").join(d, "dst")
    ok = fail_where(j, F.col("cs") != F.col("cd"), F.concat(F.lit("edge spans containers: "), F.col("src").cast("string")))
    return ok.select(F.col("cs").alias("container_id"), (F.col("src") - F.col("fs")).alias("src"), (F.col("dst") - F.col("fs")).alias("dst"))


def edge_truth(edges: DataFrame, containers: DataFrame) -> DataFrame:
    """Elements that end a true edge in class-0 containers; ``edges(container_id, src, dst, y)``."""
    zero = containers.where("label = 0").select("container_id")
    true = edges.where("y = 1").join(zero, "container_id", "left_semi")
    return true.select("container_id", F.explode(F.array("src", "dst")).alias("element_id")).distinct()


ARCHIVED = ("_archive", "_trash", "_old")


def read_summaries(spark: SparkSession, root: str, name: str = "summary.json", schema: str | None = None) -> DataFrame:
    """One row per summary file below ``root`` (whole files, indented or not): its fields, ``path`` relative to the
    root, ``modified``, and ``_corrupt_record`` for a file that is no JSON object."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("multiLine", "true").option("mode", "PERMISSIVE")
    if schema:
        reader = reader.schema(f"{schema}, _corrupt_record string")
    df = reader.json(root)
    base = root.split(":", 1)[-1].rstrip("/") + "/"
    path = F.substring_index(F.col("_metadata.file_path"), "/" + base.lstrip("/"), -1)
    df = df.select("*", path.alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
    return df if "_corrupt_record" in df.columns else df.withColumn("_corrupt_record", F.lit(None).cast("string"))


def _archived(exclude: Sequence[str]) -> Column:
    """Some part of the relative path begins with an archive prefix."""
    hit = lambda part: functools.reduce(lambda a, b: a | b, [part.startswith(e) for e in exclude])
    return F.exists(F.split("path", "/"), hit) if exclude else F.lit(False)


def scan_runs(spark: SparkSession, root: str, exclude: Sequence[str] = ARCHIVED, datasets: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """Readable summaries outside archived folders; a dataset is named by a path part or by the field."""
    df = read_summaries(spark, root, schema=schema).where(~_archived(exclude))
    df = df.where("_corrupt_record IS NULL").drop("_corrupt_record")
    if datasets:
        part = F.exists(F.split("path", "/"), lambda x: x.isin(list(datasets)))
        df = df.where(part | F.coalesce(F.col("dataset").isin(list(datasets)), F.lit(False)) if "dataset" in df.columns else part)
    return df


def flatten_summary(df: DataFrame) -> DataFrame:
    """Scalar fields only, with the run time falling back on the file's own."""
    scalar = [c for c, t in df.dtypes if not t.startswith(("struct", "array", "map")) and c != "modified"]
    stamp = F.coalesce(F.col("run_timestamp").cast("timestamp"), F.col("modified")) if "run_timestamp" in scalar else F.col("modified")
    return df.select(*scalar, stamp.alias("stamp"))


def harvest(spark: SparkSession, root: str, exclude: Sequence[str] = ARCHIVED, schema: str | None = None) -> DataFrame:
    """found = harvested + skipped, counted in files; archived folders are not looked into."""
    df = read_summaries(spark, root, schema=schema).where(~_archived(exclude))
    # stored first: Spark refuses to read the corrupt column alone
    bad = F.col("_corrupt_record").isNotNull().cast("long")
    return cut_lineage(df.withColumn("bad", bad).drop("_corrupt_record")).agg(
        F.count("*").alias("found"), F.coalesce(F.sum(1 - F.col("bad")), F.lit(0)).alias("harvested"), F.coalesce(F.sum("bad"), F.lit(0)).alias("skipped")
    )


def metrics_wide(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """method -> split -> metric -> value maps to one row per method with ``<metric>_<split>`` columns."""
    m = df.select(*keys, F.explode("methods").alias("method", "splits"))
    s = m.select(*keys, "method", F.explode("splits").alias("split", "metrics"))
    v = s.select(*keys, "method", "split", F.explode("metrics").alias("metric", "value"))
    named = v.withColumn("name", F.concat_ws("_", "metric", "split"))
    return named.groupBy(*keys, "method").pivot("name", list(names)).agg(F.first("value"))


def parse_run_path(path: Column, layout: str = "family_first") -> list[Column]:
    """Identity columns from ``root/family/dataset/foldK/variant/run`` or the vocabulary-first order."""
    p = F.split(path, "/")
    at = (1, 2, 3, 4, 5) if layout == "family_first" else (1, 3, 4, 2, 5)
    family, dataset, fold, variant, run = (F.get(p, i) for i in at)
    rule = F.regexp_extract(variant, r"_relabelled_(dnf_k\d+_r\d+)$", 1)
    return [
        family.alias("family"), dataset.alias("dataset"), F.regexp_extract(fold, r"^fold(\d+)$", 1).cast("int").alias("fold"),
        F.regexp_replace(variant, "_filter.*$", "").alias("base"), variant.contains("_filter").alias("filtered"),
        F.regexp_extract(run, r"^bb-([A-Za-z]+)_", 1).alias("backbone"),
        F.coalesce(F.nullif(F.regexp_extract(run, r"(?:^|_|enc-)(onehot|linear)(?:_|$)", 1), F.lit("")), F.lit("none")).alias("encoder"),
        F.when(rule != "", "planted").otherwise("none").alias("tier"),
    ]


def read_impact(raw: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """item -> container -> value JSON to long rows."""
    m = raw.select(*keys, F.explode(F.from_json(text, "map<string,map<string,double>>")).alias("item_key", "inner"))
    long = m.select(*keys, "item_key", F.explode("inner").alias("container", "impact"))
    return long.select(*keys, "item_key", F.col("container").cast("long").alias("container_id"), not_nan(F.col("impact")).alias("impact"))


def read_scores(raw: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """split -> method -> container -> array JSON to one row per element."""
    kind = "map<string,map<string,map<string,array<double>>>>"
    m = raw.select(*keys, F.explode(F.from_json(text, kind)).alias("split", "methods"))
    m = m.select(*keys, "split", F.explode("methods").alias("method", "inner"))
    c = m.select(*keys, "split", "method", F.explode("inner").alias("container", "values"))
    return c.select(*keys, "split", "method", F.col("container").cast("long").alias("container_id"), F.posexplode("values").alias("element_id", "score"))


def read_predictions(raw: DataFrame, keys: Sequence[str], text: str, names: Sequence[str]) -> DataFrame:
    """split -> metric -> value JSON to one row per split with the named scalars, NULL where absent or NaN."""
    m = raw.select(*keys, F.explode(F.from_json(text, "map<string,map<string,double>>")).alias("split", "values"))
    return m.select(*keys, "split", *[not_nan(F.try_element_at("values", F.lit(n))).alias(n) for n in names])


def pooled_points(spark: SparkSession, scores: str, impacts: str, schema_key: str = "item_key string") -> DataFrame:
    """Per-split score files joined to impact files on (split, item); folders ``split=<name>`` hold the CSVs."""
    read = lambda path, value: spark.read.csv(path, header=True, schema=f"{schema_key}, {value} double, split string")
    return read(scores, "score").join(read(impacts, "impact"), ["split", "item_key"])


def collect_points(points: DataFrame, kind: str, canonical: str, legacy: str) -> DataFrame:
    """Points of all runs with their identity; a run's legacy file counts only where it has no canonical one.

    ``points(run, file, kind, item_key, container_id, score, impact)``.
    """
    rows = points.where(F.col("kind") == kind)
    good = rows.where(F.col("file") == canonical)
    old = rows.where(F.col("file") == legacy).join(good.select("run").distinct(), "run", "left_anti")
    return good.unionByName(old).select("run", *parse_run_path(F.col("run")), "item_key", "container_id", "score", "impact")


def read_correlations(spark: SparkSession, path: str) -> DataFrame:
    """Correlation files with numeric values or NULL."""
    df = spark.read.csv(path, header=True)
    return df.select("method", *[not_nan(F.expr(f"try_cast({c} AS double)")).alias(c) for c in df.columns if c != "method"])


def load_incidence(coo: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Matrix cells plus row and column dictionaries to (container, item) pairs."""
    return coo.join(rows, "row").join(columns, "col").select("container_id", "item_key").distinct()
