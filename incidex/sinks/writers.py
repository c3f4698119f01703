"""Writers and keyed merges.  Each returns or writes a new snapshot; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from incidex.functions.expr import not_nan
from incidex.operators.gates import fail_where


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones with the same key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def append_versioned(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """First row per key and version wins, so writing twice adds nothing."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    return _first(both, [*keys, version], [F.col("_o")]).drop("_o")


def append_new(prev: DataFrame, df: DataFrame, keys: Sequence[str], done: Column, order: Sequence[Column]) -> DataFrame:
    """Only unseen keys are added; finished rows are preferred among duplicates."""
    fresh = _first(df, keys, [F.when(done, 0).otherwise(1), *order]).join(prev.select(*keys), list(keys), "left_anti")
    return prev.unionByName(fresh)


def merge_summary(old: DataFrame, new: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Maps merged key by key, the new value first."""
    n = new.select(*keys, F.col(column).alias("_n"))
    o = old.select(*keys, F.col(column).alias("_o"))
    j = o.join(n, list(keys), "full_outer")
    merged = F.map_zip_with("_o", "_n", lambda k, a, b: F.coalesce(b, a))
    return j.select(*keys, F.coalesce(merged, "_n", "_o").alias(column))


def pooled(points: DataFrame) -> DataFrame:
    """Rows tagged for pooling over all splits and over the test split."""
    tags = F.when(F.col("split") == "test", F.array(F.lit("alltest"), F.lit("testonly"))).otherwise(F.array(F.lit("alltest")))
    return points.withColumn("pooling", F.explode(tags))


def epoch_log(df: DataFrame, every: int, k: int) -> DataFrame:
    """Every n-th epoch, the k best and k worst items."""
    e = df.where(F.col("epoch") % every == 0)
    hi = Window.partitionBy("epoch").orderBy(F.desc("score"), "item_key")
    lo = Window.partitionBy("epoch").orderBy(F.asc("score"), "item_key")
    top = e.withColumn("r", F.row_number().over(hi)).where(F.col("r") <= k).withColumn("side", F.lit("top"))
    low = e.withColumn("r", F.row_number().over(lo)).where(F.col("r") <= k).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def experiment_index(tidy: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Row counts and the metrics present per experiment."""
    agg = tidy.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.count(m).alias(f"_{m}") for m in metrics])
    present = F.array_compact(F.array(*[F.when(F.col(f"_{m}") > 0, F.lit(m)) for m in metrics]))
    return agg.select(*keys, "n_rows", F.array_join(present, ",").alias("present"))


def update_runs(runs: DataFrame, metrics: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Recomputed values over recorded ones."""
    m = metrics.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    j = runs.join(m, list(keys), "left")
    for c in columns:
        j = j.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return j


def write_files(df: DataFrame, root: str) -> None:
    """One file per row of ``(path, content)`` below ``root``, written by the tasks."""

    def write(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        for r in rows:
            full = f"{root}/{r['path']}"
            system, path = (fs.LocalFileSystem(), "/" + full.split(":", 1)[-1].lstrip("/")) if full.startswith(("/", "file:")) else fs.FileSystem.from_uri(full)
            system.create_dir(path.rsplit("/", 1)[0])
            with system.open_output_stream(path) as out:
                out.write(r["content"].encode())

    df.select("path", "content").foreachPartition(write)


def write_points(points: DataFrame, root: str) -> None:
    """Importance and impact tables, one folder per (method, split)."""
    for value in ("score", "impact"):
        points.select("method", "split", "item_key", "container_id", value).write.mode("overwrite").partitionBy("method", "split").parquet(f"{root}/{value}")


def correlation_rows(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pearson correlation of score and impact per group, NULL where it does not exist, with the number of points."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), not_nan(F.corr("score", "impact")).alias("pearson"))


def write_instance(points: DataFrame, root: str) -> None:
    """Correlation rows per container, one folder per split."""
    correlation_rows(points, ["split", "container_id"]).write.mode("overwrite").partitionBy("split").parquet(root)


def write_global(parts: Sequence[DataFrame], path: str) -> None:
    """All methods and splits in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.write.mode("overwrite").parquet(path)


def log_scalars(df: DataFrame, path: str, header: Sequence[str]) -> None:
    """Appends telemetry under a fixed header: absent columns are NULL, unknown ones fail."""
    unknown = sorted(set(df.columns) - set(header))
    if unknown:
        raise ValueError(f"columns outside the header: {unknown}")
    df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string" if c == "name" else "double").alias(c) for c in header]).write.mode("append").parquet(path)


def write_sheets(df: DataFrame, config: Sequence[str], path: str) -> None:
    """One folder per (regime, sheet), with a readable config id."""
    named = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in config])
    df.withColumn("config_id", named).write.mode("overwrite").partitionBy("regime", "sheet").parquet(path)


def result_frames(scores: DataFrame, impacts: DataFrame, classes: DataFrame, k: int) -> dict[str, DataFrame]:
    """Frames of a result: a row per (item, container) with score, impact and the item's discriminativeness, item means,
    and the k items of highest and lowest mean score.

    ``scores(item_key, container_id, score)``, ``impacts(item_key, container_id, impact)``, ``classes(item_key, share)``.
    """
    points = scores.join(impacts, ["item_key", "container_id"]).join(classes, "item_key", "left")
    items = points.groupBy("item_key").agg(F.avg("score").alias("score"), F.avg("impact").alias("impact"), F.max("share").alias("share"), F.count("*").alias("n"))
    ends = items.orderBy(F.desc("score"), "item_key").limit(k).withColumn("side", F.lit("top")).unionByName(
        items.orderBy("score", "item_key").limit(k).withColumn("side", F.lit("bottom"))
    )
    return {"points": points, "items": items, "ends": ends}


def export_folds(containers: DataFrame, folds: DataFrame, truth: DataFrame, path: str) -> None:
    """One labelled table per (dataset, fold) with each container's true elements as a mask.

    ``containers(dataset, container_id, label)``, ``folds(fold, container_id, split)``, ``truth(container_id, element_id)``.
    """
    mask = truth.groupBy("container_id").agg(F.array_sort(F.collect_set("element_id")).alias("truth"))  # a container's elements
    rows = containers.join(folds, "container_id").join(mask, "container_id", "left")
    rows.withColumn("truth", F.coalesce("truth", F.array().cast("array<bigint>"))).write.mode("overwrite").partitionBy("dataset", "fold").parquet(path)


def save_splits(splits: DataFrame, seed: str, path: str) -> None:
    splits.withColumn("seed", F.lit(seed)).write.mode("overwrite").parquet(path)


def load_splits(path_rows: DataFrame, strict: bool = False) -> DataFrame:
    """Saved splits; ``overlaps`` marks ids that legacy files hold in several splits (an error if ``strict``)."""
    many = F.count("*").over(Window.partitionBy("container_id")) > 1
    out = path_rows.withColumn("overlaps", many)
    return fail_where(out, F.col("overlaps"), F.concat(F.lit("id in several splits: "), F.col("container_id").cast("string"))) if strict else out
