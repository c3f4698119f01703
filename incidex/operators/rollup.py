"""Roll-ups of run results over folds, methods and configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidex import skew
from incidex.functions.expr import mean_std_cell, weighted_pearson
from incidex.operators.metrics import with_ranks


def _fold_list() -> Column:
    return F.array_join(F.array_sort(F.collect_set("fold")).cast("array<string>"), ",")


def experiment_id(axes: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.concat(F.lit(f"{a}="), F.coalesce(F.col(a).cast("string"), F.lit("none"))) for a in axes])


def build_tidy(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample std of every metric over folds (0 for one fold), fold count and list."""
    aggs = [F.countDistinct("fold").alias("n_folds"), _fold_list().alias("folds")]
    for m in metrics:
        std = F.when(F.count(m) == 1, 0.0).otherwise(F.stddev_samp(m))
        aggs += [F.avg(m).alias(f"{m}_mean"), std.alias(f"{m}_std")]
    return runs.groupBy(*keys).agg(*aggs)


def broadcast_axis(tidy: DataFrame, base: Sequence[str], axis: str, agnostic: Column) -> DataFrame:
    """Axis-agnostic rows are repeated for every axis value seen under the same base key."""
    values = tidy.where(~agnostic).select(*base, F.col(axis).alias("_v")).distinct()
    copies = tidy.where(agnostic).drop(axis).join(values, list(base)).withColumnRenamed("_v", axis)
    return tidy.unionByName(copies.select(tidy.columns))


def expand_explainers(runs: DataFrame, keys: Sequence[str], pattern: str = r"^(.+)_(mean|max)_(.+)$") -> DataFrame:
    """Columns ``explainer_agg_metric`` become rows (explainer, agg) with one column per metric."""
    import re

    cols = [c for c in runs.columns if re.match(pattern, c) and c not in keys]
    metrics = sorted({re.match(pattern, c).group(3) for c in cols})
    long = runs.unpivot(list(keys), cols, "name", "value")
    tagged = long.select(
        *keys,
        F.regexp_extract("name", pattern, 1).alias("explainer"),
        F.regexp_extract("name", pattern, 2).alias("agg"),
        F.regexp_extract("name", pattern, 3).alias("metric"),
        "value",
    )
    return tagged.groupBy(*keys, "explainer", "agg").pivot("metric", metrics).agg(F.first("value"))


def expand_pooling(df: DataFrame, mean_col: str, max_col: str, out: str) -> DataFrame:
    """One row per pooling where both sources exist, else the row as it is with blank pooling."""
    both = F.col(mean_col).isNotNull() & F.col(max_col).isNotNull()
    rows = F.when(
        both,
        F.array(
            F.struct(F.lit("mean").alias("pooling"), F.col(mean_col).alias(out)),
            F.struct(F.lit("max").alias("pooling"), F.col(max_col).alias(out)),
        ),
    ).otherwise(F.array(F.struct(F.lit("").alias("pooling"), F.coalesce(mean_col, max_col).alias(out))))
    return df.withColumn("_p", F.explode(rows)).select(*df.columns, "_p.pooling", f"_p.{out}")


def pivot_cells(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], metric: str) -> DataFrame:
    """``mean ± std`` text cells, one column per value."""
    cell = df.groupBy(*rows, column).agg(
        mean_std_cell(F.avg(metric), F.stddev_samp(metric), F.count(metric)).alias("cell")
    )
    wide = cell.groupBy(*rows).pivot(column, list(values)).agg(F.first("cell"))
    return wide.select(*rows, *[F.coalesce(v, F.lit("")).alias(v) for v in values])


def select_pooling(df: DataFrame, pooling: str) -> DataFrame:
    return df.where(F.col("pooling").isin(pooling, "")).drop("pooling")


def fold_aggregate(df: DataFrame, keys: Sequence[str], ddof: int) -> DataFrame:
    """Mean, std and non-NULL count of all numeric columns."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    cols = [c for c, k in df.dtypes if k in ("double", "float", "int", "bigint") and c not in (*keys, "fold")]
    aggs = [a for c in cols for a in (F.avg(c).alias(f"{c}_mean"), std(c).alias(f"{c}_std"), F.count(c).alias(f"{c}_n"))]
    return df.groupBy(*keys).agg(*aggs)


def best_per_row(long: DataFrame, rows: Sequence[str], method: str, value: str, higher: bool = True) -> DataFrame:
    """Best method of each row, NULL values ignored, with the number of methods that have one."""
    v = F.col(value) if higher else -F.col(value)
    key = F.when(F.col(value).isNotNull(), F.struct(v, F.col(method)))
    return long.groupBy(*rows).agg(
        F.max_by(method, key).alias("best_method"), F.max_by(value, key).alias("best_value"), F.count(value).alias("n_methods")
    )


def wide_by(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.avg(value))


def regime(variant: Column, tier: Column) -> Column:
    """Which kind of labels and vocabulary a run used."""
    kind = F.when(tier.startswith("dnf_"), "planted").when(tier == "source", "source").otherwise("real")
    return F.concat_ws("_", kind, F.when(variant.endswith("_filter"), "filtered").otherwise("full"))


def metric_set(df: DataFrame, cell: Sequence[str], headline: str) -> DataFrame:
    """Fold count of each cell on its rows, the headline alias and the main/supplement mark."""
    n = df.groupBy(*cell).agg(F.countDistinct("fold").alias("n_folds"))
    full = df.join(n, list(cell)).withColumn("headline", F.col(headline))
    return full.withColumn("part", F.when(F.col("vocab_variant").endswith("_filter"), "supplement").otherwise("main"))


def inject_filtered(full: DataFrame, filtered: DataFrame, keys: Sequence[str], overwrite: Sequence[str], blank: Sequence[str]) -> DataFrame:
    """Full-vocabulary rows cloned as filtered ones: some columns replaced, others emptied."""
    f = filtered.select(*keys, *[F.col(c).alias(f"_{c}") for c in overwrite])
    j = full.join(f, list(keys))
    cols = [
        F.col(f"_{c}").alias(c) if c in overwrite else F.lit(None).cast(t).alias(c) if c in blank else F.col(c)
        for c, t in full.dtypes
    ]
    return j.select(*cols, F.lit(True).alias("injected"))


def presence(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])


def coverage_report(df: DataFrame, cell: Sequence[str], expected_folds: int) -> DataFrame:
    """Rows, backbones and folds of each cell; incomplete cells come first."""
    agg = df.groupBy(*cell).agg(
        F.count("*").alias("n_rows"), F.countDistinct("backbone").alias("n_backbones"), F.countDistinct("fold").alias("n_folds")
    )
    return agg.withColumn("complete", F.col("n_folds") >= expected_folds).orderBy("complete", *cell)


def ranking_stability(df: DataFrame, explainer: str, scheme: str, metric: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rank correlation of explainers between pairs of schemes, with a verdict.

    The schemes are few and named, so every pair is one column comparison on a pivoted table.
    """
    names = sorted({s for p in pairs for s in p})
    wide = wide_by(df, [explainer], scheme, names, metric)
    both = F.explode(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("score"), F.col(b).alias("impact")) for a, b in pairs])
    )
    long = wide.select(explainer, both.alias("p")).select("p.*").where("score IS NOT NULL AND impact IS NOT NULL")
    rho = with_ranks(long, ["a", "b"]).groupBy("a", "b").agg(
        F.count("*").alias("n"), weighted_pearson(F.col("rx"), F.col("ry"), F.lit(1.0)).alias("rho")
    )
    verdict = (
        F.when(F.col("rho").isNull(), "too few")
        .when(F.col("rho") >= 0.8, "stable")
        .when(F.col("rho") >= 0.5, "mostly stable")
        .otherwise("unstable")
    )
    return rho.withColumn("verdict", verdict)


def sweep_one_factor(runs: DataFrame, centre: dict[str, float], metric: str, guard: str, guard_drop: float) -> DataFrame:
    """Configs that differ from the centre in exactly one knob, and the best safe value per knob.

    A config is safe when its guard metric stays within ``guard_drop`` of the centre's.
    """
    knobs = list(centre)
    agg = runs.groupBy(*knobs).agg(
        F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.avg(guard).alias("guard"), F.count(metric).alias("n")
    )
    off = F.filter(
        F.array(*[F.when(F.abs(F.col(k) - v) > 1e-12 + 1e-6 * abs(v), F.lit(k)) for k, v in centre.items()]),
        lambda k: k.isNotNull(),
    )
    tagged = agg.withColumn("off", off)
    centre_guard = tagged.where(F.size("off") == 0).agg(F.max("guard")).scalar()
    centre_mean = tagged.where(F.size("off") == 0).agg(F.max("mean")).scalar()
    one = tagged.where(F.size("off") == 1).withColumn("knob", F.col("off")[0])
    value = F.coalesce(*[F.when(F.col("knob") == k, F.col(k).cast("double")) for k in knobs])
    one = one.withColumn("value", value).withColumn("safe", F.col("guard") >= centre_guard - guard_drop)
    key = F.when(F.col("safe"), F.struct("mean", "value"))
    return one.groupBy("knob").agg(
        F.count("*").alias("n_values"),
        F.max_by("value", key).alias("best_value"),
        (F.max(F.when(F.col("safe"), F.col("mean"))) - F.max(centre_mean)).alias("gain"),
    )


def accumulate_extremes(points: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Best and worst k items of each cell, accumulated over cells.

    ``points(by, item_key, score)``; one row per (side, item).
    """
    one = points.groupBy(*by, "item_key").agg(F.max("score").alias("score"))
    top = skew.top_rows(one, by, [F.desc("score"), F.col("item_key")], k).withColumn("side", F.lit("top"))
    low = skew.top_rows(one, by, [F.asc("score"), F.col("item_key")], k).withColumn("side", F.lit("bottom"))
    cell = F.concat_ws("|", *[F.col(b).cast("string") for b in by])
    return top.unionByName(low).groupBy("side", "item_key").agg(
        F.count("*").alias("n"),
        F.sum("score").alias("total"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.countDistinct(cell).alias("n_cells"),
    )


def dataset_stats(containers: DataFrame, sizes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sizes, class counts, positive share, mean elements and edges per dataset.

    A container of n elements in a path has 2 (n - 1) directed edges.
    """
    n = F.coalesce("n_elements", F.lit(0))
    return containers.join(sizes, "container_id", "left").groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum("label").alias("n_pos"),
        F.avg(F.col("label").cast("double")).alias("pos_share"),
        F.avg(n).alias("mean_elements"),
        F.avg(F.greatest(2 * (n - 1), F.lit(0))).alias("mean_edges"),
    )


def stamp_rules(df: DataFrame, source: DataFrame, planted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rule text per run: source truth first, then the planted rule."""
    j = df.join(source.select("dataset", F.col("rule").alias("_s")), "dataset", "left")
    j = j.join(planted.select(*keys, F.col("rule").alias("_p")), list(keys), "left")
    return j.withColumn("rule", F.coalesce("_s", "_p")).drop("_s", "_p")


def enumerate_grid(base: DataFrame, axes: dict[str, Sequence[str]], excluded: Column) -> DataFrame:
    """Every combination of the configured axes for each base row, minus excluded ones, with an id."""
    grid = base
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    cols = grid.columns
    return skew.number_rows(grid.where(~excluded), [], [F.col(c) for c in cols], "config_id")


def enumerate_cells(grid: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid cells whose rule is available; cells with no rule list at all are kept."""
    known = rules.select(*keys).distinct().withColumn("_known", F.lit(True))
    ok = rules.select(*keys, "tier").distinct().withColumn("_ok", F.lit(True))
    j = grid.join(known, list(keys), "left").join(ok, [*keys, "tier"], "left")
    return j.where(F.col("_known").isNull() | F.col("_ok")).drop("_known", "_ok").distinct()


def shard(df: DataFrame, order: Sequence[Column], i: int, n: int) -> DataFrame:
    return skew.number_rows(df, [], order, "_r").where((F.col("_r") - 1) % n == i).drop("_r")


def config_hash(df: DataFrame, columns: Sequence[str], digits: int = 6, length: int = 10) -> DataFrame:
    """sha1 prefix of the sorted-key JSON of the configuration, numbers rounded."""
    kinds = dict(df.dtypes)
    fields = [
        (F.bround(c, digits) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in sorted(columns)
    ]
    return df.withColumn("config_json", F.to_json(F.struct(*fields))).withColumn(
        "config_hash", F.substring(F.sha1("config_json"), 1, length)
    )


def filter_runs(df: DataFrame, variants: Sequence[str] | None, datasets: Sequence[str] | None) -> DataFrame:
    if variants:
        df = df.where(F.col("vocab_variant").isin(list(variants)))
    return df.where(F.col("dataset").isin(list(datasets))) if datasets else df


