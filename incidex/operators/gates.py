"""Quality gates, predicates and field normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidex.functions.expr import not_nan

UNKNOWN = -1


def fail_where(df: DataFrame, bad: Column, message: Column) -> DataFrame:
    """The same rows; evaluation stops with ``message`` at the first bad one."""
    stop = F.raise_error(message).cast("boolean")
    return df.where(F.when(F.coalesce(bad, F.lit(False)), stop).otherwise(F.lit(True)))


def assert_no_wildcard(df: DataFrame, column: str, row_id: str) -> DataFrame:
    message = F.concat(F.lit("wildcard in row "), F.col(row_id).cast("string"))
    return fail_where(df, F.col(column).contains("*"), message)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "") | (F.lower(F.trim(c)) == "nan")


def assert_text(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """Rejects NULL, blank and the text 'nan'."""
    return fail_where(df, is_blank(F.col(column)), F.concat(F.lit("empty text in row "), F.col(row_id).cast("string")))


def require_column(df: DataFrame, column: str) -> DataFrame:
    """Column exists and holds no blank ('none' is a value); reports the first offender."""
    if column not in df.columns:
        raise ValueError(f"missing column {column}")
    bad = df.where(is_blank(F.col(column).cast("string"))).limit(1).collect()
    if bad:
        raise ValueError(f"column {column} is blank in {bad[0].asDict()}")
    return df


def partition_violations(membership: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements that no part owns, and elements owned more than once."""
    keys = ["container_id", "element_id"]
    missing = elements.select(*keys).join(membership.select(*keys), keys, "left_anti").withColumn("kind", F.lit("missing"))
    twice = membership.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys, F.lit("overlap").alias("kind"))
    return missing.unionByName(twice)


def verify_cover(blocks: DataFrame, chosen: DataFrame, protected: DataFrame) -> DataFrame:
    """Counts of missing and overlapping elements and of protected sets that are torn apart.

    ``blocks(container_id, part_id, element_id)``, ``chosen(container_id, part_id)``,
    ``protected(container_id, element_id, set_id)``.
    """
    own = blocks.join(chosen.select("container_id", "part_id"), ["container_id", "part_id"], "left_semi")
    bad = partition_violations(own, blocks.select("container_id", "element_id").distinct())
    torn = (
        protected.join(own, ["container_id", "element_id"], "left")
        .groupBy("container_id", "set_id")
        .agg(F.countDistinct("part_id").alias("k"))
        .where("k <> 1")
    )
    counts = bad.agg(
        F.sum((F.col("kind") == "missing").cast("long")).alias("n_missing"),
        F.sum((F.col("kind") == "overlap").cast("long")).alias("n_overlap"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_missing", "n_overlap")]
    return counts.select(*zero, torn.agg(F.count("*")).scalar().alias("n_torn"))


def membership_state(lookup: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per container: 'known', 'all_unknown' (complete and all -1), 'incomplete'."""
    per = lookup.groupBy("container_id").agg(F.max("item_id").alias("hi"), F.count("*").alias("n"))
    state = F.when(F.col("hi") >= 0, "known").when(F.col("n") == F.col("n_elements"), "all_unknown").otherwise("incomplete")
    return per.join(sizes, "container_id").select("container_id", state.alias("state"))


def validate_membership(lookup: DataFrame, sizes: DataFrame, filtered: bool) -> DataFrame:
    """An unfiltered vocabulary has no unknown element; all-unknown containers must be complete."""
    checked = lookup
    if not filtered:
        message = F.concat(F.lit("unknown element in container "), F.col("container_id").cast("string"))
        checked = fail_where(lookup, F.col("item_id") == UNKNOWN, message)
    states = membership_state(checked, sizes)
    message = F.concat(F.lit("incomplete lookup of container "), F.col("container_id").cast("string"))
    return fail_where(states, F.col("state") == "incomplete", message)


def unknown_guard(lookup: DataFrame, containers: DataFrame, max_fraction: float = 0.9, report_from: float = 0.25) -> DataFrame:
    """Share of containers without any known item (empty ones included) and the verdict."""
    known = lookup.where("item_id >= 0").select("container_id").distinct().withColumn("_k", F.lit(1))
    j = containers.select("container_id").join(known, "container_id", "left")
    agg = j.agg(F.count("*").alias("n"), F.sum(F.col("_k").isNull().cast("long")).alias("n_unknown"))
    share = F.col("n_unknown") / F.col("n")
    verdict = F.when(share > max_fraction, "fail").when(share >= report_from, "report").otherwise("ok")
    return agg.select("*", share.alias("fraction"), verdict.alias("state"))


def rule_items_dropped(rules: DataFrame, kept: DataFrame) -> DataFrame:
    """Rule items that did not survive the cutoff."""
    return rules.select("rule_id", "clause_id", "item_key").join(kept.select("item_key"), "item_key", "left_anti")


def rule_unknown_conflicts(fired: DataFrame, rules: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements of fired clauses that are unknown in the thresholded lookup.

    ``elements(container_id, element_id, item_key, item_id)``.
    """
    need = fired.join(rules, ["rule_id", "clause_id"]).select("rule_id", "container_id", "item_key").distinct()
    lost = elements.where("item_id < 0").select("container_id", "element_id", "item_key")
    return need.join(lost, ["container_id", "item_key"])


def out_of_bounds(df: DataFrame, sizes: DataFrame) -> DataFrame:
    return df.join(sizes, "container_id", "left").where(
        F.col("n_elements").isNull() | (F.col("element_id") < 1) | (F.col("element_id") > F.col("n_elements"))
    )


def assert_bounds(df: DataFrame, sizes: DataFrame) -> DataFrame:
    j = df.join(sizes, "container_id", "left")
    bad = F.col("n_elements").isNull() | (F.col("element_id") < 1) | (F.col("element_id") > F.col("n_elements"))
    message = F.concat(F.lit("element out of bounds in container "), F.col("container_id").cast("string"))
    return fail_where(j, bad, message).drop("n_elements")


def validate_splits(containers: DataFrame, splits: DataFrame, map_keys: DataFrame) -> DataFrame:
    """Violations per check of a fold table against its split list and key map.

    ``containers(container_id, text, ok)``, ``splits(container_id, split)``, ``map_keys(text)``.
    """
    c, s = containers, splits

    def count(df: DataFrame, check: str) -> DataFrame:
        return df.agg(F.lit(check).alias("check"), F.count("*").alias("n"))

    ids = c.groupBy("container_id").agg(F.count("*").alias("k"))
    split_ids = s.groupBy("container_id").agg(F.count("*").alias("k"))
    texts = c.select("text").distinct()
    parts = [
        count(c.where(~F.col("ok")), "not_converted"),
        count(c.where(is_blank(F.col("text"))), "empty_text"),
        count(ids.where("k > 1"), "duplicate_id"),
        count(split_ids.where("k > 1"), "not_disjoint"),
        count(split_ids.join(ids, "container_id", "left_anti"), "only_in_splits"),
        count(ids.join(split_ids, "container_id", "left_anti"), "only_in_table"),
        count(texts.join(map_keys.select("text").distinct(), "text", "left_anti"), "no_map"),
        count(map_keys.select("text").distinct().join(texts, "text", "left_anti"), "extra_map"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assert_splits(report: DataFrame) -> DataFrame:
    return fail_where(report, F.col("n") > 0, F.concat(F.lit("split table fails "), F.col("check")))


def verify_labels(labelled: DataFrame, marks: DataFrame, expected: DataFrame, by: Sequence[str] = ("rule_id",)) -> DataFrame:
    """Label against rule, and marked elements against the elements the rule explains, for every rule.

    ``labelled(*by, container_id, label, synth)``; ``marks`` and ``expected`` hold
    (*by, container_id, element_id) and are compared as sets per rule and container.
    """
    by = list(by)
    keys = [*by, "container_id", "element_id"]
    a = marks.select(*keys).distinct().withColumn("_m", F.lit(1))
    b = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    diff = a.join(b, keys, "full_outer").groupBy(*by, "container_id").agg(
        F.count("_m").alias("n_marked"), F.sum((F.col("_m").isNull() | F.col("_e").isNull()).cast("long")).alias("n_diff")
    )
    j = labelled.join(diff, [*by, "container_id"], "left")
    y, r = F.col("label") == 1, F.col("synth") == 1
    cnt = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return j.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((y == r).cast("double")).alias("agreement"),
        cnt(y & ~r).alias("false_pos"),
        cnt(~y & r).alias("false_neg"),
        cnt(~y & (F.col("n_marked") > 0)).alias("neg_with_marks"),
        cnt(y & (F.col("n_diff") > 0)).alias("pos_mismatch"),
    )


def method_state(item_scores: DataFrame, flat: DataFrame, files: DataFrame, required: int) -> DataFrame:
    """VALID, DEGENERATE, PARTIAL or MISSING per (run, method), with the reason.

    ``item_scores(run, method, score)``, ``flat(run, method, container_id, lo, hi)`` (element
    range per container), ``files(run, method, n_files)``.
    """
    keys = ["run", "method"]
    s = item_scores.groupBy(*keys).agg(
        F.count("*").alias("n_scores"),
        F.countDistinct(F.round("score", 12)).alias("n_values"),
        F.sum((F.isnan("score") | F.col("score").isNull()).cast("long")).alias("n_nan"),
    )
    f = flat.groupBy(*keys).agg(F.avg((F.coalesce(F.col("lo") == F.col("hi"), F.lit(True))).cast("double")).alias("flat_share"))
    j = files.join(s, keys, "left").join(f, keys, "left")
    reason = (
        F.when(F.col("n_files") == 0, "no files")
        .when(F.col("n_files") < required, "files absent")
        .when(F.coalesce("n_scores", F.lit(0)) == 0, "no rows")
        .when(F.col("n_nan") > 0, "nan score")
        .when(F.col("n_values") <= 1, "constant score")
        .when(F.col("flat_share").isNull(), "no element scores")
        .when(F.col("flat_share") > 0.99, "flat element scores")
        .otherwise("")
    )
    state = F.when(reason == "no files", "MISSING").when(reason == "files absent", "PARTIAL").when(reason == "", "VALID").otherwise("DEGENERATE")
    return j.select(*keys, state.alias("state"), reason.alias("reason"))


def conflated_cells(df: DataFrame, cell: Sequence[str], config: str) -> DataFrame:
    """Cells that mix more than one configuration."""
    return df.groupBy(*cell).agg(F.countDistinct(config).alias("n_configs")).where("n_configs > 1")


def fold_distribution(df: DataFrame, cell: Sequence[str]) -> DataFrame:
    return df.groupBy(*cell).agg(F.count("*").alias("n_folds")).groupBy("n_folds").agg(F.count("*").alias("n_cells"))


def assert_folds(df: DataFrame, cell: Sequence[str], limit: int = 5) -> DataFrame:
    """Fails when a cell holds more rows than there are folds."""
    return fail_where(fold_distribution(df, cell), F.col("n_folds") > limit, F.lit("a cell mixes more than one configuration"))


def base_variant(c: Column) -> Column:
    """Variant name without its outer suffixes."""
    return F.regexp_replace(c, r"(_filter)?(_relabelled(_(easy|medium|hard))?)?$", "")


def scope(df: DataFrame, name: str, prefixes: Sequence[str], excluded: Sequence[str], column: str = "vocab_variant") -> DataFrame:
    """Named filters: ``main`` keeps prefixes, ``rest`` drops an exclude set, ``all`` keeps everything."""
    base = base_variant(F.col(column))
    if name == "main":
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | base.startswith(p)
        return df.where(hit)
    if name == "rest":
        return df.where(~base.isin(list(excluded)))
    if name == "all":
        return df
    raise ValueError(f"unknown scope {name!r}")


def collapse_folds(df: DataFrame, single_fold: DataFrame) -> DataFrame:
    """Datasets that come in one fold only keep their first fold."""
    first = df.groupBy("dataset").agg(F.min("fold").alias("_first"))
    one = single_fold.select("dataset", F.lit(True).alias("_one")).distinct()
    j = df.join(first, "dataset").join(one, "dataset", "left")
    return j.where(F.col("_one").isNull() | (F.col("fold") == F.col("_first"))).drop("_first", "_one")


def assert_task(registry: dict[str, str], dataset: str, source_truth: Sequence[str] = (), synthetic: bool = False) -> None:
    """Rules need class labels; synthetic truth is refused where source truth exists."""
    if registry.get(dataset) == "Regression":
        raise ValueError(f"{dataset}: rules need class labels")
    if synthetic and dataset in source_truth:
        raise ValueError(f"{dataset}: has source truth, synthetic truth refused")


def truth_containers(containers: DataFrame, truth: DataFrame, positive: int = 1, by: Sequence[str] = ("rule_id",)) -> DataFrame:
    """Positive test containers that carry truth, for every rule."""
    pos = containers.where((F.col("split") == "test") & (F.col("label") == positive)).select("container_id")
    return truth.select(*by, "container_id").distinct().join(pos, "container_id").select(*by, "container_id")


def has_truth(rules: DataFrame, truth: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``(rule_id, kind, present)``: whether each rule has truth of each kind, in one pass."""
    found = truth.where(F.col("kind").isin(list(kinds))).groupBy("rule_id").agg(F.collect_set("kind").alias("kinds"))
    asked = rules.select("rule_id").distinct().join(found, "rule_id", "left").select("rule_id", "kinds", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return asked.select("rule_id", "kind", F.coalesce(F.array_contains("kinds", F.col("kind")), F.lit(False)).alias("present"))


# ---- field normalisation ---------------------------------------------------------------


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "on"), F.lit(False))


def normalise(df: DataFrame, aliases: dict[str, str], agnostic: Sequence[str]) -> DataFrame:
    """Axes from recorded fields: family alias, variant parts, tier, flags, config signature."""
    v = F.trim("vocab_variant")
    fam = F.col("family")
    for old, new in aliases.items():
        fam = F.when(F.col("family") == old, new).otherwise(fam)
    named = F.regexp_extract(v, r"_relabelled_(easy|medium|hard)$", 1)
    field = F.lower(F.trim("gt_tier"))
    valid = field.rlike(r"^(easy|medium|hard|dnf_k\d+_r\d+(_rare)?)$")
    tier = F.when(F.coalesce(valid, F.lit(False)), field).when(named != "", named).otherwise("none")
    bare = F.regexp_replace(v, r"_relabelled(_(easy|medium|hard))?$", "")
    relabelled = (bare != v) | (tier != "none")
    flags = F.concat(*[F.when(truthy(F.col(c)), "1").otherwise("0") for c in ("w_feat", "w_message", "w_readout")])
    gt = truthy(F.col("use_gt")) | relabelled
    return df.select(
        "*",
        fam.alias("family_norm"),
        F.regexp_replace(bare, "_filter$", "").alias("vocab_base"),
        bare.endswith("_filter").alias("is_filter"),
        relabelled.alias("is_relabelled"),
        tier.alias("tier"),
        F.when(gt, "gt").otherwise("real").alias("synthetic"),
        F.when(F.col("family").isin(list(agnostic)), "na").otherwise(flags).alias("injection"),
        config_signature(F.col("exp_dir")).alias("config_sig"),
    )


def config_signature(path: Column) -> Column:
    """Run path without its fold part."""
    keep = F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.rlike(r"^fold\d+$"))
    return F.array_join(keep, "/")


def alias_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Legacy columns fill new names where those are unset."""
    for old, new in mapping.items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old))
    return df


def performance(task: Column) -> Column:
    """Task-aware headline: auc else pearson, or the first error that is recorded."""
    n = lambda c: not_nan(F.col(c).cast("double"))
    return F.when(task == "Regression", F.coalesce(n("rmse_orig"), n("mae_orig"), n("rmse"), n("mae"))).otherwise(
        F.coalesce(n("auc"), n("pearson"))
    )


def fill_pooled(df: DataFrame, side: DataFrame, keys: Sequence[str], column: str, headline: str) -> DataFrame:
    """Missing pooled values come from the side table, else from the headline."""
    s = side.select(*keys, F.col(column).alias("_side"))
    j = df.join(s, list(keys), "left")
    return j.withColumn(column, F.coalesce(F.col(column), F.col("_side"), F.col(headline))).drop("_side")


def fill_diagnostics(df: DataFrame, side: DataFrame, keys: Sequence[str], subsets: Sequence[str], value: str, invariant: str) -> DataFrame:
    """Per-subset values as columns and the first recorded value of a subset-invariant one."""
    wide = side.groupBy(*keys).pivot("subset", list(subsets)).agg(F.first(value))
    wide = wide.select(*keys, *[F.col(s).alias(f"{value}_{s}") for s in subsets])
    same = side.groupBy(*keys).agg(F.first(invariant, ignorenulls=True).alias(invariant))
    return df.join(wide, list(keys), "left").join(same, list(keys), "left")


def selfcheck(calc: DataFrame, stored: DataFrame, keys: Sequence[str], value: str, tol: float = 1e-6) -> DataFrame:
    """Recomputed against recorded: equal rows, worst finite difference, number of mismatches."""
    j = calc.select(*keys, F.col(value).alias("_a")).join(stored.select(*keys, F.col(value).alias("_b")), list(keys))
    a, b = not_nan(F.col("_a")), not_nan(F.col("_b"))
    ok = F.coalesce(F.abs(a - b) <= tol, a.isNull() & b.isNull())
    return j.agg(
        F.count("*").alias("n"), F.sum(ok.cast("long")).alias("n_ok"), F.max(F.abs(a - b)).alias("worst"),
        F.sum((~ok).cast("long")).alias("n_bad"),
    )


def mismatches(calc: DataFrame, stored: DataFrame, keys: Sequence[str], value: str, tol: float = 1e-6, n: int = 10) -> DataFrame:
    """First n differing rows, for the report."""
    j = calc.select(*keys, F.col(value).alias("calc")).join(stored.select(*keys, F.col(value).alias("stored")), list(keys))
    a, b = not_nan(F.col("calc")), not_nan(F.col("stored"))
    ok = F.coalesce(F.abs(a - b) <= tol, a.isNull() & b.isNull())
    return j.where(~ok).orderBy(*keys).limit(n)


def report_metrics(df: DataFrame, default: Sequence[str], prefixes: Sequence[str] = ("score_", "topbot_", "gtvo_")) -> list[str]:
    """Metric columns worth reporting, from the schema alone."""
    numeric = [c for c, k in df.dtypes if k in ("double", "float", "int", "bigint")]
    names = [c for c in default if c in df.columns]
    names += [c for c in numeric if c.startswith(tuple(prefixes)) and c not in names]
    if not any(c.endswith("_orig") for c in df.columns):
        names += [c for c in ("mae", "rmse") if c in df.columns and c not in names]
    for generic in ("pearson", "spearman"):
        if generic not in df.columns and any(c.endswith(f"_mean_{generic}") for c in df.columns):
            names.append(generic)
    return names


def alignment(a: DataFrame, b: DataFrame, skip: str | None = None) -> DataFrame:
    """Element-by-element comparison of two sources: ``a(…, kind)``, ``b(…, kind)``.

    One row per mismatch with its reason; one kind can be left out.
    """
    keys = ["container_id", "element_id"]
    j = a.select(*keys, F.col("kind").alias("ka")).join(b.select(*keys, F.col("kind").alias("kb")), keys, "full_outer")
    reason = (
        F.when(F.col("kb").isNull(), "unmapped")
        .when(F.col("ka").isNull(), "extra")
        .when(F.col("kb") == "?", "unknown_kind")
        .when(F.col("ka") != F.col("kb"), "kind_differs")
    )
    rows = j.select(*keys, "ka", "kb", reason.alias("reason")).where("reason IS NOT NULL")
    return rows if skip is None else rows.where(~F.coalesce(F.col("ka") == skip, F.lit(False)))


