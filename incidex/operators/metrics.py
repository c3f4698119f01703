"""Grading element and item scores against truth, impact and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidex import skew
from incidex.functions.expr import not_nan, ratio, weighted_pearson
from incidex.session import cut_lineage

UNKNOWN = -1
SMALL = 64  # elements of a container that are compared pair by pair inside its row


# ---- predictions ------------------------------------------------------------------


def regression_errors(df: DataFrame, by: Sequence[str], y: str, pred: str) -> DataFrame:
    diff = F.col(pred) - F.col(y)
    return df.groupBy(*by).agg(
        F.avg(F.abs(diff)).alias("mae"), F.sqrt(F.avg(diff * diff)).alias("rmse"), F.count(diff).alias("n")
    )


def evaluate(df: DataFrame, task: str, y: str = "y", pred: str = "pred", scale: Column | None = None) -> DataFrame:
    """One row of task-aware figures.

    ``binary``: AUC.  ``regression``: errors in normalised units and, times ``scale``,
    in original units.  ``multilabel``: mean AUC over tasks, missing labels left out
    (needs a ``task`` column).
    """
    if task == "binary":
        return skew.roc_auc(df.withColumn("_g", F.lit(1)), ["_g"], y, pred).select("auc")
    if task == "regression":
        base = regression_errors(df, [], y, pred)
        k = F.lit(1.0) if scale is None else scale
        return base.select("mae", "rmse", (F.col("mae") * k).alias("mae_orig"), (F.col("rmse") * k).alias("rmse_orig"))
    if task == "multilabel":
        per = skew.roc_auc(df.where(F.col(y).isNotNull()), ["task"], y, pred)
        return per.agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_tasks"))
    raise ValueError(f"unknown task {task!r}")


def score_stats(df: DataFrame, by: Sequence[str], x: str = "score") -> DataFrame:
    """Min, max, mean, population std, exact median, mode of 3-decimal values (only if repeated)."""
    by = list(by)
    src = df.select(*by, not_nan(F.col(x).cast("double")).alias("x")).where("x IS NOT NULL")
    main = src.groupBy(*by).agg(
        F.min("x").alias("score_min"),
        F.max("x").alias("score_max"),
        F.avg("x").alias("score_mean"),
        F.stddev_pop("x").alias("score_std"),
        F.count("*").alias("score_count"),
    )
    freq = src.groupBy(*by, F.bround("x", 3).alias("r")).agg(F.count("*").alias("c"))
    mode = freq.groupBy(*by).agg(
        F.max("c").alias("_c"), F.max_by("r", F.struct(F.col("c"), -F.col("r"))).alias("_r")
    ).select(*by, F.when(F.col("_c") > 1, F.col("_r")).alias("score_mode"))
    return main.join(mode, by).join(skew.quantiles(src, by, "x", {"score_median": 0.5}), by)


# ---- correlations -----------------------------------------------------------------


def with_ranks(points: DataFrame, by: Sequence[str], x: str = "score", y: str = "impact") -> DataFrame:
    """Adds tie-averaged ranks ``rx`` and ``ry`` inside each group."""
    return skew.average_rank(skew.average_rank(points, by, x, "rx"), by, y, "ry")


def grouped_correlations(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pearson and Spearman, weighted by support or not, with and without the unknown item.

    ``points(by, item_id, score, impact, support)``; one row per (by, unk).
    """
    by = list(by)
    tags = F.when(F.col("item_id") == UNKNOWN, F.array(F.lit("incl"))).otherwise(F.array(F.lit("incl"), F.lit("excl")))
    both = points.withColumn("unk", F.explode(tags))
    keys = [*by, "unk"]
    ranked = with_ranks(both, keys)
    w = F.greatest(F.coalesce(F.col("support").cast("double"), F.lit(1.0)), F.lit(0.0))
    one = F.lit(1.0)
    c = F.col
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n_items"),
        weighted_pearson(c("score"), c("impact"), w).alias("pearson_w"),
        weighted_pearson(c("score"), c("impact"), one).alias("pearson_u"),
        weighted_pearson(c("rx"), c("ry"), w).alias("spearman_w"),
        weighted_pearson(c("rx"), c("ry"), one).alias("spearman_u"),
    )


def instance_correlation(scores: DataFrame, impact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Correlation over shared (item, container) keys, finite values only."""
    by = list(by)
    pts = scores.join(impact, [*by, "item_key", "container_id"]).select(
        *by, not_nan(F.col("score")).alias("score"), not_nan(F.col("impact")).alias("impact")
    ).where("score IS NOT NULL AND impact IS NOT NULL")
    ranked = with_ranks(pts, by)
    one = F.lit(1.0)
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n_instances"),
        weighted_pearson(F.col("score"), F.col("impact"), one).alias("pearson_instance"),
        weighted_pearson(F.col("rx"), F.col("ry"), one).alias("spearman_instance"),
    )


def subset_correlation(points: DataFrame, subsets: dict[str, Column], out: str) -> DataFrame:
    """``instance_correlation`` of the points in each of several subsets that may overlap, finite values only.

    The points are ranked once for all subsets.
    """
    flags = {name: f"_in{i}" for i, name in enumerate(subsets)}
    pts = points.select(
        not_nan(F.col("score")).alias("score"), not_nan(F.col("impact")).alias("impact"), *[F.coalesce(c, F.lit(False)).alias(flags[k]) for k, c in subsets.items()]
    ).where("score IS NOT NULL AND impact IS NOT NULL")
    for x in ("score", "impact"):
        pts = skew.average_ranks(pts, [], x, {f"_{x}{f}": F.col(f) for f in flags.values()})
    rows = []
    for name, f in flags.items():
        one = F.when(F.col(f), 1.0)
        rows.append(F.struct(
            F.lit(name).alias(out), F.count(one).alias("n_instances"),
            weighted_pearson(F.col("score"), F.col("impact"), one).alias("pearson_instance"),
            weighted_pearson(F.col(f"_score{f}"), F.col(f"_impact{f}"), one).alias("spearman_instance"),
        ))
    return pts.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).where("n_instances > 0")


def score_impact(item_scores: DataFrame, impact: DataFrame) -> DataFrame:
    """Item score against impact: over all (item, container) points, and over item means."""
    one = F.lit(1.0)
    point = impact.join(item_scores, "item_key").agg(
        F.count("*").alias("n_points"), weighted_pearson(F.col("score"), F.col("impact"), one).alias("pearson_points")
    )
    means = impact.groupBy("item_key").agg(F.avg("impact").alias("impact")).join(item_scores, "item_key")
    item = with_ranks(means, []).agg(
        F.count("*").alias("n_items"),
        weighted_pearson(F.col("score"), F.col("impact"), one).alias("pearson_items"),
        weighted_pearson(F.col("rx"), F.col("ry"), one).alias("spearman_items"),
    )
    return item.select(
        "*", *[point.select(c).scalar().alias(c) for c in ("n_points", "pearson_points")]
    )


# ---- element scores to item scores ----------------------------------------------------


def score_cache(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean element score per (item, container); unknown elements are left out."""
    return scores.where(F.col("item_id") >= 0).groupBy(*by, "item_key", "container_id").agg(F.avg("score").alias("score"))


def broadcast_scores(elements: DataFrame, cache: DataFrame) -> DataFrame:
    """(item, container) scores back on elements, 0 where there is none."""
    return (
        elements.select("container_id", "element_id", "item_key")
        .join(cache.select("container_id", "item_key", "score"), ["container_id", "item_key"], "left")
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
    )


def masks(lookup: DataFrame) -> DataFrame:
    """Elements of each known item per container: a filter, not a matrix."""
    return lookup.where(F.col("item_id") >= 0).select("item_id", "container_id", "element_id")


def fill_unknown(scores: DataFrame, value: float) -> DataFrame:
    return scores.withColumn("score", F.when(F.col("item_id") < 0, F.lit(value)).otherwise(F.col("score")))


def keep_elements(lookup: DataFrame, kept: DataFrame | None) -> DataFrame:
    """All elements, or only those whose item is kept."""
    return lookup if kept is None else lookup.join(kept.select("item_key"), "item_key", "left_semi")


# ---- presence against the label ------------------------------------------------------------


def discriminativeness(inc: DataFrame, containers: DataFrame) -> DataFrame:
    """How far an item's presence separates the classes; always or never present items are dropped."""
    lab = containers.where("label IS NOT NULL")
    n = lab.agg(F.count("*")).scalar()
    p = lab.agg(F.sum("label")).scalar()
    agg = inc.join(lab.select("container_id", "label"), "container_id").groupBy("item_key").agg(
        F.count("*").alias("n_present"), F.sum("label").alias("n_pos")
    )
    agg = agg.select("*", n.alias("_n"), p.alias("_p")).where("n_present < _n")
    tpr = ratio(F.col("n_pos"), F.col("_p"))
    fpr = ratio(F.col("n_present") - F.col("n_pos"), F.col("_n") - F.col("_p"))
    p1, p0 = F.col("n_pos") / F.col("n_present"), (F.col("_p") - F.col("n_pos")) / (F.col("_n") - F.col("n_present"))
    auc = (1 + tpr - fpr) / 2
    return agg.select(
        "item_key",
        "n_present",
        (F.col("n_present") / F.col("_n")).alias("prevalence"),
        p1.alias("p1_given_m"),
        p0.alias("p1_given_not_m"),
        (p1 - p0).alias("delta_p1"),
        auc.alias("presence_auc"),
        (F.abs(auc - 0.5) * 2).alias("abs_disc"),
    )


def top_discriminative(item_scores: DataFrame, disc: DataFrame, k: int = 10) -> DataFrame:
    """Mean discriminativeness of the k best scored items, of all, and the rank correlation."""
    both = item_scores.join(disc.select("item_key", "abs_disc"), "item_key").where("abs_disc IS NOT NULL")
    top = both.orderBy(F.desc("score"), "item_key").limit(k).agg(F.avg("abs_disc")).scalar()
    ranked = with_ranks(both, [], "score", "abs_disc")
    return ranked.agg(
        F.count("*").alias("n_items"),
        F.avg("abs_disc").alias("mean_abs_disc"),
        weighted_pearson(F.col("rx"), F.col("ry"), F.lit(1.0)).alias("score_disc_spearman"),
    ).withColumn("top_k_abs_disc", top)


def top_bottom(item_scores: DataFrame, item_impact: DataFrame, k: int = 10) -> DataFrame:
    """Best k against worst k by score; k never exceeds half the items."""
    both = item_scores.join(item_impact, "item_key").select("item_key", "score", "impact")
    n = both.agg(F.count("*")).scalar()
    use = F.least(F.lit(k), F.floor(n / 2))
    tag = lambda d, side: d.withColumn("side", F.lit(side))
    head = tag(skew.top_rows(both.withColumn("_g", F.lit(1)), ["_g"], [F.desc("score"), F.col("item_key")], k), "top")
    tail = tag(skew.top_rows(both.withColumn("_g", F.lit(1)), ["_g"], [F.asc("score"), F.desc("item_key")], k), "bottom")
    rows = head.unionByName(tail).where(F.col("rank") <= use)
    top, bot = F.col("side") == "top", F.col("side") == "bottom"
    mean = lambda c, s: F.avg(F.when(s, F.col(c)))
    out = rows.agg(
        F.count(F.when(top, 1)).alias("k"),
        mean("score", top).alias("top_mean_score"),
        mean("score", bot).alias("bottom_mean_score"),
        mean("impact", top).alias("top_mean_impact"),
        mean("impact", bot).alias("bottom_mean_impact"),
    )
    return out.withColumn(
        "impact_ratio", F.when(F.col("bottom_mean_impact") > 1e-9, F.col("top_mean_impact") / F.col("bottom_mean_impact"))
    )


# ---- truth ------------------------------------------------------------------------------------


def positive_class(containers: DataFrame, truth: DataFrame) -> DataFrame:
    """The one label that carries truth, else 1."""
    marked = containers.join(truth.select("container_id").distinct(), "container_id", "left_semi")
    got = marked.agg(F.countDistinct("label").alias("k"), F.min("label").alias("only"))
    return got.select(F.when(F.col("k") == 1, F.col("only")).otherwise(1).alias("positive_class"))


def truth_items(truth: DataFrame, lookup: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Known items that own any truth element."""
    keys = ["container_id", "element_id"]
    el = lookup.where(F.col("item_id") >= 0).select(*keys, F.col("item_key").alias("truth_item"))
    return truth.select(*by, *keys).join(el, keys).select(*by, "truth_item").distinct()


def truth_vs_outside(
    item_scores: DataFrame, impact: DataFrame, truth_keys: DataFrame, containers: DataFrame, positive: int = 1
) -> DataFrame:
    """Truth items against the others over all, positive and correctly predicted positive containers.

    ``containers(container_id, label, prob)``; ``prob`` is P(label = 1).
    """
    pos = F.col("label") == positive
    p = F.col("prob") if positive == 1 else 1 - F.col("prob")
    subsets = F.filter(
        F.array(
            F.lit("all"),
            F.when(pos, "positive_class"),
            F.when(pos & (p > 0.5), "correct_positive_class"),
        ),
        lambda s: s.isNotNull(),
    )
    tagged = containers.select("container_id", F.explode(subsets).alias("subset"))
    means = (
        impact.join(tagged, "container_id").groupBy("subset", "item_key").agg(F.avg("impact").alias("impact"))
    )
    flag = truth_keys.select(F.col("truth_item").alias("item_key"), F.lit(True).alias("_t")).distinct()
    overall = impact.groupBy("item_key").agg(F.avg("impact").alias("m"))
    items = (
        item_scores.join(overall, "item_key")
        .join(flag, "item_key", "left")
        .select("item_key", "score", "m", F.coalesce("_t", F.lit(False)).alias("is_truth"))
    )
    ranked = skew.number_rows(items, [], [-F.col("m"), F.col("item_key")], "impact_rank")
    auc = skew.roc_auc(items.withColumn("_g", F.lit(1)), ["_g"], "is_truth", "score").select("auc").scalar()
    rank = ranked.where("is_truth").agg(F.avg("impact_rank")).scalar()
    t = F.col("is_truth")
    mean = lambda c, cond: F.avg(F.when(cond, F.col(c)))
    n_gt = items.where("is_truth").agg(F.count("*")).scalar()
    n_all = items.agg(F.count("*")).scalar()
    sg = items.agg(mean("score", t)).scalar()
    sn = items.agg(mean("score", ~t)).scalar()
    size = tagged.groupBy("subset").agg(F.count("*").alias("n_examples"))
    by_subset = means.join(items, "item_key").groupBy("subset").agg(
        mean("impact", t).alias("gt_mean_impact"), mean("impact", ~t).alias("non_gt_mean_impact")
    )
    return size.join(by_subset, "subset").select(
        "*",
        n_gt.alias("n_gt_items"),
        (n_all - n_gt).alias("n_non_gt_items"),
        sg.alias("gt_mean_score"),
        sn.alias("non_gt_mean_score"),
        auc.alias("score_auc"),
        rank.alias("gt_impact_rank"),
    )


def edge_to_element_truth(edges: DataFrame) -> DataFrame:
    """Elements that end a true edge."""
    ends = F.explode(F.array("src", "dst")).alias("element_id")
    return edges.select("container_id", ends).distinct()


def edge_scores(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Edge score = product of the scores of both ends."""
    s = scores.select("container_id", F.col("element_id").alias("src"), F.col("score").alias("s"))
    d = scores.select("container_id", F.col("element_id").alias("dst"), F.col("score").alias("d"))
    return edges.join(s, ["container_id", "src"]).join(d, ["container_id", "dst"]).withColumn(
        "score", F.col("s") * F.col("d")
    ).drop("s", "d")


def container_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUC of every container; ``scored(by, container_id, y, score)``."""
    return skew.roc_auc(scored, [*by, "container_id"], "y", "score")


def mean_auc(per: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population std over containers; degenerate containers are counted, not averaged."""
    return per.groupBy(*by).agg(
        F.avg("auc").alias("auc_mean"),
        F.stddev_pop("auc").alias("auc_std"),
        F.count("auc").alias("n_scored"),
        F.sum(F.col("auc").isNull().cast("long")).alias("n_degenerate"),
    )


def _fired_elements(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores of all elements of fired containers, flagged when they belong to the cause."""
    cause = truth.where("kind = 'node'").select("rule_id", "container_id", "element_id", F.lit(1).alias("cause"))
    where = cause.select("rule_id", "container_id").distinct()
    keys = ["rule_id", "container_id", "element_id"]
    return (
        scores.select("container_id", "element_id", "score")
        .join(where, "container_id")
        .join(cause, keys, "left")
        .withColumn("cause", F.coalesce("cause", F.lit(0)))
    )


def _pair_auc(pos: Column, neg: Column) -> Column:
    """AUC of two short lists of scores; NULL when one is empty."""
    beats = lambda p: F.aggregate(
        neg, F.lit(0.0), lambda n_won, n: n_won + F.when(n < p, 1.0).when(n == p, 0.5).otherwise(0.0)
    )
    won = F.aggregate(pos, F.lit(0.0), lambda u, p: u + beats(p))
    pairs = F.size(pos) * F.size(neg)
    return F.when(pairs > 0, won / pairs)


def _by_size(scores: DataFrame, truth: DataFrame) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """Scores and truth of the containers that fit in a row, and of the larger ones (None if there are none)."""
    # 64 marks weigh as much as an element
    known = scores.select("container_id", F.lit(64).alias("w")).unionByName(truth.select("container_id", F.lit(1).alias("w")))
    return skew.split_groups(known, ["container_id"], 64 * SMALL, scores, truth, weight="w")


def _rows(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per (rule, container): scores of the cause and of the others (no NULL), and the marks of its clauses and rivals."""
    els = scores.where("score IS NOT NULL").groupBy("container_id").agg(F.collect_list(F.struct("element_id", "score")).alias("els"))
    of_kind = lambda kinds, c: F.collect_list(F.when(F.col("kind").isin(*kinds), c))
    marks = truth.repartition("container_id").groupBy("container_id", "rule_id").agg(
        of_kind(["node"], F.col("element_id")).alias("node"),
        of_kind(["clause"], F.struct("ordinal", "element_id")).alias("clause"),
        of_kind(["family", "spurious"], F.struct("kind", "ordinal", "element_id")).alias("rivals"),
    )
    hit = lambda e: F.array_contains("node", e["element_id"])
    return marks.where(F.size("node") > 0).join(els, "container_id").withColumns(
        {
            "cause": F.transform(F.filter("els", hit), lambda e: e["score"]),
            "other": F.transform(F.filter("els", lambda e: ~hit(e)), lambda e: e["score"]),
        }
    )


def _marked(marks: str, ordinal: Column) -> Column:
    """Scores of the elements with this ordinal in ``marks``."""
    has = lambda e: F.exists(marks, lambda m: (m["ordinal"] == ordinal) & (m["element_id"] == e["element_id"]))
    return F.transform(F.filter("els", has), lambda e: e["score"])


def _row_node_auc(rows: DataFrame) -> DataFrame:
    return rows.select("rule_id", "container_id", _pair_auc(F.col("cause"), F.col("other")).alias("auc"))


def _row_dnf_auc(rows: DataFrame) -> DataFrame:
    ordinals = F.array_distinct(F.transform("clause", lambda m: m["ordinal"]))
    fired = rows.where(F.size("clause") > 0).withColumn("pos", F.transform(ordinals, lambda o: _marked("clause", o)))
    return fired.select(
        "rule_id",
        "container_id",
        _pair_auc(F.col("cause"), F.col("other")).alias("global_auc"),
        F.array_max(F.transform("pos", lambda p: _pair_auc(p, F.col("other")))).alias("instance_auc"),
    )


def _row_contrast(rows: DataFrame, kind: str) -> DataFrame:
    rival = F.filter("rivals", lambda m: (m["kind"] == kind) & ~F.array_contains("node", m["element_id"]))
    each = rows.where(F.size("rivals") > 0).withColumn("rival", rival).withColumn(
        "ordinal", F.explode(F.array_distinct(F.transform("rival", lambda m: m["ordinal"])))
    )
    auc = _pair_auc(_marked("rival", F.col("ordinal")), F.col("cause"))
    return each.select("rule_id", "ordinal", "container_id", auc.alias("auc"))


def _large_dnf_auc(scores: DataFrame, truth: DataFrame) -> DataFrame:
    flagged = _fired_elements(scores, truth)
    whole = skew.roc_auc(flagged, ["rule_id", "container_id"], "cause", "score", "global_auc")
    clause = truth.where("kind = 'clause'").select("rule_id", "container_id", "element_id", F.col("ordinal").alias("clause_id"))
    keys = ["rule_id", "container_id", "element_id"]
    pos = clause.join(flagged, keys).select("rule_id", "container_id", "clause_id", "score", F.lit(1).alias("y"))
    fired = clause.select("rule_id", "container_id", "clause_id").distinct()
    neg = flagged.where("cause = 0").join(fired, ["rule_id", "container_id"]).select(
        "rule_id", "container_id", "clause_id", "score", F.lit(0).alias("y")
    )
    per = skew.roc_auc(pos.unionByName(neg), ["rule_id", "container_id", "clause_id"], "y", "score")
    best = per.groupBy("rule_id", "container_id").agg(F.max("auc").alias("instance_auc"))
    return whole.select("rule_id", "container_id", "global_auc").join(best, ["rule_id", "container_id"])


def dnf_auc(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Per (rule, container): best fired clause (other clauses left out) and union of fired clauses.

    Containers of few elements are graded inside one row, larger ones by ranges of their scores.
    """
    few, many = _by_size(scores, truth.where("kind IN ('node', 'clause')"))
    per = _row_dnf_auc(_rows(*few))
    return per if many is None else per.unionByName(_large_dnf_auc(*many))


def _mean_dnf(per: DataFrame) -> DataFrame:
    return per.groupBy("rule_id").agg(
        F.avg("instance_auc").alias("instance_auc"),
        F.avg("global_auc").alias("global_auc"),
        F.count("instance_auc").alias("n_containers"),
    )


def dnf_roc(scores: DataFrame, truth: DataFrame) -> DataFrame:
    return _mean_dnf(dnf_auc(scores, truth))


def _large_contrast(scores: DataFrame, truth: DataFrame, kind: str) -> DataFrame:
    keys = ["rule_id", "container_id", "element_id"]
    cause = truth.where("kind = 'node'").select(*keys)
    rival = truth.where(F.col("kind") == kind).select(*keys, "ordinal").join(cause, keys, "left_anti")
    groups = rival.select("rule_id", "container_id", "ordinal").distinct()
    neg = cause.join(groups, ["rule_id", "container_id"]).select(*keys, "ordinal", F.lit(0).alias("y"))
    rows = rival.select(*keys, "ordinal", F.lit(1).alias("y")).unionByName(neg)
    scored = rows.join(scores.select("container_id", "element_id", "score"), ["container_id", "element_id"])
    per = skew.roc_auc(scored, ["rule_id", "ordinal", "container_id"], "y", "score")
    return per.select("rule_id", "ordinal", "container_id", "auc")


def _mean_contrast(per: DataFrame) -> DataFrame:
    return per.groupBy("rule_id", "ordinal").agg(F.avg("auc").alias("auc_mean"), F.count("auc").alias("n_containers"))


def contrast(scores: DataFrame, truth: DataFrame, kind: str) -> DataFrame:
    """Competitor elements (positives) against the cause (negatives), mean over containers."""
    few, many = _by_size(scores, truth)
    per = _row_contrast(_rows(*few), kind)
    return _mean_contrast(per if many is None else per.unionByName(_large_contrast(*many, kind)))


def truth_roc_all(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Whole set per rule: node, instance, global, family and per-competitor AUC with their maximum."""
    few, many = _by_size(scores, truth)
    rows = cut_lineage(_rows(*few))
    nodes, dnf = _row_node_auc(rows), _row_dnf_auc(rows)
    rivals = {kind: _row_contrast(rows, kind) for kind in ("family", "spurious")}
    if many is not None:
        flagged = _fired_elements(*many)
        nodes = nodes.unionByName(skew.roc_auc(flagged, ["rule_id", "container_id"], "cause", "score").select(nodes.columns))
        dnf = dnf.unionByName(_large_dnf_auc(*many))
        rivals = {kind: per.unionByName(_large_contrast(*many, kind)) for kind, per in rivals.items()}
    node, dnf = mean_auc(nodes, ["rule_id"]), _mean_dnf(dnf)
    fam = _mean_contrast(rivals["family"]).select("rule_id", F.col("auc_mean").alias("family_auc"))
    spur = _mean_contrast(rivals["spurious"]).groupBy("rule_id").agg(
        F.max("auc_mean").alias("spurious_auc_max"), F.count("auc_mean").alias("n_spurious")
    )
    joined = node.select("rule_id", F.col("auc_mean").alias("node_auc"))
    for part in (dnf.drop("n_containers"), fam, spur):
        joined = joined.join(part, "rule_id", "left")
    return joined.withColumn("instance_auc", F.coalesce("instance_auc", "node_auc")).withColumn(
        "global_auc", F.coalesce("global_auc", "node_auc")
    )


def truth_roc(scores: DataFrame, truth: DataFrame, unk_mode: str) -> DataFrame:
    """DNF ROC with unknown elements as they are, set to 0 or 0.5, or left out."""
    if unk_mode == "exclude":
        known = scores.where("item_id >= 0")
        return dnf_roc(known, truth)
    if unk_mode in ("zero", "half"):
        return dnf_roc(fill_unknown(scores, 0.0 if unk_mode == "zero" else 0.5), truth)
    if unk_mode != "as_is":
        raise ValueError(f"unknown mode {unk_mode!r}")
    return dnf_roc(scores, truth)


def require_element_scores(scores: DataFrame) -> DataFrame:
    """Fails when a method has no element scores."""
    if scores.isEmpty():
        raise ValueError("method has no element scores")
    return scores


def competitor_names(truth: DataFrame) -> DataFrame:
    """Name of every competitor column, by position where it has none."""
    named = truth.where("kind = 'spurious'").groupBy("rule_id", "ordinal").agg(F.max("item_key").alias("item_key"))
    fallback = F.concat(F.lit("spur"), F.col("ordinal").cast("string"))
    return named.select("rule_id", "ordinal", F.coalesce("item_key", fallback).alias("name"))
