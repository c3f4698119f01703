"""Leave-one-out impact, necessity hypotheses, pooling and graph aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidex import skew
from incidex.functions.expr import binary_entropy, clamp, logit, not_nan, ratio
from incidex.session import cut_lineage

UNKNOWN_KEY = "UNK"
CATEGORY_ORDER = ("HH", "HL", "LH", "LL")


# ---- leave-one-out impact ------------------------------------------------------------


def leave_one_out(pred: DataFrame) -> DataFrame:
    """|p_full - p_without| per (container, item); missing predictions are dropped."""
    gap = not_nan(F.abs(F.col("p_full") - F.col("p_without")))
    return pred.select("container_id", "item_key", gap.alias("impact")).where("impact IS NOT NULL")


def item_impact(impact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return impact.groupBy(*by, "item_key").agg(
        F.avg("impact").alias("mean_impact"), F.stddev_pop("impact").alias("std_impact"), F.count("*").alias("n_containers")
    )


def grouped_rows(impact: DataFrame, scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean impact and support of each item, next to its score."""
    rows = impact.groupBy(*by, "item_key").agg(F.avg("impact").alias("impact"), F.count("*").alias("support"))
    return rows.join(scores, "item_key")


def impact_frame(impact: DataFrame, scores: DataFrame, containers: DataFrame) -> DataFrame:
    """Long frame with a container tag unique over splits, importance and its logit."""
    return (
        impact.join(scores.select("item_key", F.col("score").alias("importance")), "item_key")
        .join(containers.select("container_id", "split", "label"), "container_id")
        .select(
            F.concat_ws(":", "split", F.col("container_id").cast("string")).alias("container_tag"),
            "container_id",
            "item_key",
            "impact",
            "importance",
            logit(F.col("importance")).alias("importance_logit"),
            F.col("label").cast("double").alias("label"),
        )
    )


# ---- H0 / H1 / H2 ----------------------------------------------------------------------


def _first_per_item(df: DataFrame) -> DataFrame:
    """One row per (item, container): the one with the smallest source key."""
    rest = [c for c in df.columns if c not in ("container_id", "item_key", "source_key")]
    packed = df.groupBy("container_id", "item_key").agg(F.min_by(F.struct(*rest), "source_key").alias("r"))
    return packed.select("container_id", "item_key", *[F.col(f"r.{c}").alias(c) for c in rest])


def local_high(df: DataFrame, mode: str) -> DataFrame:
    """Adds ``is_local_hi``: global mean, in-container p50/p75, or above the container's unknown mean.

    The rows are stored: a sum of doubles that is made twice may differ in its last bit, and a row must equal its own threshold.
    """
    return _local_high(cut_lineage(df), mode)


def _local_high(df: DataFrame, mode: str) -> DataFrame:
    """``local_high`` of stored rows."""
    imp = F.col("impact")
    if mode == "global":
        return df.withColumn("is_local_hi", imp >= df.agg(F.avg("impact")).scalar())
    if mode in ("p50", "p75"):
        cut = skew.quantiles(df, ["container_id"], "impact", {"_thr": 0.5 if mode == "p50" else 0.75})
        return df.join(cut, "container_id").withColumn("is_local_hi", imp >= F.col("_thr")).drop("_thr")
    if mode == "beat_unk":
        unk = df.where(F.col("item_key") == UNKNOWN_KEY).groupBy("container_id").agg(F.avg("impact").alias("_unk"))
        mean = df.agg(F.avg("impact")).scalar()
        j = df.join(unk, "container_id", "left")
        return j.withColumn("is_local_hi", imp > F.coalesce("_unk", mean)).drop("_unk")
    raise ValueError(f"unknown local filter {mode!r}")


def hypotheses(df: DataFrame, mode: str, importance_thr: Column | None = None) -> DataFrame:
    """h2: locally high.  h1: not h2, but the container has an important h2 row.  h0: neither."""
    return _hypotheses(cut_lineage(df), mode, importance_thr)


def _hypotheses(df: DataFrame, mode: str, importance_thr: Column | None = None) -> DataFrame:
    """``hypotheses`` of stored rows."""
    thr = df.agg(F.avg("importance")).scalar() if importance_thr is None else importance_thr
    marked = cut_lineage(_local_high(df, mode).withColumnRenamed("is_local_hi", "h2"))
    anchors = (
        marked.where(F.col("h2") & (F.col("importance") > thr)).select("container_id").distinct().withColumn("_a", F.lit(True))
    )
    j = marked.join(anchors, "container_id", "left")
    return (
        j.withColumn("h1", ~F.col("h2") & F.col("_a").isNotNull())
        .withColumn("h0", ~F.col("h2") & F.col("_a").isNull())
        .drop("_a")
    )


def categorise(df: DataFrame, importance_thr: Column, impact_thr: Column) -> DataFrame:
    hi, im = F.col("avg_importance") > importance_thr, F.col("avg_impact") > impact_thr
    return df.withColumn(
        "category", F.when(hi & im, "HH").when(hi & ~im, "HL").when(~hi & im, "LH").otherwise("LL")
    )


def hypothesis_ratios(df: DataFrame, mode: str, min_containers: int = 5) -> DataFrame:
    """Per-item shares of h2/h1/h0, mean impact of the other items nearby, class purity, category.

    ``df(container_id, item_key, source_key, impact, importance, label)``.
    """
    one = _first_per_item(df)
    if mode != "beat_unk":
        one = one.where(F.col("item_key") != UNKNOWN_KEY)
    one = cut_lineage(one)
    flagged = _hypotheses(one, mode)
    around = one.groupBy("container_id").agg(F.sum("impact").alias("_sum"), F.count("*").alias("_cnt"))
    j = flagged.join(around, "container_id").withColumn(
        "cooc", (F.col("_sum") - F.col("impact")) / F.greatest(F.col("_cnt") - 1, F.lit(1))
    )
    cnt = lambda c: F.sum(c.cast("long"))
    agg = (
        j.groupBy("item_key")
        .agg(
            F.count("*").alias("total"),
            cnt(F.col("h2")).alias("n_h2"),
            cnt(F.col("h1")).alias("n_h1"),
            cnt(F.col("h0")).alias("n_h0"),
            F.avg("importance").alias("avg_importance"),
            F.avg("impact").alias("avg_impact"),
            F.avg("cooc").alias("cooc_avg_impact"),
            F.greatest(cnt(F.col("label") >= 0.5), cnt(F.col("label") < 0.5)).alias("_major"),
        )
        .where(F.col("total") >= min_containers)
    )
    agg = agg.withColumn("purity", F.col("_major") / F.col("total")).drop("_major")
    for h in ("h2", "h1", "h0"):
        agg = agg.withColumn(f"ratio_{h}", F.col(f"n_{h}") / F.col("total"))
    return categorise(agg, one.agg(F.avg("importance")).scalar(), one.agg(F.avg("impact")).scalar())


def category_summary(ratios: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), F.col("category"))
    return ratios.groupBy("category").agg(
        F.count("*").alias("n_items"),
        F.avg("ratio_h2").alias("mean_h2"),
        F.avg("ratio_h1").alias("mean_h1"),
        F.avg("ratio_h0").alias("mean_h0"),
        F.avg("avg_importance").alias("mean_importance"),
        F.avg("avg_impact").alias("mean_impact"),
    ).withColumn("position", order)


# ---- coherence of element scores -----------------------------------------------------------


def coherence(scores: DataFrame) -> DataFrame:
    """Variance of element scores within items and between item means, averaged over containers."""
    per = scores.groupBy("container_id", "item_key").agg(F.var_pop("score").alias("v"), F.avg("score").alias("m"))
    box = per.groupBy("container_id").agg(F.avg("v").alias("within"), F.var_pop("m").alias("between"))
    return box.agg(F.count("*").alias("n_containers"), F.avg("within").alias("within"), F.avg("between").alias("between"))


def consistency(scores: DataFrame) -> DataFrame:
    """Mean sample variance over (container, item) groups with two elements or more."""
    per = scores.groupBy("container_id", "item_key").agg(F.var_samp("score").alias("v"), F.count("*").alias("n"))
    return per.where("n >= 2").agg(F.count("*").alias("n_groups"), F.avg("v").alias("mean_variance"))


def item_scores(scores: DataFrame) -> DataFrame:
    """Mean and max element score inside a container, then the mean over containers."""
    per = scores.groupBy("container_id", "item_key").agg(F.avg("score").alias("mean"), F.max("score").alias("max"))
    return per.groupBy("item_key").agg(
        F.avg("mean").alias("score_mean"), F.avg("max").alias("score_max"), F.count("*").alias("n_containers")
    )


def collapsed(item_scores_df: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """Groups of two or more item scores whose population spread is below the threshold."""
    return item_scores_df.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop("score").alias("std")).withColumn(
        "collapsed", (F.col("n") >= 2) & (F.col("std") < threshold)
    )


def rank_scale(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str = "scaled") -> DataFrame:
    """Position in [0, 1] inside the group by a total order (no ties)."""
    numbered = skew.number_rows(df, by, order, "_r")
    size = df.groupBy(*by).agg(F.count("*").alias("_n"))
    share = (F.col("_r") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    return numbered.join(size, list(by)).withColumn(out, share).drop("_r", "_n")


# ---- pooling ---------------------------------------------------------------------------------


def pool_parts(vectors: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, max and sum of every vector dimension per part (unknown elements share one part)."""
    return vectors.select(*by, F.posexplode("vector").alias("dim", "v")).groupBy(*by, "dim").agg(
        F.avg(F.col("v").cast("double")).alias("mean"),
        F.max(F.col("v").cast("double")).alias("max"),
        F.sum(F.col("v").cast("double")).alias("sum"),
    )


def pack(pooled: DataFrame, by: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Pooled dimensions back into one array per part: the chosen figures one after another."""
    cells = F.array_sort(F.collect_list(F.struct("dim", *parts)))
    one = pooled.groupBy(*by).agg(cells.alias("c"))  # a vector has a fixed length
    return one.select(*by, F.concat(*[F.col("c").getField(p) for p in parts]).alias("vector"))


def size_weights(elements: DataFrame, by: Sequence[str], unknown: Column) -> DataFrame:
    """1 / (elements of the item in its container); unknown elements weigh 1."""
    size = elements.groupBy(*by).agg(F.count("*").alias("_n"))
    return elements.join(size, list(by)).withColumn("weight", F.when(unknown, 1.0).otherwise(1 / F.col("_n"))).drop("_n")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def occlusion(vectors: DataFrame) -> DataFrame:
    """1 - cos(mean of all, mean without the item), never negative; mean per item over its containers.

    ``vectors(container_id, item_key, vector)``.  The container's own sum is computed once
    and the item's sum taken off it.
    """
    item = pool_parts(vectors, ["container_id", "item_key"]).select("container_id", "item_key", "dim", "sum")
    full = item.groupBy("container_id", "dim").agg(F.sum("sum").alias("total"))
    j = item.join(full, ["container_id", "dim"]).withColumn("rest", F.col("total") - F.col("sum"))
    dist = j.groupBy("container_id", "item_key").agg(
        (1 - ratio(F.sum(F.col("total") * F.col("rest")), F.sqrt(F.sum(F.col("total") ** 2)) * F.sqrt(F.sum(F.col("rest") ** 2)))).alias("d")
    ).where("d IS NOT NULL")
    return dist.groupBy("item_key").agg(F.avg(F.greatest("d", F.lit(0.0))).alias("occlusion"), F.count("*").alias("n"))


def attention_scores(df: DataFrame) -> DataFrame:
    """Mean attention per item, and mean probability of the predicted class.

    ``df(item_key, alpha, probs array<double>)``.
    """
    best = F.array_position("probs", F.array_max("probs")) - 1
    return df.withColumn("cls", best).groupBy("item_key").agg(
        F.avg("alpha").alias("attention"),
        F.avg(F.array_max("probs") * F.col("alpha")).alias("class_attention"),
        F.sum((F.col("cls") == 0).cast("long")).alias("n_first_class"),
        F.count("*").alias("n"),
    )


# ---- monitored penalties ------------------------------------------------------------------------


def score_entropy(df: DataFrame, by: Sequence[str], x: str = "score") -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(binary_entropy(F.col(x))).alias("entropy"), F.avg((F.col(x) > 0.5).cast("double")).alias("share_high")
    )


def score_penalty(item_scores_df: DataFrame, tau: int) -> DataFrame:
    """Sum of all item scores but the top tau, and mean entropy."""
    top = item_scores_df.orderBy(F.desc("score"), "item_key").limit(tau).agg(F.coalesce(F.sum("score"), F.lit(0.0))).scalar()
    return item_scores_df.agg(
        (F.sum("score") - top).alias("size_penalty"), F.avg(binary_entropy(F.col("score"))).alias("entropy_penalty")
    )


def kl_to_prior(df: DataFrame, by: Sequence[str], r: float, weight: Column | None = None) -> DataFrame:
    """Weighted mean Bernoulli KL divergence of a score from the prior r."""
    p = clamp(F.col("score"), 1e-6, 1 - 1e-6)
    kl = p * F.ln(p / r) + (1 - p) * F.ln((1 - p) / (1 - r))
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*by).agg(ratio(F.sum(w * kl), F.sum(w)).alias("kl"))


# ---- graph aggregates -----------------------------------------------------------------------------


def degree_histogram(elements: DataFrame, edges: DataFrame) -> DataFrame:
    deg = edges.groupBy("container_id", F.col("dst").alias("element_id")).agg(F.count("*").alias("d"))
    j = elements.select("container_id", "element_id").join(deg, ["container_id", "element_id"], "left")
    return j.groupBy(F.coalesce("d", F.lit(0)).alias("degree")).agg(F.count("*").alias("n"))


def class_weights(labels: DataFrame, lo: float = 0.1, hi: float = 10.0) -> DataFrame:
    """neg / pos per task, clamped; missing labels are left out.  ``labels(task, y)``."""
    pos, neg = F.sum((F.col("y") == 1).cast("long")), F.sum((F.col("y") == 0).cast("long"))
    return labels.where("y IS NOT NULL").groupBy("task").agg(
        pos.alias("n_pos"), neg.alias("n_neg"), clamp(neg / F.greatest(pos, F.lit(1)), lo, hi).alias("pos_weight")
    )


def standardise(containers: DataFrame, column: str) -> DataFrame:
    """z-score with mean and population std of the training split only, and the value restored from it."""
    train = containers.where("split = 'training'")
    m, sd = train.agg(F.avg(column)).scalar(), train.agg(F.stddev_pop(column)).scalar()
    z = ratio(F.col(column) - m, sd)
    return containers.withColumn("z", z).withColumn("restored", F.col("z") * sd + m)


def neighbour_aggregate(x: DataFrame, edges: DataFrame, mode: str, eps: float = 0.0) -> DataFrame:
    """One message-passing step with fixed weights.

    ``sum``: neighbours + (1 + eps) x self; ``norm``: D^-1/2 A D^-1/2 with self loops;
    ``mean``: mean of neighbours + self.  ``x(container_id, element_id, v)``.
    """
    src = x.select("container_id", F.col("element_id").alias("src"), "v")
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    if mode == "norm":
        loops = x.select("container_id", F.col("element_id").alias("src"), F.col("element_id").alias("dst"))
        links = edges.select("container_id", "src", "dst").unionByName(loops)
        deg = links.groupBy("container_id", F.col("dst").alias("k")).agg(F.count("*").alias("d"))
        j = (
            links.join(src, ["container_id", "src"])
            .join(deg.select("container_id", F.col("k").alias("src"), F.col("d").alias("ds")), ["container_id", "src"])
            .join(deg.select("container_id", F.col("k").alias("dst"), F.col("d").alias("dd")), ["container_id", "dst"])
        )
        msg = F.col("v") / F.sqrt(F.col("ds") * F.col("dd"))
        return j.groupBy("container_id", F.col("dst").alias("element_id")).agg(F.sum(msg).alias("out"))
    got = edges.join(src, ["container_id", "src"]).groupBy("container_id", F.col("dst").alias("element_id")).agg(
        F.sum(F.col("v") * w).alias("_s"), F.avg(F.col("v") * w).alias("_m")
    )
    j = x.join(got, ["container_id", "element_id"], "left")
    if mode == "sum":
        out = F.coalesce("_s", F.lit(0.0)) + (1 + eps) * F.col("v")
    elif mode == "mean":
        out = F.coalesce("_m", F.lit(0.0)) + F.col("v")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return j.select("container_id", "element_id", out.alias("out"))


def unit_length(df: DataFrame, by: Sequence[str], x: str = "out") -> DataFrame:
    """L2 normalisation of a long vector (one row per dimension)."""
    norm = df.groupBy(*by).agg(F.sqrt(F.sum(F.col(x) ** 2)).alias("_n"))
    return df.join(norm, list(by)).withColumn(x, ratio(F.col(x), F.greatest("_n", F.lit(1e-12)))).drop("_n")


def multi_aggregate(x: DataFrame, edges: DataFrame, mean_log_degree: float) -> DataFrame:
    """Sum, mean, max and std of neighbours, each plain, amplified and attenuated by log degree."""
    src = x.select("container_id", F.col("element_id").alias("src"), "v")
    agg = edges.join(src, ["container_id", "src"]).groupBy("container_id", F.col("dst").alias("element_id")).agg(
        F.sum("v").alias("sum"),
        F.avg("v").alias("mean"),
        F.max("v").alias("max"),
        F.stddev_pop("v").alias("std"),
        F.count("*").alias("deg"),
    )
    up = F.ln(F.col("deg") + 1) / mean_log_degree
    cols = [F.col("container_id"), F.col("element_id")]
    for a in ("sum", "mean", "max", "std"):
        cols += [F.col(a), (F.col(a) * up).alias(f"{a}_amp"), (F.col(a) / up).alias(f"{a}_att")]
    return agg.select(*cols)


def edge_softmax(edges: DataFrame, slope: float = 0.2) -> DataFrame:
    """Softmax of leaky-ReLU edge scores over the edges that enter a node.

    Max and sum are aggregated and joined back, so a node with very many edges is not one task.
    """
    e = edges.withColumn("_a", F.when(F.col("score") > 0, F.col("score")).otherwise(F.col("score") * slope))
    key = ["container_id", "dst"]
    top = e.groupBy(*key).agg(F.max("_a").alias("_m"))
    ex = e.join(top, key).withColumn("_e", F.exp(F.col("_a") - F.col("_m")))
    total = e.join(top, key).groupBy(*key).agg(F.sum(F.exp(F.col("_a") - F.col("_m"))).alias("_t"))
    return ex.join(total, key).withColumn("alpha", F.col("_e") / F.col("_t")).drop("_a", "_m", "_e", "_t")


def container_pool(x: DataFrame, weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return x.groupBy("container_id").agg(F.sum(F.col("v") * w).alias("add"), F.avg(F.col("v") * w).alias("mean"))


def edge_to_element_score(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean score of the edges at an element (both ends count); 0 for isolated elements."""
    ends = edges.select("container_id", F.explode(F.array("src", "dst")).alias("element_id"), "score")
    mean = ends.groupBy("container_id", "element_id").agg(F.avg("score").alias("score"))
    return elements.select("container_id", "element_id").join(mean, ["container_id", "element_id"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


def element_weights(elements: DataFrame, item_weight: DataFrame, mode: str, fixed: float = 1.0) -> DataFrame:
    """Item weight on elements; unknown elements get a fixed value, the mean weight, or are dropped."""
    j = elements.join(item_weight.select("item_key", "w"), "item_key", "left")
    known = F.col("item_id") >= 0
    if mode == "fixed":
        return j.withColumn("w", F.when(known, F.col("w")).otherwise(F.lit(fixed)))
    if mode == "shared":
        mean = item_weight.agg(F.avg("w")).scalar()
        return j.withColumn("w", F.when(known, F.col("w")).otherwise(mean))
    if mode == "ignore":
        return j.where(known)
    raise ValueError(f"unknown mode {mode!r}")


# ---- summaries -------------------------------------------------------------------------------------


def summary_fields(metrics: DataFrame, by: Sequence[str], names: Sequence[str], suffix: str = "_all") -> DataFrame:
    """Long (metric, value) rows to named scalar columns."""
    wide = metrics.groupBy(*by).pivot("metric", list(names)).agg(F.first("value"))
    return wide.select(*by, *[F.col(n).alias(n + suffix) for n in names])


def epoch_items(df: DataFrame) -> DataFrame:
    """Mean importance and impact per (epoch, item); NaN counts as missing."""
    return df.groupBy("epoch", "item_key").agg(
        F.avg(not_nan(F.col("importance"))).alias("importance"), F.avg(not_nan(F.col("impact"))).alias("impact")
    )


def snapshot(pooled: DataFrame, scores: DataFrame, impact: DataFrame) -> DataFrame:
    """Per (container, item): mean vector, importance clipped to [0, 1] (0.5 when unknown), impact or NULL."""
    return (
        pooled.join(scores.select("item_key", "importance"), "item_key", "left")
        .join(impact.select("container_id", "item_key", "impact"), ["container_id", "item_key"], "left")
        .withColumn("importance", clamp(F.coalesce("importance", F.lit(0.5)), 0.0, 1.0))
    )


def flatten_scores(df: DataFrame, first_class: int = 0) -> DataFrame:
    """Per-class item scores to one score per item of the first class."""
    mine = df.where(F.col("cls") == first_class).select("item_key").distinct()
    return df.join(mine, "item_key", "left_semi").groupBy("item_key").agg(F.avg("score").alias("score"))


# ---- vectors --------------------------------------------------------------------------------------------


def pca2(vectors: DataFrame) -> DataFrame:
    """Two principal components per row of ``vectors(id, vector array<float>)``."""
    data = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("x"))
    model = PCA(k=2, inputCol="x", outputCol="p").fit(data)
    p = vector_to_array("p")
    return model.transform(data).select("id", p[0].alias("pc1"), p[1].alias("pc2"))


def probe(vectors: DataFrame, fold: Column) -> float | None:
    """Held-out balanced accuracy of a linear probe on unit-length rows; None below 30 rows.

    ``vectors(vector, y, n)``.
    """
    v = F.col("vector").cast("array<double>")
    norm = F.sqrt(dot(v, v))
    data = vectors.select(
        array_to_vector(F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))).alias("x"), "y", fold.alias("f")
    )
    stats = {r["f"]: r for r in data.groupBy("f").agg(F.count("*").alias("n"), F.countDistinct("y").alias("k")).collect()}
    if sum(r["n"] for r in stats.values()) < 30 or any(stats.get(s) is None or stats[s]["k"] < 2 for s in (0, 1)):
        return None
    model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=50, regParam=1e-3).fit(data.where("f = 0"))
    recall = model.transform(data.where("f = 1")).groupBy("y").agg(
        F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("r")
    )
    return recall.agg(F.avg("r")).collect()[0][0]
