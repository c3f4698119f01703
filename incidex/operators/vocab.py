"""Vocabulary: supports, ids, thresholds, coverage and statistics.

Columns used throughout: ``container_id, element_id, item_key, item_id, part_id``.
Item id -1 (unknown) is a value, never NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidex import skew
from incidex.functions.expr import ratio
from incidex.operators import graph
from incidex.session import cut_lineage

UNKNOWN = -1
IMBALANCE = 0.6  # share from which a class counts as the majority


def train_valid(df: DataFrame) -> DataFrame:
    return df.where(F.col("split").isin("training", "valid"))


def item_containers(parts: DataFrame, containers: DataFrame) -> DataFrame:
    """One row per (item, container): number of parts, largest part, label, split."""
    per = parts.groupBy("container_id", "item_key").agg(
        F.count("*").alias("n_parts"), F.max("n_elements").alias("n_elements")
    )
    return per.join(containers.select("container_id", "label", "split"), "container_id")


def build_vocab(parts: DataFrame, containers: DataFrame, min_sup: float = 0.01) -> DataFrame:
    """Per-item counts.  Container counts use all splits, weighted counts train+valid."""
    n_all = containers.agg(F.count("*")).scalar()
    tv = F.col("split").isin("training", "valid")
    occ = lambda cond: F.sum(F.when(cond, F.col("n_parts")).otherwise(0))
    return (
        item_containers(parts, containers)
        .groupBy("item_key")
        .agg(
            F.count("*").alias("n_containers"),
            F.sum((F.col("label") == 1).cast("long")).alias("n_pos"),
            F.sum((F.col("label") != 1).cast("long")).alias("n_neg"),
            F.sum("n_parts").alias("n_occurrences"),
            occ(tv).alias("wt"),
            occ(tv & (F.col("label") == 0)).alias("wt0"),
            occ(tv & (F.col("label") != 0)).alias("wt1"),
            F.max("n_elements").alias("n_elements"),
        )
        .withColumn("above_min_sup", F.col("n_containers") / n_all >= min_sup)
    )


def assign_ids(vocab: DataFrame, count: str = "n_containers") -> DataFrame:
    """Dense ids from 0 by falling count; the key breaks ties."""
    return skew.number_rows(vocab, [], [-F.col(count), F.col("item_key")], "item_id", first=0)


def build_lookup(membership: DataFrame, vocab: DataFrame, kept: DataFrame) -> DataFrame:
    """Element -> item id; items outside ``kept`` become unknown."""
    ids = vocab.join(kept.select("item_key"), "item_key", "left_semi").select("item_key", "item_id")
    return (
        membership.drop("item_id")
        .join(ids, "item_key", "left")
        .withColumn("item_id", F.coalesce("item_id", F.lit(UNKNOWN)))
    )


def incidence(membership: DataFrame) -> DataFrame:
    return membership.select("container_id", "item_key").distinct()


def class_counts(containers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return containers.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum((F.col("label") == 0).cast("long")).alias("n0"),
        F.sum((F.col("label") != 0).cast("long")).alias("n1"),
    )


def minority_size() -> Column:
    """Size of the minority class when the other class holds 60 % or more, else NULL."""
    n = F.greatest(F.col("n"), F.lit(1))
    return F.when(F.col("n0") / n >= IMBALANCE, F.col("n1")).when(
        F.col("n1") / n >= IMBALANCE, F.col("n0")
    )


def passes(pct: Column) -> Column:
    """Global cutoff int(pct*n), or the minority class's own cutoff on its own counts."""
    minority = minority_size()
    minority_wt = F.when(F.col("n0") / F.greatest(F.col("n"), F.lit(1)) >= IMBALANCE, F.col("wt1")).otherwise(
        F.col("wt0")
    )
    rescued = minority.isNotNull() & (minority_wt >= (pct * minority).cast("long"))
    return (F.col("wt") >= (pct * F.col("n")).cast("long")) | F.coalesce(rescued, F.lit(False))


def with_class_counts(vocab: DataFrame, containers: DataFrame) -> DataFrame:
    names = ("n", "n0", "n1")
    totals = class_counts(train_valid(containers)).select(F.struct(*names).alias("t")).scalar()
    return vocab.select("*", *[totals.getField(c).alias(c) for c in names])


def threshold_items(vocab: DataFrame, containers: DataFrame, pct: float) -> DataFrame:
    return with_class_counts(vocab, containers).where(passes(F.lit(pct))).select("item_key")


def fold_threshold(parts: DataFrame, fold_splits: DataFrame, pct: float) -> DataFrame:
    """Support again on each fold's own train+valid rows; all folds in one job."""
    tv = train_valid(fold_splits)
    totals = class_counts(tv, ["fold"])
    per = parts.groupBy("container_id", "item_key").agg(F.count("*").alias("n_parts"))
    sup = (
        per.join(tv.select("container_id", "fold", "label"), "container_id")
        .groupBy("fold", "item_key")
        .agg(
            F.sum("n_parts").alias("wt"),
            F.sum(F.when(F.col("label") == 0, F.col("n_parts")).otherwise(0)).alias("wt0"),
            F.sum(F.when(F.col("label") != 0, F.col("n_parts")).otherwise(0)).alias("wt1"),
        )
    )
    return sup.join(totals, "fold").where(passes(F.lit(pct))).select("fold", "item_key", "wt", "wt0", "wt1")


def resolve_cutoff(
    chosen: dict[str, float],
    dataset: str,
    explicit: float | None = None,
    enabled: bool = True,
    metadata: float | None = None,
) -> float | None:
    """Explicit value first, then off, then stored metadata, then the chosen table."""
    if explicit is not None:
        return explicit
    if not enabled:
        return None
    if metadata is not None:
        return metadata
    if dataset not in chosen:
        raise KeyError(f"no cutoff chosen for {dataset}")
    return chosen[dataset]


def apply_threshold(lookup: DataFrame, kept: DataFrame) -> DataFrame:
    """Rewrite a finished lookup: unknown stays unknown, dropped items become unknown."""
    flag = kept.select("item_key", F.lit(True).alias("_kept"))
    return (
        lookup.join(flag, "item_key", "left")
        .withColumn(
            "item_id",
            F.when(F.col("_kept") & (F.col("item_id") >= 0), F.col("item_id")).otherwise(UNKNOWN),
        )
        .drop("_kept")
    )


def kept_ids(vocab: DataFrame, kept: DataFrame) -> DataFrame:
    return vocab.join(kept.select("item_key"), "item_key", "left_semi").select("item_id", "item_key")


def fold_annotation(
    membership: DataFrame, vocab: DataFrame, parts: DataFrame, fold_splits: DataFrame, pct: float
) -> DataFrame:
    """Thresholded lookup of every fold, with the cutoff used."""
    kept = fold_threshold(parts, fold_splits, pct).select("fold", "item_key", F.lit(True).alias("_kept"))
    cut = class_counts(train_valid(fold_splits), ["fold"]).select(
        "fold", (F.lit(pct) * F.col("n")).cast("long").alias("cutoff")
    )
    folds = cut.agg(F.array_sort(F.collect_list(F.struct("fold", "cutoff")))).scalar()  # one entry per fold
    ids = vocab.select("item_key", "item_id", F.explode(folds).alias("f")).select("item_key", "item_id", "f.*")
    per_fold = (
        ids.join(kept, ["fold", "item_key"], "left")
        .select(
            "fold", "cutoff", "item_key", F.when(F.col("_kept"), F.col("item_id")).otherwise(UNKNOWN).alias("item_id")
        )
    )
    return membership.select("container_id", "element_id", "item_key").join(per_fold, "item_key")


def container_coverage(membership: DataFrame, kept: DataFrame) -> DataFrame:
    """Share of each container's elements whose item is kept (empty containers are absent)."""
    counts = membership.groupBy("container_id", "item_key").agg(F.count("*").alias("n"))
    flag = kept.select("item_key", F.lit(1).alias("_kept"))
    return (
        counts.join(flag, "item_key", "left")
        .groupBy("container_id")
        .agg((F.sum(F.col("n") * F.coalesce("_kept", F.lit(0))) / F.sum("n")).alias("share"))
    )


def coverage(membership: DataFrame, kept: DataFrame) -> DataFrame:
    return container_coverage(membership, kept).agg(
        F.count("*").alias("n_containers"), F.coalesce(F.avg("share"), F.lit(0.0)).alias("coverage")
    )


def sweep(
    membership: DataFrame, vocab: DataFrame, containers: DataFrame, thresholds: Sequence[float]
) -> DataFrame:
    """One row per threshold: cutoffs, vocabulary sizes, coverage of train+valid and of test.

    The thresholds are a short list, so each vocabulary row carries one flag per
    threshold and every container is read once for all of them.
    """
    th = list(thresholds)
    v = with_class_counts(vocab, containers)
    n_all = containers.agg(F.count("*")).scalar()
    minority = minority_size()
    flags = [passes(F.lit(t)).cast("int") for t in th]
    glob = [(F.col("wt") >= (F.lit(t) * F.col("n")).cast("long")).cast("int") for t in th]
    common = (F.col("n_containers") / n_all >= 0.01).cast("int")
    per_item = v.select("*", F.array(*flags).alias("kept"), F.array(*glob).alias("glob"), common.alias("common"))
    per_threshold = (
        per_item.select("n", "n0", "n1", "common", F.posexplode(F.arrays_zip("kept", "glob")).alias("i", "f"))
        .groupBy("i")
        .agg(
            F.sum("f.glob").alias("vocab_size_global"),
            F.sum("f.kept").alias("vocab_size"),
            ratio(F.sum(F.col("f.kept") * F.col("common")), F.sum("common")).alias("common_kept"),
            F.max("n").alias("n"),
            F.max(minority).alias("n_minority"),
        )
    )
    counts = membership.groupBy("container_id", "item_key").agg(F.count("*").alias("c"))
    sums = [F.sum(F.col("c") * F.col("kept")[i]) / F.sum("c") for i in range(len(th))]
    cover = (
        counts.join(per_item.select("item_key", "kept"), "item_key")
        .groupBy("container_id")
        .agg(F.array(*sums).alias("share"))
        .join(containers.select("container_id", "split"), "container_id")
        .select(F.col("split").isin("training", "valid").alias("tv"), F.posexplode("share").alias("i", "s"))
        .groupBy("i")
        .agg(
            F.avg(F.when(F.col("tv"), F.col("s"))).alias("coverage_tv"),
            F.avg(F.when(~F.col("tv"), F.col("s"))).alias("coverage_test"),
        )
    )
    t = F.element_at(F.array(*[F.lit(x) for x in th]), F.col("i") + 1)
    return (
        per_threshold.join(cover, "i")
        .select(
            t.alias("threshold"),
            (t * F.col("n")).cast("long").alias("min_count"),
            F.coalesce((t * F.col("n_minority")).cast("long"), F.lit(0)).alias("minority_cut"),
            "vocab_size_global",
            "vocab_size",
            (F.col("vocab_size") - F.col("vocab_size_global")).alias("n_rescued"),
            "coverage_tv",
            "coverage_test",
            (1 - F.col("coverage_tv")).alias("unk_rate"),
            F.coalesce("common_kept", F.lit(1.0)).alias("common_kept"),
        )
    )


def suggest(sweep_df: DataFrame, target: float = 0.8) -> DataFrame:
    """Highest threshold that still covers ``target``, and the thresholds near 80 % and 90 %."""
    cov, t = F.col("coverage_tv"), F.col("threshold")
    near80, near90 = cov.between(0.78, 0.82), cov.between(0.88, 0.92)
    return sweep_df.agg(
        F.max(F.when(cov >= target, t)).alias("suggested"),
        F.max_by("vocab_size", F.when(cov >= target, t)).alias("vocab_size"),
        F.sum(near80.cast("long")).alias("n_near_80"),
        F.sum(near90.cast("long")).alias("n_near_90"),
    )


def item_stats(vocab: DataFrame, containers: DataFrame, kept: DataFrame) -> DataFrame:
    n_all = containers.agg(F.count("*")).scalar()
    flag = kept.select("item_key", F.lit(True).alias("above_threshold"))
    return vocab.join(flag, "item_key", "left").select(
        "item_key",
        "n_elements",
        F.col("n_containers").alias("freq_count"),
        (F.col("n_containers") / n_all * 100).alias("freq_pct"),
        F.coalesce("above_threshold", F.lit(False)).alias("above_threshold"),
    )


def container_stats(parts: DataFrame, containers: DataFrame, kept: DataFrame) -> DataFrame:
    """Parts, elements and unknown elements of each container, empty containers included."""
    flag = kept.select("item_key", F.lit(1).alias("_kept"))
    per = (
        parts.join(flag, "item_key", "left")
        .groupBy("container_id")
        .agg(
            F.sum("n_elements").alias("n_elements"),
            F.count("*").alias("n_parts"),
            F.sum(F.when(F.col("_kept").isNull(), F.col("n_elements")).otherwise(0)).alias("n_unknown"),
        )
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_elements", "n_parts", "n_unknown")]
    return (
        containers.select("container_id", "split", "label")
        .join(per, "container_id", "left")
        .select("container_id", "split", "label", *zero)
        .withColumn("single_part", (F.col("n_parts") == 1) & (F.col("n_elements") > 0))
        .withColumn("pct_unknown", F.col("n_unknown") / F.greatest("n_elements", F.lit(1)) * 100)
    )


def size_bucket(c: Column) -> Column:
    return (
        F.when(c <= 2, "1-2").when(c <= 5, "3-5").when(c <= 9, "6-9").when(c <= 15, "10-15").otherwise("16+")
    )


def split_summary(stats: DataFrame) -> DataFrame:
    """Container statistics per split and over all splits, with the exact median."""
    both = stats.withColumn("split", F.explode(F.array("split", F.lit("all"))))
    main = both.groupBy("split").agg(
        F.count("*").alias("n"),
        F.sum(F.col("single_part").cast("long")).alias("n_single"),
        F.sum((F.col("n_unknown") > 0).cast("long")).alias("n_with_unknown"),
        F.sum("n_unknown").alias("n_unknown"),
        F.avg("pct_unknown").alias("mean_pct_unknown"),
        F.avg("n_parts").alias("mean_parts"),
        F.min("n_parts").alias("min_parts"),
        F.max("n_parts").alias("max_parts"),
    )
    return main.join(skew.quantiles(both, ["split"], "n_parts", {"median_parts": 0.5}), "split")


def parts_distribution(stats: DataFrame) -> DataFrame:
    both = stats.withColumn("split", F.explode(F.array("split", F.lit("all"))))
    return both.groupBy("split", "n_parts").agg(F.count("*").alias("n"))


def vocab_stats(parts: DataFrame, n_containers: Column) -> DataFrame:
    """Corpus-level vocabulary figures from occurrence counts."""
    v = parts.groupBy("item_key").agg(F.count("*").alias("n"), F.max("n_elements").alias("size"))
    sup = F.col("n") / n_containers
    bucket = size_bucket(F.col("size"))
    single = parts.groupBy("container_id").agg(F.count("*").alias("p")).where("p = 1").agg(F.count("*")).scalar()
    return v.agg(
        F.count("*").alias("vocab_size"),
        F.sum((sup >= 0.01).cast("long")).alias("above_1pct"),
        F.sum((sup >= 0.05).cast("long")).alias("above_5pct"),
        F.avg("size").alias("mean_size"),
        F.sum("n").alias("encoding_length"),
        *[
            F.sum((bucket == b).cast("long")).alias(f"size_{i}")
            for i, b in enumerate(("1-2", "3-5", "6-9", "10-15", "16+"))
        ],
    ).withColumn("single_part_containers", single)


def support_band(pct: Column) -> Column:
    return (
        F.when(pct < 1, "<1%").when(pct < 5, "1-5%").when(pct < 10, "5-10%").when(pct < 20, "10-20%").otherwise(">20%")
    )


def distributions(parts: DataFrame, vocab: DataFrame, n_containers: Column) -> DataFrame:
    """Three histograms in one table: item size, support band, parts per container (15+ pooled)."""
    size = vocab.groupBy(F.col("n_elements").cast("string").alias("bucket")).agg(F.count("*").alias("n"))
    band = vocab.groupBy(support_band(F.col("n_containers") / n_containers * 100).alias("bucket")).agg(
        F.count("*").alias("n")
    )
    per = parts.groupBy("container_id").agg(F.count("*").alias("p"))
    ppc = per.groupBy(F.when(F.col("p") >= 15, "15+").otherwise(F.col("p").cast("string")).alias("bucket")).agg(
        F.count("*").alias("n")
    )
    tag = lambda d, name: d.select(F.lit(name).alias("histogram"), "bucket", "n")
    return tag(size, "size").unionByName(tag(band, "support")).unionByName(tag(ppc, "parts"))


def enrichment(vocab: DataFrame, containers: DataFrame) -> DataFrame:
    """(positive rate) / (max(neg, 1) rate) per item."""
    n_pos = F.greatest(containers.agg(F.sum("label")).scalar(), F.lit(1))
    n_neg = F.greatest(containers.agg(F.sum(1 - F.col("label"))).scalar(), F.lit(1))
    pos, neg = F.col("n_pos") / n_pos, F.greatest("n_neg", F.lit(1)) / n_neg
    return vocab.select(
        "item_key",
        "n_containers",
        (F.col("n_pos") / F.greatest("n_containers", F.lit(1)) * 100).alias("pct_pos"),
        (pos / neg).alias("enrichment"),
    )


def signal_to_noise(share: Column) -> Column:
    """Precision of the better class against the rest; ``share`` in [0, 1]."""
    best = F.greatest(share, 1 - share)
    return best / F.greatest(1 - best, F.lit(1e-6))


def snr_table(inc: DataFrame, labels: DataFrame) -> DataFrame:
    """Items under two label sets (``label``, ``label2``)."""
    j = inc.join(labels.select("container_id", "label", "label2"), "container_id")
    agg = j.groupBy("item_key").agg(
        F.count("*").alias("n_containers"),
        F.avg(F.col("label").cast("double")).alias("c1_first"),
        F.avg(F.col("label2").cast("double")).alias("c1_second"),
    )
    first, second = signal_to_noise(F.col("c1_first")), signal_to_noise(F.col("c1_second"))
    return agg.select("*", first.alias("snr_first"), second.alias("snr_second"), (second - first).alias("delta"))


def split_counts(inc: DataFrame, containers: DataFrame, split: str = "test") -> DataFrame:
    """Distinct containers of one split per item (0 for items that miss it)."""
    inside = containers.where(F.col("split") == split).select("container_id")
    hits = inc.join(inside, "container_id", "left_semi").groupBy("item_key").agg(F.count("*").alias("n"))
    return inc.select("item_key").distinct().join(hits, "item_key", "left").select(
        "item_key", F.coalesce("n", F.lit(0)).alias("n_split")
    )


def full_coverage(lookup: DataFrame, sizes: DataFrame) -> DataFrame:
    """Containers fully known (no unknown element) and fully covered (every element present)."""
    per = lookup.groupBy("container_id").agg(
        F.min("item_id").alias("low"), F.count("*").alias("n")
    )
    return per.join(sizes, "container_id").agg(
        F.count("*").alias("n_containers"),
        F.sum((F.col("low") != UNKNOWN).cast("long")).alias("n_fully_known"),
        F.sum((F.col("n") == F.col("n_elements")).cast("long")).alias("n_fully_covered"),
    )


def item_sets(lookup: DataFrame) -> DataFrame:
    """Sorted known item ids of each container; its size is bounded by the vocabulary kept."""
    known = lookup.where(F.col("item_id") != UNKNOWN).select("container_id", "item_id").distinct()
    return known.groupBy("container_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def item_lists(membership: DataFrame) -> DataFrame:
    keys = membership.select("container_id", "item_key").distinct()
    return keys.groupBy("container_id").agg(F.array_sort(F.collect_set("item_key")).alias("items"))


def top_items(vocab: DataFrame, n_containers: Column, n: int = 25, min_pct: float = 1.0, min_size: int = 2) -> DataFrame:
    """Best items by support% x size."""
    sup = F.col("n_containers") / n_containers * 100
    return (
        vocab.select("item_key", "n_containers", "n_elements", sup.alias("support"))
        .where((F.col("support") >= min_pct) & (F.col("n_elements") >= min_size))
        .withColumn("sel_score", F.round(F.col("support") * F.col("n_elements"), 3))
        .orderBy(F.desc("sel_score"), "item_key")
        .limit(n)
    )


def rule_candidates(
    vocab: DataFrame, kept: DataFrame, n_containers: Column, min_cover: float = 5.0, n: int = 20
) -> DataFrame:
    """Items fit for rules: two elements or more, else one; the cover floor adapts to the best item."""
    ok = vocab.where("above_min_sup").join(kept.select("item_key"), "item_key", "left_semi")
    best_size = ok.agg(F.max("n_elements")).scalar()
    need = F.when(best_size >= 2, 2).otherwise(1)
    cand = ok.where(F.col("n_elements") >= need).withColumn("cover", F.col("n_containers") / n_containers * 100)
    best = cand.agg(F.max("cover")).scalar()
    floor = F.when(best >= min_cover, F.lit(min_cover)).otherwise(F.greatest(F.lit(1.0), best))
    return (
        cand.where(F.col("cover") >= floor)
        .select("item_key", "n_containers", "n_elements", "cover")
        .orderBy(F.desc("cover"), "item_key")
        .limit(n)
    )


def pool_rare(membership: DataFrame, n_containers: Column, tau: float, prefix: Column, pooled: Column) -> DataFrame:
    """Rare leftover keys go to a coarse bucket; ``prefix`` tells which keys are leftovers."""
    counts = membership.select("container_id", "item_key").distinct().groupBy("item_key").agg(F.count("*").alias("_n"))
    rare = F.col("_n") < F.lit(tau) * n_containers
    mapping = counts.select("item_key", F.when(rare & prefix, pooled).otherwise(F.col("item_key")).alias("pooled_key"))
    return membership.join(mapping, "item_key")


def fold_keys(support: DataFrame, bare: Column) -> DataFrame:
    """Bare keys move to the best-supported full key with the same skeleton.

    ``support`` has ``item_key, skeleton, n``; the result maps item_key to new_key.
    """
    best = (
        support.where(~bare)
        .groupBy("skeleton")
        .agg(F.max_by("item_key", F.struct("n", "item_key")).alias("best_key"))
    )
    return support.join(best, "skeleton", "left").select(
        "item_key", F.when(bare, F.coalesce("best_key", "item_key")).otherwise(F.col("item_key")).alias("new_key")
    )


def strip_prefix(keys: DataFrame, pattern: str) -> DataFrame:
    """Stripped key and how many original keys it stands for (a collision is > 1)."""
    bare = keys.select(F.regexp_replace("item_key", pattern, "").alias("bare_key"), "item_key").distinct()
    return bare.groupBy("bare_key").agg(F.count("*").alias("n_keys"))


def require_no_collision(stripped: DataFrame) -> DataFrame:
    """Fails when two keys fall together."""
    message = F.concat(F.lit("prefix collision on "), F.col("bare_key"))
    return stripped.where(F.when(F.col("n_keys") > 1, F.raise_error(message).isNotNull()).otherwise(F.lit(True)))


def raw_stats(columns: DataFrame, weighted: str = "wt") -> DataFrame:
    """Item counts from a columns table; the weighted count falls back on occurrences."""
    return columns.select(
        "item_key",
        F.col("n_containers").alias("n"),
        F.coalesce(F.col(weighted), F.col("n_occurrences")).alias("weighted"),
        F.coalesce("wt0", F.lit(0)).alias("wt0"),
        F.coalesce("wt1", F.lit(0)).alias("wt1"),
    )


def support_floor(containers: DataFrame, pct: float) -> DataFrame:
    """max(1, int(pct * train+valid containers))."""
    return train_valid(containers).agg(
        F.greatest(F.lit(1), (F.lit(pct) * F.count("*")).cast("long")).alias("s_min")
    )


def spread_lookup(elements: DataFrame, direct: DataFrame, edges: DataFrame) -> DataFrame:
    """Fill unmapped elements from mapped neighbours, round by round, to a fixpoint.

    ``direct`` maps (container_id, element_id) to item_id; a mapped unknown is final.
    Each round the smallest neighbour id (by element id) wins.  A round maps an element or is the last.
    (container_id, element_id) is a key.  Containers of up to ``graph.SMALL`` rows are filled inside one row each.
    """
    by = ["container_id"]
    tables = [elements.select(*by, "element_id"), direct.select(*by, "element_id", "item_id"), edges.select(*by, "src", "dst")]
    sizes = tables[0].select(*by).unionByName(tables[1].select(*by)).unionByName(tables[2].select(*by))
    few, rest = skew.split_groups(sizes, by, graph.SMALL, *tables)
    kinds = {c: tables[1].schema[c].dataType.simpleString() for c in ("element_id", "item_id")}
    out = graph.close_rows(dict(zip(("elements", "direct", "edges"), few)), by, "element_id long, item_id long", _spread)
    out = out.select(*by, *[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    return out if rest is None else out.unionByName(_spread_rounds(*rest))


def _spread(elements: list, direct: list, edges: list) -> dict[str, np.ndarray]:
    row, ids = elements[0], elements[1].to_numpy(zero_copy_only=False)
    order, place = graph.number_nodes(row, ids)
    given = direct[2].is_valid().to_numpy(zero_copy_only=False)
    at = place(direct[0][given], direct[1].to_numpy(zero_copy_only=False)[given])
    item, known = np.full(len(ids), UNKNOWN), np.zeros(len(ids), bool)
    item[at[at >= 0]] = direct[2].drop_null().to_numpy()[at >= 0]
    known[at[at >= 0]] = True
    src, dst = (place(edges[0], e.to_numpy(zero_copy_only=False)) for e in edges[1:3])
    held = (src >= 0) & (dst >= 0)
    src, dst = src[held], dst[held]
    while True:
        offer = known[src] & ~known[dst]
        best = np.full(len(ids), len(ids))
        np.minimum.at(best, dst[offer], src[offer])
        new = np.flatnonzero(best < len(ids))
        if not len(new):
            break
        item[new], known[new] = item[best[new]], True
    return {"row": row[order], "element_id": ids[order], "item_id": item}


def _spread_rounds(elements: DataFrame, direct: DataFrame, edges: DataFrame) -> DataFrame:
    keys = ["container_id", "element_id"]
    state = cut_lineage(elements.select(*keys).join(direct.select(*keys, "item_id"), keys, "left"))
    open_rows = state.where("item_id IS NULL").count()
    while open_rows:
        known = state.where("item_id IS NOT NULL").select(
            "container_id", F.col("element_id").alias("src"), F.col("item_id").alias("from_item")
        )
        todo = state.where("item_id IS NULL").select("container_id", F.col("element_id").alias("dst"))
        offer = (
            edges.join(todo, ["container_id", "dst"], "left_semi")
            .join(known, ["container_id", "src"])
            .groupBy("container_id", F.col("dst").alias("element_id"))
            .agg(F.min_by("from_item", "src").alias("new_item"))
        )
        state = cut_lineage(
            state.join(offer, keys, "left").select(*keys, F.coalesce("item_id", "new_item").alias("item_id"))
        )
        left = state.where("item_id IS NULL").count()
        if left == open_rows:
            break
        open_rows = left
    return state.withColumn("item_id", F.coalesce("item_id", F.lit(UNKNOWN)))


def direct_lookup(elements: DataFrame, lookup: DataFrame) -> DataFrame:
    """Join on matching ids; a container without any lookup row fails."""
    keys = ["container_id", "element_id"]
    present = lookup.select("container_id").distinct().withColumn("_known", F.lit(True))
    checked = elements.join(present, "container_id", "left")
    message = F.concat(F.lit("no lookup for container "), F.col("container_id").cast("string"))
    missing = F.when(F.col("_known").isNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return (
        checked.where(missing)
        .drop("_known")
        .join(lookup.select(*keys, "item_id"), keys, "left")
        .withColumn("item_id", F.coalesce("item_id", F.lit(UNKNOWN)))
    )
