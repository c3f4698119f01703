"""Co-occurrence, itemsets, Boolean rules and the truth they define.

A rule is a disjunction of clauses, a clause a set of items, in long form:
``rules(rule_id, clause_id, item_key)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidex import skew
from incidex.functions.expr import jaccard, ratio
from incidex.operators import itemcounts as ic
from incidex.operators import unions
from incidex.operators.vocab import signal_to_noise
from incidex.session import cut_lineage

J_HIGH = 0.70
P_PROXY = 0.70


# ---- co-occurrence ----------------------------------------------------------


def cooccurrence(inc: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pair profile of a bounded item list, one row per ordered pair that co-occurs.

    ``a, b, inter, n_a, n_b, jaccard, p_b_given_a, p_a_given_b``.
    """
    rows = inc.select("container_id", ic.index_column(names).alias("i")).where("i IS NOT NULL")
    counts = ic.pair_counts(ic.basket_counts(rows, ["container_id"], "i"), len(names))
    label = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    named = counts.select(label[F.col("i")].alias("a"), label[F.col("j")].alias("b"), "n")
    single = named.where("a = b")
    both = named.where("a <> b").select(
        F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"),
        F.col("n").alias("inter"),
    ).select("p.a", "p.b", "inter")
    na = single.select("a", F.col("n").alias("n_a"))
    nb = single.select(F.col("a").alias("b"), F.col("n").alias("n_b"))
    return both.join(na, "a").join(nb, "b").select(
        "a",
        "b",
        "inter",
        "n_a",
        "n_b",
        jaccard(F.col("inter"), F.col("n_a"), F.col("n_b")).alias("jaccard"),
        (F.col("inter") / F.col("n_a")).alias("p_b_given_a"),
        (F.col("inter") / F.col("n_b")).alias("p_a_given_b"),
    )


def proxies(profile: DataFrame, threshold: float = P_PROXY) -> DataFrame:
    """Items that show up in at least ``threshold`` of another item's containers."""
    return profile.where(F.col("p_b_given_a") >= threshold).select(
        F.col("a").alias("item_key"), F.col("b").alias("proxy"), "jaccard", F.col("p_b_given_a").alias("p")
    )


def ambiguity(rules: DataFrame, proxy: DataFrame) -> DataFrame:
    """Proxies of rule items that are not themselves in the rule."""
    items = rules.select("rule_id", "item_key").distinct()
    inside = items.select("rule_id", F.col("item_key").alias("proxy"))
    return items.join(proxy, "item_key").join(inside, ["rule_id", "proxy"], "left_anti")


# ---- itemsets ----------------------------------------------------------------


def itemsets(inc: DataFrame, min_count: int) -> DataFrame:
    """Frequent itemsets of any size: ``items`` (sorted), ``n``."""
    n_baskets = max(1, inc.select("container_id").distinct().count())
    baskets = inc.groupBy("container_id").agg(F.collect_set("item_key").alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (min_count - 0.5) / n_baskets))
    return model.fit(baskets).freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))


def maximal(freq: DataFrame) -> DataFrame:
    """Itemsets without a frequent superset.

    All subsets of a frequent set are frequent, so a set is covered exactly when it
    arises from some frequent set by dropping one item: an equi-join, no containment scan.
    """
    drop_one = F.transform("items", lambda x: F.array_except("items", F.array(x)))
    covered = freq.where(F.size("items") > 1).select(F.explode(drop_one).alias("items")).distinct()
    return freq.join(covered, "items", "left_anti")


# ---- clauses and rules ---------------------------------------------------------


def _pairs_above(profile: DataFrame, threshold: float) -> set[tuple[str, str]]:
    """Redundant pairs of the bounded item list."""
    rows = profile.where((F.col("jaccard") >= threshold) & (F.col("a") < F.col("b"))).select("a", "b").collect()
    return {(r["a"], r["b"]) for r in rows}


def clauses(inc: DataFrame, names: Sequence[str], max_size: int = 3, j_high: float = J_HIGH) -> DataFrame:
    """Clauses of 1..max_size items that are not redundant and genuinely narrower.

    ``items`` (in list order), ``size``, ``n1``.
    """
    spark = inc.sparkSession
    rows = inc.select("container_id", ic.index_column(names).alias("i")).where("i IS NOT NULL")
    baskets = ic.basket_counts(rows, ["container_id"], "i")
    redundant = _pairs_above(cooccurrence(inc, names), j_high)

    def fine(c: tuple[int, ...]) -> bool:
        return not any(tuple(sorted((names[x], names[y]))) in redundant for x, y in combinations(c, 2))

    combos = [c for k in range(1, max_size + 1) for c in combinations(range(len(names)), k) if k == 1 or fine(c)]
    counted = ic.combination_counts(baskets, len(names), combos, "all")
    meta = spark.createDataFrame(
        [(i, [names[x] for x in c], len(c)) for i, c in enumerate(combos)], "combo long, items array<string>, size int"
    )
    all_rows = meta.join(counted, "combo").select("combo", "items", "size", F.col("n").alias("n1"))
    single = all_rows.where("size = 1").select(F.col("items")[0].alias("item"), F.col("n1").alias("n_item"))
    smallest = (
        all_rows.select("combo", F.explode("items").alias("item"))
        .join(single, "item")
        .groupBy("combo")
        .agg(F.min("n_item").alias("smallest"))
    )
    ok = (F.col("size") == 1) | ((F.col("n1") > 0) & (F.col("n1") < F.col("smallest")))
    return all_rows.join(smallest, "combo").where(ok).select("items", "size", "n1")


def structural_clauses(
    inc: DataFrame, names: Sequence[str], n_containers: Column, min_only: float = 0.05, j_high: float = J_HIGH, profile: DataFrame | None = None
) -> DataFrame:
    """Single items, and pairs with a flag telling whether both sides also occur alone; ``profile``: their co-occurrence, if at hand."""
    p = (cooccurrence(inc, names) if profile is None else profile).where("a < b")
    pairs = p.where(
        (F.col("inter") > 0) & (F.col("jaccard") < j_high) & (F.col("inter") < F.least("n_a", "n_b"))
    ).select(
        F.array("a", "b").alias("items"),
        F.col("inter").alias("n_match"),
        (
            (F.col("n_a") - F.col("inter") >= F.lit(min_only) * n_containers)
            & (F.col("n_b") - F.col("inter") >= F.lit(min_only) * n_containers)
        ).alias("and_valid"),
    )
    singles = (
        inc.where(F.col("item_key").isin(list(names)))
        .groupBy("item_key")
        .agg(F.count("*").alias("n_match"))
        .select(F.array("item_key").alias("items"), "n_match", F.lit(True).alias("and_valid"))
    )
    return singles.unionByName(pairs)


def clause_baskets(inc: DataFrame, clause_list: Sequence[Sequence[str]]) -> DataFrame:
    """Baskets of fired clause indexes (a clause fires when all its items are present)."""
    long = inc.sparkSession.createDataFrame([(i, k) for i, c in enumerate(clause_list) for k in c], "c int, item_key string")
    return fired_baskets(inc, long)


def fired_baskets(inc: DataFrame, clause_items: DataFrame) -> DataFrame:
    """The same for clauses in rows ``(c int, item_key)``.

    Equal baskets of items are merged before they meet the clauses.
    """
    spec = clause_items.distinct()
    held = ic.basket_counts(inc.join(spec.select("item_key").distinct(), "item_key", "left_semi"), ["container_id"], "item_key")
    spec = spec.join(spec.groupBy("c").agg(F.count("*").alias("need")), "c")
    items = held.select("basket", "n", F.explode("basket").alias("item_key"))
    fired = items.join(spec, "item_key").groupBy("basket", "n", "c", "need").agg(F.count("*").alias("got")).where("got = need")
    per = fired.groupBy("basket", "n").agg(F.array_sort(F.collect_set("c")).alias("fired"))
    return per.groupBy(F.col("fired").alias("basket")).agg(F.sum("n").alias("n"))


def dnf_rules(
    inc: DataFrame,
    clause_list: Sequence[Sequence[str]],
    n_containers: int,
    min_cov: float = 5.0,
    max_clauses: int = 4,
    per_size: int = 50,
) -> DataFrame:
    """Every OR of up to ``max_clauses`` clauses with enough coverage, best 50 per size.

    Coverage of a part of a rule never exceeds the rule's own, so dropping parts of
    failed rules changes nothing: the sizes of all unions are read off the intersections instead.
    """
    inter = cut_lineage(unions.intersections(clause_baskets(inc, clause_list), max_clauses))
    sets = unions.combinations(inc.sparkSession, len(clause_list), max_clauses)
    counted = sets.withColumn("key", unions.key_of(F.col("ids"))).join(unions.union_sizes(sets, inter), "key")
    kept = counted.withColumn("pct1", F.col("n") / n_containers * 100).where((F.col("n") > 0) & (F.round("pct1", 1) >= min_cov))
    top = skew.top_rows(kept, ["size"], [F.desc("n"), F.col("key")], per_size)
    return top.select(F.col("size").alias("n_clauses"), F.col("ids").alias("clause_ids"), text_of("ids", clause_list), F.col("n").alias("n1"), "pct1", "rank")


def text_of(ids: str, clause_list: Sequence[Sequence[str]], name: str = "rule") -> Column:
    """The rule that an array of clause numbers stands for."""
    texts = F.array(*[F.lit("(" + " & ".join(c) + ")") for c in clause_list])
    return F.array_join(F.transform(ids, lambda i: F.get(texts, i)), " | ").alias(name)


def fired_clauses(inc: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, clause_id, container_id) for every clause whose items are all present."""
    need = rules.groupBy("rule_id", "clause_id").agg(F.countDistinct("item_key").alias("need"))
    spec = rules.join(need, ["rule_id", "clause_id"])
    return (
        inc.join(spec, "item_key")
        .groupBy("rule_id", "clause_id", "container_id", "need")
        .agg(F.count("*").alias("got"))
        .where("got = need")
        .select("rule_id", "clause_id", "container_id")
    )


def fired_containers(inc: DataFrame, rules: DataFrame) -> DataFrame:
    return fired_clauses(inc, rules).select("rule_id", "container_id").distinct()


def apply_rules(containers: DataFrame, inc: DataFrame, rules: DataFrame) -> DataFrame:
    """Synthetic label of every (rule, container): 1 when any clause fires."""
    ids = rules.select("rule_id").distinct().agg(F.collect_set("rule_id")).scalar()
    hits = fired_containers(inc, rules).withColumn("synth", F.lit(1))
    grid = containers.select("container_id", "label", F.explode(ids).alias("rule_id"))
    return grid.join(hits, ["rule_id", "container_id"], "left").withColumn("synth", F.coalesce("synth", F.lit(0)))


def annotate(elements: DataFrame, rules: DataFrame, spurious: DataFrame, family: DataFrame) -> DataFrame:
    """Element truth in long form.

    kind ``clause`` (ordinal = fired clause), ``node`` (any fired clause), ``spurious``
    (ordinal = position of the correlate) and ``family``; only containers where the rule fires.
    """
    named = rules.select("rule_id", "clause_id", "item_key").distinct()
    mark = lambda kind, ordinal: F.struct("rule_id", "item_key", kind.alias("kind"), ordinal.cast("int").alias("ordinal"))
    extra = spurious.select("rule_id", mark(F.lit("spurious"), F.col("ordinal")).alias("x")).unionByName(
        family.select("rule_id", mark(F.lit("family"), F.lit(0)).alias("x"))
    ).groupBy("rule_id").agg(F.collect_list("x").alias("extra"))
    clauses = named.groupBy("rule_id", "clause_id").agg(
        F.collect_set("item_key").alias("items"),
        F.collect_list(mark(F.lit("clause"), F.col("clause_id"))).alias("own"),
        F.collect_list(mark(F.lit("node"), F.lit(0))).alias("node"),
    ).join(extra, "rule_id", "left")
    marks = F.concat("own", "node", F.coalesce("extra", F.array()))
    clauses = clauses.agg(F.collect_list(F.struct("items", marks.alias("marks"))).alias("clauses"))  # the rules are a short list
    # the items of rules that a container holds, and with them the marks of its fired clauses
    elements = elements.select("container_id", "element_id", "item_key")
    ruled = elements.select("container_id", "item_key").join(F.broadcast(named.select("item_key").distinct()), "item_key", "left_semi")
    held = ruled.groupBy("container_id").agg(F.collect_set("item_key").alias("held")).crossJoin(F.broadcast(clauses))
    fired = F.filter("clauses", lambda c: F.forall(c["items"], lambda i: F.array_contains("held", i)))
    held = held.select("container_id", F.flatten(F.transform(fired, lambda c: c["marks"])).alias("marks"))
    own = F.array_distinct(F.filter("marks", lambda m: m["item_key"] == F.col("item_key")))
    found = elements.join(held, "container_id").select("container_id", "element_id", F.explode(own).alias("m"))
    return found.select("container_id", "m.item_key", "element_id", "m.rule_id", "m.kind", "m.ordinal")


def annotate_edges(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """Edges whose two ends are both rule elements."""
    node = truth.where("kind = 'node'").select("rule_id", "container_id", "element_id")
    src = node.withColumnRenamed("element_id", "src")
    dst = node.withColumnRenamed("element_id", "dst")
    return edges.join(src, ["container_id", "src"]).join(dst, ["rule_id", "container_id", "dst"])


# ---- rule scores -----------------------------------------------------------------


def hash_order(key: Column, seed: str) -> Column:
    """Order of a reproducible draw."""
    return F.md5(F.concat(F.lit(seed + "|"), key.cast("string")))


def separation(containers: DataFrame, items: DataFrame, inc: DataFrame, rules: DataFrame, n: int, seed: str) -> DataFrame:
    """1 - mean Jaccard over a sampled match x non-match grid of n by n containers.

    ``inc`` decides which rules fire, ``items(container_id, item_key)`` gives the sets that are compared; containers without items
    are drawn but not compared.  Both sides are drawn from the first containers in hash order: ever more of them, until each rule
    has its n on both sides.  Rules are judged on these containers only.
    """
    rule_ids = rules.agg(F.collect_set("rule_id")).scalar()
    order = [hash_order(F.col("container_id"), seed), F.col("container_id")]
    size = 16 * n
    while True:
        head = cut_lineage(containers.select("container_id").orderBy(*order).limit(size))
        side = fired_containers(inc.join(head, "container_id", "left_semi"), rules).withColumn("hit", F.lit(True))
        tagged = head.select("container_id", F.explode(rule_ids).alias("rule_id")).join(side, ["rule_id", "container_id"], "left")
        tagged = cut_lineage(tagged.withColumn("hit", F.coalesce("hit", F.lit(False))))
        sides = tagged.groupBy("rule_id").agg(F.count_if("hit").alias("yes"), F.count_if(~F.col("hit")).alias("no"))
        if head.count() < size or sides.where(F.least("yes", "no") < n).isEmpty():
            break
        size *= 8
    drawn = cut_lineage(skew.top_rows(tagged, ["rule_id", "hit"], order, n).select("rule_id", "container_id", "hit"))
    sets = items.join(drawn.select("container_id").distinct(), "container_id", "left_semi")
    sets = sets.groupBy("container_id").agg(F.collect_set("item_key").alias("items"))
    drawn = drawn.join(sets, "container_id")
    grouped = drawn.groupBy("rule_id").agg(  # at most n sets a side
        F.collect_list(F.when(F.col("hit"), F.col("items"))).alias("match"),
        F.collect_list(F.when(~F.col("hit"), F.col("items"))).alias("rest"),
    )

    def score(a):
        return F.aggregate(
            "rest",
            F.lit(0.0),
            lambda acc, b: acc + F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)),
        )

    rows = grouped.select("rule_id", F.explode("match").alias("a"), "rest", F.size("rest").alias("m"))
    return rows.groupBy("rule_id").agg(
        F.coalesce(1 - ratio(F.sum(score(F.col("a"))), F.sum("m")), F.lit(0.0)).alias("separation")
    )


def redundancy(rules: DataFrame, profile: DataFrame, general: DataFrame) -> DataFrame:
    """0.6 x mean pair Jaccard + 0.4 x min(1, 0.2 x general variants inside the rule).

    ``general(item_key, variant)``: variant is a more general form of item_key.
    """
    items = rules.select("rule_id", "item_key").distinct()
    packed = items.groupBy("rule_id").agg(F.array_sort(F.collect_set("item_key")).alias("k"))
    pair = F.flatten(
        F.transform("k", lambda a: F.transform(F.filter("k", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    mean_j = (  # a rule holds a handful of items
        packed.select("rule_id", F.explode(pair).alias("p"))
        .select("rule_id", "p.a", "p.b")
        .join(profile.select("a", "b", "jaccard"), ["a", "b"], "left")
        .groupBy("rule_id")
        .agg(F.avg(F.coalesce("jaccard", F.lit(0.0))).alias("mean_j"))
    )
    inside = items.select("rule_id", F.col("item_key").alias("variant"))
    pen = (
        items.join(general, "item_key")
        .join(inside, ["rule_id", "variant"])
        .groupBy("rule_id")
        .agg(F.count("*").alias("n_general"))
    )
    spur = 0.6 * F.coalesce("mean_j", F.lit(0.0)) + 0.4 * F.least(F.lit(1.0), 0.2 * F.coalesce("n_general", F.lit(0)))
    return packed.select("rule_id").join(mean_j, "rule_id", "left").join(pen, "rule_id", "left").select(
        "rule_id", spur.alias("spurious")
    )


def balance(pct: Column) -> Column:
    return 1 - F.abs(pct - 50) / 50


def score_rules(coverage: DataFrame, redund: DataFrame, sep: DataFrame) -> DataFrame:
    """score = balance x separation x (1 - spurious); rules without separation score 0."""
    j = coverage.join(redund, "rule_id").join(sep, "rule_id", "left").withColumn("balance", balance(F.col("pct1")))
    score = F.col("balance") * F.col("separation") * (1 - F.col("spurious"))
    return j.withColumn("score", F.coalesce(score, F.lit(0.0)))


def label_confusion(labelled: DataFrame) -> DataFrame:
    """Original label against the rule's label per rule."""
    s, o = F.col("synth") == 1, F.col("label") == 1
    cnt = lambda c: F.sum(c.cast("long"))
    agg = labelled.groupBy("rule_id").agg(
        cnt(s & o).alias("s1_o1"),
        cnt(s & ~o).alias("s1_o0"),
        cnt(~s & o).alias("s0_o1"),
        cnt(~s & ~o).alias("s0_o0"),
    )
    n1 = F.col("s1_o1") + F.col("s1_o0")
    prec = F.coalesce(ratio(F.col("s1_o1"), n1), F.lit(0.0))
    total = n1 + F.col("s0_o1") + F.col("s0_o0")
    snr = F.when(n1 > 0, F.least(prec / F.greatest(1 - prec, F.lit(1e-6)), F.lit(1e6))).otherwise(0.0)
    return agg.select(
        "*", prec.alias("precision"), snr.alias("snr"), ((F.col("s1_o1") + F.col("s0_o0")) / total).alias("consistency")
    )


def label_snr_by_item(inc: DataFrame, labelled: DataFrame) -> DataFrame:
    """Each item's class-1 share and signal-to-noise under the original and every rule's label."""
    j = inc.join(labelled.select("rule_id", "container_id", "label", "synth"), "container_id")
    agg = j.groupBy("rule_id", "item_key").agg(
        F.count("*").alias("n"),
        F.avg(F.col("label").cast("double")).alias("orig_c1"),
        F.avg(F.col("synth").cast("double")).alias("synth_c1"),
    )
    o, s = signal_to_noise(F.col("orig_c1")), signal_to_noise(F.col("synth_c1"))
    return agg.select("*", o.alias("orig_snr"), s.alias("synth_snr"), (s - o).alias("snr_delta"))


# ---- correlates and difficulty ------------------------------------------------------


def phi(n11: Column, n1: Column, nf: Column, n: Column) -> Column:
    """Correlation of two binary columns from counts; NULL when one is constant."""
    den = F.sqrt((n1 * (n - n1)).cast("double")) * F.sqrt((nf * (n - nf)).cast("double"))
    return ratio(n * n11 - n1 * nf, den)


def rule_correlations(inc: DataFrame, fired: DataFrame, rules: DataFrame, n: Column) -> DataFrame:
    """phi of every (rule, item outside the rule): ``rule_id, item_key, corr, sep, supp, n_fired``."""
    supp = inc.groupBy("item_key").agg(F.count("*").alias("supp"))
    nf = fired.groupBy("rule_id").agg(F.count("*").alias("n_fired"))
    both = inc.join(fired, "container_id").groupBy("rule_id", "item_key").agg(F.count("*").alias("n11"))
    ids = rules.select("rule_id").distinct().agg(F.collect_set("rule_id")).scalar()
    grid = supp.withColumn("rule_id", F.explode(ids))
    inside = rules.select("rule_id", "item_key").distinct()
    j = (
        grid.join(inside, ["rule_id", "item_key"], "left_anti")
        .join(both, ["rule_id", "item_key"], "left")
        .join(nf, "rule_id")
        .withColumn("n11", F.coalesce("n11", F.lit(0)))
        .withColumn("_n", n)
    )
    return j.select(
        "rule_id",
        "item_key",
        phi(F.col("n11"), F.col("supp"), F.col("n_fired"), F.col("_n")).alias("corr"),
        (F.col("n_fired") - F.col("n11")).alias("sep"),
        "supp",
        "n_fired",
    ).where("corr IS NOT NULL")


def correlates(corrs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Strong correlates by sign; without a strong positive one the best positive is kept, flagged."""
    c = F.col("corr")
    best = corrs.where(c > 0).groupBy("rule_id").agg(
        F.max("corr").alias("best"), F.max_by("item_key", F.struct("corr", "item_key")).alias("best_item")
    )
    j = corrs.join(best, "rule_id", "left")
    fallback = (F.col("best") < threshold) & (F.col("item_key") == F.col("best_item"))
    sign = F.when(c >= threshold, "pos").when(c <= -threshold, "neg").when(fallback, "pos")
    return (
        j.select("rule_id", "item_key", "corr", "sep", "supp", "n_fired", sign.alias("sign"),
                 F.coalesce(fallback & (c < threshold), F.lit(False)).alias("fallback"))
        .where("sign IS NOT NULL")
    )


def separability(corrs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Smallest ``sep`` over strong positive correlates, else the number of fired containers."""
    strong = F.when(F.col("corr") >= threshold, F.col("sep"))
    return corrs.groupBy("rule_id").agg(
        F.coalesce(F.min(strong), F.max("n_fired")).alias("separability"), F.max(F.abs("corr")).alias("max_corr")
    )


def difficulty(fired: DataFrame, truth: DataFrame, corrs: DataFrame) -> DataFrame:
    """Clause overlap, support spread, strongest correlation, median truth elements per positive.

    ``fired(rule_id, clause_id, container_id)``; a rule has few clauses, so the clause sets of a
    container are short and clause pairs are counted from merged baskets.
    """
    supp = fired.groupBy("rule_id", "clause_id").agg(F.count("*").alias("n"))
    spread = supp.groupBy("rule_id").agg((F.max("n") / F.greatest(F.min("n"), F.lit(1))).alias("spread"))
    baskets = fired.groupBy("rule_id", "container_id").agg(F.array_sort(F.collect_set("clause_id")).alias("b"))
    merged = baskets.groupBy("rule_id", "b").agg(F.count("*").alias("n"))
    pair = F.flatten(
        F.transform("b", lambda x: F.transform(F.filter("b", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    )
    inter = (
        merged.select("rule_id", "n", F.explode(pair).alias("p"))
        .groupBy("rule_id", "p.x", "p.y")
        .agg(F.sum("n").alias("inter"))
    )
    sx = supp.select("rule_id", F.col("clause_id").alias("x"), F.col("n").alias("nx"))
    sy = supp.select("rule_id", F.col("clause_id").alias("y"), F.col("n").alias("ny"))
    overlap = (
        inter.join(sx, ["rule_id", "x"])
        .join(sy, ["rule_id", "y"])
        .groupBy("rule_id")
        .agg(F.max(jaccard(F.col("inter"), F.col("nx"), F.col("ny"))).alias("overlap"))
    )
    size = truth.where("kind = 'node'").groupBy("rule_id", "container_id").agg(
        F.count("*").alias("n")
    )
    median = skew.quantiles(size, ["rule_id"], "n", {"median_truth": 0.5})
    r = separability(corrs).select("rule_id", "max_corr")
    return (
        spread.join(overlap, "rule_id", "left")
        .join(r, "rule_id", "left")
        .join(median, "rule_id", "left")
        .withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    )


# ---- look-alike families ---------------------------------------------------------------


def look_alikes(tokens: DataFrame, tol: int = 2) -> DataFrame:
    """Pairs where one key's token set contains the other and sizes differ by at most ``tol``.

    ``tokens(item_key, toks array<string>)``.  Each key lists its own set with up to
    ``tol`` tokens dropped, so containment is an equi-join.
    """
    base = tokens.select("item_key", F.array_sort(F.array_distinct("toks")).alias("toks"))
    shrunk = base.select("item_key", "toks", F.array("toks").alias("forms"))
    for _ in range(tol):
        drop = F.flatten(
            F.transform("forms", lambda s: F.transform(s, lambda x: F.array_except(s, F.array(x))))
        )
        shrunk = shrunk.withColumn("forms", F.array_distinct(F.concat("forms", drop)))
    sub = shrunk.select(F.col("item_key").alias("larger"), F.explode("forms").alias("toks"))
    pairs = base.where(F.size("toks") > 0).select(F.col("item_key").alias("smaller"), "toks").join(sub, "toks")
    return pairs.where("smaller <> larger").select("smaller", "larger")


def subsuming(tokens: DataFrame, top: Sequence[str]) -> DataFrame:
    """General and specific variants of a bounded list of top items.

    Containment is counted from shared tokens: a set lies in another exactly when
    the number of shared tokens is its own size.
    """
    base = tokens.select("item_key", F.array_distinct("toks").alias("toks")).where(F.size("toks") > 0)
    long = base.select("item_key", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    tops = long.where(F.col("item_key").isin(list(top))).select(
        F.col("item_key").alias("top_item"), F.col("n").alias("n_top"), "tok"
    )
    shared = (
        long.join(F.broadcast(tops), "tok")  # bounded: len(top) short token sets
        .where("item_key <> top_item")
        .groupBy("top_item", "item_key", "n_top", "n")
        .agg(F.count("*").alias("shared"))
    )
    direction = F.when(F.col("shared") == F.col("n_top"), "specific").when(F.col("shared") == F.col("n"), "general")
    return shared.select("top_item", "item_key", direction.alias("direction")).where("direction IS NOT NULL")


def tag_families(tags: DataFrame, top: Sequence[str]) -> DataFrame:
    """Items that share a tag with a top item: ``top_item, tag, item_key``."""
    mine = tags.where(F.col("item_key").isin(list(top))).select(F.col("item_key").alias("top_item"), "tag")
    return tags.join(F.broadcast(mine), "tag").select("top_item", "tag", "item_key")


# ---- lookup and reports ------------------------------------------------------------------


def load_rule(rules: DataFrame, key: str | int) -> DataFrame:
    """One rule by its key, or by 0-based position; fails when there is none."""
    if isinstance(key, int):
        order = Window.orderBy("rule_key")
        index = rules.select("rule_key").distinct().withColumn("_i", F.row_number().over(order) - 1)
        found = rules.join(index.where(F.col("_i") == key).drop("_i"), "rule_key", "left_semi")
    else:
        found = rules.where(F.col("rule_key") == key)
    if found.isEmpty():
        raise KeyError(f"no rule {key!r}")
    return found


def rule_text(rules: DataFrame) -> DataFrame:
    """``(a & b) | (c)`` per rule."""
    clause = rules.groupBy("rule_id", "clause_id").agg(
        F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_set("item_key")), " & "), F.lit(")")).alias("t")
    )
    return clause.groupBy("rule_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clause_id", "t"))), lambda s: s["t"]), " | ").alias("rule"),
        F.count("*").alias("n_clauses"),
    )


def pattern_truth(elements: DataFrame, patterns: DataFrame) -> DataFrame:
    """Elements inside an occurrence of any pattern: ``(container_id, element_id)``.

    ``patterns(words array<string>)`` are token sequences, ``elements(container_id, element_id, tok)`` tokens at consecutive places.
    The token of a pattern that is rarest in the elements tells where it can begin; the other tokens are then looked up at their places.
    """
    listed = cut_lineage(patterns.select("words").where(F.size("words") > 0).distinct().withColumn("pid", F.monotonically_increasing_id()))
    parts = listed.select("pid", F.size("words").alias("len"), F.posexplode("words").alias("j", "tok"))
    counts = elements.groupBy("tok").agg(F.count("*").alias("c"))
    rarest = F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "j", "tok")).alias("x")
    anchors = parts.join(counts, "tok", "left").groupBy("pid", "len").agg(rarest).where("x.c > 0").select("pid", "len", "x.j", "x.tok")
    starts = elements.join(anchors, "tok").select("container_id", (F.col("element_id") - F.col("j")).alias("start"), "pid", "len")
    long = starts.where("len > 1").join(parts.drop("len"), "pid").withColumn("element_id", F.col("start") + F.col("j"))
    whole = (
        long.join(elements, ["container_id", "element_id", "tok"])
        .groupBy("container_id", "start", "pid", "len")
        .agg(F.count("*").alias("got"))
        .where("got = len")
    )
    found = whole.select("container_id", "start", "len").unionByName(starts.where("len = 1").select("container_id", "start", "len"))
    return found.distinct().select("container_id", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("element_id")).distinct()


def example_container(inc: DataFrame, rule_items: DataFrame, lo: int = 3, hi: int = 6) -> DataFrame:
    """First container with lo..hi items that holds a rule item, and the rule items it holds."""
    flag = rule_items.select("item_key", F.lit(1).alias("_r")).distinct()
    per = (
        inc.join(flag, "item_key", "left")
        .groupBy("container_id")
        .agg(
            F.count("*").alias("n_items"),
            F.array_sort(F.collect_set(F.when(F.col("_r") == 1, F.col("item_key")))).alias("rule_items"),
        )
    )
    return per.where(F.col("n_items").between(lo, hi) & (F.size("rule_items") > 0)).orderBy("container_id").limit(1)


def composition(elements: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Element-type histogram of each container, one column per type."""
    wide = elements.groupBy("container_id").pivot("kind", list(kinds)).agg(F.count(F.lit(1)))
    return wide.select("container_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])
