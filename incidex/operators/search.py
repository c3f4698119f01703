"""Rule search: best rule, greedy extension, sampled rules, shortcut grading.

The driver holds only bounded lists (items, clauses, combinations); every count
comes from a Spark pass over merged baskets.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidex import skew
from incidex.operators import graph, itemcounts as ic, logit, rules as rl, unions
from incidex.session import cut_lineage

TARGET, TOLERANCE, RELATED_J = 50.0, 10.0, 0.10


def _coverage(baskets: DataFrame, width: int, combos: Sequence[tuple[int, ...]]) -> list[int]:
    rows = ic.combination_counts(baskets, width, combos, "any").collect()  # one number per combination
    out = [0] * len(combos)
    for r in rows:
        out[r["combo"]] = r["n"]
    return out


def _pair_jaccard(profile: DataFrame) -> dict[tuple[str, str], float]:
    return {(r["a"], r["b"]): r["jaccard"] for r in profile.select("a", "b", "jaccard").collect()}


def _redundancy(items: Sequence[str], pair_j: dict, general: set[tuple[str, str]]) -> float:
    pairs = list(combinations(sorted(items), 2))
    if not pairs:
        return 0.0
    mean_j = sum(pair_j.get(p, 0.0) for p in pairs) / len(pairs)
    n_general = sum((a, b) in general for a in items for b in items if a != b)
    return 0.6 * mean_j + 0.4 * min(1.0, 0.2 * n_general)


def _as_rules(spark, rows: Sequence[tuple[int, Sequence[Sequence[str]]]]) -> DataFrame:
    flat = [(rid, c, item) for rid, cl in rows for c, clause in enumerate(cl) for item in clause]
    return spark.createDataFrame(flat, "rule_id int, clause_id int, item_key string")


def _separations(containers, inc, rules, n, seed) -> dict[int, float]:
    return {r["rule_id"]: r["separation"] for r in rl.separation(containers, inc, inc, rules, n, seed).collect()}


def extend(
    baskets: DataFrame,
    clause_list: Sequence[Sequence[str]],
    start: Sequence[int],
    n_containers: int,
    pair_j: dict[tuple[str, str], float],
    general: set[tuple[str, str]] = frozenset(),
    max_extra: int = 8,
) -> list[int]:
    """Add single-item clauses toward half coverage, related items first, largest gain first.

    Returns the clause indexes chosen; one Spark count per step and pass.
    """
    chosen = list(start)
    width = len(clause_list)

    def related(item: str, used: set[str]) -> bool:
        return any(
            pair_j.get((u, item), 0) >= RELATED_J
            or pair_j.get((item, u), 0) >= RELATED_J
            or (u, item) in general
            or (item, u) in general
            for u in used
        )

    for _ in range(max_extra):
        used = {i for c in chosen for i in clause_list[c]}
        free = [c for c in range(width) if len(clause_list[c]) == 1 and clause_list[c][0] not in used]
        combos = [tuple(chosen)] + [tuple(chosen) + (c,) for c in free]
        counts = _coverage(baskets, width, combos)
        now = counts[0]
        if abs(now / n_containers * 100 - TARGET) <= TOLERANCE:
            break
        gains = [(n - now, -c) for n, c in zip(counts[1:], free) if n > now]
        near = [g for g in gains if related(clause_list[-g[1]][0], used)]
        best = max(near or gains, default=None)
        if best is None:
            break
        chosen.append(-best[1])
    return chosen


def best_rule(
    containers: DataFrame,
    inc: DataFrame,
    names: Sequence[str],
    n_containers: int,
    general: set[tuple[str, str]] = frozenset(),
    top_k: int = 15,
    max_clauses: int = 4,
    snr_top_k: int = 200,
    sample: int = 60,
    seed: str = "42",
) -> DataFrame:
    """All scored rules (best 25 and the winner); score = balance x separation x (1 - redundancy).

    Combinations are scored as rows; the driver sees the ``top_k`` clauses and the rules that are listed.
    """
    spark = inc.sparkSession
    profile = cut_lineage(rl.cooccurrence(inc, list(names)))
    weight = F.col("n_match") * F.when(F.col("and_valid"), 1.2).otherwise(1.0)
    found = rl.structural_clauses(inc, names, F.lit(n_containers), profile=profile).orderBy(-weight, "items").limit(top_k).collect()
    clause_list, valid = [list(r["items"]) for r in found], [r["and_valid"] for r in found]
    if not clause_list:
        return spark.createDataFrame([], _BEST)
    broader = spark.createDataFrame(sorted(general), "item_key string, variant string")

    inter = cut_lineage(unions.intersections(rl.clause_baskets(inc, clause_list), max_clauses))
    sets = unions.combinations(spark, len(clause_list), max_clauses)
    sized = sets.withColumn("key", unions.key_of(F.col("ids"))).join(unions.union_sizes(sets, inter), "key")
    sized = sized.withColumn("pct", F.col("n") / n_containers * 100).where("pct >= 5 AND pct <= 95")
    members = F.array(*[F.array(*map(F.lit, c)) for c in clause_list])
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("ids", lambda i: F.get(members, i)))))
    first = sized.groupBy(items.alias("items")).agg(F.min(F.struct("size", "key", "ids", "n", "pct")).alias("s"))
    cands = cut_lineage(first.select("items", "s.key", "s.ids", "s.n", "s.pct"))
    spurious = rl.redundancy(cands.select(F.col("key").alias("rule_id"), F.explode("items").alias("item_key")), profile, broader)
    balance = 1 - F.abs(F.col("pct") - 50) / 50
    cands = cands.join(spurious.withColumnRenamed("rule_id", "key"), "key").withColumn("balance", balance)
    cands = cut_lineage(cands.withColumn("first_score", F.col("balance") * (1 - F.col("spurious"))))

    head = cut_lineage(cands.orderBy(F.desc("first_score"), "ids").limit(snr_top_k).select(F.col("key").alias("rule_id"), "ids"))
    clause_items = spark.createDataFrame([(c, k) for c, clause in enumerate(clause_list) for k in clause], "clause_id int, item_key string")
    rules = head.select("rule_id", F.explode("ids").alias("clause_id")).join(clause_items, "clause_id")
    seps = rl.separation(containers, inc, inc, rules, sample, seed)
    score = F.coalesce(F.col("balance") * F.col("separation") * (1 - F.col("spurious")), F.lit(0.0)).alias("score")
    scored = cands.join(seps.withColumnRenamed("rule_id", "key"), "key", "left").select("ids", "n", "pct", "balance", "spurious", "separation", score)
    listed = [tuple(r) for r in scored.orderBy(F.desc("score"), "ids").limit(25).collect()]
    if listed and listed[0][3] < 0.8:
        pair_j = _pair_jaccard(profile)
        baskets = cut_lineage(rl.clause_baskets(inc, clause_list))
        grown = extend(baskets, clause_list, listed[0][0], n_containers, pair_j, general)
        n = _coverage(baskets, len(clause_list), [tuple(grown)])[0]
        pct = n / n_containers * 100
        of_all = tuple(sorted({i for c in grown for i in clause_list[c]}))
        sep = _separations(containers, inc, _as_rules(spark, [(0, [clause_list[c] for c in grown])]), sample, seed).get(0, 0.0)
        bal, red = 1 - abs(pct - 50) / 50, _redundancy(of_all, pair_j, general)
        if bal * sep * (1 - red) > listed[0][-1]:
            listed.insert(0, (grown, n, pct, bal, red, sep, bal * sep * (1 - red)))
    rows = [
        (r + 1, " | ".join("(" + " & ".join(clause_list[c]) + ")" for c in ids), len(ids), n, *rest, all(valid[c] for c in ids))
        for r, (ids, n, *rest) in enumerate(listed[:25])
    ]
    return spark.createDataFrame(rows, _BEST)


_BEST = (
    "rank int, rule string, n_clauses int, n_match long, pct_match double, balance double, "
    "spurious double, separation double, score double, and_valid boolean"
)


def draws(spark: SparkSession, n_tries: int, width: int, k_max: int, seed: str) -> DataFrame:
    """``(t, ids)``: try t takes 1 to ``k_max`` of ``width`` numbers, without repetition, by md5(seed|t|...).

    The j-th number counts places that are still free.
    """
    number = lambda j: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "t", j)), 1, 8), 16, 10).cast("long")
    k = (1 + number(F.lit("k")) % k_max).cast("int")

    def take(taken: Column, j: Column) -> Column:
        place = (number(j.cast("string")) % (width - j + 1)).cast("int")
        place = F.aggregate(taken, place, lambda at, other: at + F.when(at >= other, 1).otherwise(0))
        return F.array_sort(F.concat(taken, F.array(place)))

    tries = spark.range(n_tries).withColumnRenamed("id", "t").withColumn("k", k).where(F.col("k") <= width)
    return tries.select("t", F.aggregate(F.sequence(F.lit(1), F.col("k")), F.array().cast("array<int>"), take).alias("ids"))


def sample_rules(
    inc: DataFrame,
    pool: DataFrame,
    n_containers: int,
    min_new: int,
    n_rules: int = 50,
    k_max: int = 3,
    cov_lo: float = 0.4,
    cov_hi: float = 0.6,
    max_tries: int = 2000,
    seed: str = "42",
) -> DataFrame:
    """Random disjunctions of frequent itemsets that pass the coverage band and the new-positives gate.

    ``pool(items, n)`` is numbered by falling support.  All tries are drawn and judged as rows; the first
    ``n_rules`` that pass are taken, a set that is drawn again counts once.
    """
    spark = inc.sparkSession
    pool = cut_lineage(skew.number_rows(pool.select("items", "n"), [], [F.desc("n"), F.col("items")], "c", first=0))
    width = pool.count()
    if width > unions.MAX_CLAUSES:
        raise ValueError(f"{width} itemsets have no key")
    clause_items = pool.select(F.col("c").cast("int").alias("c"), F.explode("items").alias("item_key"))
    inter = cut_lineage(unions.intersections(rl.fired_baskets(inc, clause_items), k_max))
    tries = cut_lineage(draws(spark, max_tries, width, k_max, seed).groupBy("ids").agg(F.min("t").alias("t")))
    # the whole, and what is left without each of its clauses
    without = F.explode(F.sequence(F.lit(-1), F.size("ids") - 1)).alias("i")
    parts = tries.select("t", F.size("ids").alias("k"), "ids", without).select(
        "t", "k", "i", F.filter("ids", lambda _, at: at != F.col("i")).alias("ids")
    ).withColumn("key", unions.key_of(F.col("ids")))
    sizes = unions.union_sizes(parts.where(F.size("ids") > 0), inter)
    judged = parts.join(sizes, "key", "left").groupBy("t", "k").agg(
        F.max(F.when(F.col("i") < 0, F.col("n"))).alias("n_pos"),
        F.max(F.when(F.col("i") >= 0, F.coalesce("n", F.lit(0)))).alias("most_rest"),
    )
    judged = judged.withColumn("cov", F.col("n_pos") / n_containers).withColumn("min_new_pos", F.col("n_pos") - F.col("most_rest"))
    good = judged.where((F.col("cov") >= cov_lo) & (F.col("cov") <= cov_hi) & (F.col("min_new_pos") >= min_new))
    taken = cut_lineage(good.orderBy("t").limit(n_rules))
    order = F.row_number().over(Window.partitionBy("k").orderBy("t"))  # of at most n_rules rows
    numbered = taken.withColumn("rule_key", F.concat(F.lit("dnf_k"), "k", F.lit("_r"), order))
    clauses = numbered.select("t").join(tries, "t").select("t", F.posexplode("ids").alias("place", "c")).join(pool, "c")
    text = F.concat(F.lit("("), F.array_join("items", " & "), F.lit(")"))
    rule = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))), lambda s: s["text"]), " | ")
    said = clauses.groupBy("t").agg(rule.alias("rule"), F.min("n").alias("min_clause_support"))
    return numbered.join(said, "t").select("rule_key", "k", "rule", "n_pos", "cov", "min_new_pos", "min_clause_support")


def connectivity(elements: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Share of containers where the elements of a fired clause (2+ items) hang together."""
    sizes = rules.groupBy("rule_id", "clause_id").agg(F.countDistinct("item_key").alias("k")).where("k >= 2")
    multi = rules.join(sizes, ["rule_id", "clause_id"], "left_semi")
    inc = elements.select("container_id", "item_key").distinct()
    fired = rl.fired_clauses(inc, multi)
    tag = ["rule_id", "clause_id"]
    members = fired.join(multi, tag).join(elements, ["container_id", "item_key"]).select(*tag, "container_id", "element_id")
    members = cut_lineage(members.distinct())
    links = graph.induced(edges, members, ["container_id"], tag)
    comp = graph.components(members, links, [*tag, "container_id"])
    low = comp.groupBy(*tag, "container_id").agg((F.min("label") == F.max("label")).cast("double").alias("whole"))
    return low.groupBy(*tag).agg(F.count("*").alias("n_containers"), F.avg("whole").alias("connectivity"))


# ---- shortcut grading with logistic regression -------------------------------------------


def _rule_items(rules: DataFrame) -> dict[int, set[str]]:
    """Items of every rule of a bounded list, by rule id."""
    spec: dict[int, set[str]] = {}
    for r in rules.select("rule_id", "item_key").distinct().orderBy("rule_id").collect():
        spec.setdefault(r["rule_id"], set()).add(r["item_key"])
    return spec


def _targets(spark: SparkSession, keys: Sequence[tuple], names: str) -> DataFrame:
    return spark.createDataFrame([(*k, t) for t, k in enumerate(keys)], f"{names}, target int")


def rule_aucs(inc: DataFrame, containers: DataFrame, rules: DataFrame, names: Sequence[str], folds: int = 3, own_items: bool = True) -> dict[int, float]:
    """Cross-validated AUC of predicting each rule from the items of ``names`` (without its own, if asked), all rules at once."""
    spec = _rule_items(rules)
    hits = rl.fired_containers(inc, rules).join(_targets(inc.sparkSession, [(r,) for r in spec], "rule_id int"), "rule_id")
    return _aucs(inc, containers, hits, spec, names, folds, own_items)


def _aucs(inc: DataFrame, containers: DataFrame, hits: DataFrame, spec: dict[int, set[str]], names: Sequence[str], folds: int, own_items: bool) -> dict[int, float]:
    rows = logit.examples(inc, containers, hits, names, folds, "0")
    allowed = [frozenset(i for i, x in enumerate(names) if own_items or x not in own) for own in spec.values()]
    return dict(zip(spec, logit.cross_validated(rows, allowed, len(names), folds)))


def grade_rules(inc: DataFrame, containers: DataFrame, rules: DataFrame, names: Sequence[str], kinds: DataFrame, kind_names: Sequence[str], folds: int = 3) -> DataFrame:
    """Per rule: AUC from non-rule items (shortcut) and from element types (composition)."""
    spark, spec = inc.sparkSession, _rule_items(rules)
    hits = cut_lineage(rl.fired_containers(inc, rules).join(_targets(spark, [(r,) for r in spec], "rule_id int"), "rule_id"))
    shortcut = _aucs(inc, containers, hits, spec, names, folds, own_items=False)
    composition = _aucs(kinds, containers, hits, spec, kind_names, folds, own_items=True)
    return spark.createDataFrame([(r, shortcut[r], composition[r]) for r in spec], "rule_id int, shortcut_auc double, composition_auc double")


def shortcut_report(inc: DataFrame, containers: DataFrame, rules: DataFrame, names: Sequence[str], n: Column, threshold: float = 0.15) -> DataFrame:
    """Per clause: held-out AUC (70/30) from non-rule items, and the five strongest distractors."""
    spark = inc.sparkSession
    fired = cut_lineage(rl.fired_clauses(inc, rules))
    spec = _rule_items(rules)
    parts = sorted({(r["rule_id"], r["clause_id"]) for r in rules.select("rule_id", "clause_id").distinct().collect()})
    hits = fired.join(_targets(spark, parts, "rule_id int, clause_id int"), ["rule_id", "clause_id"])
    examples = cut_lineage(logit.examples(inc, containers, hits, names, 10, "0"))
    train, test = frozenset(range(7)), frozenset(range(7, 10))
    models = [logit.Model(t, train, test, frozenset(i for i, x in enumerate(names) if x not in spec[rid])) for t, (rid, _) in enumerate(parts)]
    found = logit.held_out_auc(examples, models, logit.fit(examples, models, len(names), len(parts)), len(names))
    rows = [(*part, 0.5 if found.get(t) is None else found[t]) for t, part in enumerate(parts)]
    aucs = spark.createDataFrame(rows, "rule_id int, clause_id int, shortcut_auc double")
    as_rule = rules.select(F.struct("rule_id", "clause_id").alias("rule_id"), "item_key")
    hits = fired.select(F.struct("rule_id", "clause_id").alias("rule_id"), "container_id")
    corr = rl.rule_correlations(inc, hits, as_rule, n).where(F.col("corr") >= threshold)
    flat = corr.select("rule_id.rule_id", "rule_id.clause_id", "item_key", "corr")
    whole = rules.select("rule_id", "item_key").distinct()
    flat = flat.join(whole, ["rule_id", "item_key"], "left_anti")
    top = skew.top_rows(flat, ["rule_id", "clause_id"], [F.desc("corr"), F.col("item_key")], 5)
    named = top.groupBy("rule_id", "clause_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_key"))), lambda s: s["item_key"]), ",").alias("distractors")
    )
    return aucs.join(named, ["rule_id", "clause_id"], "left").withColumn("distractors", F.coalesce("distractors", F.lit("")))
