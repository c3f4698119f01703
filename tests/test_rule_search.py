"""Unions of clauses, rule search and drawn rules against enumeration."""

import hashlib
import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from incidex.operators import rules, search, unions

NAMES = [f"item{i}" for i in range(8)]


@pytest.fixture(scope="module")
def held():
    """container -> items; one basket holds a third of all containers."""
    rng = random.Random(12)
    out = {c: {n for i, n in enumerate(NAMES) if rng.random() < 0.45 - 0.04 * i} for c in range(400)}
    return {c: {"item0", "item3"} if c % 3 == 0 else s for c, s in out.items()}


@pytest.fixture(scope="module")
def inc(spark, held):
    return spark.createDataFrame([(c, i) for c, s in held.items() for i in s], "container_id long, item_key string")


@pytest.fixture(scope="module")
def containers(spark, held):
    return spark.createDataFrame([(c, c % 2) for c in held], "container_id long, label int")


def covered(held, clauses):
    return [c for c, s in held.items() if any(set(x) <= s for x in clauses)]


def test_unions_of_all_combinations(spark, held, inc):
    clauses = [[n] for n in NAMES] + [["item0", "item1"], ["item0", "item3", "item5"], ["item7", "item6"]]
    inter = unions.intersections(rules.clause_baskets(inc, clauses), 4)
    got = {r["key"]: r["n"] for r in inter.collect()}
    assert len(got) == inter.count()
    sets = unions.combinations(spark, len(clauses), 4)
    sized = sets.withColumn("key", unions.key_of(F.col("ids"))).join(unions.union_sizes(sets, inter), "key").collect()
    assert len(sized) == sum(math.comb(len(clauses), k) for k in range(1, 5))
    for r in sized:
        assert r["n"] == len(covered(held, [clauses[i] for i in r["ids"]])), r
    with pytest.raises(ValueError, match="at most 4"):
        unions.intersections(rules.clause_baskets(inc, clauses), 5)


def test_dnf_rules(held, inc):
    clauses = [[n] for n in NAMES] + [["item0", "item1"]]
    got = rules.dnf_rules(inc, clauses, len(held), min_cov=20.0, max_clauses=3, per_size=10).collect()
    want = []
    for k in (1, 2, 3):
        sized = [(-len(covered(held, [clauses[i] for i in c])), c) for c in combinations(range(len(clauses)), k)]
        want += [(c, -n) for n, c in sorted(sized) if round(-n / len(held) * 100, 1) >= 20.0][:10]
    assert sorted((tuple(r["clause_ids"]), r["n1"]) for r in got) == sorted(want)


def test_best_rule_like_enumeration(spark, held, inc, containers):
    n = len(held)
    general = {("item2", "item3"), ("item5", "item4")}
    support = {x: sum(x in s for s in held.values()) for x in NAMES}
    both = {(a, b): sum(a in s and b in s for s in held.values()) for a, b in combinations(NAMES, 2)}
    jac = {p: c / (support[p[0]] + support[p[1]] - c) for p, c in both.items()}
    found = [([x], support[x], True) for x in NAMES]
    for (a, b), c in both.items():
        if 0 < c < min(support[a], support[b]) and jac[a, b] < 0.7:
            found.append(([a, b], c, support[a] - c >= 0.05 * n and support[b] - c >= 0.05 * n))
    found.sort(key=lambda f: (-f[1] * (1.2 if f[2] else 1.0), f[0]))
    found = found[:9]
    order = sorted(held, key=lambda c: (hashlib.md5(f"42|{c}".encode()).hexdigest(), c))
    cands, seen = [], set()
    for k in (1, 2, 3):
        for combo in combinations(range(len(found)), k):
            hit = set(covered(held, [found[i][0] for i in combo]))
            pct, items = len(hit) / n * 100, tuple(sorted({x for i in combo for x in found[i][0]}))
            if not 5 <= pct <= 95 or items in seen:
                continue
            seen.add(items)
            pairs = list(combinations(items, 2))
            mean_j = sum(jac[p] for p in pairs) / len(pairs) if pairs else 0.0
            red = 0.6 * mean_j + 0.4 * min(1.0, 0.2 * sum(a in items and b in items for a, b in general))
            cands.append(((1 - abs(pct - 50) / 50) * (1 - red), combo, hit, pct, red))
    cands.sort(key=lambda x: (-x[0], x[1]))
    scored = []
    for i, (_, combo, hit, pct, red) in enumerate(cands):
        sep = None
        if i < 12:
            yes, no = ([held[c] for c in order if (c in hit) == side][:20] for side in (True, False))
            yes, no = [x for x in yes if x], [x for x in no if x]
            sep = 1 - sum(len(a & b) / len(a | b) for a in yes for b in no) / (len(yes) * len(no))
        bal = 1 - abs(pct - 50) / 50
        scored.append((bal * sep * (1 - red) if sep is not None else 0.0, combo, len(hit)))
    scored.sort(key=lambda x: (-x[0], x[1]))
    got = search.best_rule(containers, inc, NAMES, n, general, top_k=9, max_clauses=3, snr_top_k=12, sample=20).orderBy("rank").collect()
    text = lambda combo: " | ".join("(" + " & ".join(found[c][0]) + ")" for c in combo)
    assert [(r["rule"], r["n_match"]) for r in got if r["score"] > 0] == [(text(c), m) for s, c, m in scored[:25] if s > 0]
    assert all(math.isclose(r["score"], s[0], abs_tol=1e-9) for r, s in zip(got, scored))


def test_drawn_rules_like_one_at_a_time(spark, held, inc):
    n, pool = len(held), [([x], sum(x in s for s in held.values())) for x in NAMES] + [(["item0", "item1"], sum({"item0", "item1"} <= s for s in held.values()))]
    pool.sort(key=lambda p: (-p[1], p[0]))
    number = lambda t, j: int(hashlib.md5(f"7|{t}|{j}".encode()).hexdigest()[:8], 16)
    want, seen, per = [], set(), {}
    for t in range(900):
        ids = []
        for j in range(1, 2 + number(t, "k") % 3):
            at = number(t, j) % (len(pool) - j + 1)
            for other in ids:
                at += at >= other
            ids = sorted([*ids, at])
        if tuple(ids) in seen:
            continue
        seen.add(tuple(ids))
        size = lambda some: len(covered(held, [pool[i][0] for i in some]))
        total, fewest = size(ids), min(size(ids) - size([i for i in ids if i != x]) for x in ids)
        if 0.3 <= total / n <= 0.7 and fewest >= 12 and len(want) < 15:
            per[len(ids)] = per.get(len(ids), 0) + 1
            rule = " | ".join("(" + " & ".join(pool[i][0]) + ")" for i in ids)
            want.append((f"dnf_k{len(ids)}_r{per[len(ids)]}", rule, total, fewest, min(pool[i][1] for i in ids)))
    df = spark.createDataFrame(pool, "items array<string>, n long")
    got = search.sample_rules(inc, df, n, 12, n_rules=15, cov_lo=0.3, cov_hi=0.7, max_tries=900, seed="7").collect()
    assert len(want) == 15 and {len(x) for x in seen} == {1, 2, 3}
    assert sorted((r["rule_key"], r["rule"], r["n_pos"], r["min_new_pos"], r["min_clause_support"]) for r in got) == sorted(want)


def test_patterns_of_several_tokens(spark):
    """Overlapping, repeated and partly present phrases; containers without any stay out."""
    texts = {1: "a b a b a c", 2: "b b b b", 3: "x y z", 4: "c a b", 5: "the a", 6: "d"}
    phrases = [["a", "b"], ["b", "b", "b"], ["a", "b", "a"], ["y", "q"], ["z"], ["c", "a", "b", "d"], ["never"], [], ["z"]]
    el = spark.createDataFrame([(c, i, w) for c, t in texts.items() for i, w in enumerate(t.split())], "container_id long, element_id int, tok string")
    got = {(r["container_id"], r["element_id"]) for r in rules.pattern_truth(el, spark.createDataFrame([(p,) for p in phrases], "words array<string>")).collect()}
    want = set()
    for c, t in texts.items():
        w = t.split()
        for p in phrases:
            want |= {(c, i + j) for i in range(len(w)) for j in range(len(p)) if p and w[i : i + len(p)] == p}
    assert got == want


def test_rules_meet_drawn_containers_only(spark, monkeypatch):
    n, seed, met = 5, "7", []
    every = spark.range(4000).select(F.col("id").alias("container_id"))
    many = every.select("container_id", F.explode(F.array(F.lit("all"), F.concat(F.lit("m"), F.col("container_id") % 2))).alias("item_key"))
    spec = spark.createDataFrame([(1, 0, "m0"), (2, 0, "m1")], "rule_id int, clause_id int, item_key string")
    whole = rules.fired_containers
    monkeypatch.setattr(rules, "fired_containers", lambda i, r: met.append(i.count()) or whole(i, r))
    got = {r["rule_id"]: r["separation"] for r in rules.separation(every, many, many, spec, n, seed).collect()}
    assert got == pytest.approx({1: 2 / 3, 2: 2 / 3})
    assert met and max(met) <= 2 * 16 * n


def test_clauses_meet_distinct_baskets(inc):
    plan = rules.clause_baskets(inc, [["item0"], ["item0", "item3"]])._jdf.queryExecution().optimizedPlan().toString()
    assert "container_id" not in plan[: plan.index("Join Inner, (item_key")]
