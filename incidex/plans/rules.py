"""Rule queries (RUL) with their SQL checks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from incidex.operators import phrases as ph
from incidex.operators import rules as rl
from incidex.operators import search
from incidex.plans.registry import query
from incidex.session import cut_lineage

SAMPLE = 60
PROXY = 0.15  # items are drawn evenly here, so the usual 0.70 would select nothing
CORR = 0.01


@query("rul1_cooccurrence", "a:s b:s inter:l n_a:l n_b:l jaccard:d p_b_given_a:d p_a_given_b:d", "SELECT * FROM cooc")
def _(t):
    return rl.cooccurrence(t.brand_incidence, t.brand_names)


@query("rul2_pairwise", "a:s b:s jaccard:d",
       "SELECT a, b, jaccard FROM cooc")
def _(t):
    return rl.cooccurrence(t.brand_incidence, t.brand_names)


@query("rul3_proxies", "item_key:s proxy:s jaccard:d p:d",
       f"SELECT a AS item_key, b AS proxy, jaccard, p_b_given_a AS p FROM cooc WHERE p_b_given_a >= {PROXY}")
def _(t):
    return rl.proxies(rl.cooccurrence(t.brand_incidence, t.brand_names), PROXY)


@query("rul4_ambiguity", "rule_id:l item_key:s proxy:s jaccard:d p:d",
       f"""SELECT r.rule_id, r.item_key, b AS proxy, jaccard, p_b_given_a AS p
           FROM (SELECT DISTINCT rule_id, item_key FROM rules) r JOIN cooc ON a = r.item_key
           WHERE p_b_given_a >= {PROXY} AND NOT EXISTS
             (SELECT 1 FROM rules q WHERE q.rule_id = r.rule_id AND q.item_key = b)""")
def _(t):
    return rl.ambiguity(t.rules, rl.proxies(rl.cooccurrence(t.brand_incidence, t.brand_names), PROXY))


def _min_count(n: int) -> int:
    return max(20, round(0.015 * n))


MIN_COUNT_SQL = "(SELECT greatest(20, CAST(round_even(0.015 * count(*), 0) AS BIGINT)) FROM containers)"
FREQ = f"""SELECT item_key AS items, 1 AS size, count(*) AS n FROM brand_incidence GROUP BY 1 HAVING count(*) >= {MIN_COUNT_SQL}
   UNION ALL SELECT a.item_key || ',' || b.item_key, 2, count(*) FROM brand_incidence a JOIN brand_incidence b
     ON a.container_id = b.container_id AND a.item_key < b.item_key GROUP BY 1 HAVING count(*) >= {MIN_COUNT_SQL}
   UNION ALL SELECT a.item_key || ',' || b.item_key || ',' || c.item_key, 3, count(*) FROM brand_incidence a
     JOIN brand_incidence b ON a.container_id = b.container_id AND a.item_key < b.item_key
     JOIN brand_incidence c ON a.container_id = c.container_id AND b.item_key < c.item_key
     GROUP BY 1 HAVING count(*) >= {MIN_COUNT_SQL}"""


def _itemsets(t):
    n = t.containers.count()
    return rl.itemsets(t.brand_incidence, _min_count(n)), n


@query("rul5_itemsets", "items:s size:l n:l", FREQ)
def _(t):
    f, _ = _itemsets(t)
    return f.select(F.array_join("items", ",").alias("items"), F.size("items").alias("size"), "n")


@query("rul6_maximal", "items:s n:l",
       f"""WITH f AS ({FREQ}) SELECT items, n FROM f WHERE NOT EXISTS
           (SELECT 1 FROM f g WHERE g.size > f.size AND list_has_all(string_split(g.items, ','), string_split(f.items, ',')))""")
def _(t):
    f, _ = _itemsets(t)
    return rl.maximal(f).withColumn("items", F.array_join("items", ","))


@query("rul7_clauses", "items:s size:l n1:l",
       """WITH i AS (SELECT container_id, item_key, rank FROM brand_incidence JOIN brand_vocab USING (item_key)),
          s AS (SELECT item_key, count(*) AS n FROM i GROUP BY 1)
          SELECT item_key AS items, 1 AS size, n AS n1 FROM s
          UNION ALL SELECT a.item_key || ',' || b.item_key, 2, count(*) FROM i a JOIN i b
            ON a.container_id = b.container_id AND a.rank < b.rank JOIN s x ON x.item_key = a.item_key JOIN s y ON y.item_key = b.item_key
            GROUP BY 1 HAVING count(*) < min(least(x.n, y.n))
          UNION ALL SELECT a.item_key || ',' || b.item_key || ',' || c.item_key, 3, count(*) FROM i a JOIN i b
            ON a.container_id = b.container_id AND a.rank < b.rank JOIN i c ON a.container_id = c.container_id AND b.rank < c.rank
            GROUP BY 1""")
def _(t):
    return rl.clauses(t.brand_incidence, t.brand_names).withColumn("items", F.array_join("items", ","))


@query("rul8_structural_clauses", "items:s n_match:l and_valid:b",
       """SELECT item_key AS items, n_containers AS n_match, true AS and_valid FROM brand_vocab
          UNION ALL SELECT a || ',' || b, inter, n_a - inter >= 0.1 * n AND n_b - inter >= 0.1 * n
          FROM cooc, (SELECT count(*) AS n FROM containers) WHERE a < b AND jaccard < 0.7 AND inter < least(n_a, n_b)""")
def _(t):
    c = rl.structural_clauses(t.brand_incidence, t.brand_names, t.n_containers, min_only=0.1)
    return c.withColumn("items", F.array_join("items", ","))


def _clause_list(t):
    """All single brands and the six pairs of the best four."""
    top = t.brand_names
    return [[x] for x in top] + [[a, b] for a, b in combinations(top[:4], 2)]


def _clause_values() -> str:
    singles = [f"SELECT {i} AS c, rank FROM brand_vocab WHERE rank = {i + 1}" for i in range(25)]
    pairs = [f"SELECT {25 + k}, rank FROM brand_vocab WHERE rank IN ({a}, {b})" for k, (a, b) in enumerate(combinations(range(1, 5), 2))]
    return " UNION ALL ".join(singles + pairs)


DNF_RULES = f"""WITH cl AS ({_clause_values()}), need AS (SELECT c, count(*) AS need FROM cl GROUP BY 1),
   hit AS (SELECT container_id, c FROM brand_incidence JOIN brand_vocab USING (item_key) JOIN cl USING (rank) JOIN need USING (c)
     GROUP BY ALL HAVING count(*) = max(need)),
   sig AS (SELECT s, count(*) AS n FROM (SELECT container_id, bit_or(1::BIGINT << c) AS s FROM hit GROUP BY 1) GROUP BY 1),
   c1 AS (SELECT unnest(range(31)) AS a),
   combos AS (SELECT 1 AS k, a, -1 AS b, -1 AS c, -1 AS d, 1::BIGINT << a AS m FROM c1
     UNION ALL SELECT 2, x.a, y.a, -1, -1, (1::BIGINT << x.a) | (1::BIGINT << y.a) FROM c1 x JOIN c1 y ON x.a < y.a
     UNION ALL SELECT 3, x.a, y.a, z.a, -1, (1::BIGINT << x.a) | (1::BIGINT << y.a) | (1::BIGINT << z.a) FROM c1 x JOIN c1 y ON x.a < y.a JOIN c1 z ON y.a < z.a
     UNION ALL SELECT 4, x.a, y.a, z.a, w.a, (1::BIGINT << x.a) | (1::BIGINT << y.a) | (1::BIGINT << z.a) | (1::BIGINT << w.a)
       FROM c1 x JOIN c1 y ON x.a < y.a JOIN c1 z ON y.a < z.a JOIN c1 w ON z.a < w.a),
   cov AS (SELECT k, a, b, c, d, sum(CASE WHEN s & m <> 0 THEN n ELSE 0 END) AS n1 FROM combos, sig GROUP BY ALL)
   SELECT k AS n_clauses, concat_ws(',', a, nullif(b, -1), nullif(c, -1), nullif(d, -1)) AS clause_ids, n1,
     n1 / (SELECT count(*) FROM containers) * 100 AS pct1 FROM cov
   WHERE n1 > 0 AND round(n1 / (SELECT count(*) FROM containers) * 100, 1) >= 5
   QUALIFY row_number() OVER (PARTITION BY k ORDER BY n1 DESC, a, b, c, d) <= 50"""


@query("rul9_dnf_rules", "n_clauses:l clause_ids:s n1:l pct1:d", DNF_RULES)
def _(t):
    r = rl.dnf_rules(t.brand_incidence, _clause_list(t), t.containers.count())
    return r.withColumn("clause_ids", F.array_join(F.col("clause_ids").cast("array<string>"), ","))


@query("rul10_best_rule", "rank:l rule:s n_clauses:l n_match:l pct_match:d balance:d spurious:d separation:d score:d and_valid:b")
def _(t):
    return search.best_rule(t.containers, t.brand_incidence, t.brand_names, t.containers.count(), top_k=30, max_clauses=4)


@query("rul11_apply_rules", "rule_id:l container_id:l label:l synth:l", "SELECT * FROM labelled")
def _(t):
    return rl.apply_rules(t.containers, t.brand_incidence, t.rules)


@query("rul12_annotate", "rule_id:l container_id:l element_id:l kind:s ordinal:l item_key:s", "SELECT * FROM truth")
def _(t):
    return t.truth


@query("rul12_annotate_edges", "rule_id:l container_id:l src:l dst:l",
       """SELECT a.rule_id, e.container_id, src, dst FROM edges e
          JOIN truth a ON a.container_id = e.container_id AND a.element_id = src AND a.kind = 'node'
          JOIN truth b ON b.container_id = e.container_id AND b.element_id = dst AND b.kind = 'node' AND b.rule_id = a.rule_id""")
def _(t):
    return rl.annotate_edges(t.edges, t.truth)


@query("rul12_annotate_counts", "rule_id:l kind:s ordinal:l n_elements:l n_containers:l",
       """SELECT rule_id, kind, ordinal, count(*) AS n_elements, count(DISTINCT container_id) AS n_containers
          FROM truth GROUP BY ALL""")
def _(t):
    per = t.truth.groupBy("rule_id", "kind", "ordinal", "container_id").agg(F.count("*").alias("n"))
    return per.groupBy("rule_id", "kind", "ordinal").agg(F.sum("n").alias("n_elements"), F.count("*").alias("n_containers"))


SEPARATION = f"""SELECT rule_id, 1 - avg(j) AS separation FROM (
   SELECT m.rule_id, len(list_intersect(m.items, q.items)) / len(list_distinct(list_concat(m.items, q.items))) AS j
   FROM d m JOIN d q ON m.rule_id = q.rule_id AND m.synth = 1 AND q.synth = 0) GROUP BY 1"""
DRAWN = f"""WITH s AS (SELECT container_id, list(item_key) AS items FROM incidence GROUP BY 1),
   d AS (SELECT * FROM (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY rule_id, synth
     ORDER BY md5('42|' || container_id), container_id) <= {SAMPLE}) JOIN s USING (container_id))"""


def _separation(t, rules):
    return rl.separation(t.containers, t.incidence, t.brand_incidence, rules, SAMPLE, "42")


COVER = "(SELECT rule_id, avg(synth) * 100 AS pct1 FROM labelled GROUP BY 1)"
REDUNDANCY = """SELECT r.rule_id, 0.6 * avg(jaccard) + 0.4 * least(1, 0.2 * (SELECT count(*) FROM rules g JOIN rules h
     ON g.rule_id = h.rule_id AND starts_with(g.item_key, h.item_key) AND g.item_key <> h.item_key WHERE g.rule_id = r.rule_id)) AS spurious
   FROM rules r JOIN rules q ON r.rule_id = q.rule_id AND r.item_key < q.item_key
   JOIN cooc ON a = r.item_key AND b = q.item_key GROUP BY r.rule_id"""


def _general(t):
    """A brand name that starts with another brand's name counts as its narrower form."""
    names = t.brand_names
    pairs = [(a, b) for a in names for b in names if a != b and a.startswith(b)]
    return t.spark.createDataFrame(pairs, "item_key string, variant string")


@query("rul13_score_rules", "rule_id:l pct1:d balance:d spurious:d separation:d score:d",
       f"""{DRAWN} SELECT *, balance * separation * (1 - spurious) AS score FROM
           (SELECT rule_id, pct1, 1 - abs(pct1 - 50) / 50 AS balance FROM {COVER})
           JOIN ({REDUNDANCY}) USING (rule_id) JOIN ({SEPARATION}) USING (rule_id)""")
def _(t):
    cover = rl.apply_rules(t.containers, t.brand_incidence, t.rules).groupBy("rule_id").agg(
        (F.avg(F.col("synth").cast("double")) * 100).alias("pct1")
    )
    red = rl.redundancy(t.rules, rl.cooccurrence(t.brand_incidence, t.brand_names), _general(t))
    return rl.score_rules(cover, red, _separation(t, t.rules))


@query("rul14_separation", "rule_id:l separation:d", f"{DRAWN} {SEPARATION}")
def _(t):
    return _separation(t, t.rules)


@query("rul15_redundancy", "rule_id:l spurious:d", REDUNDANCY)
def _(t):
    return rl.redundancy(t.rules, rl.cooccurrence(t.brand_incidence, t.brand_names), _general(t))


def _extend_sql() -> str:
    """Greedy additions as a chain of CTEs: every step adds the brand with most new containers."""
    steps = ["""s0 AS (SELECT DISTINCT container_id FROM brand_incidence JOIN brand_vocab USING (item_key) WHERE rank = 1),
       u0 AS (SELECT item_key FROM brand_vocab WHERE rank = 1)"""]
    for k in range(1, 9):
        p = k - 1
        steps.append(f"""w{k} AS (SELECT item_key, count(*) AS gain, {k} AS step FROM brand_incidence JOIN brand_vocab USING (item_key)
            WHERE item_key NOT IN (SELECT item_key FROM u{p}) AND container_id NOT IN (SELECT container_id FROM s{p})
              AND (SELECT abs((SELECT count(*) FROM s{p}) / count(*) * 100 - 50) FROM containers) > 10
            GROUP BY item_key, rank ORDER BY gain DESC, rank LIMIT 1),
            u{k} AS (SELECT * FROM u{p} UNION ALL SELECT item_key FROM w{k}),
            s{k} AS (SELECT * FROM s{p} UNION SELECT container_id FROM brand_incidence WHERE item_key IN (SELECT item_key FROM w{k}))""")
    body = " UNION ALL ".join(f"SELECT {k} AS step, item_key, (SELECT count(*) FROM s{k}) AS n_covered FROM w{k}" for k in range(1, 9))
    return f"WITH {', '.join(steps)} {body}"


@query("rul16_extend", "step:l item_key:s n_covered:l", _extend_sql())
def _(t):
    from incidex.session import cut_lineage

    names = t.brand_names
    clause_list = [[x] for x in names]
    baskets = cut_lineage(rl.clause_baskets(t.brand_incidence, clause_list))
    chosen = search.extend(baskets, clause_list, [0], t.containers.count(), {})
    prefixes = [tuple(chosen[: k + 1]) for k in range(1, len(chosen))]
    counts = search._coverage(baskets, len(names), prefixes) if prefixes else []
    rows = [(k + 1, names[p[-1]], n) for k, (p, n) in enumerate(zip(prefixes, counts))]
    return t.spark.createDataFrame(rows, "step int, item_key string, n_covered long")


@query("rul17_label_snr",
       "rule_id:l s1_o1:l s1_o0:l s0_o1:l s0_o0:l precision:d snr:d consistency:d",
       """SELECT *, s1_o1 / nullif(s1_o1 + s1_o0, 0) AS precision,
            least(s1_o1 / (s1_o1 + s1_o0) / greatest(1 - s1_o1 / (s1_o1 + s1_o0), 1e-6), 1e6) AS snr,
            (s1_o1 + s0_o0) / (s1_o1 + s1_o0 + s0_o1 + s0_o0) AS consistency FROM
          (SELECT rule_id, count(*) FILTER (synth = 1 AND label = 1) AS s1_o1, count(*) FILTER (synth = 1 AND label = 0) AS s1_o0,
             count(*) FILTER (synth = 0 AND label = 1) AS s0_o1, count(*) FILTER (synth = 0 AND label = 0) AS s0_o0
           FROM labelled GROUP BY 1)""")
def _(t):
    return rl.label_confusion(rl.apply_rules(t.containers, t.brand_incidence, t.rules))


SN = "greatest({c}, 1 - {c}) / greatest(1 - greatest({c}, 1 - {c}), 1e-6)"


@query("rul18_item_comparison",
       "rule_id:l item_key:s n:l orig_c1:d synth_c1:d orig_snr:d synth_snr:d snr_delta:d separation:d",
       f"""WITH s AS (SELECT container_id, list(item_key) AS items FROM incidence GROUP BY 1),
           g AS (SELECT v.item_key AS rule_id, c.container_id, CASE WHEN b.item_key IS NULL THEN 0 ELSE 1 END AS synth
             FROM containers c, brand_vocab v LEFT JOIN brand_incidence b ON b.container_id = c.container_id AND b.item_key = v.item_key),
           d AS (SELECT * FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY rule_id, synth
             ORDER BY md5('42|' || container_id), container_id) <= 40) JOIN s USING (container_id)),
           sep AS ({SEPARATION})
           SELECT i.rule_id, item_key, n, orig_c1, synth_c1, {SN.format(c='orig_c1')} AS orig_snr, {SN.format(c='synth_c1')} AS synth_snr,
             {SN.format(c='synth_c1')} - {SN.format(c='orig_c1')} AS snr_delta, separation
           FROM (SELECT rule_id, item_key, count(*) AS n, avg(label) AS orig_c1, avg(synth) AS synth_c1
             FROM brand_incidence JOIN labelled USING (container_id) GROUP BY ALL) i
           JOIN sep ON sep.rule_id = item_key""")
def _(t):
    lab = rl.apply_rules(t.containers, t.brand_incidence, t.rules)
    table = rl.label_snr_by_item(t.brand_incidence, lab)
    own = t.brand_vocab.select(F.col("item_key").alias("rule_id"), F.lit(0).alias("clause_id"), "item_key")
    sep = rl.separation(t.containers, t.incidence, t.brand_incidence, own, 40, "42")
    return table.join(sep.withColumnRenamed("rule_id", "item_key"), "item_key")


@query("rul19_sample_rules", "rule_key:s k:l rule:s n_pos:l cov:d min_new_pos:l min_clause_support:l")
def _(t):
    f, n = _itemsets(t)
    return search.sample_rules(t.brand_incidence, f, n, _min_count(n), n_rules=20, cov_lo=0.2, cov_hi=0.6, max_tries=200_000)


CORRS = """SELECT rule_id, item_key, supp, nf AS n_fired, nf - n11 AS sep,
     (n * n11 - supp * nf) / nullif(sqrt(supp * (n - supp)) * sqrt(nf * (n - nf)), 0) AS corr FROM (
   SELECT l.rule_id, v.item_key, max(v.n_containers) AS supp, sum(synth) AS nf, count(*) AS n,
     count(*) FILTER (synth = 1 AND b.item_key IS NOT NULL) AS n11
   FROM labelled l, brand_vocab v LEFT JOIN brand_incidence b ON b.container_id = l.container_id AND b.item_key = v.item_key
   WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.rule_id = l.rule_id AND r.item_key = v.item_key) GROUP BY ALL)"""


@query("rul20_correlates", "rule_id:l item_key:s corr:d sep:l supp:l sign:s fallback:b",
       f"""WITH c AS ({CORRS}), m AS (SELECT rule_id, max(corr) AS best, arg_max(item_key, (corr, item_key)) AS best_item FROM c WHERE corr > 0 GROUP BY 1)
           SELECT rule_id, item_key, corr, sep, supp, CASE WHEN corr <= -{CORR} THEN 'neg' ELSE 'pos' END AS sign,
             corr < {CORR} AND corr > -{CORR} AS fallback FROM c LEFT JOIN m USING (rule_id)
           WHERE abs(corr) >= {CORR} OR (best < {CORR} AND item_key = best_item)""")
def _(t):
    fired = rl.fired_containers(t.brand_incidence, t.rules)
    return rl.correlates(rl.rule_correlations(t.brand_incidence, fired, t.rules, t.n_containers), CORR)


@query("rul21_difficulty", "rule_id:l spread:d overlap:d max_corr:d median_truth:d",
       f"""WITH s AS (SELECT rule_id, clause_id, count(*) AS n FROM fired_clauses GROUP BY ALL),
           o AS (SELECT a.rule_id, a.clause_id AS x, b.clause_id AS y, count(*) AS i FROM fired_clauses a JOIN fired_clauses b
              ON a.rule_id = b.rule_id AND a.container_id = b.container_id AND a.clause_id < b.clause_id GROUP BY ALL)
           SELECT rule_id, spread, coalesce(overlap, 0) AS overlap, max_corr, median_truth FROM
             (SELECT rule_id, max(n) / greatest(min(n), 1) AS spread FROM s GROUP BY 1)
             LEFT JOIN (SELECT o.rule_id, max(i / (p.n + q.n - i)) AS overlap FROM o JOIN s p ON p.rule_id = o.rule_id AND p.clause_id = x
                JOIN s q ON q.rule_id = o.rule_id AND q.clause_id = y GROUP BY 1) USING (rule_id)
             LEFT JOIN (SELECT rule_id, max(abs(corr)) AS max_corr FROM ({CORRS}) GROUP BY 1) USING (rule_id)
             LEFT JOIN (SELECT rule_id, quantile_cont(n, 0.5) AS median_truth FROM
                (SELECT rule_id, container_id, count(*) AS n FROM truth WHERE kind = 'node' GROUP BY ALL) GROUP BY 1) USING (rule_id)""")
def _(t):
    fired = rl.fired_clauses(t.brand_incidence, t.rules)
    corrs = rl.rule_correlations(
        t.brand_incidence, fired.select("rule_id", "container_id").distinct(), t.rules, t.n_containers
    )
    return rl.difficulty(fired, t.truth, corrs)


@query("rul22_connectivity", "rule_id:l clause_id:l n_containers:l connectivity:d",
       """WITH m AS (SELECT f.rule_id, f.clause_id, f.container_id, e.element_id FROM fired_clauses f JOIN rules r USING (rule_id, clause_id)
             JOIN elements e ON e.container_id = f.container_id AND e.brand = r.item_key
             WHERE (f.rule_id, f.clause_id) IN (SELECT (rule_id, clause_id) FROM rules GROUP BY ALL HAVING count(*) >= 2))
          SELECT rule_id, clause_id, count(*) AS n_containers, avg(CAST(hi - lo + 1 = n AS INT)) AS connectivity FROM
            (SELECT rule_id, clause_id, container_id, max(element_id) AS hi, min(element_id) AS lo, count(*) AS n FROM m GROUP BY ALL)
          GROUP BY ALL""")
def _(t):
    return search.connectivity(t.brand_elements, t.edges, t.rules)


def _name_tokens(t):
    p = t.raw("part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("item_key")).distinct()
    return p.withColumn("toks", F.array_distinct(F.split(F.lower("item_key"), " "))).withColumn(
        "toks", F.filter("toks", lambda x: ~x.isin("brand#1", "brand#2", "brand#3", "brand#4", "brand#5"))
    )


NAME_TOKENS = """SELECT DISTINCT k AS item_key, list_filter(list_distinct(string_split(lower(k), ' ')),
     lambda x: x NOT IN ('brand#1', 'brand#2', 'brand#3', 'brand#4', 'brand#5')) AS toks
   FROM (SELECT p_name || ' ' || p_type || ' ' || p_brand AS k FROM part)"""


@query("rul23_look_alikes", "smaller:s larger:s",
       f"""WITH k AS ({NAME_TOKENS}) SELECT a.item_key AS smaller, b.item_key AS larger FROM k a JOIN k b
           ON a.item_key <> b.item_key AND list_has_all(b.toks, a.toks) AND len(b.toks) - len(a.toks) BETWEEN 0 AND 2""")
def _(t):
    return rl.look_alikes(_name_tokens(t))


def _top_names(t):
    rows = _name_tokens(t).orderBy(F.size("toks"), "item_key").limit(20).collect()
    return [r["item_key"] for r in rows]


@query("rul24_subsuming", "top_item:s item_key:s direction:s",
       f"""WITH k AS ({NAME_TOKENS}), t AS (SELECT * FROM k ORDER BY len(toks), item_key LIMIT 20)
           SELECT t.item_key AS top_item, k.item_key, CASE WHEN list_has_all(k.toks, t.toks) THEN 'specific' ELSE 'general' END AS direction
           FROM t JOIN k ON t.item_key <> k.item_key AND (list_has_all(k.toks, t.toks) OR list_has_all(t.toks, k.toks))""")
def _(t):
    return rl.subsuming(_name_tokens(t), _top_names(t))


@query("rul25_tag_families", "top_item:s tag:s item_key:s",
       """SELECT b.item_key AS top_item, k.p_type AS tag, o.p_name || '|' || o.p_brand AS item_key
          FROM brand_vocab b JOIN (SELECT DISTINCT p_brand, p_type FROM part) k ON k.p_brand = b.item_key
          JOIN (SELECT DISTINCT p_name, p_brand, p_type FROM part) o ON o.p_type = k.p_type""")
def _(t):
    p = t.raw("part")
    tags = p.select(F.concat_ws("|", "p_name", "p_brand").alias("item_key"), F.col("p_type").alias("tag")).distinct()
    top = p.where(F.col("p_brand").isin(t.brand_names)).select(F.col("p_brand").alias("item_key"), F.col("p_type").alias("tag"))
    both = tags.unionByName(top.distinct())
    return rl.tag_families(both, t.brand_names).where(F.col("item_key").contains("|"))


@query("rul26_shortcut_report", "rule_id:l clause_id:l shortcut_auc:d distractors:s")
def _(t):
    return search.shortcut_report(t.brand_incidence, t.containers, t.rules, t.brand_names, t.n_containers, threshold=0.005)


@query("rul27_cross_validated_auc", "rule_id:l auc:d")
def _(t):
    aucs = search.rule_aucs(t.brand_incidence, t.containers, t.rules, t.brand_names)
    return t.spark.createDataFrame(sorted(aucs.items()), "rule_id int, auc double")


@query("rul28_grade_rules", "rule_id:l shortcut_auc:d composition_auc:d")
def _(t):
    kinds = t.lines.select("container_id", F.col("kind").alias("item_key")).distinct()
    names = [r["item_key"] for r in kinds.select("item_key").distinct().orderBy("item_key").collect()]  # part types
    return search.grade_rules(t.brand_incidence, t.containers, t.rules, t.brand_names, kinds, names)


KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("rul29_composition", "container_id:l " + " ".join(f"{k}:l" for k in KINDS),
       "SELECT container_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in KINDS)
       + " FROM lines GROUP BY 1")
def _(t):
    return rl.composition(t.lines, KINDS)


@query("rul30_load_rule", "rule_id:l clause_id:l item_key:s", "SELECT * FROM rules WHERE rule_id = 3")
def _(t):
    keyed = t.rules.withColumn("rule_key", F.concat(F.lit("r"), F.col("rule_id").cast("string")))
    by_index = rl.load_rule(keyed, 2)
    return rl.load_rule(by_index, "r3")


@query("rul31_rule_table", "rule_id:l rule:s n_clauses:l n_fired:l rank:l",
       """SELECT *, row_number() OVER (ORDER BY n_fired DESC, rule_id) AS rank FROM
          (SELECT rule_id, string_agg('(' || c || ')', ' | ' ORDER BY clause_id) AS rule, count(*) AS n_clauses FROM
            (SELECT rule_id, clause_id, string_agg(item_key, ' & ' ORDER BY item_key) AS c FROM rules GROUP BY ALL) GROUP BY 1)
          JOIN (SELECT rule_id, count(*) AS n_fired FROM fired GROUP BY 1) USING (rule_id)""")
def _(t):
    from incidex import skew

    n = rl.fired_containers(t.brand_incidence, t.rules).groupBy("rule_id").agg(F.count("*").alias("n_fired"))
    table = rl.rule_text(t.rules).join(n, "rule_id")
    return skew.number_rows(table, [], [-F.col("n_fired"), F.col("rule_id")], "rank")


@query("rul32_extract_rules", "n_clauses:l rule:s n1:l pct1:d rank:l")
def _(t):
    from incidex.operators import vocab as voc

    vocab = t.brand_vocab.select("item_key", "n_containers", F.lit(2).alias("n_elements"), F.lit(True).alias("above_min_sup"))
    cand = voc.rule_candidates(vocab, vocab, t.n_containers, min_cover=5.0, n=6)
    names = [r["item_key"] for r in cand.collect()]  # at most six items
    cl = [r["items"] for r in rl.clauses(t.brand_incidence, names, max_size=2).orderBy(F.size("items"), "items").collect()]
    return rl.dnf_rules(t.brand_incidence, cl, t.containers.count(), max_clauses=3)


# Every phrase of the benchmark, of any length: what stands between marks.
PHRASES = """(WITH ph AS (SELECT DISTINCT list_filter(regexp_split_to_array(lower(f), '[^a-z]+'), lambda x: x <> '') AS w FROM (SELECT unnest(regexp_split_to_array(text, '[.,!?\n]')) AS f FROM benchmark)),
   pp AS (SELECT row_number() OVER (ORDER BY w) AS pid, w, len(w) AS n FROM ph WHERE len(w) > 0),
   parts AS (SELECT pid, unnest(w) AS token, unnest(range(n)) AS j FROM pp),
   two AS (SELECT doc_id, pos, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS t2 FROM tokens),
   starts AS (SELECT doc_id, pos, pid, n FROM two JOIN pp ON token = w[1] AND (n = 1 OR t2 = w[2])),
   found AS (SELECT s.doc_id, s.pos, s.pid, s.n FROM starts s JOIN parts p USING (pid) JOIN tokens t ON t.doc_id = s.doc_id AND t.pos = s.pos + p.j AND t.token = p.token
     GROUP BY ALL HAVING count(*) = s.n)
   SELECT DISTINCT doc_id AS container_id, unnest(range(pos, pos + n)) AS pos FROM found)"""


def _pattern_runs(t):
    phrases = t.raw("benchmark").select(F.explode(F.split("text", "[.,!?\n]")).alias("f"))
    words = F.array_remove(F.split(F.lower("f"), "[^a-z]+"), "")
    docs = t.raw("documents").select(F.col("doc_id").alias("container_id"), F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "").alias("words"))
    return ph.pattern_runs(docs, "container_id", "words", phrases.select(words.alias("words")))


@query("rul33_pattern_truth", "container_id:l element_id:l", f"SELECT container_id, pos AS element_id FROM {PHRASES}")
def _(t):
    return _pattern_runs(t).select("container_id", F.explode(F.sequence("lo", "hi")).alias("element_id"))


@query("rul33_pattern_counts", "container_id:l n_true:l",
       f"SELECT d.doc_id AS container_id, count(p.pos) AS n_true FROM documents d LEFT JOIN {PHRASES} p ON p.container_id = d.doc_id GROUP BY 1")
def _(t):
    found = _pattern_runs(t).groupBy("container_id").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n_true"))
    docs = t.raw("documents").select(F.col("doc_id").alias("container_id"))
    return docs.join(found, "container_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))


@query("rul33_pattern_edges", "container_id:l src:l dst:l",
       f"""WITH p AS MATERIALIZED (SELECT * FROM {PHRASES})
          SELECT a.container_id, a.pos AS src, b.pos AS dst FROM p a JOIN p b ON a.container_id = b.container_id AND b.pos = a.pos + 1""")
def _(t):
    pairs = _pattern_runs(t).where("hi > lo").select("container_id", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("src"))
    return pairs.withColumn("dst", F.col("src") + 1)


@query("rul34_example", "container_id:l n_items:l rule_items:s",
       """SELECT container_id, n_items, rule_items FROM (SELECT container_id, count(*) AS n_items,
            string_agg(item_key, ',' ORDER BY item_key) FILTER (item_key IN (SELECT item_key FROM rules WHERE rule_id = 1)) AS rule_items
          FROM brand_incidence GROUP BY 1) WHERE n_items BETWEEN 3 AND 6 AND rule_items IS NOT NULL ORDER BY container_id LIMIT 1""")
def _(t):
    e = rl.example_container(t.brand_incidence, t.rules.where("rule_id = 1"))
    return e.withColumn("rule_items", F.array_join("rule_items", ","))
