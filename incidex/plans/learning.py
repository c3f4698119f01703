"""Corpus-statistics and vocabulary-learning queries (LRN) with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from incidex.operators import graph
from incidex.operators import learn as ln
from incidex.operators import merges as mg
from incidex.operators import rules as rl
from incidex.plans.bindings import chain_edges
from incidex.plans.registry import query

BITS = "log2(20)"


def _docs(t):
    words = F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "")
    return t.raw("documents").select("doc_id", words.alias("words"))


SPANS = """(WITH w AS (SELECT doc_id, pos, token, lead(token) OVER d AS t2, lead(token, 2) OVER d AS t3, lag(token) OVER d AS l FROM tokens
     WINDOW d AS (PARTITION BY doc_id ORDER BY pos))
   SELECT doc_id, pos AS start, 1 AS size, token AS key, l AS "left", t2 AS "right" FROM w
   UNION ALL SELECT doc_id, pos, 2, token || ' ' || t2, l, t3 FROM w WHERE t2 IS NOT NULL)"""


STATS = f"""WITH c AS (SELECT * FROM {SPANS}),
   b AS (SELECT key, count(*) AS support, avg(m) AS mm, max(size) AS size, max(attach) AS attach FROM
     (SELECT doc_id, key, count(*) AS m, max(size) AS size, max(("left" IS NOT NULL)::INT + ("right" IS NOT NULL)::INT) AS attach FROM c GROUP BY ALL) GROUP BY key),
   h AS (SELECT key, sum(c) AS tot, count(*) AS k, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM
     (SELECT key, coalesce("right", '') AS ctx, count(*) AS c FROM c GROUP BY ALL) GROUP BY key),
   s AS (SELECT b.key, support, size, (1 - 1 / size) * (size / (size + attach)) AS s_structure,
       greatest(coalesce((ln(1 + support) - ln(2)) / nullif((SELECT ln(1 + max(support)) - ln(2) FROM b), 0), 0), 0) AS s_support,
       CASE WHEN tot > 1 AND k > 1 THEN 1 - h / ln(k) ELSE 1 END AS s_stability, 1 - 1 / mm AS s_degeneracy FROM b JOIN h USING (key))"""


@query("lrn1_candidate_stats", "key:s support:l size:l s_structure:d s_support:d s_stability:d s_degeneracy:d weight:d",
       f"{STATS} SELECT *, s_structure * (s_support + s_stability - s_degeneracy) AS weight FROM s")
def _(t):
    return ln.candidate_stats(_docs(t), "words", 2)


@query("lrn1_additive_by_size", "size:l n:l mean_weight:d",
       f"{STATS} SELECT size, count(*) AS n, avg(0.2 * s_structure + s_support + s_stability - s_degeneracy) AS mean_weight FROM s GROUP BY size")
def _(t):
    s = ln.candidate_stats(_docs(t), "words", 2, form="additive", alpha=0.2)
    return s.groupBy("size").agg(F.count("*").alias("n"), F.avg("weight").alias("mean_weight"))


NEXT = """(SELECT a.container_id, a.element_id AS boundary, a.flag <> b.flag AS c1, a.kind <> b.kind AS c2, a.brand <> b.brand AS c3
   FROM elements a JOIN elements b ON a.container_id = b.container_id AND b.element_id = a.element_id + 1)"""
CUTS = f"(SELECT container_id, boundary, 'flag' AS method FROM {NEXT} WHERE c1 UNION ALL SELECT container_id, boundary, 'kind' FROM {NEXT} WHERE c2 UNION ALL SELECT container_id, boundary, 'brand' FROM {NEXT} WHERE c3)"


def _boundaries(t):
    e = t.elements.select("container_id", "element_id", "flag", "kind", "brand")
    nxt = e.select("container_id", (F.col("element_id") - 1).alias("element_id"), *[F.col(c).alias(f"{c}2") for c in ("flag", "kind", "brand")])
    j = e.join(nxt, ["container_id", "element_id"]).withColumnRenamed("element_id", "boundary")
    votes = F.filter(
        F.array(*[F.when(F.col(c) != F.col(f"{c}2"), F.lit(c)) for c in ("flag", "kind", "brand")]), lambda m: m.isNotNull()
    )
    return j.select("container_id", "boundary"), j.select("container_id", "boundary", F.explode(votes).alias("method"))


@query("lrn2_vote_stats", "container_id:l all_share:d vote_share:d best_share:d",
       f"""SELECT container_id, coalesce(sum((h = n)::INT) / 3, 0) AS all_share, coalesce(sum(h) / max(n) / 3, 0) AS vote_share, coalesce(max(h) / max(n), 0) AS best_share
           FROM (SELECT container_id, count(*) AS n FROM {NEXT} GROUP BY 1) LEFT JOIN
             (SELECT container_id, method, count(*) AS h FROM {CUTS} GROUP BY ALL) USING (container_id) GROUP BY 1""")
def _(t):
    bounds, cuts = _boundaries(t)
    return ln.vote_stats(bounds, cuts, ["container_id"], 3)


@query("lrn3_eligible", "reason:s size:l n:l",
       f"""WITH c AS (SELECT doc_id, start, size, key FROM {SPANS}), s AS (SELECT key FROM c GROUP BY key HAVING count(DISTINCT doc_id) >= 40),
           f AS (SELECT c.*, s.key IS NOT NULL AS ok FROM c LEFT JOIN s ON s.key = c.key), o AS (SELECT doc_id, start FROM f WHERE size = 1 AND ok),
           g AS (SELECT f.*, a.start IS NOT NULL OR b.start IS NOT NULL AS better FROM f LEFT JOIN o a ON a.doc_id = f.doc_id AND a.start = f.start
             LEFT JOIN o b ON b.doc_id = f.doc_id AND b.start = f.start + 1)
           SELECT CASE WHEN ok THEN 'supported' WHEN size = 1 THEN 'irreducible' WHEN NOT better THEN 'no_better' ELSE 'gated' END AS reason, size, count(*) AS n FROM g GROUP BY ALL""")
def _(t):
    runs = ln.run_counts(_docs(t), "words", 2)
    return ln.eligible(runs, 40, 2).groupBy("reason", "size").agg(F.sum("n").alias("n"))


@query("lrn4_candidates", "size:l n_candidates:l n_keys:l",
       f"SELECT size, count(*) AS n_candidates, count(DISTINCT key) AS n_keys FROM {SPANS} GROUP BY size")
def _(t):
    per = ln.run_counts(_docs(t), "words", 2)
    return per.groupBy("size").agg(F.sum("n").alias("n_candidates"), F.count("*").alias("n_keys"))


PAIRS = """(SELECT token AS ctx, nxt AS partner FROM (SELECT token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tokens) WHERE nxt IS NOT NULL
   UNION ALL SELECT nxt, token FROM (SELECT token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tokens) WHERE nxt IS NOT NULL)"""
ENTROPY = f"""SELECT ctx, sum(c) AS n, count(*) AS n_partners, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS entropy
   FROM (SELECT ctx, partner, count(*) AS c FROM {PAIRS} GROUP BY ALL) GROUP BY ctx"""


def _pairs(t):
    """Counts of neighbouring words, not summed."""
    return ln.context_counts(_docs(t), "words", 1, summed=False).where("ctx <> ''").select(F.col("key").alias("a"), F.col("ctx").alias("b"), "c")


@query("lrn5_branching_entropy", "ctx:s n:l n_partners:l entropy:d", ENTROPY)
def _(t):
    return ln.branching_entropy(_pairs(t))


@query("lrn6_local_max_cuts", "doc_id:l n_edges:l n_cuts:l n_null:l",
       f"""WITH h AS ({ENTROPY}), v AS (SELECT doc_id, pos, round(entropy, 9) AS v FROM tokens JOIN h ON ctx = token),
           n AS (SELECT doc_id, pos, v, greatest(lag(v) OVER d, lead(v) OVER d) AS near FROM v WINDOW d AS (PARTITION BY doc_id ORDER BY pos))
           SELECT doc_id, count(*) AS n_edges, count(*) FILTER (v > near) AS n_cuts, count(*) FILTER (near IS NULL) AS n_null FROM n GROUP BY doc_id""")
def _(t):
    h = ln.branching_entropy(_pairs(t)).select(F.col("ctx").alias("token"), F.round("entropy", 9).alias("v"))
    return ln.local_max_counts(_docs(t), "doc_id", "words", h)


@query("lrn7_description_length", "lang:s bits:d n:l",
       f"""SELECT lang, sum(length(token)) * {BITS} + sum(c) * log2(sum(c)) - sum(c * log2(c)) AS bits, sum(c) AS n FROM
           (SELECT lang, token, count(*) AS c FROM tokens JOIN documents USING (doc_id) GROUP BY ALL) GROUP BY lang""")
def _(t):
    lang = t.raw("documents").select("doc_id", "lang")
    c = t.tokens.join(lang, "doc_id").groupBy("lang", "token").agg(F.count("*").alias("c"))
    return ln.description_length(c.withColumn("size", F.length("token")), ["lang"])


@query("lrn8_model_length", "bits:d n_types:l",
       f"""SELECT sum(length(token)) * {BITS} + count(*) * log2(greatest(count(*), 2)) + sum(c) * log2(sum(c)) - sum(c * log2(c)) AS bits, count(*) AS n_types
           FROM (SELECT token, count(*) AS c FROM tokens GROUP BY token)""")
def _(t):
    c = t.tokens.groupBy("token").agg(F.count("*").alias("c"))
    return ln.model_length(c.withColumn("size", F.length("token")))


def _words(t):
    """Distinct words as letter sequences, weighted by their count in the corpus."""
    w = t.tokens.groupBy("token").agg(F.count("*").alias("w"))
    return mg.pack_sequences(w.select(F.split("token", "").alias("tokens"), "w"))


# One merge a step; a row without weight carries the tokens made so far, whose place is their age.
MERGED = """(WITH RECURSIVE s AS (
   SELECT 0 AS step, '<' || array_to_string(string_split(token, ''), '><') || '>' AS seq, count(*)::BIGINT AS w, '' AS a, '' AS b, 0::BIGINT AS c, NULL::VARCHAR[] AS made FROM tokens GROUP BY token
   UNION ALL SELECT 0, '', 0, '', '', 0, []
   UNION ALL
   SELECT step + 1, replace(seq, '<' || m.a || '><' || m.b || '>', '<' || m.a || m.b || '>'), w, m.a, m.b, m.c, list_append(s.made, m.a || m.b) FROM s,
     (SELECT p.* FROM (SELECT a, b, sum(w)::BIGINT AS c FROM (SELECT w, unnest(t[:-2]) AS a, unnest(t[2:]) AS b FROM (SELECT w, string_split(seq[2:-2], '><') AS t FROM s WHERE w > 0) WHERE len(t) > 1)
        WHERE length(a || b) <= 4 GROUP BY ALL HAVING sum(w) >= 0.001 * (SELECT count(*) FROM tokens)) p, (SELECT made FROM s WHERE w = 0) o
      ORDER BY c DESC, greatest(coalesce(list_position(made, a), 0), coalesce(list_position(made, b), 0)), a, b LIMIT 1) m)
  SELECT * FROM s)"""


def _trace(t, trace):
    return t.spark.createDataFrame([(i + 1, a, b, c) for i, (a, b, c) in enumerate(trace)], "step int, a string, b string, c long")


@query("lrn9_bpe_frequency", "step:l a:s b:s c:l", f"SELECT step, a, b, c FROM {MERGED} WHERE w = 0 AND step > 0")
def _(t):
    return _trace(t, mg.merge_by_support(_words(t), 0.001, cap=4))


@query("lrn10_bpe_description", "step:l a:s b:s bits:d")
def _(t):
    trace = mg.merge_by_length(_words(t))
    return t.spark.createDataFrame([(i + 1, *x) for i, x in enumerate(trace)], "step int, a string, b string, bits double")


@query("lrn11_knee", "n_keep:l distance:d",
       """WITH c AS (SELECT row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS step, count(*) AS c FROM tokens GROUP BY token),
          e AS (SELECT max(step) AS x1, log10(greatest(arg_min(c, step), 1)) AS y0, log10(greatest(arg_max(c, step), 1)) AS y1 FROM c),
          d AS (SELECT step, round(abs((y1 - y0) * step - x1 * (log10(greatest(c, 1)) - y0)) / sqrt(x1 * x1 + (y1 - y0) * (y1 - y0)), 9) AS d FROM c, e)
          SELECT arg_max(step, (d, -step)) + 1 AS n_keep, max(d) AS distance FROM d""")
def _(t):
    c = t.tokens.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("c"))
    return ln.knee(ln.id_order(c))


@query("lrn12_bpe_shoulder", "step:l a:s b:s c:l")
def _(t):
    return _trace(t, mg.merge_to_knee(_words(t)))


@query("lrn13_apply_merges", "token:s c:l",
       f"""WITH s AS MATERIALIZED (SELECT step, seq, w FROM {MERGED})
           SELECT token, sum(w) AS c FROM (SELECT w, unnest(string_split(seq[2:-2], '><')) AS token FROM s WHERE w > 0 AND step = (SELECT max(step) FROM s)) GROUP BY token""")
def _(t):
    words = _words(t)
    trace = mg.merge_by_support(words, 0.001, cap=4)
    return mg.token_supports(mg.apply_merges(words, trace)).withColumnRenamed("t", "token")


def _baskets(t):
    per = t.brand_incidence.groupBy("container_id").agg(F.array_sort(F.collect_set("item_key")).alias("items"))
    return per.groupBy("items").agg(F.count("*").alias("n"))


@query("lrn14_merge_parents", "step:l parent:s n_merged:l saved:l")
def _(t):
    names = t.brand_names  # bounded item list
    parents = [(f"P{i}", [names[i], names[i + 1]]) for i in range(0, len(names) - 1, 2)]
    floor = t.containers.count() // 100
    _, history = ln.merge_parents(_baskets(t), parents, {n: 1 for n in names}, floor, 0.5)
    return t.spark.createDataFrame([(i + 1, *h) for i, h in enumerate(history)], "step int, parent string, n_merged long, saved long")


@query("lrn15_hierarchy", "node:s support:l n_children:l depth:l parent:s method:s is_internal:b",
       """WITH c AS (SELECT DISTINCT container_id, kind AS parent, brand AS child, 1 AS depth, 'kind' AS method FROM lines
            UNION ALL SELECT DISTINCT container_id, brand, brand || ':' || flag, 2, 'flag' FROM lines),
          e AS (SELECT child AS node, count(*) AS s, min(depth) AS depth, min(parent) AS parent, min(method) AS method FROM c GROUP BY 1),
          r AS (SELECT kind AS node, count(DISTINCT container_id) AS r FROM lines GROUP BY 1), k AS (SELECT parent AS node, count(DISTINCT child) AS k FROM c GROUP BY 1)
          SELECT node, coalesce(s, 0) + coalesce(r, 0) AS support, coalesce(k, 0) AS n_children, CASE WHEN r IS NOT NULL THEN 0 ELSE depth END AS depth,
            CASE WHEN r IS NULL THEN parent END AS parent, CASE WHEN r IS NOT NULL THEN 'root' ELSE method END AS method,
            coalesce(k, 0) > 0 AND r IS NULL AS is_internal FROM e FULL JOIN r USING (node) LEFT JOIN k USING (node)""")
def _(t):
    li = t.lines
    one = li.select(F.col("container_id").alias("record"), F.col("kind").alias("parent"), F.col("brand").alias("child"), F.lit(1).alias("depth"), F.lit("kind").alias("method")).distinct()
    two = li.select(F.col("container_id").alias("record"), F.col("brand").alias("parent"), F.concat_ws(":", "brand", "flag").alias("child"), F.lit(2).alias("depth"), F.lit("flag").alias("method")).distinct()
    roots = li.select(F.col("container_id").alias("record"), F.col("kind").alias("node")).distinct()
    return ln.hierarchy(one.unionByName(two), roots)


def _trees(t):
    """Order -> part types -> return flags: three-level trees with few children per node."""
    li = t.lines.select("container_id", "kind", "flag").distinct()
    root = li.select(F.col("container_id").alias("tree"), F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("order").alias("key")).distinct()
    mid = li.select(F.col("container_id").alias("tree"), F.col("kind").alias("node"), F.lit("root").alias("parent"), F.col("kind").alias("key")).distinct()
    leaf = li.select(F.col("container_id").alias("tree"), F.concat_ws(":", "kind", "flag").alias("node"), F.col("kind").alias("parent"), F.col("flag").alias("key"))
    return root.unionByName(mid).unionByName(leaf)


def _twigs(t):
    """Part types of an order, each over the same two leaves: trees in which every type pays as a rule."""
    li = t.lines.select(F.col("container_id").alias("tree"), "kind")
    node = lambda name, parent, key: F.struct(name.alias("node"), parent.cast("string").alias("parent"), key.alias("key"))
    k = F.col("kind")
    leaves = [node(x, k, x) for x in (F.concat("kind", F.lit(":price")), F.concat("kind", F.lit(":size")))]
    return li.distinct().select("tree", F.explode(F.array(node(k, F.lit(None), k), *leaves)).alias("n")).select("tree", "n.*")


@query("lrn16_learn_rulebook", "step:l key:s kids:s gain:d")
def _(t):
    book = ln.learn_rulebook(_twigs(t))
    rows = [(i + 1, k, c.replace("␟", ","), g) for i, (k, c, g) in enumerate(book)]
    return t.spark.createDataFrame(rows, "step int, key string, kids string, gain double")


@query("lrn17_apply_rulebook", "key:s n:l",
       """WITH m AS (SELECT container_id, kind, string_agg(DISTINCT flag, '' ORDER BY flag) AS f FROM lines GROUP BY ALL),
          k AS (SELECT *, f IN ('A', 'R') AS hit FROM m)
          SELECT kind AS key, count(*) AS n FROM k WHERE hit GROUP BY 1
          UNION ALL SELECT flag, count(*) FROM (SELECT DISTINCT container_id, kind, flag FROM lines) JOIN k USING (container_id, kind) WHERE NOT hit GROUP BY 1""")
def _(t):
    kinds = t.raw("part").select(F.col("p_type").alias("key")).distinct()
    book = kinds.withColumn("kids", F.explode(F.array(F.lit("A"), F.lit("R"))))
    return ln.apply_rulebook(_trees(t), book).groupBy("key").agg(F.count("*").alias("n"))


@query("lrn18_krimp", "step:l code:s size:l")
def _(t):
    """Codes over the part types of an order; candidates are all itemsets that a tenth of the orders hold."""
    inc = t.lines.select("container_id", F.col("kind").alias("item_key")).distinct()
    per = inc.groupBy("container_id").agg(F.array_sort(F.collect_set("item_key")).alias("items"))
    baskets = per.groupBy("items").agg(F.count("*").alias("n"))
    frequent = rl.itemsets(inc, t.containers.count() // 10).where(F.size("items") > 1).collect()  # of a handful of types
    codes, _ = ln.krimp(baskets, [(sorted(r["items"]), r["n"]) for r in frequent])
    rows = [(i + 1, ",".join(c), len(c)) for i, c in enumerate(codes)]
    return t.spark.createDataFrame(rows, "step int, code string, size int")


@query("lrn19_greedy_cover", "code:s size:l c:l",
       """WITH top AS (SELECT item_key, rank FROM brand_vocab WHERE rank <= 4),
          b AS (SELECT container_id, max((rank = 1)::INT) AS r1, max((rank = 2)::INT) AS r2, max((rank = 3)::INT) AS r3, max((rank = 4)::INT) AS r4
            FROM brand_incidence LEFT JOIN top USING (item_key) GROUP BY 1),
          u AS (SELECT container_id, coalesce(r1 + r2 + r3, 0) = 3 AS u1, coalesce(r3 + r4, 0) = 2 AND coalesce(r1 + r2 + r3, 0) < 3 AS u2 FROM b),
          n AS (SELECT (SELECT item_key FROM top WHERE rank = 1) AS n1, (SELECT item_key FROM top WHERE rank = 2) AS n2, (SELECT item_key FROM top WHERE rank = 3) AS n3, (SELECT item_key FROM top WHERE rank = 4) AS n4)
          SELECT array_to_string(list_sort([n1, n2, n3]), ' & ') AS code, 3 AS size, count(*) AS c FROM u, n WHERE u1 GROUP BY 1
          UNION ALL SELECT array_to_string(list_sort([n3, n4]), ' & '), 2, count(*) FROM u, n WHERE u2 GROUP BY 1
          UNION ALL SELECT item_key, 1, count(*) FROM brand_incidence JOIN u USING (container_id) LEFT JOIN top USING (item_key)
            WHERE NOT (u1 AND coalesce(rank, 9) <= 3) AND NOT (u2 AND coalesce(rank, 9) IN (3, 4)) GROUP BY 1""")
def _(t):
    a = t.brand_names
    cover = ln.greedy_cover(_baskets(t), [[a[0], a[1], a[2]], [a[2], a[3]]])
    return ln.code_usage(cover).withColumn("code", F.array_join("code", " & "))


def _repair_sql(floor: int, rounds: int) -> str:
    steps = ["s0 AS (SELECT token AS key, count(*) AS n FROM tokens GROUP BY 1)"]
    for k in range(1, rounds + 1):
        p = f"s{k - 1}"
        steps.append(f"""a{k} AS (SELECT s.key, s.n, s.key[:length(s.key) // 2] AS l, s.key[length(s.key) // 2 + 1:] AS r FROM {p} s
              LEFT JOIN {p} x ON x.key = s.key[:length(s.key) // 2] LEFT JOIN {p} y ON y.key = s.key[length(s.key) // 2 + 1:]
              WHERE s.n < {floor} AND length(s.key) > 1 AND coalesce(x.n, 0) + s.n >= {floor} AND coalesce(y.n, 0) + s.n >= {floor}),
            s{k} AS (SELECT key, sum(n) AS n FROM (SELECT * FROM {p} WHERE key NOT IN (SELECT key FROM a{k})
              UNION ALL SELECT l, n FROM a{k} UNION ALL SELECT r, n FROM a{k}) GROUP BY key)""")
    return f"WITH {', '.join(steps)} SELECT key, n FROM s{rounds}"


@query("lrn20_repair", "key:s n:l", _repair_sql(5, 8))
def _(t):
    counts = t.tokens.groupBy(F.col("token").alias("key")).agg(F.count("*").alias("n"))
    half = F.floor(F.length("key") / 2).cast("int")
    return ln.repair(counts, lambda k: (F.substring(k, F.lit(1), half), F.substring(k, half + 1, F.length(k))), 5)


@query("lrn21_vote_cuts", "container_id:l boundary:l votes:l",
       f"""SELECT container_id, boundary, count(DISTINCT method) AS votes FROM {CUTS} WHERE (container_id, boundary) NOT IN
             (SELECT (container_id, element_id) FROM elements WHERE flag = 'R') GROUP BY ALL HAVING count(DISTINCT method) >= 2""")
def _(t):
    _, cuts = _boundaries(t)
    frozen = t.elements.where("flag = 'R'").select("container_id", F.col("element_id").alias("boundary"))
    return ln.vote_cuts(cuts, ["container_id"], 2, frozen)


@query("lrn22_components", "container_id:l element_id:l label:l",
       """WITH c AS (SELECT container_id, element_id, CASE WHEN flag = lag(flag) OVER w THEN 0 ELSE 1 END AS s FROM elements WINDOW w AS (PARTITION BY container_id ORDER BY element_id)),
          g AS (SELECT *, sum(s) OVER (PARTITION BY container_id ORDER BY element_id) AS g FROM c)
          SELECT container_id, element_id, min(element_id) OVER (PARTITION BY container_id, g) AS label FROM g""")
def _(t):
    e = t.brand_elements.select("container_id", "element_id", "flag")
    after = e.select("container_id", (F.col("element_id") - 1).alias("element_id"), F.col("flag").alias("flag2"))
    cuts = e.join(after, ["container_id", "element_id"]).where("flag <> flag2")
    cuts = cuts.select("container_id", F.col("element_id").alias("src"), (F.col("element_id") + 1).alias("dst"))
    return graph.components(e, chain_edges(e), ["container_id"], cuts=cuts)


@query("lrn23_support_levels", "level:s bucket:s n_keys:l largest:l",
       """SELECT level, CASE WHEN s = 1 THEN '1' WHEN s < 10 THEN '2-9' WHEN s < 100 THEN '10-99' WHEN s < 1000 THEN '100-999' ELSE '1000+' END AS bucket,
            count(*) AS n_keys, max(s) AS largest FROM (SELECT level, key, count(DISTINCT container_id) AS s FROM
            (SELECT container_id, 'kind' AS level, kind AS key FROM lines UNION ALL SELECT container_id, 'brand', brand FROM lines
             UNION ALL SELECT container_id, 'item_key', item_key FROM lines UNION ALL SELECT container_id, 'part_id', part_id FROM lines) GROUP BY ALL) GROUP BY ALL""")
def _(t):
    return ln.support_levels(t.lines, "container_id", ["kind", "brand", "item_key", "part_id"])
