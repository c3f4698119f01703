"""Vocabulary queries (VOC) with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from incidex.operators import vocab as voc
from incidex.plans.bindings import PCT, chain_edges, kept_sql
from incidex.plans.registry import query
from incidex.session import cut_lineage

SWEEP = [0.005, 0.015, 0.02, 0.024, 0.026, 0.028, 0.03, 0.034]

VOCAB_COLS = "item_key:s n_containers:l n_pos:l n_neg:l n_occurrences:l wt:l wt0:l wt1:l n_elements:l above_min_sup:b"


@query("flt1_train_valid", "container_id:l split:s",
       "SELECT container_id, split FROM containers WHERE split IN ('training', 'valid')")
def _(t):
    return voc.train_valid(t.containers)


@query("voc1_build_vocab", VOCAB_COLS, "SELECT * FROM vocab")
def _(t):
    return t.vocab


@query("voc1_token_vocab", "token:s n_docs:l n_occurrences:l",
       "SELECT token, count(DISTINCT doc_id) AS n_docs, count(*) AS n_occurrences FROM tokens GROUP BY token")
def _(t):
    per = t.tokens.groupBy("doc_id", "token").agg(F.count("*").alias("c"))
    return per.groupBy("token").agg(F.count("*").alias("n_docs"), F.sum("c").alias("n_occurrences"))


@query("voc2_assign_ids", "item_key:s item_id:l", "SELECT * FROM vocab_ids")
def _(t):
    return t.vocab_ids


@query("voc2_token_ids", "token:s item_id:l",
       """SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS item_id FROM
          (SELECT token, count(*) AS n FROM tokens GROUP BY token)""")
def _(t):
    v = t.tokens.groupBy("token").agg(F.count("*").alias("n"))
    ids = voc.assign_ids(v.withColumnRenamed("token", "item_key"), count="n")
    return ids.withColumnRenamed("item_key", "token")


@query("voc3_build_lookup", "container_id:l element_id:l item_key:s item_id:l", "SELECT * FROM lookup")
def _(t):
    return t.lookup


@query("voc4_incidence", "container_id:l item_key:s", "SELECT * FROM incidence")
def _(t):
    return voc.incidence(t.lines)


@query("voc5_threshold_items", "item_key:s", "SELECT * FROM kept")
def _(t):
    return t.kept


FOLD_KEPT = f"""SELECT fold, item_key, wt, wt0, wt1 FROM
   (SELECT fold, item_key, sum(c) AS wt, sum(CASE WHEN label = 0 THEN c ELSE 0 END) AS wt0,
      sum(CASE WHEN label <> 0 THEN c ELSE 0 END) AS wt1
    FROM (SELECT container_id, item_key, count(*) AS c FROM parts GROUP BY ALL)
    JOIN fold_splits USING (container_id) WHERE split <> 'test' GROUP BY ALL)
   JOIN (SELECT fold, count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label <> 0) AS n1
         FROM fold_splits WHERE split <> 'test' GROUP BY fold) USING (fold)
   WHERE {kept_sql(PCT)}"""


@query("voc6_fold_threshold", "fold:l item_key:s wt:l wt0:l wt1:l", FOLD_KEPT)
def _(t):
    return voc.fold_threshold(t.parts, t.fold_splits, PCT)


@query("voc7_resolved_cutoffs", "split:s pct:d cutoff:l",
       f"""SELECT split, pct, CAST(floor(pct * n) AS BIGINT) AS cutoff FROM
           (SELECT split, count(*) AS n, CASE split WHEN 'training' THEN {PCT} WHEN 'valid' THEN 0.03 ELSE 0.02 END::DOUBLE AS pct
            FROM containers GROUP BY split)""")
def _(t):
    chosen = {"test": 0.02}
    pct = {
        "training": voc.resolve_cutoff(chosen, "training", explicit=PCT),
        "valid": voc.resolve_cutoff(chosen, "valid", metadata=0.03),
        "test": voc.resolve_cutoff(chosen, "test"),
    }
    col = F.create_map(*[F.lit(x) for kv in pct.items() for x in kv])[F.col("split")]
    n = t.containers.groupBy("split").agg(F.count("*").alias("n"))
    return n.select("split", col.alias("pct"), F.floor(col * F.col("n")).alias("cutoff"))


@query("voc8_apply_threshold", "container_id:l element_id:l item_id:l",
       f"""SELECT container_id, element_id, CASE WHEN k.item_key IS NULL THEN -1 ELSE item_id END AS item_id
           FROM elements JOIN vocab_ids USING (item_key) LEFT JOIN (SELECT item_key FROM vocab, tv_counts
           WHERE {kept_sql(0.03)}) k USING (item_key)""")
def _(t):
    every = voc.build_lookup(t.elements, t.vocab_ids, t.vocab_ids)
    return voc.apply_threshold(every, voc.threshold_items(t.vocab, t.containers, 0.03))


@query("voc9_kept_ids", "item_id:l item_key:s", "SELECT item_id, item_key FROM vocab_ids JOIN kept USING (item_key)")
def _(t):
    return voc.kept_ids(t.vocab_ids, t.kept)


@query("voc10_fold_annotation", "fold:l item_id:l cutoff:l n_elements:l id_sum:l",
       f"""SELECT fold, CASE WHEN k.item_key IS NULL THEN -1 ELSE item_id END AS item_id, cutoff,
             count(*) AS n_elements, sum(element_id) AS id_sum
           FROM elements JOIN vocab_ids USING (item_key),
             (SELECT fold, CAST(floor(CAST({PCT} AS DOUBLE) * count(*)) AS BIGINT) AS cutoff FROM fold_splits
              WHERE split <> 'test' GROUP BY fold) f
           LEFT JOIN (SELECT fold AS kfold, item_key FROM ({FOLD_KEPT})) k
             ON k.item_key = elements.item_key AND kfold = fold
           GROUP BY ALL""")
def _(t):
    a = voc.fold_annotation(t.elements, t.vocab_ids, t.parts, t.fold_splits, PCT)
    return a.groupBy("fold", "item_id", "cutoff").agg(
        F.count("*").alias("n_elements"), F.sum("element_id").alias("id_sum")
    )


COVERAGE = """SELECT container_id, avg(CASE WHEN k.item_key IS NULL THEN 0.0::DOUBLE ELSE 1.0 END) AS share
   FROM lines LEFT JOIN {kept} k USING (item_key) GROUP BY container_id"""


@query("voc11_coverage", "n_containers:l coverage:d",
       f"SELECT count(*) AS n_containers, avg(share) AS coverage FROM ({COVERAGE.format(kept='kept')})")
def _(t):
    return voc.coverage(t.lines, t.kept)


def _sweep_sql() -> str:
    rows = []
    for p in SWEEP:
        glob = f"wt >= CAST(floor(CAST({p} AS DOUBLE) * n) AS BIGINT)"
        rows.append(f"""SELECT CAST({p} AS DOUBLE) AS threshold,
            (SELECT CAST(floor(CAST({p} AS DOUBLE) * n) AS BIGINT) FROM tv_counts) AS min_count,
            (SELECT coalesce(CAST(floor(CAST({p} AS DOUBLE) * CASE WHEN n0/n >= 0.6 THEN n1 WHEN n1/n >= 0.6 THEN n0 END) AS BIGINT), 0)
               FROM tv_counts) AS minority_cut,
            count(*) FILTER ({glob}) AS vocab_size_global, count(*) FILTER ({kept_sql(p)}) AS vocab_size,
            count(*) FILTER ({kept_sql(p)}) - count(*) FILTER ({glob}) AS n_rescued,
            coalesce(count(*) FILTER ({kept_sql(p)} AND above_min_sup) / nullif(count(*) FILTER (above_min_sup), 0), 1) AS common_kept,
            any_value(ctv) AS coverage_tv, any_value(cte) AS coverage_test, 1 - any_value(ctv) AS unk_rate
            FROM vocab, tv_counts, (SELECT avg(share) FILTER (split <> 'test') AS ctv, avg(share) FILTER (split = 'test') AS cte
              FROM ({COVERAGE.format(kept=f'(SELECT item_key FROM vocab, tv_counts WHERE {kept_sql(p)})')})
              JOIN containers USING (container_id))""")
    return " UNION ALL ".join(rows)


SWEEP_COLS = ("threshold:d min_count:l minority_cut:l vocab_size_global:l vocab_size:l n_rescued:l "
              "coverage_tv:d coverage_test:d unk_rate:d common_kept:d")


@query("voc12_sweep", SWEEP_COLS, _sweep_sql())
def _(t):
    return voc.sweep(t.lines, t.vocab, t.containers, SWEEP)


@query("voc13_suggest", "suggested:d vocab_size:l n_near_80:l n_near_90:l",
       f"""SELECT max(threshold) FILTER (coverage_tv >= 0.8) AS suggested,
             arg_max(vocab_size, threshold) FILTER (coverage_tv >= 0.8) AS vocab_size,
             count(*) FILTER (coverage_tv BETWEEN 0.78 AND 0.82) AS n_near_80,
             count(*) FILTER (coverage_tv BETWEEN 0.88 AND 0.92) AS n_near_90 FROM ({_sweep_sql()})""")
def _(t):
    return voc.suggest(voc.sweep(t.lines, t.vocab, t.containers, SWEEP))


@query("voc14_item_stats", "item_key:s n_elements:l freq_count:l freq_pct:d above_threshold:b",
       """SELECT v.item_key, n_elements, n_containers AS freq_count,
            n_containers / (SELECT count(*) FROM containers) * 100 AS freq_pct, k.item_key IS NOT NULL AS above_threshold
          FROM vocab v LEFT JOIN kept k ON v.item_key = k.item_key""")
def _(t):
    return voc.item_stats(t.vocab, t.containers, t.kept)


CSTATS = """SELECT container_id, split, label, coalesce(e, 0) AS n_elements, coalesce(p, 0) AS n_parts,
     coalesce(u, 0) AS n_unknown, coalesce(p, 0) = 1 AND coalesce(e, 0) > 0 AS single_part,
     coalesce(u, 0) / greatest(coalesce(e, 0), 1) * 100 AS pct_unknown
   FROM containers LEFT JOIN (SELECT container_id, sum(n_elements) AS e, count(*) AS p,
     sum(CASE WHEN k.item_key IS NULL THEN n_elements ELSE 0 END) AS u
     FROM parts LEFT JOIN kept k USING (item_key) GROUP BY container_id) USING (container_id)"""


@query("voc14_container_stats",
       "container_id:l split:s label:l n_elements:l n_parts:l n_unknown:l single_part:b pct_unknown:d", CSTATS)
def _(t):
    return voc.container_stats(t.parts, t.containers, t.kept)


BOTH_SPLITS = f"(SELECT * FROM ({CSTATS}) UNION ALL SELECT * REPLACE ('all' AS split) FROM ({CSTATS}))"


@query("voc15_split_summary",
       "split:s n:l n_single:l n_with_unknown:l n_unknown:l mean_pct_unknown:d mean_parts:d min_parts:l max_parts:l median_parts:d",
       f"""SELECT split, count(*) AS n, count(*) FILTER (single_part) AS n_single,
             count(*) FILTER (n_unknown > 0) AS n_with_unknown, sum(n_unknown) AS n_unknown,
             avg(pct_unknown) AS mean_pct_unknown, avg(n_parts) AS mean_parts, min(n_parts) AS min_parts,
             max(n_parts) AS max_parts, quantile_cont(n_parts, 0.5) AS median_parts FROM {BOTH_SPLITS} GROUP BY split""")
def _(t):
    return voc.split_summary(voc.container_stats(t.parts, t.containers, t.kept))


@query("voc15_parts_distribution", "split:s n_parts:l n:l",
       f"SELECT split, n_parts, count(*) AS n FROM {BOTH_SPLITS} GROUP BY ALL")
def _(t):
    return voc.parts_distribution(voc.container_stats(t.parts, t.containers, t.kept))


BUCKET = """CASE WHEN n_elements <= 2 THEN '1-2' WHEN n_elements <= 5 THEN '3-5' WHEN n_elements <= 9 THEN '6-9'
   WHEN n_elements <= 15 THEN '10-15' ELSE '16+' END"""


@query("voc15_size_buckets", "bucket:s n:l", f"SELECT {BUCKET} AS bucket, count(*) AS n FROM vocab GROUP BY 1")
def _(t):
    return t.vocab.groupBy(voc.size_bucket(F.col("n_elements")).alias("bucket")).agg(F.count("*").alias("n"))


@query("voc15_top20", "item_key:s n_containers:l",
       "SELECT item_key, n_containers FROM vocab ORDER BY n_containers DESC, item_key LIMIT 20")
def _(t):
    return t.vocab.orderBy(F.desc("n_containers"), "item_key").limit(20)


@query("voc16_vocab_stats",
       "vocab_size:l above_1pct:l above_5pct:l mean_size:d encoding_length:l single_part_containers:l "
       "size_0:l size_1:l size_2:l size_3:l size_4:l",
       """SELECT count(*) AS vocab_size, count(*) FILTER (n / nc >= 0.01) AS above_1pct,
            count(*) FILTER (n / nc >= 0.05) AS above_5pct, avg(s) AS mean_size, sum(n) AS encoding_length,
            (SELECT count(*) FROM (SELECT container_id FROM parts GROUP BY 1 HAVING count(*) = 1)) AS single_part_containers,
            count(*) FILTER (s <= 2) AS size_0, count(*) FILTER (s BETWEEN 3 AND 5) AS size_1,
            count(*) FILTER (s BETWEEN 6 AND 9) AS size_2, count(*) FILTER (s BETWEEN 10 AND 15) AS size_3,
            count(*) FILTER (s >= 16) AS size_4
          FROM (SELECT item_key, count(*) AS n, max(n_elements) AS s FROM parts GROUP BY 1),
               (SELECT count(*) AS nc FROM containers)""")
def _(t):
    return voc.vocab_stats(t.parts, t.n_containers)


@query("voc17_distributions", "histogram:s bucket:s n:l",
       """SELECT 'size' AS histogram, CAST(n_elements AS VARCHAR) AS bucket, count(*) AS n FROM vocab GROUP BY ALL
          UNION ALL SELECT 'support', CASE WHEN p < 1 THEN '<1%' WHEN p < 5 THEN '1-5%' WHEN p < 10 THEN '5-10%'
             WHEN p < 20 THEN '10-20%' ELSE '>20%' END, count(*)
          FROM (SELECT n_containers / (SELECT count(*) FROM containers) * 100 AS p FROM vocab) GROUP BY ALL
          UNION ALL SELECT 'parts', CASE WHEN c >= 15 THEN '15+' ELSE CAST(c AS VARCHAR) END, count(*)
          FROM (SELECT count(*) AS c FROM parts GROUP BY container_id) GROUP BY ALL""")
def _(t):
    return voc.distributions(t.parts, t.vocab, t.n_containers)


@query("voc18_enrichment", "item_key:s n_containers:l pct_pos:d enrichment:d",
       """SELECT item_key, n_containers, n_pos / greatest(n_containers, 1) * 100 AS pct_pos,
            (n_pos / greatest(np, 1)) / (greatest(n_neg, 1) / greatest(nn, 1)) AS enrichment
          FROM vocab, (SELECT sum(label) AS np, sum(1 - label) AS nn FROM containers)""")
def _(t):
    return voc.enrichment(t.vocab, t.containers)


SNR = "greatest({c}, 1 - {c}) / greatest(1 - greatest({c}, 1 - {c}), 1e-6)"


@query("voc19_snr_table", "item_key:s n_containers:l c1_first:d c1_second:d snr_first:d snr_second:d delta:d",
       f"""SELECT *, {SNR.format(c='c1_first')} AS snr_first, {SNR.format(c='c1_second')} AS snr_second,
             {SNR.format(c='c1_second')} - {SNR.format(c='c1_first')} AS delta FROM
           (SELECT item_key, count(*) AS n_containers, avg(label) AS c1_first, avg(label2) AS c1_second
            FROM incidence JOIN containers USING (container_id) GROUP BY 1)""")
def _(t):
    return voc.snr_table(t.incidence, t.containers)


@query("voc20_test_counts", "item_key:s n_split:l",
       """SELECT item_key, count(*) FILTER (split = 'test') AS n_split
          FROM incidence JOIN containers USING (container_id) GROUP BY 1""")
def _(t):
    return voc.split_counts(t.incidence, t.containers)


@query("voc21_full_coverage", "n_containers:l n_fully_known:l n_fully_covered:l",
       """SELECT count(*) AS n_containers, count(*) FILTER (low <> -1) AS n_fully_known,
            count(*) FILTER (n = m) AS n_fully_covered
          FROM (SELECT container_id, min(item_id) AS low, count(*) AS n FROM lookup GROUP BY 1)
          JOIN (SELECT container_id, sum(n_elements) AS m FROM parts GROUP BY 1) USING (container_id)
          JOIN (SELECT container_id FROM containers WHERE split = 'training') USING (container_id)""")
def _(t):
    train = t.containers.where("split = 'training'").select("container_id")
    sizes = t.parts.groupBy("container_id").agg(F.sum("n_elements").alias("n_elements")).join(train, "container_id")
    return voc.full_coverage(t.lookup, sizes)


@query("voc22_item_sets", "container_id:l split:s items:s",
       """SELECT container_id, split, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT container_id, item_id FROM lookup WHERE item_id <> -1)
          JOIN containers USING (container_id) GROUP BY ALL""")
def _(t):
    sets = voc.item_sets(t.lookup).join(t.containers.select("container_id", "split"), "container_id")
    return sets.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query("voc23_top_items", "item_key:s n_containers:l n_elements:l support:d sel_score:d",
       """SELECT item_key, n_containers, n_elements, support, round(support * n_elements, 3) AS sel_score
          FROM (SELECT *, n_containers / (SELECT count(*) FROM containers) * 100 AS support FROM vocab)
          WHERE support >= 1 AND n_elements >= 2 ORDER BY sel_score DESC, item_key LIMIT 25""")
def _(t):
    return voc.top_items(t.vocab, t.n_containers)


@query("voc24_rule_candidates", "item_key:s n_containers:l n_elements:l cover:d",
       """WITH ok AS (SELECT * FROM vocab JOIN kept USING (item_key) WHERE above_min_sup),
          cand AS (SELECT *, n_containers / (SELECT count(*) FROM containers) * 100 AS cover FROM ok
             WHERE n_elements >= CASE WHEN (SELECT max(n_elements) FROM ok) >= 2 THEN 2 ELSE 1 END)
          SELECT item_key, n_containers, n_elements, cover FROM cand WHERE cover >=
            (SELECT CASE WHEN max(cover) >= 3 THEN 3 ELSE greatest(1.0, max(cover)) END FROM cand)
          ORDER BY cover DESC, item_key LIMIT 20""")
def _(t):
    return voc.rule_candidates(t.vocab, t.kept, t.n_containers, min_cover=3.0)


@query("voc25_pool_rare", "pooled_key:s n_elements:l n_keys:l",
       """WITH c AS (SELECT item_key, count(*) AS n FROM incidence GROUP BY 1)
          SELECT CASE WHEN n < 0.03 * (SELECT count(*) FROM containers) AND kind IN ('SMALL', 'PROMO')
              THEN kind || ':pooled' ELSE item_key END AS pooled_key, count(*) AS n_elements,
            count(DISTINCT item_key) AS n_keys FROM lines JOIN c USING (item_key) GROUP BY 1""")
def _(t):
    kind = F.substring_index("item_key", "|", -1)
    m = voc.pool_rare(t.lines, t.n_containers, 0.03, kind.isin("SMALL", "PROMO"), F.concat(kind, F.lit(":pooled")))
    per = m.groupBy("pooled_key", "item_key").agg(F.count("*").alias("n"))
    return per.groupBy("pooled_key").agg(F.sum("n").alias("n_elements"), F.count("*").alias("n_keys"))


@query("voc26_fold_keys", "item_key:s new_key:s",
       """WITH s AS (SELECT item_key, split_part(item_key, '|', 1) AS skeleton, count(*) AS n FROM parts GROUP BY ALL),
          b AS (SELECT skeleton, item_key AS best_key FROM s WHERE item_key NOT LIKE '%|SMALL'
            QUALIFY row_number() OVER (PARTITION BY skeleton ORDER BY n DESC, item_key DESC) = 1)
          SELECT item_key, CASE WHEN item_key LIKE '%|SMALL' THEN coalesce(best_key, item_key) ELSE item_key END AS new_key
          FROM s LEFT JOIN b USING (skeleton)""")
def _(t):
    s = t.parts.groupBy("item_key", F.substring_index("item_key", "|", 1).alias("skeleton")).agg(F.count("*").alias("n"))
    return voc.fold_keys(s, F.col("item_key").endswith("|SMALL"))


@query("voc27_strip_prefix", "bare_key:s n_keys:l",
       """SELECT regexp_replace(item_key, '^Brand#[0-9]+\\|', '') AS bare_key, count(DISTINCT item_key) AS n_keys
          FROM vocab GROUP BY 1""")
def _(t):
    return voc.strip_prefix(t.lines, r"^Brand#[0-9]+\|")


@query("voc28_raw_stats", "item_key:s n:l weighted:l wt0:l wt1:l",
       """SELECT item_key, n_containers AS n, coalesce(nullif(wt, 0), n_occurrences) AS weighted,
            coalesce(wt0, 0) AS wt0, coalesce(wt1, 0) AS wt1 FROM vocab""")
def _(t):
    return voc.raw_stats(t.vocab.withColumn("wt", F.nullif("wt", F.lit(0))))


@query("voc29_item_lists", "container_id:l items:s",
       "SELECT container_id, string_agg(item_key, ',' ORDER BY item_key) AS items FROM incidence GROUP BY 1")
def _(t):
    return voc.item_lists(t.lines).withColumn("items", F.array_join("items", ","))


@query("voc30_spread_lookup", "container_id:l element_id:l item_id:l",
       """WITH m AS (SELECT container_id, element_id, CASE WHEN flag <> 'R' THEN item_id END AS id FROM lookup),
          near AS (SELECT a.container_id, a.element_id, b.id,
              row_number() OVER (PARTITION BY a.container_id, a.element_id
                ORDER BY abs(a.element_id - b.element_id), b.element_id) AS r
            FROM m a JOIN m b ON a.container_id = b.container_id WHERE a.id IS NULL AND b.id IS NOT NULL)
          SELECT m.container_id, m.element_id, coalesce(m.id, near.id, -1) AS item_id FROM m
            LEFT JOIN near ON m.container_id = near.container_id AND m.element_id = near.element_id AND r = 1""")
def _(t):
    # lines returned as 'R' have no index entry and take the item of the nearest mapped neighbour
    lookup = cut_lineage(t.lookup.select("container_id", "element_id", "item_id", "flag"))  # read for all three inputs
    direct = lookup.where("flag <> 'R'").select("container_id", "element_id", "item_id")
    return voc.spread_lookup(lookup, direct, chain_edges(lookup))


@query("voc31_direct_lookup", "container_id:l element_id:l item_id:l",
       "SELECT container_id, element_id, item_id FROM lookup")
def _(t):
    return voc.direct_lookup(t.elements.select("container_id", "element_id"), t.lookup)


@query("voc32_refresh_membership", "item_id:l n_elements:l n_containers:l",
       """WITH b AS (SELECT brand, count(DISTINCT container_id) AS n FROM lines GROUP BY 1),
          i AS (SELECT brand, CASE WHEN n >= 0.12 * (SELECT count(*) FROM containers)
             THEN row_number() OVER (ORDER BY n DESC, brand) - 1 ELSE -1 END AS item_id FROM b)
          SELECT item_id, count(*) AS n_elements, count(DISTINCT container_id) AS n_containers
          FROM lines JOIN i USING (brand) GROUP BY 1""")
def _(t):
    # the same containers under the brand vocabulary instead of brand|type
    b = t.brand_incidence.groupBy("item_key").agg(F.count("*").alias("n_containers"))
    kept = b.where(F.col("n_containers") >= 0.12 * t.n_containers)
    lines = t.lines.withColumn("item_key", F.col("brand"))
    fresh = voc.build_lookup(lines, voc.assign_ids(b), kept)
    per = fresh.groupBy("item_id", "container_id").agg(F.count("*").alias("n"))
    return per.groupBy("item_id").agg(F.sum("n").alias("n_elements"), F.count("*").alias("n_containers"))


@query("voc33_support_floor", "s_min:l",
       f"""SELECT greatest(1, CAST(floor(CAST({PCT} AS DOUBLE) * count(*)) AS BIGINT)) AS s_min
           FROM containers WHERE split <> 'test'""")
def _(t):
    return voc.support_floor(t.containers, PCT)
