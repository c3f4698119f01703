"""Canonical tables over the driver's Parquet files, in Spark and in SQL.

container = order (or document, user, conversation), element = line of an order,
item = brand|type of the part, part = lines of one order that share item and return flag.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidex import skew
from incidex.operators import vocab as voc
from incidex.session import cut_lineage

PCT = 0.026  # support cutoff used by the bound queries
SEED = "42"


def hash_digit(key, seed: str, start: int, modulus: int):
    """Reproducible pseudo-random digit of a key: md5(seed|key), 4 hex digits from ``start``."""
    digest = F.md5(F.concat(F.lit(seed + "|"), key.cast("string")))
    return F.conv(F.substring(digest, start, 4), 16, 10).cast("int") % modulus


def hash_digit_sql(key: str, seed: str, start: int, modulus: int) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|' || {key}), {start}, 4) AS INTEGER) % {modulus})"


def _split_name(h):
    return F.when(h < 8, "training").when(h == 8, "valid").otherwise("test")


def _split_name_sql(h: str) -> str:
    return f"CASE WHEN {h} < 8 THEN 'training' WHEN {h} = 8 THEN 'valid' ELSE 'test' END"


def kept_sql(pct) -> str:
    """Cutoff test on columns wt, wt0, wt1 (item) and n, n0, n1 (containers)."""
    cut = lambda c: f"CAST(floor(CAST({pct} AS DOUBLE) * {c}) AS BIGINT)"
    return (
        f"(wt >= {cut('n')} OR (n0 / greatest(n, 1) >= 0.6 AND wt1 >= {cut('n1')}) "
        f"OR (n0 / greatest(n, 1) < 0.6 AND n1 / greatest(n, 1) >= 0.6 AND wt0 >= {cut('n0')}))"
    )


def chain_edges(elements: DataFrame) -> DataFrame:
    """Neighbouring elements of a container, in both directions."""
    e = elements.where("element_id >= 2").select("container_id", "element_id")
    prev = F.col("element_id") - 1
    pair = F.array(
        F.struct(prev.alias("src"), F.col("element_id").alias("dst")),
        F.struct(F.col("element_id").alias("src"), prev.alias("dst")),
    )
    return e.select("container_id", F.explode(pair).alias("p")).select("container_id", "p.src", "p.dst")


class Tables:
    """Lazy canonical DataFrames for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def containers(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("container_id"),
            (F.col("o_orderstatus") == "F").cast("int").alias("label"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("label2"),
            F.col("o_totalprice").alias("price"),
            F.col("o_custkey").alias("custkey"),
            F.col("o_orderdate").alias("orderdate"),
            _split_name(hash_digit(F.col("o_orderkey"), SEED, 1, 10)).alias("split"),
        )

    @cached_property
    def fold_splits(self) -> DataFrame:
        """Five folds, each with its own split of all containers."""
        c = self.containers.select("container_id", "label")
        folds = F.explode(F.array(*[F.lit(f) for f in range(5)])).alias("fold")
        key = F.concat(F.col("fold").cast("string"), F.lit("|"), F.col("container_id").cast("string"))
        return c.select("container_id", "label", folds).withColumn(
            "split", _split_name(hash_digit(key, SEED, 5, 10))
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Element rows without a number (nothing that needs a window)."""
        li, p = self.raw("lineitem"), self.raw("part")
        item = F.concat_ws("|", "p_brand", "p_type")
        return li.join(p, li.l_partkey == p.p_partkey).select(
            F.col("l_orderkey").alias("container_id"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("kind"),
            item.alias("item_key"),
            F.concat(item, F.lit("#"), F.col("l_returnflag")).alias("part_id"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_extendedprice").alias("score_a"),
            F.col("l_quantity").alias("score_b"),
            F.col("l_discount").alias("score_c"),
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_shipdate",
        )

    @cached_property
    def elements(self) -> DataFrame:
        """Lines numbered 1..n inside their container."""
        order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "score_a", "l_shipdate")]
        sizes = self.raw("lineitem").select(F.col("l_orderkey").alias("container_id"))
        return skew.number_rows(self.lines, ["container_id"], order, "element_id", sizes=sizes)

    @cached_property
    def parts(self) -> DataFrame:
        return self.lines.groupBy("container_id", "item_key", "part_id").agg(
            F.count("*").alias("n_elements")
        )

    @cached_property
    def vocab(self) -> DataFrame:
        """Item supports, stored once: one row per item."""
        return cut_lineage(voc.build_vocab(self.parts, self.containers))

    @cached_property
    def vocab_ids(self) -> DataFrame:
        return voc.assign_ids(self.vocab)

    @cached_property
    def kept(self) -> DataFrame:
        return voc.threshold_items(self.vocab, self.containers, PCT)

    @cached_property
    def lookup(self) -> DataFrame:
        """Elements with item_id, -1 below the cutoff."""
        return voc.build_lookup(self.elements, self.vocab_ids, self.kept)

    @property
    def n_containers(self):
        return self.containers.agg(F.count("*")).scalar()

    @cached_property
    def incidence(self) -> DataFrame:
        return self.lines.select("container_id", "item_key").distinct()

    @cached_property
    def brand_incidence(self) -> DataFrame:
        """Stored once: supports, fired clauses and pair counts all read it."""
        return cut_lineage(self.lines.select("container_id", F.col("brand").alias("item_key")).distinct())

    @cached_property
    def brand_vocab(self) -> DataFrame:
        """Brands numbered from 1 by falling container support (there are at most a few dozen)."""
        counts = self.brand_incidence.groupBy("item_key").agg(F.count("*").alias("n_containers"))
        return cut_lineage(voc.assign_ids(counts).withColumn("rank", F.col("item_id") + 1))

    @cached_property
    def brand_names(self) -> list[str]:
        """The bounded item list of the rule queries: every brand, best supported first."""
        return [r["item_key"] for r in self.brand_vocab.orderBy("rank").collect()]

    @cached_property
    def rules(self) -> DataFrame:
        """Six rules over brands chosen by support rank: (rule_id, clause_id, item_key)."""
        k, r = F.col("rule_id"), F.col("rank")
        clause = (
            F.when((r == k) | (r == k + 6), 0)
            .when(r == k + 12, 1)
            .when((k % 2 == 0) & ((r == k + 3) | (r == k + 15)), 2)
        )
        return (
            self.brand_vocab.select("item_key", "rank", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rule_id"))
            .select("rule_id", clause.alias("clause_id"), "item_key")
            .where("clause_id IS NOT NULL")
        )

    @cached_property
    def brand_elements(self) -> DataFrame:
        """Numbered elements with the brand as item, stored once for the element-level queries."""
        e = self.elements.select("container_id", "element_id", F.col("brand").alias("item_key"), "flag", "score_a", "score_b")
        return cut_lineage(e)

    @cached_property
    def spurious(self) -> DataFrame:
        """Two competitors per rule: the brands ranked 20 and 21 places from the top."""
        r = F.col("rank")
        return (
            self.brand_vocab.select("item_key", "rank", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rule_id"))
            .where((r == 20) | (r == 22))
            .select("rule_id", F.when(r == 20, 0).otherwise(1).alias("ordinal"), "item_key")
        )

    @cached_property
    def family(self) -> DataFrame:
        return self.brand_vocab.where("rank = 24").select(
            F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rule_id"), "item_key"
        )

    @cached_property
    def truth(self) -> DataFrame:
        from incidex.operators import rules as rl

        return cut_lineage(rl.annotate(self.brand_elements, self.rules, self.spurious, self.family))

    @cached_property
    def edges(self) -> DataFrame:
        return chain_edges(self.elements)

    @cached_property
    def predictions(self) -> DataFrame:
        """Order value, and order value without one brand: inputs of leave-one-out impact."""
        value = F.col("score_a") * (1 - F.col("score_c"))
        per = self.lines.groupBy("container_id", F.col("brand").alias("item_key")).agg(
            F.sum(value).alias("v")
        )
        full = per.groupBy("container_id").agg(F.sum("v").alias("p_full"))
        return per.join(full, "container_id").select(
            "container_id", "item_key", "p_full", (F.col("p_full") - F.col("v")).alias("p_without")
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Measured cells: (dataset, backbone, family, fold) out of nation, segment, priority, year."""
        o, c, n = self.raw("orders"), self.raw("customer"), self.raw("nation")
        cell = (
            o.join(c, o.o_custkey == c.c_custkey)
            .groupBy(
                "c_nationkey",
                F.col("c_mktsegment").alias("backbone"),
                F.col("o_orderpriority").alias("family"),
                (F.year("o_orderdate") % 5).alias("fold"),
            )
            .agg(
                F.count("*").alias("n_rows"),
                F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("auc"),
                (F.avg("o_totalprice") / 103700).alias("mae"),
                (F.avg("c_acctbal") / 10130).alias("pearson_mean"),
                (F.avg(F.col("o_totalprice") % 1000) / 1017.3).alias("pearson_max"),
                (F.avg(F.col("o_totalprice") % 100) / 101.7).alias("gt_roc"),
            )
        )
        names = n.select("n_nationkey", F.col("n_name").alias("dataset"))
        return cell.join(names, cell.c_nationkey == names.n_nationkey).drop("n_nationkey", "c_nationkey")

    @cached_property
    def run_fields(self) -> DataFrame:
        """Runs with the recorded fields of a run summary (variant, tier, flags, directory)."""
        n, fam = F.col("n_rows"), F.lower(F.substring("family", 3, 20))
        fam = F.regexp_replace(fam, " ", "_")
        variant = F.concat(
            F.lit("v"),
            F.substring("family", 1, 1),
            F.when(n % 2 == 1, "_filter").otherwise(""),
            F.when(n % 3 == 0, F.when(n % 2 == 0, "_relabelled_easy").otherwise("_relabelled")).otherwise(""),
        )
        tier = F.when(n % 4 == 0, "easy").when(n % 4 == 1, "dnf_k2_r1").when(n % 4 == 2, "odd")
        return self.runs.select(
            "dataset", "backbone", "fold", "n_rows", "auc", "mae", "pearson_mean", "pearson_max", "gt_roc",
            fam.alias("family"),
            variant.alias("vocab_variant"),
            tier.alias("gt_tier"),
            F.when(n % 3 == 0, "true").when(n % 3 == 1, "no").otherwise("1").alias("use_gt"),
            (n % 2 == 0).alias("w_feat"),
            (n % 3 == 0).alias("w_message"),
            F.lit(None).cast("boolean").alias("w_readout"),
            F.concat_ws("/", F.lit("runs"), fam, F.col("dataset"), F.concat(F.lit("fold"), F.col("fold").cast("string")), variant,
                        F.concat(F.lit("bb-"), F.col("backbone"), F.lit("_enc-onehot"))).alias("exp_dir"),
        )

    @cached_property
    def tokens(self) -> DataFrame:
        """Lower-case letter runs of whole documents: (doc_id, pos, token)."""
        words = F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "")
        return self.raw("documents").select("doc_id", F.posexplode(words).alias("pos", "token"))


SHARED_SQL: dict[str, str] = {
    "containers": f"""SELECT o_orderkey AS container_id, CAST(o_orderstatus = 'F' AS INT) AS label,
        CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT) AS label2, o_totalprice AS price,
        o_custkey AS custkey, o_orderdate AS orderdate,
        {_split_name_sql(hash_digit_sql('o_orderkey', SEED, 1, 10))} AS split FROM orders""",
    "fold_splits": f"""SELECT container_id, label, fold,
        {_split_name_sql(hash_digit_sql("fold || '|' || container_id", SEED, 5, 10))} AS split
        FROM containers, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f""",
    "lines": """SELECT l_orderkey AS container_id, p_brand AS brand, p_type AS kind,
        p_brand || '|' || p_type AS item_key, p_brand || '|' || p_type || '#' || l_returnflag AS part_id,
        l_returnflag AS flag, l_extendedprice AS score_a, l_quantity AS score_b, l_discount AS score_c,
        l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "elements": """SELECT *, row_number() OVER (PARTITION BY container_id
        ORDER BY l_linenumber, l_partkey, l_suppkey, score_a, l_shipdate) AS element_id FROM lines""",
    "parts": """SELECT container_id, item_key, part_id, count(*) AS n_elements FROM lines GROUP BY ALL""",
    "tv_counts": """SELECT count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label <> 0) AS n1
        FROM containers WHERE split IN ('training', 'valid')""",
    "vocab": """SELECT item_key, count(*) AS n_containers, count(*) FILTER (label = 1) AS n_pos,
        count(*) FILTER (label <> 1) AS n_neg, sum(n_parts) AS n_occurrences,
        sum(CASE WHEN split <> 'test' THEN n_parts ELSE 0 END) AS wt,
        sum(CASE WHEN split <> 'test' AND label = 0 THEN n_parts ELSE 0 END) AS wt0,
        sum(CASE WHEN split <> 'test' AND label <> 0 THEN n_parts ELSE 0 END) AS wt1,
        max(n_elements) AS n_elements,
        count(*) / (SELECT count(*) FROM containers) >= 0.01 AS above_min_sup
        FROM (SELECT container_id, item_key, count(*) AS n_parts, max(n_elements) AS n_elements FROM parts GROUP BY ALL)
        JOIN containers USING (container_id) GROUP BY item_key""",
    "vocab_ids": "SELECT *, row_number() OVER (ORDER BY n_containers DESC, item_key) - 1 AS item_id FROM vocab",
    "kept": f"SELECT item_key FROM vocab, tv_counts WHERE {kept_sql(PCT)}",
    "lookup": """SELECT e.*, CASE WHEN k.item_key IS NULL THEN -1 ELSE item_id END AS item_id FROM elements e
        JOIN vocab_ids USING (item_key) LEFT JOIN kept k USING (item_key)""",
    "incidence": "SELECT DISTINCT container_id, item_key FROM lines",
    "brand_incidence": "SELECT DISTINCT container_id, brand AS item_key FROM lines",
    "brand_vocab": """SELECT item_key, count(*) AS n_containers,
        row_number() OVER (ORDER BY count(*) DESC, item_key) AS rank FROM brand_incidence GROUP BY 1""",
    "rules": """SELECT * FROM (SELECT rule_id, CASE WHEN rank IN (rule_id, rule_id + 6) THEN 0
          WHEN rank = rule_id + 12 THEN 1
          WHEN rule_id % 2 = 0 AND rank IN (rule_id + 3, rule_id + 15) THEN 2 END AS clause_id, item_key
        FROM brand_vocab, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS rule_id)) WHERE clause_id IS NOT NULL""",
    "fired_clauses": """SELECT rule_id, clause_id, container_id FROM brand_incidence JOIN rules USING (item_key)
        JOIN (SELECT rule_id, clause_id, count(*) AS need FROM rules GROUP BY ALL) USING (rule_id, clause_id)
        GROUP BY ALL HAVING count(*) = max(need)""",
    "fired": "SELECT DISTINCT rule_id, container_id FROM fired_clauses",
    "labelled": """SELECT r.rule_id, c.container_id, label, CASE WHEN f.rule_id IS NULL THEN 0 ELSE 1 END AS synth
        FROM containers c, (SELECT DISTINCT rule_id FROM rules) r
        LEFT JOIN fired f ON f.rule_id = r.rule_id AND f.container_id = c.container_id""",
    "truth": """SELECT m.rule_id, e.container_id, e.element_id, m.kind, m.ordinal, e.brand AS item_key FROM elements e JOIN (
        SELECT rule_id, container_id, item_key, 'clause' AS kind, clause_id AS ordinal
          FROM fired_clauses JOIN rules USING (rule_id, clause_id)
        UNION ALL SELECT DISTINCT rule_id, container_id, item_key, 'node', 0
          FROM fired_clauses JOIN rules USING (rule_id, clause_id)
        UNION ALL SELECT rule_id, container_id, item_key, 'spurious', CASE WHEN rank = 20 THEN 0 ELSE 1 END
          FROM fired, brand_vocab WHERE rank IN (20, 22)
        UNION ALL SELECT rule_id, container_id, item_key, 'family', 0 FROM fired, brand_vocab WHERE rank = 24) m
        ON m.container_id = e.container_id AND m.item_key = e.brand""",
    "cooc": """SELECT a.item_key AS a, b.item_key AS b, count(*) AS inter, any_value(va.n_containers) AS n_a,
        any_value(vb.n_containers) AS n_b,
        count(*) / (any_value(va.n_containers) + any_value(vb.n_containers) - count(*)) AS jaccard,
        count(*) / any_value(va.n_containers) AS p_b_given_a, count(*) / any_value(vb.n_containers) AS p_a_given_b
        FROM brand_incidence a JOIN brand_incidence b ON a.container_id = b.container_id AND a.item_key <> b.item_key
        JOIN brand_vocab va ON va.item_key = a.item_key JOIN brand_vocab vb ON vb.item_key = b.item_key GROUP BY 1, 2""",
    "edges": """SELECT container_id, element_id - 1 AS src, element_id AS dst FROM elements WHERE element_id >= 2
        UNION ALL SELECT container_id, element_id, element_id - 1 FROM elements WHERE element_id >= 2""",
    "predictions": """SELECT container_id, item_key, p_full, p_full - v AS p_without FROM
        (SELECT container_id, brand AS item_key, sum(score_a * (1 - score_c)) AS v FROM lines GROUP BY ALL)
        JOIN (SELECT container_id, sum(score_a * (1 - score_c)) AS p_full FROM lines GROUP BY ALL) USING (container_id)""",
    "runs": """SELECT n_name AS dataset, c_mktsegment AS backbone, o_orderpriority AS family,
        year(o_orderdate) % 5 AS fold, count(*) AS n_rows, avg(CAST(o_orderstatus = 'F' AS DOUBLE)) AS auc,
        avg(o_totalprice) / 103700 AS mae, avg(c_acctbal) / 10130 AS pearson_mean,
        avg(o_totalprice % 1000) / 1017.3 AS pearson_max, avg(o_totalprice % 100) / 101.7 AS gt_roc
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
    "run_fields": """SELECT *, 'runs/' || family || '/' || dataset || '/fold' || fold || '/' || vocab_variant || '/bb-' || backbone || '_enc-onehot' AS exp_dir
        FROM (SELECT dataset, backbone, fold, n_rows, auc, mae, pearson_mean, pearson_max, gt_roc,
        replace(lower(substr(family, 3)), ' ', '_') AS family,
        'v' || substr(family, 1, 1) || CASE WHEN n_rows % 2 = 1 THEN '_filter' ELSE '' END
          || CASE WHEN n_rows % 3 <> 0 THEN '' WHEN n_rows % 2 = 0 THEN '_relabelled_easy' ELSE '_relabelled' END AS vocab_variant,
        CASE n_rows % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'dnf_k2_r1' WHEN 2 THEN 'odd' END AS gt_tier,
        CASE n_rows % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'no' ELSE '1' END AS use_gt,
        n_rows % 2 = 0 AS w_feat, n_rows % 3 = 0 AS w_message, CAST(NULL AS BOOLEAN) AS w_readout FROM runs)""",
    "tokens": """SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM
        (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS i FROM
          (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM documents))
        WHERE token <> ''""",
}
