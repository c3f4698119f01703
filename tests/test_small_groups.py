"""Groups that fit in a row or a task are worked there; larger ones go by ranges or rounds, with the same results."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from incidex import skew
from incidex.operators import graph, learn, metrics, vocab
from incidex.session import scratch_folders


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_numbering_stores_no_rows_of_small_groups(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 7).alias("g"), F.hash("id").alias("x"))
    with scratch_folders() as made:
        few = skew.number_rows(df, ["g"], [F.col("x")], "n")
    assert all(spark.read.parquet(p).count() == 0 for p in made)
    monkeypatch.setattr(skew, "WHOLE", 42)  # six groups have more
    assert rows(few) == rows(skew.number_rows(df, ["g"], [F.col("x")], "n"))
    assert rows(few.where("g = 6"))[0][1] == 1 and few.where("n = 43").count() == 6


def _truth(spark):
    scores = spark.range(400).select(
        (F.col("id") % 50).alias("container_id"), F.col("id").alias("element_id"),
        F.when(F.col("id") % 11 > 0, F.pmod(F.hash("id"), F.lit(9)) / 2).alias("score"),
    )
    kinds = [("node", 0, 3), ("clause", 0, 6), ("clause", 1, 9), ("spurious", 0, 5), ("spurious", 1, 7), ("family", 0, 4)]
    marks = [
        scores.where(F.pmod(F.hash("element_id", F.lit(k), F.lit(o)), F.lit(m)) == 0).select(
            F.explode(F.array(F.lit(1), F.lit(2))).alias("rule_id"), "container_id", "element_id", F.lit(k).alias("kind"), F.lit(o).alias("ordinal")
        ).where((F.col("rule_id") == 1) | (F.col("container_id") % 3 > 0))
        for k, o, m in kinds
    ]
    truth = marks[0]
    for m in marks[1:]:
        truth = truth.unionByName(m)
    return scores, truth.localCheckpoint()


def test_grades_of_small_and_large_containers_agree(spark, monkeypatch):
    scores, truth = _truth(spark)
    with scratch_folders() as made:
        few = rows(metrics.dnf_auc(scores, truth))
    assert len(made) == 1  # the list of large containers; no scores are stored
    run = lambda: [rows(f) for f in (metrics.truth_roc_all(scores, truth), metrics.contrast(scores, truth, "spurious"))]
    whole = run()
    monkeypatch.setattr(metrics, "SMALL", 0)
    ranged = rows(metrics.dnf_auc(scores, truth))
    assert few == ranged and len(few) > 20
    close = lambda a, b: all(x == y or abs(x - y) < 1e-9 for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
    assert all(close(a, b) for a, b in zip(whole, run(), strict=True))


def _paths(spark):
    """Paths of 1 to 40 nodes with ids in mixed order, some of their edges cut, and an edge to a node that is not there."""
    at = spark.range(41 * 40).select((F.col("id") % 41).alias("container_id"), F.floor(F.col("id") / 41).alias("i")).where("i <= container_id")
    name = lambda i: F.pmod(F.col(i) * 17, F.lit(41))
    nodes = at.select("container_id", name("i").alias("element_id"))
    one = at.where("i > 0").withColumn("j", F.col("i") - 1).select("container_id", "i", name("i").alias("src"), name("j").alias("dst"))
    edges = one.select("container_id", "src", "dst").unionByName(one.select("container_id", F.col("src").alias("dst"), F.col("dst").alias("src")))
    edges = edges.unionByName(spark.range(1).select(F.lit(5).alias("container_id"), F.lit(99).alias("src"), F.lit(0).alias("dst")))
    return nodes, edges, one.where("i % 9 = 4").select("container_id", "src", "dst")


def test_components_of_small_groups_take_no_rounds(spark, monkeypatch):
    nodes, edges, cuts = _paths(spark)
    with scratch_folders() as made:
        few = rows(graph.components(nodes, edges, ["container_id"], cuts=cuts))
    assert len(made) == 1 and len(few) == nodes.count()
    monkeypatch.setattr(graph, "SMALL", 60)  # the longer paths go by rounds
    assert few == rows(graph.components(nodes, edges, ["container_id"], cuts=cuts))


def test_lookups_of_small_containers_spread_without_rounds(spark, monkeypatch):
    nodes, edges, _ = _paths(spark)
    direct = nodes.where("element_id % 13 = 2").withColumn("item_id", F.when(F.col("container_id") % 5 > 0, F.col("element_id") % 4 - 1))
    with scratch_folders() as made:
        few = rows(vocab.spread_lookup(nodes, direct, edges))
    assert len(made) == 1 and len(few) == nodes.count()
    monkeypatch.setattr(graph, "SMALL", 60)
    assert few == rows(vocab.spread_lookup(nodes, direct, edges))


def test_equal_trees_are_learned_from_once(spark):
    base = [(n, p, n[0]) for n, p in (("A", None), ("b", "A"), ("c", "A"))]
    other = [("A", None, "A"), ("d", "A", "d")]
    trees = [(i, *x) for i in range(30) for x in (other if i % 3 == 0 else base)]
    nodes = spark.createDataFrame(trees, "tree int, node string, parent string, key string")
    kept, classes = learn.distinct_trees(nodes)
    assert rows(classes) == [(0, 10), (1, 20)] and kept.count() == 5
    named = nodes.select("tree", *[F.concat(c, F.lit(":"), F.col("tree")).alias(c) for c in ("node", "parent")], "key")  # no two are equal
    assert learn.distinct_trees(named)[1].count() == 30
    book = learn.learn_rulebook(nodes)
    assert len(book) == 2 and book == learn.learn_rulebook(named)


def test_cuts_are_counted_without_dealing_positions(spark, monkeypatch):
    words = F.transform(F.sequence(F.lit(1), F.col("id") % 40), lambda i: F.concat(F.lit("w"), F.pmod(F.hash("id", i), F.lit(30))))
    docs = spark.range(0, 300, 1, 3).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 40 > 0, words).otherwise(F.array()).alias("words"))
    values = spark.range(29).select(F.concat(F.lit("w"), "id").alias("token"), (F.col("id") % 9 / 4).alias("v"))  # w29 has none
    monkeypatch.setattr(learn, "CHUNK", 100)
    got = learn.local_max_counts(docs, "doc_id", "words", values)
    whole = docs.select("doc_id", F.posexplode("words").alias("pos", "token")).join(values, "token").select("doc_id", "pos", "v")
    order = Window.partitionBy("doc_id").orderBy("pos")
    near = F.greatest(F.lag("v").over(order), F.lead("v").over(order))
    want = whole.withColumn("near", near).groupBy("doc_id").agg(
        F.count("*").alias("n_edges"), F.count_if(F.col("v") > F.col("near")).alias("n_cuts"), F.count_if(F.isnull("near")).alias("n_null")
    )
    assert rows(got) == rows(want) and got.where("n_null > 0").count() > 0


def test_no_stored_row_holds_more_than_a_record(spark, monkeypatch):
    words = F.transform(F.sequence(F.lit(1), F.col("id") % 40 + 1), lambda i: F.concat(F.lit("w"), F.pmod(F.hash("id", i), F.lit(30))))
    docs = spark.range(0, 400, 1, 2).select(F.col("id").alias("doc_id"), words.alias("words"))
    stored = []
    monkeypatch.setattr(learn, "cut_lineage", lambda df, cut=learn.cut_lineage: stored.append(cut(df)) or stored[-1])
    values = spark.range(30).select(F.concat(F.lit("w"), "id").alias("token"), (F.col("id") % 9 / 4).alias("v"))
    got = learn.local_max_counts(docs, "doc_id", "words", values)
    assert got.count() == 400
    for df in stored:
        for name, kind in df.dtypes:
            held = F.size(name) if kind.startswith("array") else F.length(F.col(name).cast("binary")) / 4 if kind in ("binary", "string") else F.lit(1)
            assert df.agg(F.max(held)).first()[0] <= 40, name
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_entropy_of_counts_in_several_rows(spark):
    docs = spark.createDataFrame([(i, ["a", "b", "a", "c", "a"][: 2 + i % 4]) for i in range(20)], "doc int, words array<string>").repartition(3)
    apart, summed = (learn.context_counts(docs, "words", 1, summed=x) for x in (False, True))
    assert apart.count() > summed.count()
    found = [learn.branching_entropy(df.where("ctx <> ''").selectExpr("key AS a", "ctx AS b", "c")).selectExpr("ctx", "n", "n_partners", "round(entropy, 9)") for df in (apart, summed)]
    assert rows(found[0]) == rows(found[1]) != []
