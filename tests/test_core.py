"""Known answers and invariants on small fixtures."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from incidex import skew
from incidex.operators import gates, learn, merges, metrics, rules, vocab
from incidex.sinks import writers
from incidex.sources import readers


def test_auc_perfect_and_reversed(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 1, 0.8), ("a", 0, 0.1), ("a", 0, 0.05), ("b", 0, 0.9), ("b", 1, 0.1)], "g string, y int, s double")
    got = {r["g"]: r["auc"] for r in skew.roc_auc(df, ["g"], "y", "s").collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_auc_is_null_for_one_class(spark):
    df = spark.createDataFrame([("a", 1, 0.9)], "g string, y int, s double")
    assert skew.roc_auc(df, ["g"], "y", "s").collect()[0]["auc"] is None


def test_quantiles_are_linear(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 10)], "g string, x double")
    row = skew.quantiles(df, ["g"], "x", {"q": 0.75, "m": 0.5}).collect()[0]
    assert (row["q"], row["m"]) == (4.0, 2.0)


def test_number_rows_and_ranks_match_brute_force(spark):
    values = [((i * 37) % 101) / 7 for i in range(3000)]
    df = spark.createDataFrame([("hot" if i % 3 else f"g{i % 7}", i, v) for i, v in enumerate(values)], "g string, i int, x double")
    rows = skew.average_rank(skew.number_rows(df, ["g"], [F.col("x"), F.col("i")], "n"), ["g"], "x", "r").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["g"], []).append(r)
    for rs in groups.values():
        rs.sort(key=lambda r: (r["x"], r["i"]))
        assert [r["n"] for r in rs] == list(range(1, len(rs) + 1))
        for r in rs:
            below = sum(q["x"] < r["x"] for q in rs)
            same = sum(q["x"] == r["x"] for q in rs)
            assert r["r"] == below + (same + 1) / 2


def test_dnf_instance_beats_global(spark):
    truth = spark.createDataFrame(
        [(1, 1, e, "clause", c) for e, c in ((0, 0), (1, 0), (2, 1), (3, 1))] + [(1, 1, e, "node", 0) for e in range(4)],
        "rule_id int, container_id int, element_id int, kind string, ordinal int")
    scores = spark.createDataFrame([(1, i, s) for i, s in enumerate((0.9, 0.85, 0.10, 0.05, 0.40, 0.30))], "container_id int, element_id int, score double")
    row = metrics.dnf_roc(scores, truth).collect()[0]
    assert (row["instance_auc"], row["global_auc"]) == (1.0, 0.5)


def test_only_fired_clauses_are_truth(spark):
    el = spark.createDataFrame(
        [("A", 0, "benzene"), ("A", 1, "benzene"), ("A", 2, "C=O"), ("A", 3, "Cl"), ("A", 4, "CC")], "container_id string, element_id int, item_key string")
    rl = spark.createDataFrame([(1, 0, "C=O"), (1, 0, "benzene"), (1, 1, "Cl"), (1, 1, "pip")], "rule_id int, clause_id int, item_key string")
    none = spark.createDataFrame([], "rule_id int, ordinal int, item_key string")
    got = rules.annotate(el, rl, none, none.drop("ordinal")).where("kind = 'node'").collect()
    assert sorted(r["element_id"] for r in got) == [0, 1, 2]


def test_fold_cutoff_keeps_all(spark):
    c = spark.createDataFrame([(1, 1, "training"), (2, 1, "valid"), (3, 0, "training")], "container_id int, label int, split string")
    p = spark.createDataFrame([(1, "C", "p", 1), (1, "N", "q", 1), (2, "C", "p", 1), (2, "N", "q", 1), (3, "O", "r", 1)], "container_id int, item_key string, part_id string, n_elements int")
    kept = vocab.threshold_items(vocab.build_vocab(p, c), c, 0.5).collect()
    assert {r["item_key"] for r in kept} == {"C", "N", "O"}


def test_gates_raise(spark):
    df = spark.createDataFrame([(1, "a*b")], "id int, t string")
    with pytest.raises(Exception, match="wildcard"):
        gates.assert_no_wildcard(df, "t", "id").collect()
    with pytest.raises(ValueError):
        gates.assert_task({"d": "Regression"}, "d")
    with pytest.raises(ValueError):
        gates.require_column(df, "absent")


def test_greedy_cover_is_a_partition(spark):
    b = spark.createDataFrame([(["a", "b", "c", "d"], 2), (["b", "c"], 1)], "items array<string>, n long")
    for r in learn.greedy_cover(b, [["a", "b"], ["b", "c"], ["c", "d"]]).collect():
        flat = sorted(x for code in r["used"] for x in code)
        assert flat == sorted(r["items"])


def test_ranks_with_one_frequent_value(spark):
    """One value on nine rows of ten, in every group."""
    values = [0.0 if i % 10 else float(i) for i in range(4000)]
    df = spark.createDataFrame([(f"g{i % 3}", i, v) for i, v in enumerate(values)] + [("g0", -1, None)], "g string, i int, x double")
    got = skew.average_rank(df, ["g"], "x", "r").collect()
    assert len(got) == 4001 and [r["r"] for r in got if r["x"] is None] == [None]
    for g in ("g0", "g1", "g2"):
        xs = sorted(r["x"] for r in got if r["g"] == g and r["x"] is not None)
        n = xs.count(0.0)
        assert {r["r"] for r in got if r["g"] == g and r["x"] == 0.0} == {(n + 1) / 2}
        assert {r["r"] for r in got if r["g"] == g and r["x"] == xs[-1]} == {float(len(xs))}


def test_ranges_cut_few_groups(spark):
    """Groups stay together but for the ends of ranges, and a large group is spread over several."""
    df = spark.range(20_000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2000)).alias("g"), F.hash("id").alias("x"))
    parts = skew.in_ranges(df, [F.col("g"), F.col("x")])
    per = parts.groupBy("g", skew._RANGE).count()
    assert per.count() <= df.select("g").distinct().count() + 4
    assert per.where("g = 7").count() > 1
    got = skew.number_rows(df, ["g"], [F.col("x")], "r").groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("r").alias("d"), F.max("r").alias("m"))
    assert got.where("n <> d OR n <> m").count() == 0


def test_more_gates_raise(spark):
    blank = spark.createDataFrame([(1, "x"), (2, "nan")], "id int, t string")
    with pytest.raises(Exception, match="empty text in row 2"):
        gates.assert_text(blank, "t", "id").collect()
    with pytest.raises(ValueError, match="blank"):
        gates.require_column(blank, "t")
    assert gates.require_column(spark.createDataFrame([("none",)], "t string"), "t").count() == 1
    lookup = spark.createDataFrame([(1, 0, 5), (1, 1, -1)], "container_id int, element_id int, item_id int")
    sizes = spark.createDataFrame([(1, 2)], "container_id int, n_elements long")
    with pytest.raises(Exception, match="unknown element"):
        gates.validate_membership(lookup, sizes, filtered=False).collect()
    members = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "node long, container_id string")
    with pytest.raises(Exception, match="edge spans containers"):
        readers.local_edges(spark.createDataFrame([(1, 2)], "src long, dst long"), members).collect()


def test_shoulder_stops_at_single_pairs(spark):
    """Pairs seen once are not merged, and a curve of two steps is kept whole."""
    seq = merges.pack_sequences(spark.createDataFrame([(list("abxy"),), (list("abzw"),), (list("abc"),)], "tokens array<string>"))
    assert merges.merge_to_knee(seq) == [("a", "b", 3)]
    two = spark.createDataFrame([(0, 100), (1, 3)], "step long, c long")
    assert learn.knee(two).collect()[0]["n_keep"] == 2


def test_rulebook_takes_every_rule_that_does_not_cost(spark):
    rows = [(t, "r", None, "root") for t in range(8)] + [(t, k, "r", k) for t in range(8) for k in ("longname", "othername")]
    nodes = spark.createDataFrame(rows, "tree long, node string, parent string, key string")
    book = learn.learn_rulebook(nodes)
    assert [b[:2] for b in book] == [("root", "longname␟othername")] and book[0][2] <= 0
    frozen = spark.createDataFrame([b[:2] for b in book], "key string, kids string")
    assert {r["key"] for r in learn.apply_rulebook(nodes, frozen).collect()} == {"root"}


def test_krimp_takes_the_frequent_pair(spark):
    """Codes that always occur together are taken; the model never grows."""
    b = spark.createDataFrame([(["a", "b"], 40), (["a", "b", "c"], 20), (["c"], 10)], "items array<string>, n long")
    codes, curve = learn.krimp(b, [(["a", "b"], 60), (["b", "c"], 20)])
    assert ["a", "b"] in codes and curve == sorted(curve, reverse=True)


def test_harvest_counts_files(spark, tmp_path):
    """found = harvested + skipped, in files; archived folders do not count; indented JSON is read."""
    for name, text in (("a", '{\n  "dataset": "d1",\n  "auc": 0.5\n}'), ("b", '{"dataset": "d2"}'), ("c", "{broken"), ("_archive_x/d", '{"dataset": "d1"}')):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "summary.json").write_text(text)
    (tmp_path / "a" / "other.json").write_text("[]")
    row = readers.harvest(spark, str(tmp_path), schema="dataset string, auc double").collect()[0]
    assert (row["found"], row["harvested"], row["skipped"]) == (3, 2, 1)
    runs = readers.scan_runs(spark, str(tmp_path), schema="dataset string, auc double").collect()
    assert sorted((r["path"], r["dataset"]) for r in runs) == [("a/summary.json", "d1"), ("b/summary.json", "d2")]
    assert [r["path"] for r in readers.scan_runs(spark, str(tmp_path), datasets=["a", "d2"], schema="dataset string, auc double").select("path").orderBy("path").collect()] == ["a/summary.json", "b/summary.json"]


def test_scalars_keep_their_header(spark, tmp_path):
    path = str(tmp_path / "log")
    writers.log_scalars(spark.createDataFrame([(1, 0.5)], "epoch int, loss double"), path, ["epoch", "loss", "auc"])
    writers.log_scalars(spark.createDataFrame([(1, 0.7)], "epoch int, auc double"), path, ["epoch", "loss", "auc"])
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == [(1.0, 0.5, None), (1.0, None, 0.7)]
    with pytest.raises(ValueError, match="outside"):
        writers.log_scalars(spark.createDataFrame([(1,)], "other int"), path, ["epoch"])


def test_legacy_splits_are_marked(spark):
    s = spark.createDataFrame([(1, "training"), (1, "test"), (2, "valid")], "container_id int, split string")
    assert {(r["container_id"], r["overlaps"]) for r in writers.load_splits(s).collect()} == {(1, True), (2, False)}
    with pytest.raises(Exception, match="several splits"):
        writers.load_splits(s, strict=True).collect()


def test_workers_need_no_package(tmp_path):
    """A query with worker code runs from another folder, with the package on the driver's path only."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r}); from incidex.session import local_session; from incidex.plans import load_all; "
        "print('rows', load_all()['rul2_pairwise'].run(local_session('x', 2, 2), '/root/testdata/sf0.001').count())"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows" in out.stdout, out.stderr[-1500:]


def test_graded_rules_are_all_rules(spark):
    from incidex.plans import load_all

    for name in ("rul26_shortcut_report", "rul27_cross_validated_auc", "rul28_grade_rules"):
        got = load_all()[name].run(spark, "/root/testdata/sf0.001").collect()
        assert {r["rule_id"] for r in got} == {1, 2, 3, 4, 5, 6}, name


def test_rule_search_takes_the_whole_lists(spark, monkeypatch):
    from unittest.mock import MagicMock

    from incidex.operators import search
    from incidex.plans import load_all, rules as plans

    asked = {}
    monkeypatch.setattr(search, "best_rule", lambda *_, **options: asked.update(options))
    monkeypatch.setattr(search, "sample_rules", lambda *_, **options: asked.update(options))
    monkeypatch.setattr(plans, "_itemsets", lambda t: (MagicMock(), 100))
    monkeypatch.setattr(plans, "_min_count", lambda n: 1)
    for name in ("rul10_best_rule", "rul19_sample_rules"):
        load_all()[name].build(MagicMock())
    assert (asked["top_k"], asked["max_clauses"], asked["max_tries"]) == (30, 4, 200_000)
