"""Correlations over subsets of the same points, ranked once."""

from pyspark.sql import functions as F

from incidex.operators import metrics as mt
from incidex.plans import bindings, load_all


def test_subsets_equal_their_own_runs(spark):
    c = F.col("id")
    pts = spark.range(200).select((c % 23 * 1.5).alias("score"), F.when(c % 41 > 0, c * c % 17 + c / 50.0).alias("impact"), (c % 3 > 0).alias("some"), (c < 0).alias("none"))
    got = mt.subset_correlation(pts, {"all": F.lit(True), "some": F.col("some"), "none": F.col("none")}, "keep").collect()
    assert sorted(r["keep"] for r in got) == ["all", "some"]
    keyed = pts.withColumns({"item_key": F.monotonically_increasing_id(), "container_id": F.lit(1)})
    for r in got:
        own = keyed if r["keep"] == "all" else keyed.where("some")
        (want,) = mt.instance_correlation(own.select("item_key", "container_id", "score"), own.select("item_key", "container_id", "impact")).collect()
        assert r["n_instances"] == want["n_instances"] > 100
        for k in ("pearson_instance", "spearman_instance"):
            assert abs(r[k] - want[k]) < 1e-9


def test_offline_instance_numbers_no_elements(spark, monkeypatch):
    def unwanted(*_):
        raise AssertionError("elements are numbered")

    monkeypatch.setattr(bindings.Tables, "elements", property(unwanted))
    got = load_all()["met10_offline_instance"].run(spark, "/root/testdata/sf0.001").collect()
    assert {r["keep"] for r in got} == {"full", "kept"}
