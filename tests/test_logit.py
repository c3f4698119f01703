"""Many models at once against single fits."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from incidex.operators import logit, search

NAMES = [f"i{k}" for k in range(6)]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    held = {c: [k for k in range(6) if rng.random() < 0.25 + 0.08 * k] for c in range(900)}
    hits = {c: [t for t, need in enumerate([(0, 1), (2,), (5, 4)]) if any(k in s for k in need) != (rng.random() < 0.2)] for c, s in held.items()}
    inc = spark.createDataFrame([(c, NAMES[k]) for c, s in held.items() for k in s], "container_id long, item_key string")
    containers = spark.createDataFrame([(c, c % 2) for c in held], "container_id long, label int")
    # target 3 is always, target 4 never positive
    positive = spark.createDataFrame([(c, t) for c, h in hits.items() for t in [*h, 3]], "container_id long, target int")
    return inc, containers, positive, logit.examples(inc, containers, positive, NAMES, 3, "0")


def test_rows_are_merged_containers(data):
    inc, containers, positive, rows = data
    got = rows.collect()
    assert sum(r["n"] for r in got) == 900 and len(got) < 900
    assert sum(r["n"] * len(r["hits"]) for r in got) == positive.count()
    assert sum(r["n"] * len(r["basket"]) for r in got) == inc.count()


def test_models_equal_single_fits(data):
    rows = data[3]
    models = [logit.Model(t, frozenset({0, 1, 2}) - {f}, frozenset({f}), frozenset(range(6)) - {5 * (t == 2)}) for t in range(5) for f in range(3)]
    beta = logit.fit(rows, models, 6, 5)
    aucs = logit.held_out_auc(rows, models, beta, 6)
    for m, model in enumerate(models):
        if model.target > 2:
            assert np.isnan(beta[m]).all() and aucs.get(m) is None
            continue
        y = F.array_contains("hits", model.target).cast("int")
        x = array_to_vector(F.array(*[F.array_contains("basket", k).cast("double") for k in sorted(model.items)]))
        table = rows.select("fold", y.alias("y"), x.alias("x"), F.col("n").cast("double").alias("w"))
        one = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=500, tol=1e-14, regParam=1e-4).fit(table.where(F.col("fold").isin(list(model.train))))
        want = [*one.coefficients, one.intercept]
        mine = [*beta[m][sorted(model.items)], beta[m][6]]
        assert all(math.isclose(a, b, abs_tol=2e-5) for a, b in zip(mine, want)), (m, mine, want)
        held = [(r["y"], float(one.intercept + np.dot(one.coefficients, r["x"])), r["w"]) for r in table.where(F.col("fold").isin(list(model.test))).collect()]
        pos, neg = ([(round(p, 4), w) for y, p, w in held if y == side] for side in (1, 0))
        auc = sum(a * b * ((p > q) + 0.5 * (p == q)) for p, a in pos for q, b in neg) / (sum(a for _, a in pos) * sum(b for _, b in neg))
        assert math.isclose(aucs[m], auc, abs_tol=1e-6)


def test_known_answers(spark, data):
    inc, containers, positive, rows = data
    # the item itself is the target: perfect; without it, and without any item, nothing is left to learn
    rule = spark.createDataFrame([(1, 0, "i2"), (2, 0, "i0"), (2, 1, "i1")], "rule_id int, clause_id int, item_key string")
    aucs = search.rule_aucs(inc, containers, rule, NAMES)
    assert aucs == {1: 1.0, 2: 1.0}
    assert search.rule_aucs(inc, containers, rule.where("rule_id = 1"), ["i2"], own_items=False) == {1: 0.5}
    graded = search.grade_rules(inc, containers, rule, NAMES, inc, NAMES).collect()
    assert all(r["composition_auc"] == 1.0 and abs(r["shortcut_auc"] - 0.5) < 0.1 for r in graded)
    # separable data still ends
    assert logit.cross_validated(rows, [frozenset()] * 5, 6, 3) == [0.5] * 5
