"""Phrases found inside rows, against enumeration and against the joins."""

import random

import pytest

from incidex.operators import learn, phrases


def enumerated(texts, patterns):
    out = []
    for d, w in enumerate(texts):
        inside = {i + j for p in patterns if p for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p for j in range(len(p))}
        lows = [i for i in sorted(inside) if i - 1 not in inside]
        out += [(d, i, next(j for j in range(i, len(w) + 1) if j not in inside) - 1) for i in lows]
    return sorted(out)


def tables(spark):
    rng = random.Random(2)
    texts = [[], ["a"], ["b", "a"], ["b"] * 9, *[[rng.choice("abcdefg") for _ in range(rng.randrange(1, 60))] for _ in range(80)]]
    patterns = [["a"], ["b", "b", "b"], ["c", "d"], ["c", "d", "e"], ["d", "d"], ["f", "x"], ["never"], [], ["g", "c", "g", "c"], ["g", "c", "g"]]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(texts)] + [(99, None)], "doc long, words array<string>").repartition(3)
    return texts, patterns, docs, spark.createDataFrame([(p,) for p in patterns + patterns[:3]], "words array<string>")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("at_a_time, listed", [(7, 10**6), (10**6, 10**6), (10**6, 3)])
def test_runs_of_places_inside_patterns(spark, monkeypatch, at_a_time, listed):
    monkeypatch.setattr(learn, "WORDS", at_a_time)
    monkeypatch.setattr(phrases, "LISTED", listed)
    texts, patterns, docs, table = tables(spark)
    assert rows(phrases.pattern_runs(docs, "doc", "words", table)) == enumerated(texts, patterns) != []


def test_no_patterns(spark):
    _, _, docs, table = tables(spark)
    assert rows(phrases.pattern_runs(docs, "doc", "words", table.where("size(words) = 0"))) == []


@pytest.mark.parametrize("name", ["rul33_pattern_truth", "rul33_pattern_edges"])
def test_places_are_not_shuffled(spark, name):
    from incidex.plans import load_all

    plan = load_all()[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
