"""Fast similarity sketches: filled bins, concentration, and classes against brute force."""

import random

import numpy as np
import pytest

from incidex.llm import fastsketch, queries
from test_text import brute_classes


def test_sketches_fill_and_agree_like_the_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(-(2**63), 2**63 - 1, n)) for n in (1, 2, 5, 40, 300, 5000)]
    found = fastsketch.sketches([*sets, np.empty(0, np.int64)])
    assert (found[:-1] != fastsketch._EMPTY).all() and (found[-1] == fastsketch._EMPTY).all()
    assert (fastsketch.sketches(sets[3:4]) == found[3]).all()
    for n in (10, 60, 2000):
        for share in (0.5, 0.8, 0.95):
            off = []
            for _ in range(20):
                both = rng.integers(-(2**63), 2**63 - 1, n)
                cut = int(n * (1 - share) / 2)
                x, y = both[cut:], both[: n - cut]
                a, b = fastsketch.sketches([np.unique(x), np.unique(y)])
                true = (n - 2 * cut) / n
                off.append((a == b).mean() - true)
                # bins agree at a rate of J, within the bound the filter uses
                assert abs(off[-1]) < 6 * np.sqrt(true * (1 - true) / fastsketch.BINS) + 1e-9
            assert abs(np.mean(off)) < 0.02


def test_late_rounds_fill_what_the_first_leave(monkeypatch):
    """With hashes that reach one bin only, the rounds of single bins fill the rest."""
    monkeypatch.setattr(fastsketch, "mix64", lambda x: (np.asarray(x, np.uint64) >> np.uint64(8)) << np.uint64(8))
    found = fastsketch.sketches([np.array([1 << 40, 2 << 40])])
    assert (found != fastsketch._EMPTY).all()


@pytest.mark.parametrize("k,percent", [(4, 80), (2, 60)])
def test_classes_equal_brute_force(spark, docs, rows, empty, k, percent):
    want, links = brute_classes(rows, k, percent)
    got = fastsketch.similar_classes(docs, k, percent).collect()
    assert links > 10 and len(got) == len(rows)
    expected = sorted((str(i), *(want[i, t] if i is not None else (None, None))) for i, t, *_ in rows if i is not None)
    assert sorted((str(r["id"]), r["n_shingles"], r["component_id"]) for r in got if r["id"] is not None) == expected
    assert all(r["component_id"] is None and r["kept"] for r in got if r["id"] is None)
    assert fastsketch.similar_classes(empty, k, percent).count() == 0


def test_query_over_short_and_borderline_texts(spark, tmp_path):
    """Sets of a few shingles and pairs just at the threshold."""
    rng = random.Random(9)
    rows = []
    for g in range(60):
        base = [f"g{g}w{j}" for j in range(rng.choice([3, 4, 7, 8, 9, 12, 23, 33, 63]))]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 3)}"
            rows.append((len(rows) * 3 % 997, " ".join(w[: len(w) - rng.randint(0, 2)])))
    rows += [rows[5], (rows[6][0], "another text under the same id for once"), (999, "AND up"), (1000, "and UP")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_fast_sketch_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want, _ = brute_classes(rows, 4, 80)
    expected = sorted((i, *want[i, t], i == want[i, t][1]) for i, t in rows)
    assert sorted(map(tuple, got.collect())) == expected


def test_many_chunks_pivots_and_crowds(spark, monkeypatch):
    """The same classes when families are dealt to chunks and buckets are linked untested."""
    base, rows = [f"w{i}" for i in range(100)], []
    for d in range(120):
        w = list(base)
        for j in range(d % 9):
            w[(d * 7 + j * 11) % 100] = f"v{d}x{j}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, _ = brute_classes(rows, 3, 80)
    expected = sorted((i, want[i, t][1]) for i, t in rows)
    assert 3 < len({c for _, c in expected}) < 100
    for crowd, pivots, chunk in ((65_536, 64, 900), (65_536, 1, 2_000_000), (4, 64, 700)):
        monkeypatch.setattr(fastsketch, "CROWD", crowd)
        monkeypatch.setattr(fastsketch, "PIVOTS", pivots)
        got = fastsketch.similar_classes(df, 3, 80, chunk=chunk).collect()
        assert sorted((r["id"], r["component_id"]) for r in got) == expected
