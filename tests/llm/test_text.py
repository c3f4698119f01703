"""Line dedup, Jaccard join, decontamination and quality rules against brute force."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from incidex.llm import bm25, decisionlist, jaccard, linededup

LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile("[^\x20\x09-\x0d]+")


def test_line_dedup(spark, rows, docs, empty):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = collections.defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    holders[key(line)].add(i)
    want = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        want.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = [(str(r["id"]), r["kept"], r["n_lines"], r["n_dropped"]) for r in linededup.line_dedup(docs).collect()]
    assert sorted(got) == sorted(want)
    assert sum(x[3] for x in want) > 5
    assert linededup.line_dedup(empty).count() == 0


def brute_classes(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            w = WORD.findall((t or "").translate(LOWER))
            sets[i, t] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {x: x for x in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y])
            if x != y and both and 100 * both >= percent * len(sets[x] | sets[y]):
                links += 1
                up[root(x)] = root(y)
    least = {}
    for x in sets:
        least[root(x)] = min(x[0], least.get(root(x), x[0]))
    return {x: (len(s), least[root(x)] if s else x[0]) for x, s in sets.items()}, links


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard(spark, rows, docs, empty, k, percent):
    want, links = brute_classes(rows, k, percent)
    got = jaccard.similar_classes(docs, k, percent).collect()
    assert links > 10
    assert len(got) == len(rows)
    expected = sorted((str(i), *(want[i, t] if i is not None else (None, None))) for i, t, *_ in rows if i is not None)
    assert sorted((str(r["id"]), r["n_shingles"], r["component_id"]) for r in got if r["id"] is not None) == expected
    assert all(r["component_id"] is None for r in got if r["id"] is None)
    if k == 5:
        assert jaccard.similar_classes(empty, k, percent).count() == 0


def test_jaccard_in_many_chunks(spark, monkeypatch):
    """The same classes when groups are cut up and rows are asked by many queries."""
    monkeypatch.setattr(jaccard, "CHUNK", 400)
    monkeypatch.setattr(jaccard, "QUERIES", 300)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for d in range(80):
        w = list(base)
        for j in range(d % 9):
            w[(d * 7 + j * 11) % 100] = f"v{d}x{j}"
        rows.append((d, " ".join(w)))
    want, _ = brute_classes(rows, 3, 80)
    got = jaccard.similar_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 80).collect()
    assert sorted((r["id"], r["component_id"]) for r in got) == sorted((i, want[i, t][1]) for i, t in rows)


def test_one_of_each(docs, rows):
    want, _ = brute_classes(rows, 5, 80)
    keep = sorted({i for (i, t), (_, c) in want.items() if c == i})
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == keep
    assert ids.count(None) == 2


def test_repeated_ids_keep_every_class(spark):
    """An unrelated text under a repeated id is nobody's copy and stays; names of the operator's own columns may occur."""
    other = "totally other words that nobody else has written down here today"
    rows = [(1, "a b c d e f g h"), (1, other), (2, "a b c d e f g h"), (3, ""), (3, None), (4, other + " at"), (1, other)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: jaccard.F.lit(7) for c in ("_keep", "_rank", "id", "sid", "th", "cls", "key", "_c0_9")})
    got = jaccard.one_of_each(df, k=5, percent=80)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == [(1, "a b c d e f g h"), (1, other), (3, "")]


def test_columns_send_forests(spark, monkeypatch):
    """Few comparisons and small columns only make families larger; links stay those of all pairs."""
    import numpy as np

    rng = np.random.default_rng(1)
    sets = []
    for g in range(4):
        base = rng.integers(-(2**62), 2**62, 300)
        sets += [np.unique(np.concatenate([base[: 300 - 12 * j], rng.integers(-(2**62), 2**62, 9 * j)])) for j in range(10)]
    n = [len(s) for s in sets]
    true = {(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert len(true) > 20

    def classes(links):
        up = list(range(40))
        for a, b in links:
            a, b = up[a], up[b]
            up = [a if x == b else x for x in up]
        return up

    sketches = [jaccard.sketch(s) for s in sets]
    for tests in (10**8, 0):
        monkeypatch.setattr(jaccard, "TESTS", tests)
        found = classes(list(jaccard.Column(list(range(40)), n, sketches, 80, {}).forest()))
        assert all(found[i] == found[j] for i, j in true)
        assert len(list(jaccard.Column(list(range(40)), n, sketches, 80, {}).forest())) < 40
    matrix = jaccard.TokenGroups(80)
    links = [(i, j) for i in rng.permutation(40).tolist() for j in matrix.add(i, sets[i])]
    assert set(map(lambda p: tuple(sorted(p, reverse=True)), links)) <= true
    want, got = classes(true), classes(links)
    assert len({*zip(want, got)}) == len(set(want)) == len(set(got))


ITEMS = [
    (1, "Wa xe yi zo wu va ve vi vo vu qa qe qi qo qu. The answer is qaqe qiqo."),
    (2, "ra re ri ro ru rara rere riri roro ruru rare reri riro roru rura"),
    (3, None), (4, ""), (5, "two words"), (2, "ra re ri ro ru rara rere riri roro ruru rare reri riro roru rura"),
    (6, " ".join(f"long{i}" for i in range(150)) + ". Short answer here."),
    (None, "na ne ni no nu nana nene nini nono nunu nane neni nino nonu"),
]


def leak_fixture(spark, docs, rows):
    q = dict((i, t) for i, t in ITEMS if i)
    extra = [
        (2001, f"{rows[1][1]} {q[1]} {rows[2][1]}"), (2002, q[1].split(". ")[0]), (2003, f"{rows[3][1]}\n{q[2].upper()}***"),
        (2004, rows[4][1] + " " + q[6]), (2005, " ".join(q[6].split(" ")[:60])), (2006, " ".join(reversed(q[2].split(" ")))), (None, q[2]),
    ]
    more = spark.createDataFrame(extra, "doc_id bigint, text string")
    return docs.unionByName(more, allowMissingColumns=True)


def test_decontamination(spark, docs, rows, empty):
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id bigint, text string, doc_id int")
    every = leak_fixture(spark, docs, rows)
    index = bm25.Index(items, shard=3)
    assert index.shards > 1
    got = {(r["doc_id"], r["item_id"]) for r in bm25.find_leaks(every, index).collect()}
    want = set()
    for r in every.select("doc_id", "text").collect():
        words = bm25.words_of((r["text"] or "").encode())
        for i, t in ITEMS:
            q, a = bm25.question_and_answer((t or "").encode())
            if len(q) + len(a) >= 5 and bm25.share_found(q, words) >= 0.8 and (not a or len(set(a) & set(words)) >= 0.8 * len(set(a))):
                want.add((r["doc_id"], i))
    assert got == want == {(2001, 1), (2003, 2), (2004, 6), (None, 2)}
    kept = bm25.without_leaks(every, index)
    assert kept.columns == every.columns
    gone = collections.Counter(str(r["doc_id"]) for r in every.select("doc_id").collect()) - collections.Counter(str(r["doc_id"]) for r in kept.select("doc_id").collect())
    assert gone == {"2001": 1, "2003": 1, "2004": 1, "None": 1}
    assert bm25.find_leaks(empty, index).count() == 0
    assert bm25.find_leaks(every, bm25.Index(items.where("1 = 0"))).count() == 0


def test_block_max_wand_is_exact():
    import random

    rng = random.Random(3)
    vocabulary = [f"t{i}".encode() for i in range(60)]
    segments = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 30))] for _ in range(70)]
    df = collections.Counter(w for s in segments for w in set(s))
    shard = bm25.Shard(segments, list(range(70)), df, 70, 15.0)
    for _ in range(40):
        terms = sorted({shard.number[w] for w in rng.sample(vocabulary, 25) if w in shard.number})
        for floor in (0.2, 0.45, 0.7):
            score = collections.Counter()
            for t in terms:
                for s, x in zip(shard.segments[t], shard.scores[t]):
                    score[s] += x
            got = dict(shard.search(terms, set(range(shard.n_blocks)), floor))
            assert set(got) == {s for s, x in score.items() if x >= floor - 1e-9}


def features(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_features(rows, docs, empty):
    got = decisionlist.text_features(docs.select("doc_id", "text", "n"), prefix="q_").collect()
    assert sorted((str(r["doc_id"]), *(r[f"q_{c}"] for c in decisionlist.COUNTS)) for r in got) == sorted((str(i), *features(t)) for i, t, *_ in rows)
    assert decisionlist.text_features(empty, prefix="q_").count() == 0


def test_decision_list(spark, docs, empty):
    """Junk with marks is told from prose; rows without labels change nothing; no labels, no rules."""
    good = [(3000 + i, " ".join(f"word{(i * 7 + j * 3) % 97}" for j in range(60))) for i in range(60)]
    junk = [(4000 + i, " ".join(f"word{(i * 5 + j) % 89}%%%" for j in range(60))) for i in range(30)]
    df = spark.createDataFrame(good + junk, "doc_id bigint, text string").withColumn("n", F.lit(5))
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in junk] + [(9, None), (None, 1), (None, 0)], "doc_id bigint, quality int")
    judged, rules = decisionlist.judge(df, labels)
    assert 1 <= len(rules) <= 3
    assert {(r["doc_id"] >= 4000, r["q_kept"]) for r in judged.collect()} == {(False, True), (True, False)}
    kept = decisionlist.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == 60
    judged, rules = decisionlist.judge(docs, labels)
    assert rules == [] and judged.where("q_kept = q_base_failed").count() == 0
    assert decisionlist.keep_good(empty, labels).count() == 0
