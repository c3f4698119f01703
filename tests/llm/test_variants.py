"""Spelling variants against brute force over all pairs."""

import collections
import random
import re
import zlib

from pyspark.sql import functions as F

from incidex.llm import queries, variants


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    p = 0
    while p < min(len(x), len(y)) and x[p] == y[p]:
        p += 1
    if len(x) == len(y):
        return x[p + 1 :] == y[p + 1 :]
    x, y = sorted((x, y), key=len)
    return x[p:] == y[p + 1 :]


def forms(counts, factor=10):
    """word -> (form, root, n, n_near, form_n)"""
    form, n_near = {}, {}
    for w, n in counts.items():
        partners = [v for v in counts if near(w, v)]
        best = min(partners, key=lambda v: (-counts[v], v), default=None)
        n_near[w] = len(partners)
        form[w] = best if best is not None and counts[best] >= factor * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, n_near[w], counts.get(form[w]))
    return out


def counted(rows, min_chars=7, slip=31):
    total = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_chars:
                total[run] += 1
    return total


def got(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in rows}


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeéÀß") for _ in range(rng.randint(5, 10))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaab", "abababab", "bababab"]
    rows = [(i, " ".join(rng.choice(base[: 1 + int(64 * rng.random() ** 2)]) for _ in range(80))) for i in range(120)]
    rows += [(3, "Abcdefgh-ABCDEFGH abcdefgh×abc ÉCOLES1Écoles ﬁnality"), (None, base[0] + " " + base[1]), (500, None), (501, ""), (502, base[2] * 3000), rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("id", "word", "n", "key")})
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_spelling_forms(spark, str(tmp_path))
    assert sorted(out.columns) == sorted(["word", "form", "root", "n", "n_near", "form_n"])
    want = forms({w: n for w, n in counted(rows).items() if n >= 2})
    assert got(out) == want
    assert sum(w[0] is not None for w in want.values()) > 20
    assert variants.spelling_forms(variants.word_counts(df.where("1 = 0"))).count() == 0


def test_blocks_are_halved_without_losing_pairs(spark):
    """Dense vocabularies: every pair once, whatever the size of a block; chains of forms end at their root."""
    rng = random.Random(6)
    counts = {}
    for _ in range(900):
        w = "pre" + "".join(rng.choice("ab") for _ in range(rng.randint(4, 7)))
        counts[w] = 10 ** rng.randint(0, 5) + rng.randint(0, 1)
    counts |= {"zzzzzzz" + "q" * k: 3 * 10 ** k for k in range(9)}
    want = forms(counts)
    assert want["zzzzzzz"][1] == "zzzzzzz" + "q" * 8
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    for block in (5, 64, 4096):
        assert got(variants.spelling_forms(words, block=block)) == want
