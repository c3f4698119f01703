"""Toxicity, URL lists, language model, token shards, mixing, archives and the pipeline."""

import base64
import collections
import datetime
import hashlib
import io
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from incidex.llm import brownlm, pfair, queries, tokenfile, toxicity, urllists, warc
from incidex.session import cut_lineage

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def test_toxicity_learns_pairs(spark, docs, empty):
    """Neither word alone is toxic, only both: a sum of weights fails, the pair term does not."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.randint(0, 400)}" for _ in range(30)]
        a, b = i % 2, (i // 2) % 2
        words += ["zork"] * a + ["blim"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, a & b))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("y", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (3, None), (None, 1), (5, 7)], "doc_id bigint, toxic int")
    model = toxicity.train(df, marks, F.col("doc_id") % 5 != 0)
    got = {r["id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels if i % 5 == 0]) > 0.97
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(df, marks.where("1 = 0"), F.lit(True))
    assert all(math.isclose(r["score"], 1e-4) for r in toxicity.score(df.limit(5), none).collect())


def test_toxicity_counts_all_labelled_rows(spark):
    """Buckets are chosen from all labelled rows and without a cap; only the fit takes a sample."""
    rows = [(i, f"word{i % 7} " + " ".join(f"bad{i}x{k % 90}" if i < 2 else f"vile{k}" for k in range(90)) if i % 2 else f"word{i % 7} good") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    few, all_rows = (toxicity.train(df, marks, F.lit(True), sample=n) for n in (20, 400))
    assert len(few.buckets) > 80 and list(few.buckets) == list(all_rows.buckets)
    many = [(i, " ".join(f"t{k}" for k in range(6000)) if i % 2 else "fine") for i in range(60)]
    model = toxicity.train(spark.createDataFrame(many, df.schema), marks, F.lit(True))
    assert len(model.buckets) > 5000


def test_url_lists(spark):
    day = lambda n: datetime.date(2024, 1, n)
    log = [
        ("host", "a.x.com", day(5), True), ("host", "a.x.com", day(9), False), ("host", "a.x.com", day(9), True), ("host", "a.x.com", day(12), False),
        ("domain", "x.com", day(11), True), ("path", "b.x.com/p", day(3), True), ("host", None, day(1), True), ("host", "c.org", None, True),
    ]
    pages = [
        (1, "http://a.x.com/q", day(4), False, None), (2, "HTTP://u:p@A.x.com:80/q", day(5), True, "host"), (3, "http://a.x.com", day(10), True, "host"),
        (4, "http://a.x.com/", day(12), True, "domain"), (5, "https://b.x.com/p/z?y", day(4), True, "path"), (6, "https://b.x.com/q", day(4), False, None),
        (7, None, day(4), False, None), (8, "nonsense", day(4), False, None), (9, "http://a.x.com/", None, False, None), (10, "http://a.x.com/q", day(20), False, None),
        (2, "HTTP://u:p@A.x.com:80/q", day(5), True, "host"),
    ]
    entries = spark.createDataFrame(log, "kind string, pattern string, day date, listed boolean")
    captures = spark.createDataFrame([p[:3] for p in pages], "page_id bigint, url string, day date").withColumn("pattern", F.lit(1))
    got = urllists.judge(captures, entries, ttl=8)
    assert got.columns[:4] == captures.columns
    assert sorted((r["page_id"], r["blocked"], str(r["entry_kind"])) for r in got.collect()) == sorted((p[0], p[3], str(p[4])) for p in pages)
    assert urllists.judge(captures, entries.where("1 = 0")).where("blocked").count() == 0
    assert urllists.judge(captures.where("1 = 0"), entries).count() == 0


def test_language_model(spark, rows, docs, empty):
    train_on = docs.where(F.coalesce(F.col("doc_id") % 4 != 2, F.lit(True)))
    model = brownlm.train(train_on, k=8, passes=4, unit_share=1e-3)
    counts, want = collections.Counter(), []
    tokens = lambda t: [*(t or "").encode().translate(LOWER).split(), None]
    for i, t, *_ in rows:
        if i is None or i % 4 != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert (model.total, model.types) == (n, v)
    for send in (1e-6, 0.01):  # all counts sent, and most of them joined
        got = brownlm.score(docs, model, send_share=send).collect()
        want = sorted((str(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), 4)) for i, t, *_ in rows)
        assert sorted((str(r["id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert brownlm.score(empty, model).count() == 0
    nothing = brownlm.train(empty, k=4)
    assert all(math.isfinite(r["score"]) and r["base_score"] == 0 for r in brownlm.score(docs.limit(5), nothing).collect())


def test_class_model_is_a_distribution(spark):
    """Class transitions add up to 1, and so do the emissions of a class with its slot for unseen words."""
    df = spark.createDataFrame([(i, " ".join(f"{'ab'[j % 2]}{(i * j) % 7}" for j in range(40))) for i in range(30)], "doc_id bigint, text string")
    model = brownlm.train(df, k=6, passes=6, unit_share=1e-3)
    assert np.allclose((10.0**model.transitions).sum(1), 1)
    rows = model.counts.collect()
    kind = model.classes[model.units.of(np.array([r["h"] for r in rows]), np.array([r["ending"] for r in rows]))]
    for c in range(1, 6):
        inside = [r["c"] for r, k in zip(rows, kind) if k == c]
        assert math.isclose(sum(x + model.delta for x in inside) + model.delta, 10 ** model.slots[c])
    # a alternates with b: the exchange finds it and beats single words
    got = brownlm.score(df, model).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"] * 0.9


def test_best_class_agrees_with_recount():
    rng = np.random.default_rng(2)
    chain = rng.integers(1, 12, 400)
    classes = rng.integers(1, 5, 12)

    def table(classes):
        out = np.zeros((5, 5))
        np.add.at(out, (classes[chain[:-1]], classes[chain[1:]]), 1)
        return out

    for w in range(1, 12):
        after = np.bincount([classes[b] for a, b in zip(chain, chain[1:]) if a == w and b != w], minlength=5).astype(float)
        before = np.bincount([classes[a] for a, b in zip(chain, chain[1:]) if b == w and a != w], minlength=5).astype(float)
        loop = float(sum(a == b == w for a, b in zip(chain, chain[1:])))
        best, gain = brownlm.best_class(table(classes), int(classes[w]), after, before, loop)
        moved = classes.copy()
        values = []
        for c in range(1, 5):
            moved[w] = c
            values.append(brownlm.objective(table(moved)))
        assert best == 1 + int(np.argmax(values))
        assert math.isclose(gain, max(values) - values[classes[w] - 1], abs_tol=1e-6)


def test_token_shards(spark, rows, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = [(5001, "Don't STOP, it's 12.5%!! <|endoftext|> Σίσυφος ΣΑΣ é É 　x"), (5002, "A,b.;c ,, ..!? 'tis O'Neil's"), (5003, "\x1c\x1d a\tb\r\nc\x0bd")]
    every = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"), allowMissingColumns=True)
    shards = tokenfile.write_shards(every, path, 2)
    got = tokenfile.read_shards(shards, ids=True).orderBy("start").collect()
    keys = [r["key"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    at, seen = 0, collections.Counter()
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"] and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
        seen[r["key"], bytes(r["ids"])] += 1
    texts = [(i, t) for i, t, *_ in rows] + odd
    assert seen == collections.Counter((i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in texts)
    assert tokenfile.read_shards(tokenfile.write_shards(empty, path, 2)).count() == 0
    # absent keys are refused by their fingerprints
    shard = tokenfile.Shard(shards.first()["path"])
    absent = np.arange(10**9, 10**9 + 2000)
    assert (shard.find(absent, np.zeros(2000, np.int64)) >= 0).sum() <= 1


def test_minimal_perfect_hash():
    keys = np.arange(5000, dtype=np.int64) * 977 - 10**6
    hashed = tokenfile._hash_keys(keys, np.zeros(5000, np.int64))
    assert sorted(tokenfile._slots(tokenfile._levels(hashed), hashed).tolist()) == list(range(5000))


def test_pfair(spark, docs, rows, empty):
    weights = spark.createDataFrame([("a", 5.0), ("b", 3.0), (None, 1.3), ("c", 0.7)], "source string, weight double")
    per = pfair.schedule(pfair.shares(weights, 100)).collect()
    period = per[0]["period"]
    assert sorted(r["slot"] for r in per) == list(range(period))
    for s in {r["source"] for r in per}:
        own = sorted((r["j"], r["slot"], r["q"]) for r in per if r["source"] == s)
        q = own[0][2]
        assert len(own) == q
        assert all(j * period // q <= slot < -(-(j + 1) * period // q) for j, slot, _ in own)
        for t in range(period + 1):
            assert abs(sum(slot < t for _, slot, _ in own) - q * t / period) < 1
    mixed = pfair.interleave(docs, cut_lineage(pfair.tempered(docs)), block=3, period=20)
    got = mixed.collect()
    assert mixed.columns[: len(docs.columns)] == docs.columns and len(got) == len(rows)
    assert collections.Counter((r["doc_id"], r["source"]) for r in got) == collections.Counter((i, s) for i, _, _, s in rows)
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    assert len({(r["mix_slot"], r["mix_place"]) for r in got}) == len(got)
    by_slot = collections.defaultdict(set)
    for r in got:
        by_slot[r["mix_slot"]].add(r["source"])
    assert all(len(s) == 1 for s in by_slot.values())
    assert pfair.interleave(empty, pfair.tempered(empty)).count() == 0
    with pytest.raises(ValueError, match="no target weight"):
        pfair.interleave(docs, weights)
    with pytest.raises(ValueError, match="more than"):
        pfair.interleave(docs, pfair.tempered(docs), max_sources=2)


def test_archives(spark):
    pages = [(i, f"http://h/{i}", "x" * (i * 1000) if i % 3 else "same page", "n") for i in range(1, 30)]
    pages += [(40, None, None, "n"), (41, "http://h/\r\nX: y", "", "n"), (3, "http://h/3", "same page", "n"), (None, "http://n", "same page", "n"), (None, "u", "only nulls", "n"), (50, "http://big", "\r\n\r\né" * 200_000, "n")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, payload string")
    got = warc.read_archives(warc.write_archives(df)).collect()
    want = []
    for p, _, h, _ in pages:
        body = (h or "").encode()
        first = min((q for q, _, x, _ in pages if (x or "") == (h or "") and q is not None), default=None)
        again = first is not None and p != first
        want.append((str(p), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, want)) == sorted(str((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    assert all(bytes(r["payload"]).decode() == (next(h for p, _, h, _ in pages if p == r["page_id"]) or "") for r in got if r["record_type"] == "response" and r["page_id"])
    assert warc.read_archives(warc.write_archives(df.where("1 = 0"))).count() == 0
    small = warc.read_archives(warc.write_archives(df, min_revisit_bytes=10)).collect()
    assert not any(r["record_type"] == "revisit" and r["payload_bytes"] < 10 for r in small)


def test_archive_reader_refuses_damage():
    raw = warc.record_bytes(1, "http://a", b"hello", 5, base64.b32encode(hashlib.sha1(b"hello").digest()).decode(), None)

    def member(x):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(x) + z.flush()

    good = member(raw)
    assert [(f["page-id"], n, b) for f, n, b in warc.read_records(io.BytesIO(good + good))] == [("1", 5, b"hello")] * 2
    for bad in (member(raw.replace(b"hello", b"hellO")), good[:-20], member(raw.replace(b"Content-Length: ", b"Content-Size: ")), member(raw + b"x")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


def test_queries_match_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, sf), con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(map(str, got.select(*columns).collect())) == sorted("Row(" + ", ".join(f"{c}={v!r}" for c, v in zip(columns, r)) + ")" for r in want.fetchall())
