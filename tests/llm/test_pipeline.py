"""Each stage of the pipeline against brute force on its own input."""

import collections

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from incidex.llm import bm25, decisionlist
from test_text import ITEMS, brute_classes, features, leak_fixture


def test_stages(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    base = leak_fixture(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), rows)
    base.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 7)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, steps[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert steps[-1].columns == columns
    pairs = [collections.Counter((r["doc_id"], r["text"]) for r in s.collect()) for s in steps[:-1]]

    judged, rules = decisionlist.judge(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    passed = {str(r["doc_id"]) for r in judged.where("q_kept").collect()}
    assert all(str(i) in passed for i, _ in pairs[1])
    for i, t in pairs[0]:
        n, _, _, _, covered = features(t)
        if n < 20 or 100 * covered > 30 * n:
            assert (i, t) not in pairs[1]

    classes, _ = brute_classes([(i, t) for i, t in pairs[1].elements()], 5, 80)
    keep = {i for (i, _), (_, c) in classes.items() if c == i}
    assert {i for i, _ in pairs[2] if i is not None} == keep
    assert pairs[2][None, rows[5][1]] == pairs[1][None, rows[5][1]]

    def leaks(text):
        words = bm25.words_of((text or "").encode())
        for _, t in ITEMS:
            q, a = bm25.question_and_answer((t or "").encode())
            if len(q) + len(a) >= 5 and bm25.share_found(q, words) >= 0.8 and (not a or len(set(a) & set(words)) >= 0.8 * len(set(a))):
                return True
        return False

    assert pairs[3] == collections.Counter({x: n for x, n in pairs[2].items() if not leaks(x[1])})
    assert sum(pairs[3].values()) < sum(pairs[2].values())
    assert pairs[4] == pairs[3]

    order = steps[4].select("doc_id", "text", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in order:
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        want.append((str(r["doc_id"]), at, n))
        at += n
    assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"]) for r in steps[5].collect()) == sorted(want)
    # the order is a mix, not the order of the ids
    ids = [r["doc_id"] for r in order if r["doc_id"] is not None]
    assert ids != sorted(ids) and np.all(np.array([r["n_tokens"] for r in steps[5].collect()]) > 0)
