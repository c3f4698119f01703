"""Tables with columns named like the operators' own."""

import datetime

from pyspark.sql import functions as F

from incidex.llm import decisionlist, jaccard, pfair, urllists
from incidex.session import cut_lineage

NAMES = (
    "q_n_words", "q_kept", "q_base_failed", "p_key", "o_key", "q_key", "mix_slot", "mix_place", "mix_key", "mix_block", "_keep", "_rank", "_host",
    "host", "blocked", "id", "sid", "cls", "th", "key", "n", "have", "q", "j", "slot", "period", "name", "none", "_c0_31", "a.b",
)


def named(df):
    return df.withColumns({n: F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")) for n in NAMES})


def test_stages_keep_columns_and_values(spark, rows):
    plain = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id bigint, text string, lang string, source string").dropDuplicates(["doc_id"])
    docs = named(plain)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 7)], "doc_id bigint, quality int, toxic int")
    stages = {
        "rules": (lambda d: decisionlist.keep_good(d, labels)),
        "near": (lambda d: jaccard.one_of_each(d)),
        "mix": (lambda d: pfair.in_mixed_order(d, cut_lineage(pfair.tempered(d.select("source"))))),
    }
    for name, stage in stages.items():
        got = stage(docs)
        assert got.columns == docs.columns, name
        out = got.collect()
        assert all(r[n] == f"{n}:{r['doc_id']}" for r in out for n in NAMES), name
        assert {r["doc_id"] for r in out} == {r["doc_id"] for r in stage(plain).collect()}, name
    mixed = pfair.interleave(docs, cut_lineage(pfair.tempered(docs.select("source"))))
    assert len(set(mixed.columns)) == len(mixed.columns) and mixed.count() == docs.count()


def test_url_lists_return_each_name_once(spark):
    day = datetime.date(2024, 1, 3)
    pages = spark.createDataFrame([(1, "http://a.example.org/x", day, "mine")], "doc_id bigint, url string, day date, host string")
    log = spark.createDataFrame([("host", "a.example.org", day, True)], "kind string, pattern string, day date, listed boolean")
    got = urllists.judge(pages, log)
    assert len(set(got.columns)) == len(got.columns)
    assert [(r["host"], r["blocked"]) for r in got.collect()] == [("a.example.org", True)]
