"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidex.llm import bm25, brownlm, fastsketch, pfair, turns, urllists
from incidex.llm.common import id_crc, table
from incidex.llm.decisionlist import COUNTS, judge
from incidex.llm.jaccard import similar_classes
from incidex.llm.linededup import line_dedup
from incidex.llm.tokenfile import read_shards, write_shards
from incidex.llm.toxicity import score, train
from incidex.llm.variants import spelling_forms, word_counts
from incidex.llm.warc import read_archives, write_archives
from incidex.session import cut_lineage

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(id_crc("doc_id") % 5 == 0, F.lit(False))
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time and there is no list table: the day follows from the page id, and the log says for each
    page's host, path and domain whether what was fetched that day is covered with junk marks."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(365)).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("day"), F.coalesce(F.col("html").contains("%%% "), F.lit(False)).alias("junk"))
    kinds = urllists.patterns(F.col("url"))
    entry = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("pattern")) for k, c in kinds.items()])).alias("e")
    log = pages.select("day", F.col("junk").alias("listed"), entry).select("e.kind", "e.pattern", "day", "listed")
    found = urllists.judge(pages.select("page_id", "url", "day"), log, ttl=90)
    return found.select("page_id", "host", F.col("day").cast("string").alias("day"), "blocked", "entry_kind", "entry", F.col("entry_day").cast("string").alias("entry_day"))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, DATE '2024-01-01' + CAST((page_id * 7919) % 365 AS INTEGER) AS day, coalesce(contains(html, '%%% '), false) AS junk,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)', 1) AS part
  FROM pages),
k AS (SELECT *, host || '/' || part AS path, nullif(regexp_extract(host, '([^.]+\.[^.]+)$', 1), '') AS domain FROM p),
log AS (
  SELECT kind, pattern, day, bool_or(junk) AS listed
  FROM (SELECT 'path' AS kind, path AS pattern, day, junk FROM k UNION ALL SELECT 'host', host, day, junk FROM k UNION ALL SELECT 'domain', domain, day, junk FROM k)
  WHERE pattern IS NOT NULL GROUP BY ALL),
spans AS (
  SELECT kind, pattern, day AS valid_from, least(day + 90, coalesce(nxt, day + 90)) AS valid_to
  FROM (SELECT *, lead(day) OVER (PARTITION BY kind, pattern ORDER BY day) AS nxt FROM log) WHERE listed)
SELECT k.page_id, k.host, CAST(k.day AS VARCHAR) AS day, coalesce(a.valid_from, h.valid_from, d.valid_from) IS NOT NULL AS blocked,
  CASE WHEN a.valid_from IS NOT NULL THEN 'path' WHEN h.valid_from IS NOT NULL THEN 'host' WHEN d.valid_from IS NOT NULL THEN 'domain' END AS entry_kind,
  CASE WHEN a.valid_from IS NOT NULL THEN k.path WHEN h.valid_from IS NOT NULL THEN k.host WHEN d.valid_from IS NOT NULL THEN k.domain END AS entry,
  CAST(CAST(coalesce(a.valid_from, h.valid_from, d.valid_from) AS DATE) AS VARCHAR) AS entry_day
FROM k
LEFT JOIN spans a ON a.kind = 'path' AND a.pattern = k.path AND k.day >= a.valid_from AND k.day < a.valid_to
LEFT JOIN spans h ON h.kind = 'host' AND h.pattern = k.host AND k.day >= h.valid_from AND k.day < h.valid_to
LEFT JOIN spans d ON d.kind = 'domain' AND d.pattern = k.domain AND k.day >= d.valid_from AND k.day < d.valid_to
"""


def op3_benchmark_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25.find_leaks(table(spark, sf_dir, "documents"), bm25.Index(table(spark, sf_dir, "benchmark")))
    return hits.select("doc_id", "item_id", F.round("score", 6).alias("score"), F.round("question_overlap", 6).alias("question_overlap"), F.round("answer_overlap", 6).alias("answer_overlap"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), min_chars=10)
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(id_crc("doc_id") % 7 == 2, F.lit(False))
    model = brownlm.train(docs.where(~held_out))
    scored = brownlm.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_classes(table(spark, sf_dir, "documents"), k=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)
    return read_shards(shards).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in COUNTS], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    mixed = pfair.interleave(docs, cut_lineage(pfair.tempered(docs, power=0.5)), block=32, period=1000)
    return mixed.select("doc_id", "source", *[F.col(f"mix_{c}").alias(c) for c in ("block", "release", "deadline", "slot", "place")])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return read_archives(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))


def op12_fast_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fastsketch.similar_classes(table(spark, sf_dir, "documents"), k=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op13_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_counts(table(spark, sf_dir, "documents"), min_chars=7, slip=31)
    return spelling_forms(counts.where("n >= 2"), factor=10)


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity_fm, op2_url_lists, op3_benchmark_bm25, op4_line_dedup, op5_brown_lm, op6_token_group_join, op7_token_shards, op8_decision_list, op9_pfair_mix, op10_warc, op11_conversation_repair, op12_fast_sketch_dedup, op13_spelling_forms)
}
ORACLES = {"op2_url_lists": OP2_SQL}
