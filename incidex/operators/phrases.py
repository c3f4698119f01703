"""Phrases found inside the rows of a table of word lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidex.operators.learn import numbered
from incidex.operators.rules import pattern_truth
from incidex.session import cut_lineage

LISTED = 1_000_000  # words of all patterns that a task holds


class Trie:
    """Patterns as numbered edges: from a node and a word to the next node, sorted."""

    def __init__(self, patterns: list[list[str]]):
        words: dict[str, int] = {}
        edges: dict[tuple[int, int], int] = {}
        ends = {0: False}
        for pattern in patterns:
            node = 0
            for w in pattern:
                node = edges.setdefault((node, words.setdefault(w, len(words))), len(edges) + 1)
                ends.setdefault(node, False)
            ends[node] = bool(pattern)
        self.words = pa.array(list(words), pa.string())
        self.width = max(len(words), 1)
        key = np.array([n * self.width + w for n, w in edges], np.int64)
        order = np.argsort(key)
        self.keys, self.next = key[order], np.array(list(edges.values()), np.int64)[order]
        self.ends = np.array([ends[n] for n in range(len(ends))])

    def hits(self, number: np.ndarray, names: pa.Array, rest: np.ndarray) -> np.ndarray:
        """Which words lie inside a pattern; ``rest`` words are left of the record."""
        word = pc.fill_null(pc.index_in(names, value_set=self.words), -1).to_numpy()[number]
        edge = np.zeros(len(word) + 1, np.int64)
        at, depth = np.flatnonzero(word >= 0), 0
        node = np.zeros(len(at), np.int64)
        while len(at):
            key = node * self.width + word[at + depth]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[i] == key
            at, node, depth = at[on], self.next[i[on]], depth + 1
            done = at[self.ends[node]]
            edge[done] += 1
            edge[done + depth] -= 1
            on = rest[at] > depth
            at, node = at[on], node[on]
            on = word[at + depth] >= 0
            at, node = at[on], node[on]
        return np.cumsum(edge[:-1]) > 0


def pattern_runs(records: DataFrame, key: str, words: str, patterns: DataFrame) -> DataFrame:
    """Longest stretches of places that lie inside an occurrence of any pattern: ``(key, lo, hi)``, both ends included.

    A record is one row, so tasks look for the patterns in place; nothing is shuffled.  Patterns ``(words array<string>)`` of more than
    ``LISTED`` words in all are joined instead.
    """
    listed = cut_lineage(patterns.select("words").where(F.size("words") > 0).distinct())
    if (listed.agg(F.sum(F.size("words"))).first()[0] or 0) > LISTED:
        places = records.select(F.col(key).alias("container_id"), F.posexplode(words).alias("element_id", "tok"))
        inside = pattern_truth(places, listed)
        order = F.row_number().over(Window.partitionBy("container_id").orderBy("element_id"))  # a record is bounded
        runs = inside.withColumn("run", F.col("element_id") - order).groupBy("container_id", "run")
        return runs.agg(F.min("element_id").alias("lo"), F.max("element_id").alias("hi")).select(F.col("container_id").alias(key), "lo", "hi")
    trie = Trie([r["words"] for r in listed.collect()])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, names, record, rest in numbered(batch.column(1)):
                hit = trie.hits(number, names, rest)
                first = np.ones(len(record), bool)
                np.not_equal(record[1:], record[:-1], out=first[1:])
                lo = np.flatnonzero(hit & (first | ~np.r_[False, hit[:-1]]))
                hi = np.flatnonzero(hit & np.r_[first[1:] | ~hit[1:], True])
                start = np.maximum.accumulate(np.where(first, np.arange(len(record)), 0))
                columns = [batch.column(0).take(pa.array(record[lo])), *[pa.array((x - start[x]).astype(np.int32)) for x in (lo, hi)]]
                yield pa.RecordBatch.from_arrays(columns, [key, "lo", "hi"])

    kind = records.schema[key].dataType.simpleString()
    return records.where(F.size(words) > 0).select(key, words).mapInArrow(find, f"{key} {kind}, lo int, hi int")
