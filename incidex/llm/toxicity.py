"""Toxicity scores from a factorization machine over hashed terms.

Terms of a text are its distinct words (A-Z lower-cased, marks at the ends taken off) and, for longer words,
their first five bytes; each is hashed into ``BUCKETS``.  Over all labelled training rows the classes' document
counts of every bucket are added up; all buckets that tell the classes apart (by ``least_gap`` standard errors at least) carry the model

    z = b + sum_i w_i + sum_{i<j} <v_i, v_j>,   score = 1 / (1 + exp(-z)),

where the pair term scores combinations (an insult next to a group's name) that no sum of weights can.  The
model is fitted with Adam on a bounded sample of labelled rows (``sample`` rows by hash order of the id, taken after the counts; the bound is
what is ever gathered on the driver), and scoring is one pass over the documents.

Defined results: NULL and empty texts have no terms and get the model's base rate; NULL ids are scored, never
learned from and never held out; NULL labels are not used; a document with several labels counts once for each;
with no labels of one class every score is the base rate; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidex.llm.common import lower_words, record_batches, slices, text_bytes
from incidex.session import cut_lineage

BUCKETS = 1 << 18
_MARKS = b".,;:!?|\"'()[]{}#*$%&<>~_-=+/\\"
_STEM = 5
_MEMO = 500_000


class TermHasher:
    """Buckets of words, remembered per task (the memo is emptied when full)."""

    def __init__(self, keep: dict[int, int] | None = None):
        self._memo: dict[bytes, tuple[int, ...]] = {}
        self._keep = keep

    def _of(self, word: bytes) -> tuple[int, ...]:
        core = word.strip(_MARKS)
        if not core:
            return ()
        terms = [xxhash.xxh32_intdigest(core) % BUCKETS]
        if len(core) > _STEM:
            terms.append(xxhash.xxh32_intdigest(b"\x00" + core[:_STEM]) % BUCKETS)
        if self._keep is None:
            return tuple(terms)
        return tuple(self._keep[t] for t in terms if t in self._keep)

    def __call__(self, text: bytes | None) -> set[int]:
        """Distinct buckets of a text, or the model's numbers for them."""
        memo, out = self._memo, set()
        if len(memo) > _MEMO:
            memo.clear()
        for word in set(lower_words(text)):
            got = memo.get(word)
            if got is None:
                got = memo[word] = self._of(word)
            if got:
                out.update(got)
        return out


@dataclass
class FactorizationMachine:
    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, index: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(row, self.weights[index], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[index, f]
            z += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return z

    def scores(self, index: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(index, row, n), -35, 35)))


def fit(buckets: np.ndarray, y: np.ndarray, rows: list[np.ndarray], k: int = 6, steps: int = 400, batch: int = 4096, rate: float = 0.03, l2: float = 1e-4) -> FactorizationMachine:
    """Adam on the logistic loss; batches are taken in turn."""
    rng, size = np.random.default_rng(7), len(buckets)
    share = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
    model = FactorizationMachine(buckets, float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, k)))
    if not size or y.min() == y.max():
        return model
    params = [np.array([model.bias]), model.weights, model.factors]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    starts = list(range(0, len(y), batch))
    for step in range(1, steps + 1):
        at = starts[(step - 1) % len(starts)]
        part = rows[at : at + batch]
        index = np.concatenate(part).astype(np.int64)
        row = np.repeat(np.arange(len(part)), [len(r) for r in part])
        g = (model.scores(index, row, len(part)) - y[at : at + batch]) / len(part)
        each = g[row]
        grads = [np.array([g.sum()]), np.bincount(index, each, size) + l2 * model.weights, l2 * model.factors]
        for f in range(k):
            v = model.factors[index, f]
            grads[2][:, f] += np.bincount(index, each * (np.bincount(row, v, len(part))[row] - v), size)
        for p, m, s, d in zip(params, first, second, grads):
            m += 0.1 * (d - m)
            s += 0.001 * (d * d - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        model.bias = float(params[0][0])
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 200_000, min_docs: int = 3, least_gap: float = 2.5) -> FactorizationMachine:
    """Fits on rows of ``labels(doc_id, toxic)`` that satisfy ``usable`` (a condition on ``doc_id``)."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TermHasher()
        for whole in batches:
            for b in slices(whole, 1024):
                got = [list(terms(t)) for t in text_bytes(b, "text")]
                yield record_batches([("id", pa.int64(), b.column("id")), ("terms", pa.list_(pa.int32()), got)])

    # hashed terms meet their labels, so no text is shuffled; a merge join at every size
    terms = docs.where(F.col("doc_id").isNotNull() & usable).select(F.col("doc_id").alias("id"), "text").mapInArrow(hashed, "id bigint, terms array<int>")
    rows = cut_lineage(terms.join(marks.hint("merge"), "id").select("id", "y", "terms"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            lists = b.column("terms")
            index = lists.flatten().to_numpy(zero_copy_only=False)
            y = np.repeat(b.column("y").to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
            for c in (0, 1):
                table[c] += np.bincount(index[y == c], minlength=BUCKETS)
        some = np.flatnonzero(table.sum(0))
        yield record_batches([("bucket", pa.int32(), pa.array(some.astype(np.int32))), ("neg", pa.int64(), pa.array(table[0][some])), ("pos", pa.int64(), pa.array(table[1][some]))])

    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    pos, neg = F.col("pos"), F.col("neg")
    # distance of the log shares in standard errors
    gap = F.abs(F.log((pos + 0.5) / F.lit(n_pos + 1.0)) - F.log((neg + 0.5) / F.lit(n_neg + 1.0))) / F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    totals = rows.mapInArrow(counted, "bucket int, neg bigint, pos bigint").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    best = totals.where((pos + neg >= min_docs) & (gap >= least_gap)).select("bucket").toPandas()  # at most BUCKETS
    buckets = np.sort(best["bucket"].to_numpy(np.int64))
    if not n_pos or not n_neg:
        buckets = buckets[:0]
    number = {int(b): i for i, b in enumerate(buckets)}

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[number[t] for t in terms if t in number] for terms in b.column("terms").to_pylist()]
            yield record_batches([("id", pa.int64(), b.column("id")), ("y", pa.int32(), b.column("y")), ("x", pa.list_(pa.int32()), got)])

    some = rows if n_pos + n_neg <= sample else rows.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    design = some.mapInArrow(reduced, "id bigint, y int, x array<int>").toArrow()
    order = np.argsort(mix_order(design.column("id").to_numpy()), kind="stable")
    y = design.column("y").to_numpy().astype(float)[order]
    lists = design.column("x").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return fit(buckets, y, [np.sort(values[starts[i] : ends[i]]) for i in order])


def mix_order(ids: np.ndarray) -> np.ndarray:
    """A fixed shuffle of the training rows."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row."""
    number = {int(b): i for i, b in enumerate(model.buckets)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TermHasher(number)
        for whole in batches:
            for b in slices(whole, 1024):
                got = [sorted(terms(t)) for t in text_bytes(b, "text")]
                index = np.array([i for r in got for i in r], np.int64)
                row = np.repeat(np.arange(len(got)), [len(r) for r in got])
                yield record_batches([("id", pa.int64(), b.column("id")), ("score", pa.float64(), pa.array(model.scores(index, row, len(got))))])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, score double")
