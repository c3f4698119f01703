"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

    log10 P(text) = sum_i log10 P(c_i | c_{i-1}) + log10 P(w_i | c_i),   c_0 = the end class

Units of clustering are the words with a share of at least ``unit_share`` of all training tokens, and the endings
(last three bytes) of all other words whose joint share reaches it; what is left is one unit.  A share of 1/x leaves
at most x words and x endings at any corpus size, so the class map is small by proof; every word gets the
class of its unit.  Exchange clustering starts from round-robin classes by frequency; in each pass half of
the units (by hash) move to the class that raises the mutual information of adjacent classes most.  Each pass is
one Spark job over the stored neighbour lists of the units.

Smoothing: transitions are interpolated with the class shares (weight ``beta``); emissions add ``delta`` to each count and
to one slot for unseen words: (c + delta) / (N_class + delta (V_class + 1)).

All counts cover all training rows.  Word counts stay distributed: words with a share of at least ``send_share`` (at
most its inverse many) are sent to the tasks, the rest are joined as (document, word) rows after the scoring pass.

Defined results: NULL and empty texts are one end token; NULL ids are learned from like others (their crc is
that of no text: not held out); repeated rows count as often as they occur; with no training rows N = V = 0 and scores
stay finite; further columns are not read.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidex.llm.common import lower_words, record_batches, slices, text_bytes
from incidex.session import cut_lineage

END_HASH, END_ENDING = 0, -1
_MEMO = 1_500_000


class Words:
    """Local numbers of words in one task, with their 64-bit hash and ending."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self._number: dict[bytes, int] = defaultdict()
        self._number.default_factory = self._number.__len__
        self.hashes, self.endings = np.empty(0, np.int64), np.empty(0, np.int64)

    def full(self) -> bool:
        return len(self._number) > _MEMO

    def numbers(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts, one after the other, and the number of words of each text."""
        words = [lower_words(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        get = self._number.__getitem__
        flat = np.fromiter(map(get, itertools.chain.from_iterable(words)), np.int64, int(lengths.sum()))
        fresh = list(itertools.islice(self._number, len(self.hashes), None))
        if fresh:
            h = np.array([xxhash.xxh3_64_intdigest(w) or 1 for w in fresh], np.uint64).view(np.int64)
            e = np.array([int.from_bytes(w[-3:], "big") for w in fresh], np.int64)
            self.hashes, self.endings = np.concatenate([self.hashes, h]), np.concatenate([self.endings, e])
        return flat, lengths


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(h, ending, c)``: count of every word, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, ends = Words(), np.zeros(0, np.int64), 0

        def flush() -> pa.RecordBatch:
            return record_batches([("h", pa.int64(), pa.array(words.hashes)), ("ending", pa.int64(), pa.array(words.endings)), ("c", pa.int64(), pa.array(counts))])

        for whole in batches:
            for b in slices(whole, 1024):
                flat, lengths = words.numbers(text_bytes(b, text_col))
                got = np.bincount(flat, minlength=len(words.hashes))
                got[: len(counts)] += counts
                counts, ends = got, ends + len(lengths)
                if words.full():
                    yield flush()
                    words.clear()
                    counts = np.zeros(0, np.int64)
        yield flush()
        if ends:
            yield record_batches([("h", pa.int64(), [END_HASH]), ("ending", pa.int64(), [END_ENDING]), ("c", pa.int64(), [ends])])

    return docs.select(text_col).mapInArrow(run, "h bigint, ending bigint, c bigint").groupBy("h", "ending").agg(F.sum("c").alias("c"))


@dataclass
class Units:
    """Word hash or ending to unit; 0 is the end token, the last unit is the rest."""

    hashes: np.ndarray
    endings: np.ndarray

    @property
    def count(self) -> int:
        return len(self.hashes) + len(self.endings) + 2

    def of(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.count - 1, np.int64)
        for keys, values, base in ((self.endings, ending, 1 + len(self.hashes)), (self.hashes, h, 1)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
                hit = keys[at] == values
                out[hit] = base + at[hit]
        out[h == END_HASH] = 0
        return out


def find_units(counts: DataFrame, total: int, unit_share: float) -> Units:
    words = counts.where((F.col("c") >= F.lit(unit_share * total)) & (F.col("h") != END_HASH))
    rest = counts.where((F.col("c") < F.lit(unit_share * total)) & (F.col("h") != END_HASH)).groupBy("ending").agg(F.sum("c").alias("c"))
    ends = rest.where(F.col("c") >= F.lit(unit_share * total))
    return Units(np.sort(words.select("h").toPandas()["h"].to_numpy(np.int64)), np.sort(ends.select("ending").toPandas()["ending"].to_numpy(np.int64)))


def unit_bigrams(docs: DataFrame, units: Units, text_col: str = "text") -> DataFrame:
    """``(u, v, c)``: how often unit v follows unit u; texts begin after an end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unit, held, size = Words(), np.empty(0, np.int64), [], 0

        def flush() -> pa.RecordBatch:
            codes, c = np.unique(np.concatenate(held), return_counts=True)
            return record_batches([("u", pa.int64(), pa.array(codes // units.count)), ("v", pa.int64(), pa.array(codes % units.count)), ("c", pa.int64(), pa.array(c))])

        for whole in batches:
            for b in slices(whole, 1024):
                flat, lengths = words.numbers(text_bytes(b, text_col))
                unit = np.concatenate([unit, units.of(words.hashes[len(unit) :], words.endings[len(unit) :])])
                chain = with_ends(unit[flat], lengths)
                held.append(chain[:-1] * units.count + chain[1:])
                size += len(chain)
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
                if words.full():
                    words.clear()
                    unit = np.empty(0, np.int64)
        if held:
            yield flush()

    return docs.select(text_col).mapInArrow(run, "u bigint, v bigint, c bigint").groupBy("u", "v").agg(F.sum("c").alias("c"))


def with_ends(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The texts' values with a 0 (end) before the first and after each text."""
    out = np.zeros(len(values) + len(lengths) + 1, values.dtype)
    place = np.arange(len(values)) + np.repeat(np.arange(len(lengths)), lengths) + 1
    out[place] = values
    return out


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_class(table: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, loop: float) -> tuple[int, float]:
    """Best class for a unit and the gain over staying.

    ``after`` and ``before`` count its neighbours by class without itself, ``loop`` counts it beside itself.
    """
    n = table.copy()
    n[own, :] -= after
    n[:, own] -= before
    n[own, own] -= loop
    rows, cols, diag = n.sum(1) + before, n.sum(0) + after, np.diagonal(n).copy()
    to_row = _phi(n + after[None, :]) - _phi(n)
    to_col = _phi(n + before[:, None]) - _phi(n)
    gain = to_row.sum(1) - np.diagonal(to_row) + to_col.sum(0) - np.diagonal(to_col)
    gain += _phi(diag + after + before + loop) - _phi(diag)
    gain -= _phi(rows + after.sum() + loop) - _phi(rows) + _phi(cols + before.sum() + loop) - _phi(cols)
    gain[0] = -np.inf
    best = int(np.argmax(gain))
    return best, float(gain[best] - gain[own])


def class_table(bigrams: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for b in batches:
            u, v, c = (b.column(x).to_numpy() for x in "uvc")
            total += np.bincount(classes[u] * k + classes[v], c, k * k)
        some = np.flatnonzero(total)
        yield record_batches([("cell", pa.int64(), pa.array(some)), ("n", pa.float64(), pa.array(total[some]))])

    out = np.zeros(k * k)
    for r in bigrams.mapInArrow(run, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(k, k)


def objective(table: np.ndarray) -> float:
    return float(_phi(table).sum() - _phi(table.sum(0)).sum() - _phi(table.sum(1)).sum())


def exchange(bigrams: DataFrame, n_units: int, k: int, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit (0 only for the end token) and the class bigram table."""
    side = lambda w, o: F.struct(F.col(o).alias("o"), F.col("c").alias("c"))
    after = bigrams.groupBy(F.col("u").alias("w")).agg(F.collect_list(side("u", "v")).alias("after"), F.sum("c").alias("n"))
    before = bigrams.groupBy(F.col("v").alias("w")).agg(F.collect_list(side("v", "u")).alias("before"))
    near = cut_lineage(after.join(before, "w", "full"))
    classes = np.ones(n_units, np.int64)
    ranked = [r["w"] for r in near.select("w", "n").orderBy(F.col("n").desc_nulls_last(), "w").collect() if r["w"]]
    classes[ranked] = 1 + np.arange(len(ranked)) % (k - 1)
    classes[0] = 0
    table = class_table(bigrams, classes, k)
    best = (objective(table), classes, table)
    for turn in range(passes):

        def move(batches: Iterator[pa.RecordBatch], classes=classes, table=table, turn=turn) -> Iterator[pa.RecordBatch]:
            for b in batches:
                moved, to = [], []
                for w, lists in zip(b.column("w").to_pylist(), zip(b.column("after"), b.column("before"))):
                    if w == 0 or (w * 2654435761 >> 7) % 2 != turn % 2:
                        continue
                    sums, loop = [], 0.0
                    for near in lists:
                        pairs = near.values
                        o = pairs.field("o").to_numpy() if pairs is not None else np.empty(0, np.int64)
                        c = pairs.field("c").to_numpy().astype(float) if pairs is not None else np.empty(0)
                        loop = float(c[o == w].sum())
                        sums.append(np.bincount(classes[o[o != w]], c[o != w], k))
                    new, gain = best_class(table, int(classes[w]), sums[0], sums[1], loop)
                    if gain > 1e-6:
                        moved.append(w)
                        to.append(new)
                yield record_batches([("w", pa.int64(), moved), ("to", pa.int64(), to)])

        changes = near.select("w", "after", "before").mapInArrow(move, "w bigint, to bigint").toPandas()
        classes = classes.copy()
        classes[changes["w"].to_numpy(np.int64)] = changes["to"].to_numpy(np.int64)
        table = class_table(bigrams, classes, k)
        value = objective(table)
        if value > best[0]:
            best = (value, classes, table)
        if changes.empty and turn:
            break
    return best[1], best[2]


@dataclass
class Model:
    units: Units
    classes: np.ndarray
    transitions: np.ndarray  # log10 P(class | class before)
    slots: np.ndarray  # log10 of the emission denominators
    delta: float
    counts: DataFrame
    total: int
    types: int


def train(docs: DataFrame, text_col: str = "text", k: int = 64, passes: int = 10, unit_share: float = 1e-4, beta: float = 5.0, delta: float = 0.5) -> Model:
    counts = cut_lineage(word_counts(docs, text_col))
    r = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    units = find_units(counts, r["n"], unit_share)
    bigrams = cut_lineage(unit_bigrams(docs, units, text_col))
    classes, table = exchange(bigrams, units.count, k, passes)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(k), np.zeros(k)
        for b in batches:
            c = classes[units.of(b.column("h").to_numpy(), b.column("ending").to_numpy())]
            n, v = n + np.bincount(c, b.column("c").to_numpy(), k), v + np.bincount(c, minlength=k)
        yield record_batches([("k", pa.int64(), list(range(k))), ("n", pa.float64(), pa.array(n)), ("v", pa.float64(), pa.array(v))])

    n, v = np.zeros(k), np.zeros(k)
    for x in counts.mapInArrow(by_class, "k bigint, n double, v double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[x["k"]], v[x["k"]] = x["n"], x["v"]
    share = (n + 1) / (n.sum() + k)
    moves = (table + beta * share[None, :]) / (table.sum(1, keepdims=True) + beta)
    slots = np.log10(n + delta * (v + 1))
    return Model(units, classes, np.log10(moves), slots, delta, counts, r["n"], r["v"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", send_share: float = 1e-6) -> DataFrame:
    """``id, n_tokens, n_known, base_score, score`` for every row."""
    spark = docs.sparkSession
    limit = F.lit(max(1.0, send_share * model.total))
    often = model.counts.where(F.col("c") >= limit).select("h", "c").toPandas().sort_values("h")  # at most 1 / send_share rows
    sent = spark.sparkContext.broadcast((often["h"].to_numpy(np.int64), often["c"].to_numpy(np.int64)))
    units, classes, moves, slots, delta = model.units, model.classes, model.transitions, model.slots, model.delta
    end_count = float(sent.value[1][0]) if len(often) and sent.value[0][0] == END_HASH else None
    if end_count is None:
        found = model.counts.where(F.col("h") == END_HASH).select("c").first()
        end_count = float(found["c"]) if found else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_h, known_c = sent.value
        row, words = TaskContext.get().partitionId() << 40, Words()
        kind = base = own = hit = None

        def look_up(start: int) -> tuple[np.ndarray, ...]:
            h = words.hashes[start:]
            at = np.minimum(np.searchsorted(known_h, h), max(len(known_h) - 1, 0))
            there = known_h[at] == h if len(known_h) else np.zeros(len(h), bool)
            c = np.where(there, known_c[at] if len(known_h) else 0, 0).astype(float)
            return classes[units.of(h, words.endings[start:])], np.where(there, np.log10(c + 1), 0), np.where(there, np.log10(c + delta), 0), there

        for whole in batches:
            for b in slices(whole, 1024):
                if kind is None or words.full():
                    words.clear()
                    kind, base, own, hit = np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0, bool)
                flat, lengths = words.numbers(text_bytes(b, "text"))
                fresh = look_up(len(kind))
                kind, base, own, hit = (np.concatenate(x) for x in zip((kind, base, own, hit), fresh))
                chain = with_ends(kind[flat], lengths)
                steps = moves[chain[:-1], chain[1:]] - np.where(chain[1:] > 0, slots[chain[1:]], 0)
                bounds = np.r_[0, np.cumsum(lengths + 1)]
                sums = np.add.reduceat(steps, bounds[:-1])
                doc = np.repeat(np.arange(len(lengths)), lengths)
                weigh = lambda x: np.bincount(doc, x[flat], len(lengths))
                rare = np.flatnonzero(~hit[flat])
                codes, tf = np.unique(doc[rare] * max(len(kind), 1) + flat[rare], return_counts=True)
                ends = np.searchsorted(codes // max(len(kind), 1), np.arange(len(lengths) + 1))
                offsets = pa.array(ends, pa.int32())
                yield record_batches([
                    ("row", pa.int64(), pa.array(row + np.arange(len(lengths)))),
                    ("id", pa.int64(), b.column("id")),
                    ("n_tokens", pa.int64(), pa.array(lengths + 1)),
                    ("known", pa.int64(), pa.array(weigh(hit.astype(float)).astype(np.int64) + int(end_count > 0))),
                    ("base", pa.float64(), pa.array(weigh(base) + np.log10(end_count + 1))),
                    ("own", pa.float64(), pa.array(sums + weigh(own))),
                    ("rare", pa.list_(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(words.hashes[codes % max(len(kind), 1)]))),
                    ("tf", pa.list_(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))),
                ])
                row += len(lengths)

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = cut_lineage(src.mapInArrow(run, "row bigint, id bigint, n_tokens bigint, known bigint, base double, own double, rare array<bigint>, tf array<bigint>"))
    pairs = parts.select("row", F.explode(F.arrays_zip("rare", "tf")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.tf").alias("tf"))
    tail = model.counts.where(F.col("c") < limit).select("h", "c")
    c: Column = F.coalesce(F.col("c"), F.lit(0))
    sums = pairs.join(tail, "h", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * F.log10(c + 1)).alias("more_base"),
        F.sum(F.col("tf") * F.log10(c + delta)).alias("more_own"),
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    n_tokens = F.col("n_tokens")
    return parts.drop("rare", "tf").join(sums, "row", "left").select(
        "id", "n_tokens", (F.col("known") + zero("more_known")).alias("n_known"),
        (F.col("base") + zero("more_base") - n_tokens * F.log10(F.lit(float(model.total + model.types + 1)))).alias("base_score"),
        (F.col("own") + zero("more_own")).alias("score"),
    )
