"""Benchmark decontamination: a BM25 index of test items, searched by every passage of every document.

Words are lower-cased (A-Z) and lose marks at their ends.  An item is cut into segments of at most ``SEGMENT`` words; a
document into passages of twice that, one beginning every ``SEGMENT`` words, so any segment that was copied lies whole in
some passage.  A segment's BM25 score for a passage is divided by its score for itself: 1 means all its terms are
there.  All segments at or above ``floor`` are retrieved.

Search is block-max WAND over lists ordered by segment, with a maximum for each block of ``BLOCK`` segments.  The block
maxima are first added up for all passages of a batch at once: (passage, block) pairs whose sum is below the
floor hold no hit, and only passages with pairs left are searched list by list.

A hit is verified on the words around the passage: of the item's question (all but its last sentence) the share ``overlap``
of its 5-word shingles must be there, and of its answer (the last sentence, if there are two or more) the same share
of its distinct words.

The index is built with DataFrame operations and cut into shards of about ``shard`` segments; only one
shard is sent to the tasks at a time, so what is sent is bounded for any number of items.

Defined results: items that are NULL or have fewer than ``min_words`` words are not searched; NULL and empty documents
hold nothing; repeated documents and items are each searched; an empty benchmark gives no hits; NULL ids are kept as they
are; further columns are not read by the search and kept by the filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidex.llm.common import lower_words, record_batches, slices, text_bytes
from incidex.session import cut_lineage

SEGMENT, BLOCK, SHINGLE = 32, 8, 5
K1, B = 1.2, 0.75
_MARKS = b".,;:!?|\"'()[]{}#*$%&<>~_-=+/\\"
_MEMO = 1_000_000


def words_of(text: bytes | None) -> list[bytes]:
    return [c for w in lower_words(text) if (c := w.strip(_MARKS))]


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Words of all sentences but the last, and of the last if there is more than one."""
    parts = [w for s in re.split(rb"(?<=[.!?])\s+|\n+", text) if (w := words_of(s))]
    return [w for p in (parts[:-1] if len(parts) > 1 else parts) for w in p], parts[-1] if len(parts) > 1 else []


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def share_found(wanted: list[bytes], around: list[bytes]) -> float:
    need = shingles(wanted)
    if not need:
        return 1.0
    n = min(SHINGLE, len(wanted))
    there = {tuple(around[i : i + n]) for i in range(len(around) - n + 1)}
    return len(need & there) / len(need)


class Shard:
    """Inverted lists of one shard: term -> segments and scores, and their maxima by block."""

    def __init__(self, segments: list[list[bytes]], items: list[int], df: dict[bytes, int], n_segments: int, mean_length: float):
        self.items, self.n_blocks = items, -(-len(segments) // BLOCK)
        lists: dict[bytes, list[tuple[int, float]]] = {}
        for s, words in enumerate(segments):
            tf: dict[bytes, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / mean_length)
            raw = {w: np.log(1 + (n_segments - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in tf.items()}
            whole = sum(raw.values())
            for w, x in raw.items():
                lists.setdefault(w, []).append((s, x / whole))
        self.number = {w: i for i, w in enumerate(lists)}
        self.segments = [[s for s, _ in v] for v in lists.values()]
        self.scores = [[x for _, x in v] for v in lists.values()]
        self.best = np.array([max(x) for x in self.scores] or [0.0])
        blocks = []
        for segs, xs in zip(self.segments, self.scores):
            top: dict[int, float] = {}
            for s, x in zip(segs, xs):
                top[s // BLOCK] = max(top.get(s // BLOCK, 0.0), x)
            blocks.append(top)
        self.block_best = blocks
        # block maxima: terms in many blocks as rows of a matrix, the others as lists
        self.wide = np.array([len(b) > max(4, self.n_blocks // 4) for b in blocks] or [False])
        self.block_ptr = np.cumsum([0, *(0 if w else len(b) for w, b in zip(self.wide, blocks))])
        narrow = [b for w, b in zip(self.wide, blocks) if not w]
        self.block_of = np.array([k for b in narrow for k in b], np.int64)
        self.block_max = np.array([x for b in narrow for x in b.values()], float)
        self.wide_row = np.cumsum(self.wide) - 1
        self.wide_max = np.zeros((int(self.wide.sum()), max(self.n_blocks, 1)), np.float32)
        for row, b in enumerate(b for w, b in zip(self.wide, blocks) if w):
            self.wide_max[row, list(b)] = list(b.values())

    def candidates(self, chunk: np.ndarray, term: np.ndarray, first: np.ndarray, last: np.ndarray, floor: float) -> dict[int, set[int]]:
        """Passage -> blocks that may hold a segment at the floor.

        ``chunk`` and ``term`` are the distinct terms of each chunk; passage p is chunks p and p + 1, or the only chunk
        of a document.  ``first`` and ``last`` tell whether a chunk is its document's first or last.
        """
        n, blocks = len(first), self.n_blocks
        size = self.block_ptr[term + 1] - self.block_ptr[term]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.block_ptr[term], size)
        codes = np.repeat(chunk, size) * blocks + self.block_of[at]
        bound = np.bincount(codes, self.block_max[at], n * blocks).astype(np.float32).reshape(n, blocks)
        wide = self.wide[term]
        has = np.zeros((n, len(self.wide_max)), np.float32)
        has[chunk[wide], self.wide_row[term[wide]]] = 1
        bound += has @ self.wide_max
        bound[:-1] += np.where(last[:-1, None], np.float32(0), bound[1:])
        bound[last & ~first] = 0  # a passage begins at every chunk but the last; at the only one too
        left: dict[int, set[int]] = {}
        for p, b in np.argwhere(bound >= floor - 1e-5).tolist():
            left.setdefault(p, set()).add(b)
        return left

    def search(self, terms: list[int], allowed: set[int], floor: float) -> list[tuple[int, float]]:
        """All segments with a score of ``floor`` or more: block-max WAND."""
        bound = {b: sum(self.block_best[t].get(b, 0.0) for t in terms) for b in allowed}
        allowed = {b for b, x in bound.items() if x >= floor}
        if not allowed:
            return []
        cursor = {t: 0 for t in terms}
        found, eps = [], 1e-9
        while True:
            live = sorted((self.segments[t][cursor[t]], t) for t in cursor if cursor[t] < len(self.segments[t]))
            total, pivot = 0.0, None
            for s, t in live:  # the first segment whose lists could reach the floor together
                total += float(self.best[t])
                if total >= floor - eps:
                    pivot = s
                    break
            if pivot is None:
                return found
            block = pivot // BLOCK
            if block not in allowed:
                target = (block + 1) * BLOCK  # the whole block falls short
            else:
                score = 0.0
                for s, t in live:
                    k = self._to(t, cursor[t], pivot)
                    if k < len(self.segments[t]) and self.segments[t][k] == pivot:
                        score += self.scores[t][k]
                if score >= floor - eps:
                    found.append((pivot, score))
                target = pivot + 1
            for s, t in live:
                if s < target:
                    cursor[t] = self._to(t, cursor[t], target)

    def _to(self, term: int, at: int, target: int) -> int:
        segs = self.segments[term]
        while at < len(segs) and segs[at] < target:
            at += 1
        return at


class _TermMemo(dict):
    def __init__(self, number: dict[bytes, int]):
        super().__init__()
        self._number = number

    def __missing__(self, word: bytes) -> int:
        core = word.strip(_MARKS)
        got = self[word] = self._number.get(core, -1) if core else -2
        return got


def search_texts(shard: Shard, memo: _TermMemo, texts: list[bytes | None], floor: float) -> Iterator[tuple[int, int, float, int]]:
    """``(text, item, score, chunk in the text)`` of every hit."""
    if len(memo) > _MEMO:
        memo.clear()
    terms, chunks, counts, base = [], [], [], 0
    for text in texts:
        t = np.fromiter(map(memo.__getitem__, lower_words(text)), np.int64)
        t = t[t != -2]
        n = -(-len(t) // SEGMENT)
        chunks.append(base + np.arange(len(t)) // SEGMENT)
        terms.append(t)
        counts.append(n)
        base += n
    if not base or not shard.n_blocks:
        return
    chunk, term, counts = np.concatenate(chunks), np.concatenate(terms), np.array(counts)
    size = len(shard.number) + 1
    pairs = np.unique(chunk[term >= 0] * size + term[term >= 0])
    chunk, term = pairs // size, pairs % size
    start = np.cumsum(counts) - counts
    first, last = np.zeros(base, bool), np.zeros(base, bool)
    first[start[counts > 0]] = True
    last[(start + counts - 1)[counts > 0]] = True
    ptr = np.searchsorted(chunk, np.arange(base + 1))
    text_of = np.repeat(np.arange(len(counts)), counts)
    for p, blocks in shard.candidates(chunk, term, first, last, floor).items():
        end = p + 1 if last[p] else p + 2
        query = np.unique(term[ptr[p] : ptr[end]]).tolist()
        for segment, score in shard.search(query, blocks, floor):
            yield int(text_of[p]), shard.items[segment], score, int(p - start[text_of[p]])


class Index:
    """Shards of the index, each fetched when it is its turn."""

    def __init__(self, items: DataFrame, id_col: str = "item_id", text_col: str = "text", min_words: int = 5, shard: int = 4096):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts, segments = [], [], []
                for i, text in zip(b.column("item").to_pylist(), text_bytes(b, "text")):
                    words = words_of(text)
                    if len(words) < min_words:
                        continue
                    parts = -(-len(words) // SEGMENT)
                    step = -(-len(words) // parts)
                    for at in range(0, len(words), step):
                        ids.append(i)
                        texts.append(text)
                        segments.append(words[at : at + step])
                yield record_batches([("item", pa.int64(), ids), ("text", pa.binary(), texts), ("words", pa.list_(pa.binary()), segments)])

        src = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
        self._segments = cut_lineage(src.mapInArrow(cut, "item bigint, text binary, words array<binary>"))
        row = self._segments.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("words")), F.lit(1.0)).alias("mean")).first()
        self.n, self.mean = row["n"], row["mean"]
        self.shards = -(-self.n // shard)
        self._part = F.pmod(F.xxhash64("item", "words"), F.lit(max(self.shards, 1)))
        self._df = self._segments.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))

    def fetch(self, number: int) -> tuple[Shard, list[tuple[int | None, bytes]]]:
        """A shard and its items ``(id, text)``; about ``shard`` segments."""
        rows = self._segments.where(self._part == number)
        terms = rows.select(F.explode("words").alias("w")).distinct().join(self._df, "w")
        df = {bytes(r["w"]): r["df"] for r in terms.toLocalIterator()}
        items: dict[tuple[int | None, bytes], int] = {}
        segments, owners = [], []
        for r in rows.orderBy("item", "text", "words").toLocalIterator():
            owners.append(items.setdefault((r["item"], bytes(r["text"])), len(items)))
            segments.append([bytes(w) for w in r["words"]])
        return Shard(segments, owners, df, self.n, self.mean), list(items)


def verified(text: bytes, item: bytes, at: int, overlap: float) -> tuple[float, float] | None:
    """Shares of question and answer found around chunk ``at`` of a text, if both suffice."""
    question, answer = question_and_answer(item)
    words, reach = words_of(text), len(question) + len(answer) + SEGMENT
    around = words[max(0, at * SEGMENT - reach) : (at + 2) * SEGMENT + reach]
    q, a = share_found(question, around), len(set(answer) & set(around)) / len(set(answer)) if answer else 1.0
    return (q, a) if q >= overlap and a >= overlap else None


def find_leaks(docs: DataFrame, index: Index, floor: float = 0.6, overlap: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap)`` of every verified pair, best passage each."""
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for number in range(index.shards):
        sent = spark.sparkContext.broadcast(index.fetch(number))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shard, items = sent.value
            memo = _TermMemo(shard.number)
            for whole in batches:
                for b in slices(whole, 512):
                    ids, texts = b.column("id").to_pylist(), text_bytes(b, "text")
                    best: dict[tuple[int, int], tuple[float, float, float]] = {}
                    for doc, item, score, at in search_texts(shard, memo, texts, floor):
                        if (got := verified(texts[doc], items[item][1], at, overlap)) is not None:
                            best[doc, item] = max(best.get((doc, item), (0.0, 0.0, 0.0)), (score, *got))
                    yield record_batches([
                        ("doc_id", pa.int64(), [ids[d] for d, _ in best]), ("item_id", pa.int64(), [items[i][0] for _, i in best]),
                        *[(name, pa.float64(), [x[k] for x in best.values()]) for k, name in enumerate(("score", "question_overlap", "answer_overlap"))],
                    ])

        out = out.unionByName(src.mapInArrow(search, schema))
    # an item's segments may lie in several shards
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def without_leaks(docs: DataFrame, index: Index, floor: float = 0.6, overlap: float = 0.8, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item; rows pass through the search of each shard, nothing is shuffled."""
    for number in range(index.shards):
        sent = docs.sparkSession.sparkContext.broadcast(index.fetch(number))

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shard, items = sent.value
            memo = _TermMemo(shard.number)
            for whole in batches:
                for b in slices(whole, 512):
                    texts, clean = text_bytes(b, text_col), np.ones(b.num_rows, bool)
                    for doc, item, _, at in search_texts(shard, memo, texts, floor):
                        if clean[doc] and verified(texts[doc], items[item][1], at, overlap) is not None:
                            clean[doc] = False
                    yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
