"""Exact n-gram Jaccard join with a token-group matrix.

A document's set holds the 64-bit hashes of its distinct k-word shingles (all its words as one shingle when it has
fewer).  Two documents link when ``100 * |x & y| >= percent * |x | y|``; the result is each document's class.

1. Equal sets collapse to one set id; from here on only different sets are compared.
2. Every set sends the first ``n - ceil(t n) + 1`` of its shingles, in one global order, to the columns of the matrix.
   Linked sets share one of these.  Shingles that are frequent somewhere come last in the order (by their count), so
   passages that many documents share are not met again and again; the order never changes the result.
3. One sorted stream over the columns partitions similar sets into families.  A column's sets are compared by sizes and sketches: a sketch holds
   the parity of the shingles on each of about n bits, so the bits in which two sketches differ are no more than the shingles in which the
   sets differ, and sets that link always pass.  A column sends a spanning forest of what passes, found with pivots, never its pairs; beyond
   ``TESTS`` comparisons it links the rest to its first set untested, which only makes families larger.
4. Sets that link lie in one family.  A family's full sets are fetched once and go through a token-group matrix: each group of linked sets
   stores the union of its shingles.  A set queries the matrix with its shingles; the count of a group bounds every overlap inside, and only groups
   where it reaches ``t |q|`` are opened and compared set by set.  Groups that a set links with become one.
5. A family of more than ``CHUNK`` shingles is dealt to chunks, each with the family's first set; then its sets outside its largest class
   query the unions of all its chunks.

All steps are exact.  Rows that meet in one task are bounded by the chunk size; queries are dealt over copies of a chunk.
Joins on sets and ids are merge joins at every size.

Defined results: NULL, empty or white-space text has no set and is its own class; a NULL id links with nothing and
gets a NULL class; repeated rows and ids join the same class; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidex.llm.brownlm import Words
from incidex.llm.common import mix64, record_batches, set_aside, slices, text_bytes, unused
from incidex.operators.graph import components
from incidex.session import cut_lineage, release

CHUNK = 2_000_000  # shingles of the members compared in one task
QUERIES = 2_000_000  # shingles of the queries sent to one copy of a chunk
TESTS = 100_000_000  # comparisons of sketches in one column
HELD = 64_000_000  # bytes of one column held in a task
_FREQUENT = 1e-3  # share of documents from which a shingle goes to the end of the order


def shingle_sets(words: Words, texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    flat, lengths = words.numbers(texts)
    h = mix64(words.hashes.view(np.uint64))[flat]
    rolled = h.copy()
    for j in range(1, k):
        rolled[: len(h) - j] = mix64(rolled[: len(h) - j] + np.uint64(j)) ^ h[j:] if len(h) > j else rolled[:0]
    at = 0
    for n in lengths.tolist():
        if n >= k:
            yield np.unique(rolled[at : at + n - k + 1].view(np.int64))
        elif n:
            short = int(xxhash.xxh3_64_intdigest(h[at : at + n].tobytes(), seed=n))
            yield np.array([short - (1 << 64) if short >> 63 else short], np.int64)
        else:
            yield np.empty(0, np.int64)
        at += n
        if words.full():  # numbers of this call stay valid: ``h`` is already looked up
            words.clear()


def set_id(tokens: np.ndarray) -> int:
    digest = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return digest - (1 << 64) if digest >> 63 else digest


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens on each of a power of two of bits, as many as tokens at least."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    return np.packbits((np.bincount(tokens & (bits - 1), minlength=bits) & 1).astype(bool)).tobytes()


def may_link(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """False only if the sketches prove that the sets do not link."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    differ = int(np.bitwise_count(x ^ y).sum())
    return (100 + percent) * ((na + nb - differ) // 2) >= percent * (na + nb)


def at_least(percent: int, n: int) -> int:
    """Smallest overlap with a set of n that can link."""
    return -(-percent * n // 100)


class TokenGroups:
    """Token-group matrix of a chunk: groups of linked sets and the union of each group's shingles."""

    def __init__(self, percent: int):
        self._percent = percent
        self._ids: list[list[int]] = []  # members of each group
        self._sets: list[list[np.ndarray]] = []
        self._groups_of: dict[int, list[int]] = defaultdict(list)  # the matrix, by token
        self._unions: list[set[int]] = []
        self._now: list[int] = []  # group that a group has become part of

    def _current(self, g: int) -> int:
        while self._now[g] != g:
            self._now[g] = g = self._now[self._now[g]]
        return g

    def linked(self, tokens: np.ndarray) -> list[tuple[int, int]]:
        """Groups with a set that links with ``tokens``, and that set's id."""
        listed, n, out = tokens.tolist(), len(tokens), []
        need = at_least(self._percent, n)
        # a group that reaches the bound holds one of any n - need + 1 shingles: the rarest are asked for
        rare = sorted(listed, key=lambda t: len(self._groups_of.get(t, ())))[: n - need + 1]
        every = set(listed)
        for g in {self._current(g) for t in rare for g in self._groups_of.get(t, ())}:
            if len(self._unions[g] & every) < need:
                continue
            for i, other in zip(self._ids[g], self._sets[g]):
                m = len(other)
                if 100 * min(n, m) >= self._percent * max(n, m):
                    both = len(np.intersect1d(tokens, other, assume_unique=True))
                    if 100 * both >= self._percent * (n + m - both):
                        out.append((g, i))
                        break
        return out

    def add(self, sid: int, tokens: np.ndarray) -> list[int]:
        """Puts a set into the matrix; one id of each group it links with."""
        found = self.linked(tokens)
        if found:
            g = found[0][0]
        else:
            g = len(self._ids)
            self._ids.append([])
            self._sets.append([])
            self._unions.append(set())
            self._now.append(g)
        for other, _ in found[1:]:
            self._now[other] = g
            self._ids[g] += self._ids[other]
            self._sets[g] += self._sets[other]
            self._unions[g] |= self._unions[other]
            self._ids[other], self._sets[other], self._unions[other] = [], [], set()
        for t in tokens.tolist():
            if t not in self._unions[g]:
                self._unions[g].add(t)
                self._groups_of[t].append(g)
        self._ids[g].append(sid)
        self._sets[g].append(tokens)
        return [i for _, i in found]


class Column:
    """Sets of one column and which of them may link."""

    def __init__(self, sids: list[int], sizes: list[int], sketches: list[bytes], percent: int, known: dict[tuple[int, int], bool]):
        self._sids, self._n, self._percent, self._known = sids, np.array(sizes), percent, known
        self._sketches, self._tables = sketches, {}

    def _table(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose sketch, folded where it is longer, has this many bytes."""
        if size not in self._tables:
            rows, folded = [], []
            for i, s in enumerate(self._sketches):
                if len(s) in (size, 2 * size):
                    x = np.frombuffer(s, np.uint8)
                    rows.append(i)
                    folded.append(x if len(s) == size else x[:size] ^ x[size:])
            self._tables[size] = np.array(rows, np.int64), np.array(folded, np.uint8).reshape(len(rows), size)
        return self._tables[size]

    def hits(self, x: int) -> np.ndarray:
        """Rows that may link with row x."""
        out = np.zeros(len(self._n), bool)
        out[x] = True
        if len(self._n) <= 8:
            for y in range(len(self._n)):
                if y != x:
                    pair = (self._sids[x], self._sids[y]) if self._sids[x] < self._sids[y] else (self._sids[y], self._sids[x])
                    good = self._known.get(pair)
                    if good is None:
                        n, m = int(self._n[x]), int(self._n[y])
                        fits = 100 * min(n, m) >= self._percent * max(n, m)
                        good = self._known[pair] = fits and may_link(self._sketches[x], self._sketches[y], n, m, self._percent)
                    out[y] = good
            return out
        own, n = np.frombuffer(self._sketches[x], np.uint8), int(self._n[x])
        for size in {len(own), len(own) // 2} - {4}:
            rows, table = self._table(size)
            if len(rows):
                mine = own if size == len(own) else own[:size] ^ own[size:]
                differ = np.bitwise_count(table ^ mine).sum(1, dtype=np.int64)
                m = self._n[rows]
                out[rows] |= ((100 + self._percent) * ((n + m - differ) // 2) >= self._percent * (n + m)) & (100 * np.minimum(n, m) >= self._percent * np.maximum(n, m))
        return out

    def _block_hits(self, some: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of a row of ``some`` (sketches of one length) and a row that may link with it."""
        length = len(self._sketches[some[0]])
        own = np.frombuffer(b"".join(self._sketches[x] for x in some), np.uint8).reshape(len(some), length)
        for size in {length, length // 2} - {4}:
            rows, table = self._table(size)
            if not len(rows):
                continue
            mine = (own if size == length else own[:, :size] ^ own[:, size:]).copy().view(np.uint64)
            theirs = table.view(np.uint64)
            step = max(1, 4_000_000 // (mine.shape[1] * len(rows)))
            for at in range(0, len(some), step):
                differ = np.bitwise_count(mine[at : at + step, None, :] ^ theirs[None]).sum(2, dtype=np.int64)
                n, m = self._n[some[at : at + step]][:, None], self._n[rows][None]
                good = ((100 + self._percent) * ((n + m - differ) // 2) >= self._percent * (n + m)) & (100 * np.minimum(n, m) >= self._percent * np.maximum(n, m))
                for x, y in zip(*np.nonzero(good)):
                    yield int(some[at + x]), int(rows[y])

    def forest(self) -> Iterator[tuple[int, int]]:
        """Links that join all sets that may link."""
        count = len(self._n)
        label, pending = np.arange(count), np.ones(count, bool)
        for _ in range(count if count <= 32 else 16):
            classes, counts = np.unique(label[pending], return_counts=True)
            if len(classes) < 2:
                return
            x = int(np.flatnonzero(pending & (label == classes[np.argmin(counts)]))[0])
            pending[x] = False
            hit = self.hits(x)
            for other in np.unique(label[hit]):
                if other != label[x]:
                    yield self._sids[x], self._sids[int(np.flatnonzero(hit & (label == other))[0])]
                    label[label == other] = label[x]
        classes, counts = np.unique(label, return_counts=True)
        left = np.flatnonzero(pending & (label != classes[np.argmax(counts)]))  # all pairs but those of the largest class
        if len(left) * count <= TESTS:
            lengths = np.array([len(s) for s in self._sketches])
            for length in np.unique(lengths[left]):
                for x, y in self._block_hits(left[lengths[left] == length]):
                    if label[x] != label[y]:
                        yield self._sids[x], self._sids[y]
                        label[label == label[y]] = label[x]
            return
        for other in classes:
            if other != label[0]:
                yield self._sids[0], self._sids[int(np.flatnonzero(label == other)[0])]


def _column_links(percent: int):
    """Rows sorted by column: links of every column's forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], bool] = {}
        links: set[tuple[int, int]] = set()
        token, rows, held = None, [], 0

        def close_column() -> None:
            if len(rows) == 2:
                (a, n, x), (b, m, y) = rows
                pair = (a, b) if a < b else (b, a)
                good = known.get(pair)
                if good is None:
                    good = known[pair] = 100 * min(n, m) >= percent * max(n, m) and may_link(x, y, n, m, percent)
                if good:
                    links.add(pair)
            elif len(rows) > 2:
                links.update(Column(*map(list, zip(*rows)), percent, known).forest())

        def sent() -> pa.RecordBatch:
            a, b = zip(*links) if links else ((), ())
            return record_batches([("a", pa.int64(), list(a)), ("b", pa.int64(), list(b))])

        for batch in batches:
            for t, *row in zip(*(batch.column(c).to_pylist() for c in ("token", "sid", "n", "sketch"))):
                if t != token:
                    close_column()
                    token, rows, held = t, [], 0
                rows.append(row)
                held += len(row[2]) + 100
                if held > HELD:  # too large to hold: linked to its first set untested
                    links.update((rows[0][0], r[0]) for r in rows[1:])
                    rows, held = rows[:1], 0
            if len(links) > 50_000:
                yield sent()
                links.clear()
            if len(known) > 500_000:
                known.clear()
        close_column()
        yield sent()

    return run


def _decide(percent: int):
    """Rows sorted by cell, members before queries: links ``(a, b)`` that join all linked sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, seen, matrix = None, set(), TokenGroups(percent)
        links: list[tuple[int, int]] = []
        for batch in batches:
            tokens = batch.column("tokens")
            flat, at = tokens.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))]
            for j, (c, sid, asks) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("cell", "sid", "asks")))):
                if c != cell:
                    cell, seen, matrix = c, set(), TokenGroups(percent)
                if (sid, asks) in seen:
                    continue
                seen.add((sid, asks))
                own = flat[at[j] : at[j + 1]]
                found = [i for _, i in matrix.linked(own)] if asks else matrix.add(sid, own)
                links += [(sid, i) for i in found if i != sid]
            if len(links) > 50_000:
                yield record_batches([("a", pa.int64(), [a for a, _ in links]), ("b", pa.int64(), [b for _, b in links])])
                links = []
        yield record_batches([("a", pa.int64(), [a for a, _ in links]), ("b", pa.int64(), [b for _, b in links])])

    return run


def similar_classes(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row."""
    return _rows_with_classes(docs, k, percent, id_col, text_col).select("id", F.col("n").alias("n_shingles"), "component_id")


def _rows_with_classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, th, n, sid, cls, component_id)`` for every row; ``th`` hashes the text, ``cls`` is NULL without a set or an id."""
    if percent < 50:
        raise ValueError("sketches are compared with those of half and double their size only: percent from 50")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size and id of every set, and shingles frequent in what the task has read."""
        words, held, size, n_docs = Words(), [], 0, 0

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= max(4, _FREQUENT * n_docs)
            nothing = pa.nulls(int(some.sum()), pa.int64())
            return record_batches([("id", pa.int64(), nothing), ("th", pa.int64(), nothing), ("n", pa.int64(), pa.array(-counts[some])), ("sid", pa.int64(), pa.array(tokens[some])), ("sketch", pa.binary(), pa.nulls(int(some.sum()), pa.binary()))])

        for whole in batches:
            for b in slices(whole, 1024):
                sets = list(shingle_sets(words, text_bytes(b, "text"), k))
                yield record_batches([("id", pa.int64(), b.column("id")), ("th", pa.int64(), b.column("th")), ("n", pa.int64(), [len(s) for s in sets]), ("sid", pa.int64(), [set_id(s) for s in sets]), ("sketch", pa.binary(), [sketch(s) for s in sets])])
                held += sets
                size, n_docs = size + sum(map(len, sets)), n_docs + len(sets)
                if size > 6_000_000:
                    yield frequent()
                    held, size, n_docs = [], 0, 0
        if held:
            yield frequent()

    scanned = cut_lineage(src.mapInArrow(scan, "id bigint, th bigint, n bigint, sid bigint, sketch binary"))
    listed = scanned.where("n >= 0")
    n_docs = listed.count()
    # at most 2 * (mean set size) / _FREQUENT shingles can reach this sum
    often = scanned.where("n < 0").groupBy("sid").agg((-F.sum("n")).alias("c")).where(F.col("c") >= max(8, 0.5 * _FREQUENT * n_docs)).toPandas()
    often = often.sort_values(["c", "sid"])["sid"].to_numpy(np.int64)
    by_token = np.argsort(often)
    often_sent = docs.sparkSession.sparkContext.broadcast((often[by_token], by_token))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles each set sends to the matrix."""
        words, (known, rank) = Words(), often_sent.value
        for whole in batches:
            for b in slices(whole, 1024):
                out, sids, ns = [], [], []
                for i, s in zip(b.column("id").to_pylist(), shingle_sets(words, text_bytes(b, "text"), k)):
                    n = len(s)
                    if i is None or not n or (100 * n < percent * (n + 1) and 100 * (n - 1) < percent * n):
                        continue
                    keep = n - at_least(percent, n) + 1
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        late = known[at] == s
                        first = s[~late][:keep]
                        if len(first) < keep:
                            rest = s[late]
                            first = np.concatenate([first, rest[np.argsort(rank[at[late]])][: keep - len(first)]])
                    else:
                        first = s[:keep]
                    out.append(first)
                    sids.append(set_id(s))
                    ns.append(len(first))
                if out:
                    yield record_batches([("token", pa.int64(), pa.array(np.concatenate(out))), ("sid", pa.int64(), pa.array(np.repeat(np.array(sids, np.int64), ns)))])

    sent = cut_lineage(src.mapInArrow(columns, "token bigint, sid bigint"))
    shared = sent.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi").select("token")
    common = cut_lineage(sent.join(shared.hint("merge"), "token").distinct())
    release(sent)
    first = cut_lineage(listed.where("id is not null and n > 0").groupBy("sid").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    seats = common.join(first.select("sid", "n", "sketch").hint("merge"), "sid").select("token", "sid", "n", "sketch")
    edges = cut_lineage(seats.repartition("token").sortWithinPartitions("token").mapInArrow(_column_links(percent), "a bigint, b bigint").distinct())
    release(common)
    ends = edges.select(F.col("a").alias("sid")).unionByName(edges.select(F.col("b").alias("sid"))).distinct()
    families = close(ends, edges).withColumnRenamed("cls", "family")
    members = cut_lineage(families.join(first.select("sid", "n", "id").hint("merge"), "sid"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in batches:
            for b in slices(whole, 1024):
                sets = list(shingle_sets(words, text_bytes(b, "text"), k))
                good = [j for j, (s, want) in enumerate(zip(sets, b.column("sid").to_pylist())) if set_id(s) == want]
                offsets = np.r_[0, np.cumsum([len(sets[j]) for j in good])].astype(np.int32)
                flat = np.concatenate([sets[j] for j in good]) if good else np.empty(0, np.int64)
                yield record_batches([("sid", pa.int64(), b.column("sid").take(pa.array(good, pa.int64()))), ("family", pa.int64(), b.column("family").take(pa.array(good, pa.int64()))), ("tokens", pa.list_(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))])

    wanted = members.select("id", "sid", "family").hint("merge")
    whole = cut_lineage(src.join(wanted, "id").select("sid", "family", "text").mapInArrow(tokens, "sid bigint, family bigint, tokens array<bigint>"))
    large = cut_lineage(members.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(CHUNK)).alias("chunks")).where("chunks > 1"))

    def decided(rows: DataFrame) -> DataFrame:
        cells = rows.repartition("cell").sortWithinPartitions("cell", "asks")
        return cells.select("cell", "asks", "sid", "tokens").mapInArrow(_decide(percent), "a bigint, b bigint")

    cell = lambda *c: F.xxhash64("family", *c).alias("cell")
    numbers = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    dealt = whole.join(large, "family", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    place = F.when(F.col("sid") == F.col("family"), numbers("chunks")).otherwise(F.array(F.pmod(F.xxhash64(F.lit(3), "sid"), "chunks")))
    seated = dealt.select("family", "sid", "tokens", F.explode(place).alias("chunk"))
    links = cut_lineage(decided(seated.select(cell("chunk"), F.lit(False).alias("asks"), "sid", "tokens")))
    classes = close(members.select("sid"), links)

    if not large.isEmpty():  # what is not in a large family's largest class queries the unions of its chunks
        homes = classes.join(members.select("sid", "family", "n"), "sid").join(large, "family")
        counts = homes.groupBy("family", "cls").agg(F.count("*").alias("c"))
        main = counts.groupBy("family").agg(F.max_by("cls", F.struct("c", "cls")).alias("main"))
        outside = cut_lineage(homes.join(main, "family").where("cls <> main").select("family", "sid", "n"))
        copies = outside.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(QUERIES)).alias("copies"))
        held = seated.where((F.col("sid") != F.col("family")) | (F.col("chunk") == 0)).join(copies, "family")
        held = held.select("family", "chunk", "sid", "tokens", F.explode(numbers("copies")).alias("copy"), F.lit(False).alias("asks"))
        asking = whole.join(outside.select("sid"), "sid").join(copies, "family").join(large, "family")
        own_copy = F.pmod(F.xxhash64(F.lit(5), "sid"), "copies").alias("copy")
        asking = asking.select("family", F.explode(numbers("chunks")).alias("chunk"), "sid", "tokens", own_copy, F.lit(True).alias("asks"))
        more = cut_lineage(decided(held.unionByName(asking).select(cell("chunk", "copy"), "asks", "sid", "tokens")))
        classes = close(members.select("sid"), links.unionByName(more))
    release(whole)

    of_set = first.select("sid", "id").join(classes.hint("merge"), "sid", "left").select("sid", "id", F.coalesce("cls", "sid").alias("cls"))
    least = of_set.groupBy("cls").agg(F.min("id").alias("least"))
    of_set = of_set.join(least.hint("merge"), "cls").select("sid", "cls", "least")
    has = F.col("id").isNotNull() & (F.col("n") > 0)
    rows = listed.select("id", "th", "n", "sid").join(of_set.hint("merge"), "sid", "left")
    return rows.select("id", "th", "n", "sid", F.when(has, F.col("cls")).alias("cls"), F.when(has, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def close(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(sid, cls)``: connected components of the links over the nodes."""
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return components(nodes, both, [], "sid").withColumnRenamed("label", "cls")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that of the smallest id (of rows that repeat it, one with a text of the class); NULL ids stay.

    An id that occurs with texts of several classes is kept for each of them; without a set, rows of an id are one class.
    """
    found = _rows_with_classes(docs, k, percent, id_col, text_col).where("id is not null")
    alone = F.when(F.col("cls").isNull(), F.col("id"))
    keep = found.groupBy("cls", alone.alias("alone")).agg(F.min(F.struct("id", "th")).alias("x")).select("x.id", "x.th").distinct()
    plain, own = set_aside(docs, (id_col, text_col))
    key, th, rank = unused(plain, 3)
    keep = keep.select(F.col("id").alias(key), F.col("th").alias(th))
    with_id = plain.where(F.col(id_col).isNotNull()).withColumn(th, F.xxhash64(text_col)).withColumn(key, F.col(id_col).cast("long"))
    first = F.row_number().over(Window.partitionBy(key, th).orderBy(key))
    kept = with_id.join(keep.hint("merge"), [key, th], "left_semi").withColumn(rank, first).where(F.col(rank) == 1)
    return kept.select(*own).unionByName(docs.where(F.col(id_col).isNull()))
