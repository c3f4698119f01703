"""Near-duplicate classes from fast similarity sketches: hashed bins, banding, exact verification.

A document's set holds the 64-bit hashes of its distinct k-word shingles (all its words as one shingle when it has fewer).
Two documents link when ``100 * |x & y| >= percent * |x | y|``; the result is each document's class.

1. Sketch: in round r every shingle is hashed to one of ``BINS`` bins with the value (r, hash); a bin keeps its least value.  Rounds go on until
   all bins are filled, which for large sets is one or two; after ``BINS`` rounds, round ``BINS + j`` sends every shingle to bin j, so every
   bin fills.  A bin agrees in two sketches with probability J, and the share of bins that agree is concentrated about J as if bins were independent.
2. Banding: equal sets are one; a set is listed in a bucket for each of its bands of ``ROWS`` bins.  A pair at J = 0.8 shares no bucket with probability
   (1 - 0.8^5)^51 < 2e-9.
3. One sorted stream over the buckets compares the sketches' low bits (one of each bin) and drops what is more than six standard deviations off ``percent``.
   A bucket sends a spanning forest of what is left, found with pivots: no pairs of a bucket are emitted.  Its first set is its least, so that
   the buckets that hold the same sets send the same links.
   Buckets of more than ``CROWD`` sets, or ``PIVOTS`` pivots, link what is left to the first set untested; that only makes families larger.
4. Families are the components of these forests; pairs that link lie in one family.  Full sets are fetched once per family and all pairs of a family are decided on them:
   pivots against an inverted list, until all members that were no pivot are in one class.
5. A family of more than ``chunk`` shingles is dealt to chunks, each with the family's first set; then its members outside its largest class
   query all its chunks.

Joins on sets and ids are merge joins at every size, so small inputs run the plan that large ones need.

Hashes stand for words, shingles and sets and are not checked for collisions.

Defined results: NULL, empty or white-space text has no set and is its own class; a NULL id links with nothing, gets a NULL class and is kept;
repeated rows join one class; rows that repeat an id with another text are judged by their own text; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidex.llm.brownlm import Words
from incidex.llm.common import mix64, record_batches, slices, text_bytes
from incidex.llm.jaccard import close, set_id, shingle_sets
from incidex.session import cut_lineage, release

BINS = 256
ROWS = 5
BANDS = BINS // ROWS
CHUNK = 2_000_000  # shingles of the members compared in one task, and of the queries sent to one copy of them
CROWD = 65_536
PIVOTS = 64
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORDS = [f"s{j}" for j in range(BINS // 64)]


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` values for each set; sets without shingles keep empty bins.  ``bins`` is a power of two up to 256."""
    out = np.full((len(sets), bins), _EMPTY)
    active = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(active):
        return out
    sizes = np.array([len(sets[i]) for i in active])
    tokens = np.concatenate([sets[i] for i in active]).view(np.uint64)
    owner, flat = np.repeat(active, sizes), out.reshape(-1)
    for r in range(2 * bins):
        h = mix64(tokens + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        to = (h & np.uint64(bins - 1)).astype(np.int64) if r < bins else r - bins
        np.minimum.at(flat, owner * bins + to, np.uint64(r << 54) | h >> np.uint64(10))
        done = (out[active] != _EMPTY).all(1)
        if done.any():
            left = np.zeros(len(sets), bool)
            left[active[~done]] = True
            some = left[owner]
            tokens, owner, active = tokens[some], owner[some], active[~done]
            if not len(active):
                break
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """Bucket of each band of each sketch."""
    parts = sketch[:, : BANDS * ROWS].reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for j in range(ROWS):
        key = mix64(mix64(key) ^ parts[:, :, j])
    return key.view(np.int64)


def low_bits(sketch: np.ndarray) -> np.ndarray:
    """The lowest bit of every bin, 64 to a number."""
    return np.packbits((sketch & np.uint64(1)).astype(bool), axis=1).view(np.int64)


def most_apart(percent: int) -> int:
    """Low bits in which two sets that link differ at most, but for six standard deviations."""
    q = (1 - percent / 100) / 2
    return math.ceil(BINS * q + 6 * math.sqrt(BINS * q * (1 - q)))


def may_link_another(n: int, percent: int) -> bool:
    """Whether a set of n can link with one that is not equal."""
    return 100 * n >= percent * (n + 1) or 100 * (n - 1) >= percent * n


def maybe(n: np.ndarray, bits: np.ndarray, x: int | np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows x and y may link, by their sizes and sketches."""
    apart = np.bitwise_count(bits[x] ^ bits[y]).sum(-1)
    return (apart <= most_apart(percent)) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))


def forest(n: np.ndarray, bits: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join all rows of a bucket that may link, given what is joined already (``label``; row 0 has been compared with all)."""
    links, rows = [], np.arange(len(n))
    pending = rows > 0
    for _ in range(PIVOTS):
        classes, counts = np.unique(label[pending], return_counts=True)
        if len(classes) < 2:
            return links
        x = int(np.flatnonzero(pending & (label == classes[np.argmin(counts)]))[0])
        pending[x] = False
        hit = maybe(n, bits, x, rows, percent)
        for other in np.unique(label[hit]):
            if other != label[x]:
                links.append((x, int(np.flatnonzero(hit & (label == other))[0])))
                label[label == other] = label[x]
    classes, first = np.unique(label, return_index=True)
    links += [(0, int(y)) for c, y in zip(classes, first) if c != label[0]]
    return links


def overlaps(tokens: np.ndarray, sorted_tokens: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Size of the intersection of ``tokens`` with each of n sets, given as one inverted list."""
    lo, hi = np.searchsorted(sorted_tokens, tokens, "left"), np.searchsorted(sorted_tokens, tokens, "right")
    size = hi - lo
    total = int(size.sum())
    if not total:
        return np.zeros(n, np.int64)
    at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    return np.bincount(owners[at], minlength=n)


def chunk_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all linked members of a chunk; every pair is decided."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    tokens, owners = flat[order], np.repeat(np.arange(n), sizes)[order]
    label, pending, links = np.arange(n), np.ones(n, bool), []
    while pending.any():
        classes, counts = np.unique(label[pending], return_counts=True)
        if len(classes) == 1:
            break
        rare = classes[np.argmin(counts)]
        x = int(np.flatnonzero(pending & (label == rare))[0])
        pending[x] = False
        both = overlaps(sets[x], tokens, owners, n)
        hit = 100 * both >= percent * (sizes[x] + sizes - both)
        for other in np.unique(label[hit]):
            if other != label[x]:
                y = int(np.flatnonzero(hit & (label == other))[0])
                links.append((int(ids[x]), int(ids[y])))
                label[label == other] = label[x]
    return links


def _bucket_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # bucket, sid, n and bits of the bucket that may go on
        crowded = False  # only the first row of that bucket is held

        def links_of(part: list[np.ndarray]) -> np.ndarray:
            bucket, sid, n, bits = part
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            size = np.diff(np.r_[start, len(bucket)])
            head = np.repeat(start, size)
            rest = np.flatnonzero(head != np.arange(len(bucket)))
            good = maybe(n, bits, head[rest], rest, percent)
            out = [np.stack([sid[head[rest[good]]], sid[rest[good]]], 1)]
            joined = np.ones(len(bucket), bool)
            joined[rest[~good]] = False
            for s in np.unique(head[rest[~good]]):
                e = s + int(size[np.searchsorted(start, s)])
                if e - s > 2:
                    label = np.where(joined[s:e], 0, np.arange(e - s))
                    more = forest(n[s:e], bits[s:e], label, percent)
                    out.append(sid[s:e][np.array(more, np.int64).reshape(-1, 2)])
            return np.unique(np.concatenate(out), axis=0)

        def sent(pairs: np.ndarray) -> pa.RecordBatch:
            return record_batches([("a", pa.int64(), pa.array(pairs[:, 0])), ("b", pa.int64(), pa.array(pairs[:, 1]))])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "sid", "n", *_WORDS)]
            part = [*cols[:3], np.stack(cols[3:], 1).view(np.uint64)]
            if crowded:
                on = part[0] == held[0][0]
                yield sent(np.stack([np.repeat(held[1], on.sum()), part[1][on]], 1))
                part = [c[~on] for c in part]
                if not len(part[0]):
                    continue
                crowded, held = False, []
            if held:
                part = [np.concatenate(c) for c in zip(held, part)]
            last = int(np.searchsorted(part[0], part[0][-1]))
            if last:
                yield sent(links_of([c[:last] for c in part]))
            held = [c[last:] for c in part]
            if len(held[0]) > CROWD:
                yield sent(np.stack([np.repeat(held[1][:1], len(held[1]) - 1), held[1][1:]], 1))
                held, crowded = [c[:1] for c in held], True
        if held and not crowded:
            yield sent(links_of(held))

    return run


def _decide(percent: int):
    """Rows sorted by cell, members before queries: links ``(a, b)`` that join all linked rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, seen, ids, sets, index = None, set(), [], [], None
        a: list[int] = []
        b: list[int] = []

        def close_cell() -> None:
            if index is None and len(ids) > 1:
                for x, y in chunk_links(np.array(ids, np.int64), sets, percent):
                    a.append(x)
                    b.append(y)

        for batch in batches:
            tokens = batch.column("tokens")
            flat, at = tokens.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))]
            for j, (c, sid, asks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cell", "sid", "asks")))):
                if c != cell:
                    close_cell()
                    cell, seen, ids, sets, index = c, set(), [], [], None
                if (sid, asks) in seen:
                    continue
                seen.add((sid, asks))
                own = flat[at[j] : at[j + 1]]
                if not asks:
                    ids.append(sid)
                    sets.append(own)
                    continue
                if index is None:
                    sizes = np.array([len(s) for s in sets], np.int64)
                    every = np.concatenate(sets)
                    order = np.argsort(every, kind="stable")
                    index = sizes, every[order], np.repeat(np.arange(len(sets)), sizes)[order], np.arange(len(sets))
                sizes, every, owners, label = index
                both = overlaps(own, every, owners, len(ids))
                hit = np.flatnonzero(100 * both >= percent * (len(own) + sizes - both))
                for first in np.unique(label[hit]):  # one link to each class that the links of this cell have made so far
                    a.append(sid)
                    b.append(ids[first])
                if len(hit):
                    label[np.isin(label, label[hit])] = label[hit].min()
            if len(a) > 50_000:
                yield record_batches([("a", pa.int64(), a), ("b", pa.int64(), b)])
                a, b = [], []
        close_cell()
        yield record_batches([("a", pa.int64(), a), ("b", pa.int64(), b)])

    return run


def similar_classes(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in batches:
            for b in slices(whole, 512):
                sets = list(shingle_sets(words, text_bytes(b, "text"), k))
                # small sets that link with equal ones only need no sketch
                some = [s if may_link_another(len(s), percent) else s[:0] for s in sets]
                found = sketches(some)
                bits, buckets = low_bits(found), bands(found)
                full = np.array([len(s) > 0 for s in some], bool)
                cuts = np.r_[0, np.cumsum(np.where(full, BANDS, 0))].astype(np.int32)
                yield record_batches(
                    [("id", pa.int64(), b.column("id")), ("n", pa.int64(), [len(s) for s in sets]), ("sid", pa.int64(), [set_id(s) for s in sets])]
                    + [(c, pa.int64(), pa.array(np.ascontiguousarray(bits[:, j]))) for j, c in enumerate(_WORDS)]
                    + [("buckets", None, pa.ListArray.from_arrays(pa.array(cuts), pa.array(buckets[full].reshape(-1))))]
                )

    kinds = f"id bigint, n bigint, sid bigint, {', '.join(f'{c} bigint' for c in _WORDS)}, buckets array<bigint>"
    scanned = cut_lineage(src.mapInArrow(scan, kinds))
    # one row per set, with its least id
    first = scanned.where("id is not null and n > 0").groupBy("sid").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", *_WORDS, "buckets")])
    first = cut_lineage(first)

    seats = first.select(F.explode("buckets").alias("bucket"), "sid", "n", *_WORDS)
    pairs = seats.repartition("bucket").sortWithinPartitions("bucket", "sid").mapInArrow(_bucket_links(percent), "a bigint, b bigint")
    edges = cut_lineage(pairs.distinct())
    ends = edges.select(F.col("a").alias("sid")).unionByName(edges.select(F.col("b").alias("sid"))).distinct()
    families = close(ends, edges).withColumnRenamed("cls", "family")
    members = cut_lineage(families.join(first.select("sid", "n", "id").hint("merge"), "sid"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in batches:
            for b in slices(whole, 512):
                sets = list(shingle_sets(words, text_bytes(b, "text"), k))
                good = [j for j, (s, want) in enumerate(zip(sets, b.column("sid").to_pylist())) if set_id(s) == want]
                cuts = np.r_[0, np.cumsum([len(sets[j]) for j in good])].astype(np.int32)
                flat = np.concatenate([sets[j] for j in good]) if good else np.empty(0, np.int64)
                took = pa.array(good, pa.int64())
                yield record_batches(
                    [("sid", pa.int64(), b.column("sid").take(took)), ("family", pa.int64(), b.column("family").take(took)), ("tokens", None, pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)))]
                )

    fetched = src.join(members.select("id", "sid", "family").hint("merge"), "id").select("sid", "family", "text").mapInArrow(tokens, "sid bigint, family bigint, tokens array<bigint>")
    sizes = members.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(chunk)).alias("chunks"))
    large = cut_lineage(sizes.where("chunks > 1"))
    whole = cut_lineage(fetched)

    def decided(rows: DataFrame) -> DataFrame:
        cells = rows.repartition("cell").sortWithinPartitions("cell", "asks")
        return cells.select("cell", "asks", "sid", "tokens").mapInArrow(_decide(percent), "a bigint, b bigint")

    cell = lambda *c: F.xxhash64("family", *c).alias("cell")
    dealt = whole.join(large, "family", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    place = F.when(F.col("sid") == F.col("family"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64(F.lit(3), "sid"), "chunks")))
    seated = dealt.select("family", "sid", "tokens", F.explode(place).alias("chunk"))
    links = cut_lineage(decided(seated.select(cell("chunk"), F.lit(False).alias("asks"), "sid", "tokens")))
    classes = close(members.select("sid"), links)

    if not large.isEmpty():  # what is not in a large family's largest class queries its chunks
        homes = classes.join(members.select("sid", "family", "n"), "sid").join(large, "family")
        counts = homes.groupBy("family", "cls").agg(F.count("*").alias("c"))
        main = counts.groupBy("family").agg(F.max_by("cls", F.struct("c", "cls")).alias("main"))
        outside = cut_lineage(homes.join(main, "family").where("cls <> main").select("family", "sid", "n"))
        copies = outside.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(chunk)).alias("copies"))
        numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        held = seated.where((F.col("sid") != F.col("family")) | (F.col("chunk") == 0)).join(copies, "family").select("family", "chunk", "sid", "tokens", numbers("copies").alias("copy"))
        asking = whole.join(outside.select("sid"), "sid").join(copies, "family").join(large, "family")
        asking = asking.select("family", numbers("chunks").alias("chunk"), "sid", "tokens", F.pmod(F.xxhash64(F.lit(5), "sid"), "copies").alias("copy"))
        both = held.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True)))
        more = cut_lineage(decided(both.select(cell("chunk", "copy"), "asks", "sid", "tokens")))
        classes = close(members.select("sid"), links.unionByName(more))
    release(whole)

    of_set = first.select("sid", "id").join(classes.hint("merge"), "sid", "left").select("sid", "id", F.coalesce("cls", "sid").alias("cls"))
    least = of_set.groupBy("cls").agg(F.min("id").alias("least"))
    of_set = of_set.join(least.hint("merge"), "cls").select("sid", "least")
    own = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("least")).otherwise(F.col("id"))
    listed = scanned.select("id", "n", "sid").join(of_set.hint("merge"), "sid", "left").select("id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return listed.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
