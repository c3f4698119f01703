"""Spelling variants: words one edit apart, found with a bit-sliced position index, and their most frequent form.

Two words are near if one inserted, deleted or replaced code point turns one into the other.  Of a pair let x be the shorter
(or either), m its length and p the length of the common beginning; then x and y are equal before p and, but for the edit, after it.

1. Words meet in blocks.  A block ``(m, lo, hi)`` holds words of m and m + 1 letters that agree on all before ``lo`` and all after ``hi``
   (counted in the shorter word); a pair belongs to the block whose range has its p.  The ranges of a length are its two
   halves; blocks of more than ``block`` words are halved again, down to one position, where a block has at most one word per letter or pair of letters.
2. In a block every (position, letter) has a bitset over the block's words.  For each word x of m letters three sets are carried
   through the range, all words of the block at once:

       zero' = zero & B[i, x_i]
       replaced' = (replaced & B[i, x_i]) | (zero & ~B[i, x_i])
       inserted' = (inserted | zero) & B[i + 1, x_i]

   ``replaced`` among the words of m letters and ``inserted`` (and ``zero``: one more letter at the end) among those of m + 1 are x's partners.
   Words of a block are numbered by falling frequency, so the lowest bit is the most frequent partner.
3. A block sends one row per word: number of partners and the best one; no pairs are made.  The form of a word is its best partner if that is
   ``factor`` times as frequent.  Forms grow by that factor, so roots are reached by pointer doubling in a number of rounds known beforehand.

Words that are only counted never reach the driver; tasks hold one block and a bounded table of counts.

Defined results: NULL and empty texts have no words; a NULL id is written as no characters; rows that repeat an id count
like others; words of one length that tie in frequency are ordered by code points; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidex.llm.common import LOWER, record_batches, text_bytes
from incidex.session import cut_lineage

LETTERS = "A-Za-zÀ-ÿ"
_COUNTS = 400_000  # distinct words a task counts before it sends them


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, slip: int = 0) -> DataFrame:
    """``(word, n)`` for runs of letters of at least ``min_chars``, A-Z lower-cased.

    With ``slip``, a run loses the code point ``h % length`` where h, the crc32 of ``id:run``, is a multiple of ``slip``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, counts = re.compile(f"[{LETTERS}]{{{min_chars},}}").findall, Counter()

        def flush() -> pa.RecordBatch:
            return record_batches([("word", pa.string(), list(counts)), ("n", pa.int64(), list(counts.values()))])

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), text_bytes(batch, "text")):
                if not text:
                    continue
                found = Counter(runs(text.translate(LOWER).decode()))
                if slip:
                    start = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for run in list(found):
                        h = zlib.crc32(run.encode(), start)
                        if h % slip == 0:
                            at, times = h % len(run), found.pop(run)
                            if len(run) > min_chars:
                                counts[run[:at] + run[at + 1 :]] += times
                counts.update(found)
                if len(counts) > _COUNTS:
                    yield flush()
                    counts.clear()
        yield flush()

    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def near_in_block(words: list[str], m: int, lo: int, hi: int) -> tuple[list[int], list[int]]:
    """Partners of every word of a block, and the first of them (-1 for none), in the order given."""
    index: dict[tuple[int, str], int] = {}
    plain = longer = 0
    for j, w in enumerate(words):
        bit = 1 << j
        if len(w) == m:
            plain |= bit
        else:
            longer |= bit
        for p in range(lo, min(hi + 1, len(w))):
            index[p, w[p]] = index.get((p, w[p]), 0) | bit
    partners, first = [0] * len(words), [-1] * len(words)
    get, everyone = index.get, plain | longer
    for j, x in enumerate(words):
        if len(x) != m:
            continue
        zero, replaced, inserted = everyone, 0, 0
        for i in range(lo, hi):
            here = get((i, x[i]), 0)
            inserted = (inserted | zero) & get((i + 1, x[i]), 0)
            same = zero & here
            replaced = (replaced & here) | (zero ^ same)
            zero = same
        # a longer word that agrees up to hi has its edit there: it belongs to the next range, if there is one
        inserted = (inserted | zero if hi == m else inserted & ~zero) & longer
        found = (replaced & plain) | inserted
        if not found:
            continue
        partners[j] += found.bit_count()
        best = (found & -found).bit_length() - 1
        if first[j] < 0 or best < first[j]:
            first[j] = best
        while inserted:
            low = inserted & -inserted
            y = low.bit_length() - 1
            partners[y] += 1
            if first[y] < 0 or j < first[y]:
                first[y] = j
            inserted ^= low
    return partners, first


def _ranges(extra: int) -> Column:
    """Both halves of the word, read as one of m letters (``extra`` = 0) or m + 1."""
    m = F.length("word") - extra
    half = F.floor(m / 2).cast("int")
    span = lambda lo, hi: F.struct(m.alias("m"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    return F.array(span(F.lit(0), half), span(half, m))


def _block_key() -> Column:
    behind = F.substring("word", F.col("hi") + F.length("word") - F.col("m") + 1, F.length("word"))
    return F.concat_ws("|", "m", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), behind)


def blocks(words: DataFrame, block: int) -> DataFrame:
    """``(key, word, n, m, lo, hi)``: every word in the blocks of its ranges, none of them too large."""
    spans = F.explode(F.concat(_ranges(0), _ranges(1))).alias("r")
    open_ = words.select("word", "n", spans).select("word", "n", "r.m", "r.lo", "r.hi").withColumn("key", _block_key())
    done = []
    while True:
        hot = open_.groupBy("key").agg(F.count("*").alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        hot = cut_lineage(hot.where((F.col("c") > block) & (F.col("hi") - F.col("lo") > 1)).select("key"))
        if hot.isEmpty():
            done.append(open_)
            break
        done.append(open_.join(hot, "key", "left_anti"))
        half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        sides = F.explode(F.array(F.struct("lo", half.alias("hi")), F.struct(half.alias("lo"), "hi"))).alias("r")
        open_ = open_.join(hot, "key", "left_semi").select("word", "n", "m", sides).select("word", "n", "m", "r.lo", "r.hi").withColumn("key", _block_key())
        open_ = cut_lineage(open_)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("key", "word", "n", "m", "lo", "hi")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: ``(word, k, best_n, best)`` for the words that have partners."""
    out: list[tuple] = []
    key, members, span = None, [], None

    def search() -> None:
        if len(members) < 2:
            return
        members.sort(key=lambda r: (-r[1], r[0]))
        words = [w for w, _ in members]
        partners, first = near_in_block(words, *span)
        out.extend((w, k, members[f][1], words[f]) for w, k, f in zip(words, partners, first) if k)

    def flush() -> pa.RecordBatch:
        word, k, best_n, best = zip(*out) if out else ((), (), (), ())
        return record_batches([("word", pa.string(), list(word)), ("k", pa.int64(), list(k)), ("best_n", pa.int64(), list(best_n)), ("best", pa.string(), list(best))])

    for batch in batches:
        for k, w, n, *s in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "m", "lo", "hi"))):
            if k != key:
                search()
                key, members, span = k, [], s
            members.append((w, n))
        if len(out) > 10_000:
            yield flush()
            out = []
    search()
    yield flush()


def near_words(words: DataFrame, block: int = 4096) -> DataFrame:
    """``(word, n_near, best, best_n)`` for the words of ``words(word, n)`` that have near words."""
    dealt = blocks(words, block).repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_search, "word string, k bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def spelling_forms(words: DataFrame, factor: int = 10, block: int = 4096) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``words(word, n)``; words are distinct."""
    words = cut_lineage(words)
    found = near_words(words, block)
    is_form = F.col("best_n") >= factor * F.col("n")
    formed = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    formed = cut_lineage(formed)
    most, least = formed.agg(F.max("n"), F.min("n")).first()
    steps = math.log(most / least, factor) if most else 0
    up = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1.0, steps))) + 1 if steps else 0):
        above = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        up = cut_lineage(up.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root")))
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
