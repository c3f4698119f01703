"""Line de-duplication: lines are exploded, hashed, counted over documents, dropped and put together again.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased.
Keys of at least ``min_chars`` code points held by two or more documents keep their lines only
in the document with the smallest id.

Only hashes travel: (key hash of 128 bits, id, position).  "Two documents or more" is
``min(id) < max(id)``, so a line found in every document is reduced to one row per task before
the shuffle.  The join back to the positions is a plain equi-join that adaptive execution splits.

Defined results: NULL or empty text is one empty line; a row with NULL id keeps all its lines and
counts for nothing; rows that repeat an id are one document (none of its lines count as shared
between its own rows); an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidex.llm.common import LOWER, SPACE, record_batches, slices, text_bytes

_LINE = "id bigint, th bigint, pos int, h1 bigint, h2 bigint"


def _line_keys(min_chars: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 512):
                ids, ths, poss, h1, h2 = [], [], [], [], []
                for i, th, text in zip(
                    batch.column("id").to_pylist(), batch.column("th").to_pylist(), text_bytes(batch, "text")
                ):
                    if i is None or not text:
                        continue
                    for pos, line in enumerate(text.translate(LOWER).split(b"\n")):
                        key = line.strip(SPACE)
                        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
                            continue
                        digest = xxhash.xxh3_128_digest(key)
                        ids.append(i)
                        ths.append(th)
                        poss.append(pos)
                        h1.append(int.from_bytes(digest[:8], "big", signed=True))
                        h2.append(int.from_bytes(digest[8:], "big", signed=True))
                yield record_batches(
                    [("id", pa.int64(), ids), ("th", pa.int64(), ths), ("pos", pa.int32(), poss), ("h1", pa.int64(), h1), ("h2", pa.int64(), h2)]
                )

    return explode


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 512):
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                n_dropped.append(len(gone or ()))
                if gone:
                    drop = set(gone)
                    lines = [x for i, x in enumerate(lines) if i not in drop]
                kept.append("\n".join(lines))
            yield record_batches(
                [("id", pa.int64(), batch.column("id")), ("kept", pa.string(), kept), ("n_lines", pa.int64(), n_lines), ("n_dropped", pa.int64(), n_dropped)]
            )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``(id, kept, n_lines, n_dropped)`` for every row of ``docs``; ``kept`` is the text that is left."""
    src = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
        F.col(text_col).alias("text"),
    )
    lines = src.mapInArrow(_line_keys(min_chars), _LINE)
    shared = lines.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    gone = (
        lines.join(shared.drop("hi"), ["h1", "h2"])
        .where("id > lo")
        .groupBy("id", "th")
        .agg(F.collect_set("pos").alias("gone"))
    )
    return src.join(gone, ["id", "th"], "left").select("id", "text", "gone").mapInArrow(
        _reassemble, "id bigint, kept string, n_lines bigint, n_dropped bigint"
    )
