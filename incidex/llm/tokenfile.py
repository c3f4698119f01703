"""Token-id shards with a minimal perfect hash index.

A shard file holds, in order: the magic, all ids as little-endian unsigned integers (16 bits where the whole vocabulary
fits, else 32), and an index: per document its length; the levels of a minimal perfect hash over the document keys; for each hash slot a
32-bit fingerprint and the document's number in the shard; the keys; and a trailer with the sizes.  A
lookup hashes the key through the levels, takes the slot's rank, compares the stored fingerprint and goes
to the offset: constant time, no search.

The hash is built in levels: at each level every key left over hashes into a bit table of ``GAMMA`` times
their number; keys alone on their bit stay there, the others go on.  A slot is the rank of a bit.

Shards are ranges of the wanted order, written by tasks under names that hold the task attempt; only
finished tasks report theirs, so a lost executor leaves an orphan file at most.  A running total over the
short list of shards gives each document its place in the whole stream.

Defined results: NULL text is an empty document (just the end id); rows with NULL key come first; keys may
repeat (rows of one key are told apart by their ordinal in the shard); an empty table gives no shards
and no rows; further columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidex.llm.common import file_system, mix64, one_row_each, record_batches, shared_folder, slices
from incidex.session import cut_lineage

MAGIC = b"TIDSHRD2"
GAMMA = 2
_NULL_KEY = -(1 << 63)
_MARKS = ".,;:!?%$#*&"
_MEMO = 1_400_000  # pieces kept per task; a full memo is emptied, results do not change


class WordEncoder:
    """Encodes texts by encoding each distinct piece between spaces once.

    Right for tokenizers that drop white space and never merge across it, lower-case letter by letter, and
    part a run of letters from the marks after it: ``Word,`` is ``word`` and ``,``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        self._tokenizer = Tokenizer.from_file(path)
        self._memo: dict[str, bytes] = {}

    def width(self, *more: int) -> int:
        """Bytes of an id."""
        return 2 if max(self._tokenizer.get_vocab_size() - 1, *more) < 1 << 16 else 4

    @staticmethod
    def _parts(piece: str) -> tuple[str, str]:
        """The piece without closing marks and in lower case, where that changes no id; and the marks."""
        core = piece.rstrip(_MARKS)
        mark = piece[len(core) :]
        if not core.isalpha():
            return piece, ""
        return (core if core.islower() or "\u03a3" in core or "\u0130" in core else core.lower()), mark

    def _learn(self, pieces: set[str], width: int) -> None:
        memo = self._memo
        parts = {p: self._parts(p) for p in pieces}
        cores = list({x for pair in parts.values() for x in pair if x not in memo})
        for core, e in zip(cores, self._tokenizer.encode_batch_fast(cores, add_special_tokens=False)):
            memo[core] = np.array(e.ids, f"<u{width}").tobytes()
        for piece, (core, mark) in parts.items():
            memo[piece] = memo[core] + memo[mark]

    def ids(self, text: str, width: int = 4) -> bytes:
        """Little-endian ids of a text; one width to an encoder."""
        pieces, memo = text.replace("\n", " ").split(" "), self._memo
        if len(memo) > _MEMO:
            memo.clear()
        try:
            return b"".join(map(memo.__getitem__, pieces))
        except KeyError:
            self._learn({p for p in pieces if p not in memo}, width)
            return b"".join(map(memo.__getitem__, pieces))


def _levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit tables of the minimal perfect hash of distinct 64-bit keys."""
    tables = []
    while len(keys):
        size = GAMMA * len(keys) + 1
        bit = (mix64(keys + np.uint64(len(tables) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)
        hits = np.bincount(bit, minlength=size)
        tables.append(hits == 1)
        keys = keys[hits[bit] != 1]
    return tables


def _slots(tables: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 where no level takes it."""
    slot, base = np.full(len(keys), -1, np.int64), 0
    todo = np.arange(len(keys))
    for level, bits in enumerate(tables):
        bit = (mix64(keys[todo] + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(len(bits))).astype(np.int64)
        here = bits[bit]
        rank = np.cumsum(bits) - 1
        slot[todo[here]] = base + rank[bit[here]]
        base += int(rank[-1]) + 1
        todo = todo[~here]
    return slot


def _hash_keys(keys: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    return mix64(keys.view(np.uint64) + mix64(ordinals.astype(np.uint64) + np.uint64(1)))


def _fingerprints(hashed: np.ndarray) -> np.ndarray:
    return (mix64(hashed ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype("<u4")


def _ordinals(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each key."""
    order = np.argsort(keys, kind="stable")
    first = np.r_[True, keys[order][1:] != keys[order][:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - start
    return out


def index_bytes(keys: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    hashed = _hash_keys(keys, _ordinals(keys))
    tables = _levels(hashed)
    slot = _slots(tables, hashed)
    prints, numbers = np.empty(len(keys), "<u4"), np.empty(len(keys), "<u4")
    prints[slot], numbers[slot] = _fingerprints(hashed), np.arange(len(keys))
    sizes = np.array([len(t) for t in tables], "<u8")
    bits = b"".join(np.packbits(t).tobytes() for t in tables)
    parts = [lengths.astype("<u8").tobytes(), sizes.tobytes(), bits, prints.tobytes(), numbers.tobytes(), keys.astype("<i8").tobytes()]
    return b"".join(parts) + struct.pack("<QQQQ", width, len(keys), len(tables), len(bits)) + MAGIC


class Shard:
    """Keyed access to one shard file."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self._file = system.open_input_file(path)
        size = self._file.size()
        self.width, n, levels, n_bits = struct.unpack("<QQQQ", self._file.read_at(32, size - 40))
        if self._file.read_at(8, 0) != MAGIC or self._file.read_at(8, size - 8) != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        index_size = 8 * n + 8 * levels + n_bits + 4 * n + 4 * n + 8 * n
        raw = self._file.read_at(index_size, size - 40 - index_size)
        at = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.lengths = take("<u8", n).astype(np.int64)
        sizes = take("<u8", levels).astype(np.int64)
        self._tables = [np.unpackbits(take("u1", -(-int(s) // 8)), count=int(s)).astype(bool) for s in sizes]
        self._prints, self._numbers, self.keys = take("<u4", n), take("<u4", n), take("<i8", n).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def find(self, keys: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
        """Document number of each (key, ordinal); -1 if the fingerprint says it is not there."""
        hashed = _hash_keys(np.asarray(keys, np.int64), ordinals)
        slot = _slots(self._tables, hashed)
        if not len(self._prints):
            return slot
        good = (slot >= 0) & (self._prints[np.maximum(slot, 0)] == _fingerprints(hashed))
        return np.where(good, self._numbers[np.maximum(slot, 0)].astype(np.int64), -1)

    def payload(self, number: int) -> bytes:
        """The ids of one document as unsigned 32-bit integers."""
        raw = self._file.read_at(int(self.lengths[number]) * self.width, 8 + int(self.starts[number]) * self.width)
        return raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", order: list | None = None, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encodes and writes every row, about ``shard_bytes`` of text to a shard; returns the list of shards ``(path, shard, n_docs, n_tokens)``.

    The stream is ordered by ``order`` (columns; the key alone by default), then by key.
    """
    folder = shared_folder(docs.sparkSession, "tokens")
    by = [F.col(f"o{i}") for i in range(len(order or []))] + [F.col("key")]
    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *[c.alias(f"o{i}") for i, c in enumerate(order or [])])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder = TaskContext.get(), WordEncoder(tokenizer)
        uri = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.tid"
        system, path = file_system(uri)
        width = encoder.width(end_id)
        end, out, keys, lengths = end_id.to_bytes(width, "little"), None, [], []
        for batch in batches:
            for part in slices(batch, 256):
                keys.append(np.array([_NULL_KEY if k is None else k for k in part.column("key").to_pylist()], np.int64))
                for body in part.column("text").to_pylist():
                    if out is None:
                        out = system.open_output_stream(path, compression=None)
                        out.write(MAGIC)
                    ids = (encoder.ids(body, width) if body else b"") + end
                    out.write(ids)
                    lengths.append(len(ids) // width)
        if out is not None:
            out.write(index_bytes(np.concatenate(keys), np.array(lengths, np.int64), width))
            out.close()
            yield record_batches([("path", pa.string(), [uri]), ("shard", pa.int64(), [task.partitionId()]), ("n_docs", pa.int64(), [len(lengths)]), ("n_tokens", pa.int64(), [sum(lengths)])])

    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = src.repartitionByRange(max(1, -(-size // shard_bytes)), *by).sortWithinPartitions(*by).select("key", "text")
    return cut_lineage(ranged.mapInArrow(write, "path string, shard bigint, n_docs bigint, n_tokens bigint"))


def read_shards(shards: DataFrame, ids: bool = False) -> DataFrame:
    """One row per document, fetched by key through each shard's index: ``key, shard, start, n_tokens, ids_crc32``
    (and the raw ``ids`` if asked for)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    listed = shards.select("path", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, number, base in zip(*(batch.column(c).to_pylist() for c in ("path", "shard", "base"))):
                shard = Shard(uri)
                found = shard.find(shard.keys, _ordinals(shard.keys))
                if (found < 0).any():
                    raise ValueError(f"{uri}: a key is missing from the index")
                for at in range(0, len(found), 1024):
                    some = found[at : at + 1024]
                    raw = [shard.payload(i) for i in some]
                    yield record_batches([
                        ("key", pa.int64(), pa.array([None if k == _NULL_KEY else int(k) for k in shard.keys[at : at + 1024]], pa.int64())),
                        ("shard", pa.int64(), [number] * len(some)),
                        ("start", pa.int64(), pa.array(base + shard.starts[some])),
                        ("n_tokens", pa.int64(), pa.array(shard.lengths[some])),
                        ("ids_crc32", pa.int64(), [zlib.crc32(x) for x in raw]),
                        ("ids", pa.binary(), raw if ids else [None] * len(raw)),
                    ])

    return one_row_each(listed, "path").mapInArrow(
        read, "key bigint, shard bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    )
