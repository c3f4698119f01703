"""Helpers shared by the training-data operators: tables, byte words, hashes and shared files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidex.session import scratch_path

# bytes.split() and bytes.strip() cut at exactly [\x20\x09-\x0D]
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str) -> Column:
    """crc32 of a key written as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def unused(df: DataFrame, n: int) -> list[str]:
    """Column names that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    while len(out) < n:
        name = f"_c{len(out)}_{len(taken)}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def set_aside(df: DataFrame, needed: Iterable[str], made: Iterable[str] = ()) -> tuple[DataFrame, list[Column]]:
    """``df`` with all columns but ``needed`` under names that clash with nothing, and what selects its own columns again.

    Own columns named as one of ``made`` (the columns an operator adds) are left out of that.
    """
    needed, made = set(needed), {m.lower() for m in made}
    names = {c: c if c in needed else n for c, n in zip(df.columns, unused(df, len(df.columns)))}
    plain = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return plain, [F.col(n).alias(c) for c, n in names.items() if c.lower() not in made]


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased; none for NULL."""
    return text.translate(LOWER).split() if text else []


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shared_folder(spark: SparkSession, label: str) -> str:
    """URI of a fresh folder below the shared one, created now."""
    uri = scratch_path(spark, label)
    system, path = file_system(uri)
    system.create_dir(path)
    return uri


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, for code that runs inside tasks."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def one_row_each(df: DataFrame, order: str) -> DataFrame:
    """The rows of a small list (one per file), about one to a partition."""
    return df.repartitionByRange(max(1, df.count()), order)


def record_batches(columns: Iterable[tuple[str, pa.DataType, list]]) -> pa.RecordBatch:
    names, arrays = [], []
    for name, kind, values in columns:
        names.append(name)
        arrays.append(values if isinstance(values, pa.Array) else pa.array(values, kind))
    return pa.RecordBatch.from_arrays(arrays, names)


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
