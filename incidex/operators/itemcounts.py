"""Counts over baskets of a bounded item list.

Containers are reduced to sorted index arrays, equal baskets are merged before any
counting, and every partition adds up its own small matrix with NumPy.  Nothing is
emitted per pair of items inside a container, so a hot container costs no more than
any other: its basket cannot exceed the item list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ITEMS = 4096


def basket_counts(rows: DataFrame, group: Sequence[str], index: str) -> DataFrame:
    """Distinct baskets with their number of groups: ``basket array<int>, n``."""
    per = rows.groupBy(*group).agg(F.array_sort(F.collect_set(index)).alias("basket"))
    return per.groupBy("basket").agg(F.count("*").alias("n"))


def _dense(baskets: pd.Series, width: int) -> np.ndarray:
    sizes = baskets.map(len).to_numpy()
    out = np.zeros((len(baskets), width), dtype=bool)
    if sizes.sum():
        cols = np.concatenate([np.asarray(b, dtype=np.int64) for b in baskets if len(b)])
        out[np.repeat(np.arange(len(baskets)), sizes), cols] = True
    return out


def pair_counts(baskets: DataFrame, width: int) -> DataFrame:
    """Groups holding both i and j, for i <= j (i = j gives the plain support)."""
    if width > MAX_ITEMS:
        raise ValueError(f"{width} items exceed the bounded list of {MAX_ITEMS}")

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            m = _dense(pdf["basket"], width).astype(np.float64)
            total += m.T @ (m * pdf["n"].to_numpy(dtype=np.float64)[:, None])
        i, j = np.nonzero(np.triu(total))
        yield pd.DataFrame({"i": i, "j": j, "n": total[i, j].astype(np.int64)})

    return baskets.mapInPandas(add_up, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def combination_counts(baskets: DataFrame, width: int, combos: Sequence[tuple[int, ...]], mode: str) -> DataFrame:
    """Groups that hold ``all`` or ``any`` members of each combination: ``combo, n``."""
    combos = [tuple(c) for c in combos]

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(combos), dtype=np.int64)
        longest = max((len(c) for c in combos), default=1)
        padded = np.array([c + (c[0],) * (longest - len(c)) for c in combos], dtype=np.int64)
        for pdf in batches:
            m = _dense(pdf["basket"], width)
            w = pdf["n"].to_numpy(dtype=np.int64)
            for start in range(0, len(combos), 512):
                part = padded[start : start + 512]
                hit = m[:, part[:, 0]]
                for k in range(1, longest):
                    hit = hit & m[:, part[:, k]] if mode == "all" else hit | m[:, part[:, k]]
                total[start : start + 512] += w @ hit
        yield pd.DataFrame({"combo": np.arange(len(combos)), "n": total})

    if not combos:
        return baskets.sparkSession.createDataFrame([], "combo long, n long")
    return baskets.mapInPandas(add_up, "combo long, n long").groupBy("combo").agg(F.sum("n").alias("n"))


def index_column(names: Sequence[str], key: str = "item_key") -> Column:
    """Index of a key in the bounded list, NULL outside it."""
    if not names:
        return F.lit(None).cast("int")
    mapping = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    return F.try_element_at(mapping, F.col(key))
