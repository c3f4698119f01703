"""Connected components and neighbour joins on (container, element) graphs."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidex import skew
from incidex.session import cut_lineage

SMALL = 1000  # nodes and edges of a group that are worked inside one row


def close_rows(
    tables: dict[str, DataFrame], by: Sequence[str], schema: str, close: Callable[..., dict[str, np.ndarray]]
) -> DataFrame:
    """Each group of ``by`` in one row of lists, and ``close`` over many rows at once.

    ``tables`` are named; all their columns but ``by`` are whole numbers.  ``close`` gets the row number and the columns of
    each table, in the order given, and returns the column ``row`` and those of ``schema``.
    """
    by, tagged = list(by), None
    width = max(len(x.columns) for x in tables.values()) - len(by)
    for name, x in tables.items():
        cols = [F.col(c).cast("long") for c in x.columns if c not in by]
        cols += [F.lit(None).cast("long")] * (width - len(cols))
        part = x.select(*by, F.lit(name).alias("_t"), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(cols)]).alias("_v"))
        tagged = part if tagged is None else tagged.unionByName(part)
    lists = tagged.repartition(*by).groupBy(*by).agg(*[F.collect_list(F.when(F.col("_t") == n, F.col("_v"))).alias(n) for n in tables])
    names, n_by = list(tables), len(by)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = []
            for name in names:
                column = batch.column(name)
                sizes = column.value_lengths().to_numpy(zero_copy_only=False)
                values = column.flatten().flatten()
                flat.append([np.repeat(np.arange(len(sizes)), sizes), *values])
            out = close(*flat)
            row = pa.array(out.pop("row"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(row) for i in range(n_by)] + [v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()],
                batch.schema.names[:n_by] + list(out),
            )

    heads = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lists.select(*by).schema)
    return lists.mapInArrow(work, f"{heads}, {schema}")


def number_nodes(row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Order of the nodes by (row, id), and a lookup of their places in it: -1 for ends that are no nodes."""
    order = np.lexsort((ids, row))
    known, codes = np.unique(ids, return_inverse=True)
    key = row * (len(known) + 1) + codes
    key = key[order]

    def place(r: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(key):
            return np.full(len(r), -1)
        c = np.minimum(np.searchsorted(known, x), len(known) - 1)
        want = r * (len(known) + 1) + c
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return np.where((known[c] == x) & (key[at] == want), at, -1)

    return order, place


def _labels(nodes: list, edges: list, cuts: list | None = None) -> dict[str, np.ndarray]:
    row, ids = nodes[0], nodes[1].to_numpy(zero_copy_only=False)
    order, place = number_nodes(row, ids)
    src, dst = (place(edges[0], e.to_numpy(zero_copy_only=False)) for e in edges[1:3])
    held = (src >= 0) & (dst >= 0)
    if cuts is not None:
        a, b = (place(cuts[0], e.to_numpy(zero_copy_only=False)) for e in cuts[1:3])
        a, b, n = a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)], len(ids)
        held &= ~np.isin(src * n + dst, np.r_[a * n + b, b * n + a])
    src, dst = src[held], dst[held]
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, dst, label[src])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return {"row": row[order], "id": ids[order], "label": ids[order][label]}


def components(
    nodes: DataFrame, edges: DataFrame, by: Sequence[str], node: str = "element_id", max_rounds: int = 100, cuts: DataFrame | None = None
) -> DataFrame:
    """Component label (smallest member) of every node inside its group.

    ``edges(by, src, dst)`` holds both directions; ends that are no nodes do not count.  Groups of up to ``SMALL`` nodes and edges are closed inside a row, the
    others are merged in rounds that store nodes and the links left.  ``node`` is a whole number.  ``cuts`` are edges, in either direction, that
    do not count.
    """
    by = list(by)
    if not by:
        return _rounds(nodes, edges if cuts is None else without_cuts(edges, cuts, by), by, node, max_rounds)
    tables = [nodes.select(*by, node), edges.select(*by, "src", "dst")] + ([] if cuts is None else [cuts.select(*by, "src", "dst")])
    sizes = functools.reduce(DataFrame.unionByName, [x.select(*by) for x in tables])
    few, rest = skew.split_groups(sizes, by, SMALL, *tables)
    kind = nodes.schema[node].dataType.simpleString()
    out = close_rows(dict(zip(("nodes", "edges", "cuts"), few)), by, "id long, label long", _labels)
    out = out.select(*by, F.col("id").cast(kind).alias(node), F.col("label").cast(kind).alias("label"))
    if rest is None:
        return out
    links = rest[1] if cuts is None else without_cuts(rest[1], rest[2], by)
    return out.unionByName(_rounds(rest[0], links, by, node, max_rounds))


def _rounds(nodes: DataFrame, edges: DataFrame, by: list[str], node: str, max_rounds: int) -> DataFrame:
    """Each round merges every node into the least one of the tree that least neighbours make; links between merged nodes are left.

    A node that survives two rounds has taken in another, so the nodes at least halve.
    """
    ids = nodes.select(*by, F.col(node).alias("id"))
    state = cut_lineage(ids.withColumn("label", F.col("id")))
    both = edges.where("src <> dst").select(*by, F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    for end in ("src", "dst"):
        both = both.join(ids.withColumnRenamed("id", end), [*by, end], "left_semi")
    links = cut_lineage(both)
    for _ in range(max_rounds):
        if links.isEmpty():
            return cut_lineage(state.select(*by, F.col("id").alias(node), F.col("label").cast(nodes.schema[node].dataType).alias("label")))
        up = cut_lineage(links.groupBy(*by, F.col("src").alias("id")).agg(F.min("dst").alias("up")))
        moved = True
        while moved:  # up to the root: who has no entry is one
            hop = up.select(*by, F.col("id").alias("up"), F.col("up").alias("top"))
            up = cut_lineage(up.join(hop, [*by, "up"], "left").select(*by, "id", F.col("up").alias("old"), F.coalesce("top", "up").alias("up")))
            moved = not up.where("up <> old").isEmpty()
        root = lambda c: up.select(*by, F.col("id").alias(c), F.col("up").alias(f"{c}_up"))
        state = state.join(root("label"), [*by, "label"], "left").select(*by, "id", F.coalesce("label_up", "label").alias("label"))
        ends = links.join(root("src"), [*by, "src"]).join(root("dst"), [*by, "dst"], "left")
        ends = ends.select(*by, F.col("src_up").alias("src"), F.coalesce("dst_up", "dst").alias("dst")).where("src <> dst")
        links = cut_lineage(ends.select(*by, F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    raise RuntimeError(f"components not closed after {max_rounds} rounds")


def without_cuts(edges: DataFrame, cuts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Edges that survive a cut list given in either direction."""
    both = cuts.select(*by, "src", "dst").unionByName(
        cuts.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    return edges.join(both.distinct(), [*by, "src", "dst"], "left_anti")


def induced(edges: DataFrame, members: DataFrame, by: Sequence[str], tag: Sequence[str]) -> DataFrame:
    """Edges with both ends inside the same tagged element set."""
    src = members.select(*tag, *by, F.col("element_id").alias("src"))
    dst = members.select(*tag, *by, F.col("element_id").alias("dst"))
    return edges.join(src, [*by, "src"]).join(dst, [*tag, *by, "dst"])
