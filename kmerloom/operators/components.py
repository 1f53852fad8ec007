"""Connected components of a link table by alternating large-star and small-star steps.

Each step groups links by one end, with a partial minimum before the shuffle, and
hangs them on the smallest neighbour. The link table is written to the shared folder
after each round, so lineage stays short and no link reaches the driver, only the
count and checksum that tell whether a round changed anything. Links of whole numbers
are first put together where they lie, a bounded number at a time, which leaves fewer links and shorter paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.storage import materialize

#: Links of whole numbers that are put together where they lie.
BUFFER = 1 << 20


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) with u > v. Large: all neighbours; small: the smaller ones only."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    hung = both.join(least, "u")
    if large:
        out = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def hung(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node but the smallest of its component, as far as these links tell, to that one. A pass at least halves the open roots."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            own = np.flatnonzero(root != np.arange(len(nodes)))
            return nodes[own], nodes[root[own]]
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]


def _together(links: DataFrame) -> DataFrame:
    """Links (u, v) of longs with the same components, about BUFFER at a time as they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def put() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in hung(table["u"].to_numpy(), table["v"].to_numpy())], ["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BUFFER:
                yield put()
        if sum(b.num_rows for b in held):
            yield put()

    return links.mapInArrow(run, "u bigint, v bigint")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); root is the smallest node of its component.

    Self-links and links with a null end are ignored; a node without links does not appear.
    Raises if ``max_rounds`` do not suffice (rounds grow with the logarithm of the longest path).
    """
    flat = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    numbers = isinstance(flat.schema["u"].dataType, T.LongType)
    now = materialize((_together(flat) if numbers else flat).distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        starred = _star(_star(now, large=True), large=False)
        now = materialize(_together(starred).distinct() if numbers else starred)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
