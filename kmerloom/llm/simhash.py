"""SimHash near-duplicate detection (operator 9).

Fingerprints are taken in Arrow batches. Equal fingerprints are one node, so copies
never meet again. Nodes are compared exactly, in tiles sorted by population count, with
numpy exclusive-or and bit counts; tile pairs whose population counts differ beyond the
radius are skipped. Tiles over all nodes would make a quadratic number of pairs, so nodes are
dealt first, without loss: with 64 bits in four blocks, two fingerprints that differ in two bits or
fewer agree in two blocks, so each node goes to the six pairs of blocks. A crowded bucket of 32
equal bits is dealt once more by its other 32 bits, again in four blocks: what meets then has 48 equal
bits and is at most 65,536 nodes whatever the data, so no task ever gathers more. Whole
buckets are put together into tiles, whose links are true links, wherever the nodes come from. A task returns
at most one link per node and tile set, to a node it reaches there, which keeps components whole.

Defined cases: a null text has no word; a text without words has fingerprint zero and
is linked like any other; a text of fewer words than a shingle gives one shingle of all
its words; rows with equal ``doc_id`` and text are equal nodes; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import join_with_hot, materialize
from kmerloom.operators.components import connected_components

BITS = 64
#: Blocks that fingerprints, or what is left of them in a bucket, are cut into.
BLOCKS = 4
#: Rows of a tile, rows that are compared together, and nodes of a bucket that is dealt once more.
TILE, TOGETHER, CROWDED = 128, 1024, 4096


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; one of all words if they are fewer, none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([hashed(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([hashed(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle or None].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fold(hashes: np.ndarray) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """64-bit SimHash of one text."""
    return fold(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps})

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint"
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def _hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of labels joined by links (a, b); a class's label is its smallest position."""
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (flat := labels[labels] != labels).any():
            labels[flat] = labels[labels[flat]]


def tile_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) that join the classes of fingerprints under all pairs at ``radius`` or fewer bits."""
    count = np.bitwise_count(fps).astype(np.int16)
    order = np.argsort(count, kind="stable")
    fps, count = fps[order], count[order]
    labels = np.arange(len(fps))
    last = count[np.minimum(np.arange(TILE - 1, len(fps) + TILE - 1, TILE), len(fps) - 1)] if len(fps) else count
    for t, i in enumerate(range(0, len(fps), TILE)):
        for j in range(i, len(fps), TILE):
            if count[j] - last[t] > radius:
                break
            near = np.bitwise_count(fps[i : i + TILE, None] ^ fps[None, j : j + TILE]) <= radius
            a, b = np.nonzero(np.triu(near, 1) if i == j else near)
            _hook(labels, a + i, b + j)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return fps[moved], fps[labels[moved]]


def _pairs_of_blocks(bits: list[Column], size: int) -> list[Column]:
    """For each two of four blocks a number of which two they are and what is in them; ``size`` bits a block."""
    return [
        F.shiftleft(F.lit(k).cast("bigint"), 2 * size).bitwiseOR(F.shiftleft(bits[i], size)).bitwiseOR(bits[j])
        for k, (i, j) in enumerate(combinations(range(BLOCKS), 2))
    ]


def _rest(fp: Column, key: Column) -> list[Column]:
    """The 32 bits that two blocks of 16 leave, in blocks of 8, by the number of the two in ``key``."""
    left = [[b for b in range(BLOCKS) if b not in two] for two in combinations(range(BLOCKS), 2)]
    size = BITS // BLOCKS
    which = F.shiftrightunsigned(key, 2 * size).cast("int")
    at = lambda n: F.element_at(F.array(*[F.lit(x[n] * size) for x in left]), which + 1)
    half = [F.call_function("shiftrightunsigned", fp, at(n)) for n in (0, 1)]
    return [F.shiftrightunsigned(half[n // 2], size // 2 * (n % 2)).bitwiseAND((1 << size // 2) - 1) for n in range(BLOCKS)]


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, part, fp): the distinct fingerprints in buckets of two nodes or more, so dealt that any two within 2 bits meet."""
    size = BITS // BLOCKS
    blocks = [F.shiftrightunsigned("fp", size * i).bitwiseAND((1 << size) - 1) for i in range(BLOCKS)]
    rows = materialize(nodes.select(F.explode(F.array(*_pairs_of_blocks(blocks, size))).alias("key"), "fp"))
    filled = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = materialize(join_with_hot(rows, filled, ["key"], "n", rows.count()))
    plain = met.filter(F.col("n") <= CROWDED).select("key", F.lit(-1).cast("bigint").alias("part"), "fp")
    again = _pairs_of_blocks(_rest(F.col("fp"), F.col("key")), size // 2)
    crowded = met.filter(F.col("n") > CROWDED).select("key", F.explode(F.array(*again)).alias("part"), "fp")
    return plain.unionByName(crowded)


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` whose components are those of all pairs in ``radius``.

    Radius 0 to 2: two of four blocks are then equal.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # the bucket that the last batch ended in, and whole ones before it
        rows = 0
        last: tuple[int, int] | None = None

        def found(parts: list[np.ndarray]) -> pd.DataFrame:
            u, v = tile_links(np.unique(np.concatenate(parts)), radius)
            return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

        for batch in batches:
            if not len(batch):
                continue
            key, part, fp = (batch[c].to_numpy(np.int64) for c in ("key", "part", "fp"))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(fp)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if rows >= TOGETHER and last != (key[a], part[a]):
                    yield found(held)
                    held, rows = [], 0
                held.append(fp[a:b].view(np.uint64))
                rows += b - a
                last = (key[a], part[a])
        if rows:
            yield found(held)

    return buckets(nodes).repartition("key", "part").sortWithinPartitions("key", "part").mapInPandas(run, "u bigint, v bigint")


def simhash_components(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id it reaches, itself included)."""
    fps = materialize(fingerprints(docs, shingle, seed))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs")))
    roots = connected_components(links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named)
    class_id = named.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count(F.lit(1)).alias("n_fps"))
    total = named.count()
    ids = materialize(join_with_hot(named, class_id, ["root"], "n_fps", total).select("fp", "component_id", "n_docs"))
    rows = fps.count()
    return join_with_hot(fps, ids, ["fp"], "n_docs", rows).select("doc_id", "fp", "component_id")
