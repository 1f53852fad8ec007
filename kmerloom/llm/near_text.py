"""SimHash near-duplicate detection at a similarity of word shingles (operator 9 in the pipeline).

Two texts are near if the Jaccard similarity of their sets of 5-word shingles is ``least`` or
more. Pairs are found in two steps. The first is operator 9's own (``simhash.links``): fingerprints in blocks of equal
bits, compared in tiles, linked at CLOSEST or fewer differing bits. Here a fingerprint is that of a set, so that
no repeated passage outweighs the rest of a text.

Fingerprints of pairs at 0.8 differ in about 10 bits of 64, so tiles of all fingerprints would have to be
compared with all, in quadratic time, and blocks of equal bits as for radius 2 do not exist. For what the first step
cannot reach texts are dealt into buckets by their shingles as well: BANDS bands of ROWS smallest hashes, of which a pair at 0.8 shares
one but for 1 in 20,000, a closer one still more surely. In a bucket fingerprints are compared by exclusive-or and
bit counts, in tiles of a bounded size, and pairs within RADIUS bits are confirmed on the full sets, as
32-bit hashes of the shingles.

Texts with equal shingle sets are one node, so copies never meet again. In each band's bucket all
nodes are first compared with the smallest; then, in tiles, those of the buckets that the links
so far leave in different components, where a task returns links and never pairs to be confirmed elsewhere, so
components are those of all fetched pairs.

Defined cases: a null text has no word; texts without words are one node; a text of fewer words than
a shingle gives one shingle of all its words; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import join_with_hot, materialize
from kmerloom.llm.simhash import _hook, fold, links, shingle_hashes
from kmerloom.operators.components import connected_components

BANDS, ROWS = 25, 5
SEED = 42
#: Nodes of a bucket that meet in one task when all are compared with all.
TILE = 512
#: Bits in which fingerprints of a near pair may differ: pairs at 0.8 differ in 10 of 64, by 3 more or less.
RADIUS = 22
#: Bits at which fingerprints link without more, as in operator 9.
CLOSEST = 2

_RANDOM = np.random.default_rng(9)
_TIMES = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_MIX = _RANDOM.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def band_keys(found: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS smallest values of the shingles under different hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, (found[None, at : at + 2048] * _TIMES + _PLUS).min(axis=1))
    least ^= least >> np.uint64(31)
    mixed = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    return (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)


def row_key() -> list[Column]:
    """96 bits, equal for rows of equal doc_id and text."""
    return [F.xxhash64("doc_id", "text").alias("_a"), F.hash("text", "doc_id").alias("_b")]


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """The row key, doc_id, node, fingerprint, shingles and band keys of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                every = [shingle_hashes(t, width, SEED) for t in part["text"]]
                found = [np.unique(h) for h in every]
                fp = np.array([fold(h) for h in found], np.uint64).view(np.int64)
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
                keys = [band_keys(s).view(np.int64) for s in found]
                yield pd.DataFrame({"doc_id": part["doc_id"], "_a": part["_a"], "_b": part["_b"], "node": node, "fp": fp, "sh": [np.unique(s.astype(np.uint32)).view(np.int32) for s in found], "keys": keys})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _a bigint, _b int, node bigint, fp bigint, sh array<int>, keys array<bigint>"
    return docs.select("doc_id", "text", *row_key()).mapInPandas(run, schema).withColumn("rid", F.monotonically_increasing_id())


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar by ``least`` or more; v may be a hot node."""
    times = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n_v"))
    right = sets.select(F.col("node").alias("v"), F.col("sh").alias("sv")).join(times, "v")
    left = sets.select(F.col("node").alias("u"), F.col("sh").alias("su"))
    both = F.size(F.array_intersect("su", "sv"))
    return materialize(
        join_with_hot(pairs, right, ["v"], "n_v", pairs.count())
        .join(left, "u")
        .filter((F.size("su") >= least * F.size("sv")) & (F.size("sv") >= least * F.size("su")))
        .filter(both >= least * (F.size("su") + F.size("sv") - both) - 1e-9)
        .select("u", "v")
    )


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) of operator 9 between ``nodes`` (node, fp): equal fingerprints, and those that ``simhash.links`` joins.

    Texts without words have fingerprint zero and are one node already.
    """
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("v")))
    equal = nodes.join(first, "fp").filter("node <> v").select(F.col("node").alias("u"), "v")
    joined = links(first.select("fp"), CLOSEST).withColumnsRenamed({"u": "a", "v": "b"})
    at = lambda c, n: first.select(F.col("fp").alias(c), F.col("v").alias(n))
    return materialize(equal.unionByName(joined.join(at("a", "u"), "a").join(at("b", "v"), "b").select("u", "v")))


def close(a: str, b: str) -> Column:
    """Whether two fingerprints differ in RADIUS bits or fewer."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def similar(a: list[np.ndarray], b: list[np.ndarray], least: float) -> np.ndarray:
    """Whether each two sets of ``a`` and ``b``, sorted hashes, are similar by ``least`` or more; empty sets are similar to none."""
    codes = np.unique(np.concatenate([*a, *b]), return_inverse=True)[1]
    size = np.array([len(x) for x in (*a, *b)])
    starts = np.concatenate(([0], np.cumsum(size)))
    own, other = codes[: starts[len(a)]], codes[starts[len(a)] :]
    held = np.zeros(int(codes.max(initial=0)) + 1, bool)
    out = np.zeros((len(a), len(b)), bool)
    edges = starts[len(a) :] - starts[len(a)]
    for i in range(len(a)):
        mine = own[starts[i] : starts[i + 1]]
        held[mine] = True
        inside = np.concatenate(([0], np.cumsum(held[other])))
        both = inside[edges[1:]] - inside[edges[:-1]]
        out[i] = (both > 0) & (both >= least * (len(mine) + size[len(a) :] - both) - 1e-9)
        held[mine] = False
    return out


def _tiled(open_: DataFrame, least: float) -> DataFrame:
    """Links (u, v) that join the nodes of each bucket as all its similar pairs do; ``open_`` has key, node, fp, sh, n.

    A bucket is dealt into tiles, and each two tiles meet in one group of a bounded size, which
    compares fingerprints, confirms close pairs on the sets, and returns a link a node at most.
    """
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    placed = open_.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    one = placed.select("key", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("tiles") - 1)).alias("j"), F.lit(0).alias("side"), "node", "fp", "sh")
    two = placed.filter("own > 0").select("key", F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), F.lit(1).alias("side"), "node", "fp", "sh")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "node"], kind="stable")
        side, node, fp = rows["side"].to_numpy(), rows["node"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64).view(np.uint64)
        sets = [np.asarray(x, np.int32) for x in rows["sh"]]
        at, over = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(rows)),) * 2
        near = np.bitwise_count(fp[at][:, None] ^ fp[over][None, :]) <= RADIUS
        labels = np.arange(len(rows))
        if len(at) and len(over):
            a, b = np.nonzero(near & similar([sets[k] for k in at], [sets[k] for k in over], least))
            _hook(labels, at[a], over[b])
        moved = np.flatnonzero(labels != np.arange(len(rows)))
        return pd.DataFrame({"u": np.maximum(node[moved], node[labels[moved]]), "v": np.minimum(node[moved], node[labels[moved]])})

    met = one.unionByName(two).groupBy("key", "i", "j").applyInPandas(compare, "u bigint, v bigint")
    return materialize(met.filter("u <> v").distinct())


def kept_rows(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """The row keys (_a, _b) to keep: of each component that of the smallest doc_id, a null one last."""
    signed = materialize(_signed(docs, width))
    best = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_a", "_b")
    nodes = materialize(signed.groupBy("node").agg(F.min(best).alias("best"), F.min("rid").alias("rid"), F.min("fp").alias("fp")))
    closest = fingerprint_links(nodes.select("node", "fp"))
    alone = signed.join(nodes.select("rid"), "rid", "left_semi")  # one row of each node
    members = alone.select("node", "fp", F.explode("keys").alias("key"))
    first = F.min(F.struct("node", "fp"))
    buckets = materialize(members.groupBy("key").agg(first.alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.col("v.node").alias("v"), F.col("v.fp").alias("fv"), "n"))
    members = materialize(members.join(buckets, "key"))
    stars = materialize(members.filter((F.col("node") != F.col("v")) & close("fp", "fv")).select(F.col("node").alias("u"), "v").distinct())
    wanted = materialize(nodes.join(members.select("node").distinct(), "node", "left_semi").select("rid"))  # the sets are shuffled once, by row
    sets = materialize(signed.select("rid", "node", "sh").join(wanted, "rid", "left_semi").select("node", "sh"))
    found = closest.unionByName(_confirmed(stars, sets, least))
    roots = connected_components(found)
    rooted = members.join(roots, "node", "left").select("key", "node", "fp", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"),
        F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(3), "node")).alias("s2"),
    ).filter("n > 2 and lo <> hi")
    mixed = mixed.groupBy("n", "s1", "s2").agg(F.min("key").alias("key"))  # buckets of the same nodes in several bands count once
    open_ = rooted.join(mixed.select("key", "n"), "key").select("key", "node", "fp", "n").join(sets, "node")
    found = found.unionByName(_tiled(open_, least))
    named = nodes.join(connected_components(found), "node", "left").select(F.coalesce("root", "node").alias("root"), "best")
    return named.groupBy("root").agg(F.min("best").alias("best")).select("best._a", "best._b")
