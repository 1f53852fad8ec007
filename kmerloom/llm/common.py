"""Shared helpers: hot keys and skew-safe joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.storage import materialize

__all__ = ["HOT_SHARE", "ascii_lower", "carried", "carried_back", "hot_keys", "join_with_hot", "materialize"]

#: A key that holds more than this share of the rows is handled apart from the
#: others, so at most 1 / HOT_SHARE keys are ever broadcast as hot.
HOT_SHARE = 1e-3
#: A sample of about this many rows is enough to find the keys above HOT_SHARE.
HOT_SAMPLE_ROWS = 200_000


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII only take the fast built-in."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def carried(docs: DataFrame, own: list[str], gone: tuple[str, ...] = ()) -> DataFrame:
    """``own`` columns of ``docs`` and all others, but for ``gone``, as one column ``_rest``, so that no name of theirs is in the way."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in own and c not in gone]
    return docs.select(*own, (F.struct(*others) if others else F.lit(None).cast("int")).alias("_rest"))


def carried_back(docs: DataFrame, own: dict[str, Column], gone: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``docs`` in their order, from a table made by ``carried``; those in ``own`` are given."""
    return [own.get(c, F.col(f"_rest.c{i}")).alias(c) for i, c in enumerate(docs.columns) if c not in gone]


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold about ``share`` of the rows or more, by a sample of rows.

    At most ``2 / share`` rows whatever the input, so the result can be broadcast.
    A key that the sample misses is merely handled with the others: results do not
    depend on the sample.
    """
    rows = df.count()
    sample = df.select(*keys)
    if rows > HOT_SAMPLE_ROWS:
        sample = sample.sample(HOT_SAMPLE_ROWS / rows, seed=17)
    least = max(16.0, min(rows, HOT_SAMPLE_ROWS) * share / 2)
    return sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hot")).filter(F.col("n_hot") >= least).drop("n_hot")


def join_with_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, where ``right`` has one row per key.

    ``count`` is the column of ``right`` with the number of rows that the key has in
    ``left``, ``total`` their sum. Keys above HOT_SHARE of ``total``, at most 1,000,
    are broadcast; only the others are shuffled. ``left`` is read twice, so it should
    be a narrow materialised table. Keys must not be null.
    """
    heavy = F.col(count) > max(16.0, total * HOT_SHARE)
    hot, cold = right.filter(heavy), right.filter(~heavy)
    few = F.broadcast(hot.select(*keys))
    return (
        left.join(F.broadcast(hot), keys)
        .unionByName(left.join(few, keys, "left_anti").join(cold, keys))
    )
