"""Exact deduplication by content sort (operator 10, native).

Sampled splitters range-partition the rows by the first bytes of their text and
a hash, an external sort places equal texts next to each other, and the rows of
one run are compared in full by the window over the whole text. A text that holds
a large share of all rows is dealt over many ranges by a salt on the identifier and on the
part of the input that a row stands in, so null and repeated identifiers are dealt out as well,
and the runs of its salts are joined by their digest.

Defined cases: a null text counts as the empty text; equal ``doc_id`` in one
group give one kept row; a null ``doc_id`` is smaller than all others; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import HOT_SHARE, hot_keys, materialize

#: Characters of the text that splitters see; the hash behind them separates texts with a common start.
PREFIX = 16


def exact_dedup(docs: DataFrame, keep: str = "largest", hot_share: float = HOT_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` names the identifier that stays, ``largest`` or ``smallest``.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep!r}")
    spark = docs.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("body"), F.spark_partition_id().alias("part")).withColumn("h", F.xxhash64("body"))
    hot = hot_keys(rows, ["h"], hot_share).withColumn("salts", F.lit(salts))
    keyed = (
        rows.join(F.broadcast(hot), "h", "left")
        .withColumn("hot", F.col("salts").isNotNull())
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "part"), F.col("salts").cast("bigint"))).otherwise(F.lit(0).cast("bigint")))
        .withColumn("start", F.substring("body", 1, PREFIX))
        .drop("salts", "part")
    )
    best = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    same = Window.partitionBy("start", "h", "salt", "body")
    run = (
        keyed.repartitionByRange("start", "h", "salt")
        .sortWithinPartitions("start", "h", "salt", "body", best)
        .withColumn("rn", F.row_number().over(same.orderBy(best)))
        .withColumn("keep_id", F.first("doc_id").over(same.orderBy(best)))
        .withColumn("group_size", F.count(F.lit(1)).over(same))
        .select("doc_id", "keep_id", "group_size", "rn", "hot", "salt", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))
    )
    run = materialize(run)
    # Runs of a salted text: at most 2 / hot_share texts, one row for each once aggregated.
    if keep == "largest":
        top = F.max(F.struct(F.col("keep_id").isNotNull().alias("known"), "keep_id", (-F.col("salt")).alias("salt")))
    else:
        top = F.min(F.struct(F.col("keep_id").isNull().alias("none"), "keep_id", "salt"))
    whole = (
        run.filter("hot AND rn = 1")
        .groupBy("text_sha256")
        .agg(top.alias("top"), F.sum("group_size").alias("size_all"))
        .select("text_sha256", F.col("top.keep_id").alias("keep_all"), F.abs("top.salt").alias("salt_all"), "size_all")
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("rn") == 1) & (F.col("salt") == F.coalesce("salt_all", "salt"))
    return (
        run.join(F.broadcast(whole), "text_sha256", "left")
        .withColumn("keep_id", F.when(F.col("salt_all").isNull(), F.col("keep_id")).otherwise(F.col("keep_all")))
        .withColumn("group_size", F.coalesce("size_all", "group_size"))
        .select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    )
