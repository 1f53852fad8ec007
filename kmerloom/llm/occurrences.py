"""Which occurrences of a key are not the first: a streamed sort for the many keys, pre-aggregation for the hot few.

Shared by line and chunk deduplication. The table of occurrences is narrow and
materialised, as it is read several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import hot_keys, materialize

#: Stands for a null document: smaller than all others.
NO_DOC = -(2**63)


def later_occurrences(
    occ: DataFrame, keys: list[str], within: list[str], largest_first: bool, min_docs: int, with_first: bool = False
) -> DataFrame:
    """Rows of ``occ`` whose key is found in ``min_docs`` documents or more, but for those of the first document.

    ``occ`` has ``keys``, ``doc_id`` (a long) and ``within``, the columns that say where in
    the document. The first document has the largest ``doc_id``, or the smallest. Rows are
    range-partitioned by key and sorted by document and place, and a window streams
    each run. Keys with a large share of all rows are left out of the sort: their
    documents are counted with partial aggregation and the verdicts broadcast.
    ``with_first`` adds first_doc and first_place, the least of ``within`` there.
    """
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_DOC))
    order = doc.desc() if largest_first else doc.asc()
    place = F.col(within[0]) if len(within) == 1 else F.struct(*within)
    out = ["doc_id", *within, *(["first_doc", "first_place"] if with_first else [])]
    hot = materialize(hot_keys(occ, keys))
    run = Window.partitionBy(*keys)
    cold = (
        occ.join(F.broadcast(hot), keys, "left_anti")
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys, order, *within)
        .withColumn("nth_doc", F.dense_rank().over(run.orderBy(order)))
        .withColumn("n_docs", F.max("nth_doc").over(run))
    )
    if with_first:
        at_first = run.orderBy(order, *within)
        cold = cold.withColumns({"first_doc": F.first(doc).over(at_first), "first_place": F.first(place).over(at_first)})
    cold = cold.filter((F.col("n_docs") >= min_docs) & (F.col("nth_doc") > 1)).select(*out)
    best = F.max_by if largest_first else F.min_by
    verdict = (
        occ.join(F.broadcast(hot), keys)
        .groupBy(*keys, doc.alias("d"))
        .agg(F.min(place).alias("p"))
        .groupBy(*keys)
        .agg(best("d", "d").alias("first_doc"), best("p", "d").alias("first_place"), F.count(F.lit(1)).alias("n_docs"))
        .filter(F.col("n_docs") >= min_docs)
    )
    warm = occ.join(F.broadcast(verdict), keys).filter(doc != F.col("first_doc")).select(*out)
    return cold.unionByName(warm)
