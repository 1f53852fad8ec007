"""Line deduplication (operator 2, native).

Every line of every text gets a 128-bit hash of its key. The rows (hash, document,
position) are range-partitioned by hash with a secondary sort by document and
position; a window streams each run, sees the first document of it and marks the
rows of the others. What returns is not text but, per document, the 64-bit words
of its keep bitmap that have a line to drop; words that keep all their lines are
left out. A key that holds a large share of all lines does not pass the sort: its
documents are pre-aggregated and its verdict, one row, is broadcast.

Defined cases: a null or empty text is one empty line; rows with equal ``doc_id``
count as one document and each row keeps its own positions; a null ``doc_id`` is
one document, smaller than all others; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import ascii_lower, carried, carried_back, materialize
from kmerloom.llm.occurrences import later_occurrences

#: ASCII white space: blank and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, row_fp, pos) of each line whose key has ``min_chars`` code points or more."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("row_fp"), F.posexplode(_lines()).alias("pos", "line"))
    stripped = F.btrim(F.col("line"), F.lit(SPACE))
    return (
        lines.filter(F.char_length("line") >= min_chars)
        .withColumn("key", ascii_lower(stripped))
        .filter(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), "key").alias("h2"), "doc_id", "row_fp", "pos")
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per row of ``docs`` that loses lines: doc_id, row_fp and ``drops``.

    Keys of ``min_chars`` code points or more that are found in ``min_docs`` documents
    or more lose their lines in all but the largest ``doc_id``. ``drops`` maps the index
    of a 64-line word to its bits, 1 for a dropped line. Together with the count of
    lines this is the compressed keep bitmap.
    """
    occ = materialize(line_keys(docs, min_chars))
    dropped = later_occurrences(occ, ["h1", "h2"], ["row_fp", "pos"], largest_first=True, min_docs=min_docs)
    bit = F.expr("shiftleft(1L, pos % 64)")
    return (
        dropped.repartition("doc_id", "row_fp")
        .groupBy("doc_id", "row_fp", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .groupBy("doc_id", "row_fp")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped, which replace columns of these names; the bitmaps are small, so texts pass unsorted."""
    gone = ("kept_text", "n_lines", "n_dropped")
    own = carried(docs, ["doc_id", "text"], gone)
    b = bitmaps.select(F.col("doc_id").alias("_b_doc"), F.col("row_fp").alias("_b_fp"), F.col("drops").alias("_b_drops"))
    same = own["doc_id"].eqNullSafe(b["_b_doc"]) & (F.xxhash64(own["text"]) == b["_b_fp"])
    joined = own.join(b.hint("shuffle_hash"), same, "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    dropped = F.expr("aggregate(map_values(_b_drops), 0L, (n, w) -> n + bit_count(w))")

    def stays(_: Column, i: Column) -> Column:
        word = F.coalesce(F.element_at(F.col("_b_drops"), F.shiftright(i, 6)), F.lit(0).cast("bigint"))
        return F.getbit(word, i % 64) == 0

    kept = F.when(F.col("_b_drops").isNull(), text).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    done = joined.select("doc_id", "text", "_rest", kept.alias("_kept"), F.size(lines).cast("bigint").alias("_n"), F.coalesce(dropped, F.lit(0).cast("bigint")).alias("_d"))
    own = carried_back(docs, {"doc_id": F.col("doc_id"), "text": F.col("text")}, gone)
    return done.select(*own, F.col("_kept").alias("kept_text"), F.col("_n").alias("n_lines"), F.col("_d").alias("n_dropped"))
