"""Sequence tables derived from ``documents``: letters of a text, in a cycle, are read as bases.

Tables that several queries read are derived once for a session and state of the files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.codes import code_names
from kmerloom.operators import genes, splicegraph, superkmers
from kmerloom.operators.junctions import all_exons, bounds_of_runs, long_enough, runs_between
from kmerloom.storage import global_rank, materialize, once, spread

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
DIGITS = "0123456789"
K = 25
#: An exon of EXON bases starts every STRIDE bases of a contig; a contig shorter than that is one exon.
EXON, STRIDE = 120, 180
READ, STEP = 100, 50
#: Reads that are cut from one block of a contig.
BLOCK = 64
#: Passes over the buckets when all transcripts are held against all contigs: each shuffles a part of the k-mers.
PASSES = 2
#: Leniency of the window form that the graph queries use.
LENIENCY = 10
#: Splice signals before and after an exon.
LEFT_SIGNALS, RIGHT_SIGNALS = ["AG", "TG", "AC", "GC", "GG"], ["GT", "TT", "AT"]


def bases(text: Column) -> Column:
    """Letters of a text as bases."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]+", "")), LETTERS, BASES)


def masked_bases(text: Column) -> Column:
    """Letters of a text as bases, its digits as N."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", "")), LETTERS + DIGITS, BASES + "N" * len(DIGITS))


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return once(spark, f"{sf_dir}/documents.parquet", name, build)


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq) of each whole text."""
    own = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text")
    return own.select("doc_id", bases(F.col("text")).alias("seq"))


def windows(own: DataFrame) -> DataFrame:
    """(doc_id, r, seq): the reads of (doc_id, seq).

    A place in a text is found by counting its letters, so a text is first cut into blocks of BLOCK reads and these into reads;
    from a whole text they would cost the square of its length. Empty reads go at last: a filter on ``seq`` would derive it twice.
    """
    over = F.greatest(F.char_length("seq") - READ, F.lit(0))
    own = own.select("doc_id", "seq", over.alias("over"), F.ceil(over / STEP).cast("int").alias("last"))
    at = lambda r: F.least(r * STEP, F.col("over"))
    block = lambda c: F.struct((c * BLOCK).alias("first"), F.substring(F.col("seq"), at(c * BLOCK) + 1, F.lit(BLOCK * STEP + READ)).alias("seq"))
    blocks = own.select("doc_id", "over", "last", F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"last div {BLOCK}").cast("int")), block)).alias("b"))
    read = lambda r: F.struct(r.alias("r"), F.substring(F.col("b.seq"), at(r) - at(F.col("b.first")) + 1, F.lit(READ)).alias("seq"))
    places = F.sequence(F.col("b.first"), F.least(F.col("last"), F.col("b.first") + BLOCK - 1))
    return blocks.select("doc_id", F.explode(F.transform(places, read)).alias("w")).select("doc_id", "w.r", "w.seq").filter("seq <> ''")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, r, seq): windows of READ bases at every STEP and a last one up to the end; a shorter contig is one read."""

    def build() -> DataFrame:
        return windows(contigs(spark, sf_dir))

    return _once(spark, sf_dir, "reads", build)


def passing_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reads`` as they are derived, for a query that takes them once: they are neither written nor read again."""
    return windows(contigs(spark, sf_dir))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): of each contig all exons (T1), and all but every third (T2)."""

    def build() -> DataFrame:
        own = contigs(spark, sf_dir).filter("seq <> ''")
        count = F.greatest(F.expr(f"(char_length(seq) - {EXON}) div {STRIDE} + 1").cast("int"), F.lit(1))
        exon = lambda j: F.substring(F.col("seq"), (j - 1) * STRIDE + 1, F.lit(EXON))
        places = F.sequence(F.lit(1), count)
        both = F.array(
            F.struct(F.lit("T1").alias("t"), F.array_join(F.transform(places, exon), "").alias("seq")),
            F.struct(F.lit("T2").alias("t"), F.array_join(F.transform(F.filter(places, lambda j: j % 3 != 0), exon), "").alias("seq")),
        )
        return own.select("doc_id", F.explode(both).alias("x")).select(F.concat(F.lit("D"), F.col("doc_id").cast("string"), "x.t").alias("id"), "x.seq")

    return _once(spark, sf_dir, "transcripts", build)


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contigs' k-mers by their minimizers: the form in which all others ask for them."""
    return _once(spark, sf_dir, "dealt", lambda: superkmers.deal(contigs(spark, sf_dir), K))


def known_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contigs' distinct k-mers. They are not stored: the table they come from is a tenth of their size."""
    return superkmers.counted(dealt(spark, sf_dir), K).select(*code_names(K))


def known_size(spark: SparkSession, sf_dir: str) -> int:
    """How many distinct k-mers the contigs have."""
    return superkmers.size(dealt(spark, sf_dir), K)


def members(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """Those of some k-mers, in code columns, that the contigs have."""
    return lambda asked: superkmers.members(asked, dealt(spark, sf_dir), K)


def absent(spark: SparkSession, sf_dir: str, seqs: DataFrame) -> DataFrame:
    """(id, a, b): runs of k-mer starts of ``seqs`` that the contigs do not have.

    The contigs are dealt straight into the shuffle: ``dealt`` would lie on disk a second time beside it. A pass takes
    a part of the buckets, and what it shuffled goes when its runs are written.
    """
    one = lambda share: superkmers.absent_runs(seqs, superkmers.deal(contigs(spark, sf_dir), K, share=share), K, share=share)
    return reduce(DataFrame.unionByName, [materialize(one((i, PASSES))) for i in range(PASSES)])


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hits along the transcripts."""
    own = transcripts(spark, sf_dir)
    return _once(spark, sf_dir, "runs", lambda: runs_between(own, absent(spark, sf_dir, long_enough(own, K)), K))


def exon_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_no, name, exon, start, end, seq) of the exons found along all transcripts."""

    def build() -> DataFrame:
        found = all_exons(transcripts(spark, sf_dir), bounds_of_runs(runs(spark, sf_dir), K, LENIENCY))
        named = found.select(F.concat_ws("_", "id", "start", "end").alias("id"), F.col("id").alias("t"), "exon_no", F.col("exon_seq").alias("seq"))
        return splicegraph.parse_headers(global_rank(named, ["t", "exon_no"], "rec_no"))

    return _once(spark, sf_dir, "exons", build)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "blocks", lambda: splicegraph.exon_blocks(exon_records(spark, sf_dir)))


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "ends", lambda: splicegraph.end_index(blocks(spark, sf_dir)))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(exon, node) of the merged exons."""
    own = blocks(spark, sf_dir)
    return _once(spark, sf_dir, "merged", lambda: splicegraph.merge_exons(own, splicegraph.exon_components(own)))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, src, dst) between nodes."""
    return _once(spark, sf_dir, "graph", lambda: splicegraph.relabel(splicegraph.chain_edges(blocks(spark, sf_dir)), merged(spark, sf_dir)))


def gene_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(exon, gene) of the graph's nodes."""
    return _once(spark, sf_dir, "genes", lambda: genes.genes(graph(spark, sf_dir)))
