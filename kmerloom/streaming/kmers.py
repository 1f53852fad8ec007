"""k-mer counts over sequence files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.codes import code_names, decode
from kmerloom.operators.kmers import explode_kmers


def stream_reads(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming (seq), in upper case, of FASTA and four-line FASTQ files that appear in ``folder``.

    A file is one row until its records are cut, so files of up to 2 GB.
    """
    text = F.regexp_replace("value", "\r", "")
    lines = F.split(text, "\n", -1)
    fastq = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(2)), F.lit(4)), lambda i: F.get(lines, i))
    records = F.filter(F.split(F.concat(F.lit("\n"), text), "\n>", -1), lambda r: ~r.startswith("\n") & (r != ""))
    fasta = F.transform(records, lambda r: F.regexp_replace(F.regexp_replace(r, "^[^\n]*", ""), "\n", ""))
    seqs = F.when(text.startswith("@"), fastq).otherwise(fasta)
    files = spark.readStream.text(folder, wholetext=True)
    return files.select(F.explode(seqs).alias("seq")).filter("seq is not null").select(F.upper("seq").alias("seq"))


def stream_counts(reads: DataFrame, k: int) -> DataFrame:
    """Streaming (canon, n): running counts, to be written in update or complete mode."""
    # A state by k-mer grows from batch to batch; buckets of minimizers are counted anew in each.
    names = code_names(k)
    return explode_kmers(reads, k, keep=[]).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).select(decode(k).alias("canon"), "n")
