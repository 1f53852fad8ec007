"""Corpus pipeline: language ID, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; all but the last return the columns of ``documents``, with ``n_chars`` renewed
where the text changed. Operators see doc_id, text and what else they need; the other columns are
carried along as one, so their names clash with none of an operator's. ``run`` writes each stage's result to the shared folder as
Parquet and reads it again as the next stage's ``docs``.

Defined cases: those of the operators; a document whose lines all go stays with an
empty text until near-dedup, where documents without words are one group; in that stage
rows with equal ``doc_id`` and text leave one row, and other rows with equal or null ``doc_id`` stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.chunk_dedup import dedup_substrings
from kmerloom.llm.language import UNKNOWN, fit, held_out, predict
from kmerloom.llm.line_dedup import apply_bitmaps, keep_bitmaps
from kmerloom.llm.near_text import kept_rows, row_key
from kmerloom.llm.packing import pack
from kmerloom.llm.queries import vocabulary_path
from kmerloom.storage import materialize, scratch, spread

#: Least probability of the predicted language for a document to stay.
LEAST_SCORE = 0.5


def _carried(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and ``more`` of ``docs``, and all columns but the text as one."""
    return docs.select("doc_id", "text", *more, F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("_row"))


def _restored(df: DataFrame, text: str, columns: list[str], changed: bool = True) -> DataFrame:
    """The ``columns`` of the table that ``df`` carries, with the column ``text`` of ``df`` as text."""
    new = {"text": F.col(text).alias("text")}
    if changed:
        new["n_chars"] = F.char_length(text).cast("bigint").alias("n_chars")
    return df.select(*[new.get(c, F.col("_row").getField(c).alias(c)) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with a probability of ``LEAST_SCORE`` or more."""
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out()))
    scored = predict(_carried(docs), model)
    fine = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return _restored(scored.filter(fine), "text", docs.columns, changed=False)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a later document holds as well."""
    own = _carried(docs)
    return _restored(apply_bitmaps(own, keep_bitmaps(own)), "kept_text", docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest ``doc_id``.

    SimHash as operator 9 has it links fingerprints (of 5-word shingles) at 2 or fewer bits; pairs of similarity 0.8 beyond that are linked as well.
    """
    own = _carried(docs)
    keyed = own.select("*", *row_key())
    one = keyed.join(kept_rows(own).hint("shuffle_hash"), ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"])
    return _restored(one, "text", docs.columns, changed=False)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document holds as well."""
    return _restored(dedup_substrings(_carried(docs)), "text", docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack(docs, vocabulary_path(), capacity=1024, end_id=2)


#: The stages and their functions. SimHash near-dedup takes operator 9's links, and those beyond 2 bits as ``near_text`` says.
STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no form of the trained, hashed and packed stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote on its way goes with it
            docs = materialize(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
