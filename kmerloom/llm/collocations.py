"""Phrase collocations: compressed position bitmaps of words, shifted and intersected depth first, popcounts summed over shards.

Operator 13. A shard is a run of words of whole texts, cut where a bounded number is reached, with the next words as context. Every
word of a shard has a bitmap of its places; an empty place stands between pieces, so that no phrase crosses from one to
the next. Bitmaps are compressed by bytes: only bytes with a bit are stored, as (byte, bits). A phrase is extended by shifting its
bitmap by one place and intersecting it with the bitmaps of words, for a block of first words at a time and
down to the longest phrase before the next block; popcounts of all shards are summed by Spark.

A first pass counts words and pairs. Each further pass counts phrases of one word more and extends only phrases whose parts reached the least
count over all shards before. What reached it is known to tasks as a hashed set of fixed size: a phrase that shares its slot with
another is counted in vain and goes when counts are summed, so results never depend on the size.

Cases: a null or empty text has no pieces; a null ``lang`` is ``und``, as is that name itself; documents with equal
or null ``doc_id`` count as often as they stand; columns other than text and lang are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import materialize
from kmerloom.llm.tokens import Words, byte_table, slices, words_of

#: Bytes between pieces, and those between words as well.
PIECE_ENDS = byte_table(".,;:!?\n\x0b\x0c\r")
LETTERS = ~(PIECE_ENDS | byte_table(" \t"))
#: Words of a shard.
SHARD = 1_000_000
#: Bitmap bytes that are extended at a time.
BLOCK = 100_000
#: Slots of the hashed set of frequent phrases, one bit each.
SLOTS = 1 << 25
_SCHEMA = "lang string, phrase string, n bigint"
_NAMES = ["lang", "phrase", "n"]


class Bitmaps:
    """Compressed bitmaps of the words at ``places``: for each word, its bytes with a bit, in order; and the same by byte."""

    def __init__(self, word: np.ndarray, place: np.ndarray):
        at = place >> 3
        self.bytes = int(at.max(initial=-1)) + 2
        key = word * self.bytes + at
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.bits = np.bitwise_or.reduceat((1 << (place & 7)).astype(np.uint8)[order], first) if len(key) else np.zeros(0, np.uint8)
        self.word, self.at = np.divmod(key[first], self.bytes)
        self.by_byte = np.argsort(self.at, kind="stable")
        self.begin = np.searchsorted(self.at[self.by_byte], np.arange(self.bytes + 1))

    def extended(self, phrase: np.ndarray, at: np.ndarray, bits: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps of all phrases that are one of ``phrase`` and one more word, as (phrase, word, byte, bits)."""
        wide = bits.astype(np.uint16) << 1  # a bit that leaves its byte goes to the next
        phrase = np.concatenate((phrase, phrase))
        at = np.concatenate((at, at + 1))
        bits = np.concatenate((wide & 255, wide >> 8)).astype(np.uint8)
        own = bits > 0
        phrase, at, bits = phrase[own], at[own], bits[own]
        n = self.begin[at + 1] - self.begin[at]
        ends = np.cumsum(n)
        other = self.by_byte[np.arange(ends[-1] if len(n) else 0) + np.repeat(self.begin[at] - (ends - n), n)]
        both = self.bits[other] & np.repeat(bits, n)
        own = both > 0
        return np.repeat(phrase, n)[own], self.word[other[own]], np.repeat(at, n)[own], both[own]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits from two numbers of 64 bits, by odd multipliers."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(31))


def _hashes(words: pa.Array) -> np.ndarray:
    """A number for each of some strings; equal strings have equal ones."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))


class Frequent:
    """Hashed set of phrases, given by the hashes of their words in order, the last of them under their language."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def slot(slots: int, lang: np.ndarray, *words: np.ndarray) -> np.ndarray:
        h = lang
        for w in words:
            h = _mixed(h, w)
        return h & np.uint64(slots - 1)

    def holds(self, lang: np.ndarray, *words: np.ndarray) -> np.ndarray:
        slot = self.slot(8 * len(self.bits), lang, *words)
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _grouped(phrases: list[np.ndarray], count: np.ndarray, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal phrases of numbers below ``words`` once, with the sum of their counts."""
    if not len(count):
        return phrases, count
    if words ** len(phrases) < 2**62:
        key = phrases[0]
        for p in phrases[1:]:
            key = key * words + p
        order = np.argsort(key)
        differs = key[order][1:] != key[order][:-1]
    else:
        order = np.lexsort(phrases[::-1])
        differs = np.any([p[order][1:] != p[order][:-1] for p in phrases], axis=0)
    first = np.flatnonzero(np.concatenate(([True], differs)))
    return [p[order[first]] for p in phrases], np.add.reduceat(count[order], first)


def phrase_counts(word: np.ndarray, breaks: np.ndarray, own: int, size: int, lang: np.ndarray, hashed: np.ndarray, sets: list[Frequent | None], block: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(words of each phrase, its count) of the phrases of ``size`` words that begin at one of the first ``own`` words of a shard.

    ``word`` has the words' numbers, ``breaks`` says where a piece begins; ``lang`` and ``hashed`` have each number's
    language and hash. All parts of a phrase must be in the ``sets``, by their length from 1, where there is one.
    """
    place = np.arange(len(word)) + np.cumsum(breaks)
    words = len(lang)
    maps = Bitmaps(word, place)
    known = sets[0].holds(lang, hashed) if sets and sets[0] else np.ones(words, bool)
    begins = known[maps.word]
    limit = place[own - 1] if own else -1
    bits = maps.bits.copy()
    over = maps.at > limit >> 3
    bits[maps.at == limit >> 3] &= np.uint8((2 << (int(limit) & 7)) - 1)
    rows = np.flatnonzero(begins & ~over & (bits > 0))
    for lo in range(0, len(rows), block):
        part = rows[lo : lo + block]
        phrases = [maps.word[part]]  # the words of each row's phrase
        at, got = maps.at[part], bits[part]
        for depth in range(2, size + 1):
            row, last, at, got = maps.extended(np.arange(len(at)), at, got, words)
            phrases = [p[row] for p in phrases] + [last]
            for n in range(1, min(depth, len(sets)) + 1):  # all parts that end here
                if sets[n - 1] is None:
                    continue
                fits = sets[n - 1].holds(lang[last], *(hashed[p] for p in phrases[depth - n :]))
                phrases, last, at, got = [p[fits] for p in phrases], last[fits], at[fits], got[fits]
        yield _grouped(phrases, np.bitwise_count(got).astype(np.int64), words)


def _shards(words: Words, context: int, shard: int) -> Iterator[tuple[int, int, int]]:
    """(first, after last own word, after last word of context) of each shard."""
    for lo in range(0, len(words.starts), shard):
        hi = min(lo + shard, len(words.starts))
        yield lo, hi, min(hi + context, len(words.starts))


def _shard_rows(sizes: list[int], sets: list, shard: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function from (text, lang) to the counts of phrases of ``sizes`` words in each shard; those of no words count all words of a language."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                words = words_of(part.column(0), LETTERS)
                if not len(words.starts):
                    continue
                breaks = words.breaks(PIECE_ENDS)
                number, distinct = words.coded()
                langs = part.column(1).dictionary_encode()
                of_row = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                # a word of two languages is two words
                paired, number = np.unique(number * len(langs.dictionary) + of_row[words.row], return_inverse=True)
                text_of, lang_of = np.divmod(paired, len(langs.dictionary))
                lang, hashed = (_hashes(langs.dictionary)[lang_of], _hashes(distinct)[text_of]) if any(sets) else (np.zeros(len(paired), np.uint64),) * 2
                held = [s and s.value for s in sets]

                def rows(phrases: list[np.ndarray], count: np.ndarray, distinct=distinct, langs=langs, text_of=text_of, lang_of=lang_of) -> pa.RecordBatch:  # noqa: ANN001
                    texts = [distinct.take(pa.array(text_of[p])) for p in phrases]
                    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang_of[phrases[0]])), pc.binary_join_element_wise(*texts, " "), pa.array(count, pa.int64())], _NAMES)

                for size in sizes:
                    if size == 0:
                        total = np.bincount(of_row[words.row], minlength=len(langs.dictionary))
                        yield pa.RecordBatch.from_arrays([langs.dictionary, pa.nulls(len(total), pa.string()), pa.array(total, pa.int64())], _NAMES)
                    elif size == 1:
                        yield rows([np.arange(len(paired))], np.bincount(number, minlength=len(paired)))
                    else:
                        for lo, hi, more in _shards(words, size - 1, shard):
                            for phrases, count in phrase_counts(number[lo:more], breaks[lo:more], hi - lo, size, lang, hashed, held, block):
                                if len(count):
                                    yield rows(phrases, count)

    return go


def _frequent_set(spark: SparkSession, phrases: DataFrame, slots: int):  # noqa: ANN202
    """Broadcast hashed set of (lang, phrase): ``slots`` bits, a power of two, whatever the number of phrases."""

    def words_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = pc.split_pattern(batch.column(1), " ")
            sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
            lang, hashed = _hashes(batch.column(0)), _hashes(pc.list_flatten(parts))
            begin = np.cumsum(sizes) - sizes
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                slot = np.unique(Frequent.slot(slots, lang[own], *(hashed[begin[own] + i] for i in range(n))))
                at, first = np.unique(slot >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits.view(np.int64))], ["at", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(words_set, "at int, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    held = np.zeros(slots >> 6, np.uint64)
    held[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(Frequent(held.view(np.uint8)))


def frequent_phrases(docs: DataFrame, least: int = 10, longest: int = 3, shard: int = SHARD, block: int = BLOCK, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of the phrases of up to ``longest`` words found ``least`` times or more, and (lang, total words)."""
    spark = docs.sparkSession
    own = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    counted = lambda sizes, sets: own.mapInArrow(_shard_rows(sizes, sets, shard, block), _SCHEMA).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = F.size(F.split("phrase", " "))
    first = materialize(counted([0, 1, 2][: longest + 1], []).filter(F.col("phrase").isNull() | (F.col("n") >= least)).withColumn("words", words))
    totals = first.filter("phrase is null").select("lang", F.col("n").alias("total"))
    found = first.filter("phrase is not null")
    newest, sets = found.filter("words = 2"), [None]
    for size in range(3, longest + 1):
        sets.append(_frequent_set(spark, newest, slots))
        newest = materialize(counted([size], sets).filter(F.col("n") >= least).withColumn("words", words))
        found = found.unionByName(newest)
    return found, totals


def _part(first: int, after: int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first + 1, after - first), " ")


def _scored(found: DataFrame, totals: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the phrases of two words or more, by their lowest cut."""
    counts = found.select("lang", F.col("phrase").alias("_part"), F.col("n").alias("_n"))
    out = None
    for size in range(2, longest + 1):
        own = found.filter(F.col("words") == size).withColumnRenamed("n", "a")
        cuts = []
        for k in range(1, size):
            for name, part in (("_l", _part(0, k)), ("_r", _part(k, size))):
                own = own.withColumn("_part", part).join(counts, ["lang", "_part"]).withColumnRenamed("_n", f"{name}{k}").drop("_part")
            big = lambda c: f"cast({c} as decimal(15, 0))"
            score = F.expr(f"({big('a')} * {big('a')} * cast(1000000 as decimal(7, 0))) div ({big(f'_l{k}')} * {big(f'_r{k}')})")
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")))
        lowest = F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]
        own = own.withColumn("_cut", lowest).select("lang", "phrase", "words", "a", "_cut.l", "_cut.r", "_cut.score")
        out = own if out is None else out.unionByName(own)
    return out.join(totals.withColumnRenamed("total", "n"), "lang")


def _without_covered(scored: DataFrame, longest: int) -> DataFrame:
    """Phrases that no longer phrase with at least half their count holds."""
    over = scored.filter(F.col("words") > 2)
    inner = None
    for size in range(2, longest):
        for longer in range(size + 1, longest + 1):
            for first in range(longer - size + 1):
                one = over.filter(F.col("words") == longer).select("lang", _part(first, first + size).alias("phrase"), F.col("a").alias("_over"))
                inner = one if inner is None else inner.unionByName(one)
    if inner is None:
        return scored
    most = inner.groupBy("lang", "phrase").agg(F.max("_over").alias("_over"))
    kept = F.col("_over").isNull() | (F.col("_over") * 100 < F.col("a") * 50)
    return scored.join(most, ["lang", "phrase"], "left").filter(kept).drop("_over")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, shard: int = SHARD, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words.

    The first ones are taken inside parts of a language before those meet, so no task sees more than a part.
    """
    found, totals = frequent_phrases(docs, least, longest, shard, block, slots)
    kept = _without_covered(materialize(_scored(found, totals, longest)), longest)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").cast("binary").asc()]
    parts = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = parts.withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_nth") <= top).drop("_nth", "_salt")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
