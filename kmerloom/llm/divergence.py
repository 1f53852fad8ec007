"""Source divergence audit: how far the word frequencies of sources of a language are apart.

Operator 11. Counts of a term in the sources of its language are a sparse vector. Terms with identical vectors are grouped; each
pair of sources is evaluated once per distinct vector and multiplied by the number of its terms, and a source's own terms are
ranked by their vectors first, then by name. Vectors are numbered, and only these numbers are joined: a table of vectors is small in its files
but many times larger in memory, so Spark must not be left to broadcast it. Only sources with a count are stored: where neither of a pair
has one, the difference is that of the two smoothed zeros, which is added once for all terms.

Pairs are evaluated between tiles of sources, over parts of the distinct vectors, so that neither a language
with most terms nor one with many sources is one task. All arithmetic is on whole numbers.

Cases: null text, lang and source are the empty text; documents with equal or null ``doc_id`` count as often as they stand; a
group without terms still has its pairs; a language whose terms all are rare has pairs with value 0 and no terms;
a language of one source has no pairs; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import materialize
from kmerloom.llm.tokens import byte_table, slices, words_of

#: Terms: ASCII letters and all characters beyond ASCII.
LETTERS = ~byte_table(bytes([*range(0x00, 0x61), *range(0x7B, 0x80)]))
#: Sources whose pairs are evaluated together, and distinct vectors in a part.
TILE, PART = 128, 20_000
#: Groups whose table is broadcast: about 100 bytes each. With more, all joins are shuffled.
BROADCAST_GROUPS = 100_000
#: Probabilities are in units of one in SCALE; PRIOR counts are added to each term.
SCALE, PRIOR = 1_000_000_000, 5
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, lang, source) to counts of terms in groups; each group also has a row without a term."""
    names = ["lang", "source", "term", "n", "docs"]
    for batch in batches:
        for part in slices(batch, 0):
            words = words_of(part.column(0), LETTERS)
            number, distinct = words.coded()
            langs, sources = part.column(1).dictionary_encode(), part.column(2).dictionary_encode()
            group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
            groups, group = np.unique(group, return_inverse=True)
            size = max(len(distinct), 1)
            in_row, n = np.unique(words.row * size + number, return_counts=True)
            row, term = np.divmod(in_row, size)
            key = group[row] * size + term
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0))) if len(key) else np.zeros(0, np.int64)
            total = np.add.reduceat(n[order], first) if len(key) else n
            docs = np.diff(np.concatenate((first, [len(key)])))
            of_group, term = np.divmod(key[order[first]], size)
            of_group = np.concatenate((of_group, np.arange(len(groups))))
            of_lang, of_source = np.divmod(groups[of_group], len(sources.dictionary))
            none = np.zeros(len(groups), np.int64)
            shown = distinct.take(pa.array(np.concatenate((term, none)), pa.int64(), mask=np.arange(len(of_group)) >= len(term)))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(of_lang)), sources.dictionary.take(pa.array(of_source)), shown, pa.array(np.concatenate((total, none))), pa.array(np.concatenate((docs, none)))], names
            )


def smoothed(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) for 0 <= count <= total below 9e15, digit by digit so that nothing overflows."""
    rest, out = count % total, count // total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _smoothed(count: str, total: str) -> Column:
    """As ``smoothed``, of expressions."""
    return F.expr(f"1 + (cast({count} as decimal(19, 0)) * cast({SCALE} as decimal(10, 0))) div cast({total} as decimal(19, 0))")


class Audit:
    """Counts of kept terms and what follows from them, as tables."""

    def __init__(self, docs: DataFrame, least_docs: int = 30, tile: int = TILE, part: int = PART):
        own = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
        counted = own.mapInArrow(_count_terms, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        self.counts = materialize(counted)
        #: (lang, source, s): sources numbered within their language.
        groups = self.counts.filter("term is null").select("lang", "source")
        self.groups = materialize(groups.withColumn("s", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")))
        self.few = self.groups.count() <= BROADCAST_GROUPS
        self.least_docs, self.tile, self.part = least_docs, tile, part
        self._vectors()

    def _known(self, groups: DataFrame) -> DataFrame:
        """A table of at most a row a group, to be joined on the right: broadcast where there are few groups, else never."""
        return F.broadcast(groups) if self.few else groups.hint("merge")

    def _vectors(self) -> None:
        numbered = self.counts.filter("term is not null").join(self._known(self.groups), ["lang", "source"])
        vector = F.array_sort(F.collect_list(F.struct("s", "n")))  # as long as the language has sources
        terms = numbered.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), vector.alias("vector")).filter(F.col("docs") >= self.least_docs)
        kept = materialize(terms.select("lang", "term", "vector"))
        distinct = kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("m"))
        #: (lang, vector, m, vid): distinct vectors, how many terms have each, and their numbers.
        self.distinct = materialize(distinct.withColumn("vid", F.monotonically_increasing_id()))
        #: (lang, term, vid): kept terms and the numbers of their vectors.
        self.terms = materialize(kept.join(self.distinct.select("lang", "vector", "vid").hint("merge"), ["lang", "vector"]).select("lang", "term", "vid"))
        totals = self.distinct.select("lang", "m", F.explode("vector").alias("e")).groupBy("lang", F.col("e.s").alias("s")).agg(F.sum(F.col("m") * F.col("e.n")).alias("total"))
        sizes = self.distinct.groupBy("lang").agg(F.sum("m").alias("v"))
        zero = F.lit(0).cast("bigint")
        own = self.groups.join(self._known(totals), ["lang", "s"], "left").join(self._known(sizes), "lang", "left")
        #: (lang, source, s, total, v): all groups, with their count of kept terms and their language's number of these.
        self.sources = materialize(own.withColumns({"total": F.coalesce("total", zero), "v": F.coalesce("v", zero)}))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): the sum of differences over all kept terms, for all ordered pairs of sources of a language."""
        tile, parts = self.tile, max(1, -(-self.distinct.count() // self.part))
        tiles = self.sources.groupBy("lang").agg((F.max("s") / tile).cast("int").alias("last"))
        i, j = F.sequence(F.lit(0), F.col("last")), F.sequence(F.col("i"), F.col("last"))
        blocks = tiles.select("lang", "last", F.explode(i).alias("i")).select("lang", "i", F.explode(j).alias("j"))
        spread = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        ends = F.explode(F.array_distinct(F.array("i", "j"))).alias("tile")
        sources = self.sources.withColumn("tile", F.expr(f"s div {tile}").cast("int"))
        right = blocks.select("lang", "i", "j", ends).join(self._known(sources), ["lang", "tile"]).select("lang", "i", "j", spread, "s", "source", "total", "v")
        # a vector goes to the pairs of tiles of which it has a source, with what it has there
        touched = F.array_distinct(F.transform("vector", lambda e: (e["s"] / tile).cast("int")))
        own = self.distinct.withColumns({"tiles": touched, "part": F.pmod(F.xxhash64("vector"), F.lit(parts)).cast("int")}).join(self._known(tiles), "lang")
        met = F.transform(F.sequence(F.lit(0), F.col("last")), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")))
        left = own.select("lang", "part", "vector", "m", "last", "tiles", F.explode("tiles").alias("tile")).select("lang", "part", "vector", "m", "tiles", "tile", F.explode(met).alias("b"))
        left = left.select("lang", "part", "vector", "m", "tiles", "tile", "b.i", "b.j")
        left = left.filter(F.col("tile") == F.when(F.array_contains("tiles", F.col("i")), F.col("i")).otherwise(F.col("j")))  # once for each pair of tiles
        tile_of = lambda e: (e["s"] / tile).cast("int")
        inside = F.filter("vector", lambda e: (tile_of(e) == F.col("i")) | (tile_of(e) == F.col("j")))
        left = left.select("lang", "i", "j", "part", inside.alias("vector"), "m").groupBy("lang", "i", "j", "part", "vector").agg(F.sum("m").alias("m"))
        key = ["lang", "i", "j", "part"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_evaluate(tile), "lang string, source string, item string, value bigint")
        return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def term_values(self, top: int = 50) -> DataFrame:
        """(lang, source, item, value): each source's ``top`` terms that are more frequent in it than in its language.

        A source's vectors are ranked by value; terms are joined to the first ones only, and of terms that share a
        vector, and so their value, only the first ``top`` can count.
        """
        whole = self.sources.groupBy("lang").agg(F.sum("total").alias("in_lang"))
        amount = F.aggregate("vector", F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
        own = self.distinct.select("lang", "vid", amount.alias("n_lang"), F.explode("vector").alias("e")).select("lang", "vid", "n_lang", "e.s", "e.n")
        own = own.join(self._known(self.sources.join(self._known(whole), "lang")), ["lang", "s"])
        p = _smoothed(f"(n + {PRIOR})", f"(total + {PRIOR} * v)")
        q = _smoothed(f"(n_lang + {PRIOR})", f"(in_lang + {PRIOR} * v)")
        valued = own.select("lang", "source", "vid", (p - q).alias("value")).filter("value > 0")
        best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
        first = valued.withColumn("_nth", F.rank().over(best)).filter(F.col("_nth") <= top).drop("_nth")
        shared = Window.partitionBy("lang", "vid").orderBy("term")
        terms = self.terms.withColumn("_nth", F.row_number().over(shared)).filter(F.col("_nth") <= top).drop("_nth")
        return first.join(terms.hint("merge"), ["lang", "vid"]).select("lang", "source", F.col("term").alias("item"), "value")


def _evaluate(size: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Pairs of sources of two tiles over one part of the vectors, as differences from the case that no source has a count."""

    def go(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["lang", "source", "item", "value"]
        lang, i, j, part = (k.as_py() for k in key)
        empty = pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.string(), pa.int64())], names=names)
        if not right.num_rows:
            return empty
        right = right.sort_by("s")
        s, tile = right["s"].to_numpy(), right["s"].to_numpy() // size
        v = int(right["v"][0].as_py())
        a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        sums = np.zeros((len(a), len(b)), np.int64)
        if v:
            total = right["total"].to_numpy() + PRIOR * v
            zero = smoothed(np.full(len(s), PRIOR, np.int64), total)
            apart = np.abs(zero[a][:, None] - zero[b][None, :])
            if part == 0:
                sums += v * apart
            lists = left["vector"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            many = left["m"].to_numpy()
            entries = lists.flatten()
            place, count = np.searchsorted(s, entries.field("s").to_numpy(zero_copy_only=False)), entries.field("n").to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            step = max(1, 2_000_000 // max(1, len(a) * len(b)))
            for lo in range(0, len(many), step):
                hi = min(lo + step, len(many))
                p = np.tile(zero, (hi - lo, 1))
                begin, end = (ends[lo - 1] if lo else 0), ends[hi - 1]
                rows = np.repeat(np.arange(hi - lo), lengths[lo:hi])
                at = place[begin:end]
                p[rows, at] = smoothed(count[begin:end] + PRIOR, total[at])
                off = np.abs(p[:, a][:, :, None] - p[:, b][:, None, :]) - apart
                sums += (off * many[lo:hi, None, None]).sum(axis=0)
        source = right["source"].to_numpy()
        x, y = np.meshgrid(a, b, indexing="ij")
        own = x < y if i == j else np.ones(x.shape, bool)
        x, y, value = x[own], y[own], sums[own]
        return pa.table([pa.array([lang] * (2 * len(x)), pa.string()), pa.array(np.concatenate((source[x], source[y])), pa.string()), pa.array(np.concatenate((source[y], source[x])), pa.string()), pa.array(np.concatenate((value, value)))], names=names)

    return go


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, tile: int = TILE, part: int = PART) -> DataFrame:
    """(lang, source, part, item, value, rank): both reports, ranked within their group."""
    audit = Audit(docs, least_docs, tile, part)
    rows = audit.pairs().select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(
        audit.term_values(top).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))
