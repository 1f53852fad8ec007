"""Benchmark decontamination: a generalised suffix automaton of the items' words, along which documents are streamed.

Operator 12. Items are dealt into blocks of a bounded number of words; each block
becomes one automaton, which is what is broadcast. A document's words are streamed through it and the
length of the longest match that ends at each word is tracked; words that no item of the block has lead
back to the root, so runs of words that are shorter than every window are passed over at
once. Matches of a window's length or more make spans, which can be removed.

Cases: a null or empty text has no words and is returned with zeros and the digest of the empty text; items that are
null or have no words are never found; windows of an item without an id are hit, but no id is told; equal items, with equal or different ids, are all reported;
documents with equal or null ``doc_id`` are judged row by row; other columns of both tables are not
read; an empty table of items leaves every document clean, an empty table of documents gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import materialize
from kmerloom.llm.tokens import Words, byte_table, slices, words_of

#: Words of a document or item, lower-cased: letters, digits and all characters beyond ASCII.
LETTERS = ~byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])) | byte_table(bytes(range(0x41, 0x5B)))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of items whose automaton is broadcast at a time: at most half as many words, usually a sixth, of about 1 KB each.
BLOCK_CHARS = 500_000


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers, and what ends at its states."""

    window: int
    vocabulary: dict[str, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Items with a window that is the longest match of a state cut to the window's length.
    items: dict[int, list[int]] = field(default_factory=dict)
    #: For a state, the nearest state up its links, itself included, that is a whole item of fewer words than a window.
    whole: list[int] = field(default_factory=list)
    #: For a state of matches of the window's length or more, the one that holds its last ``window`` words.
    tail: list[int] = field(default_factory=list)
    names: list[str | None] = field(default_factory=list)
    shortest: int = 0

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of ``p`` and ``word`` with nothing longer in it."""
        q = self.step[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def follow(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        step = self.step
        while state and word not in step[state]:
            state = self.link[state]
            length = self.length[state]
        onward = step[state].get(word)
        return (0, 0) if onward is None else (onward, length + 1)

    def add(self, items: list[tuple[str | None, list[str]]]) -> Automaton:
        """Build from (id, words) of items with words."""
        self.names = [name for name, _ in items]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        for words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        ends: set[int] = set()
        places: list[tuple[int, int]] = []
        for number, words in enumerate(coded):
            state, length = 0, 0
            for w in words:
                state, length = self.follow(state, length, w)
                if length >= self.window:
                    places.append((state, number))
            if len(words) < self.window:
                ends.add(state)
                self.items.setdefault(state, []).append(number)
        self.whole, self.tail = [-1] * len(order), [-1] * len(order)
        for v in order[1:]:
            up = self.link[v]
            self.whole[v] = v if v in ends else self.whole[up]
            if self.length[v] >= self.window:
                self.tail[v] = v if self.length[up] < self.window else self.tail[up]
        for state, number in places:
            own = self.items.setdefault(self.tail[state], [])
            if not own or own[-1] != number:
                own.append(number)
        self.shortest = min([self.window, *(len(words) for words in coded)]) if coded else 0
        return self

    def hits(self, words: list[int], found: set[int]) -> list[tuple[int, int]]:
        """Spans (first, after last) of ``words`` inside any occurrence of a window, apart and in order; adds the windows' items to ``found``."""
        spans: list[tuple[int, int]] = []
        state, length, seen = 0, 0, set()
        for at, word in enumerate(words, 1):
            state, length = self.follow(state, length, word)
            reach = 0
            if length >= self.window:
                reach = length
                seen.add(self.tail[state])
            short = self.whole[state] if state else -1
            if short >= 0 and self.length[short] > length:
                short = self.whole[self.link[short]]
            if short >= 0:
                reach = max(reach, self.length[short])
                while short > 0:
                    seen.add(short)
                    short = self.whole[self.link[short]]
            if reach:
                first = at - reach
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, at))
        for s in seen:
            found.update(self.items[s])
        return spans


def item_words(text: str | None) -> list[str]:
    words = words_of(pa.array([text], pa.string()), LETTERS)
    return [bytes(words.data[s:e]).decode() for s, e in zip(words.starts, words.ends, strict=True)]


def _runs(known: np.ndarray, row: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, after last) of runs of ``least`` known words or more of one text."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
    if not len(edge):
        return []
    begin, end = edge[::2], edge[1::2]
    turn = np.flatnonzero(row[1:] != row[:-1]) + 1
    turn = turn[known[turn] & known[turn - 1]]
    begin, end = np.sort(np.concatenate((begin, turn))), np.sort(np.concatenate((end, turn)))
    long = end - begin >= least
    return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))


def _found(words: Words, automaton: Automaton) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
    """(row, spans of word numbers, item numbers) of each text with a hit."""
    numbers, distinct = words.coded()
    known = pc.index_in(distinct, pa.array(list(automaton.vocabulary), pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
    ids = known[numbers] if len(numbers) else numbers
    last, spans, items = -1, [], set()
    for lo, hi in _runs(ids >= 0, words.row, automaton.shortest):
        row = int(words.row[lo])
        if row != last:
            if spans:
                yield last, spans, items
            last, spans, items = row, [], set()
        spans += [(lo + a, lo + b) for a, b in automaton.hits(ids[lo:hi].tolist(), items)]
    if spans:
        yield last, spans, items


def _blocks(items: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """(block, id, text), and the number of blocks: items dealt by hash into blocks of about ``block_chars`` characters."""
    own = items.select(F.col("item_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    own = materialize(own.withColumn("n", F.char_length("text") + 1))
    count = max(1, -(-(own.agg(F.sum("n")).first()[0] or 0) // block_chars))
    return own.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count))), count


def match_items(docs: DataFrame, items: DataFrame, window: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, text, n_words, spans, items) of every row of ``docs``.

    ``spans`` are places (first byte, after the last byte, words) in the UTF-8 text that lie inside an occurrence of a window,
    apart and in order; ``items`` are the ids, as text, of items with such a window. A window is ``window`` consecutive words
    of an item; an item of fewer words is one window. With one block of items this is one pass that shuffles nothing; with more,
    each block is a pass that returns rows with hits only, and these meet per row.
    """
    spark = docs.sparkSession
    blocks, count = _blocks(items, block_chars)
    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    tail = "spans array<struct<first:bigint,after:bigint,words:bigint>>, items array<string>"

    def block(number: int):  # noqa: ANN202
        rows = blocks.filter(F.col("block") == number).select("id", "text").collect()  # one block, of bounded size
        own = [(r["id"], words) for r in rows if (words := item_words(r["text"]))]
        return spark.sparkContext.broadcast(Automaton(window).add(own))

    def run(table, every: bool, names: list[str]) -> Callable:  # noqa: ANN001
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1):
                    words = words_of(part.column(1), LETTERS)
                    n = np.bincount(words.row, minlength=words.rows)
                    begin = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(part.column(1)), 0).to_numpy(zero_copy_only=False))))
                    spans, found = [[]] * words.rows, [[]] * words.rows
                    for row, own, got in _found(words, table.value):
                        spans[row] = [{"first": int(words.starts[a] - begin[row]), "after": int(words.ends[b - 1] - begin[row]), "words": b - a} for a, b in own]
                        found[row] = sorted({name for i in got if (name := table.value.names[i]) is not None})
                    columns = [part.column(0), *([part.column(1)] if every else []), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(found, pa.list_(pa.string()))]
                    out = pa.RecordBatch.from_arrays(columns, names)
                    yield out if every else out.filter(pc.greater(pc.list_value_length(out.column(2)), 0))

        return go

    if count == 1:
        return narrow.mapInArrow(run(block(0), True, ["doc_id", "text", "n_words", "spans", "items"]), f"doc_id {kind}, text string, n_words bigint, {tail}")
    numbered = materialize(narrow.withColumn("_row", F.monotonically_increasing_id()))
    found = None
    for number in range(count):
        one = numbered.select("_row", "text").mapInArrow(run(block(number), False, ["_row", "n_words", "spans", "items"]), f"_row bigint, n_words bigint, {tail}").select("_row", "spans", "items")
        found = one if found is None else found.unionByName(one)
    merged = materialize(found).groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("_all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = numbered.mapInArrow(_counted(numbered.columns), f"doc_id {kind}, text string, _row bigint, n_words bigint")
    return (
        counted.join(merged, "_row", "left")
        .mapInArrow(_united, f"doc_id {kind}, text string, n_words bigint, {tail}")
    )


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("words", pa.int64())]))


def _counted(names: list[str]) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words = words_of(part.column(1), LETTERS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.bincount(words.row, minlength=words.rows), pa.int64())], [*names, "n_words"])

    return go


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that different blocks found in one text, united; the words of a united span are counted anew."""
    for batch in batches:
        spans = []
        for text, own in zip(batch.column("text").to_pylist(), batch.column("_all").to_pylist(), strict=True):
            out: list[list[int]] = []
            for s in sorted(own or [], key=lambda s: s["first"]):
                if out and s["first"] <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], s["after"])
                else:
                    out.append([s["first"], s["after"]])
            raw = text.encode() if out else b""
            spans.append([{"first": a, "after": b, "words": len(item_words(raw[a:b].decode()))} for a, b in out])
        items = pc.if_else(pc.is_null(batch.column("items")), pa.scalar([], pa.list_(pa.string())), batch.column("items"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("n_words"), pa.array(spans, _SPANS), items], ["doc_id", "text", "n_words", "spans", "items"])


def remove_spans(matched: DataFrame, longest: int = 10, most_covered: float = 0.5) -> DataFrame:
    """(doc_id, text, n_removed, dropped): texts of ``match_items`` without spans of ``longest`` words or more.

    A document whose spans cover more than ``most_covered`` of its words is dropped whole: its text is empty.
    """
    covered = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["words"])
    own = matched.withColumns({"_go": F.filter("spans", lambda s: s["words"] >= longest), "dropped": covered > F.col("n_words") * most_covered})
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # the bytes from the end of one removed span to the start of the next
    froms = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_go", lambda s: s["after"]))
    tos = F.concat(F.transform("_go", lambda s: s["first"]), F.array(F.octet_length(raw).cast("bigint")))
    pieces = F.zip_with(froms, tos, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    return own.select("doc_id", F.when(F.col("dropped"), "").otherwise(F.array_join(pieces, "")).alias("text"), F.size("_go").alias("n_removed"), "dropped")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    found = match_items(docs, items, window)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["words"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
