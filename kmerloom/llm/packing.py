"""Best-fit packing of documents into sequences (operator 5).

A task tokenizes its texts and returns one small row per piece: place, length and a
checksum of its ids. What the packing needs is the number of pieces of each length,
at most ``capacity`` counts however many documents there are, so the packing is
planned on that table: lengths above one third of the capacity are paired greedily,
the longest with the longest that still fits; shorter ones, longest first, go where
the smallest gap takes them, gaps of equal size in one step. The plan is a short list
of rules "pieces of this length with ranks from .. to .. go to these sequences at this
offset". Ranks are counted within a task and shifted by the counts of the tasks before
it, so no group of equal lengths meets in one task.

Defined cases: a null text counts as the empty text and gives one piece that holds the
end token alone; only documents longer than a sequence are cut, and their first piece
is the short one; rows with equal ``doc_id`` are documents of their own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.bpe import byte_symbols
from kmerloom.llm.common import materialize

#: Texts with a longer run of blanks or of other characters go to the tokenizers library, whose time stays in proportion there.
LONG_RUN = 1000
_BLANKS = re.compile(rf"\s{{{LONG_RUN}}}")


class _Encoder:
    """Ids as little-endian bytes, as the tokenizers library gives them for a byte-level vocabulary file.

    Where merges make tokens in the order of their ids, the ids are ranks, and plain texts are encoded by rank; special
    tokens' strings and texts with very long runs go to the library itself, and so does all else with other vocabularies.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, symbols = model["vocab"], byte_symbols()
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.by_rank = None
        if made == sorted(set(made)):
            special = set(self.special)
            ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items() if t not in special}
            self.by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bool:
        return (
            self.by_rank is not None
            and not any(s in text for s in self.special)
            and max(map(len, text.split()), default=0) <= LONG_RUN
            and _BLANKS.search(text) is None
        )

    def encode(self, texts: list[str]) -> list[bytes]:
        return [
            self.by_rank.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes()
            if self._plain(t)
            else np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            for t in texts
        ]


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                rows = []
                for doc_id, body in zip(part["doc_id"], encoder.encode([t or "" for t in part["text"]]), strict=True):
                    ids = memoryview(body + end)
                    n = len(ids) // 4
                    start = 0
                    stop = n % capacity or capacity
                    piece = 0
                    while start < n:
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                        start, stop, piece = stop, stop + capacity, piece + 1
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rules (length, rank_from, rank_to, sequence, per_sequence, offset) that pack ``counts`` pieces of each length.

    The piece of rank r goes to sequence ``sequence + (r - rank_from) // per_sequence`` at
    ``offset + (r - rank_from) % per_sequence * length``. Rules number at most a few for each length and gap.
    """
    rules: list[tuple[int, int, int, int, int, int]] = []
    used: dict[int, int] = dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first sequence, number)
    following = 0

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        rules.append((length, used[length], used[length] + n, first, each, offset))
        used[length] += n

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            gaps.setdefault(room, []).append((first, n))

    large = {n: counts[n] for n in sorted((n for n in counts if 3 * n > capacity), reverse=True) if counts[n]}
    left = dict(large)
    for length in large:
        while left[length]:
            mate = next((m for m in large if left[m] and m + length <= capacity and (m != length or left[m] > 1)), None)
            if mate is None:
                n, each = left[length], 1
                put(length, n, following, each, 0)
                free(capacity - length, following, n)
            elif mate == length:
                n = left[length] // 2 * 2
                put(length, n, following, 2, 0)
                free(capacity - 2 * length, following, n // 2)
            else:
                n = min(left[length], left[mate])
                put(length, n, following, 1, 0)
                put(mate, n, following, 1, length)
                left[mate] -= n
                free(capacity - length - mate, following, n)
            left[length] -= n
            following += n // 2 if mate == length else n
    for length in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        rest = counts[length]
        while rest:
            room = min((g for g in gaps if g >= length), default=None)
            if room is None:
                each = capacity // length
                need = -(-rest // each)
                free(capacity, following, need)
                following += need
                continue
            first, n = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
            each = room // length
            full = min(n, rest // each)
            offset = capacity - room
            if full:
                put(length, full * each, first, each, offset)
                free(room - each * length, first, full)
                rest -= full * each
            if full < n and rest:
                part = min(rest, each)
                put(length, part, first + full, each, offset)
                free(room - part * length, first + full, 1)
                rest -= part
                full += 1
            free(room, first + full, n - full)
    return rules


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, capacity, end_id).withColumn("task", F.spark_partition_id()))
    by_task = materialize(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = by_task.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))).select("length", "task", "shift")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    schema = "length bigint, lo bigint, hi bigint, first bigint, each bigint, at bigint"
    rules = spark.createDataFrame(plan(counts, capacity), schema)
    own = Window.partitionBy("length", "task").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        cut.withColumn("rn", F.row_number().over(own) - 1)
        .join(shift.hint("merge"), ["length", "task"])  # a row for each task and length: too many to broadcast
        .withColumn("rank", F.col("rn") + F.col("shift"))
    )
    # Per length the rules cover the ranks without gaps: one array of them, found by the rank.
    table = rules.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "first", "each", "at"))).alias("rules"))
    nth = F.col("rank") - F.col("rule.lo")
    return (
        ranked.join(F.broadcast(table), "length")
        .withColumn("rule", F.filter("rules", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0])
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("rule.first") + F.floor(nth / F.col("rule.each"))).alias("sequence_id"),
            (F.col("rule.at") + F.pmod(nth, F.col("rule.each")) * F.col("length")).alias("offset"),
        )
    )
