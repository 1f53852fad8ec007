"""Sequences in pieces: a record that is larger than a task is never one string.

A record is stored as pieces (rec_no, piece, start, bases) of ``size`` bases each; the first ``halo`` bases of what follows
stand behind a piece, so every window of halo + 1 bases lies whole in the one piece where it begins. The reader makes
pieces straight from file splits: a first pass counts headers and bases of each split, sums over the splits tell where in
which record a split begins, and only pieces that cross the edge of a split are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.sources.records import _batch, _stretches
from kmerloom.sources.splits import KEY, in_order, known_splits, numbered, read_rows, renumbered, with_start
from kmerloom.storage import materialize

#: Bases of a piece.
SIZE = 1 << 20
_PIECE = pa.schema([("rec_no", pa.int64()), ("piece", pa.int64()), ("at", pa.int64()), ("bases", pa.string()), ("whole", pa.bool_())])
_SPLIT = pa.schema([("_turn", pa.int32()), ("_path", pa.string()), ("_block", pa.int64()), ("headers", pa.int64()), ("head", pa.int64()), ("tail", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (KEY, is a header, bases) of lines to headers, bases before the first and behind the last header of each split."""
    at, headers, head, tail = None, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        out = []
        for lo, hi, key in _stretches(batch):
            if key != at:
                if at is not None:
                    out.append((*at, headers, head, tail))
                at, headers, head, tail = key, 0, 0, 0
            for is_header, n in zip(batch.column(3)[lo:hi].to_pylist(), batch.column(4)[lo:hi].to_pylist(), strict=True):
                if is_header:
                    headers, tail = headers + 1, 0
                elif headers:
                    tail += n
                else:
                    head += n
        yield _batch(out, _SPLIT)
    if at is not None:
        yield _batch([(*at, headers, head, tail)], _SPLIT)


def _carried(splits: pd.DataFrame) -> pd.DataFrame:
    """Bases of the record at hand before and behind each split of one file, as if the file opened a record; whether that record is still the one."""
    splits = splits.sort_values("_block")
    now, before, after = 0, [], []
    for headers, head, tail in zip(splits["headers"], splits["head"], splits["tail"], strict=True):
        before.append(now)
        now = int(tail) if headers else now + int(head)
        after.append(now)
    opened = splits["headers"].cumsum() - splits["headers"]
    return splits[[*KEY, "headers"]].assign(_before=before, _after=after, _goes_on=opened == 0)


def _over_files(splits: DataFrame) -> DataFrame:
    """``splits`` of ``_carried`` with ``_file``: a file that does not begin with a header goes on with the record at the end of the file before.

    What runs over all files is a row for each file.
    """
    files = splits.groupBy("_file", "_path").agg((F.sum("headers") > 0).alias("_opens"), F.max_by("_after", "_block").alias("_bases"))
    order = Window.orderBy("_file", "_path")
    record = F.sum(F.col("_opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    so_far = F.sum("_bases").over(Window.partitionBy("_record").orderBy("_file", "_path").rowsBetween(Window.unboundedPreceding, 0))
    held = files.withColumn("_record", record).withColumn("_held", so_far).select("_file", "_path", F.lag("_held", 1, 0).over(order).alias("_held"))
    before = F.col("_before") + F.when(F.col("_goes_on"), F.col("_held")).otherwise(0)
    return splits.join(held, ["_file", "_path"]).withColumn("_before", before.cast("bigint")).drop("_held", "_after", "_goes_on")


class Pieces:
    """Cuts bases that arrive in order into pieces; ``before`` bases of the first record have gone by."""

    def __init__(self, record: int, before: int, size: int, halo: int):
        self.size, self.halo = size, halo
        self.open(record, before)

    def open(self, record: int, before: int = 0) -> None:
        self.record, self.at, self.held, self.parts = record, before, 0, []
        self.first = before // self.size - (before % self.size < self.halo and before >= self.size)  # the piece before still lacks its halo
        self.clipped = before > 0

    def _text(self) -> str:
        text = "".join(self.parts)
        self.parts = [text]
        return text

    def add(self, bases: str) -> Iterator[tuple]:
        self.parts.append(bases)
        self.held += len(bases)
        while self.at + self.held >= (self.first + 1) * self.size + self.halo:
            yield self._piece(True)

    def _piece(self, full: bool) -> tuple:
        text, begin = self._text(), self.first * self.size
        a, b = max(begin, self.at), min(begin + self.size + self.halo, self.at + self.held)
        row = self.record, self.first, a, text[a - self.at : b - self.at], full and a == begin
        keep = min(max((self.first + 1) * self.size, self.at), self.at + self.held)
        self.parts, self.held, self.at = [text[keep - self.at :]], self.at + self.held - keep, keep
        self.first += 1
        return row

    def close(self, ended: bool) -> Iterator[tuple]:
        """What is left of the record; its pieces are whole if the record both began and ended here."""
        while self.held:
            yield self._piece(ended and not (self.clipped and self.at > self.first * self.size))


def _cut(size: int, halo: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function from (KEY, is a header, value, _start, _before) of lines to pieces, and to those parts of pieces that a split has."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cut = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            for lo, hi, key in _stretches(batch):
                if key != at:
                    if cut:
                        out += cut.close(False)
                    at, cut = key, Pieces(batch.column(5)[lo].as_py() - 1, batch.column(6)[lo].as_py(), size, halo)
                for is_header, line in zip(batch.column(3)[lo:hi].to_pylist(), batch.column(4)[lo:hi].to_pylist(), strict=True):
                    if is_header:
                        out += cut.close(True)
                        cut.open(cut.record + 1)
                    elif line:
                        out += cut.add(line)
            yield _batch(out, _PIECE)
        if cut:
            yield _batch(list(cut.close(False)), _PIECE)

    return go


def read_pieces(spark: SparkSession, paths: list[str], halo: int, size: int = SIZE) -> DataFrame:
    """(rec_no, piece, start, bases) of the records of FASTA files; a record without bases has no piece. Lines from # on are left out.

    Files are read in order as one text: a file that begins without a header goes on with the record before.
    """
    if not 0 <= halo < size:
        raise ValueError("halo must be from 0 to size - 1")
    lines = read_rows(spark, paths).withColumn("value", F.rtrim(F.replace("value", F.lit("\r"), F.lit("")))).filter(~F.col("value").startswith("#"))
    is_header = F.col("value").startswith(">")
    counts = lines.select(*KEY, is_header.alias("header"), F.char_length("value").cast("bigint").alias("n")).mapInArrow(_counted, "_turn int, _path string, _block bigint, headers bigint, head bigint, tail bigint")
    carried = materialize(counts).groupBy("_turn", "_path").applyInPandas(_carried, "_turn int, _path string, _block bigint, headers bigint, _before bigint, _after bigint, _goes_on boolean")
    starts = materialize(with_start(_over_files(in_order(spark, materialize(carried), paths)), "headers", "_start").select(*KEY, "_start", "_before"))
    told = lines.join(known_splits(starts), KEY, "left").select(
        *KEY, is_header.alias("header"), "value", F.when(F.col("_start").isNull(), F.raise_error(F.lit("files were dealt into other splits than before"))).otherwise(F.col("_start")).alias("_start"), "_before"
    )
    cut = told.mapInArrow(_cut(size, halo), "rec_no bigint, piece bigint, at bigint, bases string, whole boolean")
    parts = F.array_sort(F.collect_list(F.struct("at", "bases")))  # as many as splits that a piece crosses
    crossing = cut.filter("not whole").groupBy("rec_no", "piece").agg(parts.alias("parts")).select("rec_no", "piece", F.array_join(F.transform("parts", lambda p: p["bases"]), "").alias("bases"))
    return cut.filter("whole").select("rec_no", "piece", "bases").unionByName(crossing).select("rec_no", "piece", (F.col("piece") * size).alias("start"), "bases")


def read_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(rec_no, header) of the records of FASTA files, without the > sign."""
    rows = renumbered(read_rows(spark, paths).filter(F.col("value").startswith(">")))
    return numbered(spark, rows, paths, "rec_no").select("rec_no", F.rtrim(F.replace(F.substring("value", 2, 1 << 30), F.lit("\r"), F.lit(""))).alias("header"))


def cut_pieces(seqs: DataFrame, halo: int, size: int = SIZE, rec: str = "rec_no") -> DataFrame:
    """(rec, piece, start, bases) of sequences that are strings of a table (``rec``, seq)."""
    kind = seqs.schema[rec].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, seq in enumerate(batch.column(1)):
                text = seq.as_py() or ""
                for start in range(0, len(text), size):
                    own = [batch.column(0).slice(i, 1), pa.array([start // size], pa.int64()), pa.array([start], pa.int64()), pa.array([text[start : start + size + halo]])]
                    yield pa.RecordBatch.from_arrays(own, [rec, "piece", "start", "bases"])

    return seqs.select(rec, "seq").mapInArrow(go, f"{rec} {kind}, piece bigint, start bigint, bases string")
