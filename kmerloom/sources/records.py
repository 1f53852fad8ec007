"""Records of several lines, cut from file splits by a state machine that runs on all splits at once.

What a line is depends on the lines before it: a line that begins with @ may be a header or a quality string. A first pass
computes for each split, from the first letters of its lines, the function from the state at its
start to that at its end, and how many records begin in it for each start. Putting these small functions
together along a file, a row for each split, gives every split its true start; a second pass then cuts its lines into records.
Only lines at the start of a split that end a record begun before it are sent to that record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.sources.splits import KEY, in_order, known_splits, read_rows, with_start
from kmerloom.storage import materialize

#: States before a line: between records, the first and further lines of a FASTA body, lines 2, 3 and 4 of a FASTQ record.
BETWEEN, FIRST, BODY, BASES, PLUS, QUALITY = range(6)
#: Classes of lines.
OTHER, GREATER, HASH, AT, SAM_HEADER, BLANK = range(6)

#: Next state and whether a record begins, by state and class, where records of all kinds may stand.
_ANY = {
    BETWEEN: {OTHER: (BETWEEN, 1), GREATER: (FIRST, 1), HASH: (BETWEEN, 0), AT: (BASES, 1), SAM_HEADER: (BETWEEN, 0), BLANK: (BETWEEN, 0)},
    BODY: {OTHER: (BODY, 0), GREATER: (FIRST, 1), HASH: (BETWEEN, 0), AT: (BODY, 0), SAM_HEADER: (BODY, 0), BLANK: (BODY, 0)},
}
#: Records of four lines each, whatever these are.
_FOURS = {BETWEEN: dict.fromkeys(range(6), (BASES, 1))}
_BOTH = {FIRST: dict.fromkeys(range(6), (BODY, 0)), BASES: dict.fromkeys(range(6), (PLUS, 0)), PLUS: dict.fromkeys(range(6), (QUALITY, 0)), QUALITY: dict.fromkeys(range(6), (BETWEEN, 0))}
MACHINES = {"any": _ANY | _BOTH, "fastq": _BOTH | _FOURS | {BODY: dict.fromkeys(range(6), (BODY, 0))}}
#: Letters of all lines that complete records over split edges, up to which they are broadcast.
BROADCAST_LETTERS = 64_000_000


def line_class(head: Column) -> Column:
    """Class of a line, from its first letters."""
    header = head.rlike("^@[A-Za-z]{2}\t")
    return (
        F.when(head.startswith(">"), GREATER).when(head.startswith("#"), HASH).when(head.startswith("@"), F.when(header, SAM_HEADER).otherwise(AT))
        .when(F.rtrim(F.replace(head, F.lit("\r"), F.lit(""))) == "", BLANK).otherwise(OTHER).cast("tinyint")
    )


def _class(machine: str) -> Column:
    """Class of each line; records of four lines do not ask for it."""
    return F.lit(OTHER).cast("tinyint") if machine == "fastq" else line_class(F.substring("value", 1, 4))


def _tables(machine: str) -> tuple[np.ndarray, np.ndarray]:
    table = MACHINES[machine]
    cells = np.array([[table[s][c] for c in range(6)] for s in range(6)], np.int64)
    return cells[:, :, 0], cells[:, :, 1]


def composed(classes: np.ndarray, machine: str) -> tuple[np.ndarray, np.ndarray]:
    """(state after the lines, records that begin in them) for each state before; neighbouring functions are put together until one is left."""
    step, begin = _tables(machine)
    to, n = step.T[classes], begin.T[classes]
    if not len(classes):
        return np.arange(6), np.zeros(6, np.int64)
    while len(to) > 1:
        odd = (to[-1:], n[-1:]) if len(to) % 2 else (to[:0], n[:0])
        a, b = to[: len(to) - len(odd[0]) : 2], to[1::2]
        m = n[: len(to) - len(odd[0]) : 2] + np.take_along_axis(n[1::2], a, 1)
        to, n = np.concatenate((np.take_along_axis(b, a, 1), odd[0])), np.concatenate((m, odd[1]))
    return to[0], n[0]


def led(classes: np.ndarray, state: int, machine: str) -> tuple[int, int]:
    """(how many of the lines end a record that is open in ``state``, the state behind them; BETWEEN where the record has ended)."""
    step, begin = _tables(machine)
    n = 0
    while state != BETWEEN and n < len(classes):
        if state == BODY:  # any number of lines
            ends = np.flatnonzero((step[BODY] != BODY)[classes[n:]] | (begin[BODY] > 0)[classes[n:]])
            n += int(ends[0]) if len(ends) else len(classes) - n
            if not len(ends):
                return n, BODY
        c = classes[n]
        if begin[state, c]:
            return n, BETWEEN
        state, n = int(step[state, c]), n + 1
    return n, state


def _summaries(machine: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function from (KEY, class, _row) to (KEY, exits, counts, leads, _first) of each split."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, to, n = None, np.arange(6), np.zeros(6, np.int64)
        first, lead, left = 0, [0] * 6, list(range(6))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(KEY, at, strict=True)) | {"exits": to.tolist(), "counts": n.tolist(), "leads": lead, "_first": first}], schema=_SUMMARY)

        for batch in batches:
            if not batch.num_rows:
                continue
            classes = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, key in _stretches(batch):
                if key != at:
                    if at is not None:
                        yield out()
                    at, to, n = key, np.arange(6), np.zeros(6, np.int64)
                    first, lead, left = batch.column(4)[lo].as_py(), [0] * 6, list(range(6))
                for s in range(6):
                    more, left[s] = led(classes[lo:hi], left[s], machine)
                    lead[s] += more
                more, begun = composed(classes[lo:hi], machine)
                to, n = more[to], n + begun[to]
        if at is not None:
            yield out()

    return go


_SUMMARY = pa.schema([("_turn", pa.int32()), ("_path", pa.string()), ("_block", pa.int64()), ("exits", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("leads", pa.list_(pa.int64())), ("_first", pa.int64())])


def _runs(batch: pa.RecordBatch) -> list[tuple[int, int, int]]:
    """(first, after last, split) of runs of rows of one split, whose number is the first column."""
    split = batch.column(0).to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(split) != 0) + 1).tolist(), batch.num_rows]
    return [(lo, hi, int(split[lo])) for lo, hi in zip(edges, edges[1:], strict=False)]


def _stretches(batch: pa.RecordBatch) -> list[tuple[int, int, tuple]]:
    """(first, after last, key) of runs of rows of one split."""
    turn, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
    path = batch.column(1).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero((np.diff(turn) != 0) | (np.diff(block) != 0) | (np.diff(path) != 0)) + 1).tolist(), batch.num_rows]
    return [(lo, hi, tuple(batch.column(i)[lo].as_py() for i in range(3))) for lo, hi in zip(edges, edges[1:], strict=False)]


def _followed(splits: pd.DataFrame) -> pd.DataFrame:
    """State before, records begun and lines that end one begun before, in each split of one file."""
    state, states, counts, leads = BETWEEN, [], [], []
    splits = splits.sort_values("_block")
    for exits, begun, lead in zip(splits["exits"], splits["counts"], splits["leads"], strict=True):
        states.append(state)
        counts.append(int(begun[state]))
        leads.append(int(lead[state]))
        state = int(exits[state])
    return splits[[*KEY, "_first"]].assign(_state=states, _n=counts, _lead=leads)


def split_starts(spark: SparkSession, rows: DataFrame, paths: list[str], machine: str) -> DataFrame:
    """(KEY, _state, _start, _split, _first, _lead): the state before the first line of each split, the number of the first record that
    begins in it, a number of the split, its first ``_row``, and how many of its lines end a record begun before it."""
    classes = rows.select(*KEY, _class(machine).alias("_class"), "_row")
    own = materialize(classes.mapInArrow(_summaries(machine), "_turn int, _path string, _block bigint, exits array<int>, counts array<bigint>, leads array<bigint>, _first bigint"))
    followed = own.groupBy("_turn", "_path").applyInPandas(_followed, "_turn int, _path string, _block bigint, _first bigint, _state int, _n bigint, _lead bigint")
    placed = with_start(in_order(spark, materialize(followed), paths), "_n", "_start")
    return materialize(placed.select(*KEY, "_state", "_start", F.monotonically_increasing_id().alias("_split"), "_first", "_lead"))


class _Cut:
    """Lines of one split cut into records that begin in it."""

    def __init__(self, machine: str, state: int, number: int):
        self.step, self.begin = (t.tolist() for t in _tables(machine))
        self.state, self.number = state, number - 1
        self.header: str | None = None
        self.seq: list[str] = []
        self.qual: str | None = None

    def close(self, ended: bool) -> Iterator[tuple]:
        if self.header is not None:
            kind = {AT: "@", GREATER: ">"}.get(self.kind, "line")
            yield self.number, kind, self.header, "".join(self.seq), self.qual, None if ended else self.state
        self.header, self.seq, self.qual = None, [], None

    def add(self, lines: list[str], classes: list[int]) -> Iterator[tuple]:
        for line, c in zip(lines, classes, strict=True):
            state = self.state
            if self.begin[state][c]:
                yield from self.close(True)
                self.number += 1
                self.header, self.kind = line.rstrip("\r"), c if self.step[state][c] != BASES else AT
            elif self.header is not None:
                if state == QUALITY:
                    self.qual = line.rstrip("\r")
                elif state in (FIRST, BASES) or state == BODY and c != HASH:
                    self.seq.append(line.rstrip("\r"))
            self.state = self.step[state][c]
            if self.state == BETWEEN:
                yield from self.close(True)


_RECORD = pa.schema([("rec_no", pa.int64()), ("kind", pa.string()), ("header", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("_open", pa.int32())])
_HEAD = pa.schema([("rec_no", pa.int64()), ("_block", pa.int64()), ("lines", pa.list_(pa.string()))])


def _fours(cut: _Cut, lines: pa.Array) -> Iterator[pa.RecordBatch]:
    """``_Cut.add`` for a run of lines of records of four lines: whole records are taken from the batch at once."""
    first = 0
    while cut.state != BETWEEN and first < len(lines):  # what is left of the record at hand
        first += 1
        yield _batch(list(cut.add(lines.slice(first - 1, 1).to_pylist(), [OTHER])), _RECORD)
    n = (len(lines) - first) // 4
    if n:
        part = [pc.utf8_rtrim(lines.take(pa.array(np.arange(first + i, first + 4 * n, 4))), "\r") for i in (0, 1, 3)]
        number = pa.array(cut.number + 1 + np.arange(n))
        cut.number += n
        kind, closed = pa.array(np.full(n, "@", object), pa.string()), pa.nulls(n, pa.int32())
        yield pa.RecordBatch.from_arrays([number, kind, *part, closed], schema=_RECORD)
    rest = lines.slice(first + 4 * n).to_pylist()
    yield _batch(list(cut.add(rest, [OTHER] * len(rest))), _RECORD)


def _steps(classes: np.ndarray, state: int, step: list[list[int]]) -> np.ndarray:
    """The state before each line, and behind the last."""
    out = [state]
    for c in classes.tolist():
        state = step[state][c]
        out.append(state)
    return np.array(out)


def _anys(cut: _Cut, lines: pa.Array, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``_Cut.add`` for a run of lines of records of all kinds: records that begin and end in it are taken from the batch at once."""
    step, begin = np.array(cut.step), np.array(cut.begin)
    first, _ = led(classes, cut.state if cut.header is not None else BETWEEN, "any")  # what is left of the record at hand
    yield _batch(list(cut.add(lines.slice(0, first).to_pylist(), classes[:first].tolist())), _RECORD)
    lines, classes = lines.slice(first), classes[first:]
    if not len(lines):
        return
    state = _steps(classes, cut.state, cut.step)
    before, behind = state[:-1], state[1:]
    heads = np.flatnonzero(begin[before, classes])
    if len(heads) and cut.header is not None:  # it ends where the next one begins
        yield _batch(list(cut.close(True)), _RECORD)
    whole = heads if behind[-1] == BETWEEN else heads[:-1]  # the last one may go on in the next batch
    stop = len(lines) if len(whole) == len(heads) else heads[-1]
    if len(whole):
        before, behind, known = before[:stop], behind[:stop], classes[:stop]
        opens = np.zeros(stop, bool)
        opens[whole] = True
        record = np.cumsum(opens) - 1
        body = np.flatnonzero(~opens & (record >= 0) & ((before == FIRST) | (before == BASES) | ((before == BODY) & (known != HASH))))
        qual = np.flatnonzero(~opens & (record >= 0) & (before == QUALITY))
        trimmed = lambda at: pc.utf8_rtrim(lines.take(pa.array(at)), "\r")
        ends = np.searchsorted(record[body], np.arange(len(whole) + 1))
        seq = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), trimmed(body)), "")
        rank = np.full(len(whole), -1)
        rank[record[qual]] = np.arange(len(qual))
        own = trimmed(qual).take(pa.array(rank, mask=rank < 0))
        kind = np.where(step[before[whole], known[whole]] == BASES, "@", np.where(known[whole] == AT, "@", np.where(known[whole] == GREATER, ">", "line")))
        number = pa.array(cut.number + 1 + np.arange(len(whole)))
        yield pa.RecordBatch.from_arrays([number, pa.array(kind.astype(object), pa.string()), trimmed(whole), seq, own, pa.nulls(len(whole), pa.int32())], schema=_RECORD)
    cut.number += len(whole)
    cut.state = int(state[stop])
    yield _batch(list(cut.add(lines.slice(stop).to_pylist(), classes[stop:].tolist())), _RECORD)


def _records(machine: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function from (_split, _state, _start, class, value) to the records that begin in each split; the last may lack lines of the next split."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cut = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            classes = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            lines = batch.column(4).cast(pa.string())
            for lo, hi, split in _runs(batch):
                if split != at:
                    if cut:
                        yield _batch(list(cut.close(False)), _RECORD)
                    at, cut = split, _Cut(machine, batch.column(1)[lo].as_py(), batch.column(2)[lo].as_py())
                own = lines.slice(lo, hi - lo)
                yield from _fours(cut, own) if machine == "fastq" else _anys(cut, own, classes[lo:hi])
        if cut:
            yield _batch(list(cut.close(False)), _RECORD)

    return go


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _heads(machine: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function from the same columns and _block to the lines at each split's start that belong to a record begun before it."""
    step, begin = (t.tolist() for t in _tables(machine))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, number, block, lines = None, BETWEEN, 0, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            for lo, hi, split in _runs(batch):
                if split != at:
                    if lines:
                        out.append((number, block, lines))
                    at, state, number, lines = split, batch.column(1)[lo].as_py(), batch.column(2)[lo].as_py() - 1, []
                    block = batch.column(5)[lo].as_py()
                while state != BETWEEN and lo < hi:
                    c = batch.column(3)[lo].as_py()
                    if begin[state][c]:
                        state = BETWEEN
                        break
                    if not (state == BODY and c == HASH):
                        lines.append(batch.column(4)[lo].as_py().rstrip("\r"))
                    state = step[state][c]
                    lo += 1
            yield _batch(out, _HEAD)
        if lines:
            yield _batch([(number, block, lines)], _HEAD)

    return go


def cut_records(spark: SparkSession, paths: list[str], machine: str = "any") -> DataFrame:
    """(rec_no, kind, header, seq, qual) of the records of files in the order of ``paths``.

    ``kind`` is > or @, by the header's first letter, or ``line`` for a record of one line, which then is its header. ``rec_no`` counts from 0.
    ``machine`` is ``any`` or ``fastq``, records of four lines.
    """
    rows = read_rows(spark, paths)
    starts = split_starts(spark, rows, paths, machine)
    state = F.when(F.col("_state").isNull(), F.raise_error(F.lit("files were dealt into other splits than before"))).otherwise(F.col("_state"))
    placed = rows.join(known_splits(starts), KEY, "left")
    own = ["_split", state.alias("_state"), "_start", _class(machine).alias("_class"), "value"]
    led_by = placed.filter(F.col("_row") - F.col("_first") < F.col("_lead"))  # a few lines of each split are all that goes to Python again
    records = placed.select(*own).mapInArrow(_records(machine), "rec_no bigint, kind string, header string, seq string, qual string, _open int")
    heads = led_by.select(*own, "_block").mapInArrow(_heads(machine), "rec_no bigint, _block bigint, lines array<string>")
    heads = materialize(heads.groupBy("rec_no").agg(F.array_sort(F.collect_list(F.struct("_block", "lines"))).alias("_parts")))
    rest = heads.select("rec_no", F.flatten(F.transform("_parts", lambda p: p["lines"])).alias("_rest"))
    letters = rest.agg(F.sum(F.char_length(F.array_join("_rest", "\n")))).first()[0] or 0
    if letters <= BROADCAST_LETTERS:
        return _completed(records.join(F.broadcast(rest), "rec_no", "left"))
    whole = records.filter(F.col("_open").isNull()).withColumn("_rest", F.lit(None).cast("array<string>"))
    return _completed(whole).unionByName(_completed(records.filter(F.col("_open").isNotNull()).join(rest, "rec_no", "left")))


def _completed(records: DataFrame) -> DataFrame:
    """Records with the lines that stand behind the edge of their split."""
    state, rest = F.col("_open"), F.coalesce("_rest", F.array().cast("array<string>"))
    body = F.concat("seq", F.array_join(rest, ""))
    seq = F.when(state.isin(FIRST, BODY), body).when(state == BASES, F.coalesce(F.get(rest, F.lit(0)), F.lit(""))).otherwise(F.col("seq"))
    qual = F.when(state.isin(BASES, PLUS, QUALITY), F.get(rest, QUALITY - state)).otherwise(F.col("qual"))
    return records.select("rec_no", "kind", "header", seq.alias("seq"), qual.alias("qual"))
