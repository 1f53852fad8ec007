"""k-mers dealt by their minimizer: neighbours travel together, two bits a base.

The minimizer of a k-mer is the smallest hash of its canonical windows of M bases, the same on both strands. Neighbouring k-mers
mostly share it, so a stretch of them (a super-k-mer) goes to the bucket of its minimizer as one string: about a byte for
a k-mer, where each k-mer by itself took ten and more. All k-mers that are equal meet in one bucket. A row holds a batch's
distinct stretches of one bucket: how many k-mers each has, their bases one after another, and how often each occurs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.functions.codes import _CODE, WORD, _packed, canonical_windows, code_names, widths, windows_of

#: Bases of a minimizer.
M = 11
#: Buckets that minimizers are dealt to.
BUCKETS = 2048
#: k-mers that are read before they are merged with those at hand.
CHUNK = 1 << 21
#: k-mers that are asked for together.
ASKED = 1 << 19
#: Most k-mers of a stretch.
MOST = 255
_MIX, _DEAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _minimizers(bases: np.ndarray, k: int) -> np.ndarray:
    """Smallest hash of the windows of M bases in each window of k; bases are 0 to 3."""
    m = min(M, k)
    codes, _ = canonical_windows(bases, m)
    least, size, wide = _mixed(codes[0].view(np.uint64) + np.uint64(1)), 1, k - m + 1
    while size < wide:
        step = min(size, wide - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return least


def _minimizers_of(codes: list[np.ndarray], k: int) -> np.ndarray:
    """``_minimizers`` of k-mers that do not follow one another."""
    if k > WORD:
        bases = np.stack([c >> 2 * (w - 1 - i) & 3 for c, w in zip(codes, widths(k), strict=True) for i in range(w)], axis=1).astype(np.uint8)
        return _minimizers(bases.ravel(), k)[::k]
    m, own, back = min(M, k), codes[0], np.zeros(len(codes[0]), np.int64)
    for i in range(k):
        back = back << 2 | 3 - (own >> 2 * i & 3)
    mask = (1 << 2 * m) - 1
    every = (np.minimum(own >> 2 * (k - m - i) & mask, back >> 2 * i & mask) for i in range(k - m + 1))
    return np.minimum.reduce([_mixed(c.view(np.uint64) + np.uint64(1)) for c in every])


def _bucket(minimizer: np.ndarray) -> np.ndarray:
    return ((minimizer * _DEAL) >> np.uint64(40)).astype(np.int64) % BUCKETS


def _pack(bases: np.ndarray) -> bytes:
    """Four bases a byte."""
    four = np.zeros(-(-len(bases) // 4) * 4, np.uint8)
    four[: len(bases)] = bases
    four = four.reshape(-1, 4)
    return (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).tobytes()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends of the values, 0 first) of a binary array."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def unpacked(sizes: pa.Array, bases: pa.Array, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(codes, stretch, number in the stretch) of all k-mers of some rows, in order."""
    n, rows = column_bytes(sizes)
    n = n.astype(np.int64)
    packed, begins = column_bytes(bases)
    stretch = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(stretch)) - np.repeat(np.cumsum(n) - n, n)
    wide = np.concatenate(([0], np.cumsum(n + k - 1)))
    first = wide[:-1] + np.repeat(4 * begins[:-1] - wide[rows[:-1]], np.diff(rows))  # a row's bases begin with a byte
    at = first[stretch] + nth
    if k <= 29:  # a window lies in eight bytes
        eight = np.concatenate((packed, np.zeros(8, np.uint8)))
        words = np.zeros(len(packed), np.uint64)
        for i in range(8):
            words = words << np.uint64(8) | eight[i : i + len(packed)]
        own = (words[at >> 2] >> (np.uint64(64 - 2 * k) - 2 * (at & 3).astype(np.uint64))) & np.uint64((1 << 2 * k) - 1)
        other = own ^ np.uint64((1 << 2 * k) - 1)
        for mask, by in ((0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4)):
            m, s = np.uint64(mask), np.uint64(by)
            other = (other & m) << s | (other >> s) & m
        back = other.byteswap() >> np.uint64(64 - 2 * k)
        return [np.minimum(own, back).view(np.int64)], stretch, nth
    flat = np.stack([packed >> s & 3 for s in (6, 4, 2, 0)], axis=1).ravel()
    codes, _ = canonical_windows(flat, k)
    return [c[at] for c in codes], stretch, nth


def _in_parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """A bucket's rows, about CHUNK k-mers at a time."""
    if table.num_rows:
        table = table.combine_chunks()
        most = max(1, CHUNK // max(1, 8 * len(table["sizes"].combine_chunks().buffers()[2] or b"") // table.num_rows))
        yield from table.to_batches(max_chunksize=most)


def _alike(bucket: np.ndarray, start: np.ndarray, wide: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, times, order): the first of each stretch's copies by bucket, how many there are, and all stretches in this order.

    A stretch of up to two words is told by its first and last word; a longer one counts as different from all others.
    """
    word = _packed(np.concatenate((bases, np.zeros(WORD, np.uint8))), WORD)
    head = word[start] >> 2 * np.maximum(WORD - wide, 0)
    tail = np.where(wide > WORD, word[np.maximum(start + wide - WORD, 0)], 0)
    order = np.lexsort((tail, head, wide, bucket))
    opens = wide[order] > 2 * WORD
    for v in (bucket, wide, head, tail):
        opens[1:] |= np.diff(v[order]) != 0
    opens[:1] = True
    edges = np.flatnonzero(opens)
    first, times = order[edges], np.diff(np.concatenate((edges, [len(order)])))
    by = np.lexsort((first, bucket[first]))  # as they come, so that keys stay sorted
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return first[by], times[by], order[np.argsort(np.repeat(place, times), kind="stable")]


def _planes(v: np.ndarray) -> bytes:
    """32-bit numbers with their first bytes first: high ones are mostly equal and pack well."""
    return v.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(data: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view(np.int32).ravel()


def _owners(names: pa.Array, xs: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """For each row the lengths of its stretches' keys, -1 for a null one, their places and the keys, packed."""
    lengths = np.array(names.is_valid()).astype(np.int32)
    data, ends = column_bytes(names.cast(pa.binary()))
    lengths = np.where(lengths > 0, np.diff(ends), -1).astype(np.int32)
    data = data.tobytes()
    return [zlib.compress(_planes(lengths[a:b]) + _planes(xs[a:b]) + data[ends[a] : ends[b]], 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _owned(packed: list[bytes], times: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """(keys, places) of rows of ``_owners``; ``times`` has each row's numbers of copies."""
    lengths, xs, data = [], [], []
    for blob, many in zip(packed, times, strict=True):
        body, n = zlib.decompress(blob), int(many.sum())
        lengths.append(_unplaned(body, n))
        xs.append(_unplaned(body, n, 4 * n))
        data.append(body[8 * n :])
    size = np.concatenate(lengths)
    ends = np.concatenate(([0], np.cumsum(np.maximum(size, 0)))).astype(np.int64)
    valid = pa.py_buffer(np.packbits(size >= 0, bitorder="little").tobytes())
    keys = pa.Array.from_buffers(pa.large_string(), len(size), [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(data))])
    return keys, np.concatenate(xs)


def _times(column: pa.Array) -> list[np.ndarray]:
    """How often each stretch of each row occurs."""
    return [_unplaned(data, len(data) // 4) for data in map(zlib.decompress, column.to_pylist())]


def deal(seqs: DataFrame, k: int, key: str | None = None, seq: str = "seq", share: tuple[int, int] = (0, 1), group: str | None = None) -> DataFrame:
    """(bucket, sizes, bases, times) of all k-mers of A, C, G and T; with ``key``, ``owners`` has its value, as text, and the place of each copy of each stretch.

    ``share`` (i, n) leaves only the i-th of n parts of the buckets, for work in n passes. With ``group``, rows have its value and the k-mers of that group only.
    """
    columns = ["sizes", "bases", "times", *(["owners"] if key else [])]
    fields = [T.StructField("bucket", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in columns)]
    names = [f.name for f in fields]

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for g in pc.unique(column):
                own = batch.filter(pc.is_null(column) if not g.is_valid else pc.fill_null(pc.equal(column, g), False))
                for row in run(iter([own.select([seq])])):
                    yield row.append_column(group, pa.array([g.as_py()] * row.num_rows, column.type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, place, inside, clean in windows_of(batch.column(0), k):
                own = np.flatnonzero(inside & clean)
                if not len(own):
                    continue
                codes = _CODE[part] & 3
                least = _minimizers(codes, k)[own]
                opens = np.flatnonzero(np.concatenate(([True], (np.diff(own) != 1) | (np.diff(least) != 0) | (np.diff(row[own]) != 0))))
                size = np.diff(np.concatenate((opens, [len(own)])))
                if share[1] > 1:
                    mine = np.flatnonzero(_bucket(least[opens]) % share[1] == share[0])
                    opens, size = opens[mine], size[mine]
                    if not len(mine):
                        continue
                if size.max() > MOST:  # text of a short period
                    more = -(-size // MOST)
                    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                    opens, size = np.repeat(opens, more) + nth * MOST, np.minimum(np.repeat(size, more) - nth * MOST, MOST)
                first, times, order = _alike(_bucket(least[opens]), own[opens], size + k - 1, codes)
                bucket, start, sizes = _bucket(least[opens[first]]), own[opens[first]], size[first].astype(np.uint8)
                wide = size[first] + k - 1
                ends = np.cumsum(wide)
                flat = codes[np.arange(ends[-1]) + np.repeat(start - (ends - wide), wide)]
                edges = np.concatenate((np.flatnonzero(np.concatenate(([True], np.diff(bucket) != 0))), [len(bucket)]))
                stops = np.concatenate(([0], ends))[edges]
                out = [
                    pa.array(bucket[edges[:-1]].astype(np.int32)),
                    pa.array([sizes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                    pa.array([_pack(flat[a:b]) for a, b in zip(stops[:-1], stops[1:], strict=True)], pa.binary()),
                    pa.array([zlib.compress(_planes(times[a:b]), 1) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                ]
                if key:
                    at = own[opens[order]]
                    copies = np.concatenate(([0], np.cumsum(times)))[edges]
                    out.append(pa.array(_owners(batch.column(1).take(pa.array(row[at])), place[at].astype(np.int32), copies), pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names)

    if group:
        return seqs.select(seq, group).mapInArrow(grouped, T.StructType([*fields, seqs.schema[group]]))
    return seqs.select(seq, *([F.col(key).cast("string").alias(key)] if key else [])).mapInArrow(run, T.StructType(fields))


def _distinct(table: pa.Table, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct k-mers of a bucket's rows, and how often each occurs: rows are read about CHUNK k-mers at a time."""
    names = code_names(k)
    held: list[np.ndarray] = [np.zeros(0, np.int64) for _ in names]
    many = np.zeros(0, np.int64)
    parts: list[list[np.ndarray]] = []
    often: list[np.ndarray] = []
    waiting = 0

    def merged() -> None:
        nonlocal held, many, parts, often, waiting
        columns = [np.concatenate([h, *(p[j] for p in parts)]) for j, h in enumerate(held)]
        n = np.concatenate([many, *often])
        order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        first = np.flatnonzero(np.concatenate(([True], np.any([np.diff(c) != 0 for c in columns], axis=0))))
        held, many = [c[first] for c in columns], np.add.reduceat(n[order], first)
        parts, often, waiting = [], [], 0

    for rows in _in_parts(table.select(["sizes", "bases", "times"])):
        codes, stretch, _ = unpacked(rows.column(0), rows.column(1), k)
        parts.append(codes)
        often.append(np.concatenate(_times(rows.column(2))).astype(np.int64)[stretch])
        waiting += len(codes[0])
        if waiting >= max(CHUNK, len(many)):
            merged()
    if waiting:
        merged()
    return held, many


def counted(dealt: DataFrame, k: int) -> DataFrame:
    """(codes, n) over all k-mers of ``deal``: those of one bucket are counted where the bucket lies, so no k-mer is shuffled by itself.

    A task holds a bucket packed, and its distinct k-mers.
    """
    names = code_names(k)

    def own(table: pa.Table) -> pa.Table:
        codes, n = _distinct(table, k)
        return pa.table([*codes, n], names=[*names, "n"])

    return dealt.select("bucket", "sizes", "bases", "times").groupBy("bucket").applyInArrow(own, ", ".join(f"{c} bigint" for c in [*names, "n"]))


def size(dealt: DataFrame, k: int) -> int:
    """How many distinct k-mers there are in all; a number for each bucket is all that leaves it."""

    def own(table: pa.Table) -> pa.Table:
        return pa.table([pa.array([len(_distinct(table, k)[1])], pa.int64())], names=["n"])

    found = dealt.select("bucket", "sizes", "bases", "times").groupBy("bucket").applyInArrow(own, "n bigint")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def sizes(seqs: DataFrame, k: int, group: str, seq: str = "seq") -> DataFrame:
    """(group, n): how many distinct k-mers the sequences of each group have."""
    kind = seqs.schema[group].dataType.simpleString()

    def own(table: pa.Table) -> pa.Table:
        groups = pc.unique(table[group])
        of = lambda g: pc.is_null(table[group]) if g is None else pc.equal(table[group], g)
        n = [len(_distinct(table.filter(of(g.as_py())), k)[1]) for g in groups]
        return pa.table([groups, pa.array(n, pa.int64())], names=[group, "n"])

    met = deal(seqs, k, seq=seq, group=group).groupBy("bucket").applyInArrow(own, f"`{group}` {kind}, n bigint")
    return met.groupBy(group).agg(F.sum("n").alias("n"))


def _member(codes: list[np.ndarray], known: list[np.ndarray]) -> np.ndarray:
    """Which k-mers are among sorted distinct ones."""
    if not len(known[0]):
        return np.zeros(len(codes[0]), bool)
    if len(codes) > 1:
        kind = [(f"c{j}", np.int64) for j in range(len(codes))]
        codes = [np.rec.fromarrays(codes, dtype=kind)]
        known = [np.rec.fromarrays(known, dtype=kind)]
    at = np.minimum(np.searchsorted(known[0], codes[0]), len(known[0]) - 1)
    return known[0][at] == codes[0]


def absent_runs(seqs: DataFrame, reference: DataFrame, k: int, key: str = "id", seq: str = "seq", share: tuple[int, int] = (0, 1)) -> DataFrame:
    """(key, a, b): first and last k-mer start of runs of starts of ``seqs`` that are not in ``reference``, k-mers of ``deal``.

    A run may go on in the next one, as a stretch ends it; starts with other letters than A, C, G and T are absent.
    With ``share`` (i, n) both sides are those of ``deal``, and the runs of all n passes are the whole.
    """
    kind = seqs.schema[key].dataType.simpleString()

    def own(asked: pa.Table, held: pa.Table) -> pa.Table:
        known, _ = _distinct(held, k)
        out = []
        for rows in _in_parts(asked.select(["sizes", "bases", "times", "owners"])):
            codes, stretch, nth = unpacked(rows.column(0), rows.column(1), k)
            miss = np.flatnonzero(~_member(codes, known))
            if not len(miss):
                continue
            opens = np.concatenate(([True], (np.diff(miss) != 1) | (np.diff(stretch[miss]) != 0)))
            first = np.flatnonzero(opens)
            last = np.concatenate((first[1:], [len(miss)])) - 1
            each = _times(rows.column(2))
            keys, xs = _owned(rows.column(3).to_pylist(), each)
            times = np.concatenate(each).astype(np.int64)
            which = stretch[miss[first]]
            many = times[which]  # a run goes to each copy of its stretch
            copy = np.arange(many.sum()) + np.repeat((np.cumsum(times) - times)[which] - (np.cumsum(many) - many), many)
            a, b = (np.repeat(nth[miss[v]], many) + xs[copy] for v in (first, last))
            out.append(pa.table([keys.take(pa.array(copy)).cast(pa.string()), a.astype(np.int32), b.astype(np.int32)], names=[key, "a", "b"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.int32())], names=[key, "a", "b"])

    def unclean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row, place, inside, clean in windows_of(batch.column(0), k):
                at = np.flatnonzero(inside & ~clean)
                if len(at):
                    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(row[at]) != 0))))
                    last = np.concatenate((first[1:], [len(at)])) - 1
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row[at[first]])), pa.array(place[at[first]].astype(np.int32)), pa.array(place[at[last]].astype(np.int32))], [key, "a", "b"])

    schema = f"`{key}` {kind}, a int, b int"
    text = f"`{key}` string, a int, b int"
    found = deal(seqs, k, key, seq, share).groupBy("bucket").cogroup(reference.select("bucket", "sizes", "bases", "times").groupBy("bucket")).applyInArrow(own, text)
    found = found.withColumn(key, F.col(key).cast(kind))
    if share[0]:
        return found  # the first pass has the starts without a bucket
    return found.unionByName(seqs.filter(F.col(seq).rlike("[^ACGT]")).select(seq, key).mapInArrow(unclean, schema))


def _once(codes: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct k-mers, in order."""
    if len(codes) == 1:
        own = np.sort(codes[0])
        return [own[np.diff(own, prepend=-1) != 0]]
    order = np.lexsort(codes[::-1])
    codes = [c[order] for c in codes]
    first = np.any([np.diff(c, prepend=-1) != 0 for c in codes], axis=0)
    return [c[first] for c in codes]


def members(asked: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """(codes): the distinct k-mers of ``asked`` (codes) that are in ``reference``, k-mers of ``deal``.

    Those that are asked go to their buckets packed, about ASKED at a time and each of them once.
    """
    names = code_names(k)
    ddl = ", ".join(f"{c} bigint" for c in names)

    def put(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        codes = [np.concatenate([b.column(j).to_numpy() for b in held]) for j in range(len(names))]
        fine = np.all([c >= 0 for c in codes], axis=0)
        codes = _once([c[fine] for c in codes])
        bucket = _bucket(_minimizers_of(codes, k)) if len(codes[0]) else np.zeros(0, np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        parts = [[p.tobytes() for p in np.split(c[order], first[1:])] if len(first) else [] for c in codes]
        return pa.RecordBatch.from_arrays([pa.array(bucket[order][first].astype(np.int32)), *(pa.array(p, pa.binary()) for p in parts)], ["bucket", *names])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ASKED:
                yield put(held)
                held = []
        if held:
            yield put(held)

    def own(question: pa.Table, held: pa.Table) -> pa.Table:
        codes = _once([np.frombuffer(b"".join(question[c].to_pylist()), np.int64) for c in names])
        found = _member(codes, _distinct(held, k)[0]) if len(codes[0]) else np.zeros(0, bool)
        return pa.table([c[found] for c in codes], names=names)

    dealt = asked.select(*names).mapInArrow(routed, "bucket int, " + ", ".join(f"{c} binary" for c in names))
    return dealt.groupBy("bucket").cogroup(reference.select("bucket", "sizes", "bases", "times").groupBy("bucket")).applyInArrow(own, ddl)
