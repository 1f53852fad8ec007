"""Exon junctions from k-mer membership along transcripts.

What is not in the set is found piece by piece: a record's k-mer starts are dealt into
pieces of a bounded length, missing starts become runs inside their piece, and only
runs, about as many as a record has junctions, meet per record. With a leniency of zero
the boundary list follows from the runs of hits alone. With more, bases are probed and
corrected at each gap, which is a walk over one record. Both give a boundary list per record:
1-based inclusive places, start of the first segment, pairs around each junction, end of the last.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.operators.kmers import missing_kmers, reference_set
from kmerloom.functions.codes import WORD, code_names
from kmerloom.operators import bloom
from kmerloom.operators.gaps import Episode, Members, corrected
from kmerloom.operators.lookup import BROADCAST_LIMIT, Has, answer_records
from kmerloom.storage import materialize

#: Least novel bases of an exon between two others.
MIN_EXON = 5
#: Hits in a row that make sure of a place.
SURE = 3
#: Order in which bases are tried.
PROBE_ORDER = "ATGC"
#: k-mer starts of a piece.
PIECE = 4096


def leniency_from_rate(leniency: int, factor: float, rate: float, k: int) -> int:
    """The default leniency of 10 gives way to ceil(factor * rate * k) where a factor is set."""
    return -int(-(factor * rate * k) // 1) if leniency == 10 and factor else leniency


def leniency_column(leniency: Column, factor: Column, rate: Column, k: int) -> Column:
    """``leniency_from_rate`` of columns."""
    return F.when((leniency == 10) & (factor != 0), F.ceil(factor * rate * k).cast("int")).otherwise(leniency)


def long_enough(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    return seqs.filter(F.char_length(seq) >= k + MIN_EXON)


def missing_runs(seqs: DataFrame, kmers: DataFrame, k: int, piece: int = PIECE) -> DataFrame:
    """(id, a, b): first and last k-mer start of each run of starts that are not in the set, cut where a piece ends."""
    absent = missing_kmers(long_enough(seqs, k), kmers, k, valid_only=False).select("id", "x", F.expr(f"x div {piece}").alias("piece"))
    nth = F.row_number().over(Window.partitionBy("id", "piece").orderBy("x"))
    return (
        absent.withColumn("run", F.col("x") - nth)
        .groupBy("id", "piece", "run")
        .agg(F.min("x").alias("a"), F.max("x").alias("b"))
        .select("id", "a", "b")
    )


def hit_runs(seqs: DataFrame, kmers: DataFrame, k: int, piece: int = PIECE) -> DataFrame:
    """(id, n, s, e): first and last of each run of k-mer starts that are in the set; n starts are scanned, the two after them looked at only."""
    return runs_between(seqs, missing_runs(seqs, kmers, k, piece), k)


def runs_between(seqs: DataFrame, missing: DataFrame, k: int) -> DataFrame:
    """``hit_runs`` from the runs of missing starts (id, a, b); these may stand end to end."""
    own = long_enough(seqs, k).select("id", (F.char_length("seq") - k + 1).alias("starts"))
    absent = missing.select("id", "a", "b", F.lit(None).cast("int").alias("starts"))
    edges = absent.unionByName(own.select("id", F.col("starts").alias("a"), F.col("starts").alias("b"), "starts"))
    along = Window.partitionBy("id").orderBy("a")
    whole = Window.partitionBy("id")
    return (
        edges.withColumns({"s": F.lag("b", 1, -1).over(along) + 1, "e": F.col("a") - 1, "n": F.max("starts").over(whole) - 2})
        .filter("e >= s")
        .select("id", "n", "s", "e")
    )


def first_match(runs: DataFrame) -> DataFrame:
    """(id, first_x): the first start of three hits in a row."""
    return runs.filter(F.col("e") - F.col("s") >= SURE - 1).groupBy("id").agg(F.min("s").alias("first_x"))


def last_match(runs: DataFrame, k: int) -> DataFrame:
    """(id, last_pos): 1-based end of the last scanned hit."""
    return runs.filter(F.col("s") < F.col("n")).groupBy("id").agg(F.max(F.least(F.col("e"), F.col("n") - 1) + k).alias("last_pos"))


def gaps(runs: DataFrame) -> DataFrame:
    """(id, start_x, end_x): first miss after three hits in a row, and the next start of three hits in a row."""
    sure = runs.filter(F.col("e") - F.col("s") >= SURE - 1)
    following = F.lead("s").over(Window.partitionBy("id").orderBy("s"))
    return sure.select("id", (F.col("e") + 1).alias("start_x"), following.alias("end_x")).filter("end_x is not null")


def boundaries_by_windows(seqs: DataFrame, kmers: DataFrame, k: int, leniency: int = 0) -> DataFrame:
    """(id, bounds) without probing of substitutions.

    At leniency 0 this is the operator itself. A positive leniency only lowers the
    least gap of a junction and lets a long gap be an exon of its own (an extension:
    there are no votes).
    """
    return bounds_of_runs(hit_runs(seqs, kmers, k), k, leniency)


def bounds_of_runs(runs: DataFrame, k: int, leniency: int = 0) -> DataFrame:
    """(id, bounds) from runs of hits; records without three hits in a row have no row."""
    per = runs.groupBy("id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))
    sure = F.filter("runs", lambda r: r["e"] - r["s"] >= SURE - 1)
    scanned = F.filter("runs", lambda r: r["s"] < F.col("n"))
    per = per.withColumns({"sure": sure, "last_pos": F.least(F.element_at(scanned, -1)["e"], F.col("n") - 1) + k}).filter(F.size("sure") > 0)
    between = F.zip_with(F.slice("sure", 1, F.size("sure") - 1), F.slice("sure", 2, F.size("sure") - 1), lambda a, b: F.struct((a["e"] + 1 + k).alias("start"), (b["s"] + k).alias("end")))

    def pairs(g: Column) -> Column:
        start, end = g["start"], g["end"]
        middle = F.array(start - 1, start) if leniency == 0 else F.array(start - 1, start, end - k - 1, end - k)
        return F.when(end - start > k + MIN_EXON, middle).when(end - start >= k - leniency - 2, F.array(start - 1, end - k)).otherwise(F.array().cast("array<int>"))

    return per.select("id", F.concat(F.array(F.element_at("sure", 1)["s"] + 1), F.flatten(F.transform(between, pairs)), F.array("last_pos")).alias("bounds"))


class _Record:
    """One record under correction: its bases, and which of its k-mer starts hit."""

    def __init__(self, seq: str, k: int, has: Has, missing: list[tuple[int, int]] | None):
        self.bases, self.k, self.has = list(seq), k, has
        n = len(seq) - k + 1
        self.scanned = n - 2
        self.hits = bytearray(b"\x01" * n if missing is not None else b"\x02" * n)  # 0 miss, 1 hit, 2 not asked yet
        for a, b in missing or ():
            self.hits[a : b + 1] = bytes(b - a + 1)

    def window(self, x: int) -> str:
        return "".join(self.bases[x : x + self.k])

    def hit(self, x: int) -> bool:
        if self.hits[x] == 2:
            self.hits[x] = self.has(self.window(x))
        return self.hits[x] == 1

    def put(self, place: int, base: str) -> None:
        """Correct a base; the starts whose k-mers hold it are asked anew."""
        self.bases[place] = base
        for x in range(max(place - self.k + 1, 0), min(place + 1, len(self.hits))):
            self.hits[x] = 2

    def first_sure(self) -> int | None:
        return next((x for x in range(self.scanned) if all(self.hit(x + i) for i in range(SURE))), None)

    def next_miss(self, x: int) -> int | None:
        while (found := _OTHER.search(self.hits, x, self.scanned)) and self.hit(found.start()):
            x = found.start() + 1
        return found.start() if found else None

    def fitting(self, x: int, at: int) -> str | None:
        """The first base that makes the k-mer at ``x`` a known one if put at its place ``at``."""
        kmer = self.window(x)
        return next((b for b in PROBE_ORDER if self.has(f"{kmer[:at]}{b}{kmer[at + 1:]}")), None)


_OTHER = re.compile(rb"[^\x01]")


def _forward_vote(record: _Record, gap: int, leniency: int, compat: bool) -> Callable[[int, int], tuple[int, bool, tuple[int, str] | None]]:
    """The vote of one gap: a function of a missing start and the steps used, to the steps used then, whether the start now hits, and a correction.

    The first base that the gap's k-mers do not share with those before it is probed in
    ``leniency`` k-mers; a base with more votes than all others, and twice the k-mers
    that no base fits, is the true one.
    """
    votes = dict.fromkeys(PROBE_ORDER, 0)
    unfit = 0

    def vote(x: int, used: int) -> tuple[int, bool, tuple[int, str] | None]:
        nonlocal unfit
        hit = False
        if used <= leniency:
            at = record.k - used
            base = record.fitting(x, at)
            if compat:
                kmer = record.window(x)
                hit = record.has(f"{kmer[:at]}C{kmer[at + 1:]}")
            used += 1
            if base:
                votes[base] += 1
                return used, hit, None
            unfit += 1
        if used == leniency + 1:
            total = sum(votes.values())
            winner = [b for b, n in votes.items() if n >= 2 * unfit and 2 * n > total]
            return used + 1, hit, (x + record.k - 1 - leniency, winner[0]) if winner else None
        return used, hit, None

    return vote


def _backward_vote(record: _Record, x: int, leniency: int) -> bool:
    """Whether one base fits before the place where a gap closes: then the gap's end is not that of an exon of its own."""
    votes, unfit = dict.fromkeys(PROBE_ORDER, 0), 0
    for n, at in enumerate(range(x - 1, max(x - leniency, 0) - 1, -1)):
        base = record.fitting(at, n)
        if base:
            votes[base] += 1
        else:
            unfit += 1
    return max(votes.values()) >= 2 * unfit


def _cross_gap(record: _Record, gap: int, leniency: int, compat: bool, fixes: list[tuple[int, str, str]]) -> tuple[int | None, int]:
    """Where the next three hits in a row begin after a gap that opens at ``gap``, if they do, and the last start that hit."""
    vote, used, last = _forward_vote(record, gap, leniency, compat), 1, -1
    for x in range(gap, record.scanned):
        hit = record.hit(x)
        if hit:
            last = x
        else:
            used, hit, fix = vote(x, used)
            if fix and record.bases[fix[0]] != fix[1]:
                fixes.append((fix[0], record.bases[fix[0]], fix[1]))
                record.put(*fix)
        if hit and record.hit(x + 1):
            if record.hit(x + 2):
                return x, last
        elif hit:
            used += 1
    return None, last


def _gap_bounds(record: _Record, gap: int, x: int, leniency: int) -> list[int]:
    """What a gap from ``gap`` to ``x`` adds to the boundary list."""
    k, size = record.k, x - gap
    if size > k + MIN_EXON:
        return [gap + k - 1, gap + k] + ([] if _backward_vote(record, x, leniency) else [x - 1, x])
    return [gap + k - 1, x] if size >= k - leniency - 2 else []


def gap_episode(k: int, leniency: int, compat: bool) -> Episode:
    """What happens from the opening of a gap until the scan is out of it and behind all that it changed; places count from the gap."""

    def episode(bases: str, missing: list[tuple[int, int]], ends: bool, has: Has) -> dict[str, Any]:
        record = _Record(bases, k, has, missing)
        starts = len(record.hits)
        bounds, fixes, last, gap = [], [], -1, 0
        if starts < SURE:
            return {"bounds": [], "fixes": [], "last": -1, "resume": -1, "short": not ends}
        while True:
            x, hit = _cross_gap(record, gap, leniency, compat, fixes)
            last = max(last, hit)
            if x is None:
                return {"bounds": bounds, "fixes": fixes, "last": last, "resume": -1, "short": not ends}
            bounds += _gap_bounds(record, gap, x, leniency)
            changed = max((f[0] for f in fixes), default=-1)
            out = max(x, changed) + 1  # from here on nothing is changed
            if out >= record.scanned and not ends:
                return {"bounds": bounds, "fixes": fixes, "last": last, "resume": -1, "short": True}
            gap = record.next_miss(x + 1)
            if gap is None or gap >= out:
                out = min(out, record.scanned)
                return {"bounds": bounds, "fixes": fixes, "last": out - 1 if out > x + 1 else last, "resume": out, "short": False}
            if gap > x + 1:
                last = gap - 1

    return episode


def first_probes(k: int, leniency: int) -> Callable[[str, int], list[str]]:
    """k-mers to ask for at a gap before anything is known: the first novel base in all that hold it, and the last one before the place where the gap closes."""

    def ahead(bases: str, close: int) -> list[str]:
        starts = len(bases) - k + 1
        out = [bases[x : k - 1] + b + bases[k : x + k] for x in range(min(k, starts)) for b in PROBE_ORDER]
        if close > k + MIN_EXON:
            for n in range(min(leniency, close)):
                w = bases[close - 1 - n : close - 1 - n + k]
                out += [w[:n] + b + w[n + 1 :] for b in PROBE_ORDER]
        return out

    return ahead


def scan_record(
    seq: str, k: int, leniency: int, has: Has, compat: bool, missing: list[tuple[int, int]] | None = None
) -> tuple[list[int], list[tuple[int, str, str]]]:
    """Boundary list and corrected bases (0-based place, from, to) of one record.

    ``missing`` has the runs of k-mer starts that are not in the set, if they are known already.
    ``compat`` keeps a known quirk: after probing, the k-mer at hand holds a C at the
    probed base, so a base whose true value is C is never corrected.
    """
    if len(seq) < k + MIN_EXON:
        return [], []
    record = _Record(seq, k, has, missing)
    x = record.first_sure()
    if x is None:
        return [], []
    bounds, fixes, last = [x + 1], [], x
    while (gap := record.next_miss(x + 1)) is not None:
        if gap > x + 1:
            last = gap - 1
        x, hit = _cross_gap(record, gap, leniency, compat, fixes)
        last = max(last, hit)
        if x is None:
            break
        bounds += _gap_bounds(record, gap, x, leniency)
    else:
        if x + 1 < record.scanned:
            last = record.scanned - 1
    return [*bounds, last + k], fixes


def boundaries(
    seqs: DataFrame, kmers: DataFrame, k: int, leniency: int = 10, compat: bool = True, limit: int = BROADCAST_LIMIT, factor: float = 0.0, rate: float = 0.0,
    missing: DataFrame | None = None, members: Members | None = None, size: int | None = None,
) -> DataFrame:
    """(id, bounds, fixes) with probing; records without three hits in a row have no row. ``id`` is unique.

    A set of up to ``limit`` k-mers is broadcast and each record is scanned in one go; beyond, all gaps of all records are a frontier (``gaps``).
    With a ``factor`` the default leniency follows from ``rate``, the false-positive rate the set was made for.
    ``missing``, the runs of missing starts (id, a, b), ``members``, which answers for the set, and its ``size`` are given where they are had without it.
    """
    leniency = leniency_from_rate(leniency, factor, rate, k)
    if not 0 <= leniency <= k - 2:
        raise ValueError("leniency must be from 0 to k - 2")

    def work(row: dict[str, Any], has: Has) -> tuple:
        missing = [] if row["missing"] is None else [(r["a"], r["b"]) for r in row["missing"]]
        return scan_record(row["seq"], k, leniency, has, compat, missing)

    absent = (missing_runs(seqs, kmers, k) if missing is None else missing).groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("missing"))
    own = long_enough(seqs, k).select("id", "seq").join(absent, "id", "left")
    if k <= WORD and (kmers.count() if size is None else size) <= limit:
        schema = "bounds array<int>, fixes array<struct<place: int, was: string, base: string>>"
        out = answer_records(own, kmers, k, "id", work, schema)
    else:
        known = kmers.select(*code_names(k))
        members = members or (lambda asked: asked.join(known, code_names(k), "left_semi"))
        out = corrected(own, members, k, gap_episode(k, leniency, compat), first_probes(k, leniency))
    return out.filter(F.size("bounds") > 0)


def filter_members(seqs: DataFrame, slices: DataFrame, k: int, bits: int, hashes: int) -> DataFrame:
    """The distinct k-mers of ``seqs`` that a stored filter holds: the set as far as these sequences can tell."""
    asked = reference_set(seqs, k)
    return bloom.probe(asked, slices, k, bits, hashes).filter("present").select(*code_names(k))


def boundaries_by_filter(seqs: DataFrame, slices: DataFrame, k: int, bits: int, hashes: int, leniency: int = 10, compat: bool = True, factor: float = 0.0) -> DataFrame:
    """As ``boundaries``, against a stored filter (slice, body): false positives of the filter are hits.

    With a ``factor`` the default leniency follows from the rate that the filter's bits measure.
    """
    if factor:
        leniency = leniency_from_rate(leniency, factor, (bloom.set_bits(slices).first()["set_bits"] / bits) ** hashes, k)
    if not 0 <= leniency <= k - 2:
        raise ValueError("leniency must be from 0 to k - 2")
    slices = slices.select("slice", "body")
    known = materialize(filter_members(long_enough(seqs, k), slices, k, bits, hashes))
    absent = missing_runs(seqs, known, k).groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("missing"))
    own = long_enough(seqs, k).select("id", "seq").join(absent, "id", "left")
    members = lambda asked: bloom.probe(asked, slices, k, bits, hashes).filter("present").select(*code_names(k))
    return corrected(own, members, k, gap_episode(k, leniency, compat), first_probes(k, leniency)).filter(F.size("bounds") > 0)


def substitutions(found: DataFrame) -> DataFrame:
    """(id, place, was, base) of each corrected base, places from 0."""
    return found.select("id", F.explode("fixes").alias("f")).select("id", "f.place", "f.was", "f.base")


def _cut(seq: Column, b: Column, e: Column) -> Column:
    """Bases b to e; none if e is b - 1, and all from b if e is smaller yet."""
    return F.when(e - b + 1 >= 0, F.substring(seq, b, F.greatest(e - b + 1, F.lit(0)))).otherwise(F.substring(seq, b, F.lit(1 << 30)))


def _segments(bounds: Column) -> Column:
    """Structs (start, end) between the pairs of a boundary list; the ends of a pair are swapped where they cross."""
    n = F.size(bounds)
    one = lambda i: F.struct(
        F.when(i == 0, F.get(bounds, F.lit(0))).otherwise(F.greatest(F.get(bounds, 2 * i - 1), F.get(bounds, 2 * i))).cast("int").alias("start"),
        F.when(2 * i + 2 == n, F.get(bounds, n - 1)).otherwise(F.least(F.get(bounds, 2 * i + 1), F.get(bounds, 2 * i + 2))).cast("int").alias("end"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(n >= 2, F.transform(F.sequence(F.lit(0), F.greatest((n / 2).cast("int") - 1, F.lit(0))), one)).otherwise(none)


def _emit(df: DataFrame) -> DataFrame:
    """A row for each segment. The outer form leaves records without one to a filter on ``exon_no``: Spark would move one on the size of
    ``segs`` to where the runs are, and there work out the whole boundary list for each of its places."""
    s, e = F.col("s.start"), F.col("s.end")
    return df.select("id", F.posexplode_outer("segs").alias("exon_no", "s"), "seq").filter("exon_no is not null").select(
        "id", "exon_no", s.alias("start"), e.alias("end"), _cut(F.col("seq"), s, e).alias("exon_seq")
    )


def all_exons(seqs: DataFrame, bounds: DataFrame) -> DataFrame:
    """(id, exon_no, start, end, exon_seq): every segment, cut from the uncorrected sequence."""
    return _emit(seqs.select("id", "seq").join(bounds.select("id", "bounds"), "id").withColumn("segs", _segments(F.col("bounds"))))


def confident_exons(seqs: DataFrame, bounds: DataFrame) -> DataFrame:
    """As ``all_exons`` without segments that reach an end of their record.

    With more than one segment, the pair at an end that is reached goes, and the value
    next to it bounds the remaining segment as it is.
    """
    b, n = F.col("bounds"), F.size("bounds")
    size = F.char_length("seq")
    at_start, at_end = F.get(b, F.lit(0)) == 1, F.get(b, n - 1) >= size - 2
    lo = F.when(at_start, 2).otherwise(0)
    kept = F.slice(b, lo + 1, F.greatest(n - lo - F.when(at_end, 2).otherwise(0), F.lit(0)))
    inner = F.when(n > 2, kept).when(~at_start & ~at_end, b).otherwise(F.array().cast("array<int>"))
    joined = seqs.select("id", "seq").join(bounds.select("id", "bounds"), "id").withColumn("inner", inner)
    return _emit(joined.withColumn("segs", _segments(F.col("inner"))))


def boundary_rows(bounds: DataFrame) -> DataFrame:
    """(id, exon_no, raw_start, raw_end): the list by twos, as found."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size("bounds") / 2).cast("int") - 1), lambda i: F.struct(F.get("bounds", 2 * i).alias("a"), F.get("bounds", 2 * i + 1).alias("b")))
    return bounds.select("id", F.posexplode(pairs).alias("exon_no", "p")).select("id", "exon_no", F.col("p.a").alias("raw_start"), F.col("p.b").alias("raw_end"))
