"""Substring deduplication by content-defined chunks (operator 1).

A gear rolling hash over the last 16 bytes of the UTF-8 text cuts each text into
variable chunks, so an insertion moves the cuts next to it only. A cut lies where the hash is
small, or smallest for a stretch on both sides, so passages of few different words are cut by their
content as well. Chunks are deduplicated by digest: the first document, by smallest
``doc_id``, keeps its chunk. Later chunks that follow each other in a document, and whose kept
copies follow each other in one other document, form a run. The bytes of the run are held
against those of its copy, and the text beside its ends is compared, byte by byte, with the text beside
the copy, so that the parts of a passage before its first whole chunk and after its last one
belong to it. What a document shares with one other document in one piece of ``min_words``
whole words or more goes; chance repeats of single chunks stay, and so do shorter pieces of
several documents that stand side by side.

Defined cases: a null text counts as the empty text, which has no chunk, and stays
null; rows with equal ``doc_id`` count as one document; a repeat inside one
document stays; a null ``doc_id`` is smaller than all others; an empty table gives an
empty result; other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import carried, carried_back, join_with_hot, materialize
from kmerloom.llm.occurrences import NO_DOC, later_occurrences

#: ASCII white space.
SPACE = b" \t\n\x0b\x0c\r"

#: Least and most bytes of a chunk, and hash bits that are zero at a cut: 32 bytes between cuts on average, past the least.
LEAST, MOST, BITS = 12, 256, 5
#: Bytes on both sides of a cut at a smallest hash.
AROUND = 32
#: Least bytes of a chunk that ends where the hash is smallest once more.
APART = 96
#: Bytes beside a run that are compared; more than the longest chunk.
REACH = 320


def gear_table(seed: int = 20_111) -> np.ndarray:
    """A random 16-bit number for each byte value."""
    return np.random.default_rng(seed).integers(0, 1 << 16, 256, dtype=np.uint16)


GEAR = gear_table()


def cuts(data: bytes) -> np.ndarray:
    """Ends of the chunks of ``data``, in bytes; the last is its length."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):  # sums of gear values shifted by their distance, over 16 bytes: older ones have left the 16 bits
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step)
        h = more
    cut = h >> np.uint16(16 - BITS) == 0
    again = np.zeros(n, bool)  # smallest not for the first time, as in text of a short period
    if n > 2 * AROUND:
        least, size = h, 1
        while size < AROUND:  # the smallest of windows of 2, 4, 8 .. bytes, at last of one side
            step = min(size, AROUND - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        middle, before = h[AROUND : n - AROUND], least[: n - 2 * AROUND]
        smallest = middle <= least[AROUND + 1 : n - AROUND + 1]
        cut[AROUND : n - AROUND] |= smallest & (middle < before)
        again[AROUND : n - AROUND] = smallest & (middle == before)
    out = []
    last = 0
    places = np.flatnonzero(cut | again)
    for at, space in zip((places + 1).tolist(), np.where(cut[places], LEAST, APART).tolist(), strict=True):
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= space:
            out.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return np.array(out, np.int64)


def _key(docs: DataFrame) -> DataFrame:
    """``docs`` with _doc, the identifier or the number that stands for none, and _fp, 23 bits of the text's hash.

    Rows of equal ``doc_id`` with different texts of equal _fp would meet; as bytes are compared, nothing else than a repeat is ever cut.
    """
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_DOC))
    return docs.withColumns({"_doc": doc, "_fp": F.xxhash64("text").bitwiseAND(0x7FFFFF).cast("int")})


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(h, doc_id, place) of each chunk; ``place`` packs start (31 bits, bytes), 23 bits of the text's hash, and length (9 bits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.iloc[lo : lo + 64]
                frames = []
                for doc, fp, text in zip(part["_doc"], part["_fp"], part["text"], strict=True):
                    data = (text or "").encode()
                    stops = cuts(data)
                    if not len(stops):
                        continue
                    starts = np.concatenate(([0], stops[:-1]))
                    h = np.array([digest(data[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.uint64)
                    frames.append((np.full(len(h), doc, np.int64), h.view(np.int64), starts << 32 | int(fp) << 9 | stops - starts))
                if frames:
                    d, h, p = (np.concatenate(x) for x in zip(*frames, strict=True))
                    yield pd.DataFrame({"h": h, "doc_id": d, "place": p})

    return _key(docs.select("doc_id", "text")).select("_doc", "_fp", "text").mapInPandas(run, "h bigint, doc_id bigint, place bigint")


def _unpack(df: DataFrame, place: str, prefix: str) -> DataFrame:
    p = F.col(place)
    start = F.shiftright(p, 32).cast("int")
    return df.withColumns({
        f"{prefix}start": start,
        f"{prefix}stop": (start + p.bitwiseAND(0x1FF)).cast("int"),
        f"{prefix}fp": F.shiftright(p, 9).bitwiseAND(0x7FFFFF).cast("int"),
    })


def repeated_runs(docs: DataFrame, min_bytes: int) -> DataFrame:
    """(doc, fp, start, stop, src, src_fp, at): runs of later chunks of ``min_bytes`` or more whose kept copies lie in one piece from ``at`` on in ``src``."""
    occ = materialize(chunk_rows(docs))
    later = later_occurrences(occ, ["h"], ["place"], largest_first=False, min_docs=2, with_first=True)
    rows = _unpack(_unpack(later, "place", ""), "first_place", "first_")
    own = ["doc_id", "fp"]
    along = Window.partitionBy(*own).orderBy("start")
    before = lambda c: F.lag(c).over(along)
    follows = (
        (F.col("start") == before("stop")) & (F.col("first_doc") == before("first_doc"))
        & (F.col("first_fp") == before("first_fp")) & (F.col("first_start") == before("first_stop"))
    )
    return (
        rows.repartition(*own)
        .dropDuplicates([*own, "start"])
        .withColumn("opens", (~F.coalesce(follows, F.lit(False))).cast("int"))
        .withColumn("run", F.sum("opens").over(along))
        .groupBy(*own, "run", F.col("first_doc").alias("src"), F.col("first_fp").alias("src_fp"))
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_start").alias("at"))
        .filter(F.col("stop") - F.col("start") >= int(min_bytes))
        .select(F.col("doc_id").alias("doc"), "fp", "start", "stop", "src", "src_fp", "at")
    )


def _slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (src, src_fp, at, size, n) with the REACH bytes before and after that piece of the source, and its digest."""

    @F.pandas_udf("array<struct<left: binary, right: binary, digest: binary>>")
    def cut(texts: pd.Series, places: pd.Series) -> pd.Series:
        def one(text: str | None, where: list) -> list[dict]:
            data = (text or "").encode()
            out = []
            for x in where:
                a, b = x["at"], x["at"] + x["size"]
                out.append({"left": data[max(0, a - REACH) : a], "right": data[b : b + REACH], "digest": _digest(data[a:b])})
            return out

        return pd.Series([one(t, w) for t, w in zip(texts, places, strict=True)])

    lists = wanted.groupBy("src", "src_fp").agg(F.collect_list(F.struct("at", "size", "n")).alias("places"))
    texts = _key(docs.select("doc_id", "text")).select(F.col("_doc").alias("src"), F.col("_fp").alias("src_fp"), "text")
    found = texts.join(lists.hint("shuffle_hash"), ["src", "src_fp"]).withColumn("bodies", cut("text", "places"))
    return (
        found.select("src", "src_fp", F.explode(F.arrays_zip("places", "bodies")).alias("x"))
        .select("src", "src_fp", "x.places.at", "x.places.size", "x.places.n", F.col("x.bodies").alias("body"))
        .dropDuplicates(["src", "src_fp", "at", "size"])
    )


def passages(docs: DataFrame, min_bytes: int) -> DataFrame:
    """(doc, fp, spans): runs of each document with what lies beside their kept copies, as structs (start, stop, body)."""
    runs = materialize(repeated_runs(docs, min_bytes).withColumn("size", F.col("stop") - F.col("start")))
    keys = ["src", "src_fp", "at", "size"]
    beside = materialize(_slices(docs, runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))))
    return (
        join_with_hot(runs, beside, keys, "n", runs.count())
        .groupBy("doc", "fp")
        .agg(F.collect_list(F.struct("start", "stop", "body")).alias("spans"))
    )


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common at their start."""
    n = min(len(a), len(b))
    off = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(off[0]) if len(off) else n


def widen(data: bytes, spans: list, min_words: int) -> list[tuple[int, int]]:
    """Pieces of ``min_words`` whole words or more that ``data`` shares with one kept copy each, merged.

    A span grows by what it shares with its kept copy on both sides and is cut back to whole words.
    """
    found = []
    for x in spans:
        a, b, body = x["start"], x["stop"], x["body"]
        if _digest(data[a:b]) != body["digest"]:
            continue
        b += _common(data[b : b + REACH], body["right"])
        a -= _common(data[max(0, a - REACH) : a][::-1], body["left"][::-1])
        while a < b and a and data[a - 1] not in SPACE and data[a] not in SPACE:
            a += 1
        while b > a and b < len(data) and data[b - 1] not in SPACE and data[b] not in SPACE:
            b -= 1
        if len(data[a:b].split()) >= min_words:
            found.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """Text without the spans; bytes and spans cut."""
    kept, last = [], 0
    for a, b in spans:
        kept.append(data[last:a])
        last = b
    kept.append(data[last:])
    return b"".join(kept).decode("utf-8", "replace"), sum(b - a for a, b in spans), len(spans)


def dedup_substrings(docs: DataFrame, min_words: int = 25, min_bytes: int = 24) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``, and n_spans and n_bytes_dropped.

    If ``docs`` has columns of the names n_spans or n_bytes_dropped, these replace them.
    """
    spans = passages(docs, min_bytes).select(F.col("doc").alias("_s_doc"), F.col("fp").alias("_s_fp"), F.col("spans").alias("_s_spans"))

    @F.pandas_udf("text string, n_bytes_dropped bigint, n_spans int")
    def apply(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [
            (t, 0, 0) if s is None else cut_out(t.encode(), widen(t.encode(), s, min_words))
            for t, s in zip(texts, found, strict=True)
        ]
        return pd.DataFrame(rows, columns=["text", "n_bytes_dropped", "n_spans"])

    gone = ("n_spans", "n_bytes_dropped")
    keyed = _key(carried(docs, ["doc_id", "text"], gone))
    same = (keyed["_doc"] == spans["_s_doc"]) & (keyed["_fp"] == spans["_s_fp"])
    joined = keyed.join(spans.hint("shuffle_hash"), same, "left").withColumn("_s_out", apply(keyed["text"], F.col("_s_spans")))
    own = carried_back(docs, {"doc_id": F.col("doc_id"), "text": F.col("_s_out.text")}, gone)
    return joined.select(*own, F.col("_s_out.n_spans").alias("n_spans"), F.col("_s_out.n_bytes_dropped").alias("n_bytes_dropped"))
