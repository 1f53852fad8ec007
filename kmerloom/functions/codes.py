"""k-mers as numbers: two bits a base, most significant first, in as many longs as needed.

31 bases fill a long, so a k-mer of up to 31 bases is one column ``c0``, a longer one
has ``c1`` and so on. Bases are numbered in alphabetical order: numbers compare like the
texts, and the smaller of a k-mer and its reverse complement is the same either way. All
windows of a batch of sequences are coded at once with numpy, by doubling the width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 31
#: Windows that are coded at a time.
STEP = 1 << 20

_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def widths(k: int) -> list[int]:
    """Bases in each long of a k-mer."""
    return [min(WORD, k - at) for at in range(0, k, WORD)]


def code_names(k: int) -> list[str]:
    """The code columns of k-mers."""
    return [f"c{j}" for j in range(len(widths(k)))]


def encode(kmer: Column, k: int) -> list[Column]:
    """Code columns of a column of upper-case k-mers; negative where there is another letter."""
    plain = ~kmer.rlike("[^ACGT]")
    digits = F.translate(kmer, "ACGT", "0123")
    words = [F.conv(F.substring(digits, WORD * j + 1, w), 4, 10).cast("bigint") for j, w in enumerate(widths(k))]
    return [F.when(plain, c).otherwise(F.lit(-1).cast("bigint")).alias(n) for c, n in zip(words, code_names(k), strict=True)]


def decode(k: int) -> Column:
    """The text of the k-mer in the code columns."""
    words = [F.lpad(F.conv(F.col(n).cast("string"), 10, 4), w, "0") for n, w in zip(code_names(k), widths(k), strict=True)]
    return F.translate(F.concat(*words), "0123", "ACGT")


def _packed(bases: np.ndarray, width: int) -> np.ndarray:
    """The number of each window of ``width`` bases, from windows of 1, 2, 4 .. bases put together."""
    n = len(bases) - width + 1
    power, size, at = bases.astype(np.int64), 1, 0
    out = np.zeros(n, np.int64)
    while True:
        if width & size:
            out = out << (2 * size) | power[at : at + n]
            at += size
        if 2 * size > width:
            return out
        power = power[:-size] << (2 * size) | power[size:]
        size *= 2


def canonical_windows(bases: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes of the smaller of each window and its reverse complement, and whether that is the latter."""
    n = len(bases) - k + 1
    back = (3 - bases)[::-1]
    forward, reverse, at = [], [], 0
    packed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in widths(k):
        if w not in packed:
            packed[w] = _packed(bases, w), _packed(back, w)
        forward.append(packed[w][0][at : at + n])
        reverse.append(packed[w][1][at : at + n][::-1])
        at += w
    flipped, same = np.zeros(n, bool), np.ones(n, bool)
    for f, r in zip(forward, reverse, strict=True):
        flipped |= same & (r < f)
        same &= r == f
    return [np.where(flipped, r, f) for f, r in zip(forward, reverse, strict=True)], flipped


def code_of(kmer: str) -> int:
    """Code of one canonical k-mer of up to WORD bases."""
    return int(kmer.translate(str.maketrans("ACGT", "0123")), 4)


def windows_of(seqs: pa.Array, k: int):  # noqa: ANN201
    """For runs of windows of a string array: (their bytes, row, place in the row, inside one row, clean).

    The array's bytes are taken as one text, whatever its rows' lengths, so windows that cross
    from one row to the next are there as well; clean ones have no other letter than A, C, G and T.
    """
    seqs = seqs.cast(pa.string())
    if not len(seqs) or seqs.buffers()[2] is None:
        return
    ends = np.frombuffer(seqs.buffers()[1], np.int32, len(seqs) + 1, 4 * seqs.offset).astype(np.int64)
    data = np.frombuffer(seqs.buffers()[2], np.uint8)
    for lo in range(int(ends[0]), int(ends[-1]) - k + 1, STEP):
        hi = min(lo + STEP, int(ends[-1]) - k + 1)
        part = data[lo : hi + k - 1]
        place = np.arange(lo, hi)
        row = np.searchsorted(ends, place, "right") - 1
        other = np.concatenate(([0], np.cumsum(_CODE[part] == 4)))
        yield part, row, place - ends[row], place + k <= ends[row + 1], other[k:] == other[:-k]


def coded_windows(seqs: pa.Array, k: int, valid_only: bool):  # noqa: ANN201
    """For runs of windows of a string array: (row, place in the row, codes, flipped).

    A window with another letter is left out or has a negative code that no other window of its row has.
    """
    for part, row, place, inside, clean in windows_of(seqs, k):
        keep = inside & clean if valid_only else inside
        codes, flipped = canonical_windows(_CODE[part] & 3, k)
        codes = [c if valid_only else np.where(clean, c, -1 - place) for c in codes]
        yield row[keep], place[keep].astype(np.int32), [c[keep] for c in codes], flipped[keep]
