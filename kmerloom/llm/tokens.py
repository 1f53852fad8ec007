"""Words of whole Arrow batches of texts, as places in their bytes.

Word letters and separators are told apart by bytes. Separators are ASCII, so every
byte of a longer UTF-8 character is part of a word, and words are valid UTF-8. Only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 4_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_table(members: str | bytes) -> np.ndarray:
    """A table of 256 booleans, true for the bytes in ``members``."""
    table = np.zeros(256, bool)
    table[list(members.encode() if isinstance(members, str) else members)] = True
    return table


@dataclass
class Words:
    """Words of some texts: ``starts`` and ``ends`` in the lower-cased bytes ``data``, and the text (``row``) each is in; ``inside`` marks their bytes."""

    data: np.ndarray
    inside: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    rows: int

    def breaks(self, separators: np.ndarray) -> np.ndarray:
        """For each word, whether a byte of ``separators`` or the start of a text lies between it and the word before."""
        found = np.zeros(len(self.starts) + 1, bool)
        found[np.searchsorted(self.starts, np.flatnonzero(separators[self.data]))] = True
        found[:1] = True
        found[1:-1] |= self.row[1:] != self.row[:-1]
        return found[:-1]

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """(number of each word in the list of distinct words, that list)."""
        sizes = self.ends - self.starts
        ends = np.concatenate(([0], np.cumsum(sizes)))
        own = self.data[self.inside]
        kind, width = (pa.string(), np.int32) if ends[-1] < 2**31 else (pa.large_string(), np.int64)
        words = pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(own)])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.string())


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have up to ``most`` bytes together; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield batch.slice(lo)


def words_of(texts: pa.Array, letters: np.ndarray) -> Words:
    """Words of a string array: maximal runs of bytes of ``letters`` within each text; null counts as empty."""
    texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32, len(texts) + 1, (8 if large else 4) * texts.offset).astype(np.int64)
    raw = texts.buffers()[2]
    data = _LOWER[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    own = np.zeros(len(data) + 2, bool)
    own[1:-1] = letters[data]
    starts, ends = own[1:] & ~own[:-1], own[:-1] & ~own[1:]
    # where a text begins, a word of the text before ends and one of its own begins
    meet = offsets[1:-1][own[offsets[1:-1]] & own[offsets[1:-1] + 1]]
    starts[meet], ends[meet] = True, True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    return Words(data, own[1:-1], starts, ends, row, len(texts))
