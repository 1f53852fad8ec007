"""Quality rules by suffix-array repetition (operator 8).

Words of a text are numbered, and a suffix array over them is built by prefix doubling;
the ranks of each doubling step also give the longest common prefixes of neighbours in
the array. A maximal repeated substring is an interval of the array whose least common
prefix is longer than at its sides, so the longest repeat from a place is the larger of
its two common prefixes, and the spans of all places that repeat ``min_span`` words or
more unite to the spans of all such maximal repeats. A text is kept if the base rules
hold, the covered share of its words is at most ``max_covered`` and the longest repeat is
at most ``max_repeat`` words or ``max_share`` of the text's words, whichever is more. Spans
are shorter than the base rule's windows, so short phrases said over and over count here only, and so
does one long passage said twice in a long text.

Defined cases: a null or empty text has no word and fails the base rules; texts of any
length are read whole; rows that repeat give equal rows; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Words of a window of the base rule, and the symbols it counts.
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"


def suffix_ranks(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``ids``, and for each power of two the ranks of the substrings of that length (cut at the end).

    Doubling ends when all ranks differ, so there is one array of ranks for each
    doubling of the longest repeat.
    """
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels = [rank.astype(np.int32)]
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        step *= 2
        levels.append(rank.astype(np.int32))
        if rank[order[-1]] == n - 1 or step >= n:
            return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in the array; 0 for the first."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        ok = np.flatnonzero((a + size <= n) & (b + size <= n))
        ok = ok[levels[k][a[ok]] == levels[k][b[ok]]]
        lcp[ok + 1] += size
        a[ok] += size
        b[ok] += size
    return lcp


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> int:
    """Places in the union of spans."""
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def measure(text: str | None, min_span: int) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words, longest repeat."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, sum(data.count(s) for s in SYMBOLS), 0, 0, 0, 0
    joined = np.frombuffer(b"".join(words), np.uint8)
    chars = int(np.count_nonzero((joined & 0xC0) != 0x80))
    symbols = sum(data.count(s) for s in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    order, levels = suffix_ranks(ids)
    lcp = common_prefixes(order, levels)
    longest = np.empty(n, np.int64)  # longest repeat from each place
    longest[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    again = np.flatnonzero(longest >= WINDOW)
    spans = np.flatnonzero(longest >= min_span)
    return (
        n, chars, symbols, len(lines) - len(set(lines)),
        covered(again, np.full(len(again), WINDOW), n), covered(spans, longest[spans], n), int(lcp.max(initial=0)),
    )


def quality(docs: DataFrame, min_span: int = 5, max_covered: float = 0.3, max_repeat: int = 50, max_share: float = 0.1) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and covered_words and longest_repeat of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
        for batch in batches:
            out = pd.DataFrame([measure(t, min_span) for t in batch["text"]], columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
            fine = (out["covered_words"] <= max_covered * out["n_words"]) & (out["longest_repeat"] <= np.maximum(max_repeat, max_share * out["n_words"]))
            out["kept"] = ~out["base_failed"] & fine
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "covered_words bigint, longest_repeat bigint, base_failed boolean, kept boolean"
    )
    return docs.select("doc_id", "text").mapInPandas(run, schema)
