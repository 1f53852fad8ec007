"""Byte-level BPE encoding and decoding by a tokenization automaton (operator 3).

The automaton accepts, over the alphabet of tokens, exactly the token sequences that
the merge list yields. It starts with one state in which every byte is an arc, and
each merge (u, v), in order of priority, adds one gadget: all arcs u end in a single
state q; a copy of q without its arc v becomes the new end of u, and each state that
has an arc u gets an arc uv to where v leads. All arcs of a token thus share one end,
so the compiled tables hold for each token when its arcs appeared, the token u whose arcs they
follow and the token v whose end they share, and for each pair (u, v) when the end of u
lost its arc v. An arc leaves a state if, going back in time through these tables, it was there before
it was ever lost. Cells of the transition table that have been met are kept.

A word is read byte by byte, once and without going back. A second table, over bytes,
leads from byte to byte through the longest piece of a token that the text read so far
ends in; with it come the tokens that the text ends in, longest first. As each string has one
accepted tokenization, each prefix of the word has one state, and exactly one of these tokens
leaves the state of the prefix before it: it is the last token of this prefix. The ids of the
word are read from the last prefix backwards. Time is in proportion to the length of the word, times
the tokens that end at one place. Decoding emits the labels of the arcs.

Texts are split into words by the pattern of the vocabulary, with letters, numbers and
white space as the tokenizers library has them: its tables of characters are older than the regex
package's, so the driver asks it once for the class of every code point and writes the
differences into the pattern.

Defined cases: a null text counts as the empty text, which has no token; a special
token's string in a text is that token, as in the tokenizers library; texts of any
length are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words, and pieces of text between blanks, kept with their ids in each Python worker.
WORD_CACHE = 300_000
#: Cells of the transition table kept.
CELLS = 1_000_000
#: White space at which a text cannot simply be cut at its blanks, and the blanks at which it can be cut then.
_BLANKS = re.compile(r" (?:\s|\Z)")
_OPENS = re.compile(r" (?=\S)")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranges(points: list[int]) -> str:
    """Code points as ranges inside a character class."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}")
        i = j + 1
    return "".join(out)


def library_classes(path: str) -> dict[str, set[int]]:
    """Code points that the library's splitter takes for letters (L), numbers (N) and white space (s)."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    found: dict[str, set[int]] = {"L": set(), "N": set(), "s": {32}}
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and c != 32]
    for at in range(0, len(points), 4096):
        block = points[at : at + 4096]
        starts = {a for _, (a, _) in split("".join(f"!{chr(c)}a" for c in block))}
        between = []  # neither with the mark before it nor with the letter after it: a number or white space
        for i, c in enumerate(block):
            if 3 * i + 1 in starts:
                if 3 * i + 2 in starts:
                    between.append(c)
                else:
                    found["L"].add(c)
        starts = {a for _, (a, _) in split("".join(f"1{chr(c)}!" for c in between))} if between else set()
        for i, c in enumerate(between):
            found["s" if 3 * i + 1 in starts else "N"].add(c)
    return found


@lru_cache(maxsize=2)
def word_pattern(path: str) -> str:
    """The vocabulary's pattern with the library's classes of characters, for the regex package. Asked once, in the driver."""
    import public_tokenizers
    import regex

    everything = "".join(map(chr, range(0x110000)))
    pattern = public_tokenizers.PATTERN.replace("\\S", "\0^").replace("\\s", "\0s").replace("\\p{L}", "\0L").replace("\\p{N}", "\0N")
    for name, own in library_classes(path).items():
        base = "\\s" if name == "s" else f"\\p{{{name}}}"
        known = {m.start() for m in regex.finditer(base, everything)}
        less, more = _ranges(sorted(known - own)), _ranges(sorted(own - known))
        base = f"[{base}--[{less}]]" if less else base
        base = f"[{base}[{more}]]" if more else base
        pattern = pattern.replace(f"\0{name}", base)
        if name == "s":
            pattern = pattern.replace("\0^", f"[^{base}]")
    return f"(?V1){pattern}"


class TokenAutomaton:
    """The compiled automaton of one vocabulary file; ``pattern`` splits texts into words."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label: dict[int, bytes] = {i: raw(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.specials.items()}
        self.split = regex.compile(pattern).findall
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self._compile_gadgets([(vocab[u], vocab[v], vocab[u + v]) for u, v in merges], {i for i in vocab.values() if len(self.label[i]) == 1})
        self._compile_suffixes()
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}  # text behind a blank, up to the next word's blank
        specials = "|".join(re.escape(t) for t in sorted(self.specials, key=len, reverse=True))
        self._special = re.compile(f"({specials})") if specials else None

    def _compile_gadgets(self, merges: list[tuple[int, int, int]], single: set[int]) -> None:
        """Successive merge gadgets, by time; a state is named by the token whose arcs end there."""
        size = max(self.label) + 1
        self.born, self.left, self.right = [0] * size, [-1] * size, [-1] * size
        self.lost: dict[int, int] = {}  # (u, v) as one number -> time at which the end of u lost its arc v
        self.tokens = set(single)
        for time, (u, v, uv) in enumerate(merges, 1):
            self.lost.setdefault(u << 20 | v, time)
            if uv not in self.tokens:
                self.tokens.add(uv)
                self.born[uv], self.left[uv], self.right[uv] = time, u, v
        self.known: dict[int, bool] = {}

    def _compile_suffixes(self) -> None:
        """The table over bytes: nodes are beginnings of tokens, 0 the empty one.

        ``follow`` leads from a node by a byte, ``fallback`` to the longest shorter node that its text ends
        in; ``ends`` has the tokens that the node's text ends in, longest first, with their lengths.
        """
        self.follow: dict[int, int] = {}  # node * 256 + byte
        token_at, above, byte_of = [-1], [0], [0]
        for token in sorted(self.tokens):
            node = 0
            for b in self.label[token]:
                key = node << 8 | b
                if key not in self.follow:
                    self.follow[key] = len(token_at)
                    token_at.append(-1)
                    above.append(node)
                    byte_of.append(b)
                node = self.follow[key]
            token_at[node] = token
        depth = [0] * len(token_at)
        for node in range(1, len(depth)):
            depth[node] = depth[above[node]] + 1
        self.fallback, self.ends = [0] * len(depth), [()] * len(depth)
        for node in sorted(range(1, len(depth)), key=depth.__getitem__):
            back = above[node]
            while back:
                back = self.fallback[back]
                if (to := self.follow.get(back << 8 | byte_of[node])) is not None:
                    self.fallback[node] = to
                    break
            shorter = self.ends[self.fallback[node]]
            self.ends[node] = ((token_at[node], depth[node]), *shorter) if token_at[node] >= 0 else shorter

    def leaves(self, before: int, token: int) -> bool:
        """Whether an arc ``token`` leaves the state in which arcs ``before`` end."""
        key = before << 20 | token
        found = self.known.get(key)
        if found is None:
            born, lost = self.born, self.lost
            u, v, now = before, token, len(lost) + 1
            while True:
                if lost.get(u << 20 | v, now + 1) <= now:
                    found = False
                    break
                if not born[u] and not born[v]:
                    found = True
                    break
                if born[v] >= born[u]:
                    v, now = self.left[v], born[v]
                else:
                    u, now = self.right[u], born[u] - 1
            if len(self.known) < CELLS:
                self.known[key] = found
        return found

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-split word: the last token of each prefix, byte by byte, then from the end to the start."""
        follow, fallback, ends, known, leaves = self.follow, self.fallback, self.ends, self.known, self.leaves
        node = at = 0
        last: list[tuple[int, int]] = []
        for byte in word:
            while (to := follow.get(node << 8 | byte)) is None:
                node = fallback[node]
            node = to
            at += 1
            for found in ends[node]:
                token, size = found
                if size == at:
                    break
                before = last[at - size - 1][0]
                fits = known.get(before << 20 | token)
                if fits or fits is None and leaves(before, token):
                    break
            last.append(found)
        path = []
        while at:
            token, size = last[at - 1]
            path.append(token)
            at -= size
        return tuple(path[::-1])

    def _words(self, chunk: str) -> tuple[int, ...]:
        """Ids of a piece of text between two places where words always part. Frequent words come early, so a full cache stays as it is."""
        words = self.words
        out: list[int] = []
        for word in self.split(chunk):
            ids = words.get(word)
            if ids is None:
                ids = self.encode_word(word.encode("utf-8", "surrogatepass"))
                if len(words) < WORD_CACHE and len(word) <= 64:
                    words[word] = ids
            out += ids
        return tuple(out)

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens. A blank before a character that is none always opens a word."""
        if _BLANKS.search(text):
            first, *rest = _OPENS.split(text)
        else:
            first, *rest = text.split(" ")
        chunks = self.chunks
        ids = list(map(chunks.get, rest))
        for k, found in enumerate(ids):
            if found is None:
                chunk = rest[k]
                ids[k] = found = self._words(" " + chunk)
                if len(chunks) < WORD_CACHE and len(chunk) <= 64:
                    chunks[chunk] = found
        return [*self._words(first), *chain.from_iterable(ids)]

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        if self._special and self._special.search(text):
            return [i for part in self._special.split(text) if part for i in ([self.specials[part]] if part in self.specials else self._plain(part))]
        return self._plain(text)

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, as text."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str, pattern: str) -> TokenAutomaton:
    """One per Python worker."""
    return TokenAutomaton(path, pattern)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; the text goes no further than its task."""
    pattern = word_pattern(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = automaton(path, pattern)
        decimal = {i: str(i) for i in model.label}
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = model.encode(text or "")
                joined = ",".join(map(decimal.__getitem__, ids))
                decoded = model.decode(ids)
                rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with a column ``ids``, an array of the token ids of ``text``."""
    pattern = word_pattern(path)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        model = automaton(path, pattern)
        return texts.map(lambda t: model.encode(t or ""))

    return docs.withColumn("ids", ids("text"))


def decoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with a column ``decoded`` from its column ``ids``."""
    pattern = word_pattern(path)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        model = automaton(path, pattern)
        return ids.map(lambda x: model.decode(list(x) if x is not None else []))

    return docs.withColumn("decoded", text("ids"))
