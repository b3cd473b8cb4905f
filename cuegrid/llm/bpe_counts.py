"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at special strings and then by the tokenizer's split pattern; each piece starts as one symbol per UTF-8 byte.
A heap holds the ranked adjacent pairs, a linked list the symbols; the lowest-ranked pair is merged until none is left.
The count is the number of bytes minus the number of merges: no token id is ever made. No piece reaches across a blank
that stands between two other characters into the character before it, so a text is first cut at such blanks, and equal
chunks, and equal pieces of chunks, are counted once per task, in tables of bounded size.

Defined results: a null text counts as empty; an empty text has no tokens; a special string counts as one token.
Every row is counted for itself, so repeated rows, null ids, ties and further columns need no care.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

import public_tokenizers

#: A blank inside of white space or at an end, and a blank between two characters that no library takes for white space.
LOOSE_BLANK = re.compile(r"\A\s|\s\Z| \s|\s ")
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Entries that each of the two tables keeps. A table starts afresh when full, which changes memory and time, never a count.
KEPT = 600_000
#: Longer pieces are counted without being kept.
KEPT_LENGTH = 64


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeCounter(dict):
    """chunk after a blank -> number of tokens, for one vocabulary file; counts a missing chunk when it is asked for."""

    def __init__(self, path: str):
        super().__init__()
        self.pieces: dict[str, int] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = byte_symbols()
        raw = {token: bytes(plain[c] for c in token) for token in spec["model"]["vocab"] if all(c in plain for c in token)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"]]
        number = {b: i for i, b in enumerate(dict.fromkeys([*(bytes([b]) for b in range(256)), *(raw[x + y] for x, y in merges)]))}
        #: (left symbol, right symbol) -> (rank, merged symbol)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (x, y) in enumerate(merges):
            self.ranks.setdefault((number[raw[x]], number[raw[y]]), (rank, number[raw[x + y]]))
        special = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.special_texts = special
        self.split = regex.compile(public_tokenizers.PATTERN).findall

    def merged(self, piece: str) -> int:
        """Bytes of the piece minus the merges that apply to it."""
        symbols: list[int] = list(piece.encode("utf-8", "surrogatepass"))
        n = len(symbols)
        if n < 2:
            return n
        ranks = self.ranks
        right = list(range(1, n + 1))  # the symbol after; n: none
        left = list(range(-1, n - 1))
        heap = [(found[0], i, symbols[i], symbols[i + 1], found[1]) for i in range(n - 1) if (found := ranks.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b, ab = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = ab, -1
            k = right[i] = right[j]
            count -= 1
            if k < n:
                left[k] = i
                if found := ranks.get((ab, symbols[k])):
                    heapq.heappush(heap, (found[0], i, ab, symbols[k], found[1]))
            h = left[i]
            if h >= 0 and (found := ranks.get((symbols[h], ab))):
                heapq.heappush(heap, (found[0], h, symbols[h], ab, found[1]))
        return count

    def of_piece(self, piece: str) -> int:
        if (n := self.pieces.get(piece)) is None:
            n = self.merged(piece)
            if len(piece) <= KEPT_LENGTH:
                if len(self.pieces) >= KEPT:
                    self.pieces.clear()
                self.pieces[piece] = n
        return n

    def of_chunk(self, chunk: str) -> int:
        return sum(map(self.of_piece, self.split(chunk)))

    def __missing__(self, chunk: str) -> int:
        n = self.of_chunk(" " + chunk)
        if len(chunk) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[chunk] = n
        return n

    def of_plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        chunks = CUT.split(text) if LOOSE_BLANK.search(text) else text.split(" ")
        return self.of_chunk(chunks[0]) + sum(map(self.__getitem__, chunks[1:]))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and any(s in text for s in self.special_texts):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.of_plain(p) for p in parts if p)
        return self.of_plain(text)


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """The counter of a vocabulary file, loaded once per Python worker."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text column, by the byte-level vocabulary file at `path`."""
    where = path or public_tokenizers.path("byte_bpe_50k.json")

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(where).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    return F.pandas_udf(counts, LongType())(text)
