"""SentencePiece encoding and decoding through a table of distinct chunks.

With the model's rules (identity normalisation, blanks marked by U+2581, a mark put before the text) no piece of the
vocabulary holds a mark after another character, so no merge reaches across the start of a marked word. A text is cut
before each run of marks, each distinct chunk is segmented once per task, and the ids are joined back by position. Decoding
joins the chunks' decoded texts in the same way; the blank before the text is dropped again. `PieceTable` checks these
properties of the model file and refuses one that lacks them.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; U+2581 in a text is
a blank to the model, and decodes to one. Rows are encoded each for itself, so repeated rows, null ids, ties and further
columns need no care.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

import public_tokenizers
from cuegrid.llm.common import give_back

MARK = "▁"
CHUNK = re.compile(r" +[^ ]*")
#: Chunks that a task keeps until its end. The table starts afresh when full, which changes memory and time, never an id.
KEPT = 250_000
#: Longer chunks are segmented without being kept.
KEPT_LENGTH = 64
#: Texts that are cut before their chunks are looked up, and characters at which fewer will do.
TEXTS, CHARS = 256, 1_000_000


class PieceTable(dict):
    """chunk without its first blank -> ids as text, for one model file."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces) or self.model.normalize(" a  ﬁÅ ") != f"{MARK}{MARK}a{MARK}{MARK}ﬁÅ{MARK}":
            raise ValueError(f"{path}: its pieces cross white-space marks, or it rewrites the text first")
        self.lone = [self.model.piece_to_id(MARK)]
        #: The decoded form of the chunks that do not decode to themselves.
        self.changed: dict[str, str] = {}

    def segment(self, chunks: list[str]) -> None:
        """The library puts the first mark before a text by itself, except before an empty one."""
        ids = [own or self.lone for own in self.model.encode(chunks, num_threads=1)]
        self.update(zip(chunks, [",".join(map(str, own)) for own in ids]))
        self.changed.update((c, back) for c, back in zip(chunks, self.model.decode(ids, num_threads=1)) if back != c)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each text, in order."""
        cut = [chunks_of(t.replace(MARK, " ")) if t else [] for t in texts]
        wanted = set().union(*cut)
        if len(self) + len(wanted) > KEPT:
            self.clear()
            self.changed.clear()
        self.segment(list(wanted - self.keys()))
        changed = self.changed.keys() & wanted
        for chunks in cut:
            back = [self.changed.get(c, c) for c in chunks] if changed else chunks
            yield ",".join(map(self.__getitem__, chunks)), " ".join(back)
        for c in [c for c in wanted if len(c) > KEPT_LENGTH]:
            del self[c]
            self.changed.pop(c, None)


def chunks_of(text: str) -> list[str]:
    """The chunks, in order, each without its first blank; joined by blanks they are the text."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return [c[1:] for c in CHUNK.findall(" " + text)]
    return text.split(" ")


_tables: dict[str, PieceTable] = {}


def table(path: str) -> PieceTable:
    """The table of a model file, kept by the Python worker."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def slices(texts: list[str | None], most: int = TEXTS, most_chars: int = CHARS) -> Iterator[list[str | None]]:
    """Consecutive parts of at most `most` texts, ended early by a text that fills `most_chars`."""
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t) if t else 0
        if len(part) >= most or chars >= most_chars:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _over_texts(row, schema: str, path: str | None):
    """A column function of a text column; row((ids, decoded)) gives the fields of its struct."""
    where = path or public_tokenizers.path("piece_bpe_32k.model")
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = table(where)
        for texts in batches:
            for part in slices(list(texts)):  # ids are many: each part leaves on its own
                yield pd.DataFrame([row(*x) for x in known.encode(part)], columns=names)
        known.clear()  # the worker may serve another operator next
        known.changed.clear()
        give_back()

    return F.pandas_udf(rows, schema)


def encoded(text: Column, path: str | None = None) -> Column:
    """struct(ids array<int>, decoded string)."""
    return _over_texts(lambda ids, back: (np.array(ids.split(",") if ids else [], np.int32), back), "ids array<int>, decoded string", path)(text)


def digests(text: Column, path: str | None = None) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): what `encoded` gives, as a count and digests."""
    def row(ids: str, back: str) -> tuple[int, str, str]:
        return (ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())

    return _over_texts(row, "n_tokens long, ids_sha256 string, decoded_sha256 string", path)(text)
