"""Cross-tokenizer alignment by products of sparse token-byte incidence matrices.

Tokenizer A (byte-level) encodes a blank and the text, tokenizer B (pieces) the text, before which it puts a blank itself. With A
and B as matrices of tokens by bytes, the rows of A Bᵀ are the overlap links: entry (i, j) is the number of bytes that tokens i and
j share. Byte offsets where both end a token cut the tokens into groups; with group-incidence matrices, Gᴬᵀ Gᴮ are the links of
tokens that share a group. Matrices are CSR arrays built here; `product` is Gustavson's row-by-row product.

Neither tokenizer joins what stands on both sides of a lone blank, so a text is cut there into chunks, and each distinct chunk
is aligned once per block of documents. A block is a run of rows of bounded size: the pairs of ids with their counts, pair numbers by
chunk, and chunk numbers by document (both CSR) with what each document has of its own. Only the pairs are exploded: their counts are
summed over the corpus, compared with the highest of their B id, and sorted back before the rows of the blocks in which they occur, where
two sparse products with a vector give the documents' sums, row by row. No text and no link is shuffled.

Defined results: texts that are null, empty, or whose tokens of A or of B do not spell blank + text (B reads U+2581 as a blank) have no
tokens: zeros, and '' for the groups. They add nothing to the counts. Strings of special tokens are plain text. Rows are aligned each
for itself, so repeated rows and null ids need no care, and repeated rows count as often as they occur; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import public_tokenizers
from cuegrid.llm.bpe_counts import CUT, LOOSE_BLANK, byte_symbols
from cuegrid.llm.pieces import MARK, slices
from cuegrid.plans.store import as_table

#: A block ends with the document that brings it to so many characters, or to so many distinct chunks.
BLOCK_CHARS = 8_000_000
BLOCK_CHUNKS = 200_000
#: A row of a block holds about so many numbers; more only of a single chunk or document. Parquet buffers rows by hundreds unless told to look at each.
SEGMENT = 65_536
SMALL_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}
PAIRS, CHUNKS, DOCS = range(3)
#: Chunks that are encoded in one go.
TOGETHER = 10_000
#: A blank beside other white space; other kinds of white space are searched for.
LOOSE_PAIRS = ["  ", *[p for c in "\t\n\r\x0b\x0c" for p in (c + " ", " " + c)]]
ODD_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
FACTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


class Csr(NamedTuple):
    """A 0/1 matrix by rows: the columns of row i are indices[indptr[i]:indptr[i + 1]]."""

    indptr: np.ndarray
    indices: np.ndarray
    width: int

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    @property
    def T(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        return Csr(offsets(np.bincount(self.indices, minlength=self.width)), self.rows[order], len(self.indptr) - 1)


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range, one after another."""
    before = offsets(lengths)
    return np.arange(before[-1]) + np.repeat(starts - before[:-1], lengths)


def product(a: Csr, b: Csr) -> tuple[Csr, np.ndarray]:
    """(pattern, values) of a b by Gustavson's method: row i gathers the rows of b that row i of a names, and adds up equal columns."""
    lengths = b.indptr[a.indices + 1] - b.indptr[a.indices]
    row = np.repeat(a.rows, lengths)
    key = row * b.width + b.indices[ranges(b.indptr[a.indices], lengths)]
    if len(key) and (np.diff(key) < 0).any():
        key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
    values = np.diff(np.append(first, len(key)))
    at = key[first]
    return Csr(offsets(np.bincount(at // max(b.width, 1), minlength=len(a.indptr) - 1)), at % max(b.width, 1), b.width), values


class Aligned(NamedTuple):
    """Tokens, byte ends, groups and links of a text."""

    a: np.ndarray
    b: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray
    groups: np.ndarray
    links: Csr
    n_bytes: np.ndarray
    shared: Csr


class Aligner:
    """Aligns texts, and keeps a table of the distinct chunks of a block."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.model_a = Tokenizer.from_file(path_a)
        self.model_a.encode_special_tokens = True
        self.model_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = byte_symbols()
        names = [self.model_a.id_to_token(i) or "" for i in range(self.model_a.get_vocab_size(with_added_tokens=True))]
        self.bytes_a = [bytes(plain[c] for c in t) if all(c in plain for c in t) else t.encode() for t in names]
        pieces = [self.model_b.id_to_piece(i) for i in range(self.model_b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.model_b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        ids = range(max(len(names), len(pieces)))
        #: An id as text, and what follows it inside and at the end of its side of a group.
        self.names = {mark: np.array([f"{i}{mark}" for i in ids], object) for mark in ",|;"}
        self.paths = path_a, path_b
        self.clear()

    def __reduce__(self):
        """Travels as its files: a copied tokenizer would match the strings of special tokens again."""
        return Aligner, self.paths

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.texts: list[str | None] = []
        self.facts: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []

    def align(self, text: str) -> Aligned | None:
        """None if the tokens do not spell blank + text."""
        whole = (" " + text).encode("utf-8", "surrogatepass")
        a = np.array(self.model_a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.model_b.encode(text), np.int64)
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        every = np.arange(len(whole))
        links, n_bytes = product(Csr(offsets(self.length_a[a]), every, len(whole)), Csr(offsets(self.length_b[b]), every, len(whole)).T)
        groups = np.intersect1d(end_a, end_b, assume_unique=True)
        own_a, own_b = np.searchsorted(groups, end_a), np.searchsorted(groups, end_b)
        group_b = Csr(offsets(np.bincount(own_b, minlength=len(groups))), np.arange(len(b)), len(b))
        shared, _ = product(Csr(np.arange(len(a) + 1), own_a, len(groups)), group_b)
        return Aligned(a, b, end_a, end_b, groups, links, n_bytes, shared)

    def learn(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if c and not c[0].isspace() and not c[-1].isspace()]
        for k in range(0, len(plain), TOGETHER):
            self._learn(plain[k:k + TOGETHER])
        for c in set(chunks).difference(plain):
            self._learn([c])

    def _learn(self, chunks: list[str]) -> None:
        found = self.align(" ".join(chunks))
        ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) + 1 for c in chunks])
        if found is None or not np.isin(ends, found.groups).all():
            if len(chunks) > 1:
                for c in chunks:
                    self._learn([c])
                return
            self._add(chunks, [None], np.zeros((1, len(FACTS)), np.int64), [np.zeros(0, np.int64)])
            return
        n = len(chunks)
        chunk_a, chunk_b, chunk_g = (np.searchsorted(ends, x) for x in (found.end_a, found.end_b, found.groups))
        count = lambda x: np.bincount(x, minlength=n)
        of_link = chunk_a[found.links.rows]
        n_links = count(of_link)
        facts = np.stack([count(chunk_a), count(chunk_b), count(chunk_g), n_links, count(chunk_a[found.shared.rows])], axis=1)
        keys = found.a[found.links.rows] << 32 | found.b[found.links.indices]
        # the ids of A and then those of B, group by group, each with the mark that follows it
        own_a, own_b = np.searchsorted(found.groups, found.end_a), np.searchsorted(found.groups, found.end_b)
        before_b = np.searchsorted(own_b, own_a)
        after_a = np.searchsorted(own_a, own_b, "right")
        marked = np.empty(len(own_a) + len(own_b), object)
        last_a, last_b = np.append(own_a[1:] != own_a[:-1], True), np.append(own_b[1:] != own_b[:-1], True)
        marked[np.arange(len(own_a)) + before_b] = np.where(last_a, self.names["|"][found.a], self.names[","][found.a])
        marked[np.arange(len(own_b)) + after_a] = np.where(last_b, self.names[";"][found.b], self.names[","][found.b])
        flat, stops = marked.tolist(), np.cumsum(facts[:, 0] + facts[:, 1]).tolist()
        self._add(chunks, ["".join(flat[s:e]) for s, e in zip([0, *stops], stops)], facts, [keys])

    def _add(self, chunks: list[str], texts: list[str | None], facts: np.ndarray, keys: list[np.ndarray]) -> None:
        self.at.update(zip(chunks, range(len(self.at), len(self.at) + len(chunks))))
        self.texts += texts
        self.facts.append(facts)
        self.keys += keys


def chunks_of(text: str) -> list[str]:
    loose = text[0].isspace() or text[-1].isspace() or any(map(text.__contains__, LOOSE_PAIRS)) or (ODD_BLANK.search(text) and LOOSE_BLANK.search(text))
    return CUT.split(text) if loose else text.split(" ")


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str | None, path_b: str | None) -> Aligner:
    """The aligner of two vocabulary files, loaded once per Python worker."""
    where = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    if where not in _aligners:
        _aligners[where] = Aligner(*where)
    return _aligners[where]


def links(text: Column, path_a: str | None = None, path_b: str | None = None) -> Column:
    """array<struct(a, b, id_a, id_b, n_bytes, start, end)>: the overlap links of a text; start and end are byte offsets in blank + text."""
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = aligner(path_a, path_b)
        for batch in batches:
            out = []
            for t in batch:
                x = own.align(t) if t else None
                if x is None:
                    out.append([])
                    continue
                i, j = x.links.rows, x.links.indices
                start = np.maximum(x.end_a[i] - own.length_a[x.a[i]], x.end_b[j] - own.length_b[x.b[j]])
                columns = i, j, x.a[i], x.b[j], x.n_bytes, start, start + x.n_bytes
                out.append([dict(zip(("a", "b", "id_a", "id_b", "n_bytes", "start", "end"), r)) for r in zip(*(c.tolist() for c in columns))])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(rows, "array<struct<a:int,b:int,id_a:int,id_b:int,n_bytes:int,start:int,end:int>>")(text)


OF_DOC = {"doc_id": pa.int64(), **dict.fromkeys(FACTS, pa.int64()), "groups_sha256": pa.string()}
#: Rows of a block: those of pairs hold a, b and n, the others lengths and entries of a CSR matrix, and those of documents also docs. `first` numbers the rows of its kind.
BLOCK = ("part int, block int, kind int, first int, a array<int>, b array<int>, n array<long>, lengths binary, entries binary, "
         "docs array<struct<" + ", ".join(f"{k}: {'string' if t == pa.string() else 'long'}" for k, t in OF_DOC.items()) + ">>")
INTS = pa.list_(pa.int32())
BLOCK_TYPES = {"part": pa.int32(), "block": pa.int32(), "kind": pa.int32(), "first": pa.int32(), "a": INTS, "b": INTS, "n": pa.list_(pa.int64()),
               "lengths": pa.binary(), "entries": pa.binary(), "docs": pa.list_(pa.struct(OF_DOC))}


def segments(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive runs of about SEGMENT in size."""
    if len(sizes):
        edges = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SEGMENT)) + 1
        yield from zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)])


def blocks_of(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The documents as blocks, as the module's docstring describes them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        own.clear()
        part, block, chars = 0, 0, 0
        ids: list[int | None] = []
        by_doc: list[np.ndarray] = []
        digests: list[str] = []

        def row(kind: int, first: int, **values) -> pa.RecordBatch:
            values |= {"part": part, "block": block, "kind": kind, "first": first}
            return pa.RecordBatch.from_arrays([v if isinstance(v := values.get(k), pa.Array) else pa.array([v], t) for k, t in BLOCK_TYPES.items()], list(BLOCK_TYPES))

        def whole() -> Iterator[pa.RecordBatch]:
            facts = np.concatenate([*own.facts, np.zeros((0, len(FACTS)), np.int64)])
            stops = offsets(facts[:, 3])
            keys, pair = np.unique(np.concatenate([*own.keys, np.zeros(0, np.int64)]), return_inverse=True)
            own.clear()
            lengths = np.array([len(x) for x in by_doc])
            doc_stops, flat = offsets(lengths), np.concatenate([*by_doc, np.zeros(0, np.int32)])
            times = np.bincount(flat, minlength=len(facts))
            n = np.bincount(pair, np.repeat(times, facts[:, 3]), len(keys)).astype(np.int64)
            used = np.flatnonzero(n)
            place = np.zeros(len(keys), np.int32)
            place[used] = np.arange(len(used))
            a, b, n = (keys[used] >> 32).astype(np.int32), (keys[used] & 0xFFFFFFFF).astype(np.int32), n[used]
            for s in range(0, len(used), SEGMENT):
                yield row(PAIRS, s, a=a[s:s + SEGMENT], b=b[s:s + SEGMENT], n=n[s:s + SEGMENT])
            for s, e in segments(facts[:, 3] + 1):
                yield row(CHUNKS, s, lengths=facts[s:e, 3].astype(np.int32).tobytes(), entries=place[pair[stops[s]:stops[e]]].astype(np.int32).tobytes())
            for s, e in segments(lengths + 4 * len(OF_DOC)):
                docs_, stops_ = flat[doc_stops[s]:doc_stops[e]], doc_stops[s:e + 1] - doc_stops[s]
                sums = [totals(facts[:, k], stops_, docs_) for k in range(len(FACTS))]
                of_doc = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip([ids[s:e], *sums, digests[s:e]], OF_DOC.values())], list(OF_DOC))
                yield row(DOCS, s, lengths=lengths[s:e].astype(np.int32).tobytes(), entries=docs_.astype(np.int32).tobytes(), docs=pa.ListArray.from_arrays([0, e - s], of_doc))

        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            id_of, done = batch.column(0).to_pylist(), 0
            for some in slices(batch.column(1).to_pylist()):
                split = [chunks_of(t) if t and MARK not in t else [] for t in some]
                own.learn(list(set().union(*split) - own.at.keys()))
                for t, chunks in zip(some, split):
                    at = list(map(own.at.__getitem__, chunks))
                    text = list(map(own.texts.__getitem__, at))
                    good = bool(text) and None not in text
                    by_doc.append(np.array(at if good else [], np.int32))
                    digests.append(hashlib.sha256("".join(text)[:-1].encode()).hexdigest() if good else "")
                    chars += len(t) if t else 0
                ids += id_of[done:done + len(some)]
                done += len(some)
                if chars >= BLOCK_CHARS or len(own.at) >= BLOCK_CHUNKS:
                    yield from whole()
                    block, chars, ids, by_doc, digests = block + 1, 0, [], [], []
        if ids:
            yield from whole()
        own.clear()

    return rows.mapInArrow(cut, BLOCK)


def totals(value: np.ndarray, stops: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 0/1 matrix by rows times a vector: the sum of value[at] between the stops of each row."""
    sums = offsets(value[at])
    return sums[stops[1:]] - sums[stops[:-1]]


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared: one row for each row of docs."""
    blocks = as_table(blocks_of(docs, path_a, path_b), "alignment-blocks", **SMALL_GROUPS)
    where = ["part", "block"]
    of_pairs = blocks.where(F.col("kind") == PAIRS).select(*where, "first", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "p"))
    pairs = of_pairs.select(*where, (F.col("first") + F.col("at")).alias("first"), "p.a", "p.b", "p.n")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    # a row for each id of B, which its vocabulary bounds
    best = counts.groupBy(F.col("b").alias("best_b")).agg(F.max("count").alias("most"))
    judged = counts.join(best, F.col("b") == F.col("best_b")).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    back = pairs.drop("n").join(judged, ["a", "b"]).select(*where, F.lit(PAIRS).alias("kind"), "first", "count", F.col("best").cast("long").alias("best"))
    # no row of a block meets the whole of it: its judged pairs, chunks and documents pass one after another
    met = (blocks.where(F.col("kind") != PAIRS).drop("a", "b", "n").unionByName(back, allowMissingColumns=True)
           .repartition(*where).sortWithinPartitions(*where, "kind", "first"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in filter(lambda x: x.num_rows, batches):
            keys = np.stack([batch.column(k).to_numpy() for k in (*where, "kind")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:]):
                kind = int(keys[2, s])
                if tuple(keys[:2, s]) != block:
                    block = tuple(keys[:2, s])
                    # best and count by pair and, made of these, by chunk
                    judged_, by_chunk = ([], []), ([], [])
                if kind == PAIRS:
                    for v, k in zip(judged_, ("best", "count")):
                        v.append(batch.column(k).slice(s, e - s).to_numpy(zero_copy_only=False).astype(np.int64))
                    continue
                for i in range(s, e):
                    lengths, entries = (np.frombuffer(batch.column(k)[i].as_buffer(), np.int32) for k in ("lengths", "entries"))
                    known = judged_ if kind == CHUNKS else by_chunk
                    for v in known:
                        if len(v) != 1:
                            v[:] = [np.concatenate([*v, np.zeros(1, np.int64)])]
                    sums = [totals(v[0], offsets(lengths), entries) for v in known]
                    if kind == CHUNKS:
                        for v, x in zip(by_chunk, sums):
                            v.append(x)
                        continue
                    of_doc = dict(zip(OF_DOC, batch.column("docs")[i].values.flatten()))
                    yield pa.RecordBatch.from_arrays([*of_doc.values(), *(pa.array(x, pa.int64()) for x in sums)], [*of_doc, "n_best", "count_sum"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, n_best long, count_sum long"
    return met.mapInArrow(finish, schema).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
