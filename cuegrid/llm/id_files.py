"""Token ids in files: static range asymmetric numeral systems (rANS, Duda 2009) over independent interleaved blocks.

1. Order: documents are range-partitioned and sorted by doc_id, so that a task writes a run of the stream of all ids.
2. Tokens: distinct words are encoded by the library and kept by the Python worker (bounded), letters apart from the marks behind them; ids are cut into blocks of `BLOCK` ids.
3. Table: the counts of all ids give one table of frequencies with a sum of 2^20, shared by all blocks.
4. Blocks: the ids of a block are dealt over `LANES` interleaved states. A block needs nothing but the table. Every `STEPS`
   steps it has a checkpoint (the states and the place in the words), so that its segments are decoded independently,
   and for each segment checksums of its words and of its ids.

A folder holds `table` (id, frequency) and `blocks`, both written by Spark, which replaces the output of lost tasks. A row of blocks: part
and block (its place in the stream), n_ids, first_doc (number of its first document inside the part), doc_ids and lengths (the documents with
ids in the block and how many), data. data, little-endian: 4 bytes "IDS1"; u32 n_ids; u16 lanes; u16 segments; u32 steps a segment; u32 crc32 of
the table; for each segment u32 words, u32 crc32 of its words, u32 crc32 of its ids as u32, u64 state a lane; then the words, 3 bytes each.

Defined results: a null text counts as empty, an empty document has the end id alone. Rows without doc_id come last; rows with equal doc_id
come by a hash of their text, then in the order in which they are read. A document may span blocks, never parts. Further columns are
ignored; an empty table gives empty files and results. A damaged block, or a foreign table, raises a ValueError that names it.
"""

from __future__ import annotations

import codecs
import json
import re
import string
import struct
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import public_tokenizers
from cuegrid.llm.bpe_counts import byte_symbols
from cuegrid.llm.pieces import slices
from cuegrid.plans.store import as_table

LANES, STEPS, SEGMENTS = 128, 256, 4
#: Ids of a block; the last block of a part may be shorter.
BLOCK = LANES * STEPS * SEGMENTS
SCALE = 20
#: States stay in [LOW, LOW * 2^24), below 2^53, so that all arithmetic on them is exact in doubles; words have 24 bits.
LOW = 1 << 28
BASE = float(1 << 24)
#: Blocks that are coded side by side.
ABREAST = 4
MAGIC = b"IDS1"
HEAD = "<4sIHHII"
SEGMENT = "<III"
END_ID = 2
#: Words whose ids a Python worker keeps, twice: those of late, and those of the time before that were not met again. Which ones are
#: kept changes memory and time, never an id.
KEPT = 300_000
KEPT_LENGTH = 64

#: White space that str.split knows and the rule of the words here does not.
ODD_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Texts that lower-casing by characters and as a whole changes alike, and that normalisation leaves as they are.
#: No special string has a place in them, nor odd white space.
LATIN = re.compile("[\x00-\x1b\x20-;=-\x7f\u00c0-\u012f\u0131-\u017e]*")
ODD_ASCII = "<\x1c\x1d\x1e\x1f"
#: Plain letters, which normalisation leaves as they are, and marks behind them, which are split from the letters and stay together.
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
MARKS = string.punctuation

RAW = "part int, block int, n_ids int, first_doc long, doc_ids array<long>, lengths array<int>, ids binary"
BLOCKS = RAW.replace("ids binary", "data binary")


class WordIds:
    """word -> its ids as bytes, for one vocabulary file that splits texts at white space.

    Plain letters skip the library's normalisation, which would not change them, and are encoded apart from the marks behind them, so that
    each word of letters is encoded once whatever follows it. All others pass it, as it changes nothing beyond a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.late: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.model, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for part in ("normalizer", "pre_tokenizer") for k, v in spec[part].items() if k in ("normalizers", "pretokenizers") for x in v]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex", "")
        if steps != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or "|[\\p{L}]+|" not in pattern or not pattern.endswith("|[^\\s\\p{L}\\p{N}]+"):
            raise ValueError(f"{path}: its words are not told apart by white space, or are changed in other ways")
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.kind = np.dtype("<u2" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        names = [self.model.id_to_token(i) or "" for i in range(self.model.get_vocab_size(with_added_tokens=True))]
        self.length = np.array([len(t.removesuffix("</w>")) for t in names])
        stand_in = {b: c for c, b in byte_symbols().items()} | {0x20: " "}
        self.stand_ins = "".join(stand_in[b] for b in range(256))

    def _letters(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words of plain letters. They meet as one text; the lengths of their ids tell their ends."""
        size = self.kind.itemsize
        for k in range(0, len(words), 20_000):
            text = " ".join(words[k:k + 20_000]).encode()
            ids = np.array(self.bare.encode_batch_fast([codecs.charmap_decode(text, "strict", self.stand_ins)[0]], add_special_tokens=False)[0].ids, self.kind)
            blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
            until = np.append(blanks - np.arange(len(blanks)), len(text) - len(blanks))
            ends = ((np.searchsorted(np.cumsum(self.length[ids]), until) + 1) * size).tolist()
            data = ids.tobytes()
            yield from [data[a:b] for a, b in zip([0, *ends], ends)]

    def _others(self, words: list[str]) -> Iterator[bytes]:
        size = self.kind.itemsize
        for k in range(0, len(words), 20_000):
            some = words[k:k + 20_000]
            made = self.model.encode(some, is_pretokenized=True, add_special_tokens=False)
            ends = (np.cumsum(np.bincount(np.array(made.word_ids, np.int64), minlength=len(some))) * size).tolist()
            data = np.array(made.ids, self.kind).tobytes()
            yield from [data[a:b] for a, b in zip([0, *ends], ends)]

    def _recall(self, words: set[str]) -> set[str]:
        """The words that are not known; those known from before are words of late from here on."""
        new = words.difference(self.late)
        again = new & self.before.keys()
        self.late.update(zip(again, map(self.before.__getitem__, again)))
        return new - again

    def learn(self, words: list[str]) -> None:
        known, bare = self.late, [w.rstrip(MARKS) for w in words]
        letters = set(filter(LETTERS.fullmatch, set(bare)))
        new = list(self._recall(letters))
        known.update(zip(new, self._letters(new)))
        plain = list(map(letters.__contains__, bare))
        marked = [w for w, a in zip(compress(words, plain), compress(bare, plain)) if len(a) < len(w)]
        bare = [w.rstrip(MARKS) for w in marked]
        marks = [w[len(a):] for w, a in zip(marked, bare)]
        rest = set(words).difference(compress(words, plain))
        special = {w for w in rest if any(s in w for s in self.special)}
        new = list(self._recall((rest - special).union(marks)))
        known.update(zip(new, self._others(new)))
        for w in special:
            known[w] = np.array(self.model.encode(w, add_special_tokens=False).ids, self.kind).tobytes()
        known.update(zip(marked, map(bytes.__add__, map(known.__getitem__, bare), map(known.__getitem__, marks))))

    def words_of(self, text: str) -> list[str]:
        if not any(c in text for c in ODD_ASCII) if text.isascii() else LATIN.fullmatch(text):
            return text.lower().split()
        return WORD.findall(text) if ODD_BLANK.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        cut = [self.words_of(t) if t else [] for t in texts]
        wanted = set().union(*cut)
        if len(self.late) + len(wanted) > KEPT:
            self.late, self.before = {}, self.late
        new = self._recall(wanted)
        self.learn(list(new))
        known = self.late
        for words in cut:
            yield b"".join(map(known.__getitem__, words))
        for w in [w for w in new if len(w) > KEPT_LENGTH]:
            a = w.rstrip(MARKS)
            for piece in (w, a, w[len(a):]):
                known.pop(piece, None)


def words_for(path: str) -> WordIds:
    """The table of a vocabulary file, kept by the Python worker from task to task.

    It hangs on the library's module: where functions travel by value, the names of this module start afresh in each task.
    """
    import tokenizers

    kept = vars(tokenizers).setdefault("_cuegrid_word_ids", {})
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def raw_blocks(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The ids of all documents, in ascending doc_id order, as blocks without compression."""
    where = path or public_tokenizers.path("word_bpe_49k.json")
    keys = [F.col("doc_id").asc_nulls_last(), F.col("h").asc(), F.col("m").asc()]
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
            .repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text", F.spark_partition_id().alias("part")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_for(where)
        size, end = words.kind.itemsize, np.array([end_id], words.kind).tobytes()
        full = BLOCK * size
        part, block, seen = 0, 0, 0
        held, ids, doc_ids, lengths = bytearray(), bytearray(), [], []

        def row(data: bytes) -> pa.RecordBatch:
            first = seen - len(doc_ids)
            values = [[part], [block], [len(data) // size], [first], [doc_ids], [lengths], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()))],
                                              ["part", "block", "n_ids", "first_doc", "doc_ids", "lengths", "ids"])

        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            id_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for some in slices(texts, 512, 2_000_000):
                for own in words.encode(some):
                    ids = own + end
                    seen += 1
                    start = 0
                    while start < len(ids):
                        take = min(len(ids) - start, full - len(held))
                        doc_ids.append(id_of[at])
                        lengths.append(take // size)
                        held += ids[start:start + take]
                        start += take
                        if len(held) == full:
                            yield row(bytes(held))
                            block += 1
                            held, doc_ids, lengths = bytearray(), [], []
                    at += 1
        if held:
            yield row(bytes(held))

    return rows.mapInArrow(cut, RAW)


def frequencies(counts: dict[int, int], scale: int = SCALE) -> np.ndarray:
    """Frequencies with a sum of 2^scale, each at least 1 where the count is; index: id."""
    if not counts:
        return np.zeros(0, np.int64)
    if len(counts) > 1 << (scale - 1):
        raise ValueError(f"{len(counts)} ids do not fit a table of 2^{scale}")
    total = sum(counts.values())
    f = np.zeros(max(counts) + 1, np.int64)
    for i, n in counts.items():
        f[i] = max(1, (n << scale) // total)
    over = int(f.sum()) - (1 << scale)
    order = np.argsort(-f, kind="stable")
    for i in order:  # what rounding left is given to, or taken from, the most frequent ids, at most half of each
        if not over:
            break
        step = max(-(1 << scale), min(over, int(f[i]) // 2))
        f[i] -= step
        over -= step
    return f


class Coder:
    """Encodes and decodes blocks by one table of frequencies."""

    def __init__(self, f: np.ndarray):
        self.crc = zlib.crc32(f.astype("<u4").tobytes())
        self.f = f.astype(np.float64)
        self.start = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.float64) if len(f) else self.f
        self.symbol = np.repeat(np.arange(len(f), dtype=np.int32), f)
        self.filler = int(f.argmax()) if len(f) else 0

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """The data of each block of ids."""
        out: list[bytes] = [b""] * len(blocks)
        by_steps: dict[int, list[int]] = {}
        for i, ids in enumerate(blocks):
            by_steps.setdefault(-(-len(ids) // LANES), []).append(i)
        for steps, which in by_steps.items():
            for k in range(0, len(which), ABREAST):
                some = which[k:k + ABREAST]
                for i, data in zip(some, self._encode([blocks[i] for i in some], steps)):
                    out[i] = data
        return out

    def _encode(self, blocks: list[np.ndarray], steps: int) -> Iterator[bytes]:
        n, width = len(blocks), len(blocks) * LANES
        ids = np.full((n, steps * LANES), self.filler, np.int32)
        for i, own in enumerate(blocks):
            ids[i, :len(own)] = own
        lanes = ids.reshape(n, steps, LANES).transpose(1, 0, 2).reshape(steps, width)
        freq, start = np.take(self.f, lanes), np.take(self.start, lanes)
        words, sent = np.empty((steps, width), np.uint32), np.empty((steps, width), bool)
        x, upper, q = np.full(width, float(LOW)), np.empty(width), np.empty(width)
        states = {}
        whole, room = float(1 << SCALE), (LOW >> SCALE) * BASE
        for t in range(steps - 1, -1, -1):
            f = freq[t]
            np.greater_equal(x, np.multiply(f, room, out=q), out=sent[t])
            np.multiply(x, 1.0 / BASE, out=upper)
            np.floor(upper, out=upper)
            np.subtract(x, np.multiply(upper, BASE, out=q), out=words[t], casting="unsafe")
            np.copyto(x, upper, where=sent[t])
            np.divide(x, f, out=q)
            np.floor(q, out=q)
            # x = q * whole + (x - q * f) + start
            x -= np.multiply(q, f, out=upper)
            x += np.multiply(q, whole, out=q)
            x += start[t]
            if t % STEPS == 0:
                states[t // STEPS] = x.reshape(n, LANES).astype("<u8")
        words, sent = words.reshape(steps, n, LANES), sent.reshape(steps, n, LANES)
        for i, own in enumerate(blocks):
            head, body = [struct.pack(HEAD, MAGIC, len(own), LANES, len(states), STEPS, self.crc)], []
            for s in range(len(states)):
                part = slice(s * STEPS, (s + 1) * STEPS)
                w = words[part, i][sent[part, i]].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
                mine = own[s * STEPS * LANES:(s + 1) * STEPS * LANES].astype("<u4")
                head += [struct.pack(SEGMENT, len(w) // 3, zlib.crc32(w), zlib.crc32(mine)), states[s][i].tobytes()]
                body.append(w)
            yield b"".join(head + body)

    def decode(self, blocks: list[bytes], names: list[str], segments: range | None = None) -> list[np.ndarray]:
        """The ids of each block, as u32, or of some of its segments; all segments are decoded side by side."""
        found = [self.segments(data, name) for data, name in zip(blocks, names)]
        chosen = [[s for k, s in enumerate(own) if segments is None or k in segments] for own in found]
        flat = [(s, name) for own, name in zip(chosen, names) for s in own]
        ids: list[np.ndarray] = []
        for k in range(0, len(flat), ABREAST * SEGMENTS):
            ids += self._decode(flat[k:k + ABREAST * SEGMENTS])
        made = iter(ids)
        return [np.concatenate([next(made) for _ in own]) if own else np.zeros(0, np.uint32) for own in chosen]

    def segments(self, data: bytes, name: str) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(ids, crc32 of the ids, states, words) of each segment of a block."""
        try:
            magic, n, lanes, count, steps, table = struct.unpack_from(HEAD, data)
            if magic != MAGIC or lanes != LANES or steps != STEPS or count != -(-n // (lanes * steps)):
                raise ValueError(f"{name}: not a block of this format")
            if table != self.crc:
                raise ValueError(f"{name}: written with another table")
            at, heads = struct.calcsize(HEAD), []
            if len(data) < at + count * (struct.calcsize(SEGMENT) + 8 * lanes):
                raise ValueError(f"{name}: the block is cut short")
            for _ in range(count):
                heads.append((*struct.unpack_from(SEGMENT, data, at), np.frombuffer(data, "<u8", lanes, at + struct.calcsize(SEGMENT))))
                at += struct.calcsize(SEGMENT) + 8 * lanes
            out = []
            for k, (length, crc, ids_crc, states) in enumerate(heads):
                if len(data) < at + 3 * length:
                    raise ValueError(f"{name}: the block is cut short")
                words = np.frombuffer(data, np.uint8, 3 * length, at)
                if zlib.crc32(words) != crc:
                    raise ValueError(f"{name}: segment {k} is damaged")
                out.append((min(n - k * lanes * steps, lanes * steps), ids_crc, states, words))
                at += 3 * length
            return out
        except struct.error as e:
            raise ValueError(f"{name}: the block is cut short") from e

    def _decode(self, flat: list[tuple[tuple[int, int, np.ndarray, np.ndarray], str]]) -> list[np.ndarray]:
        n = len(flat)
        steps = [-(-s[0] // LANES) for s, _ in flat]
        order = sorted(range(n), key=lambda k: -steps[k])  # those that end early come last, so that the others stay a prefix
        parts = [flat[k][0] for k in order]
        ends = np.array([steps[k] for k in order])
        low, middle, high = np.concatenate([p[3] for p in parts]).reshape(-1, 3).T.astype(np.float64)
        words = low + 256.0 * middle + 65536.0 * high
        place = np.cumsum([0, *[len(p[3]) // 3 for p in parts[:-1]]])
        x = np.concatenate([p[2] for p in parts]).astype(np.float64)
        out = np.empty((max(steps), n * LANES), np.int32)
        whole, low = float(1 << SCALE), float(LOW)
        for t in range(max(steps)):
            live = int(np.searchsorted(-ends, -t, "left")) * LANES
            y = x[:live]
            upper = np.floor(y * (1.0 / whole))
            y -= upper * whole
            sym = np.take(self.symbol, y.astype(np.int32), out=out[t, :live], mode="clip")
            y -= self.start[sym]
            y += self.f[sym] * upper
            short = np.flatnonzero(y < low)
            read = np.bincount(short // LANES, minlength=live // LANES)
            where = np.arange(len(short)) + np.repeat(place[:live // LANES] - np.cumsum(read) + read, read)
            y[short] = y[short] * BASE + words[where]
            place[:live // LANES] += read
        made: list[np.ndarray] = [out[:0, 0]] * n
        for i, k in enumerate(order):
            (length, crc, _, _), name = flat[k]
            ids = out[:steps[k], i * LANES:(i + 1) * LANES].reshape(-1)[:length].astype("<u4")
            if zlib.crc32(ids) != crc:
                raise ValueError(f"{name}: the decoded ids fail their checksum")
            made[k] = ids
        return made


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encode the texts of docs (doc_id, text) and write them to a folder that all executors reach."""
    spark = docs.sparkSession
    raw = as_table(raw_blocks(docs, path, end_id), "raw-ids")
    kind = lambda n, data: np.frombuffer(data, f"<u{len(data) // n}")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.bincount(kind(n, data.as_buffer()), minlength=len(total))
                own[:len(total)] += total
                total = own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    # one row for each id of the vocabulary at most
    counts = raw.select("n_ids", "ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    f = frequencies({r["id"]: r["n"] for r in counts})
    at = np.flatnonzero(f)
    spark.createDataFrame(pd.DataFrame({"id": at, "frequency": f[at]}), "id long, frequency long").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(f)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, ABREAST):
                some = batch.slice(k, ABREAST)
                data = coder.encode([kind(n, d.as_buffer()) for n, d in zip(some.column(2).to_pylist(), some.column(6))])
                yield pa.RecordBatch.from_arrays([*some.columns[:6], pa.array(data, pa.binary())], [*some.schema.names[:6], "data"])

    raw.mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


#: x^(8 * 2^k) modulo the polynomial of crc32, for k = 0..63, bits reflected; filled when first needed.
_powers: list[int] = []


def _times(a: int, b: int) -> int:
    """The product of two reflected polynomials modulo that of crc32."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings one after the other, from theirs and the length of the second."""
    if not _powers:
        _powers.append(1 << 23)
        for _ in range(63):
            _powers.append(_times(_powers[-1], _powers[-1]))
    k = 0
    while length:
        if length & 1:
            first = _times(_powers[k], first)
        length >>= 1
        k += 1
    return first ^ second


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: what the files of a folder hold of each document."""
    table = spark.read.parquet(f"{folder}/table").collect()  # the vocabulary at most
    f = np.zeros(max((r["id"] for r in table), default=-1) + 1, np.int64)
    for r in table:
        f[r["id"]] = r["frequency"]
    shared = spark.sparkContext.broadcast(f)
    blocks = spark.read.parquet(f"{folder}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, ABREAST):
                some = batch.slice(k, ABREAST).to_pydict()
                rows = []
                ids = coder.decode(some["data"], [f"part {p} block {b}" for p, b in zip(some["part"], some["block"])])
                for i, own in enumerate(ids):
                    data, at = memoryview(own.astype("<u4")).cast("B"), 0
                    for j, (doc, n) in enumerate(zip(some["doc_ids"][i], some["lengths"][i])):
                        rows.append((some["part"][i], some["first_doc"][i] + j, some["block"][i], at, doc, n, zlib.crc32(data[4 * at:4 * (at + n)])))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
                                                 ["part", "place", "block", "at", "doc_id", "n", "crc"])

    found = blocks.mapInArrow(decode, "part int, place long, block int, at int, doc_id long, n int, crc long")
    # a document has one row for each block that it reaches into
    docs = found.groupBy("part", "place").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("block", "at", "n", "crc"))).alias("rows"))

    @F.pandas_udf("long")
    def of_rows(rows: pd.Series) -> pd.Series:
        out = []
        for own in rows:
            crc = own[0]["crc"]
            for r in own[1:]:
                crc = joined_crc(crc, r["crc"], 4 * r["n"])
            out.append(crc)
        return pd.Series(out, dtype="int64")

    block_start = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    part_start = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a part is what one task wrote: it has some thousands of blocks at most, and there are as many parts as tasks
    parts = blocks.groupBy("part").agg(F.sum(F.col("n_ids").cast("long")).alias("n")).select("part", F.coalesce(F.sum("n").over(part_start), F.lit(0)).alias("part_start"))
    starts = (blocks.select("part", "block", F.coalesce(F.sum(F.col("n_ids").cast("long")).over(block_start), F.lit(0)).alias("block_start"))
              .join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("first_id")))
    first = F.col("rows")[0]
    return (docs.withColumn("block", first["block"]).withColumn("at", first["at"]).join(starts, ["part", "block"])
            .select("doc_id", (F.col("first_id") + F.col("at")).alias("start"), "n_tokens", of_rows("rows").alias("ids_crc32")))
