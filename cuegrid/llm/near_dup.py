"""Near-duplicate grouping by SuperMinHash signatures, banding, exact verification and grouping of the links.

1. Signatures. Each shingle draws, turn by turn, a slot of a random permutation of its own and a value in [turn, turn + 1)
   (SuperMinHash, Ertl 2017); a slot keeps the least value. A document stops after the turn that no later value can beat.
2. Classes. Documents with equal shingle sets are one class; only the smallest doc_id of each goes on.
3. Bands. 32 bands of 4 slots: a pair at similarity 0.75 shares no band with probability 5e-6, at 0.8 with 5e-8.
   Round one pairs every member of a bucket with the bucket's smallest id. After verification and grouping, round two looks
   only at buckets whose members are not all in one group. Members that a sketch of the signatures (one byte a slot) allows
   to be linked with a member of another group meet with their full sets, bucket by bucket, and one link of each two groups
   is returned: no list of pairs is ever written, however large a bucket.
4. Verification counts the intersection of the full shingle sets.
5. Grouping alternates large-star and small-star steps on the links until nothing changes; no group meets in one task.

Every join on an id or key that may be hot has a written table on both sides, so adaptive execution can split it.

Defined results: a text has one shingle if it has one to four words; null, empty and wordless texts have no shingles and
stay alone. Repeated rows with one doc_id are one node of the links and get one output row each. Rows without doc_id are
linked with nothing and kept; their component_id is null. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import give_back, utf8_words
from cuegrid.plans.store import as_table

WORDS = 5
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a task keeps until its end. The table starts afresh when full, which changes no hash.
KEPT = 250_000
#: Members of a bucket that are compared in one go; larger buckets are compared block by block.
BLOCK = 2_048
#: Shingles of such members, likewise.
WEIGHT = 1_000_000


@dataclass(frozen=True)
class Bands:
    bands: int = 32
    rows: int = 4
    #: Links need 100 * intersection >= percent * union.
    percent: int = 75

    @property
    def slots(self) -> int:
        return self.bands * self.rows


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= KEPT:
                self.clear()
            self[word] = h
        return h


_hashes = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = utf8_words(text)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(WORDS, len(h))
    s = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        s = (s * GOLDEN) + h[k:len(h) - width + 1 + k]
    return np.unique(mixed(s))


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash signatures, sets x slots; the value of turn j is j * 2^32 plus 32 random bits."""
    sig = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(owner):
        return sig
    element = np.concatenate(sets)
    chosen: list[np.ndarray] = []  # by turn: the position drawn, and what stood at the position of the turn itself
    moved: list[np.ndarray] = []

    def standing(at: np.ndarray) -> np.ndarray:
        """What the permutation holds at these positions, all not before the present turn."""
        value = at.copy()
        for k, w in zip(chosen, moved):
            np.copyto(value, w, where=at == k)
        return value

    for turn in range(slots):
        h = mixed(element + np.uint64((turn + 1) * int(GOLDEN) % (1 << 64)))
        at = (np.uint64(turn) + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(slots - turn) >> np.uint64(32))).astype(np.uint16)
        value = (np.uint64(turn) << np.uint64(32)) | (h >> np.uint64(32))
        np.minimum.at(sig.reshape(-1), owner * slots + standing(at), value)
        open_ = (sig.max(axis=1) >= np.uint64(turn + 1) << np.uint64(32))[owner]
        if not open_.any():
            break
        moved.append(standing(np.full(len(at), turn, np.uint16)))
        chosen.append(at)
        if not open_.all():
            element, owner = element[open_], owner[open_]
            chosen, moved = [k[open_] for k in chosen], [w[open_] for w in moved]
    return sig


def band_keys(sig: np.ndarray, plan: Bands) -> np.ndarray:
    keys = np.tile(np.arange(1, plan.bands + 1, dtype=np.uint64), (len(sig), 1))
    for k in range(plan.rows):
        keys = mixed(keys * GOLDEN + sig[:, k::plan.rows][:, :plan.bands])
    return keys.view(np.int64)


def sketches(sig: np.ndarray, keys: np.ndarray) -> list[bytes]:
    """32 bits of every band key, then one byte of every slot: equal bytes come up with little more than the similarity."""
    low = (keys.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [a.tobytes() + b.tobytes() for a, b in zip(low, (mixed(sig) & np.uint64(0xFF)).astype(np.uint8))]


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.string()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def texts_in_parts(batch: pa.RecordBatch, most_chars: int = 1_000_000) -> Iterator[tuple[list, list]]:
    """(ids, texts) of parts of a batch with a bounded number of characters."""
    ids, texts, chars = [], [], 0
    for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        ids.append(i)
        texts.append(t.as_py())
        chars += len(texts[-1] or "")
        if chars >= most_chars:
            yield ids, texts
            ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def long_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def signed(docs: DataFrame, plan: Bands) -> DataFrame:
    """doc_id, n_shingles, key of the shingle set, bands, sketch."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in texts_in_parts(batch):
                sets = [shingles(t) for t in texts]
                sig = signatures(sets, plan.slots)
                keys = band_keys(sig, plan)
                yield pa.record_batch([
                    pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]),
                    long_lists(list(keys.view(np.uint64))), pa.array(sketches(sig, keys), pa.binary())], schema=SIGNED)
            give_back()
        _hashes.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_shingles long, key string, bands array<long>, sketch binary")


def full_sets(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in texts_in_parts(batch):
                yield pa.record_batch([pa.array(ids, pa.int64()), long_lists([shingles(t) for t in texts])], schema=SETS)
            give_back()
        _hashes.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, plan: Bands) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("both"))
            .where(100 * F.col("common") >= plan.percent * (F.col("both") - F.col("common"))).select("a", "b"))


def checksum(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, whatever their order: the count and two sums of hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def grouped(links: DataFrame) -> DataFrame:
    """doc_id, component: the smallest id reachable over the links, for every id that has one."""
    edges = as_table(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "near-edges")
    seen = checksum(edges)
    while True:
        # large star: the larger neighbours of a node move to the least of all its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = as_table(both.groupBy("u").agg(F.min("v").alias("m")), "near-least")
        large = as_table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "near-large")
        # small star: a node and its smaller neighbours move to the least of them
        least = as_table(large.groupBy("u").agg(F.min("v").alias("m")), "near-least")
        joined = large.join(least, "u")
        small = (joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        small = as_table(small, "near-small")
        # a fixed point of both steps: every node points at the least id of its group
        seen, before = checksum(small), seen
        if seen == before:
            return small.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).unionByName(
                small.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct())
        edges = small


UNIT = ["key", "i", "j"]
MEMBER = "key long, i int, j int, second boolean, doc_id long, component long"


def by_unit(rows: DataFrame, schema: str, handle) -> DataFrame:
    """handle(table) for the rows of each (key, i, j), streamed: a task holds one unit and one batch at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            starts = unit_starts(rest)
            for lo, hi in zip(starts[:-1], starts[1:]):
                yield from handle(rest.slice(lo, hi - lo)).to_batches()
            rest = rest.slice(starts[-1]) if len(starts) else rest
        if rest is not None and rest.num_rows:
            yield from handle(rest).to_batches()
        give_back()

    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(run, schema)


def unit_starts(table: pa.Table) -> np.ndarray:
    if not table.num_rows:
        return np.zeros(0, np.int64)
    unit = np.stack([table[c].to_numpy() for c in UNIT])
    return np.concatenate([[0], 1 + np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0))])


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows to compare with columns: all with all inside a block, one block with the other otherwise."""
    if table["i"][0].as_py() == table["j"][0].as_py():
        every = np.arange(table.num_rows)
        return every, every
    second = table["second"].to_numpy(zero_copy_only=False)
    return np.flatnonzero(second), np.flatnonzero(~second)


def in_question(members: DataFrame, plan: Bands) -> DataFrame:
    """MEMBER rows: of each unit those that have a partner of another group there which sketch and size allow to be a link.

    members: key, size and weight (members and shingles of the bucket), doc_id, n, sketch, component. A bucket of more than
    BLOCK members or WEIGHT shingles is compared in pairs of hashed blocks, each pair of blocks a unit. A pair that shares
    several buckets counts only in that of its first common band.
    """
    blocks = F.greatest(F.ceil(F.col("size") / F.lit(BLOCK)), F.ceil(F.col("weight") / F.lit(WEIGHT))).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    units = (members.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("second"),
                     "doc_id", "component", "n", "sketch"))
    slots, percent, width = plan.slots, plan.percent, 4 * plan.bands
    # 4.9 standard deviations of the share of equal slots below its mean at the threshold: one pair in a million falls short
    enough = slots * percent / 100 - 4.9 * (slots * percent / 100 * (1 - percent / 100)) ** 0.5

    def handle(table: pa.Table) -> pa.Table:
        comp, n = table["component"].to_numpy(), table["n"].to_numpy()
        raw = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
        bands, sketch = np.ascontiguousarray(raw[:, :width]).view(np.uint32), raw[:, width:]
        own = np.uint32(table["key"][0].as_py() & 0xFFFFFFFF)
        band = int((bands == own).sum(axis=0).argmax())  # rows that share an id but not the text may bring another one's sketch
        rows, cols = sides(table)
        wanted = np.zeros(table.num_rows, bool)
        for lo in range(0, len(rows), 64):
            r = rows[lo:lo + 64]
            fits = comp[r][:, None] != comp[cols][None, :]
            fits &= 100 * np.minimum(n[r][:, None], n[cols][None, :]) >= percent * np.maximum(n[r][:, None], n[cols][None, :])
            for b in range(band):
                fits &= bands[r, b][:, None] != bands[cols, b][None, :]
            x, y = np.nonzero(fits)
            for part in range(0, len(x), 50_000):
                px, py = r[x[part:part + 50_000]], cols[y[part:part + 50_000]]
                keep = (sketch[px] == sketch[py]).sum(axis=1) >= enough
                wanted[px[keep]] = wanted[py[keep]] = True
        return table.filter(pa.array(wanted)).select(["key", "i", "j", "second", "doc_id", "component"])

    return by_unit(units, MEMBER, handle)


def crossing_links(members: DataFrame, sets: DataFrame, plan: Bands) -> DataFrame:
    """One verified link (a, b) of each two groups that have one in a unit; members: MEMBER rows.

    Full sets meet in the unit: each row outside its largest group is held against all others of other groups.
    """
    percent = plan.percent

    def handle(table: pa.Table) -> pa.Table:
        ids, comp = table["doc_id"].to_numpy(), table["component"].to_numpy()
        lists = table["shingles"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        rows, cols = sides(table)
        is_row, is_col = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        is_row[rows], is_col[cols] = True, True
        values, counts = np.unique(comp, return_counts=True)
        mark = np.zeros(int(flat.max()) + 1, np.int32)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for x in np.flatnonzero(comp != values[counts.argmax()]):
            mark[flat[starts[x]:starts[x + 1]]] = 1
            common = np.add.reduceat(mark[flat], starts[:-1])
            mark[flat[starts[x]:starts[x + 1]]] = 0
            linked = (100 * common >= percent * (sizes + sizes[x] - common)) & (comp != comp[x]) & (is_col if is_row[x] else is_row)
            for y in np.flatnonzero(linked)[np.unique(comp[linked], return_index=True)[1]]:
                pair = tuple(sorted((int(ids[x]), int(ids[y]))))
                found.setdefault(tuple(sorted((int(comp[x]), int(comp[y])))), pair)
        pairs = sorted(set(found.values()))
        return pa.table({"a": pa.array([p[1] for p in pairs], pa.int64()), "b": pa.array([p[0] for p in pairs], pa.int64())})

    filled = members.join(sets, "doc_id").where(F.size("shingles") > 0).select(*UNIT, "second", "doc_id", "component", "shingles")
    return by_unit(filled, "a long, b long", handle).distinct()


def near_duplicates(docs: DataFrame, plan: Bands = Bands()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    marks = as_table(signed(docs, plan), "near-marks")
    able = marks.where("n_shingles > 0 and doc_id is not null")
    copies = as_table(able.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("key").alias("copy_key"), "rep"), "near-copies")
    node = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    first = (F.col("n_shingles") > 0) & (F.col("doc_id") == node)
    members = as_table(marks.join(copies, F.col("key") == F.col("copy_key"), "left")
                       .select("doc_id", "n_shingles", node.alias("rep"), F.when(first, F.col("bands")).alias("bands"), F.when(first, F.col("sketch")).alias("sketch")), "near-members")

    first_ones = members.where("bands is not null")
    banded = first_ones.select(F.explode("bands").alias("key"), "doc_id", F.col("n_shingles").alias("n"))
    shared = as_table(banded.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("size > 1"), "near-shared")
    buckets = as_table(banded.drop("n").join(shared, "key"), "near-buckets")  # ids only; sketches are looked up where they are needed
    ids = buckets.select("doc_id").distinct()
    sets = as_table(full_sets(docs.join(ids, "doc_id", "left_semi")), "near-sets")

    pairs = as_table(buckets.where("doc_id != leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).distinct(), "near-pairs")
    links = as_table(verified(pairs, sets, plan), "near-links")
    groups = as_table(grouped(links), "near-groups")
    labelled = as_table(buckets.select("key", "size", "weight", "doc_id").join(groups, "doc_id", "left")
                        .withColumn("component", F.coalesce("component", "doc_id")), "near-labelled")
    mixed_keys = as_table(labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"), "near-mixed")
    in_mixed = as_table(labelled.join(mixed_keys, "key"), "near-in-mixed")
    marked = first_ones.select("doc_id", F.col("n_shingles").alias("n"), "sketch")
    open_ = as_table(in_question(in_mixed.join(marked, "doc_id"), plan), "near-open")
    more = as_table(crossing_links(open_, sets, plan), "near-more")
    if not more.isEmpty():
        groups = as_table(grouped(links.unionByName(more)), "near-groups")
    found = members.select("doc_id", "n_shingles", "rep").join(groups.withColumnRenamed("doc_id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
