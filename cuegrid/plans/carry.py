"""Left-to-right folds with carried state, run chunk by chunk.

Some groupings depend on everything the open group has collected so far, so no
window expresses them. The rows are hashed on (keys, chunk), sorted and
streamed through a small step function in Arrow batches: memory
per task is one batch plus the state, whatever the length of a sequence.

A state is a list of open groups, each a list whose first item is the group's
label; steps hand labels on and never look at them. That makes chunks
independent of what came before them but for the shape of the open groups:

1. A chunk first assumes nothing is open at its start. The end of a chunk, with its labels
   replaced by slot numbers ("~0", "~1", ...), is tried as entry of the following chunk, and every
   (chunk, entry) -> (end, label of each end slot) found is kept. An open group that lasts over many chunks
   has the same shape at a chunk's end whoever opened it, so this settles after a round or two; only where
   different entries of a chunk lead to different shapes at its end, again and again, are there more.
2. The true entries are read off the table of ends by doubling jumps.
3. The label of an entry slot is that of a slot at the end of the chunk before: an id, or a slot of that chunk's own
   entry. Pointer doubling over (chunk, slot) finds the ids.
4. The chunks are replayed once from their true entries, and slot numbers in the output are looked up.

Keys that fit in one chunk skip all but the replay.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cuegrid.plans.scan import CHUNK, Sequence
from cuegrid.plans.store import cut

State = list | None
Step = Callable[[State, tuple], tuple[State, tuple]]


def _shape(state: State) -> tuple[State, list]:
    """(the state with slot numbers for labels, the labels)."""
    if not state:
        return None, []
    return [[f"~{k}", *group[1:]] for k, group in enumerate(state)], [group[0] for group in state]


def _replay(batches: Iterator[pa.RecordBatch], seq: Sequence, fields: list[str], step: Step):
    """Yield (batch, outputs, [(chunk key + entry, end state)]) while walking sorted rows."""
    here, state = None, None
    for batch in batches:
        ids = list(zip(*[batch.column(k).to_pylist() for k in (*seq.chunk_keys, "_entry")]))
        rows = zip(*[batch.column(f).to_pylist() for f in fields])
        outs, ends = [], []
        for key, row in zip(ids, rows):
            if key != here:
                if here is not None:
                    ends.append((here, state))
                here, state = key, json.loads(key[-1]) if key[-1] else None
            state, out = step(state, row)
            outs.append(out)
        yield batch, outs, ends
    if here is not None:
        yield None, [], [(here, state)]


def _entering(df: DataFrame, entries: DataFrame | None, seq: Sequence) -> DataFrame:
    if entries is None:
        ready = df.withColumn("_entry", F.lit(""))
    else:
        ready = df.join(entries, seq.chunk_keys, "left").withColumn("_entry", F.coalesce("_entry", F.lit("")))
    # The window makes "one chunk, one task, in order" a requirement of the plan.
    # A repartition in front of an Arrow map is only a wish: adaptive execution may
    # drop it as redundant and then read the join's shuffle locally.
    replay = Window.partitionBy(*seq.chunk_keys, "_entry").orderBy(*seq.order)
    return ready.withColumn("_row", F.row_number().over(replay))


def _ends(df: DataFrame, entries: DataFrame | None, seq: Sequence, fields: list[str], step: Step) -> DataFrame:
    """(keys, chunk, _entry, _end, _labels) of every chunk, for each entry it is given."""
    names = seq.chunk_keys
    added = [T.StructField(n, T.StringType()) for n in ("_entry", "_end")] + [T.StructField("_labels", T.ArrayType(T.StringType()))]
    schema = T.StructType([df.schema[n] for n in names] + added)
    types = [to_arrow_type(df.schema[n].dataType) for n in names] + [pa.string(), pa.string(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ends in _replay(batches, seq, fields, step):
            if ends:
                shaped = [(key, *_shape(state)) for key, state in ends]
                columns = list(zip(*[(*key, json.dumps(shape) if shape else "", [str(x) for x in labels]) for key, shape, labels in shaped]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    return _entering(df, entries, seq).mapInArrow(run, schema)


def _entry_states(df: DataFrame, seq: Sequence, fields: list[str], step: Step) -> tuple[DataFrame, DataFrame] | None:
    """((keys, chunk, _entry), (keys, chunk, _slot, _id)) for every chunk that something open reaches."""
    keys, at = list(seq.keys), seq.chunk_keys
    spread = df.groupBy(*keys).agg(F.min(CHUNK).alias("_lo"), F.max(CHUNK).alias("_hi")).where("_lo < _hi")
    if spread.isEmpty():
        return None
    long = cut(df.join(spread.select(*keys), keys, "left_semi"))
    follow = cut(long.select(*at).distinct().select(
        *at, F.lead(CHUNK).over(seq.chain()).alias("_next"), F.lag(CHUNK).over(seq.chain()).isNull().alias("_head")))
    onward = follow.where("_next is not null").select(*at, "_next")
    known = fresh = cut(_ends(long, None, seq, fields, step))
    while True:
        handed = fresh.join(onward, at).where("_end <> ''").select(*keys, F.col("_next").alias(CHUNK), F.col("_end").alias("_entry")).distinct()
        new = cut(handed.join(known, [*at, "_entry"], "left_anti"))
        if new.isEmpty():
            break
        fresh = cut(_ends(long.join(new, at, "left_semi"), new, seq, fields, step))
        known = cut(known.unionByName(fresh))
    entered = cut(_followed(known.join(onward, at), follow.where("_head").select(*at), seq))
    return entered.where("_entry <> ''"), _ids(known.join(entered, [*at, "_entry"]).join(onward, at), seq)


def _ids(path: DataFrame, seq: Sequence) -> DataFrame:
    """(keys, chunk, _slot, _id): the label of each entry slot; path: (keys, chunk, _entry, _labels, _next) as really walked."""
    keys = list(seq.keys)
    slots = path.select(*keys, F.col(CHUNK).alias("_from"), F.col("_next").alias(CHUNK), F.posexplode("_labels").alias("_slot", "_label"))
    own = F.col("_label").startswith("~")
    known = cut(slots.select(*keys, CHUNK, "_slot", F.when(~own, F.col("_label").cast("long")).alias("_id"),
                             F.when(own, F.col("_from")).alias("_to"), F.when(own, F.substring("_label", 2, 10).cast("int")).alias("_to_slot")))
    while not known.where("_to is not null").isEmpty():
        second = known.select(*keys, F.col(CHUNK).alias("_to"), F.col("_slot").alias("_to_slot"), F.col("_id").alias("_far_id"), F.col("_to").alias("_far"), F.col("_to_slot").alias("_far_slot"))
        known = cut(known.join(second, [*keys, "_to", "_to_slot"], "left").select(
            *keys, CHUNK, "_slot", F.coalesce("_id", "_far_id").alias("_id"), F.col("_far").alias("_to"), F.col("_far_slot").alias("_to_slot")))
    return known.select(*keys, CHUNK, "_slot", "_id")


def _followed(moves: DataFrame, heads: DataFrame, seq: Sequence) -> DataFrame:
    """The entries met when walking from the heads; the k-th pass jumps 2**k chunks."""
    keys, at = list(seq.keys), [*seq.chunk_keys, "_entry"]
    jump = cut(moves.select(*at, F.col("_next").alias("_to"), F.col("_end").alias("_to_entry")))
    met = cut(heads.withColumn("_entry", F.lit("")))
    while True:
        more = cut(met.join(jump, at).select(*keys, F.col("_to").alias(CHUNK), F.col("_to_entry").alias("_entry")))
        if more.isEmpty():
            return met
        met = cut(met.unionByName(more))
        second = jump.select(*keys, F.col(CHUNK).alias("_to"), F.col("_entry").alias("_to_entry"), F.col("_to").alias("_far"), F.col("_to_entry").alias("_far_entry"))
        jump = cut(jump.join(second, [*keys, "_to", "_to_entry"]).select(*at, F.col("_far").alias("_to"), F.col("_far_entry").alias("_to_entry")))


def carry_fold(
    df: DataFrame,
    seq: Sequence,
    fields: list[str],
    step: Step,
    out: T.StructType,
) -> DataFrame:
    """Append the columns `out` that step(state, row) returns for each row.

    row is the tuple of `fields`. A state is a list of groups [label, ...] that survives a JSON round trip, or None, as at
    the start of a key; the first output is a label, and labels are whole numbers. df should hold only columns needed later.
    """
    base = seq.with_chunk(df)
    narrow = base.select(*dict.fromkeys([*seq.chunk_keys, *seq.order, *fields]))
    found = _entry_states(narrow, seq, fields, step)
    kept = list(df.columns) if found is None else list(dict.fromkeys([*df.columns, CHUNK]))
    schema = T.StructType([base.schema[c] for c in kept] + list(out) + [T.StructField("_slot", T.IntegerType())])
    types = [*[to_arrow_type(f.dataType) for f in out], pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, outs, _ in _replay(batches, seq, fields, step):
            if batch is not None and outs:
                told = [(None, *o[1:], int(o[0][1:])) if isinstance(o[0], str) else (*o, None) for o in outs]
                added = [pa.array(c, t) for c, t in zip(zip(*told), types)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + added, names=schema.names)

    if found is None:
        return _entering(base, None, seq).mapInArrow(run, schema).drop("_slot")
    entries, ids = found
    replayed = _entering(base, entries, seq).mapInArrow(run, schema)
    label = out[0].name
    return (replayed.join(ids, [*seq.chunk_keys, "_slot"], "left").withColumn(label, F.coalesce(label, "_id"))
            .select(*df.columns, *[f.name for f in out]))
