"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. All blocks are sorted, and a block's name is
the number of different blocks before it: an integer that stands for its bytes and for no others. Adjacent
names of a text are then pairs, the pairs are sorted and named the same way, and so on until each text has
one name. No fingerprint is involved: two texts get the same (level, name) if and only if they are equal.

Names come from sorted runs. Rows are sorted by range of (block, row, place), so copies of one block spread
over as many tasks as they need; a task numbers the runs it sees, and the first and last block of each task
tell how far its numbers have to be shifted and whether a run goes on from the task before. The bytes
are shuffled once, every later level moves two integers for each pair, and there are half as many each time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechframe.llm.common import cut, small, tidy

BLOCK_BYTES = 1024
#: Rows of an Arrow batch that comes back from a task.
BATCH_ROWS = 4096
#: Stands where a text of an odd number of blocks has no right neighbour; names start at 0.
NOTHING = -1


def normalised(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased and nothing else; NULL is the empty text."""
    return pc.cast(pc.ascii_lower(pc.fill_null(texts, "")), pa.binary())


def cut_blocks(docs: DataFrame, text: str, id: str, block_bytes: int) -> DataFrame:
    """(row, place, n, block, id, sha): the blocks of each row's normalised text, n of them, one empty block
    for an empty text. ``id`` and ``sha``, the digest of the whole normalised text, are on the first."""
    kind = docs.schema[id].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = normalised(batch.column(2))
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1]
            offsets = offsets.astype(np.int64)
            sizes = np.diff(offsets)
            counts = np.maximum(1, -(-sizes // block_bytes))
            ends = np.cumsum(counts)
            owner = np.repeat(np.arange(len(texts)), counts)
            place = np.arange(len(owner)) - (ends - counts)[owner]
            starts = offsets[:-1][owner] + place * block_bytes
            bounds = np.append(starts, offsets[-1]).astype(np.int32)
            # Blocks follow each other in the texts' own bytes, so they are a second view of these.
            blocks = pa.Array.from_buffers(
                pa.binary(), len(owner), [None, pa.py_buffer(bounds), texts.buffers()[2]]
            )
            data = memoryview(texts.buffers()[2] or b"")
            digests = [
                hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
            ]
            first = pa.array(np.where(place == 0, owner, 0), mask=place != 0)
            arrays = [
                batch.column(0).take(pa.array(owner)),
                pa.array(place),
                pa.array(counts[owner]),
                blocks,
                batch.column(1).take(first),
                pa.array(digests, pa.binary()).take(first),
            ]
            out = pa.RecordBatch.from_arrays(arrays, ["row", "place", "n", "block", "id", "sha"])
            for at in range(0, len(owner), BATCH_ROWS):
                yield out.slice(at, BATCH_ROWS)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(text).alias("text")
    )
    return rows.mapInArrow(
        tidy(task), f"row long, place long, n long, block binary, id {kind}, sha binary"
    )


def name_runs(rows: DataFrame, key: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """The rows without the key's columns (which hold no NULL) but with ``name``, a number from 0 for each
    different key, in the order of the keys. ``tie`` are columns that tell rows of one key apart.

    The numbered rows are checkpointed, so the shifts fit them also after executors are lost.
    """
    kept = [c for c in rows.columns if c not in key]
    ordered = rows.repartitionByRange(*key, *tie).sortWithinPartitions(*key, *tie)
    ordered = ordered.select(*kept, F.spark_partition_id().alias("__part"), *key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    schema += ", __name long, __edge int"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(batch, names, edges):
            # The key's bytes go on only where the task's rows begin and end.
            inner = pa.array(edges == 0)
            arrays = [batch.column(c) for c in (*kept, "__part")]
            for c in key:
                column = batch.column(c)
                arrays.append(pc.if_else(inner, pa.scalar(None, column.type), column))
            arrays += [pa.array(names), pa.array(edges)]
            return pa.RecordBatch.from_arrays(arrays, [*kept, "__part", *key, "__name", "__edge"])

        held, last, count = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in key:
                column = batch.column(c)
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            first = [batch.column(c)[0].as_py() for c in key]
            new[0] = last is None or first != last
            names = count - 1 + np.cumsum(new)
            edges = np.zeros(batch.num_rows, dtype=np.int32)
            edges[0] = last is None
            last = [batch.column(c)[-1].as_py() for c in key]
            count = int(names[-1]) + 1
            if held:
                yield finished(*held)
            held = batch, names, edges
        if held:
            held[2][-1] += 2
            yield finished(*held)

    numbered = cut(ordered.mapInArrow(tidy(task), schema))
    starts = numbered.filter(F.col("__edge").bitwiseAND(1) == 1).select(
        "__part", F.struct(*key).alias("first")
    )
    ends = numbered.filter(F.col("__edge") >= 2).select(
        "__part", F.struct(*key).alias("last"), (F.col("__name") + 1).alias("runs")
    )
    order = Window.orderBy("__part")
    # One row for each task of the sort, so the window and the broadcast are small.
    goes_on = F.coalesce((F.lag("last").over(order) == F.col("first")).cast("long"), F.lit(0))
    before = F.coalesce(F.sum("runs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = starts.join(ends, "__part").select("__part", "runs", goes_on.alias("on"), before.alias("before"))
    shifts = tasks.select("__part", (F.col("before") - F.sum("on").over(order)).alias("__shift"))
    named = numbered.join(F.broadcast(shifts), "__part")
    return named.select(*kept, (F.col("__name") + F.col("__shift")).alias("name"))


def name_texts(
    docs: DataFrame, text: str = "text", id: str = "doc_id", *, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(row, id, text_sha256, n_blocks, level, name) for each row: texts are equal after lower-casing A-Z if and only
    if they have the same (level, name).

    NULL counts as the empty text. ``row`` tells rows apart that are repeated or share an id (NULL too). It
    numbers the rows as they are read: input that is not read from files or a checkpoint should be written
    first. Other columns of ``docs`` are not read, whatever their names.
    """
    names = name_runs(cut_blocks(docs, text, id, block_bytes), ["block"], ["row", "place"])
    first = names.filter(F.col("place") == 0)
    heads = first.select(
        "row", "id", F.lower(F.hex("sha")).alias("text_sha256"), F.col("n").alias("n_blocks")
    )
    longest = names.agg(F.max("n")).first()[0] or 0
    level, whole = 0, []
    while True:
        done = names.filter(F.col("n") == 1)
        whole.append(done.select("row", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        even = F.col("place") % 2 == 0
        pairs = (
            names.filter(F.col("n") > 1)
            .groupBy("row", F.shiftright("place", 1).alias("place"))
            .agg(
                F.shiftright(F.max("n") + 1, 1).alias("n"),
                F.max(F.when(even, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NOTHING)).alias("right"),
            )
        )
        names = name_runs(pairs, ["left", "right"], ["row", "place"])
        longest, level = (longest + 1) // 2, level + 1
    found = whole[0]
    for part in whole[1:]:
        found = found.union(part)
    return heads.join(found, "row")


def exact_duplicates(
    docs: DataFrame, text: str = "text", id: str = "doc_id", *, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row, dropped ones too.

    Of equal texts the row with the largest id stays (NULL is the smallest; of rows with one id, the one read
    last). Only names held by several rows are joined back, and they were counted by partial aggregates, so a
    text that a third of all rows share is one row of the other side.
    """
    named = cut(name_texts(docs, text, id, block_bytes=block_bytes))
    best = F.max(F.struct("id", "row")).alias("best")
    groups = named.groupBy("level", "name").agg(F.count(F.lit(1)).alias("size"), best)
    shared = small(cut(groups.filter(F.col("size") > 1)))
    both = named.join(shared, ["level", "name"], "left")
    alone = F.col("size").isNull()
    return both.select(
        F.col("id").alias(id),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )
