"""Helpers the training-data operators share: lineage, row numbers, components, grouped streams."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only after it was counted and has at most so many rows (of fixed width).
BROADCAST_ROWS = 500_000


def checkpoint_folder(spark: SparkSession) -> None:
    """The folder the cluster names in ``spark.checkpoint.dir``; only a session on one machine
    without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the checkpoint folder, read from there. Unlike a checkpoint it brings nothing of
    the plan along: where many small joins follow each other, what the optimizer has inferred about
    their columns would grow with every one of them."""
    checkpoint_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it was counted to be small, as it is otherwise.
    Counting stops at the limit; the table should be cheap to read twice (a checkpoint)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """The rows with their global number 0 .. n-1 in the given order, and n.

    Built-in operations only. Rows are sorted by range partitions, so no task sees them all, and
    positions inside a partition are shifted by the sizes of the partitions before it. Equal rows
    are counted first and told apart by (partition, copy), so that copies of one row spread over
    many ranges too. Rows equal in ``order`` are numbered by their remaining columns. The
    sorted rows are checkpointed: both passes see one layout, also after executors are lost.
    """
    columns = df.columns
    rest = [c for c in columns if c not in order]
    pid, copies, copy, rid = (f"__{name}_{x}" for x in ("pid", "n", "copy", "rid"))
    counted = df.withColumn(pid, F.spark_partition_id()).groupBy(*columns, pid)
    copied = counted.agg(F.count(F.lit(1)).alias(copies)).withColumn(
        copy, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(copies) - 1))
    )
    ordered = [*order, *rest, pid, copy]
    placed = copied.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    placed = cut(placed.select(*columns, F.monotonically_increasing_id().alias(rid)))
    part = F.shiftright(rid, 33)
    sizes = placed.groupBy(part.alias(pid)).agg(F.count(F.lit(1)).alias(copies))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the sort, so both the window and the broadcast are small.
    starts = sizes.select(pid, F.coalesce(F.sum(copies).over(before), F.lit(0)).alias(copy))
    total = placed.count()
    numbered = placed.join(F.broadcast(starts), part == starts[pid])
    inside = F.col(rid).bitwiseAND((1 << 33) - 1)
    return numbered.select(*columns, (F.col(copy) + inside).alias(name)), total


def components(edges: DataFrame, limit: int = 60, rows: int | None = None) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b): the smallest vertex it is connected with.

    Alternating large-star and small-star steps over grouped minima; a vertex of many edges is
    pre-aggregated in the grouping, and its rows of the join back are split by adaptive execution.
    With ``rows``, a step over few edges is spread over no more partitions than hold so many each, whatever
    the session's number: the edges are counted, and their number never grows.
    """
    current = cut(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    if rows:
        parts = -(-current.count() // rows) or 1
        current = current.coalesce(parts)
    seen = None
    for _ in range(limit):
        if rows:
            ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
            both = current.select(F.inline(ends))
        else:
            both = current.union(current.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a")
            .filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(lowest, "a")
        current = (
            stars.filter(F.col("b") != F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lowest.select("a", F.col("m").alias("b")))
            .distinct()
        )
        current = cut(current.coalesce(parts) if rows else current)
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))
        ).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("v"), F.col("b").alias("root")).union(
        roots.select(F.col("b").alias("v"), F.col("b").alias("root"))
    )


def label_roots(nodes: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node each is connected with."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def runs(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Groups of equal keys out of rows sorted by them; a group may span batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        changes = np.zeros(len(batch), dtype=bool)
        for key in keys:
            values = batch[key].to_numpy()
            changes[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(changes).tolist(), len(batch)]
        for i, (start, end) in enumerate(zip(cuts, cuts[1:])):
            piece = batch.iloc[start:end]
            if i == 0 and held and any(held[-1][k].iloc[-1] != piece[k].iloc[0] for k in keys):
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            elif i > 0:
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(piece)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


#: How a worker drops what the tasks of a module keep for each other, by module.
_KEPT: dict[str, Callable[[], bool]] = {}


def keeps(module: str, drop: Callable[[], bool]) -> None:
    """``drop`` drops what tasks of ``module`` leave in a worker for the next ones, and says whether there was any."""
    _KEPT[module] = drop


def let_go(owner: str | None = None) -> None:
    """Drops what tasks of modules other than ``owner`` have left in this worker: workers serve one stage after the
    other, and the memory of an earlier one would stand beside that of the task that begins."""
    dropped = [drop() for module, drop in _KEPT.items() if module != owner]
    if any(dropped):
        release()


def release() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only GNU's library has it
        pass


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that drops what other operators have left in its worker, and gives freed memory back to the
    system when its rows are done. Python workers are kept for later tasks, and idle ones would hold their peak."""
    owner = task.__module__

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        let_go(owner)
        yield from task(batches)
        release()

    return run
