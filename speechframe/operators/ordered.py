"""Ordered work per key that survives a hot key.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here keys of more than
``hot_rows`` rows are found first (:func:`measure`, one aggregate job). Without any, the plan is
the plain one. Otherwise a hot key is cut into slices along its order, every slice is scanned on
its own, and the slices are stitched with small per-slice summaries:

* :func:`with_slices`  marks the slices (ordinary keys keep the single slice 0);
* :func:`prefix_scan`  running sum / max / count / last value over the whole key;
* :func:`fold_states`  a sequential state machine over the whole key.

What is broadcast has a bound that depends neither on skew nor on size: the limit is at least
``rows / MOST_HOT``, so at most ``MOST_HOT`` hot keys exist, and together they have at most
``OVERSPLIT * MOST_HOT + hot keys`` slices.
On the sliced path inputs that are read twice are checkpointed, so a chain of scans stays linear.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SessionLimit(int):
    """A row limit that a session's setting may replace; plain numbers are taken as they are."""


HOT_ROWS = SessionLimit(1_000_000)
HOT_ROWS_SETTING = "spark.speechframe.hotRows"
MOST_HOT = 10_000
OVERSPLIT = 8
CELLS = 64
FOREVER = (1 << 63) - 1
NEVER = -(1 << 63)

_SLICE, _HOT = "_slice", "_hot"


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Join condition matching NULL keys with NULL keys."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def checkpoint_path(spark: SparkSession) -> str:
    """The checkpoint folder, which the cluster names; only a session on one machine without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder of :func:`checkpoint_path`."""
    checkpoint_path(df.sparkSession)
    return df.checkpoint()


@dataclass(frozen=True)
class Hot:
    """Hot keys of a table: ``stats`` is None if there are none. ``width`` is the number of key
    columns they were found by; a scan by further keys is sliced by the same ones."""

    stats: DataFrame | None
    width: int = 0


NO_HOT = Hot(None)


def measure(
    df: DataFrame, keys: Sequence[str], pos: str, hot_rows: int | None | Hot = HOT_ROWS
) -> Hot:
    """Find keys of more than ``hot_rows`` rows, with quantiles of the numeric column ``pos``.

    The default limit can be changed for a session by the setting ``spark.speechframe.hotRows``.
    Either is raised to a ``MOST_HOT``-th of all rows, so that the hot keys stay few at any size.
    ``None`` is for keys whose size is bounded by construction (one chunk, one text). An earlier
    result is passed through: it stays useful for tables derived from ``df`` with about as many
    rows per key and positions in the same range (and right for any)."""
    if isinstance(hot_rows, Hot):
        return hot_rows
    if hot_rows is None:
        return NO_HOT
    if isinstance(hot_rows, SessionLimit):
        hot_rows = int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))
    names = [f"_h{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(pos).cast("double").alias("_pos")
    )
    counts = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_hn"))
    most, total = counts.agg(F.max("_hn"), F.sum("_hn")).first()
    hot_rows = max(hot_rows, (total or 0) // MOST_HOT)
    if (most or 0) <= hot_rows:
        return NO_HOT
    found = counts.where(F.col("_hn") > hot_rows).select(*[F.col(n).alias(f"{n}k") for n in names])
    pairs = [(n, f"{n}k") for n in names]
    of_hot = rows.join(F.broadcast(found), null_safe(rows, found, pairs), "left_semi")
    points = [i / CELLS for i in range(CELLS + 1)]
    parts = F.ceil(F.col("_hn") / F.lit(float(hot_rows))) * OVERSPLIT
    stats = (
        of_hot.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("_hn"), F.percentile_approx("_pos", points).alias("_points"))
        .withColumn("_cells", F.least(F.lit(CELLS), parts).cast("int"))
        .withColumn("_sub", F.ceil(parts / F.col("_cells")).cast("long"))
        .withColumn(
            "_edges",
            F.transform(
                F.sequence(F.lit(0), F.col("_cells")),
                lambda i: F.element_at(
                    "_points", (F.floor(i * CELLS / F.col("_cells")) + 1).cast("int")
                ),
            ),
        )
        .drop("_points")
    )
    return Hot(cut_lineage(stats), len(keys))


def with_slices(df: DataFrame, keys: Sequence[str], pos: str, hot: Hot) -> DataFrame:
    """Add ``_slice`` and ``_hot``. A hot key is cut at quantiles of ``pos`` into cells of about
    equal rows, and a cell into equal ranges. The edges are kept with the hot keys, so a retried
    task sees the same slices."""
    if hot.stats is None:
        return df.withColumn(_HOT, F.lit(False)).withColumn(_SLICE, F.lit(0).cast("long"))
    stats = hot.stats
    pairs = [(k, f"_h{i}") for i, k in enumerate(keys[: hot.width])]
    at = F.col(pos).cast("double")
    inner = F.slice("_edges", F.lit(2), F.col("_cells") - 1)
    low, high = (F.element_at("_edges", F.col("_cell") + n) for n in (1, 2))
    share = (at - low) / F.nullif(high - low, F.lit(0.0))
    place = F.least(F.col("_sub") - 1, F.greatest(F.lit(0), F.floor(share * F.col("_sub"))))
    ordinal = F.col("_cell") * F.col("_sub") + F.coalesce(place, F.lit(0))
    return (
        df.join(F.broadcast(stats), null_safe(df, stats, pairs), "left")
        .withColumn(_HOT, F.col("_hn").isNotNull())
        .withColumn("_cell", F.when(F.col(_HOT), F.size(F.filter(inner, lambda e: e <= at))))
        .withColumn(_SLICE, F.coalesce(ordinal, F.lit(0)).cast("long"))
        .drop(*[f"_h{i}" for i in range(hot.width)], "_hn", "_cells", "_sub", "_edges", "_cell")
    )


def without_slices(df: DataFrame) -> DataFrame:
    return df.drop(_SLICE, _HOT)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: dict[str, tuple[str, Column, bool]],
    *,
    reverse: bool = False,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Running aggregates over each key in ``order``.

    ``scans`` maps an output name to ``(kind, expression, inclusive)`` with kind ``sum``,
    ``count``, ``max`` or ``last`` (the last non-NULL value; wrap a value in a struct when its
    own NULLs count). ``reverse=True`` scans from the end, which turns ``last`` into "next".
    ``order`` must identify a row within its key, and ``order[0]`` must be numeric.
    Slice columns made by an earlier call are reused; they stay in the result.
    """
    hot = measure(df, keys, order[0], hot_rows)
    prepared = {_SLICE, _HOT} <= set(df.columns)
    sliced = df if prepared or hot.stats is None else with_slices(df, keys, order[0], hot)
    inputs = {f"_in_{name}": expr for name, (_, expr, _inclusive) in scans.items()}
    local = sliced.withColumns(inputs)
    if hot.stats is not None:
        local = sliced = cut_lineage(local)
    group = [*keys] if hot.stats is None else [*keys, _SLICE]
    directed = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    window = Window.partitionBy(*group).orderBy(*directed)
    running = {}
    for name, (kind, _, inclusive) in scans.items():
        frame = window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        running[f"_lo_{name}"] = _running(kind, F.col(f"_in_{name}")).over(frame)
    local = local.withColumns(running)
    temporary = [*inputs, *running]
    if hot.stats is None:
        found = {
            name: _combine(kind, None, F.col(f"_lo_{name}"))
            for name, (kind, _, _inclusive) in scans.items()
        }
        return local.withColumns(found).drop(*temporary)
    carry = _carry(sliced, keys, order, scans, reverse)
    pairs = [*((k, f"_c{i}") for i, k in enumerate(keys)), (_SLICE, "_cslice")]
    found = {
        name: _combine(kind, F.col(f"_carry_{name}"), F.col(f"_lo_{name}"))
        for name, (kind, _, _inclusive) in scans.items()
    }
    return (
        local.join(F.broadcast(carry), null_safe(local, carry, pairs), "left")
        .withColumns(found)
        .drop(*[f"_c{i}" for i in range(len(keys))], "_cslice", *temporary,
              *[f"_carry_{name}" for name in scans])
    )


def _running(kind: str, value: Column) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "count":
        return F.count(value)
    if kind == "max":
        return F.max(value)
    if kind == "last":
        return F.last(value, ignorenulls=True)
    raise ValueError(f"unknown scan kind {kind!r}")


def _combine(kind: str, carry: Column | None, local: Column) -> Column:
    if kind in ("sum", "count"):
        own = F.coalesce(local, F.lit(0))
        return own if carry is None else F.coalesce(carry, F.lit(0)) + own
    if carry is None:
        return local
    return F.greatest(carry, local) if kind == "max" else F.coalesce(local, carry)


def _carry(
    sliced: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: dict[str, tuple[str, Column, bool]],
    reverse: bool,
) -> DataFrame:
    """What each slice of a hot key inherits from the slices before it."""
    at = F.struct(*order)
    aggregates = []
    for name, (kind, _, _inclusive) in scans.items():
        value = F.col(f"_in_{name}")
        if kind == "last":
            pick = (F.min_by if reverse else F.max_by)(value, F.when(value.isNotNull(), at))
        else:
            pick = _running(kind, value)
        aggregates.append(pick.alias(f"_sum_{name}"))
    summary = (
        sliced.where(F.col(_HOT))
        .groupBy(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)],
                 F.col(_SLICE).alias("_cslice"))
        .agg(*aggregates)
    )
    slice_order = F.col("_cslice").desc() if reverse else F.col("_cslice").asc()
    before = (
        Window.partitionBy(*[f"_c{i}" for i in range(len(keys))])
        .orderBy(slice_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    total = {"sum": "sum", "count": "sum", "max": "max", "last": "last"}
    return summary.select(
        *[f"_c{i}" for i in range(len(keys))],
        "_cslice",
        *[
            _running(total[kind], F.col(f"_sum_{name}")).over(before).alias(f"_carry_{name}")
            for name, (kind, _, _inclusive) in scans.items()
        ],
    )


class Machine:
    """A state machine over one key's rows in order.

    A state is ``(tag, wake)`` with ``tag`` in ``range(tags)``. A row at position ``wake`` or
    later (or with its ``force`` flag set) is *due* for the state, an earlier one is *early*.
    Both return the next state, or None to leave it. An early row may only change the state in a
    way that does not depend on ``wake``. Per tag, later rows never set an earlier wake. Tags that
    never sleep use wake ``NEVER`` and are listed in ``sleepless``.

    A finite tag plus one threshold is what lets a slice be described without knowing the state
    it starts in.
    """

    tags = 1
    sleepless: frozenset[int] = frozenset()
    initial: tuple[int, int] = (0, NEVER)

    def due(self, tag: int, row: dict) -> tuple[int, int] | None:
        raise NotImplementedError

    def early(self, tag: int, row: dict) -> tuple[int, int] | None:
        return None

    def next(self, state: tuple[int, int], row: dict, at: int, forced: bool):
        tag, wake = state
        return self.due(tag, row) if forced or at >= wake else self.early(tag, row)


_STATE_FIELDS = [
    T.StructField("before_tag", T.IntegerType()),
    T.StructField("before_wake", T.LongType()),
    T.StructField("after_tag", T.IntegerType()),
    T.StructField("after_wake", T.LongType()),
    T.StructField("acted", T.BooleanType()),
]
_TRANSITION = T.ArrayType(
    T.StructType(
        [
            T.StructField("tag", T.IntegerType()),
            T.StructField("upto", T.LongType()),
            T.StructField("exit_tag", T.IntegerType()),
            T.StructField("exit_wake", T.LongType()),
        ]
    )
)


def fold_states(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    machine: Machine,
    *,
    pos: str,
    force: str | None = None,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Run ``machine`` over every key; adds the state before and after each row and ``acted``
    (whether the row set the state).

    Rows stream through sorted partitions, so a task holds one Arrow batch. Slices of hot keys
    are first reduced to transition tables in parallel, which fixes the state each one starts in.
    """
    hot = measure(df, keys, order[0], hot_rows)
    init_tag, init_wake = machine.initial
    if hot.stats is None:
        group = [*keys]
        placed = df.withColumn("_tag", F.lit(init_tag)).withColumn("_wake", F.lit(init_wake))
    else:
        group = [*keys, _SLICE]
        sliced = cut_lineage(with_slices(df, keys, order[0], hot))
        entries = _slice_entries(sliced, keys, order, machine, pos, force)
        pairs = [*((k, f"_c{i}") for i, k in enumerate(keys)), (_SLICE, "_cslice")]
        placed = (
            sliced.join(F.broadcast(entries), null_safe(sliced, entries, pairs), "left")
            .withColumn("_tag", F.coalesce("_entry_tag", F.lit(init_tag)))
            .withColumn("_wake", F.coalesce("_entry_wake", F.lit(init_wake)))
            .drop("_entry_tag", "_entry_wake", "_cslice", *[f"_c{i}" for i in range(len(keys))])
        )
    schema = T.StructType([*df.schema.fields, *_STATE_FIELDS])
    names = list(df.columns)
    run = _runner(machine, group, names, pos, force, schema)
    return _sorted_groups(placed, group, order).mapInArrow(run, schema)


def _sorted_groups(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.repartition(*group).sortWithinPartitions(*group, *order)


def rows_of(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[dict]:
    """Rows of Arrow batches as dicts of the named columns only."""
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in columns]
        for row in zip(*values):
            yield dict(zip(columns, row))


def _runner(machine, group, names, pos, force, schema):
    used = sorted({*names, *group})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, machine.initial
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in (*used, "_tag", "_wake")}
            states: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                here = tuple(columns[c][i] for c in group)
                if here != key:
                    key, state = here, (columns["_tag"][i], columns["_wake"][i])
                row = {c: columns[c][i] for c in used}
                before = state
                forced = force is not None and bool(row[force])
                moved = machine.next(state, row, row[pos], forced)
                acted = moved is not None
                state = moved if acted else state
                for out, value in zip(states, (*before, *state, acted)):
                    out.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    *[
                        pa.array(values, type=kind)
                        for values, kind in zip(
                            states, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
                        )
                    ],
                ],
                names=[f.name for f in schema.fields],
            )

    return run


def _slice_entries(sliced, keys, order, machine, pos, force) -> DataFrame:
    """The state each slice of a hot key starts in."""
    group = [*keys, _SLICE]
    hot = sliced.where(F.col(_HOT))
    key_fields = [
        T.StructField(f"_c{i}", sliced.schema[k].dataType) for i, k in enumerate(keys)
    ]
    slice_field = T.StructField("_cslice", T.LongType())
    table_schema = T.StructType(
        [*key_fields, slice_field, T.StructField("_table", _TRANSITION)]
    )
    columns = list(dict.fromkeys([*group, *sliced.columns]))

    def transitions(batches):
        # A group has the slice besides a key, so the getter gives tuples.
        for key, rows in groupby(rows_of(batches, columns), itemgetter(*group)):
            yield _table_batch(key, transition_table(machine, rows, pos, force), table_schema)

    tables = _sorted_groups(hot, group, order).mapInArrow(transitions, table_schema)
    entry_schema = T.StructType(
        [
            *key_fields,
            slice_field,
            T.StructField("_entry_tag", T.IntegerType()),
            T.StructField("_entry_wake", T.LongType()),
        ]
    )
    key_names = [f.name for f in key_fields]

    def chain(batches):
        key, state = None, machine.initial
        for batch in batches:
            values = {c: batch.column(c).to_pylist() for c in (*key_names, "_cslice", "_table")}
            tags, wakes = [], []
            for i in range(batch.num_rows):
                here = tuple(values[c][i] for c in key_names)
                if here != key:
                    key, state = here, machine.initial
                tags.append(state[0])
                wakes.append(state[1])
                state = apply_table(values["_table"][i], state)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in (*key_names, "_cslice")],
                    pa.array(tags, type=pa.int32()),
                    pa.array(wakes, type=pa.int64()),
                ],
                names=[f.name for f in entry_schema.fields],
            )

    return (
        tables.repartition(*key_names)
        .sortWithinPartitions(*key_names, "_cslice")
        .mapInArrow(chain, entry_schema)
    )


def _table_batch(key, table, schema) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    values = [*key, [dict(zip(("tag", "upto", "exit_tag", "exit_wake"), t)) for t in table]]
    return pa.RecordBatch.from_arrays(
        [pa.array([v], type=f.type) for v, f in zip(values, arrow)], schema=arrow
    )


def transition_table(machine: Machine, rows: Iterable[dict], pos: str, force: str | None):
    """Where each possible starting state of a slice ends up: a list of
    ``(tag, upto, exit_tag, exit_wake)``. Per tag an entry covers wakes in ``(previous upto, upto]``;
    wakes beyond the last entry leave the slice unchanged.

    All starting states run side by side and are joined as soon as they meet, so the work grows
    with rows and tags. A starting wake is only known by the first row that is due for it: such
    states split off from the tag's open rest row by row.
    """
    queues: dict[int, deque] = {tag: deque() for tag in range(machine.tags)}
    starts: list[tuple[int, int]] = []  # (tag, upto) of each class of starting states
    resting: set[int] = set()
    for tag in range(machine.tags):
        if tag in machine.sleepless:
            queues[tag].append((NEVER, [len(starts)]))
            starts.append((tag, FOREVER))
        else:
            resting.add(tag)
    for row in rows:
        at = row[pos]
        forced = force is not None and bool(row[force])
        arrived: dict[tuple[int, int], list[int]] = {}

        def settle(state, members, arrived=arrived):
            present = arrived.get(state)
            if present is None:
                arrived[state] = members
            elif len(present) < len(members):
                members.extend(present)
                arrived[state] = members
            else:
                present.extend(members)

        for tag, queue in queues.items():
            late = machine.due(tag, row)
            ahead = late if forced else machine.early(tag, row)
            ready: list[int] = []
            while queue and (forced or queue[0][0] <= at):
                members = queue.popleft()[1]
                if len(members) > len(ready):
                    ready, members = members, ready
                ready.extend(members)
            if tag in resting:
                ready.append(len(starts))
                starts.append((tag, FOREVER if forced else at))
            if ready:
                settle(late or (tag, NEVER), ready)
            if ahead is not None and not forced:
                for _, members in queue:
                    settle(ahead, members)
                queue.clear()
                if tag in resting:
                    settle(ahead, [len(starts)])
                    starts.append((tag, FOREVER))
            if forced or ahead is not None:
                resting.discard(tag)
        for (tag, wake), members in arrived.items():
            if wake == NEVER:
                queues[tag].appendleft((wake, members))
            else:
                queues[tag].append((wake, members))
    exits: dict[int, tuple[int, int]] = {}
    for tag, queue in queues.items():
        for wake, members in queue:
            exits.update(dict.fromkeys(members, (tag, wake)))
    table: list[tuple[int, int, int, int]] = []
    last: dict[int, int] = {}
    for index, (tag, upto) in enumerate(starts):
        previous = last.get(tag)
        if previous is not None and table[previous][2:] == exits[index]:
            table[previous] = (tag, upto, *exits[index])
        else:
            last[tag] = len(table)
            table.append((tag, upto, *exits[index]))
    return table


def apply_table(table, state: tuple[int, int]) -> tuple[int, int]:
    tag, wake = state
    for entry in table:
        if entry["tag"] == tag and wake <= entry["upto"]:
            return entry["exit_tag"], entry["exit_wake"]
    return state
