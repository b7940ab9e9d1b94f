"""Chunk plans: greedy packing of regions, forced cuts, numbering, resume."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechframe.operators.ordered import (
    HOT_ROWS,
    Hot,
    Machine,
    cut_lineage,
    fold_states,
    measure,
    null_safe,
    prefix_scan,
)
from speechframe.schema import SAMPLE_RATE

MAX_CHUNK = 30 * SAMPLE_RATE
CUT_WINDOW = 5 * SAMPLE_RATE
CUT_FRAME = SAMPLE_RATE // 10
MAX_GAP = 2 * SAMPLE_RATE


class _Packing(Machine):
    """A piece that ends beyond the open chunk's limit opens the next one."""

    def __init__(self, max_chunk: int):
        self.max_chunk = max_chunk

    def due(self, tag, row):
        return 0, row["start"] + self.max_chunk + 1


def pack_chunks(
    regions: DataFrame,
    keys: Sequence[str] = ("recording_id", "channel"),
    *,
    max_chunk: int = MAX_CHUNK,
    max_gap: int = MAX_GAP,
    pieces: DataFrame | None = None,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Pack sorted, disjoint regions into chunks ``(keys, start, end, forced_cut)``.

    A region joins the open chunk while the chunk stays within ``max_chunk`` and the silence
    before it is at most ``max_gap`` (both inclusive). Regions longer than ``max_chunk`` start
    their own chunks: at the cuts in ``pieces`` (see :func:`split_long_regions`), or whole.
    """
    long = F.col("end") - F.col("start") > max_chunk
    if pieces is None:
        parts = regions.select(
            *keys, "start", "end", F.lit(False).alias("forced_cut"), long.alias("_own")
        )
    else:
        parts = (
            regions.where(~long)
            .select(*keys, "start", "end", F.lit(False).alias("forced_cut"),
                    F.lit(False).alias("_own"))
            .unionByName(
                pieces.select(*keys, "start", "end", "forced_cut", F.lit(True).alias("_own"))
            )
        )
    hot = measure(parts, keys, "start", hot_rows)
    linked = prefix_scan(
        parts, keys, ["start"], {"_prev_end": ("last", F.col("end"), False)}, hot_rows=hot
    ).drop("_slice", "_hot")
    gap = F.col("start") - F.col("_prev_end") > max_gap
    broken = linked.withColumn("_break", F.col("_own") | F.coalesce(gap, F.lit(True)))
    states = fold_states(
        broken, keys, ["start"], _Packing(max_chunk), pos="end", force="_break", hot_rows=hot
    )
    return (
        states.withColumn("_open", F.col("after_wake") - (max_chunk + 1))
        .groupBy(*keys, "_open")
        .agg(F.max("end").alias("end"), F.max_by("forced_cut", "end").alias("forced_cut"))
        .select(*keys, F.col("_open").alias("start"), "end", "forced_cut")
    )


def number_chunks(
    chunks: DataFrame, recording: str = "recording_id", *, hot_rows: int | None | Hot = HOT_ROWS
) -> DataFrame:
    """Recording-wide ``index``: channel by channel (no channel first), then by start."""
    hot = measure(chunks, [recording], "start", hot_rows)
    if hot.stats is None:
        ranked = chunks.withColumn("_ch", F.coalesce("channel", F.lit(-1)))
        nth = {"_nth": ("count", F.col("start"), False)}
        found = prefix_scan(ranked, [recording], ["_ch", "start"], nth, hot_rows=hot)
        return found.withColumn("index", F.col("_nth").cast("int")).drop("_ch", "_nth")
    keys = [recording, "channel"]
    chunks = cut_lineage(chunks)
    within = prefix_scan(
        chunks, keys, ["start"], {"_nth": ("count", F.col("start"), False)}, hot_rows=hot
    ).drop("_slice", "_hot")
    earlier = (
        Window.partitionBy(recording)
        .orderBy(F.col("channel").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        chunks.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.col(recording).alias("_r"),
            F.col("channel").alias("_ch"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        )
    )
    return (
        within.join(offsets, null_safe(within, offsets, [(recording, "_r"), ("channel", "_ch")]))
        .withColumn("index", (F.col("_offset") + F.col("_nth")).cast("int"))
        .drop("_r", "_ch", "_offset", "_nth")
    )


def blocks_of(df: DataFrame, block_samples: int) -> DataFrame:
    """One row per audio block that ``[start, end)`` touches, with ``block_idx``."""
    first = F.floor(F.col("start") / block_samples).cast("int")
    last = F.floor((F.col("end") - 1) / block_samples).cast("int")
    return df.where(F.col("end") > F.col("start")).withColumn(
        "block_idx", F.explode(F.sequence(first, last))
    )


def _with_audio(spans: DataFrame, blocks: DataFrame, block_samples: int) -> DataFrame:
    wanted = blocks_of(spans, block_samples)
    audio = blocks.select(
        F.col("recording_id").alias("_br"),
        F.col("channel").alias("_bc"),
        F.col("block_idx").alias("_bi"),
        "start_sample",
        "samples",
    )
    pairs = [("recording_id", "_br"), ("channel", "_bc"), ("block_idx", "_bi")]
    return wanted.join(audio, null_safe(wanted, audio, pairs)).drop("_br", "_bc", "_bi")


def slice_audio(chunks: DataFrame, blocks: DataFrame, *, block_samples: int) -> DataFrame:
    """Samples of each chunk, as ``samples array<smallint>``; a chunk is at most one window."""
    keys = ["recording_id", "channel", "index", "start", "end"]
    joined = _with_audio(chunks.select(*keys), blocks, block_samples)
    low = F.greatest(F.col("start"), F.col("start_sample")) - F.col("start_sample")
    high = F.least(
        F.col("end") - F.col("start_sample"), F.size("samples").cast("bigint")
    )
    part = F.slice("samples", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    return (
        joined.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("block_idx", part.alias("s")))).alias("_parts"))
        .select(*keys, F.flatten(F.transform("_parts", lambda p: p["s"])).alias("samples"))
    )


def split_long_regions(
    regions: DataFrame,
    blocks: DataFrame,
    *,
    block_samples: int,
    max_chunk: int = MAX_CHUNK,
    cut_window: int = CUT_WINDOW,
    cut_frame: int = CUT_FRAME,
) -> DataFrame:
    """Pieces of regions longer than ``max_chunk``, cut at the quietest frame of the last
    ``cut_window`` samples of each window.

    Every cut lies on a grid of ``gcd(frame, frame // 2, max_chunk - window)`` samples from the
    region's start, so audio is reduced to exact energies per grid cell in parallel over blocks;
    only those (a few MB for the longest accepted recording) meet per region.
    """
    check_cut(max_chunk, cut_window, cut_frame)
    cell = math.gcd(cut_frame, cut_frame // 2, max_chunk - cut_window)
    long = regions.where(F.col("end") - F.col("start") > max_chunk).select(
        "recording_id", "channel", "start", "end"
    )
    energies = _cell_energies(_with_audio(long, blocks, block_samples), cell)
    keys = ["recording_id", "channel", "start", "end"]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def cuts(first: pd.Series, last: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series(
            [
                _chain_cuts(int(b - a), p, cell, max_chunk, cut_window, cut_frame)
                for a, b, p in zip(first, last, parts)
            ]
        )

    bounds = (
        energies.groupBy(*keys)
        .agg(F.collect_list(F.struct("first_cell", "energy")).alias("_parts"))
        .withColumn("_cuts", cuts("start", "end", "_parts"))
        .withColumn(
            "_edges",
            F.concat(
                F.array(F.col("start")),
                F.transform("_cuts", lambda c: c + F.col("start")),
                F.array(F.col("end")),
            ),
        )
    )
    return bounds.select(
        "recording_id", "channel", F.posexplode(F.expr("slice(_edges, 1, size(_edges) - 1)"))
        .alias("_i", "_from"), "_edges",
    ).select(
        "recording_id",
        "channel",
        F.col("_from").alias("start"),
        F.element_at("_edges", F.col("_i") + 2).alias("end"),
        (F.col("_i") < F.size("_edges") - 2).alias("forced_cut"),
    )


def plan_recordings(
    regions: DataFrame,
    blocks: DataFrame,
    *,
    block_samples: int,
    max_chunk: int = MAX_CHUNK,
    max_gap: int = MAX_GAP,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Numbered chunk plan of detected regions. Regions and the plan are small next to the audio
    and read several times, so they are kept; the audio is only touched for long regions."""
    regions = cut_lineage(regions)
    nonstop = regions.where(F.col("end") - F.col("start") > max_chunk)
    pieces = None
    if not nonstop.isEmpty():
        pieces = split_long_regions(
            nonstop, blocks, block_samples=block_samples, max_chunk=max_chunk
        )
    packed = pack_chunks(
        regions, max_chunk=max_chunk, max_gap=max_gap, pieces=pieces, hot_rows=hot_rows
    )
    return cut_lineage(number_chunks(packed, hot_rows=hot_rows))


def check_cut(max_chunk: int, cut_window: int, cut_frame: int) -> None:
    if not 0 < cut_window < max_chunk:
        raise ValueError("the cut window must be positive and shorter than a chunk")
    if cut_frame <= 0 or cut_window % cut_frame:
        raise ValueError("the cut window must be a multiple of the frame")


def _cell_energies(joined: DataFrame, cell: int) -> DataFrame:
    keys = ["recording_id", "channel", "start", "end"]
    schema = T.StructType(
        [
            *[joined.schema[k] for k in keys],
            T.StructField("first_cell", T.LongType()),
            T.StructField("energy", T.ArrayType(T.LongType())),
        ]
    )

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = batch.column("start").to_numpy(), batch.column("end").to_numpy()
            origins = batch.column("start_sample").to_numpy()
            audio = batch.column("samples")
            first_cells, energies = [], []
            for i in range(batch.num_rows):
                samples = np.asarray(audio[i].values, dtype=np.int64)
                low = max(int(starts[i]), int(origins[i]))
                high = min(int(ends[i]), int(origins[i]) + len(samples))
                square = np.square(samples[low - origins[i] : high - origins[i]])
                offset = low - int(starts[i])
                first = offset // cell
                edges = np.arange(first, (high - 1 - int(starts[i])) // cell + 1) * cell - offset
                edges[0] = 0
                first_cells.append(first)
                energies.append(np.add.reduceat(square, edges))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in keys],
                    pa.array(first_cells, type=pa.int64()),
                    pa.array(energies, type=pa.list_(pa.int64())),
                ],
                names=[f.name for f in schema.fields],
            )

    return joined.select(*keys, "start_sample", "samples").mapInArrow(reduce, schema)


def _chain_cuts(length, parts, cell, max_chunk, window, frame) -> list[int]:
    energy = np.zeros(-(-length // cell) + 1, dtype=np.int64)
    for part in parts:
        first, values = part["first_cell"], np.asarray(part["energy"], dtype=np.int64)
        energy[first + 1 : first + 1 + len(values)] += values
    total = np.cumsum(energy)
    cuts, start = [], 0
    while length - start > max_chunk:
        frames = start + max_chunk - window + np.arange(0, window + 1, frame)
        quietest = int(np.argmin(np.diff(total[frames // cell])))
        start = int(frames[quietest]) + frame // 2
        cuts.append(start)
    return cuts


def plan_stats(
    chunks: DataFrame, keys: Sequence[str] = ("recording_id",)
) -> DataFrame:
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(F.col("end") - F.col("start")).alias("transcribed_samples"),
        F.count_if("forced_cut").alias("forced_cuts"),
    )


def fixed_windows(recordings: DataFrame, length: str, window: int) -> DataFrame:
    """Windows of ``window`` samples over each recording; the last one may be short."""
    starts = F.sequence(
        F.lit(0).cast("bigint"), F.col(length) - 1, F.lit(window).cast("bigint")
    )
    return (
        recordings.where(F.col(length) > 0)
        .withColumn("start", F.explode(starts))
        .withColumn("end", F.least(F.col("start") + window, F.col(length)))
    )


def pending_chunks(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned chunks without a finished result."""
    return plan.join(done.select(*keys), list(keys), "left_anti")


def reusable_results(
    results: DataFrame, plan: DataFrame, keys: Sequence[str], exact: Sequence[str]
) -> DataFrame:
    """Results whose planned chunk is still the same one (``exact`` compared null-safely)."""
    chunk = plan.select(*[F.col(c).alias(f"_p_{c}") for c in (*keys, *exact)])
    pairs = [(c, f"_p_{c}") for c in (*keys, *exact)]
    return results.join(chunk, null_safe(results, chunk, pairs), "left_semi")


def reusable_plans(stored: DataFrame, decoded: DataFrame, key: str = "recording_id") -> DataFrame:
    """Stored plans that describe this exact decode: same sample count and channel list."""
    facts = decoded.select(
        key, F.col("audio_samples").alias("_n"), F.col("channels").alias("_chs")
    )
    return (
        stored.join(facts, key)
        .where((F.col("audio_samples") == F.col("_n")) & (F.col("channels") == F.col("_chs")))
        .drop("_n", "_chs")
    )


def quietest_frame(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First frame of least energy per key, from rows ``(keys, frame_idx, frame_start, energy)``."""
    return frames.groupBy(*keys).agg(
        F.min_by(F.struct("frame_idx", "frame_start", "energy"), F.struct("energy", "frame_idx"))
        .alias("_f")
    ).select(*keys, "_f.*")


def frame_energy(samples: Column) -> Column:
    """Exact sum of squares of int16 samples."""
    return F.aggregate(
        samples, F.lit(0).cast("bigint"), lambda total, x: total + x.cast("bigint") * x
    )


def covering_chunks(
    regions: DataFrame,
    chunks: DataFrame,
    keys: Sequence[str],
    *,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """For each region the chunk that starts last at or before it, and whether that chunk
    ``covered`` it whole: the check that a plan loses no speech. One ordered scan, no range join."""
    marks = chunks.select(
        *keys, "start", F.lit(0).alias("_kind"), F.struct("start", "end").alias("_chunk")
    )
    rows = regions.select(*keys, "start", "end", F.lit(1).alias("_kind"))
    scanned = prefix_scan(
        rows.unionByName(marks, allowMissingColumns=True), keys, ["start", "_kind"],
        {"_in": ("last", F.col("_chunk"), False)}, hot_rows=hot_rows,
    ).where(F.col("_kind") == 1)
    return scanned.select(
        *keys,
        "start",
        "end",
        F.col("_in.start").alias("chunk_start"),
        F.coalesce(F.col("_in.end") >= F.col("end"), F.lit(False)).alias("covered"),
    )


def plan_violations(
    chunks: DataFrame,
    keys: Sequence[str] = ("recording_id", "channel"),
    *,
    max_chunk: int = MAX_CHUNK,
    max_gap: int = MAX_GAP,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Chunks of a plan that break a rule: ``empty``, ``too_long``, ``overlap`` with the next one,
    or ``mergeable`` with it (a greedy plan leaves no such neighbours, forced cuts aside)."""
    following = prefix_scan(
        chunks,
        keys,
        ["start"],
        {"_next": ("last", F.struct("start", "end"), False)},
        reverse=True,
        hot_rows=hot_rows,
    )
    mergeable = (
        ~F.col("forced_cut")
        & (F.col("_next.end") - F.col("start") <= max_chunk)
        & (F.col("_next.start") - F.col("end") <= max_gap)
    )
    rule = (
        F.when(F.col("end") <= F.col("start"), "empty")
        .when(F.col("end") - F.col("start") > max_chunk, "too_long")
        .when(F.col("_next.start") < F.col("end"), "overlap")
        .when(mergeable, "mergeable")
    )
    broken = following.withColumn("rule", rule).where(F.col("rule").isNotNull())
    return broken.drop("_next", "_slice", "_hot")
