"""Speech, chunk plans and recogniser input with one pass over the audio.

A task gets rows that name byte ranges, never samples: it seeks to its range of a file, decodes it, and gives
back what the rest of the work needs of it, which is the runs of active frames and the energies of a
grid of cells. Regions, forced cuts and the plan come from these alone. The recogniser's tasks read
the ranges of their own chunks. So each sample is decoded once to find speech and once if it is
recognised, and no shuffle carries audio.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from speechframe.operators import chunks as plans
from speechframe.operators.audio import (
    BLOCK_SAMPLES, Scorer, block_rows, by_place, column_batch, decoding, energy_scorer, read_frames,
    sample_place,
)
from speechframe.operators.ordered import HOT_ROWS, Hot, cut_lineage, null_safe
from speechframe.operators.regions import close_gaps
from speechframe.schema import SAMPLE_RATE

#: Frames ``[first, first + count)`` of a file at 16 kHz as float64 on the int16 scale, shape (count, channels).
#: The row has the columns of ``pcm_layouts``, so a decoder for another container can take its place.
Decoder = Callable[[dict, int, int], np.ndarray]

FRAME = SAMPLE_RATE // 50
PAD_MS = 200
SILENCE_MS = 500
#: Cells and runs that a task gives back at a time, or little more.
BATCH_CELLS = 1 << 17

SCAN = (
    "recording_id string, channel int, block_idx int, start_sample bigint, samples bigint, "
    "runs array<struct<start:bigint,end:bigint>>, cells array<bigint>"
)


def as_int16(track: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(track), -32768, 32767).astype(np.int16)


def tracks_of(frames: np.ndarray, split: bool) -> list[tuple[int | None, np.ndarray]]:
    """(channel, int16 samples): the channels' mean, or each channel."""
    if split and frames.shape[1] > 1:
        return [(c, as_int16(frames[:, c])) for c in range(frames.shape[1])]
    return [(None, as_int16(frames.mean(axis=1)))]


def cell_samples(frame: int, pad_ms: int, max_chunk: int, cut_window: int, cut_frame: int) -> int:
    """The widest grid on which every region can begin and every forced cut can lie."""
    pad = pad_ms * SAMPLE_RATE // 1000
    return math.gcd(frame, pad, cut_frame, cut_frame // 2, max_chunk - cut_window)


def scan_blocks(
    layouts: DataFrame,
    *,
    cell: int,
    scorer: Scorer | None = None,
    frame: int = FRAME,
    halo: int = 0,
    split_channels: bool = False,
    block_samples: int = BLOCK_SAMPLES,
    decoder: Decoder = read_frames,
) -> DataFrame:
    """One row of ``SCAN`` for each block of each track of readable files.

    ``runs`` are the runs of active frames inside the block, absolute; ``cells`` the exact sums of squares on
    the grid of ``cell`` samples. A scorer whose verdict depends on earlier or later frames gets ``halo`` frames
    of the neighbouring blocks on both sides, so what it says does not depend on the blocks.
    """
    if block_samples % frame or block_samples % cell:
        raise ValueError("blocks must be whole frames and cells")
    decide = scorer or energy_scorer(0.01)
    schema = T.StructType.fromDDL(SCAN)
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        with decoding(decoder) as decode:
            for batch in batches:
                for row in batch.to_pylist():
                    first = row["block_idx"] * block_samples
                    end = min(first + block_samples, row["_n"])
                    low = max(0, first - halo * frame)
                    high = min(row["_n"], end + halo * frame)
                    frames = decode(row, low, high - low)
                    for channel, samples in tracks_of(frames, split_channels):
                        padded = np.zeros(-(-len(samples) // frame) * frame, dtype=samples.dtype)
                        padded[: len(samples)] = samples
                        active = np.asarray(decide(padded.reshape(-1, frame)), dtype=np.int8)
                        skip = (first - low) // frame
                        active = active[skip : skip + -(-(end - first) // frame)]
                        edges = np.flatnonzero(np.diff(np.concatenate(([0], active, [0]))))
                        runs = [
                            {"start": first + a * frame, "end": min(first + b * frame, end)}
                            for a, b in edges.reshape(-1, 2).tolist()
                        ]
                        square = np.square(samples[first - low : end - low].astype(np.int64))
                        cells = np.add.reduceat(square, np.arange(0, len(square), cell))
                        out.append((row["recording_id"], channel, row["block_idx"], first, end - first, runs, cells))
                        held += len(cells) + len(runs)
                    if held >= BATCH_CELLS:
                        yield column_batch(out, kinds, schema.names)
                        out, held = [], 0
                if out:
                    yield column_batch(out, kinds, schema.names)
                    out, held = [], 0

    return block_rows(layouts, block_samples).mapInArrow(run, schema)


def scanned_lengths(scans: DataFrame) -> DataFrame:
    """``(recording_id, channel, audio_samples)`` of the decoded tracks."""
    return scans.groupBy("recording_id", "channel").agg(
        F.max(F.col("start_sample") + F.col("samples")).alias("audio_samples")
    )


def scanned_regions(
    scans: DataFrame, *, min_silence_ms: int = SILENCE_MS, speech_pad_ms: int = PAD_MS
) -> DataFrame:
    """Speech regions per track: runs that touch over block edges are one, short silences are bridged, then
    regions are padded, not beyond their track."""
    ms = SAMPLE_RATE // 1000
    runs = scans.select("recording_id", "channel", F.explode("runs").alias("_r")).select(
        "recording_id", "channel", "_r.start", "_r.end"
    )
    found = close_gaps(runs, min_silence_ms * ms, speech_pad_ms * ms)
    ends = scanned_lengths(scans).select(
        F.col("recording_id").alias("_id"), F.col("channel").alias("_c"), "audio_samples"
    )
    same = null_safe(found, ends, [("recording_id", "_id"), ("channel", "_c")])
    clipped = found.join(ends, same).withColumn("end", F.least("end", "audio_samples"))
    return clipped.drop("_id", "_c", "audio_samples")


def split_by_cells(
    regions: DataFrame,
    scans: DataFrame,
    *,
    cell: int,
    block_samples: int,
    max_chunk: int = plans.MAX_CHUNK,
    cut_window: int = plans.CUT_WINDOW,
    cut_frame: int = plans.CUT_FRAME,
) -> DataFrame:
    """Pieces of regions longer than ``max_chunk``, each cut at the quietest frame of the last ``cut_window``
    samples of its window, from the energies a scan has. Regions must begin on the grid."""
    plans.check_cut(max_chunk, cut_window, cut_frame)
    if any(x % cell for x in (cut_frame, cut_frame // 2, max_chunk - cut_window)):
        raise ValueError("cuts must lie on the grid")
    keys = ["recording_id", "channel", "start", "end"]
    long = regions.where(F.col("end") - F.col("start") > max_chunk).select(*keys)
    wanted = plans.blocks_of(long, block_samples)
    energies = scans.select(
        F.col("recording_id").alias("_id"),
        F.col("channel").alias("_c"),
        F.col("block_idx").alias("_b"),
        "start_sample",
        "cells",
    )
    same = null_safe(wanted, energies, [("recording_id", "_id"), ("channel", "_c"), ("block_idx", "_b")])
    parts = wanted.join(energies, same).groupBy(*keys).agg(
        F.collect_list(F.struct("start_sample", "cells")).alias("_parts")
    )

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def edges(first: pd.Series, last: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for a, b, blocks in zip(first, last, found):
            energy = np.zeros(-(-int(b - a) // cell), dtype=np.int64)
            for block in blocks:
                values = np.asarray(block["cells"], dtype=np.int64)
                at = (int(block["start_sample"]) - int(a)) // cell
                values, at = values[max(0, -at) :], max(0, at)
                part = values[: len(energy) - at]
                energy[at : at + len(part)] = part
            cuts = chained_cuts(energy, int(b - a), cell, max_chunk, cut_window, cut_frame)
            out.append([int(a), *[int(a) + c for c in cuts], int(b)])
        return pd.Series(out)

    bounds = parts.select("recording_id", "channel", edges("start", "end", "_parts").alias("_e"))
    pairs = F.arrays_zip(
        F.expr("slice(_e, 1, size(_e) - 1)").alias("start"), F.expr("slice(_e, 2, size(_e) - 1)").alias("end")
    )
    return bounds.select("recording_id", "channel", F.posexplode(pairs).alias("_i", "_p"), F.size("_e").alias("_n")).select(
        "recording_id", "channel", "_p.start", "_p.end", (F.col("_i") < F.col("_n") - 2).alias("forced_cut")
    )


def chained_cuts(
    energy: np.ndarray, length: int, cell: int, max_chunk: int, window: int, frame: int
) -> list[int]:
    """Cuts of a region, from its start: of the frames in the last ``window`` samples that a chunk may reach, the
    centre of the first quietest, then on from there."""
    total = np.concatenate([[0], np.cumsum(energy)])
    cuts, start = [], 0
    while length - start > max_chunk:
        edges = start + max_chunk - window + np.arange(0, window + 1, frame)
        start = int(edges[np.argmin(np.diff(total[edges // cell]))]) + frame // 2
        cuts.append(start)
    return cuts


def plan_scans(
    scans: DataFrame,
    regions: DataFrame,
    *,
    cell: int,
    block_samples: int = BLOCK_SAMPLES,
    max_chunk: int = plans.MAX_CHUNK,
    max_gap: int = plans.MAX_GAP,
    cut_window: int = plans.CUT_WINDOW,
    cut_frame: int = plans.CUT_FRAME,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """The numbered chunk plan (recording_id, channel, index, start, end, forced_cut) of scanned files."""
    pieces = split_by_cells(
        regions, scans, cell=cell, block_samples=block_samples,
        max_chunk=max_chunk, cut_window=cut_window, cut_frame=cut_frame,
    )
    packed = plans.pack_chunks(regions, max_chunk=max_chunk, max_gap=max_gap, pieces=pieces, hot_rows=hot_rows)
    numbered = plans.number_chunks(packed, hot_rows=hot_rows)
    return numbered.select("recording_id", "channel", "index", "start", "end", "forced_cut")


#: What a task needs to know of a file to read any range of it.
LAYOUT = ("path", "channels", "rate", "bits", "byte_order", "data_offset", "frames", "encoding")


def with_layouts(spans: DataFrame, layouts: DataFrame) -> DataFrame:
    """Rows with a recording_id and where and how its file is to be read. A file of very many spans is a hot key
    of the join; its rows are narrow, and adaptive execution splits them."""
    return spans.join(layouts.select("recording_id", *LAYOUT), "recording_id")


def read_span(row: dict, decoder: Decoder = read_frames) -> np.ndarray:
    """int16 samples of a row with ``start``, ``end``, ``channel`` and a file's layout."""
    frames = decoder(row, row["start"], row["end"] - row["start"])
    channel = row["channel"]
    return as_int16(frames.mean(axis=1) if channel is None else frames[:, channel])


def span_energy(spans: DataFrame, layouts: DataFrame, keys: Sequence[str], decoder: Decoder = read_frames) -> DataFrame:
    """``keys``, ``samples`` and ``energy`` (sum of squares) of the audio of each span, read by its task."""
    rows = with_layouts(spans, layouts)
    schema = T.StructType([*[rows.schema[k] for k in keys], *T.StructType.fromDDL("samples bigint, energy bigint")])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with decoding(decoder) as decode:
            for batch in batches:
                out: list[tuple] = []
                for row in batch.to_pylist():
                    samples = read_span(row, decode).astype(np.int64)
                    out.append((*[row[k] for k in keys], len(samples), int(np.square(samples).sum())))
                yield column_batch(out, kinds, schema.names)

    wanted = list(dict.fromkeys([*keys, "channel", "start", "end", *LAYOUT]))
    return by_place(rows.select(*wanted), sample_place(F.col("start"))).mapInArrow(run, schema)


def scan_regions(
    layouts: DataFrame, *, cell: int, frame: int = FRAME, block_samples: int = BLOCK_SAMPLES,
    min_silence_ms: int = SILENCE_MS, speech_pad_ms: int = PAD_MS, **scan,
) -> tuple[DataFrame, DataFrame]:
    """(scans, regions) of readable files. The scan is checkpointed, so the audio is read once."""
    scans = cut_lineage(scan_blocks(layouts, cell=cell, frame=frame, block_samples=block_samples, **scan))
    regions = scanned_regions(scans, min_silence_ms=min_silence_ms, speech_pad_ms=speech_pad_ms)
    return scans, cut_lineage(regions)


def scan_files(
    layouts: DataFrame, *, block_samples: int = BLOCK_SAMPLES, frame: int = FRAME, speech_pad_ms: int = PAD_MS,
    max_chunk: int = plans.MAX_CHUNK, cut_window: int = plans.CUT_WINDOW, cut_frame: int = plans.CUT_FRAME,
    max_gap: int = plans.MAX_GAP, **scan,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scans, regions, plan) of readable files, from one pass over their audio."""
    cell = cell_samples(frame, speech_pad_ms, max_chunk, cut_window, cut_frame)
    scans, regions = scan_regions(
        layouts, cell=cell, frame=frame, block_samples=block_samples, speech_pad_ms=speech_pad_ms, **scan
    )
    plan = plan_scans(
        scans, regions, cell=cell, block_samples=block_samples, max_chunk=max_chunk,
        max_gap=max_gap, cut_window=cut_window, cut_frame=cut_frame,
    )
    return scans, regions, cut_lineage(plan)
