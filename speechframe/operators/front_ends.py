"""Named ways to get from audio to tokens and seams, compared by the evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe.functions.timing import seconds
from speechframe.operators import audio, chunks, engine, evaluation, guards
from speechframe.operators.engine import Engine
from speechframe.operators.ordered import cut_lineage
from speechframe.schema import SAMPLE_RATE

NAIVE_WINDOW_S = 30


def pipeline(
    blocks: DataFrame, engine_factory: Callable[[], Engine], *, block_samples: int, **options
) -> tuple[DataFrame, DataFrame]:
    """Speech regions, planned chunks, guards; seams lie between chunks."""
    regions = audio.detect_regions(blocks)
    plan = chunks.plan_recordings(regions, blocks, block_samples=block_samples)
    heard = chunks.slice_audio(plan, blocks, block_samples=block_samples)
    raw = engine.transcribe_recordings(heard, engine_factory, word_timestamps=True, **options)
    kept = guards.guard_reasons(guards.to_absolute(engine.raw_segments(raw), plan)).where(
        F.col("reason").isNull()
    )
    ordered = kept.withColumn("ord", F.col("chunk").cast("bigint") * 1_000_000 + F.col("ord"))
    spans = plan.select(
        "recording_id", "index", seconds(F.col("start")).alias("start"), seconds(F.col("end")).alias("end")
    )
    return _named(evaluation.timed_tokens(ordered, ["recording_id"])), _named(
        evaluation.boundaries(spans)
    )


def naive(
    blocks: DataFrame,
    engine_factory: Callable[[], Engine],
    *,
    block_samples: int,
    window_s: int = NAIVE_WINDOW_S,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Fixed windows over the whole recording, no guards; seams are the window starts."""
    window = window_s * SAMPLE_RATE
    lengths = audio.durations(blocks).drop("error_code")
    plan = cut_lineage(
        chunks.number_chunks(chunks.fixed_windows(lengths, "audio_samples", window))
    )
    heard = chunks.slice_audio(plan, blocks, block_samples=block_samples)
    raw = engine.raw_segments(
        engine.transcribe_chunks(heard, engine_factory, word_timestamps=True, **options)
    )
    ordered = raw.withColumn("_at", F.col("chunk") * float(window_s)).withColumn(
        "ord", F.col("chunk").cast("bigint") * 1_000_000 + F.col("ord")
    )
    tokens = evaluation.timed_tokens(ordered, ["recording_id"], F.col("_at"))
    marks = plan.where(F.col("start") > 0).select("recording_id", seconds(F.col("start")).alias("t"))
    return _named(tokens), _named(marks)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("recording_id", "clip_id")


FRONT_ENDS = {"pipeline": pipeline, "naive30": naive}
