"""Chunk results to transcripts and per-recording statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.functions.language import normalise_language
from speechframe.functions.timing import seconds
from speechframe.operators.ordered import prefix_scan, without_slices


def number_parts(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], part_rows: int | None
) -> DataFrame:
    """Add ``part``: 0, or the row's number within its key over ``part_rows``, without gaps."""
    if part_rows is None:
        return rows.withColumn("part", F.lit(0).cast("bigint"))
    numbered = prefix_scan(rows, keys, order, {"_before": ("count", F.lit(1), False)})
    part = F.floor(F.col("_before") / F.lit(part_rows)).cast("bigint")
    return without_slices(numbered.withColumn("part", part).drop("_before"))


def assemble_text(
    segments: DataFrame,
    keys: Sequence[str] = ("recording_id",),
    *,
    keep: Column | None = None,
    counts: dict[str, Column] | None = None,
    part_rows: int | None = None,
) -> DataFrame:
    """Full text and ordered segments per recording, of the rows with ``keep``; ``counts`` adds
    aggregates over all rows in the same pass.

    Segments sort by start, then channel, chunk and position. A recording is one row (``part`` 0),
    as long as audio is accepted. For longer ones ``part_rows`` asks for parts of so many segments,
    numbered 0, 1, ... in time order; joined in order (with a space) they are the whole text.
    """
    counts = counts or {}
    ranked = segments.withColumn("_ch", F.coalesce("channel", F.lit(0)))
    sliced = number_parts(ranked, keys, ["start", "_ch", "chunk", "ord"], part_rows)
    entry = F.struct(
        "start",
        F.coalesce("channel", F.lit(0)).alias("ch"),
        "chunk",
        "ord",
        "end",
        "text",
        "channel",
        "low_confidence",
    )
    return (
        sliced.groupBy(*keys, "part")
        .agg(
            F.array_sort(F.collect_list(entry if keep is None else F.when(keep, entry))).alias("_s"),
            *[aggregate.alias(name) for name, aggregate in counts.items()],
        )
        .select(
            *keys,
            "part",
            *counts,
            F.array_join(F.transform("_s", lambda s: s["text"]), " ").alias("text"),
            F.transform(
                "_s",
                lambda s: F.struct(
                    s["start"].alias("start"),
                    s["end"].alias("end"),
                    s["text"].alias("text"),
                    s["channel"].alias("channel"),
                    s["low_confidence"].alias("low_confidence"),
                ),
            ).alias("segments"),
        )
    )


def transcript_stats(
    plan: DataFrame,
    regions: DataFrame,
    results: DataFrame,
    reasons: DataFrame,
    audio: DataFrame,
    key: str = "recording_id",
) -> DataFrame:
    """Per-recording roll-up; every input is aggregated to one row per recording first.

    ``plan`` chunks, ``regions`` speech intervals, ``results`` one row per finished chunk with
    ``engine``, ``reasons`` guarded segments, ``audio`` ``(key, audio_samples)`` per channel.
    """
    chunks = plan.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if("forced_cut").alias("forced_cuts"),
        F.sum(F.col("end") - F.col("start")).alias("_transcribed"),
    )
    speech = regions.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("_speech"))
    length = audio.groupBy(key).agg(F.max("audio_samples").alias("audio_samples"))
    kept = reasons.groupBy(key).agg(
        F.count_if(F.col("reason").isNull() & F.col("low_confidence")).alias(
            "low_confidence_segments"
        )
    )
    dropped = name_counts(reasons.where(F.col("reason").isNotNull()), key, "reason").withColumnRenamed(
        "counts", "dropped_segments"
    )
    engines = name_counts(results, key, "engine").withColumnRenamed("counts", "engines")
    out = length
    for part in (chunks, speech, kept, dropped, engines):
        out = out.join(part, key, "left")
    zero = F.lit(0).cast("bigint")
    empty = F.create_map().cast("map<string,bigint>")
    return out.select(
        key,
        seconds(F.col("audio_samples")).alias("audio_seconds"),
        seconds(F.coalesce("_speech", zero)).alias("speech_seconds"),
        seconds(F.coalesce("_transcribed", zero)).alias("transcribed_seconds"),
        F.try_divide(F.coalesce("_speech", zero), "audio_samples").alias("speech_ratio"),
        F.coalesce("chunks", zero).alias("chunks"),
        F.coalesce("forced_cuts", zero).alias("forced_cuts"),
        F.coalesce("low_confidence_segments", zero).alias("low_confidence_segments"),
        F.coalesce("dropped_segments", empty).alias("dropped_segments"),
        F.coalesce("engines", empty).alias("engines"),
    )


def name_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    counts = df.groupBy(key, name).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "_n")))).alias("counts")
    )


def processing_ratio(df: DataFrame) -> DataFrame:
    """Audio seconds per processing second; NULL when nothing was measured."""
    return df.withColumn(
        "realtime_factor",
        F.try_divide("audio_seconds", F.when(F.col("processing_seconds") > 0,
                                             F.col("processing_seconds"))),
    )


def pin_language(
    results: DataFrame, requested: DataFrame | None = None, key: str = "recording_id"
) -> DataFrame:
    """Language per recording: the requested one (no probability), else that of the first chunk
    which detected one, with the probability of the same chunk."""
    code = normalise_language(F.col("language"))
    detected = results.groupBy(key).agg(
        F.min_by(
            F.struct(code.alias("language"), F.col("language_probability").alias("probability")),
            F.when(code.isNotNull(), F.col("chunk")),
        ).alias("_d")
    )
    if requested is None:
        return detected.select(key, "_d.language", "_d.probability")
    asked = requested.select(key, normalise_language(F.col("language")).alias("_asked"))
    return detected.join(asked, key, "left").select(
        key,
        F.coalesce("_asked", "_d.language").alias("language"),
        F.when(F.col("_asked").isNull(), F.col("_d.probability")).alias("probability"),
    )


def serve_with_fallback(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary results where there are any, the fallback's for the other chunks."""
    return primary.unionByName(fallback.join(primary.select(*keys), list(keys), "left_anti"))
