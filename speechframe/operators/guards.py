"""Quality guards: raw engine segments to absolute, checked segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.functions.text import guard_key, is_boilerplate, strip
from speechframe.functions.timing import clamp, seconds
from speechframe.operators.ordered import Hot, measure, prefix_scan, without_slices

NO_SPEECH = 0.6
LOGPROB = -1.0
COMPRESSION = 2.4
LOW_CONFIDENCE = -0.7
SUSPECT_NO_SPEECH = 0.3
MAX_REPEATS = 2


def above(value: Column, limit: float) -> Column:
    """Strictly above; a missing score never triggers."""
    return F.coalesce(value > limit, F.lit(False))


def below(value: Column, limit: float) -> Column:
    return F.coalesce(value < limit, F.lit(False))


def to_absolute(
    segments: DataFrame,
    chunks: DataFrame,
    *,
    low_confidence: float = LOW_CONFIDENCE,
) -> DataFrame:
    """Attach chunk offsets to chunk-relative segments and clamp them to the chunk."""
    offsets = chunks.select(
        "recording_id",
        F.col("index").alias("chunk"),
        "channel",
        seconds(F.col("start")).alias("_from"),
        seconds(F.col("end")).alias("_to"),
    )
    joined = segments.drop("channel").join(offsets, ["recording_id", "chunk"])

    def place(t: Column) -> Column:
        return clamp(F.col("_from") + t, F.col("_from"), F.col("_to"))

    def word(w: Column) -> Column:
        start = place(w["start"])
        return F.struct(
            start.alias("start"),
            F.greatest(place(w["end"]), start).alias("end"),
            strip(w["text"]).alias("text"),
            w["probability"].alias("probability"),
        )

    start = place(F.col("start"))
    return joined.withColumns(
        {
            "end": F.greatest(place(F.col("end")), start),
            "start": start,
            "text": strip(F.col("text")),
            "words": F.transform("words", word),
            "low_confidence": below(F.col("avg_logprob"), low_confidence),
        }
    ).drop("_from", "_to")


def guard_reasons(
    segments: DataFrame,
    keys: Sequence[str] = ("recording_id", "chunk"),
    order: Sequence[str] = ("start", "ord"),
    *,
    no_speech: float = NO_SPEECH,
    logprob: float = LOGPROB,
    compression: float = COMPRESSION,
    hot_rows: int | None | Hot = None,
) -> DataFrame:
    """Add ``reason`` (NULL = kept), decided per chunk in time order.

    ``keys`` is one chunk, at most one recogniser window, so its rows are bounded; pass
    ``hot_rows`` to guard longer runs. Rows dropped for other reasons neither count as repeats
    nor interrupt them, which reduces the running comparison to window functions.
    """
    text = F.col("_key")
    pre = (
        F.when(F.col("text") == "", "empty")
        .when(
            above(F.col("no_speech_prob"), no_speech) & below(F.col("avg_logprob"), logprob),
            "silence_hallucination",
        )
        .when(above(F.col("compression_ratio"), compression), "repetition")
    )
    suspect = F.col("low_confidence") | above(F.col("no_speech_prob"), SUSPECT_NO_SPEECH)
    hot = measure(segments, keys, order[0], hot_rows)
    # Shuffle the bare segments; their text keys are computed on the other side, where the
    # windows below find them already partitioned.
    placed = segments.repartition(*keys) if hot.stats is None else segments
    staged = (
        placed.withColumn("_key", guard_key(F.col("text")))
        .withColumn("_pre", pre)
        .withColumn("_known", suspect & is_boilerplate(text))
        .withColumn("_cand", F.col("_pre").isNull() & ~F.col("_known"))
    )
    candidate = F.when(F.col("_cand"), text)
    before = prefix_scan(
        staged,
        keys,
        order,
        {"_prev": ("last", candidate, False), "_count": ("count", candidate, False)},
        hot_rows=hot,
    )
    # The candidates counted before the present run of equal texts began.
    changed = F.col("_cand") & ~text.eqNullSafe(F.col("_prev"))
    counted = prefix_scan(
        before,
        keys,
        order,
        {"_began": ("max", F.when(changed, F.col("_count")), True)},
        hot_rows=hot,
    )
    repeats = F.when(
        text.eqNullSafe(F.col("_prev")), F.col("_count") - F.col("_began")
    ).otherwise(0)
    reason = (
        F.when(F.col("_pre").isNotNull(), F.col("_pre"))
        .when(repeats >= MAX_REPEATS, "repetition")
        .when(F.col("_known"), "known_hallucination")
    )
    return without_slices(
        counted.withColumn("reason", reason).drop(
            "_key", "_pre", "_known", "_cand", "_prev", "_count", "_began"
        )
    )


def dropped_by_reason(reasons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and reason."""
    return (
        reasons.where(F.col("reason").isNotNull())
        .groupBy(*keys, "reason")
        .agg(F.count(F.lit(1)).alias("dropped"))
    )


def count_map(counts: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """Fold per-name counts into one ``map<string,bigint>`` per key (names are few)."""
    return counts.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("counts")
    )
