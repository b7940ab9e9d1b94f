"""Speech regions: half-open sample intervals per recording and channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe.operators.ordered import HOT_ROWS, Hot, measure, prefix_scan


def merge_regions(
    regions: DataFrame,
    keys: Sequence[str] = ("recording_id", "channel"),
    *,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Union of touching or overlapping intervals ``[start, end)`` per key."""
    hot = measure(regions, keys, "start", hot_rows)
    reach = prefix_scan(
        regions.select(*keys, "start", "end"),
        keys,
        ["start", "end"],
        {"_reach": ("max", F.col("end"), False)},
        hot_rows=hot,
    )
    opens = F.coalesce(F.col("start") > F.col("_reach"), F.lit(True)).cast("bigint")
    islands = prefix_scan(
        reach, keys, ["start", "end"], {"_island": ("sum", opens, True)}, hot_rows=hot
    )
    return (
        islands.groupBy(*keys, "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_island")
    )


def close_gaps(regions: DataFrame, min_silence: int, pad: int) -> DataFrame:
    """Turn raw active frames into regions: silences shorter than ``min_silence`` samples are
    bridged, then each region is padded by ``pad`` samples (not before 0).

    Bridging is interval merging of ends pushed out by ``min_silence - 1``."""
    keys = ["recording_id", "channel"]
    stretched = regions.withColumn("end", F.col("end") + F.lit(max(min_silence - 1, 0)))
    bridged = merge_regions(stretched, keys).withColumn(
        "end", F.col("end") - F.lit(max(min_silence - 1, 0))
    )
    padded = bridged.withColumn("start", F.greatest(F.lit(0), F.col("start") - pad)).withColumn(
        "end", F.col("end") + pad
    )
    return merge_regions(padded, keys)


def region_totals(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return regions.groupBy(*keys).agg(
        F.sum(F.col("end") - F.col("start")).alias("speech_samples"),
        F.count(F.lit(1)).alias("regions"),
    )
