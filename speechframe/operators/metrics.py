"""Counters, histograms and gauges over event tables, batch and windowed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.operators.ordered import HOT_ROWS, Hot, measure, prefix_scan


def counters(events: DataFrame, labels: Sequence[str], amount: Column | None = None) -> DataFrame:
    value = F.count(F.lit(1)) if amount is None else F.sum(amount)
    return events.groupBy(*labels).agg(value.alias("total"))


def histogram(
    events: DataFrame, value: Column, buckets: Sequence[float], labels: Sequence[str] = ()
) -> DataFrame:
    """Cumulative buckets ``(labels, le, count)`` up to ``+Inf``, with ``sum`` and ``n``. All
    buckets come from one aggregation pass."""
    counts = F.array(
        *[
            F.struct(F.lit(f"{b:g}").alias("le"), F.count_if(F.col("_v") <= b).alias("count"))
            for b in map(float, buckets)
        ],
        F.struct(F.lit("+Inf").alias("le"), F.count("_v").alias("count")),
    )
    return (
        events.withColumn("_v", value.cast("double"))
        .groupBy(*labels)
        .agg(counts.alias("_b"), F.sum("_v").alias("sum"), F.count("_v").alias("n"))
        .select(*labels, F.explode("_b").alias("_b"), "sum", "n")
        .select(*labels, "_b.le", "_b.count", "sum", "n")
    )


def gauges(samples: DataFrame, labels: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Last sampled value per label set."""
    return samples.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias(value))


def windows(
    events: DataFrame, labels: Sequence[str], *, length: str, slide: str | None = None,
    value: str = "value", ts: str = "ts",
) -> DataFrame:
    """Counts and sums per tumbling (or sliding) window; works on streams with a watermark."""
    frame = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (
        events.groupBy(frame.alias("_w"), *labels)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("_w.start").alias("window_start"), *labels, "n", "total")
    )


def sessions(events: DataFrame, keys: Sequence[str], *, gap: str, ts: str = "ts") -> DataFrame:
    """Activity sessions per key, closed after ``gap`` without an event."""
    return (
        events.groupBy(F.session_window(ts, gap).alias("_w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_ts"))
        .select(*keys, F.col("_w.start").alias("session_start"), "last_ts", "n")
    )


def activity_sessions(
    events: DataFrame, keys: Sequence[str], *, gap_us: int, hot_rows: int | None | Hot = HOT_ROWS
) -> DataFrame:
    """Batch form of :func:`sessions` on ``us``; a key of very many events is scanned in slices,
    where a session window would bring it to one task."""
    hot = measure(events, keys, "us", hot_rows)
    order = ["us", "event_id"]
    seen = prefix_scan(events, keys, order, {"_prev": ("max", F.col("us"), False)}, hot_rows=hot)
    opens = F.coalesce(F.col("us") - F.col("_prev") > gap_us, F.lit(True)).cast("bigint")
    numbered = prefix_scan(seen, keys, order, {"_nth": ("sum", opens, True)}, hot_rows=hot)
    return (
        numbered.groupBy(*keys, "_nth")
        .agg(
            F.min("us").alias("start_us"),
            F.max("us").alias("last_us"),
            F.count(F.lit(1)).alias("n"),
        )
        .drop("_nth")
    )


def approximate(events: DataFrame, labels: Sequence[str], key: str, value: str) -> DataFrame:
    """Views for dashboards: distinct keys and percentiles, both approximate."""
    return events.groupBy(*labels).agg(
        F.approx_count_distinct(key).alias("keys"),
        F.percentile_approx(value, [0.5, 0.95, 0.99]).alias("percentiles"),
    )
