"""Streaming jobs built from stateless operators and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from speechframe.operators import metrics
from speechframe.sources import sinks


def unique_events(events: DataFrame, keys: Sequence[str], *, delay: str, ts: str = "ts") -> DataFrame:
    """Drop repeats of a key that arrive within the watermark delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_metrics(
    events: DataFrame, labels: Sequence[str], *, delay: str, length: str, slide: str | None = None,
    value: str = "value",
) -> DataFrame:
    """Windowed counts and sums; rows later than ``delay`` are dropped (and counted by the
    query's progress)."""
    return metrics.windows(
        events.withWatermark("ts", delay), labels, length=length, slide=slide, value=value
    )


def worker_sessions(events: DataFrame, keys: Sequence[str], *, delay: str, gap: str) -> DataFrame:
    return metrics.sessions(events.withWatermark("ts", delay), keys, gap=gap)


def route_to_dead_letters(good_path: str, dead_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that splits messages. Each batch overwrites its own directory,
    so a repeated batch leaves the same files."""

    def write(batch: DataFrame, epoch: int) -> None:
        good, dead = sinks.route_messages(batch)
        good.write.mode("overwrite").parquet(f"{good_path}/batch={epoch}")
        dead.write.mode("overwrite").json(f"{dead_path}/batch={epoch}")

    return write


def save_chunks(path: str, order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` upsert of finished chunks by ``(job_id, idx)``."""

    def write(batch: DataFrame, epoch: int) -> None:
        sinks.merge_checkpoint(
            batch.sparkSession, path, batch, ["job_id", "idx"], order, version=epoch
        )

    return write
