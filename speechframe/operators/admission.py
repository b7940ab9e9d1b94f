"""Admission of requests: the first failing check decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechframe.operators.ordered import HOT_ROWS, Hot, prefix_scan

MAX_PENDING = 200
MAX_BYTES = 100 * 1024 * 1024

# HTTP status of outcomes that are not errors.
ACCEPTED = {"created": 202, "replayed": 200, "deduplicated": 200}


def active_at(
    requests: DataFrame,
    intervals: DataFrame,
    *,
    request: str = "request_id",
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """``(request_id, active)``: open intervals ``[start, end)`` (microseconds) at each request's
    ``us``, by one scan per day over changes and requests; intervals that open at the very
    instant are not counted yet."""
    day_us = 86_400_000_000
    opened = intervals.select(F.col("start").alias("us"), F.lit(1).alias("d"), F.lit(2).alias("_kind"))
    closed = intervals.select(F.col("end").alias("us"), F.lit(-1).alias("d"), F.lit(0).alias("_kind"))
    changes = (
        opened.unionByName(closed).groupBy("us", "_kind").agg(F.sum("d").alias("d"))
    )
    probes = requests.select("us", F.lit(1).alias("_kind"), F.col(request).alias("_id"))
    rows = probes.unionByName(changes, allowMissingColumns=True).withColumn(
        "_day", F.floor(F.col("us") / day_us)
    )
    within = prefix_scan(
        rows, ["_day"], ["us", "_kind", "_id"],
        {"_open": ("sum", F.coalesce("d", F.lit(0)), True)}, hot_rows=hot_rows,
    ).where(F.col("_kind") == 1)
    # One row per day of the log.
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("_day")
        .agg(F.coalesce(F.sum("d"), F.lit(0)).alias("_net"))
        .select("_day", F.coalesce(F.sum("_net").over(earlier), F.lit(0)).alias("_carried"))
    )
    return within.join(carried, "_day").select(
        F.col("_id").alias(request), (F.col("_carried") + F.col("_open")).alias("active")
    )


def outcome(
    *,
    max_pending: int = MAX_PENDING,
    max_bytes: int = MAX_BYTES,
    source: str = "direct",
) -> Column:
    """Outcome of enriched requests: columns ``api_key_id``, ``allowed``, ``size``,
    ``replay_of``, ``active``, ``supported``, ``duplicate_of``, ``idempotency_key`` and
    ``write`` (:func:`jobs.first_writer`'s outcome).

    Direct uploads know their size before anything else and are probed after the capacity check;
    objects uploaded earlier are only measured there (NULL size: no such object)."""
    size = F.col("size")
    checks = F.when(F.col("api_key_id").isNull(), "unauthorized").when(
        ~F.col("allowed"), "rate_limited"
    )
    if source == "direct":
        checks = checks.when(size > max_bytes, "payload_too_large").when(size == 0, "bad_request")
    else:
        checks = checks.when(size.isNull(), "not_found")
    checks = checks.when(F.col("replay_of").isNotNull(), "replayed").when(
        F.col("active") >= max_pending, "queue_full"
    )
    if source == "direct":
        checks = checks.when(~F.col("supported"), "unsupported_media_type")
    else:
        checks = checks.when(size > max_bytes, "payload_too_large")
    return (
        checks.when(
            F.col("idempotency_key").isNull() & F.col("duplicate_of").isNotNull(), "deduplicated"
        )
        .when(F.col("write") == "conflict", "idempotency_key_reused")
        .otherwise(F.col("write"))
    )


def expand_batch(batches: DataFrame) -> DataFrame:
    """One row per file of a batch, in upload order; file ``i`` gets key ``<key>:<i>``. A batch
    costs one unit per file."""
    files = batches.select(
        *[c for c in batches.columns if c != "files"], F.posexplode("files").alias("position", "file")
    )
    return files.withColumn(
        "idempotency_key",
        F.concat(F.col("idempotency_key"), F.lit(":"), F.col("position").cast("string")),
    ).withColumn("cost", F.lit(1))


def number_files(
    files: DataFrame, order: str, *, batch: str = "batch_id", hot_rows: int | None | Hot = HOT_ROWS
) -> DataFrame:
    """Files that come as rows of a batch: their ``position`` and own idempotency key."""
    placed = prefix_scan(
        files, [batch], [order], {"position": ("count", F.lit(1), False)}, hot_rows=hot_rows
    ).drop("_slice", "_hot")
    own = F.concat(F.col("idempotency_key"), F.lit(":"), F.col("position").cast("string"))
    return placed.withColumn("idempotency_key", own).withColumn("cost", F.lit(1))


def batch_results(files: DataFrame) -> DataFrame:
    """Per-batch result lists in upload order (a batch holds a bounded number of files)."""
    item = F.struct("position", "filename", "status", "job_id", "error_code")
    return files.groupBy("batch_id").agg(F.array_sort(F.collect_list(item)).alias("data"))
