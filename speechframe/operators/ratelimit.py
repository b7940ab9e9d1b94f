"""Fixed rate windows that open at a key's first request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe.functions.timing import epoch_us
from speechframe.operators.ordered import HOT_ROWS, Hot, Machine, fold_states, measure, prefix_scan

WINDOW_S = 60
READ_FACTOR = 10


class _Window(Machine):
    """The first request at or after a window's end opens the next."""

    def __init__(self, length: int):
        self.length = length

    def due(self, tag, row):
        return 0, row["_us"] + self.length


def rate_limit(
    requests: DataFrame,
    keys: Sequence[str] = ("api_key", "bucket"),
    *,
    limit: str = "limit",
    cost: str = "cost",
    window_s: int = WINDOW_S,
    tie: str = "request_id",
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Add ``allowed``, ``remaining`` and ``reset_s`` to a request log with column ``ts``.

    Denied requests count too. A window starts with the first request after the last one ended,
    so windows of a key chain from each other and are not aligned to the clock."""
    length = window_s * 1_000_000
    timed = requests.withColumn("_us", epoch_us(F.col("ts")))
    hot = measure(timed, keys, "_us", hot_rows)
    placed = fold_states(
        timed, keys, ["_us", tie], _Window(length), pos="_us", hot_rows=hot
    ).withColumn("_ends", F.col("after_wake"))
    counted = prefix_scan(
        placed.drop("before_tag", "before_wake", "after_tag", "after_wake", "acted"),
        [*keys, "_ends"],
        ["_us", tie],
        {"_count": ("sum", F.col(cost), True)},
        hot_rows=hot,
    )
    left = F.col("_ends") - F.col("_us")
    return counted.select(
        *requests.columns,
        (F.col("_count") <= F.col(limit)).alias("allowed"),
        F.greatest(F.lit(0), F.col(limit) - F.col("_count")).cast("bigint").alias("remaining"),
        F.greatest(F.lit(1), F.ceil(left / 1_000_000.0)).cast("bigint").alias("reset_s"),
    )


def budgets(
    requests: DataFrame, api_keys: DataFrame, *, default_limit: int = WINDOW_S
) -> DataFrame:
    """Attach ``limit``: the key's own or the default, ten times that for reads."""
    per_key = api_keys.select(F.col("id").alias("api_key"), "rate_limit_per_minute")
    own = F.coalesce(
        F.nullif("rate_limit_per_minute", F.lit(0)), F.lit(default_limit)
    ).cast("bigint")
    factor = F.when(F.col("bucket") == "read", READ_FACTOR).otherwise(1)
    return (
        requests.join(per_key, "api_key", "left")
        .withColumn("limit", own * factor)
        .drop("rate_limit_per_minute")
    )


def aligned_usage(requests: DataFrame, keys: Sequence[str], *, window_s: int = WINDOW_S) -> DataFrame:
    """Clock-aligned approximation: cost per key and minute."""
    return requests.groupBy(*keys, F.window("ts", f"{window_s} seconds").alias("w")).agg(
        F.sum("cost").alias("cost")
    )
