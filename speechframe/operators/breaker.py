"""Circuit-breaker timeline of an engine's attempt log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe.functions.timing import epoch_us
from speechframe.operators.ordered import HOT_ROWS, NEVER, Hot, Machine, fold_states


class Breaker(Machine):
    """Tag n below ``threshold``: closed after n failures in a row. Tag ``threshold``: open until
    ``wake``; the first row from then on is the half-open trial."""

    def __init__(self, threshold: int, reset: int):
        if threshold < 1:
            raise ValueError("threshold must be at least 1")
        self.threshold, self.reset = threshold, reset
        self.tags = threshold + 1
        self.sleepless = frozenset(range(threshold))

    def due(self, tag, row):
        if row["_ok"]:
            return 0, NEVER
        if tag + 1 >= self.threshold:
            return self.threshold, row["_us"] + self.reset
        return tag + 1, NEVER


def breaker_timeline(
    attempts: DataFrame,
    keys: Sequence[str] = ("engine",),
    *,
    threshold: int,
    reset_s: int,
    ok: str = "ok",
    tie: str = "seq",
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """What the breaker would do with each attempt: ``state`` it meets, whether the call is
    ``admitted``, and ``failures`` in a row after it (0 while open). Refused calls change nothing;
    while a trial runs the others are refused."""
    rows = attempts.withColumn("_us", epoch_us(F.col("ts"))).withColumn("_ok", F.col(ok))
    states = fold_states(
        rows, keys, ["_us", tie], Breaker(threshold, reset_s * 1_000_000), pos="_us",
        hot_rows=hot_rows,
    )
    state = (
        F.when(F.col("before_tag") < threshold, "closed")
        .when(F.col("acted"), "half_open")
        .otherwise("open")
    )
    open_after = F.col("after_tag") == threshold
    return states.select(
        *attempts.columns,
        state.alias("state"),
        F.col("acted").alias("admitted"),
        F.when(open_after, 0).otherwise(F.col("after_tag")).alias("failures"),
        open_after.alias("open_after"),
    )
