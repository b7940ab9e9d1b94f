"""Webhook outbox: event payloads, delivery outcomes, retry schedule, state fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.functions.ids import event_id
from speechframe.functions.timing import epoch_us
from speechframe.operators.ordered import (
    HOT_ROWS,
    NEVER,
    Hot,
    Machine,
    fold_states,
    measure,
    prefix_scan,
)

LEASE_S = 60
MAX_ATTEMPTS = 5
MAX_DELAY_S = 3600


def retry_delay_s(attempt: Column) -> Column:
    return F.least(5 * F.pow(F.lit(2.0), attempt - 1), F.lit(float(MAX_DELAY_S)))


def loop_backoff_s(failures: Column, cap_s: float) -> Column:
    return F.least(F.lit(float(cap_s)), F.pow(F.lit(2.0), failures - 1))


def jitter_s(attempt: Column, base_s: float, seed: int) -> Column:
    """Full jitter below ``base * 2^attempt``; attempts count from 0."""
    return F.rand(seed) * base_s * F.pow(F.lit(2.0), attempt)


def delivered(status: Column) -> Column:
    return (status >= 200) & (status < 300)


def retryable(status: Column) -> Column:
    return ~delivered(status) & (status.isin(408, 429) | (status >= 500))


def delivery_outcome(status: Column) -> Column:
    return (
        F.when(delivered(status), "ok").when(retryable(status), "retryable").otherwise("permanent")
    )


def engine_error(status: Column) -> Column:
    """Error code of a hosted recogniser's HTTP status; NULL when it answered."""
    unavailable = status.isin(401, 403, 429) | (status >= 500)
    return (
        F.when(status < 400, F.lit(None).cast("string"))
        .when(unavailable, "asr_engine_unavailable")
        .otherwise("asr_engine_error")
    )


def outbox_columns(jobs: DataFrame, finished_at: Column) -> DataFrame:
    """Queue a delivery where a finished job has a target."""
    hooked = F.col("webhook_url").isNotNull()
    return jobs.withColumn("webhook_status", F.when(hooked, "pending")).withColumn(
        "webhook_next_at", F.when(hooked, finished_at)
    )


def event_rows(jobs: DataFrame) -> DataFrame:
    """One JSON event per finished job. Absent values are left out, and the id depends on job
    and status only, so a retry carries the same one."""
    failed = F.col("status") == "failed"
    error = F.when(
        failed,
        F.struct(F.col("error_code").alias("code"), F.col("error_message").alias("message")),
    )
    data = F.struct("id", "status", error.alias("error"), "duration_s", "language")
    created = F.date_format(F.to_utc_timestamp("finished_at", F.current_timezone()),
                            "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return jobs.where(F.col("status").isin("succeeded", "failed")).select(
        "id",
        F.to_json(
            F.struct(
                F.concat(F.lit("transcription."), F.col("status")).alias("type"),
                event_id(F.col("id"), F.col("status")).alias("id"),
                created.alias("created_at"),
                data.alias("data"),
            )
        ).alias("event"),
    )


IDLE = {"status": "pending", "next_us": None, "attempts": 0}


def advance(
    state: dict, event: dict, *, lease_us: int = LEASE_S * 1_000_000, max_attempts: int = MAX_ATTEMPTS
) -> tuple[dict, str]:
    """One row of a delivery log on one job's outbox entry.

    ``event`` is ``claim`` (a dispatcher takes it if due) or ``result`` with ``http_status``
    (NULL: the target was refused). Only an entry that is being sent can be settled."""
    now, status = event["us"], state["status"]
    if event["event"] == "claim":
        due = status in ("pending", "sending") and (
            state["next_us"] is None or state["next_us"] <= now
        )
        if not due:
            return state, "not_due"
        return {
            "status": "sending", "next_us": now + lease_us, "attempts": state["attempts"] + 1
        }, "sending"
    if status != "sending":
        return state, "ignored"
    outcome, delay = settle(event["http_status"], state["attempts"], max_attempts)
    next_us = None if delay is None else now + delay
    return {**state, "status": outcome, "next_us": next_us}, outcome


def settle(code: int | None, attempts: int, max_attempts: int) -> tuple[str, int | None]:
    """Status after a delivery attempt, and the delay (microseconds) before the next one."""
    if code is not None and 200 <= code < 300:
        return "delivered", None
    again = code is not None and (code in (408, 429) or code >= 500)
    if again and attempts < max_attempts:
        return "pending", min(5 * 2 ** (attempts - 1), MAX_DELAY_S) * 1_000_000
    return "failed", None


class Entry(Machine):
    """The outbox entry for :func:`fold_states`. Attempts matter up to ``max_attempts`` only, so
    status and capped attempts make the tag, and the time the entry is due next is the wake."""

    def __init__(self, lease_us: int, max_attempts: int):
        self.lease_us, self.cap = lease_us, max_attempts
        self.delivered, self.failed = 2 * max_attempts + 1, 2 * max_attempts + 2
        self.tags = self.failed + 1
        self.sleepless = frozenset({0, self.delivered, self.failed})

    def state(self, tag: int) -> tuple[str, int]:
        """Status and capped attempts of a tag."""
        if tag < self.cap:
            return "pending", tag
        if tag <= 2 * self.cap:
            return "sending", tag - self.cap
        return ("delivered" if tag == self.delivered else "failed"), 0

    def due(self, tag, row):
        if row["event"] != "claim":
            return self.early(tag, row)
        status, attempts = self.state(tag)
        if status not in ("pending", "sending"):
            return None
        return self.cap + min(attempts + 1, self.cap), row["us"] + self.lease_us

    def early(self, tag, row):
        status, attempts = self.state(tag)
        if row["event"] == "claim" or status != "sending":
            return None
        outcome, delay = settle(row["http_status"], attempts, self.cap)
        if outcome == "pending":
            return attempts, row["us"] + delay
        return (self.delivered if outcome == "delivered" else self.failed), NEVER


def delivery_states(
    deliveries: DataFrame,
    *,
    lease_s: int = LEASE_S,
    max_attempts: int = MAX_ATTEMPTS,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Outcome and state after every row of a delivery log ``(job_id, ts, seq, event,
    http_status)``."""
    rows = deliveries.withColumn("us", epoch_us(F.col("ts"))).select(
        "job_id", "us", "seq", "event", "http_status"
    )
    hot = measure(rows, ["job_id"], "us", hot_rows)
    entry = Entry(lease_s * 1_000_000, max_attempts)
    states = fold_states(rows, ["job_id"], ["us", "seq"], entry, pos="us", hot_rows=hot)
    names = F.array(*[F.lit(entry.state(tag)[0]) for tag in range(entry.tags)])
    claim, acted = F.col("event") == "claim", F.col("acted")
    named = states.withColumn("status", F.element_at(names, F.col("after_tag") + 1))
    due_at = F.when(F.col("after_wake") != NEVER, F.col("after_wake"))
    counted = prefix_scan(
        named,
        ["job_id"],
        ["us", "seq"],
        {
            "attempts": ("count", F.when(claim & acted, 1), True),
            "_due": ("last", F.when(acted, F.struct(due_at.alias("us"))), True),
        },
        hot_rows=hot,
    )
    outcome = F.when(acted, F.col("status")).otherwise(F.when(claim, "not_due").otherwise("ignored"))
    return counted.select(
        "job_id",
        "us",
        "seq",
        outcome.alias("outcome"),
        "status",
        F.col("attempts").cast("int").alias("attempts"),
        F.col("_due.us").alias("next_us"),
    )
