"""Job life cycle as a fold over an event log, batch form.

Only control events (create, claim, complete, fail, release) change who owns a job. Everything
else is a fenced write: it counts if the job is processing and owned by the writer. So:

1. heartbeats are first reduced to the last one per job, worker and stretch between control
   events (they all share the same fate);
2. the few remaining rows are folded in order;
3. all fenced writes get their outcome from the ownership at their place, by an ordered scan.

Jobs of very many events take another way to the same result: a job changes state only a few
times (claims are capped), so its changes are found one after the other, each as the earliest
row of a distributed search over all its events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechframe.functions.timing import epoch_us
from speechframe.operators.ordered import (
    HOT_ROWS,
    NEVER,
    Hot,
    cut_lineage,
    measure,
    prefix_scan,
    rows_of,
    with_slices,
    without_slices,
)

CONTROL = ("create", "claim", "complete", "fail", "release")
NEW = {"status": None, "worker_id": None, "lease": None, "attempts": 0}


def advance(state: dict, event: dict, *, lease_us: int, max_attempts: int) -> tuple[dict, str]:
    """One event on one job: the new state and the outcome. Shared with the streaming form."""
    kind, worker, now = event["event"], event["worker_id"], event["us"]
    status = state["status"]
    if kind == "create":
        if status is not None:
            return state, "ignored"
        return {**state, "status": "queued"}, "created"
    if kind == "claim":
        return _claim(state, worker, now, lease_us, max_attempts)
    if kind == "fail" and worker is None:
        if status not in ("queued", "processing"):
            return state, "ignored"
        return {**state, "status": "failed", "lease": None}, "ok"
    if status != "processing" or state["worker_id"] != worker:
        return state, "lease_lost"
    if kind == "heartbeat":
        return {**state, "lease": now + lease_us}, "ok"
    if kind == "complete":
        return {**state, "status": "succeeded", "lease": None}, "ok"
    if kind == "fail":
        return {**state, "status": "failed", "lease": None}, "ok"
    if kind == "release":
        return {**state, "status": "queued", "worker_id": None, "lease": None}, "ok"
    return state, "ok"


def _claim(state, worker, now, lease_us, max_attempts):
    status, lease = state["status"], state["lease"]
    if status is None:
        return state, "missing"
    free = status == "queued" or (status == "processing" and lease is not None and lease < now)
    if free and state["attempts"] < max_attempts:
        taken = {
            "status": "processing",
            "worker_id": worker,
            "lease": now + lease_us,
            "attempts": state["attempts"] + 1,
        }
        return taken, "claimed"
    if status in ("succeeded", "failed"):
        return state, "terminal"
    if status == "processing" and lease is not None and lease >= now:
        return state, "busy"
    return state, "exhausted" if state["attempts"] >= max_attempts else "busy"


_CONTROL_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("us", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("worker_id", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("status_after", T.StringType()),
        T.StructField("owner_after", T.StringType()),
        T.StructField("attempts_after", T.IntegerType()),
    ]
)


def event_outcomes(
    events: DataFrame,
    *,
    lease_s: int,
    max_attempts: int,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Outcome of every event of ``(job_id, ts, seq, event, worker_id)``, with the job's status,
    owner and attempts after it."""
    rows = events.select(
        "job_id", epoch_us(F.col("ts")).alias("us"), "seq", "event", "worker_id"
    )
    hot = measure(rows, ["job_id"], "us", hot_rows)
    lease_us = lease_s * 1_000_000
    if hot.stats is None:
        return _ordinary_outcomes(rows, lease_us, max_attempts)
    sliced = with_slices(rows, ["job_id"], "us", hot)
    ordinary = without_slices(sliced.where(~F.col("_hot")))
    busy = cut_lineage(sliced.where(F.col("_hot")))
    return _ordinary_outcomes(ordinary, lease_us, max_attempts).unionByName(
        _busy_outcomes(busy, lease_us, max_attempts, hot)
    )


def _ordinary_outcomes(rows: DataFrame, lease_us: int, max_attempts: int) -> DataFrame:
    control = F.col("event").isin(*CONTROL)
    beats = (
        prefix_scan(
            rows.where(control | (F.col("event") == "heartbeat")),
            ["job_id"],
            ["us", "seq"],
            {"_run": ("count", F.when(control, 1), False)},
            hot_rows=None,
        )
        .where(~control)
        .groupBy("job_id", "_run", "worker_id")
        .agg(F.max(F.struct("us", "seq")).alias("_last"))
        .select(
            "job_id", "_last.us", "_last.seq", F.lit("heartbeat").alias("event"), "worker_id"
        )
    )
    folded = _fold(rows.where(control).unionByName(beats), lease_us, max_attempts)
    decided = folded.where(F.col("event") != "heartbeat")
    state = F.struct("status_after", "owner_after", "attempts_after")
    writes = rows.where(~control).withColumn("outcome", F.lit(None).cast("string"))
    both = decided.withColumn("_own", state).unionByName(writes, allowMissingColumns=True)
    scanned = prefix_scan(
        both, ["job_id"], ["us", "seq"], {"_at": ("last", F.col("_own"), True)}, hot_rows=None
    )
    fenced = F.coalesce(
        (F.col("_at.status_after") == "processing")
        & (F.col("_at.owner_after") == F.col("worker_id")),
        F.lit(False),
    )
    return scanned.select(
        "job_id",
        "us",
        "seq",
        "event",
        "worker_id",
        F.coalesce("outcome", F.when(fenced, "ok").otherwise("lease_lost")).alias("outcome"),
        "_at.status_after",
        "_at.owner_after",
        F.coalesce("_at.attempts_after", F.lit(0)).alias("attempts_after"),
    )


def _busy_outcomes(rows: DataFrame, lease_us: int, max_attempts: int, hot: Hot) -> DataFrame:
    event, worker = F.col("event"), F.col("worker_id")
    changes = _state_changes(rows, lease_us, max_attempts, hot)
    own = F.struct("status", "owner", "attempts", F.col("c_us").alias("since"))
    marks = changes.select(
        F.col("job_id").alias("_j"), F.col("c_us").alias("_u"), F.col("c_seq").alias("_s"),
        own.alias("_own"),
    )
    # At most a few changes per hot job.
    marked = rows.join(
        F.broadcast(marks),
        (rows["job_id"] == marks["_j"]) & (rows["us"] == marks["_u"]) & (rows["seq"] == marks["_s"]),
        "left",
    ).drop("_j", "_u", "_s")
    placed = prefix_scan(
        marked,
        ["job_id"],
        ["us", "seq"],
        {"_at": ("last", F.col("_own"), True), "_before": ("last", F.col("_own"), False)},
        hot_rows=hot,
    )
    owned = (F.col("_at.status") == "processing") & (F.col("_at.owner") == worker)
    beat = F.when((event == "heartbeat") & owned, F.col("us"))
    leased = prefix_scan(
        placed, ["job_id"], ["us", "seq"], {"_beat": ("max", beat, False)}, hot_rows=hot
    )
    status, attempts = F.col("_before.status"), F.col("_before.attempts")
    live = F.greatest("_beat", "_before.since") + lease_us >= F.col("us")
    refused = (
        F.when(status.isNull(), "missing")
        .when(status.isin("succeeded", "failed"), "terminal")
        .when((status == "processing") & live, "busy")
        .when(attempts >= max_attempts, "exhausted")
        .otherwise("busy")
    )
    changed = F.col("_own").isNotNull()
    outcome = (
        F.when(changed & (event == "create"), "created")
        .when(changed & (event == "claim"), "claimed")
        .when(changed, "ok")
        .when((event == "create") | ((event == "fail") & worker.isNull()), "ignored")
        .when(event == "claim", refused)
        .when(F.coalesce(owned, F.lit(False)), "ok")
        .otherwise("lease_lost")
    )
    return leased.select(
        "job_id",
        "us",
        "seq",
        "event",
        "worker_id",
        outcome.alias("outcome"),
        F.col("_at.status").alias("status_after"),
        F.col("_at.owner").alias("owner_after"),
        F.coalesce("_at.attempts", F.lit(0)).alias("attempts_after"),
    )


def _state_changes(rows: DataFrame, lease_us: int, max_attempts: int, hot: Hot) -> DataFrame:
    """Rows that change a job's state, with the state after them. Each round finds the next
    change of every job; creation, capped claims, their releases and the end bound the rounds."""
    event, worker = F.col("event"), F.col("worker_id")
    none = F.lit(None).cast("string")
    current = (
        rows.select("job_id")
        .distinct()
        .select(
            "job_id", F.lit(NEVER).alias("c_us"), F.lit(NEVER).alias("c_seq"), none.alias("status"),
            none.alias("owner"), F.lit(0).alias("attempts"),
        )
    )
    found = None
    for _ in range(2 * max_attempts + 2):
        later = F.struct("us", "seq") > F.struct("c_us", "c_seq")
        ahead = rows.join(F.broadcast(current), "job_id").where(later)
        owned = worker == F.col("owner")
        beat = F.when((event == "heartbeat") & owned, F.col("us"))
        scanned = prefix_scan(
            ahead, ["job_id"], ["us", "seq"], {"_beat": ("max", beat, False)}, hot_rows=hot
        )
        expired = F.greatest("_beat", "c_us") + lease_us < F.col("us")
        taken = (event == "claim") & (F.col("attempts") < max_attempts)
        ended = (event == "fail") & worker.isNull()
        changes = (
            F.when(F.col("status").isNull(), event == "create")
            .when(F.col("status") == "queued", taken | ended)
            .when(
                F.col("status") == "processing",
                (event.isin("complete", "fail", "release") & owned) | ended | (taken & expired),
            )
        )
        following = (
            scanned.where(F.coalesce(changes, F.lit(False)))
            .groupBy("job_id")
            .agg(F.min(F.struct("us", "seq", "event", "worker_id")).alias("_n"))
        )
        happened = F.col("_n.event")
        current = cut_lineage(
            current.join(following, "job_id").select(
                "job_id",
                F.col("_n.us").alias("c_us"),
                F.col("_n.seq").alias("c_seq"),
                F.when(happened == "claim", "processing")
                .when(happened == "complete", "succeeded")
                .when(happened == "fail", "failed")
                .otherwise("queued")
                .alias("status"),
                F.when(happened == "claim", F.col("_n.worker_id"))
                .when(happened != "release", F.col("owner"))
                .alias("owner"),
                F.when(happened == "claim", F.col("attempts") + 1)
                .otherwise(F.col("attempts"))
                .alias("attempts"),
            )
        )
        if current.isEmpty():
            break
        found = current if found is None else found.unionByName(current)
    return current if found is None else found


def _fold(rows: DataFrame, lease_us: int, max_attempts: int) -> DataFrame:
    names = ["job_id", "us", "seq", "event", "worker_id"]
    kinds = [f.dataType for f in _CONTROL_SCHEMA]
    fields = [f.name for f in _CONTROL_SCHEMA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, state = None, NEW
        for batch in batches:
            out = []
            for row in rows_of(iter([batch]), names):
                if row["job_id"] != job:
                    job, state = row["job_id"], NEW
                state, outcome = advance(
                    state, row, lease_us=lease_us, max_attempts=max_attempts
                )
                out.append((*row.values(), outcome, state["status"], state["worker_id"],
                            state["attempts"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), type=_ARROW[type(k)]) for v, k in zip(zip(*out), kinds)],
                names=fields,
            )

    return (
        rows.select(*names)
        .repartition("job_id")
        .sortWithinPartitions("job_id", "us", "seq")
        .mapInArrow(run, _CONTROL_SCHEMA)
    )


_ARROW = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32()}


def job_states(outcomes: DataFrame) -> DataFrame:
    """Final state per job of :func:`event_outcomes`, with accepted and rejected writes."""
    last = F.max_by(
        F.struct("status_after", "owner_after", "attempts_after"),
        F.when(F.col("event").isin(*CONTROL), F.struct("us", "seq")),
    )
    return (
        outcomes.groupBy("job_id")
        .agg(
            last.alias("_s"),
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("outcome") == "lease_lost").alias("lease_lost"),
        )
        .select(
            "job_id",
            F.col("_s.status_after").alias("status"),
            F.col("_s.owner_after").alias("worker_id"),
            F.coalesce("_s.attempts_after", F.lit(0)).alias("attempts"),
            "events",
            "lease_lost",
        )
    )


def lease_lost(outcomes: DataFrame) -> DataFrame:
    """The side output of rejected writes."""
    return outcomes.where(F.col("outcome") == "lease_lost")


def stalls(
    messages: DataFrame,
    keys: list[str],
    *,
    timeout_us: int,
    order: tuple[str, ...] = ("us", "seq"),
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Rows whose key stays silent for at least ``timeout_us`` before its next row: where an
    undisturbed message would be delivered again."""
    following = prefix_scan(
        messages, keys, list(order), {"_next": ("last", F.col("us"), False)}, reverse=True,
        hot_rows=hot_rows,
    )
    idle = F.col("_next") - F.col("us")
    return (
        following.where(idle >= timeout_us)
        .withColumn("idle_us", idle)
        .withColumn("redelivered_us", F.col("us") + timeout_us)
        .drop("_next", "_slice", "_hot")
    )


def queue_counts(log: DataFrame, keys: list[str]) -> DataFrame:
    """Consumer lag and pending messages from a message log with ``event`` produced, delivered
    or acked; redeliveries count once."""
    per_message = log.groupBy(*keys, "message_id").agg(
        F.max(F.col("event") == "produced").alias("p"),
        F.max(F.col("event") == "delivered").alias("d"),
        F.max(F.col("event") == "acked").alias("a"),
    )
    return per_message.groupBy(*keys).agg(
        (F.count_if("p") - F.count_if(F.col("p") & F.col("d"))).alias("lag"),
        F.count_if(F.col("d") & ~F.col("a")).alias("pending"),
    )
