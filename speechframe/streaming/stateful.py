"""Per-key state machines on streams; each shares its step function with the batch form.

With a ``delay`` rows are held back until the watermark has passed them and then applied in event order, so
the result doesn't depend on how they were dealt to micro-batches; rows that come later than the delay are
dropped by Spark and counted in the query's progress. A key's state ends: a row beyond its end
finds a new one, and a timer removes what nobody asked for again. What is kept is the rows
within the delay and one small row for each key that hasn't ended.

Without a ``delay`` the rows of each micro-batch are applied at once, in event order inside it, and state stays:
the form for replaying a complete log that is read in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, IntegralType, StructType

from speechframe.functions.timing import epoch_us
from speechframe.operators import lifecycle, outbox
from speechframe.operators.breaker import Breaker
from speechframe.operators.ordered import NEVER

Step = Callable[[dict, dict], tuple[dict, dict]]


class Fold(StatefulProcessor):
    """Applies ``step(state, row) -> (state, output)`` to the rows of a key in order."""

    def __init__(
        self, keys: Sequence[str], order: Sequence[str], state: str, initial: dict, output: str, step: Step
    ):
        self.keys, self.order, self.step = list(keys), list(order), step
        self.state_type, self.initial = StructType.fromDDL(state), initial
        self.columns = StructType.fromDDL(output).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", self.state_type)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = list(self.initial)
        state = dict(self.initial)
        if self.value.exists():
            state = dict(zip(names, self.value.get()))
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order)
        columns = {c: [None if pd.isna(v) else v for v in batch[c].tolist()] for c in batch.columns}
        out = []
        for values in zip(*columns.values()):
            row = dict(zip(columns, values))
            state, result = self.step(state, row)
            out.append({**dict(zip(self.keys, key)), **result})
        self.value.update(tuple(state[n] for n in names))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


#: Until when a state lasts after a row, in microseconds of event time; a row later than that finds a new one.
Ends = Callable[[dict, dict], int]


class HeldFold(StatefulProcessor):
    """As :class:`Fold`, over rows held back to the watermark, with states that end."""

    def __init__(
        self, keys: Sequence[str], order: Sequence[str], rows: str, state: str, initial: dict, output: str,
        step: Step, ends: Ends,
    ):
        self.keys, self.order, self.step, self.ends = list(keys), list(order), step, ends
        self.row_type = StructType.fromDDL(rows)
        self.state_type, self.initial = StructType.fromDDL(f"{state}, _until bigint"), initial
        self.alarm_type = StructType.fromDDL("ms bigint")
        self.columns = StructType.fromDDL(output).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", self.state_type)
        self.held = handle.getListState("held", self.row_type)
        self.alarm = handle.getValueState("alarm", self.alarm_type)

    def _ring(self, us: int) -> None:
        """One timer per key, at the earliest time anything is due."""
        ms = -(-us // 1000)
        if self.alarm.exists():
            before = int(self.alarm.get()[0])
            if before <= ms:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ms)
        self.alarm.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            columns = [_plain(batch[f.name], f.dataType) for f in self.row_type]
            self.held.appendList(list(zip(*columns)))
            self._ring(int(batch["us"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        names = self.row_type.names
        due, rest = [], []
        for values in self.held.get() if self.held.exists() else ():
            row = dict(zip(names, values))
            (due if row["us"] <= passed else rest).append(row)
        state, until = dict(self.initial), None
        if self.value.exists():
            *values, until = self.value.get()
            state = dict(zip(self.initial, values))
        out = []
        for row in sorted(due, key=lambda r: [r[c] for c in self.order]):
            if until is not None and row["us"] > until:
                state = dict(self.initial)
            state, result = self.step(state, row)
            until = self.ends(state, row)
            out.append({**dict(zip(self.keys, key)), **result})
        if rest:
            self.held.put([tuple(r[c] for c in names) for r in rest])
            self._ring(min(r["us"] for r in rest))
        elif due:
            self.held.clear()
        if until is not None and until <= passed:
            self.value.clear()
        elif until is not None:
            self.value.update((*[state[n] for n in self.initial], until))
            self._ring(until)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _plain(column: pd.Series, kind: DataType) -> list:
    """Values as the state store takes them; a column of whole numbers with gaps comes as floats."""
    values = [None if pd.isna(v) else v for v in column.tolist()]
    return [None if v is None else int(v) for v in values] if isinstance(kind, IntegralType) else values


def _fold(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, initial: dict, output: str, step: Step,
    delay: str | None, ends: Ends,
) -> DataFrame:
    if delay is not None:
        fields = [f for f in rows.schema if f.name not in (*keys, "ts")]
        held = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
        return rows.withWatermark("ts", delay).groupBy(*keys).transformWithStateInPandas(
            statefulProcessor=HeldFold(keys, order, held, state, initial, output, step, ends),
            outputStructType=StructType.fromDDL(output),
            outputMode="append",
            timeMode="eventTime",
        )
    rows = rows.drop("ts")
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Fold(keys, order, state, initial, output, step),
        outputStructType=StructType.fromDDL(output),
        outputMode="append",
        timeMode="none",
    )


DAY_S = 86_400


def _after_last(keep_s: int) -> Ends:
    """A key without rows for so long is forgotten."""
    return lambda state, row: row["us"] + keep_s * 1_000_000


def job_lifecycle(
    events: DataFrame, *, lease_s: int, max_attempts: int, delay: str | None = None, keep_s: int = 7 * DAY_S
) -> DataFrame:
    """Outcome of every event of a job log stream (see ``operators.lifecycle``). A job without events for
    ``keep_s`` is forgotten; an event after that finds no job."""

    def step(state, row):
        lease = state["lease"]
        state = {**state, "lease": None if lease is None else int(lease)}
        state, outcome = lifecycle.advance(
            state, row, lease_us=lease_s * 1_000_000, max_attempts=max_attempts
        )
        return state, {
            "us": row["us"], "seq": row["seq"], "event": row["event"], "worker_id": row["worker_id"],
            "outcome": outcome, "status_after": state["status"], "attempts_after": state["attempts"],
        }

    rows = events.select("job_id", epoch_us(F.col("ts")).alias("us"), "seq", "event", "worker_id", "ts")
    output = (
        "job_id string, us bigint, seq bigint, event string, worker_id string, outcome string, "
        "status_after string, attempts_after int"
    )
    state = "status string, worker_id string, lease bigint, attempts int"
    return _fold(
        rows, ["job_id"], ["us", "seq"], state, lifecycle.NEW, output, step, delay, _after_last(keep_s)
    )


def rate_limit(requests: DataFrame, *, window_s: int = 60, delay: str | None = None) -> DataFrame:
    """Decisions for a request stream with ``limit`` and ``cost`` (see ``operators.ratelimit``). State ends with
    its window, as the next request would open another one anyway."""
    length = window_s * 1_000_000

    def step(state, row):
        fresh = state["ends"] is None or row["us"] >= state["ends"]
        ends = row["us"] + length if fresh else state["ends"]
        count = row["cost"] + (0 if fresh else state["n"])
        left = row["limit"] - count
        return {"ends": ends, "n": count}, {
            "request_id": row["request_id"], "allowed": left >= 0, "remaining": max(0, left),
            "reset_s": max(1, -((row["us"] - ends) // 1_000_000)),
        }

    rows = requests.select(
        "api_key", "bucket", "request_id", epoch_us(F.col("ts")).alias("us"),
        F.col("cost").cast("bigint").alias("cost"), F.col("limit").cast("bigint").alias("limit"), "ts",
    )
    output = (
        "api_key string, bucket string, request_id string, allowed boolean, remaining bigint, reset_s bigint"
    )
    return _fold(
        rows, ["api_key", "bucket"], ["us", "request_id"], "ends bigint, n bigint",
        {"ends": None, "n": 0}, output, step, delay, lambda state, row: state["ends"] - 1,
    )


def breaker_timeline(
    attempts: DataFrame, *, threshold: int, reset_s: int, delay: str | None = None, keep_s: int = 7 * DAY_S
) -> DataFrame:
    """Breaker states for an attempt stream ``(engine, ts, seq, ok)``. An engine without attempts for
    ``keep_s`` starts afresh, closed."""
    machine = Breaker(threshold, reset_s * 1_000_000)

    def step(state, row):
        facts = {"_us": row["us"], "_ok": row["ok"]}
        moved = machine.next((state["tag"], state["wake"]), facts, row["us"], False)
        closed = state["tag"] < threshold
        met = "closed" if closed else "half_open" if moved else "open"
        tag, wake = moved or (state["tag"], state["wake"])
        return {"tag": tag, "wake": wake}, {
            "seq": row["seq"], "state": met, "admitted": moved is not None,
            "failures": 0 if tag == threshold else tag, "open_after": tag == threshold,
        }

    rows = attempts.select("engine", epoch_us(F.col("ts")).alias("us"), "seq", "ok", "ts")
    output = (
        "engine string, seq bigint, state string, admitted boolean, failures int, open_after boolean"
    )
    return _fold(
        rows, ["engine"], ["us", "seq"], "tag int, wake bigint", {"tag": 0, "wake": NEVER}, output, step,
        delay, _after_last(keep_s),
    )


def outbox_states(
    deliveries: DataFrame, *, lease_s: int = 60, max_attempts: int = 5, delay: str | None = None,
    keep_s: int = 7 * DAY_S,
) -> DataFrame:
    """Outbox states for a delivery log stream (see ``operators.outbox``). A job without deliveries for
    ``keep_s`` is forgotten."""

    def step(state, row):
        code = row["http_status"]
        row = {**row, "http_status": None if code is None else int(code)}
        state, outcome = outbox.advance(
            state, row, lease_us=lease_s * 1_000_000, max_attempts=max_attempts
        )
        return state, {
            "us": row["us"], "seq": row["seq"], "outcome": outcome, "status": state["status"],
            "attempts": state["attempts"],
            "next_us": state["next_us"],
        }

    rows = deliveries.select(
        "job_id", epoch_us(F.col("ts")).alias("us"), "seq", "event", "http_status", "ts"
    )
    output = (
        "job_id string, us bigint, seq bigint, outcome string, status string, attempts int, next_us bigint"
    )
    return _fold(
        rows, ["job_id"], ["us", "seq"], "status string, next_us bigint, attempts int", outbox.IDLE,
        output, step, delay, _after_last(keep_s),
    )


def first_writer(requests: DataFrame, *, delay: str | None = None, keep_s: int = DAY_S) -> DataFrame:
    """Exactly one creation per (api_key, idempotency_key); later requests learn the winner. A key lasts
    ``keep_s`` from its creation and can be used anew then."""

    def step(state, row):
        if state["winner"] is None:
            state = {"winner": row["request_id"], "fingerprint": row["fingerprint"], "at": row["us"]}
            outcome = "created"
        else:
            same = state["fingerprint"] == row["fingerprint"]
            outcome = "replayed" if same else "conflict"
        return state, {
            "request_id": row["request_id"], "winner": state["winner"], "outcome": outcome
        }

    rows = requests.where(F.col("idempotency_key").isNotNull()).select(
        "api_key", "idempotency_key", epoch_us(F.col("ts")).alias("us"), "request_id", "fingerprint", "ts"
    )
    output = (
        "api_key string, idempotency_key string, request_id string, winner string, outcome string"
    )
    return _fold(
        rows, ["api_key", "idempotency_key"], ["us", "request_id"], "winner string, fingerprint string, at bigint",
        {"winner": None, "fingerprint": None, "at": None}, output, step, delay,
        lambda state, row: state["at"] + keep_s * 1_000_000,
    )


class Visibility(StatefulProcessor):
    """Timer per message, pushed out by every delivery or heartbeat and dropped by an ack; when it
    fires, the message would be delivered again."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms
        self.deadline_type = StructType.fromDDL("ms bigint")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", self.deadline_type)

    def _clear(self) -> None:
        if self.deadline.exists():
            self.handle.deleteTimer(int(self.deadline.get()[0]))
            self.deadline.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("us")
        last = batch.iloc[-1]
        self._clear()
        if last["event"] != "ack":
            deadline = int(last["us"]) // 1000 + self.timeout_ms
            self.handle.registerTimer(deadline)
            self.deadline.update((deadline,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.deadline.clear()
        yield pd.DataFrame({"message_id": [key[0]], "redelivered_ms": [at]})

    def close(self) -> None:
        pass


def redeliveries(messages: DataFrame, *, timeout_s: int, delay: str = "0 seconds") -> DataFrame:
    """Messages ``(message_id, ts, event)`` idle for ``timeout_s`` of event time without an ack."""
    rows = messages.withWatermark("ts", delay).select(
        "message_id", "ts", epoch_us(F.col("ts")).alias("us"), "event"
    )
    return rows.groupBy("message_id").transformWithStateInPandas(
        statefulProcessor=Visibility(timeout_s * 1000),
        outputStructType=StructType.fromDDL("message_id string, redelivered_ms bigint"),
        outputMode="append",
        timeMode="eventTime",
    )
