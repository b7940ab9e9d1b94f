"""Streams that hold rows back to the watermark and whose states end, against plain folds and the batch twins."""

import random

import pytest
from pyspark.sql import functions as F
from test_streaming import T0, job_log, same

from speechframe.operators import breaker, jobs, lifecycle, outbox, ratelimit
from speechframe.streaming import stateful

FAR = T0 + 10_000_000


def shuffled(spark, tmp_path, df, name, *, slack, last, seed=1):
    """A stream that reads rows in files, out of order by less than ``slack`` seconds, then the row ``last``, far
    later, which lets the watermark pass them all."""
    rng = random.Random(seed)
    rows = sorted(df.collect(), key=lambda r: r["s"] + rng.random() * slack)
    assert [r["s"] for r in rows] != sorted(r["s"] for r in rows)
    folder = str(tmp_path / name)
    for part in (rows[: len(rows) // 3], rows[len(rows) // 3 : len(rows) // 2], rows[len(rows) // 2 :], [last]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, tmp_path, name):
    """Rows of the stream, and its progress."""
    out = str(tmp_path / f"{name}-out")
    query = (
        df.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(300)
    return df.sparkSession.read.schema(df.schema).parquet(out), query.recentProgress


def far(df, **values):
    """A row far later, of a key of its own."""
    empty = dict.fromkeys(df.columns)
    return tuple({**empty, "s": FAR, **values}[c] for c in df.columns)


def stamped(df):
    return df.withColumn("ts", F.timestamp_seconds("s"))


def left(progress):
    """Rows of state at the end."""
    return progress[-1].stateOperators[0].numRowsTotal


def test_held_lifecycle_equals_batch(spark, tmp_path):
    log = job_log(spark)
    batch = lifecycle.event_outcomes(log, lease_s=60, max_attempts=3)
    columns = ["job_id", "us", "seq", "event", "worker_id", "outcome", "status_after", "attempts_after"]
    source = shuffled(spark, tmp_path, log.drop("ts"), "in", slack=100, last=far(log.drop("ts"), job_id="z", seq=-1, event="create"))
    found, progress = run(stateful.job_lifecycle(stamped(source), lease_s=60, max_attempts=3, delay="120 seconds"), tmp_path, "l")
    same(found.where("job_id <> 'z'"), batch.select(columns), "seq")
    # All jobs have ended but that of the last row, of which only held rows and an alarm are left.
    assert left(progress) <= 4


def test_held_rate_limit_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"r{i:04d}", T0 + i * 5 + rng.randrange(5), f"k{rng.randrange(4)}", "write", 1, 3) for i in range(150)]
    df = spark.createDataFrame(rows, "request_id string, s bigint, api_key string, bucket string, cost int, `limit` bigint")
    batch = ratelimit.rate_limit(stamped(df)).select("api_key", "bucket", "request_id", "allowed", "remaining", "reset_s")
    last = far(df, request_id="z", api_key="z", bucket="z", cost=1, limit=1)
    source = shuffled(spark, tmp_path, df, "in", slack=50, last=last)
    found, progress = run(stateful.rate_limit(stamped(source), delay="60 seconds"), tmp_path, "r")
    same(found.where("api_key <> 'z'"), batch, "request_id")
    assert left(progress) <= 4


def test_held_breaker_and_outbox_equal_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"e{rng.randrange(2)}", i, T0 + i * 9, rng.random() < 0.4) for i in range(120)]
    df = spark.createDataFrame(rows, "engine string, seq bigint, s bigint, ok boolean")
    batch = breaker.breaker_timeline(stamped(df), threshold=3, reset_s=60).drop("ts", "s", "ok")
    source = shuffled(spark, tmp_path, df, "b", slack=80, last=far(df, engine="z", seq=-1, ok=True))
    found, _ = run(stateful.breaker_timeline(stamped(source), threshold=3, reset_s=60, delay="90 seconds"), tmp_path, "b")
    same(found.where("engine <> 'z'"), batch, "seq")
    rows = [
        (f"j{rng.randrange(6)}", T0 + i * 11, i, rng.choice(["claim", "result"]), rng.choice([200, 503, 404, 429, None, 500]))
        for i in range(150)
    ]
    df = spark.createDataFrame(rows, "job_id string, s bigint, seq bigint, event string, http_status int")
    source = shuffled(spark, tmp_path, df, "o", slack=100, last=far(df, job_id="z", seq=-1, event="claim"))
    found, _ = run(stateful.outbox_states(stamped(source), delay="120 seconds"), tmp_path, "o")
    same(found.where("job_id <> 'z'"), outbox.delivery_states(stamped(df)), "seq")


def test_held_first_writer_forgets_keys(spark, tmp_path):
    schema = "request_id string, s bigint, api_key string, idempotency_key string, fingerprint string"
    rng = random.Random(7)
    rows = [(f"r{i:04d}", T0 + i * 10, f"k{rng.randrange(3)}", f"i{rng.randrange(4)}", f"f{rng.randrange(2)}") for i in range(120)]
    df = spark.createDataFrame(rows, schema)
    last = far(df, request_id="z", api_key="z", idempotency_key="z")
    source = shuffled(spark, tmp_path, df, "a", slack=50, last=last)
    found, _ = run(stateful.first_writer(stamped(source), delay="60 seconds", keep_s=10_000), tmp_path, "a")
    batch = jobs.first_writer(stamped(df)).select("api_key", "idempotency_key", "request_id", "winner", "outcome")
    same(found.where("api_key <> 'z'"), batch, "request_id")
    # Keys that last 300 seconds: as a plain fold that starts a key anew.
    want, open_keys = {}, {}
    for rid, s, api, key, print_ in sorted(rows, key=lambda r: (r[1], r[0])):
        held = open_keys.get((api, key))
        if held is None or s > held[2] + 300:
            held = open_keys[api, key] = (rid, print_, s)
            want[rid] = (rid, "created")
        else:
            want[rid] = (held[0], "replayed" if held[1] == print_ else "conflict")
    assert sum(x[1] == "created" for x in want.values()) > 12
    source = shuffled(spark, tmp_path, df, "b", slack=50, last=last, seed=2)
    found, progress = run(stateful.first_writer(stamped(source), delay="60 seconds", keep_s=300), tmp_path, "b")
    got = {r.request_id: (r.winner, r.outcome) for r in found.where("api_key <> 'z'").collect()}
    assert got == want and left(progress) <= 4


@pytest.mark.parametrize("late", [False, True])
def test_rows_later_than_the_delay_are_dropped_and_counted(spark, tmp_path, late):
    schema = "request_id string, s bigint, api_key string, idempotency_key string, fingerprint string"
    folder = str(tmp_path / "in")
    parts = [
        [("b", T0 + 50, "k", "i", "f"), ("a", T0 + 20, "k", "i", "f")],
        [("other", T0 + 1000, "x", "i", "f")],
        # From here on the watermark is at T0 + 940, and from the next batch on rows before it are late.
        [("more", T0 + 1000, "x", "i", "f")],
        [("c", T0 + (10 if late else 950), "k", "i", "f")],
        [("z", FAR, "z", "z", "f")],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found, progress = run(stateful.first_writer(stamped(source), delay="60 seconds"), tmp_path, "x")
    got = {r.request_id: (r.winner, r.outcome) for r in found.where("api_key = 'k'").collect()}
    kept = {"a": ("a", "created"), "b": ("a", "replayed")}
    assert got == (kept if late else kept | {"c": ("a", "replayed")})
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress if p.stateOperators) == int(late)
