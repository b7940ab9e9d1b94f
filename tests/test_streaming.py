"""Streams give what the batch twins give on the same log, also across restarts."""

import random

import pytest
from pyspark.sql import functions as F

from speechframe.operators import breaker, jobs, lifecycle, outbox, ratelimit
from speechframe.schema import DELIVERIES, JOB_EVENTS
from speechframe.streaming import jobs as streams
from speechframe.streaming import stateful

T0 = 1_700_000_000


def stream(spark, tmp_path, df, parts, name, order="s"):
    """Write ``df`` as ``parts`` files in time order and read them as a stream, a file at a time."""
    folder = str(tmp_path / name)
    rows = df.count()
    ranked = df.orderBy(order).toPandas()
    for i in range(parts):
        part = ranked.iloc[i * rows // parts : (i + 1) * rows // parts]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, tmp_path, name):
    query = (
        df.writeStream.format("parquet")
        .option("path", str(tmp_path / f"{name}-out"))
        .option("checkpointLocation", str(tmp_path / f"{name}-cp"))
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(240)
    return df.sparkSession.read.parquet(str(tmp_path / f"{name}-out"))


def same(a, b, *order):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert a.select(columns).orderBy(*order).collect() == b.select(columns).orderBy(*order).collect()


def job_log(spark, n=240, seed=11):
    rng = random.Random(seed)
    kinds = ["claim", "claim", "heartbeat", "heartbeat", "chunk", "release", "complete", "fail"]
    rows, t = [], T0
    for i in range(n):
        t += rng.randrange(1, 15)
        job = f"j{rng.randrange(12)}"
        kind = "create" if i < 24 else rng.choices(kinds, [6, 6, 8, 8, 8, 2, 1, 1])[0]
        worker = None if kind == "create" or (kind == "fail" and rng.random() < 0.5) else f"w{rng.randrange(3)}"
        rows.append((job, t, i, kind, worker))
    df = spark.createDataFrame(rows, "job_id string, s bigint, seq bigint, event string, worker_id string")
    return df.withColumn("ts", F.timestamp_seconds("s"))


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    log = job_log(spark)
    batch = lifecycle.event_outcomes(log, lease_s=60, max_attempts=3)
    columns = ["job_id", "us", "seq", "event", "worker_id", "outcome", "status_after", "attempts_after"]
    found = stateful.job_lifecycle(stream(spark, tmp_path, log, 3, "log"), lease_s=60, max_attempts=3)
    same(run(found, tmp_path, "life"), batch.select(columns), "seq")
    outcomes = {r[0] for r in batch.select("outcome").distinct().collect()}
    assert {"created", "claimed", "ok", "lease_lost", "busy"} <= outcomes


def test_lifecycle_of_hot_jobs(spark):
    log = job_log(spark, 260, 5).withColumn("job_id", F.when(F.col("seq") % 3 == 0, F.col("job_id")).otherwise("hot"))
    early = F.col("event").isin("complete", "fail") & (F.col("seq") < 245)
    log = log.withColumn("event", F.when(early, "release").otherwise(F.col("event")))
    want, states = [], {}
    for r in log.orderBy("seq").collect():
        row = {"event": r.event, "worker_id": r.worker_id, "us": r.s * 1_000_000}
        state = states.get(r.job_id, lifecycle.NEW)
        states[r.job_id], outcome = lifecycle.advance(state, row, lease_us=20_000_000, max_attempts=4)
        after = states[r.job_id]
        want.append((outcome, after["status"], after["worker_id"], after["attempts"]))
    assert {"claimed", "busy", "exhausted", "lease_lost", "ok"} <= {w[0] for w in want}
    for hot_rows in (None, 40):
        found = lifecycle.event_outcomes(log, lease_s=20, max_attempts=4, hot_rows=hot_rows).orderBy("seq").collect()
        assert [(r.outcome, r.status_after, r.owner_after, r.attempts_after) for r in found] == want


def test_rate_limit_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"r{i:04d}", T0 + i * 5 + rng.randrange(5), f"k{rng.randrange(4)}", "write", 1, 3) for i in range(150)]
    df = spark.createDataFrame(rows, "request_id string, s bigint, api_key string, bucket string, cost int, `limit` bigint")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    batch = ratelimit.rate_limit(df).select("api_key", "bucket", "request_id", "allowed", "remaining", "reset_s")
    same(run(stateful.rate_limit(stream(spark, tmp_path, df, 3, "in")), tmp_path, "rate"), batch, "request_id")


def test_breaker_stream(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"e{rng.randrange(2)}", i, T0 + i * 9, rng.random() < 0.4) for i in range(120)]
    df = spark.createDataFrame(rows, "engine string, seq bigint, s bigint, ok boolean").withColumn("ts", F.timestamp_seconds("s"))
    batch = breaker.breaker_timeline(df, threshold=3, reset_s=60).drop("ts", "s", "ok")
    found = stateful.breaker_timeline(stream(spark, tmp_path, df, 3, "in"), threshold=3, reset_s=60)
    same(run(found, tmp_path, "breaker"), batch, "seq")


def test_outbox_stream(spark, tmp_path):
    rng = random.Random(6)
    rows = [
        (f"j{rng.randrange(6)}", T0 + i * 11, i, rng.choice(["claim", "result"]), rng.choice([200, 503, 404, 429, None, 500]))
        for i in range(150)
    ]
    df = spark.createDataFrame(rows, "job_id string, s bigint, seq bigint, event string, http_status int")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    found = stateful.outbox_states(stream(spark, tmp_path, df, 3, "in"))
    same(run(found, tmp_path, "outbox"), outbox.delivery_states(df), "seq")


def test_first_writer_stream(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"r{i:04d}", T0 + i, f"k{rng.randrange(3)}", f"i{rng.randrange(12)}", f"f{rng.randrange(2)}") for i in range(100)]
    df = spark.createDataFrame(rows, "request_id string, s bigint, api_key string, idempotency_key string, fingerprint string")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    batch = jobs.first_writer(df).select("api_key", "idempotency_key", "request_id", "winner", "outcome")
    same(run(stateful.first_writer(stream(spark, tmp_path, df, 2, "in")), tmp_path, "idem"), batch, "request_id")


def test_redelivery_timer(spark, tmp_path):
    rows = [("a", T0, "deliver"), ("b", T0, "deliver"), ("c", T0, "deliver"), ("b", T0 + 50, "heartbeat"),
            ("c", T0 + 20, "ack"), ("z", T0 + 70, "deliver"), ("z", T0 + 500, "ack"), ("y", T0 + 900, "deliver")]
    df = spark.createDataFrame(rows, "message_id string, s bigint, event string").withColumn("ts", F.timestamp_seconds("s"))
    found = stateful.redeliveries(stream(spark, tmp_path, df, 8, "in"), timeout_s=60)
    got = {(r[0], r[1] // 1000 - T0) for r in run(found, tmp_path, "vis").collect()}
    assert ("a", 60) in got and ("b", 110) in got
    assert not any(m == "c" for m, _ in got)


def test_windows_unique_and_routing(spark, tmp_path):
    rows = [(f"e{i % 40}", T0 + (i % 40) * 7, "view", float(i % 40)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, s bigint, kind string, value double").withColumn("ts", F.timestamp_seconds("s"))
    unique = streams.unique_events(stream(spark, tmp_path, df, 2, "a", "id"), ["id"], delay="1 hour")
    assert run(unique, tmp_path, "u").count() == 40
    late = spark.createDataFrame([("z", T0 + 90_000, "view", 0.0)], "id string, s bigint, kind string, value double")
    df2 = df.dropDuplicates(["id"]).unionByName(late.withColumn("ts", F.timestamp_seconds("s")))
    counted = streams.windowed_metrics(
        stream(spark, tmp_path, df2, 2, "b"), ["kind"], delay="10 seconds", length="1 minute"
    )
    got = run(counted, tmp_path, "w")
    assert got.agg(F.sum("n")).first()[0] == 40

    uuid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    messages = spark.createDataFrame(
        [("1", {"job_id": uuid}), ("2", {"job_id": "nope"}), ("3", {"other": "x"})], "id string, fields map<string,string>"
    )
    source = stream(spark, tmp_path, messages, 1, "m", "id")
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    query = (
        source.writeStream.foreachBatch(streams.route_to_dead_letters(good, dead))
        .option("checkpointLocation", str(tmp_path / "mcp")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    assert [r.id for r in spark.read.parquet(good).collect()] == ["1"]
    assert sorted(r.id for r in spark.read.schema("id string, reason string").json(dead).collect()) == ["2", "3"]


@pytest.mark.parametrize("schema", [JOB_EVENTS, DELIVERIES])
def test_schemas_parse(spark, schema):
    assert spark.createDataFrame([], schema).columns
