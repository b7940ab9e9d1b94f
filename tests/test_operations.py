"""Keys, urls, job tables, admission, outbox, metrics."""

import hashlib
import hmac
import uuid

from pyspark.sql import functions as F

from speechframe.functions import ids, urls
from speechframe.operators import admission, jobs, lifecycle, metrics, outbox
from speechframe.schema import API_KEYS, ERROR_CODES, JOBS
from speechframe.sources import sinks

NOW = "2024-05-01 12:00:00"


def job_rows(spark, rows):
    """Jobs with NULL for columns that are not given."""
    df = spark.createDataFrame([], JOBS)
    types = {f.name: f.dataType for f in df.schema}
    given = sorted({k for r in rows for k in r})
    plain = spark.createDataFrame([tuple(r.get(k) for k in given) for r in rows],
                                  ", ".join(f"{k} {'int' if types[k].simpleString() == 'int' else 'double' if types[k].simpleString() == 'double' else 'string'}" for k in given))
    return plain.select(*[(F.col(n) if n in given else F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def test_event_id_equals_uuid5(spark):
    pairs = [(str(uuid.UUID(int=i * 7**40 % 2**128)), s) for i in range(1, 40) for s in ("succeeded", "failed")]
    df = spark.createDataFrame(pairs, "j string, s string")
    got = df.select("j", "s", ids.event_id(F.col("j"), F.col("s")).alias("e")).collect()
    assert all(r.e == str(uuid.uuid5(uuid.UUID(r.j), r.s)) for r in got)


def test_object_keys(spark):
    a, b = str(uuid.uuid4()), str(uuid.uuid4())
    keys = {f"up/{a}/{b}": True, f"up/{a.upper()}/{b}": False, f"{a}/{b}": False, f"up/{{{a}}}/{b}": False, f"up/{a}/{b}/": False,
            f"up/{a.replace('-', '')}/{b}": False, f"up/{a}/{b}\n": False, "": False}
    df = spark.createDataFrame([(k,) for k in keys], "k string").withColumn("p", ids.parse_object_key(F.col("k"), "up/"))
    assert {r.k: r.p is not None for r in df.collect()} == keys


def test_signatures(spark):
    body, now = '{"x":1}', 1_700_000_000

    def mark(secret, t):
        return hmac.new(secret.encode(), f"{t}.{body}".encode(), hashlib.sha256).hexdigest()

    good = mark("s", now)
    headers = {
        f"t={now},v1={good}": True, f"t={now},v1=bad,v1={good}": True, f"t={now}, v1={good}": True, f"t={now},v1={mark('old', now)}": False,
        f"t={now - 300},v1={mark('s', now - 300)}": True, f"t={now - 301},v1={mark('s', now - 301)}": False,
        f"t={now + 301},v1={mark('s', now + 301)}": False, f"v1={good}": False, f"t={now}": False, f"t={now},t={now},v1={good}": False,
        "": False, "nonsense": False, f"t=x,v1={good}": False, f"t={now},v1={good},junk": False,
    }
    df = spark.createDataFrame([(h,) for h in headers], "h string")
    ok = ids.signature_valid(F.lit("s"), F.lit(body), F.col("h"), F.lit(now))
    assert {r.h: r.ok for r in df.withColumn("ok", ok).collect()} == headers
    signed = df.limit(1).select(ids.signature(F.lit("s"), F.lit(now), F.lit(body)).alias("s")).first().s
    assert signed == f"t={now},v1={good}"


def test_urls(spark):
    cases = {"https://a.example/x": None, "HTTPS://a.example": None, "http://a.example": "scheme", "ftp://a": "scheme", "a.example": "scheme",
             "https://u:p@a.example": "credentials", "https://a.example:99999/": "port", "https://a.example:x/": "port", "https://a.example:8443/": None,
             "https:///path": "host", "https://[2606:4700::1111]/": None, "https://[2606:4700::1111]:444/": None}
    df = spark.createDataFrame([(u,) for u in cases], "u string").withColumn("p", urls.url_problem(F.col("u")))
    assert {r.u: r.p for r in df.collect()} == cases
    addresses = {"8.8.8.8": True, "10.1.1.1": False, "100.64.1.1": False, "127.0.0.1": False, "224.0.0.1": False, "::1": False, "::ffff:8.8.8.8": True,
                 "::ffff:10.0.0.1": False, "64:ff9b::8.8.8.8": True, "64:ff9b::10.0.0.1": False, "2001:4860:4860::8888": True, "fec0::1": False, "junk": False}
    assert {a: urls.public_address(a) for a in addresses} == addresses
    target = spark.createDataFrame([("https://a.example", ["8.8.8.8"]), ("https://a.example", ["8.8.8.8", "10.0.0.1"]), ("https://a.example", []),
                                    ("http://a.example", ["8.8.8.8"])], "u string, a array<string>")
    got = target.select(urls.target_problem(F.col("u"), F.col("a")).alias("p"), urls.target_problem(F.col("u"), F.col("a"), allow_private=True).alias("q")).collect()
    assert [r.p for r in got] == [None, "private", "unresolved", "scheme"] and [r.q for r in got] == [None] * 4


def test_authenticate(spark):
    rows = [(f"k{i}", "n", "p", hashlib.sha256(raw).hexdigest(), "s", None, None, None) for i, raw in ((1, b"good"), (2, b"gone"))]
    keys = spark.createDataFrame(rows, API_KEYS).withColumn("revoked_at", F.when(F.col("id") == "k2", F.current_timestamp()))
    asked = spark.createDataFrame([("good",), ("gone",), ("other",), (None,)], "raw_key string").withColumn("n", F.monotonically_increasing_id())
    got = jobs.authenticate(asked, keys).orderBy("n").collect()
    assert [r.api_key_id for r in got] == ["k1", None, None, None]
    assert [r.error_code for r in got] == [None] + ["unauthorized"] * 3


def test_claims_orphans_and_due(spark):
    df = job_rows(spark, [
        {"id": "live", "status": "processing", "attempts": 1, "lease_expires_at": "2024-05-01 12:00:05", "updated_at": NOW},
        {"id": "expired", "status": "processing", "attempts": 1, "lease_expires_at": "2024-05-01 11:55:00", "updated_at": "2024-05-01 11:50:00"},
        {"id": "recent", "status": "processing", "attempts": 1, "lease_expires_at": "2024-05-01 11:59:55", "updated_at": "2024-05-01 11:59:50"},
        {"id": "done", "status": "succeeded", "attempts": 1, "updated_at": "2024-05-01 10:00:00", "webhook_status": "pending", "webhook_next_at": "2024-05-01 11:58:00"},
        {"id": "used", "status": "queued", "attempts": 3, "updated_at": "2024-05-01 10:00:00", "webhook_status": "sending", "webhook_next_at": "2024-05-01 11:57:00"},
        {"id": "fresh", "status": "queued", "attempts": 0, "updated_at": "2024-05-01 11:59:30", "webhook_status": "pending", "webhook_next_at": "2024-05-01 12:01:00"}])
    asked = spark.createDataFrame([(x,) for x in ("live", "expired", "done", "used", "fresh", "none")], "job_id string")
    got = {r.job_id: r.outcome for r in jobs.claim_outcomes(asked, df, now=NOW, max_attempts=3).collect()}
    assert got == {"live": "busy", "expired": "claimed", "done": "terminal", "used": "exhausted", "fresh": "claimed", "none": "missing"}
    lost = jobs.orphans(df, now=NOW, queued_older_than_s=60, lease_grace_s=60, limit=10)
    assert [r.id for r in lost.orderBy("updated_at").collect()] == ["used", "expired"]
    assert [r.id for r in jobs.orphans(df, now=NOW, queued_older_than_s=60, lease_grace_s=60, backlog=True).collect()] == ["expired"]
    assert [r.id for r in jobs.due_deliveries(df, now=NOW, limit=5).collect()] == ["used", "done"]
    touched = jobs.touch_selected(df, lost, now=NOW).where(F.col("updated_at") == jobs.at(NOW))
    assert {r.id for r in touched.collect()} == {"used", "expired", "live"}


def test_pages(spark):
    rows = [{"id": f"{i:02d}", "api_key_id": "a" if i % 3 else "b", "status": "queued" if i % 2 else "failed", "created_at": f"2024-05-01 10:00:{i // 2:02d}"} for i in range(20)]
    df = job_rows(spark, rows)
    page = jobs.list_page(df, "a", limit=4).orderBy("position").collect()
    assert [r.id for r in page] == ["19", "17", "16", "14"] and str(page[0].next_cursor) == "2024-05-01 10:00:07"
    rest = jobs.list_page(df, "a", limit=20, before="2024-05-01 10:00:07").collect()
    assert len(rest) == 9 and rest[0].next_cursor is None
    assert {r.status for r in jobs.list_page(df, "a", limit=20, status="failed").collect()} == {"failed"}
    first = {(r.api_key_id, r.position): r.id for r in jobs.first_pages(df, limit=4).collect()}
    assert [first["a", i] for i in range(1, 5)] == ["19", "17", "16", "14"] and first["b", 1] == "18"
    assert jobs.owned(df, "b", "01").count() == 0 and jobs.owned(df, "b", "00").count() == 1


def test_view_and_updates(spark):
    df = job_rows(spark, [{"id": "j", "status": "succeeded", "chunks_total": 0, "chunks_done": 0, "webhook_url": "https://x", "webhook_status": "pending"},
                          {"id": "k", "status": "failed", "error_code": "undecodable_audio", "error_message": "m"},
                          {"id": "l", "status": "queued", "error_message": "hint", "chunks_total": 3, "chunks_done": 1}])
    view = {r.id: r for r in jobs.job_view(df).collect()}
    assert view["j"].progress.percent == 100.0 and view["j"].links.subtitles.endswith("/j/subtitles") and view["j"].webhook.status == "pending"
    assert view["k"].progress is None and view["k"].error.code == "undecodable_audio" and view["k"].links.subtitles is None
    assert view["l"].error is None and abs(view["l"].progress.percent - 100 / 3) < 1e-9 and view["l"].webhook is None
    facts = spark.createDataFrame([("j", ("wav", None, 2, 16000, 1.0), None, 5)], "job_id string, audio_info struct<container:string,codec:string,channels:int,sample_rate:int,header_duration_s:double>, audio_sha256 string, audio_bytes bigint")
    kept = jobs.record_audio(df.withColumn("audio_sha256", F.lit("old")), facts).where("id = 'j'").first()
    assert (kept.audio_sha256, kept.audio_bytes, kept.audio_info.channels) == ("old", 5, 2)
    stamped = df.limit(1).select(jobs.coalesce_once("started_at", jobs.at(NOW)).alias("t")).first()
    assert str(stamped.t) == NOW


def test_first_writer_and_dedupe(spark):
    rows = [("r1", 1, "a", "i", "f"), ("r2", 2, "a", "i", "f"), ("r3", 3, "a", "i", "g"), ("r4", 4, "b", "i", "g"), ("r5", 5, "a", None, "f"), ("r6", 6, "a", None, "f")]
    df = spark.createDataFrame(rows, "request_id string, ts int, api_key string, idempotency_key string, fingerprint string")
    got = {r.request_id: r.outcome for r in jobs.first_writer(df).collect()}
    assert got == {"r1": "created", "r2": "replayed", "r3": "conflict", "r4": "created", "r5": "created", "r6": "created"}
    best = jobs.earliest_per_fingerprint(df, ["api_key", "fingerprint"], ["ts"])
    assert {(r.api_key, r.fingerprint): (r.request_id, r.copies) for r in best.collect()} == {("a", "f"): ("r1", 4), ("a", "g"): ("r3", 1), ("b", "g"): ("r4", 1)}


def test_asof_and_capacity_also_when_hot(spark):
    known = spark.createDataFrame([("j1", "a", "f", 10, "failed"), ("j2", "a", "f", 20, "queued"), ("j3", "a", "f", 30, "succeeded"), ("j4", "b", "f", 5, "queued")],
                                  "id string, api_key_id string, request_fingerprint string, us bigint, status string")
    asked = spark.createDataFrame([("r1", "a", "f", 15), ("r2", "a", "f", 20), ("r3", "a", "f", 25), ("r4", "a", "f", 99), ("r5", "b", "g", 99)],
                                  "request_id string, api_key_id string, request_fingerprint string, us bigint")
    for hot_rows in (None, 2):
        got = {r.request_id: r.duplicate_of for r in jobs.asof_duplicate(asked, known, hot_rows=hot_rows).collect()}
        assert got == {"r1": None, "r2": None, "r3": "j2", "r4": "j3", "r5": None}
    day = 86_400_000_000
    spans = spark.createDataFrame([(0, 10), (5, 2 * day), (day + 1, day + 9), (8, 10)], "start bigint, end bigint")
    probes = spark.createDataFrame([(i, u) for i, u in enumerate((0, 1, 6, 9, 10, day + 5, 3 * day))], "request_id int, us bigint")
    for hot_rows in (None, 2):
        active = {r.request_id: r.active for r in admission.active_at(probes, spans, hot_rows=hot_rows).collect()}
        assert [active[i] for i in range(7)] == [0, 1, 2, 3, 1, 2, 0]
        line = jobs.concurrency(spans, hot_rows=hot_rows).orderBy("us").collect()
        assert [r.active for r in line] == [1, 2, 3, 1, 2, 1, 0]


def test_admission_order(spark):
    base = {"api_key_id": "a", "allowed": True, "size": 5, "replay_of": None, "active": 0, "supported": True, "duplicate_of": None, "idempotency_key": None, "write": "created"}
    cases = [({}, "created"), ({"api_key_id": None, "allowed": False}, "unauthorized"), ({"allowed": False, "size": 0}, "rate_limited"), ({"size": 0, "replay_of": "x"}, "bad_request"),
             ({"size": 500}, "payload_too_large"), ({"replay_of": "x", "active": 300}, "replayed"), ({"active": 200, "supported": False}, "queue_full"), ({"supported": False, "duplicate_of": "x"}, "unsupported_media_type"),
             ({"duplicate_of": "x"}, "deduplicated"), ({"duplicate_of": "x", "idempotency_key": "i"}, "created"), ({"write": "conflict", "idempotency_key": "i"}, "idempotency_key_reused")]
    schema = "api_key_id string, allowed boolean, size bigint, replay_of string, active bigint, supported boolean, duplicate_of string, idempotency_key string, write string"
    df = spark.createDataFrame([tuple({**base, **c}.values()) for c, _ in cases], schema)
    assert [r.o for r in df.select(admission.outcome(max_bytes=100).alias("o")).collect()] == [w for _, w in cases]
    uploads = spark.createDataFrame([tuple({**base, **c}.values()) for c in ({"size": None}, {"size": 500, "active": 300}, {"size": 500, "supported": False}, {"supported": False})], schema)
    got = [r.o for r in uploads.select(admission.outcome(max_bytes=100, source="upload").alias("o")).collect()]
    assert got == ["not_found", "queue_full", "payload_too_large", "created"]
    batch = spark.createDataFrame([("b", "key", [("x.wav",), ("y.txt",)])], "batch_id string, idempotency_key string, files array<struct<filename:string>>")
    files = admission.expand_batch(batch).orderBy("position").collect()
    assert [(r.idempotency_key, r.cost) for r in files] == [("key:0", 1), ("key:1", 1)]
    results = spark.createDataFrame([("b", 1, "y", 415, None, "unsupported_media_type"), ("b", 0, "x", 202, "j", None)], "batch_id string, position int, filename string, status int, job_id string, error_code string")
    assert [d.status for d in admission.batch_results(results).first().data] == [202, 415]


def test_outbox_case(spark):
    rows = [("j", 0, 0, "claim", None), ("j", 1, 1, "result", 503), ("j", 3, 2, "claim", None), ("j", 6, 3, "claim", None), ("j", 7, 4, "result", 200), ("j", 8, 5, "result", 500)]
    df = spark.createDataFrame(rows, "job_id string, s int, seq bigint, event string, http_status int").withColumn("ts", F.timestamp_seconds("s"))
    got = outbox.delivery_states(df).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["sending", "pending", "not_due", "sending", "delivered", "ignored"]
    assert [r.status for r in got] == ["sending", "pending", "pending", "sending", "delivered", "delivered"]
    state, seen = outbox.IDLE, []
    for i in range(6):
        state, _ = outbox.advance(state, {"event": "claim", "us": i * 10**10})
        state, outcome = outbox.advance(state, {"event": "result", "us": i * 10**10, "http_status": 500})
        seen.append(outcome)
    assert seen == ["pending"] * 4 + ["failed", "ignored"]


def test_events_and_dead_letters(spark):
    job = str(uuid.uuid4())
    df = job_rows(spark, [{"id": job, "status": "failed", "error_code": "x", "error_message": "m", "finished_at": NOW}, {"id": job, "status": "succeeded", "duration_s": 1.5, "language": "en", "finished_at": NOW}, {"id": job, "status": "queued"}])
    got = [r.event for r in outbox.event_rows(df).orderBy("event").collect()]
    assert len(got) == 2
    failed = next(e for e in got if "transcription.failed" in e)
    assert '"error":{"code":"x","message":"m"}' in failed and "duration_s" not in failed and '"created_at":"2024-05-01T12:00:00.000000+00:00"' in failed
    done = next(e for e in got if "transcription.succeeded" in e)
    assert "error" not in done and '"language":"en"' in done
    hooked = outbox.outbox_columns(job_rows(spark, [{"id": "a", "webhook_url": "u"}, {"id": "b"}]), jobs.at(NOW)).orderBy("id").collect()
    assert [r.webhook_status for r in hooked] == ["pending", None]
    messages = spark.createDataFrame([("2", {"z": "1", "job_id": "bad"}), ("1", {"job_id": job.upper()})], "id string, fields map<string,string>")
    good, dead = sinks.route_messages(messages)
    assert good.first().job_id == job
    assert dead.first().raw == '{"job_id":"bad","z":"1"}'


def test_metrics_and_queue(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 1.0, 2), ("a", 9.0, 3), ("b", None, 4)], "l string, v double, t int")
    rows = {(r.l, r.le): r["count"] for r in metrics.histogram(df, F.col("v"), (0.5, 1, 5), ["l"]).collect()}
    assert rows["a", "0.5"] == 1 and rows["a", "1"] == 2 and rows["a", "5"] == 2 and rows["a", "+Inf"] == 3 and rows["b", "+Inf"] == 0
    assert {r.l: r.v for r in metrics.gauges(df, ["l"], "v", ["t"]).collect()} == {"a": 9.0, "b": None}
    assert metrics.approximate(df, ["l"], "t", "v").count() == 2
    log = spark.createDataFrame([("q", 1, "produced"), ("q", 2, "produced"), ("q", 2, "delivered"), ("q", 3, "produced"), ("q", 3, "delivered"), ("q", 3, "delivered"), ("q", 3, "acked")], "q string, message_id int, event string")
    got = lifecycle.queue_counts(log, ["q"]).first()
    assert (got.lag, got.pending) == (1, 1)
    quiet = spark.createDataFrame([("m", i, u) for i, u in enumerate((0, 10, 100, 130, 1000))], "k string, seq int, us bigint")
    for hot_rows in (None, 2):
        found = lifecycle.stalls(quiet, ["k"], timeout_us=90, hot_rows=hot_rows).orderBy("us").collect()
        assert [(r.us, r.idle_us, r.redelivered_us) for r in found] == [(10, 90, 100), (130, 870, 220)]
    visits = quiet.withColumn("event_id", F.col("seq"))
    for hot_rows in (None, 2):
        found = metrics.activity_sessions(visits, ["k"], gap_us=90, hot_rows=hot_rows).orderBy("start_us").collect()
        assert [(r.start_us, r.last_us, r.n) for r in found] == [(0, 130, 4), (1000, 1000, 1)]
    keep = jobs.newest_messages(quiet, 2, "seq")
    assert {r.seq for r in keep.collect()} == {3, 4}


def test_small_expressions(spark):
    df = spark.createDataFrame([("abc-1",), ("bad id",), (None,)], "h string")
    got = [r[0] for r in df.select(ids.request_id(F.col("h"))).collect()]
    assert got[0] == "abc-1" and len(got[1]) == 36 and len(got[2]) == 36
    one = spark.range(1)
    assert one.select(ids.media_type(F.lit(" Multipart/Form-Data ; boundary=x"))).first()[0] == "multipart/form-data"
    assert len(one.select(ids.short_error(F.lit("x" * 900))).first()[0]) == 500
    assert one.select(ids.object_identity(F.lit("k"), F.lit(None))).first()[0] == "s3:k:"
    assert one.select(ids.key_prefix(F.lit("tx_0123456789"))).first()[0] == "tx_0123456"
    value = one.select(outbox.jitter_s(F.lit(2), 1.0, 7)).first()[0]
    assert 0 <= value < 4
    codes = spark.createDataFrame([(c,) for c in ERROR_CODES] + [(None,)], "error_code string")
    assert {r.error_code: (r.error_status, r.retryable) for r in jobs.error_facts(codes).collect()} == {**ERROR_CODES, None: (None, None)}
    same = [F.lit("en").alias("language")]
    a, b = one.select(ids.fingerprint(F.lit("x"), same), ids.fingerprint(F.lit("y"), same)).first()
    assert a != b and len(a) == 64
