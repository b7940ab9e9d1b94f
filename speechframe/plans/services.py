"""Queries over keys, owners, stored plans, samples, deliveries: operators that no other query reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechframe.functions import ids
from speechframe.operators import admission, assemble, audio, chunks, guards, jobs, outbox
from speechframe.plans.bindings import JOBS_SQL, LINES_SQL, line_segments, load, order_jobs, sql_strip
from speechframe.plans.transcripts import _guard_sql, _reasons

QUERIES = {}
ORACLES = {}

LINE_SAMPLES = 32_000
SPOKEN_SAMPLES = 24_000
WORD = "array<struct<start:double,end:double,text:string,probability:double>>"


def query(oracle: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = oracle
        return fn

    return register


# --- chunk-relative segments, transcript statistics -----------------------------------------


@query(
    f"""WITH {LINES_SQL}, placed AS (SELECT *, chunk * 100.0::DOUBLE AS f, chunk * 100.0::DOUBLE + 99.0 AS t,
  (ord % 50) * 2.0::DOUBLE AS rel FROM segments),
begun AS (SELECT *, least(greatest(f + rel, f), t) AS s, least(greatest(f + (rel - 0.5), f), t) AS ws FROM placed)
SELECT doc_id, ord, text, s AS start, greatest(least(greatest(f + (rel + 1.5), f), t), s) AS "end",
  ws AS word_start, greatest(least(greatest(f + (rel + 5.0), f), t), ws) AS word_end,
  avg_logprob < -0.7 AS low_confidence FROM begun"""
)
def absolute_segments(spark, sf_dir):
    """Lines as segments that count from their chunk's start, with one word each that overlaps the
    chunk's edges, moved to the recording's time."""
    lines = line_segments(spark, sf_dir)
    start = (F.col("ord") % 50) * F.lit(2.0)
    word = F.struct(
        (start - 0.5).alias("start"), (start + 5.0).alias("end"), "text", F.lit(0.5).alias("probability")
    )
    relative = lines.select(
        F.col("doc_id").alias("recording_id"), "chunk", "ord", "text", "avg_logprob",
        start.alias("start"), (start + 1.5).alias("end"), F.array(word).cast(WORD).alias("words"),
        F.lit(None).cast("int").alias("channel"),
    )
    plan = relative.groupBy("recording_id", F.col("chunk").alias("index")).agg(
        F.lit(None).cast("int").alias("channel"),
        (F.col("index") * 1_600_000).alias("start"),
        (F.col("index") * 1_600_000 + 1_584_000).alias("end"),
    )
    first = F.element_at("words", 1)
    return guards.to_absolute(relative, plan).select(
        F.col("recording_id").alias("doc_id"), "ord", "text", "start", "end",
        first["start"].alias("word_start"), first["end"].alias("word_end"), "low_confidence",
    )


@query(
    f"""WITH {_guard_sql(True)}, counted AS (SELECT doc_id, count(*) AS lines,
  count(*) FILTER (WHERE reason IS NULL AND low_confidence) AS low,
  count(*) FILTER (WHERE reason IS NOT NULL) AS dropped FROM reasons GROUP BY doc_id),
sized AS (SELECT doc_id, lines, low, dropped, greatest(n_chars * 100, lines * {LINE_SAMPLES}) AS samples
  FROM counted JOIN documents USING (doc_id))
SELECT doc_id, samples / 16000.0::DOUBLE AS audio_seconds, lines * {SPOKEN_SAMPLES} / 16000.0::DOUBLE AS speech_seconds,
  lines * {LINE_SAMPLES} / 16000.0::DOUBLE AS transcribed_seconds,
  (lines * {SPOKEN_SAMPLES})::DOUBLE / samples::DOUBLE AS speech_ratio, (lines + 49) // 50 AS chunks,
  lines // 50 AS forced_cuts, low AS low_confidence_segments, dropped,
  ((lines + 49) // 50 + 1) // 2 AS primary_chunks FROM sized"""
)
def transcript_totals(spark, sf_dir):
    """Statistics of documents as recordings of two channels: fifty lines are a chunk, a full chunk
    was cut by force, and every other chunk was served by the fallback."""
    reasons = _reasons(spark, sf_dir)
    plan = reasons.groupBy("doc_id", "chunk").agg(
        (F.min("ord") * LINE_SAMPLES).alias("start"),
        ((F.max("ord") + 1) * LINE_SAMPLES).alias("end"),
        (F.count(F.lit(1)) == 50).alias("forced_cut"),
    )
    regions = reasons.select(
        "doc_id", (F.col("ord") * LINE_SAMPLES).alias("start"),
        (F.col("ord") * LINE_SAMPLES + SPOKEN_SAMPLES).alias("end"),
    )
    results = plan.select("doc_id", F.when(F.col("chunk") % 2 == 0, "primary").otherwise("fallback").alias("engine"))
    tracks = plan.select("doc_id", F.col("end").alias("audio_samples")).unionByName(
        load(spark, sf_dir, "documents").where(F.col("text").isNotNull())
        .select("doc_id", (F.col("n_chars") * 100).alias("audio_samples"))
    )
    stats = assemble.transcript_stats(plan, regions, results, reasons, tracks, "doc_id")
    zero = F.lit(0).cast("bigint")
    return stats.select(
        "doc_id", "audio_seconds", "speech_seconds", "transcribed_seconds", "speech_ratio", "chunks",
        "forced_cuts", "low_confidence_segments",
        F.aggregate(F.map_values("dropped_segments"), zero, lambda a, x: a + x).alias("dropped"),
        F.coalesce(F.try_element_at("engines", F.lit("primary")), zero).alias("primary_chunks"),
    )


# --- keys, owners, requests -----------------------------------------------------------------


@query(
    """WITH keys AS (SELECT c_custkey::VARCHAR AS id, sha256('key-' || c_custkey) AS h FROM customer
  WHERE c_custkey % 7 <> 0)
SELECT o_orderkey, id AS api_key_id, CASE WHEN id IS NULL THEN 'unauthorized' END AS error_code
FROM orders LEFT JOIN keys ON h = sha256('key-' || CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_custkey END)"""
)
def authenticate(spark, sf_dir):
    """Orders as requests with their customer's key; some keys are revoked, some unknown."""
    keys = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        ids.key_hash(F.concat(F.lit("key-"), F.col("c_custkey").cast("string"))).alias("key_hash"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("2001-01-01").cast("timestamp")).alias("revoked_at"),
    )
    owner = F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(F.col("o_custkey"))
    requests = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("key-"), owner.cast("string")).alias("raw_key")
    )
    return jobs.authenticate(requests, keys).select("o_orderkey", "api_key_id", "error_code")


@query(
    f"""WITH {JOBS_SQL}, top AS (SELECT max(api_key_id) AS k FROM jobs)
SELECT id, status, row_number() OVER (ORDER BY created_at DESC, id DESC)::INTEGER AS position
FROM jobs, top WHERE api_key_id = k AND status = 'succeeded' AND created_at < TIMESTAMP '2001-01-01'
ORDER BY created_at DESC, id DESC LIMIT 20"""
)
def owner_page(spark, sf_dir):
    """The page before a cursor of one owner's finished jobs: of the customer of the highest number
    with an order."""
    rows = order_jobs(spark, sf_dir)
    owner = rows.agg(F.max("api_key_id")).first()[0]
    page = jobs.list_page(rows, str(owner), before="2001-01-01", status="succeeded")
    return page.select("id", "status", F.col("position").cast("int").alias("position"))


@query(
    f"""WITH {JOBS_SQL} SELECT id, status FROM jobs
WHERE api_key_id = (SELECT min(api_key_id) FROM jobs)"""
)
def owned_jobs(spark, sf_dir):
    """All jobs of one owner: of the customer of the lowest number with an order."""
    rows = order_jobs(spark, sf_dir)
    owner = rows.agg(F.min("api_key_id")).first()[0]
    return jobs.owned(rows, str(owner)).select("id", "status")


@query(
    r"""SELECT c_custkey, sha256(c_name) AS key_hash, left(c_name, 10) AS prefix,
  lower(c_mktsegment) || '/' || c_nationkey AS media_type,
  's3:' || c_name || ':' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS identity FROM customer"""
)
def client_keys(spark, sf_dir):
    """Customers' names as raw keys and object keys, their segment as a media type with parameters."""
    nation = F.col("c_nationkey").cast("string")
    header = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("/"), nation, F.lit(" ; q=1"))
    etag = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    return load(spark, sf_dir, "customer").select(
        "c_custkey",
        ids.key_hash(F.col("c_name")).alias("key_hash"),
        ids.key_prefix(F.col("c_name")).alias("prefix"),
        ids.media_type(header).alias("media_type"),
        ids.object_identity(F.col("c_name"), etag).alias("identity"),
    )


@query(
    """WITH h AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority
  WHEN 1 THEN o_orderpriority || ' ' || o_orderkey END AS header FROM orders)
SELECT o_orderkey, coalesce(regexp_full_match(header, '[A-Za-z0-9._-]{1,128}'), false) AS kept,
  true AS well_formed FROM h"""
)
def request_ids(spark, sf_dir):
    """Ids that callers sent: kept if well formed, replaced by a new one otherwise."""
    sent = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(
        F.col("o_orderkey") % 3 == 1,
        F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")),
    )
    named = load(spark, sf_dir, "orders").select("o_orderkey", sent.alias("header"))
    named = named.withColumn("id", ids.request_id(F.col("header")))
    return named.select(
        "o_orderkey",
        F.coalesce(F.col("id") == F.col("header"), F.lit(False)).alias("kept"),
        F.col("id").rlike(r"^[A-Za-z0-9._-]{1,128}\z").alias("well_formed"),
    )


@query("""SELECT doc_id, left(text, 500) AS message, right(text, 2000) AS tail FROM documents""")
def error_texts(spark, sf_dir):
    """Long messages as they are stored: the head of a message, the tail of a log."""
    return load(spark, sf_dir, "documents").select(
        "doc_id", ids.short_error(F.col("text")).alias("message"), ids.stderr_tail(F.col("text")).alias("tail")
    )


# --- samples --------------------------------------------------------------------------------

_SCALED = "greatest(least(round_even(x::DOUBLE * 32768, 0), 32767), -32768)::BIGINT"


@query(
    f"""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: {_SCALED}) AS v FROM embeddings)
SELECT vec_id, list_sum(v)::BIGINT AS total, list_min(v) AS low, list_max(v) AS high,
  true AS round_trip FROM s"""
)
def int16_samples(spark, sf_dir):
    """Vectors as float audio, scaled to 16 bits, and back and forth once more."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", audio.to_int16(F.col("embedding")).alias("v"))
    again = audio.to_int16(audio.to_float(F.col("v")))
    total = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return vectors.select(
        "vec_id", total.alias("total"), F.array_min("v").cast("bigint").alias("low"),
        F.array_max("v").cast("bigint").alias("high"), (again == F.col("v")).alias("round_trip"),
    )


@query(
    """SELECT l_orderkey, l_linenumber::INTEGER AS line, l_partkey,
  sqrt(l_quantity / (l_extendedprice * 10.0)) AS gain FROM lineitem"""
)
def noise_gain(spark, sf_dir):
    """Factor for noise of one power under speech of another, ten decibels apart."""
    gain = audio.snr_gain(F.col("l_quantity"), F.col("l_extendedprice"), 10.0)
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("int").alias("line"), "l_partkey", gain.alias("gain")
    )


# --- stored plans, fallback, batches, deliveries --------------------------------------------


@query(
    """SELECT o_orderkey AS recording_id, o_custkey AS audio_samples FROM orders
WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 1"""
)
def reusable_plans(spark, sf_dir):
    """Orders as stored plans; some recordings decode to another length now, some to other channels."""
    orders, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")

    def facts(samples, channels):
        return orders.select(key.alias("recording_id"), samples.alias("audio_samples"), channels.alias("channels"))

    stored = facts(F.col("o_custkey"), F.array(F.lit(0), F.lit(1)))
    now = facts(
        F.col("o_custkey") + F.when(key % 3 == 0, 1).otherwise(0),
        F.when(key % 4 == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))),
    )
    return chunks.reusable_plans(stored, now).select("recording_id", "audio_samples")


@query(
    """WITH p AS (SELECT * FROM lineitem WHERE l_linestatus = 'F')
SELECT l_orderkey, l_linenumber, l_partkey, 'primary' AS engine FROM p
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'fallback' FROM lineitem l WHERE NOT EXISTS (
  SELECT 1 FROM p WHERE p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber)"""
)
def served_chunks(spark, sf_dir):
    """Line items as chunks: those that the primary engine served, the fallback's for the others."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    primary = rows.where(F.col("l_linestatus") == "F").withColumn("engine", F.lit("primary"))
    fallback = rows.withColumn("engine", F.lit("fallback"))
    return assemble.serve_with_fallback(primary, fallback, ["l_orderkey", "l_linenumber"]).drop("l_linestatus")


@query(
    """SELECT l_orderkey AS batch_id, count(*) AS files, string_agg(
  l_linenumber || ':' || l_partkey || ':' || l_linestatus || ':' || l_suppkey, ','
  ORDER BY l_linenumber, l_partkey, l_linestatus, l_suppkey) AS data FROM lineitem GROUP BY l_orderkey"""
)
def batch_results(spark, sf_dir):
    """Orders as batches, their line items as files in upload order."""
    files = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("position"),
        F.col("l_partkey").alias("filename"), F.col("l_linestatus").alias("status"),
        F.col("l_suppkey").alias("job_id"), F.lit(None).cast("string").alias("error_code"),
    )
    item = F.transform(
        "data", lambda x: F.concat_ws(":", x["position"], x["filename"], x["status"], x["job_id"])
    )
    return admission.batch_results(files).select(
        "batch_id", F.size("data").cast("bigint").alias("files"), F.array_join(item, ",").alias("data")
    )


@query(
    f"""WITH {JOBS_SQL} SELECT id, 'transcription.' || status AS type, CASE WHEN status = 'failed' THEN error_code END
  AS code, strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS created_at, status = 'failed' AS has_error
FROM jobs WHERE status IN ('succeeded', 'failed')"""
)
def delivery_events(spark, sf_dir):
    """Events of finished jobs, read back from their JSON."""
    done = order_jobs(spark, sf_dir).select(
        F.regexp_replace(F.md5(F.col("id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        .alias("job"),
        "id", "status", "error_code", F.col("updated_at").alias("finished_at"),
    )
    rows = done.select(
        F.concat("job", F.lit("")).alias("uuid"), F.col("id").alias("key"), "status", "error_code", "finished_at"
    )
    events = outbox.event_rows(
        rows.select(
            F.col("uuid").alias("id"), "status", "error_code", F.lit(None).cast("string").alias("error_message"),
            F.lit(1.5).alias("duration_s"), F.lit(None).cast("string").alias("language"), "finished_at",
        )
    )
    named = events.join(rows.select(F.col("uuid").alias("id"), "key"), "id")

    def field(path: str):
        return F.get_json_object("event", path)

    return named.select(
        F.col("key").alias("id"), field("$.type").alias("type"), field("$.data.error.code").alias("code"),
        field("$.created_at").alias("created_at"), field("$.data.error").isNotNull().alias("has_error"),
    )


@query("""SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000""")
def newest_messages(spark, sf_dir):
    """What is left of the events as a stream that is trimmed to the newest thousand."""
    return jobs.newest_messages(load(spark, sf_dir, "events"), 1000, "event_id").select("event_id", "event_type")


@query(
    f"""WITH {JOBS_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN 'wav' ELSE 'old' END AS audio_info,
  CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN sha256(id::VARCHAR) ELSE 'none' END AS audio_sha256,
  CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN id * 10 ELSE -1 END AS audio_bytes FROM jobs"""
)
def recorded_audio(spark, sf_dir):
    """Probe facts of every other job; hash and size are missing for some and then stay as stored."""
    rows, key = order_jobs(spark, sf_dir), F.col("id")
    stored = rows.select(
        "id", F.lit("old").alias("audio_info"), F.lit("none").alias("audio_sha256"),
        F.lit(-1).cast("bigint").alias("audio_bytes"),
    )
    known = key % 3 != 0
    facts = rows.where(key % 2 == 0).select(
        key.alias("job_id"), F.lit("wav").alias("audio_info"),
        F.when(known, F.sha2(key.cast("string"), 256)).alias("audio_sha256"),
        F.when(known, key * 10).alias("audio_bytes"),
    )
    return jobs.record_audio(stored, facts).select("id", "audio_info", "audio_sha256", "audio_bytes")
