"""Queries over jobs, requests, deliveries, queues, objects and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.functions import ids, urls
from speechframe.functions.timing import epoch_us
from speechframe.operators import (
    admission as admit,
    audio,
    breaker,
    jobs,
    lifecycle,
    metrics,
    outbox,
    ratelimit,
)
from speechframe.operators.ordered import Hot, measure
from speechframe.plans.bindings import (
    EVENTS_SQL,
    INTERVALS_SQL,
    JOBS_SQL,
    NOW,
    event_intervals,
    event_rows,
    load,
    order_jobs,
)
from speechframe.schema import BUCKETS, ERROR_CODES
from speechframe.sources import readers, sinks

QUERIES = {}
ORACLES = {}

HOUR_US = 3_600_000_000


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


# --- rows of latest, copies, first writers --------------------------------------------------


@query(
    """SELECT l_orderkey AS job_id, l_linenumber::BIGINT AS idx, l_partkey AS part,
  l_suppkey AS supp, l_quantity AS quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
  FROM lineitem) WHERE rn = 1"""
)
def upsert_latest(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").cast("bigint").alias("idx"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").alias("quantity"),
        "l_shipdate",
        "l_extendedprice",
    )
    latest = jobs.upsert_latest(
        rows, ["job_id", "idx"], ["l_shipdate", "part", "supp", "l_extendedprice"]
    )
    return latest.select("job_id", "idx", "part", "supp", "quantity")


@query(
    "SELECT l_orderkey AS job_id, count(DISTINCT l_linenumber) AS chunks_done FROM lineitem GROUP BY 1"
)
def chunks_done(spark, sf_dir):
    return sinks.chunks_done(
        load(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("idx")
        )
    )


_PRINT_SQL = """prints AS (SELECT doc_id, source, sha256(
  '{"audio":"sha256:' || sha256(text) || '","options":{"language":"' || lang
  || '","split_channels":false}}') AS fingerprint FROM documents)"""


def _prints(spark, sf_dir) -> DataFrame:
    identity = ids.direct_identity(ids.content_digest(F.col("text")))
    options = [F.col("lang").alias("language"), F.lit(False).alias("split_channels")]
    return load(spark, sf_dir, "documents").select(
        "doc_id", "source", ids.fingerprint(identity, options).alias("fingerprint")
    )


@query(
    f"""WITH {_PRINT_SQL} SELECT fingerprint, min(doc_id) AS doc_id,
arg_min(source, doc_id) AS source, count(*) AS copies FROM prints GROUP BY fingerprint"""
)
def fingerprint_dedupe(spark, sf_dir):
    return jobs.earliest_per_fingerprint(_prints(spark, sf_dir), ["fingerprint"], ["doc_id"])


_IDEM_SQL = f"""{EVENTS_SQL},
req AS (SELECT event_id AS request_id, ts, us, user_id, event_type AS fingerprint,
          CASE WHEN k % 3 = 0 THEN 'k' || k END AS ikey, k, value FROM ev),
win AS (SELECT user_id, ikey, arg_min(request_id, us) AS winner, arg_min(fingerprint, us) AS wfp
        FROM req WHERE ikey IS NOT NULL GROUP BY user_id, ikey),
written AS (SELECT r.*, coalesce(winner, request_id) AS winner,
  CASE WHEN winner IS NULL OR winner = request_id THEN 'created'
       WHEN wfp = fingerprint THEN 'replayed' ELSE 'conflict' END AS outcome
  FROM req r LEFT JOIN win w ON w.user_id = r.user_id AND w.ikey = r.ikey)"""


def _requests(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    return event_rows(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        "ts",
        "us",
        "user_id",
        F.col("event_type").alias("fingerprint"),
        F.when(k % 3 == 0, F.concat(F.lit("k"), k.cast("string"))).alias("ikey"),
        "k",
        "value",
    )


@query(f"WITH {_IDEM_SQL} SELECT request_id, winner, outcome FROM written")
def idempotency(spark, sf_dir):
    written = jobs.first_writer(_requests(spark, sf_dir), ["user_id", "ikey"])
    return written.select("request_id", "winner", "outcome")


@query(
    f"""WITH {EVENTS_SQL} SELECT event_id AS request_id,
last_value(CASE WHEN k % 5 <> 0 THEN event_id END IGNORE NULLS) OVER (
  PARTITION BY user_id, event_type ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  AS duplicate_of FROM ev"""
)
def asof_duplicate(spark, sf_dir):
    ev = event_rows(spark, sf_dir)
    known = ev.select(
        F.col("event_id").alias("id"), "user_id", "event_type", "us",
        F.when(F.col("k") % 5 == 0, "failed").otherwise("succeeded").alias("status"),
    )
    requests = ev.select(F.col("event_id").alias("request_id"), "user_id", "event_type", "us")
    found = jobs.asof_duplicate(requests, known, keys=["user_id", "event_type"])
    return found.select("request_id", "duplicate_of")


@query(
    f"""WITH {JOBS_SQL} SELECT api_key_id, request_fingerprint, id AS job_id FROM (
SELECT *, row_number() OVER (PARTITION BY api_key_id, request_fingerprint
  ORDER BY created_at DESC, id DESC) AS rn FROM jobs WHERE status <> 'failed') WHERE rn = 1"""
)
def latest_by_fingerprint(spark, sf_dir):
    return jobs.latest_by_fingerprint(order_jobs(spark, sf_dir)).drop("created_at")


# --- rate limit and admission ---------------------------------------------------------------

WINDOW_S = 12 * 3600
WINDOW_US = WINDOW_S * 1_000_000

_RATE_SQL = f"""RECURSIVE {_IDEM_SQL},
rl0 AS (SELECT request_id, us, user_id, CASE WHEN fingerprint = 'view' THEN 'read' ELSE 'write' END AS bucket,
  CASE WHEN fingerprint = 'view' THEN 10 ELSE 1 END
    * CASE WHEN user_id % 4 = 0 THEN 2 ELSE 1 + user_id % 3 END AS lim,
  CASE WHEN k % 6 = 0 THEN 2 ELSE 1 END AS cost FROM req),
rl1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY us) AS rn FROM rl0),
rl AS (
  SELECT *, us + {WINDOW_US} AS ends, cost::BIGINT AS n FROM rl1 WHERE rn = 1
  UNION ALL
  SELECT r.*, CASE WHEN r.us >= p.ends THEN r.us + {WINDOW_US} ELSE p.ends END,
    CASE WHEN r.us >= p.ends THEN r.cost ELSE p.n + r.cost END
  FROM rl p JOIN rl1 r ON r.user_id = p.user_id AND r.bucket = p.bucket AND r.rn = p.rn + 1),
rated AS (SELECT request_id, n <= lim AS allowed, greatest(0, lim - n)::BIGINT AS remaining,
  greatest(1, ceil((ends - us) / 1000000.0::DOUBLE))::BIGINT AS reset_s FROM rl)"""


def _rated(requests: DataFrame, hot: Hot) -> DataFrame:
    api_keys = requests.select(F.col("user_id").alias("id")).distinct().withColumn(
        "rate_limit_per_minute", F.when(F.col("id") % 4 != 0, F.col("id") % 3 + 1)
    )
    asked = requests.select(
        "request_id",
        "ts",
        F.col("user_id").alias("api_key"),
        F.when(F.col("fingerprint") == "view", "read").otherwise("write").alias("bucket"),
        F.when(F.col("k") % 6 == 0, 2).otherwise(1).alias("cost"),
    )
    return ratelimit.rate_limit(
        ratelimit.budgets(asked, api_keys, default_limit=2), window_s=WINDOW_S, hot_rows=hot
    )


@query(f"WITH {_RATE_SQL} SELECT request_id, allowed, remaining, reset_s FROM rated")
def rate_limit(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    rated = _rated(requests, measure(requests, ["user_id"], "us"))
    return rated.select("request_id", "allowed", "remaining", "reset_s")


_ADMIT_SQL = f"""{_RATE_SQL},
iv AS (SELECT us AS start, us + floor(value * 300000000.0::DOUBLE)::BIGINT AS "end" FROM ev),
chg AS (SELECT start AS us, 1 AS d, 2 AS kind, NULL::BIGINT AS id FROM iv
        UNION ALL SELECT "end", -1, 0, NULL::BIGINT FROM iv
        UNION ALL SELECT us, 0, 1, request_id FROM req),
act AS (SELECT id AS request_id, active FROM (SELECT *, sum(d) OVER (ORDER BY us, kind
          RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active FROM chg) WHERE kind = 1),
dup AS (SELECT request_id, lag(request_id) OVER (PARTITION BY user_id, fingerprint ORDER BY us)
        AS duplicate_of FROM req),
facts AS (SELECT w.*, r.allowed, a.active, d.duplicate_of, floor(value * 1e6::DOUBLE) AS size
  FROM written w JOIN rated r USING (request_id) JOIN act a USING (request_id)
  JOIN dup d USING (request_id)),
decided AS (SELECT request_id, CASE WHEN user_id % 29 = 0 THEN 'unauthorized'
  WHEN NOT allowed THEN 'rate_limited' WHEN size > 250000000 THEN 'payload_too_large'
  WHEN size = 0 THEN 'bad_request' WHEN outcome = 'replayed' THEN 'replayed'
  WHEN active >= 60 THEN 'queue_full' WHEN k % 11 = 0 THEN 'unsupported_media_type'
  WHEN ikey IS NULL AND duplicate_of IS NOT NULL THEN 'deduplicated'
  WHEN outcome = 'conflict' THEN 'idempotency_key_reused' ELSE outcome END AS outcome FROM facts)"""


@query(f"WITH {_ADMIT_SQL} SELECT request_id, outcome FROM decided")
def admission(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    hot = measure(requests, ["user_id"], "us")
    written = jobs.first_writer(requests, ["user_id", "ikey"])
    active = admit.active_at(requests, event_intervals(spark, sf_dir))
    earlier = requests.select(
        F.col("request_id").alias("id"), "user_id", "fingerprint", "us", F.lit("queued").alias("status")
    )
    doubles = jobs.asof_duplicate(
        requests.select("request_id", "user_id", "fingerprint", "us"),
        earlier,
        keys=["user_id", "fingerprint"],
        hot_rows=hot,
    ).select("request_id", "duplicate_of")
    rated = _rated(requests, hot).select("request_id", "allowed")
    facts = (
        written.withColumnRenamed("outcome", "write")
        .join(rated, "request_id")
        .join(active, "request_id")
        .join(doubles, "request_id")
        .withColumns(
            {
                "api_key_id": F.when(F.col("user_id") % 29 != 0, F.col("user_id")),
                "size": F.floor(F.col("value") * 1e6).cast("bigint"),
                "replay_of": F.when(F.col("write") == "replayed", F.col("winner")),
                "supported": F.col("k") % 11 != 0,
                "idempotency_key": F.col("ikey"),
            }
        )
    )
    outcome = admit.outcome(max_pending=60, max_bytes=250_000_000)
    return facts.select("request_id", outcome.alias("outcome"))


_CODES_SQL = ", ".join(f"('{c}', {s}, {str(r).lower()})" for c, (s, r) in ERROR_CODES.items())
_CODE_NAMES = list(ERROR_CODES)


@query(
    f"""WITH {EVENTS_SQL}, codes(code, status, retryable) AS (VALUES {_CODES_SQL}),
named AS (SELECT event_id, [{', '.join(f"'{c}'" for c in _CODE_NAMES)}, 'none'][k % 21 + 1] AS code FROM ev)
SELECT event_id, n.code, status, retryable FROM named n LEFT JOIN codes c ON c.code = n.code"""
)
def error_facts(spark, sf_dir):
    names = F.array(*[F.lit(c) for c in [*_CODE_NAMES, "none"]])
    coded = event_rows(spark, sf_dir).select(
        "event_id", F.element_at(names, (F.col("k") % 21 + 1).cast("int")).alias("code")
    )
    return jobs.error_facts(coded, "code").withColumnRenamed("error_status", "status")


@query(
    """WITH files AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1
  AS position FROM conversations)
SELECT conv_id AS batch_id, position, 'key' || conv_id || ':' || position AS idempotency_key,
  role || '-' || turn || '.wav' AS filename, 1 AS cost FROM files"""
)
def batch_files(spark, sf_dir):
    """Turns as the files of a batch."""
    files = load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("batch_id"),
        "turn",
        F.concat("role", F.lit("-"), F.col("turn").cast("string"), F.lit(".wav")).alias("filename"),
        F.concat(F.lit("key"), F.col("conv_id").cast("string")).alias("idempotency_key"),
    )
    return admit.number_files(files, "turn").drop("turn")


# --- job tables -----------------------------------------------------------------------------


@query(
    f"""WITH {JOBS_SQL}, asked AS (SELECT id AS job_id FROM jobs
  UNION ALL SELECT id + 100000000 FROM jobs WHERE id % 50 = 0)
SELECT a.job_id, CASE WHEN j.id IS NULL THEN 'missing'
  WHEN attempts < 3 AND (status = 'queued' OR (status = 'processing'
       AND lease_expires_at < TIMESTAMP '{NOW}')) THEN 'claimed'
  WHEN status IN ('succeeded', 'failed') THEN 'terminal'
  WHEN status = 'processing' AND lease_expires_at >= TIMESTAMP '{NOW}' THEN 'busy'
  WHEN attempts >= 3 THEN 'exhausted' ELSE 'busy' END AS outcome
FROM asked a LEFT JOIN jobs j ON j.id = a.job_id"""
)
def claim_outcome(spark, sf_dir):
    known = order_jobs(spark, sf_dir)
    asked = known.select(F.col("id").alias("job_id")).unionByName(
        known.where(F.col("id") % 50 == 0).select((F.col("id") + 100_000_000).alias("job_id"))
    )
    return jobs.claim_outcomes(asked, known, now=NOW, max_attempts=3)


_ORPHAN_SQL = f"""((status = 'queued' AND updated_at < TIMESTAMP '{NOW}' - to_seconds(864000))
  OR (status = 'processing' AND lease_expires_at < TIMESTAMP '{NOW}' - to_seconds(60)
      AND updated_at < TIMESTAMP '{NOW}' - to_seconds(60)))"""


@query(f"WITH {JOBS_SQL} SELECT id, status FROM jobs WHERE {_ORPHAN_SQL}")
def orphans(spark, sf_dir):
    return jobs.orphans(
        order_jobs(spark, sf_dir), now=NOW, queued_older_than_s=864_000, lease_grace_s=60
    ).select("id", "status")


@query(
    f"""WITH {JOBS_SQL}, sel AS (SELECT id FROM jobs WHERE {_ORPHAN_SQL} ORDER BY updated_at, id LIMIT 100)
SELECT j.id, epoch_us(CASE WHEN s.id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE updated_at END) AS updated_us
FROM jobs j LEFT JOIN sel s ON s.id = j.id"""
)
def requeue_orphans(spark, sf_dir):
    """One sweep: the hundred orphans longest untouched are marked."""
    known = order_jobs(spark, sf_dir)
    chosen = jobs.orphans(
        known, now=NOW, queued_older_than_s=864_000, lease_grace_s=60, limit=100
    )
    return jobs.touch_selected(known, chosen, now=NOW).select(
        "id", epoch_us(F.col("updated_at")).alias("updated_us")
    )


@query(
    f"""WITH {JOBS_SQL} SELECT id, webhook_status, c_name AS secret FROM jobs JOIN customer ON c_custkey = api_key_id
WHERE webhook_status IN ('pending', 'sending') AND webhook_next_at <= TIMESTAMP '{NOW}'"""
)
def due_deliveries(spark, sf_dir):
    keys = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("webhook_secret")
    )
    due = jobs.due_deliveries(order_jobs(spark, sf_dir), keys, now=NOW)
    return due.select("id", "webhook_status", F.col("webhook_secret").alias("secret"))


@query(
    f"""WITH {JOBS_SQL} SELECT id FROM jobs
WHERE webhook_status IN ('pending', 'sending') AND webhook_next_at <= TIMESTAMP '{NOW}'
ORDER BY webhook_next_at, id LIMIT 50"""
)
def most_overdue(spark, sf_dir):
    return jobs.due_deliveries(order_jobs(spark, sf_dir), now=NOW, limit=50).select("id")


@query(
    f"""WITH {JOBS_SQL}, r AS (SELECT *, row_number() OVER w AS position,
  count(*) OVER (PARTITION BY api_key_id) AS n FROM jobs
  WINDOW w AS (PARTITION BY api_key_id ORDER BY created_at DESC, id DESC)),
cur AS (SELECT api_key_id, epoch_us(created_at) AS next_us FROM r WHERE position = 5 AND n > 5)
SELECT r.api_key_id, r.id, r.position, next_us FROM r LEFT JOIN cur USING (api_key_id)
WHERE position <= 5"""
)
def list_page(spark, sf_dir):
    pages = jobs.first_pages(order_jobs(spark, sf_dir), limit=5)
    return pages.select(
        "api_key_id", "id", F.col("position").cast("bigint").alias("position"),
        epoch_us(F.col("next_cursor")).alias("next_us"),
    )


@query(f"WITH {JOBS_SQL} SELECT count(*) FILTER (WHERE status IN ('queued', 'processing')) AS active FROM jobs")
def active_jobs(spark, sf_dir):
    return order_jobs(spark, sf_dir).agg(F.count_if(jobs.is_active()).alias("active"))


_DONE_SQL = "done AS (SELECT l_orderkey AS id, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)"


def _jobs_with_progress(spark, sf_dir) -> DataFrame:
    done = sinks.chunks_done(
        load(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("idx")
        )
    ).withColumnRenamed("job_id", "id")
    known = order_jobs(spark, sf_dir).join(done, "id", "left")
    return known.withColumn(
        "chunks_done", F.least(F.coalesce("chunks_done", F.lit(0)), F.col("chunks_total"))
    )


@query(
    f"""WITH {JOBS_SQL}, {_DONE_SQL} SELECT j.id, CASE WHEN chunks_total IS NULL THEN NULL
  WHEN chunks_total = 0 THEN 100.0::DOUBLE
  ELSE 100 * least(coalesce(n, 0), chunks_total) / chunks_total END AS percent
FROM jobs j LEFT JOIN done USING (id)"""
)
def progress(spark, sf_dir):
    known = _jobs_with_progress(spark, sf_dir)
    return known.select(
        "id", jobs.progress(F.col("chunks_done"), F.col("chunks_total")).alias("percent")
    )


@query(
    f"""WITH {JOBS_SQL}, {_DONE_SQL} SELECT j.id, status,
  CASE WHEN chunks_total = 0 THEN 100.0::DOUBLE ELSE 100 * least(coalesce(n, 0), chunks_total) / chunks_total END
    AS percent,
  error_code AS error, CASE WHEN webhook_status IS NOT NULL THEN webhook_status END AS webhook,
  '/v1/transcriptions/' || j.id AS self,
  CASE WHEN status = 'succeeded' THEN '/v1/transcriptions/' || j.id || '/subtitles' END AS subtitles
FROM jobs j LEFT JOIN done USING (id)"""
)
def job_view(spark, sf_dir):
    none = F.lit(None)
    known = _jobs_with_progress(spark, sf_dir)
    full = known.withColumns(
        {
            "id": F.col("id").cast("string"),
            "started_at": none.cast("timestamp"),
            "finished_at": none.cast("timestamp"),
            "options": none.cast("string"),
            "audio_info": none.cast("struct<container:string,codec:string,channels:int>"),
            "duration_s": none.cast("double"),
            "language": none.cast("string"),
            "language_probability": none.cast("double"),
            "error_status": F.lit(422),
            "error_message": none.cast("string"),
            "webhook_url": F.when(F.col("webhook_status").isNotNull(), "https://example.org/hook"),
            "webhook_attempts": F.lit(0),
        }
    )
    return jobs.job_view(full).select(
        F.col("id").cast("bigint").alias("id"), "status", F.col("progress.percent").alias("percent"),
        F.col("error.code").alias("error"), F.col("webhook.status").alias("webhook"),
        F.col("links.self").alias("self"), F.col("links.subtitles").alias("subtitles"),
    )


@query(
    """SELECT l_orderkey AS job_id, l_linenumber::BIGINT AS idx, l_partkey AS part FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""
)
def cascade_delete(spark, sf_dir):
    results = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("bigint").alias("idx"),
        F.col("l_partkey").alias("part"),
    )
    gone = load(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("id")
    )
    return jobs.cascade_delete(results, gone)


# --- life cycles ----------------------------------------------------------------------------

LEASE_S = 6 * 3600
LEASE_US = LEASE_S * 1_000_000


def _job_events(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    kind = (
        F.when(F.col("event_type") == "signup", "create")
        .when(F.col("event_type").isin("click", "purchase"), "claim")
        .when(F.col("event_type") == "view", "heartbeat")
        .when(k % 8 == 0, "complete")
        .when(k % 8 == 1, "fail")
        .when(k % 8 == 2, "release")
        .otherwise("chunk")
    )
    group = F.floor(F.col("us") / F.lit(5 * 86_400_000_000))
    return event_rows(spark, sf_dir).select(
        F.concat_ws("-", F.col("user_id").cast("string"), group.cast("string")).alias("job_id"),
        "ts",
        F.col("event_id").alias("seq"),
        kind.alias("event"),
        F.when(
            (kind == "fail") & (k % 16 == 1), F.lit(None)
        ).otherwise(F.concat(F.lit("w"), (k % 2).cast("string"))).alias("worker_id"),
    )


_JOB_EVENTS_SQL = f"""{EVENTS_SQL},
je0 AS (SELECT user_id || '-' || (us // {5 * 86_400_000_000}) AS job_id, us, event_id AS seq, k,
  CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type IN ('click', 'purchase') THEN 'claim'
       WHEN event_type = 'view' THEN 'heartbeat' WHEN k % 8 = 0 THEN 'complete'
       WHEN k % 8 = 1 THEN 'fail' WHEN k % 8 = 2 THEN 'release' ELSE 'chunk' END AS event FROM ev),
je AS (SELECT job_id, us, seq, event,
  CASE WHEN event = 'fail' AND k % 16 = 1 THEN NULL ELSE 'w' || (k % 2) END AS worker,
  row_number() OVER (PARTITION BY job_id ORDER BY us) AS rn FROM je0),
base AS (SELECT DISTINCT job_id, 0::BIGINT AS rn, NULL::VARCHAR AS status, NULL::VARCHAR AS owner,
  NULL::BIGINT AS lease, 0 AS attempts, ''::VARCHAR AS outcome FROM je),
life AS (
  SELECT * FROM base
  UNION ALL
  SELECT job_id, rn,
    CASE outcome WHEN 'created' THEN 'queued' WHEN 'claimed' THEN 'processing'
      WHEN 'completed' THEN 'succeeded' WHEN 'failed' THEN 'failed' WHEN 'released' THEN 'queued'
      ELSE status END,
    CASE outcome WHEN 'claimed' THEN worker WHEN 'released' THEN NULL ELSE owner END,
    CASE WHEN outcome IN ('claimed', 'beat') THEN us + {LEASE_US}
         WHEN outcome IN ('completed', 'failed', 'released') THEN NULL ELSE lease END,
    attempts + CASE WHEN outcome = 'claimed' THEN 1 ELSE 0 END, outcome
  FROM (SELECT e.job_id, e.rn, e.us, e.worker, s.status, s.owner, s.lease, s.attempts,
      CASE
        WHEN event = 'create' THEN CASE WHEN status IS NULL THEN 'created' ELSE 'ignored' END
        WHEN event = 'claim' THEN CASE WHEN status IS NULL THEN 'missing'
          WHEN attempts < 3 AND (status = 'queued' OR (status = 'processing' AND lease < us)) THEN 'claimed'
          WHEN status IN ('succeeded', 'failed') THEN 'terminal'
          WHEN status = 'processing' AND lease >= us THEN 'busy'
          WHEN attempts >= 3 THEN 'exhausted' ELSE 'busy' END
        WHEN event = 'fail' AND worker IS NULL
          THEN CASE WHEN status IN ('queued', 'processing') THEN 'failed' ELSE 'ignored' END
        WHEN status IS DISTINCT FROM 'processing' OR owner IS DISTINCT FROM worker THEN 'lease_lost'
        WHEN event = 'heartbeat' THEN 'beat' WHEN event = 'complete' THEN 'completed'
        WHEN event = 'fail' THEN 'failed' WHEN event = 'release' THEN 'released' ELSE 'ok' END AS outcome
    FROM life s JOIN je e ON e.job_id = s.job_id AND e.rn = s.rn + 1)),
lived AS (SELECT j.job_id, j.us, j.event, l.status AS status_after, l.attempts::BIGINT AS attempts_after,
  CASE WHEN outcome IN ('beat', 'completed', 'failed', 'released') THEN 'ok' ELSE outcome END AS outcome
  FROM life l JOIN je j ON j.job_id = l.job_id AND j.rn = l.rn)"""


@query(
    f"WITH RECURSIVE {_JOB_EVENTS_SQL} SELECT job_id, us, event, outcome, status_after, attempts_after FROM lived"
)
def job_lifecycle(spark, sf_dir):
    outcomes = lifecycle.event_outcomes(_job_events(spark, sf_dir), lease_s=LEASE_S, max_attempts=3)
    return outcomes.select(
        "job_id", "us", "event", "outcome", "status_after",
        F.col("attempts_after").cast("bigint").alias("attempts_after"),
    )


@query(
    f"""WITH RECURSIVE {_JOB_EVENTS_SQL} SELECT job_id, arg_max(status_after, us) AS status,
arg_max(attempts_after, us) AS attempts, count(*) AS events,
count(*) FILTER (WHERE outcome = 'lease_lost') AS lease_lost FROM lived GROUP BY job_id"""
)
def job_states(spark, sf_dir):
    outcomes = lifecycle.event_outcomes(_job_events(spark, sf_dir), lease_s=LEASE_S, max_attempts=3)
    return lifecycle.job_states(outcomes).select(
        "job_id", "status", F.col("attempts").cast("bigint").alias("attempts"), "events", "lease_lost"
    )


@query(
    f"""WITH {EVENTS_SQL}, n AS (SELECT user_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS next FROM ev)
SELECT user_id, us, next - us AS idle_us, us + {12 * HOUR_US} AS redelivered_us FROM n
WHERE next - us >= {12 * HOUR_US}"""
)
def stalls(spark, sf_dir):
    rows = event_rows(spark, sf_dir).select("user_id", "us", F.col("event_id").alias("seq"))
    return lifecycle.stalls(rows, ["user_id"], timeout_us=12 * HOUR_US).drop("seq")


@query(
    f"""WITH {EVENTS_SQL}, m AS (SELECT user_id, k AS message_id,
  bool_or(event_type IN ('signup', 'click', 'view')) AS p, bool_or(event_type IN ('view', 'purchase')) AS d,
  bool_or(event_type = 'error') AS a FROM ev GROUP BY user_id, k)
SELECT user_id, count(*) FILTER (WHERE p) - count(*) FILTER (WHERE p AND d) AS lag,
  count(*) FILTER (WHERE d AND NOT a) AS pending FROM m GROUP BY user_id"""
)
def queue_lag(spark, sf_dir):
    ev = event_rows(spark, sf_dir).select("user_id", F.col("k").alias("message_id"), "event_type")
    kind = F.col("event_type")
    steps = F.array_compact(
        F.array(
            F.when(kind.isin("signup", "click", "view"), "produced"),
            F.when(kind.isin("view", "purchase"), "delivered"),
            F.when(kind == "error", "acked"),
        )
    )
    return lifecycle.queue_counts(ev.withColumn("event", F.explode(steps)), ["user_id"])


RESET_US = 6 * HOUR_US


@query(
    f"""WITH RECURSIVE {EVENTS_SQL},
b0 AS (SELECT user_id % 20 AS engine, event_id, us, k % 3 = 0 AS ok,
  row_number() OVER (PARTITION BY user_id % 20 ORDER BY us) AS rn FROM ev),
st AS (
  SELECT DISTINCT engine, 0::BIGINT AS rn, 0 AS failures, NULL::BIGINT AS opened, ''::VARCHAR AS state FROM b0
  UNION ALL
  SELECT engine, rn,
    CASE WHEN state = 'open' THEN 0 WHEN ok THEN 0 WHEN state = 'half_open' OR failures + 1 >= 4 THEN 0
         ELSE failures + 1 END,
    CASE WHEN state = 'open' THEN opened WHEN ok THEN NULL
         WHEN state = 'half_open' OR failures + 1 >= 4 THEN us END, state
  FROM (SELECT b.engine, b.rn, b.us, b.ok, s.failures, s.opened,
          CASE WHEN s.opened IS NULL THEN 'closed' WHEN b.us - s.opened < {RESET_US} THEN 'open'
               ELSE 'half_open' END AS state
        FROM st s JOIN b0 b ON b.engine = s.engine AND b.rn = s.rn + 1))
SELECT b.event_id, s.state, s.state <> 'open' AS admitted, s.failures, s.opened IS NOT NULL AS open_after
FROM st s JOIN b0 b ON b.engine = s.engine AND b.rn = s.rn"""
)
def breaker_timeline(spark, sf_dir):
    attempts = event_rows(spark, sf_dir).select(
        (F.col("user_id") % 20).alias("engine"), "event_id", "ts", (F.col("k") % 3 == 0).alias("ok")
    )
    found = breaker.breaker_timeline(attempts, threshold=4, reset_s=6 * 3600, tie="event_id")
    return found.select("event_id", "state", "admitted", "failures", "open_after")


_HTTP = (200, 503, 429, 404, 500, 503, 204, 302)


@query(
    f"""WITH RECURSIVE {EVENTS_SQL},
d0 AS (SELECT user_id || '-' || (us // {5 * 86_400_000_000}) AS job_id, us,
  event_type IN ('view', 'click', 'signup') AS is_claim,
  CASE WHEN k % 9 = 8 THEN NULL ELSE [{', '.join(map(str, _HTTP))}][k % 9 + 1] END AS code FROM ev),
d1 AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY us) AS rn FROM d0),
ob AS (
  SELECT DISTINCT job_id, 0::BIGINT AS rn, 'pending'::VARCHAR AS status, NULL::BIGINT AS next_us, 0 AS attempts,
    ''::VARCHAR AS outcome FROM d1
  UNION ALL
  SELECT job_id, rn, CASE WHEN outcome IN ('not_due', 'ignored') THEN status ELSE outcome END,
    CASE outcome WHEN 'sending' THEN us + 60000000 WHEN 'not_due' THEN next_us WHEN 'ignored' THEN next_us
      WHEN 'pending' THEN us + least(5 * 2 ** (attempts - 1), 3600)::BIGINT * 1000000 END,
    attempts + CASE WHEN outcome = 'sending' THEN 1 ELSE 0 END, outcome
  FROM (SELECT d.job_id, d.rn, d.us, s.status, s.next_us, s.attempts,
      CASE WHEN d.is_claim THEN CASE WHEN status IN ('pending', 'sending') AND coalesce(next_us, 0) <= d.us
               THEN 'sending' ELSE 'not_due' END
           WHEN status <> 'sending' THEN 'ignored'
           WHEN d.code >= 200 AND d.code < 300 THEN 'delivered'
           WHEN (d.code IN (408, 429) OR d.code >= 500) AND attempts < 5 THEN 'pending'
           ELSE 'failed' END AS outcome
    FROM ob s JOIN d1 d ON d.job_id = s.job_id AND d.rn = s.rn + 1))
SELECT d.job_id, d.us, o.outcome, o.status, o.attempts::BIGINT AS attempts, o.next_us
FROM ob o JOIN d1 d ON d.job_id = o.job_id AND d.rn = o.rn"""
)
def outbox_state(spark, sf_dir):
    codes = F.array(*[F.lit(c) for c in _HTTP])
    group = F.floor(F.col("us") / F.lit(5 * 86_400_000_000))
    log = event_rows(spark, sf_dir).select(
        F.concat_ws("-", F.col("user_id").cast("string"), group.cast("string")).alias("job_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("view", "click", "signup"), "claim").otherwise("result")
        .alias("event"),
        F.when(F.col("k") % 9 != 8, F.element_at(codes, F.least(F.col("k") % 9 + 1, F.lit(8)).cast("int")))
        .alias("http_status"),
    )
    return outbox.delivery_states(log).select(
        "job_id", "us", "outcome", "status", F.col("attempts").cast("bigint").alias("attempts"), "next_us"
    )


@query(
    f"""WITH {EVENTS_SQL} SELECT event_id, least(5 * 2.0::DOUBLE ** (k % 14), 3600.0) AS retry_s,
  least(60.0, 2.0::DOUBLE ** (k % 14)) AS loop_s FROM ev"""
)
def backoff(spark, sf_dir):
    n = F.col("k") % 14 + 1
    return event_rows(spark, sf_dir).select(
        "event_id", outbox.retry_delay_s(n).alias("retry_s"), outbox.loop_backoff_s(n, 60.0).alias("loop_s")
    )


@query(
    f"""WITH {EVENTS_SQL}, s AS (SELECT event_id, 200 + k * 4 AS status FROM ev)
SELECT event_id, CASE WHEN status >= 200 AND status < 300 THEN 'ok'
  WHEN status IN (408, 429) OR status >= 500 THEN 'retryable' ELSE 'permanent' END AS outcome,
  CASE WHEN status < 400 THEN NULL WHEN status IN (401, 403, 429) OR status >= 500
       THEN 'asr_engine_unavailable' ELSE 'asr_engine_error' END AS engine_error FROM s"""
)
def delivery_outcome(spark, sf_dir):
    status = F.lit(200) + F.col("k") * 4
    return event_rows(spark, sf_dir).select(
        "event_id", outbox.delivery_outcome(status).alias("outcome"),
        outbox.engine_error(status).alias("engine_error"),
    )


_UUID_SQL = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' ||
  substr(h, 17, 4) || '-' || substr(h, 21, 12)"""


def _uuid_of(text: Column) -> Column:
    h = F.md5(text)
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in parts])


@query(
    f"""WITH {JOBS_SQL}, u AS (SELECT id, status, md5(id::VARCHAR) AS h FROM jobs
  WHERE status IN ('succeeded', 'failed')),
d AS (SELECT id, status, {_UUID_SQL} AS job, sha1(from_hex(h) || status::BLOB) AS s FROM u)
SELECT id, job, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' ||
  substr('89ab', ('0x' || substr(s, 17, 1))::INTEGER % 4 + 1, 1) || substr(s, 18, 3) || '-' ||
  substr(s, 21, 12) AS event_id FROM d"""
)
def event_ids(spark, sf_dir):
    done = order_jobs(spark, sf_dir).where(F.col("status").isin("succeeded", "failed"))
    return done.withColumn("job", _uuid_of(F.col("id").cast("string"))).select(
        "id", "job", ids.event_id(F.col("job"), F.col("status")).alias("event_id")
    )


# --- objects, messages, documents on the wire -----------------------------------------------


@query(
    f"""WITH keys AS (SELECT c_custkey, md5(c_name) AS h, md5(c_name || 'x') AS g FROM customer),
ids AS (SELECT c_custkey, {_UUID_SQL} AS a, {_UUID_SQL.replace('h,', 'g,')} AS b FROM keys),
paths AS (SELECT c_custkey, a, b, CASE c_custkey % 5 WHEN 0 THEN 'uploads/' || upper(a) || '/' || b
  WHEN 1 THEN a || '/' || b WHEN 2 THEN 'uploads/' || a || '/' || b || '/' ELSE 'uploads/' || a || '/' || b END
  AS path FROM ids)
SELECT c_custkey, path, CASE WHEN ok THEN regexp_extract(path, pat, 1) END AS api_key_id,
  CASE WHEN ok THEN regexp_extract(path, pat, 2) END AS upload_id
FROM (SELECT *, regexp_matches(path, pat) AS ok FROM (SELECT *,
  '^uploads/([0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})/([0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})$'
  AS pat FROM paths))"""
)
def key_parse(spark, sf_dir):
    a, b = _uuid_of(F.col("c_name")), _uuid_of(F.concat("c_name", F.lit("x")))
    v = F.col("c_custkey") % 5
    path = (
        F.when(v == 0, F.concat(F.lit("uploads/"), F.upper(a), F.lit("/"), b))
        .when(v == 1, F.concat(a, F.lit("/"), b))
        .when(v == 2, F.concat(F.lit("uploads/"), a, F.lit("/"), b, F.lit("/")))
        .otherwise(F.concat(F.lit("uploads/"), a, F.lit("/"), b))
    )
    return load(spark, sf_dir, "customer").select("c_custkey", path.alias("path")).withColumn(
        "_k", ids.parse_object_key(F.col("path"), "uploads/")
    ).select("c_custkey", "path", "_k.api_key_id", "_k.upload_id")


@query(
    f"""WITH {EVENTS_SQL}, o AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN 'other/' ELSE 'audio/' END || event_id
  AS path, ts FROM ev)
SELECT event_id, path FROM o WHERE starts_with(path, 'audio/')
AND ts < TIMESTAMP '2024-01-25 00:00:00' - to_days(10)"""
)
def retention(spark, sf_dir):
    objects = event_rows(spark, sf_dir).select(
        "event_id",
        F.concat(
            F.when(F.col("k") % 4 == 0, "other/").otherwise("audio/"), F.col("event_id").cast("string")
        ).alias("path"),
        F.col("ts").cast("timestamp").alias("modificationTime"),
    )
    old = jobs.expired_objects(objects, prefix="audio/", days=10, now="2024-01-25 00:00:00")
    return old.select("event_id", "path")


@query(
    f"""WITH {EVENTS_SQL}, m AS (SELECT event_id, k, md5(user_id::VARCHAR) AS h, event_type FROM ev),
f AS (SELECT event_id, k, event_type, CASE WHEN k % 10 = 0 THEN 'oops' WHEN k % 10 = 1 THEN NULL
  ELSE {_UUID_SQL} END AS job FROM m)
SELECT event_id, job AS job_id, 'malformed message' AS reason,
  CASE WHEN job IS NULL THEN '{{"attempt":"' || k || '"}}'
       ELSE '{{"attempt":"' || k || '","job_id":"' || job || '"}}' END AS raw
FROM f WHERE k % 10 IN (0, 1)"""
)
def dead_letters(spark, sf_dir):
    k = F.col("k")
    job = F.when(k % 10 == 0, "oops").when(k % 10 != 1, _uuid_of(F.col("user_id").cast("string")))
    fields = F.when(
        job.isNull(), F.create_map(F.lit("attempt"), k.cast("string"))
    ).otherwise(F.create_map(F.lit("job_id"), job, F.lit("attempt"), k.cast("string")))
    messages = event_rows(spark, sf_dir).select(F.col("event_id").alias("id"), fields.alias("fields"))
    _, dead = sinks.route_messages(messages)
    return dead.withColumnRenamed("id", "event_id")


_URL_SQL = """CASE page_id % 6 WHEN 0 THEN replace(url, '://', '://user:pw@')
  WHEN 1 THEN regexp_replace(url, '^([a-z]+://[^/]*)', '\\1:99999')
  WHEN 2 THEN regexp_replace(url, '^([a-z]+://[^/]*)', '\\1:8443')
  WHEN 3 THEN regexp_replace(url, '^([a-z]+)://[^/]*', 'https://') ELSE url END"""


@query(
    f"""WITH u AS (SELECT page_id, {_URL_SQL} AS url FROM pages),
p AS (SELECT *, regexp_extract(url, '^([a-z]+):', 1) AS scheme,
  regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS net FROM u),
q AS (SELECT *, regexp_extract(net, ':([0-9]+)$', 1) AS port FROM p)
SELECT page_id, net AS authority, CASE WHEN scheme <> 'https' THEN 'scheme' WHEN contains(net, '@') THEN 'credentials'
  WHEN port <> '' AND port::BIGINT > 65535 THEN 'port' WHEN net = '' THEN 'host' END AS problem FROM q"""
)
def url_targets(spark, sf_dir):
    v = F.col("page_id") % 6
    head = r"^([a-z]+://[^/]*)"
    url = (
        F.when(v == 0, F.replace("url", F.lit("://"), F.lit("://user:pw@")))
        .when(v == 1, F.regexp_replace("url", head, "$1:99999"))
        .when(v == 2, F.regexp_replace("url", head, "$1:8443"))
        .when(v == 3, F.regexp_replace("url", r"^([a-z]+)://[^/]*", "https://"))
        .otherwise(F.col("url"))
    )
    return load(spark, sf_dir, "pages").select("page_id", url.alias("url")).select(
        "page_id", urls.authority(F.col("url")).alias("authority"),
        urls.url_problem(F.col("url")).alias("problem"),
    )


_ADDRESSES = ("93.184.216.34", "10.0.0.1", "127.0.0.1", "169.254.169.254", "100.64.0.1", "224.0.0.1",
              "2606:4700::1111", "::1", "::ffff:10.0.0.1", "64:ff9b::808:808", "64:ff9b::a00:1", "fec0::1")
_PUBLIC = ("93.184.216.34", "2606:4700::1111", "64:ff9b::808:808")


@query(
    f"""WITH a AS (SELECT page_id, [{', '.join(f"'{x}'" for x in _ADDRESSES)}][page_id % 12 + 1] AS address FROM pages)
SELECT page_id, address, address IN ({', '.join(f"'{x}'" for x in _PUBLIC)}) AS public FROM a"""
)
def public_targets(spark, sf_dir):
    table = F.array(*[F.lit(a) for a in _ADDRESSES])
    address = F.element_at(table, (F.col("page_id") % 12 + 1).cast("int"))
    return load(spark, sf_dir, "pages").select("page_id", address.alias("address")).withColumn(
        "public", urls.is_public("address")
    )


def _sql_hmac(secrets: list[str], which: str, message: str) -> str:
    """HMAC-SHA256 with one of a few secrets, by its definition: two nested digests over the secret,
    filled up to a block and masked."""

    def masked(byte: int) -> str:
        blocks = [bytes(b ^ byte for b in s.encode().ljust(64, b"\0")).hex().upper() for s in secrets]
        return f"from_hex([{', '.join(repr(b) for b in blocks)}][{which}])"

    return f"sha256({masked(0x5C)} || from_hex(sha256({masked(0x36)} || encode({message}))))"


_SECRETS = ["secret0", "secret1", "secret2", "other"]
_SIGNED = "(1700000000 + page_id % 7) || '.' || html"


@query(
    f"""WITH s AS (SELECT page_id, 1700000000 + page_id % 7 AS stamp,
  {_sql_hmac(_SECRETS, 'page_id % 3 + 1', _SIGNED)} AS sent,
  {_sql_hmac(_SECRETS, 'CASE WHEN page_id % 5 = 0 THEN 4 ELSE page_id % 3 + 1 END', _SIGNED)} AS expected
  FROM pages)
SELECT page_id, 't=' || stamp || ',v1=' || sent AS header,
  coalesce(abs(1700000303 - stamp) <= 300 AND sent = expected, false) AS valid FROM s"""
)
def signature_audit(spark, sf_dir):
    """Every page as a delivery: signed, then audited with skew and a wrong secret mixed in."""
    stamp = F.lit(1_700_000_000).cast("bigint") + F.col("page_id") % 7
    secret = F.concat(F.lit("secret"), (F.col("page_id") % 3).cast("string"))
    signed = load(spark, sf_dir, "pages").withColumns({"stamp": stamp, "secret": secret}).withColumn(
        "header", ids.signature(F.col("secret"), F.col("stamp"), F.col("html"))
    )
    claimed = F.when(F.col("page_id") % 5 == 0, F.lit("other")).otherwise(F.col("secret"))
    now = F.lit(1_700_000_303).cast("bigint")
    return signed.select(
        "page_id",
        "header",
        ids.signature_valid(claimed, F.col("html"), F.col("header"), now).alias("valid"),
    )


_MAGIC = ("52494646000000005741564566", "464F524D0000000041494646", "664C6143", "4F676753",
          "0000001866747970", "1A45DFA3", "494433", "FFF1", "FFFB", "23455854")
_KINDS = ("wav", "aiff", "flac", "ogg", "mov", "matroska", "mp3", "aac", "mp3", None)


@query(
    f"""SELECT doc_id, [{', '.join('NULL' if k is None else f"'{k}'" for k in _KINDS)}][doc_id % 10 + 1] AS container,
sha256(from_hex([{', '.join(f"'{m}'" for m in _MAGIC)}][doc_id % 10 + 1]) || encode(text)) AS digest FROM documents"""
)
def container_probe(spark, sf_dir):
    magic = F.element_at(F.array(*[F.lit(m) for m in _MAGIC]), (F.col("doc_id") % 10 + 1).cast("int"))
    content = F.concat(F.unhex(magic), F.encode("text", "utf-8"))
    return load(spark, sf_dir, "documents").select("doc_id", content.alias("content")).select(
        "doc_id", audio.container(F.col("content")).alias("container"),
        ids.content_digest(F.col("content")).alias("digest"),
    )


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'wav' END AS container,
  CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 4 = 0 THEN 1 ELSE (doc_id % 3 + 1) END::INTEGER AS channels,
  CASE WHEN doc_id % 4 = 3 OR doc_id % 4 = 1 THEN NULL ELSE n_chars / 8.0::DOUBLE END AS header_duration_s,
  CASE WHEN doc_id % 8 = 7 THEN 'unsupported_media_type' WHEN doc_id % 4 = 3 THEN 'no_audio_stream' END AS error_code
FROM documents"""
)
def probe_info(spark, sf_dir):
    doc = F.col("doc_id")
    channels = F.when(doc % 4 != 0, (doc % 3 + 1).cast("string")).otherwise("null")
    duration = F.when(doc % 4 == 1, F.lit("N/A")).otherwise((F.col("n_chars") / 8.0).cast("string"))
    probe = F.when(doc % 8 == 7, F.lit("{broken")).otherwise(
        F.concat(
            F.lit('{"format":{"format_name":"wav","duration":"'), duration,
            F.lit('"},"streams":[{"codec_type":"video"},{"codec_type":"'),
            F.when(doc % 4 == 3, "data").otherwise("audio"),
            F.lit('","codec_name":"pcm","channels":'), channels, F.lit(',"sample_rate":"16000"}]}'),
        )
    )
    raw = load(spark, sf_dir, "documents").select("doc_id", probe.alias("probe"))
    return readers.probe_results(raw).select(
        "doc_id", "audio_info.container", "audio_info.channels", "audio_info.header_duration_s", "error_code"
    )


@query(
    """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS parts, (conv_id + turn) % 7 AS v FROM conversations)
SELECT conv_id, turn, CASE WHEN v <> 0 THEN len(parts) END AS words,
  CASE WHEN v = 0 THEN 'asr_engine_error' END AS error_code FROM w"""
)
def engine_responses(spark, sf_dir):
    v = (F.col("conv_id") + F.col("turn")) % 7
    items = F.transform(
        F.split("text", " "),
        lambda t, i: F.struct(
            t.alias("text"), (i * 0.5).alias("start"), (i * 0.5 + 0.25).alias("end"), F.lit("word").alias("type")
        ),
    )
    body = F.to_json(F.struct(F.lit("eng").alias("language_code"), items.alias("words")))
    raw = load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(v == 0, F.replace(body, F.lit('"start"'), F.lit('"begin"')))
        .otherwise(body).alias("body"),
    )
    good, bad = readers.engine_responses(raw)
    counted = good.select(
        "conv_id", "turn", F.size("response.words").cast("bigint").alias("words"),
        F.lit(None).cast("string").alias("error_code"),
    )
    return counted.unionByName(
        bad.select("conv_id", "turn", F.lit(None).cast("bigint").alias("words"), "error_code")
    )


@query(
    f"""WITH {EVENTS_SQL} SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
event_type AS logger, count(*) AS lines, sum(k)::BIGINT AS k FROM ev GROUP BY 1, 2"""
)
def log_levels(spark, sf_dir):
    line = F.to_json(
        F.struct(
            "ts", F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
            F.col("event_type").alias("logger"), F.lit("seen").alias("msg"), F.col("k"),
        )
    )
    lines = readers.log_lines(event_rows(spark, sf_dir).select(line.alias("value")))
    k = F.try_variant_get("rest", "$.k", "bigint")
    return lines.groupBy("level", "logger").agg(F.count(F.lit(1)).alias("lines"), F.sum(k).alias("k"))


@query(
    r"""SELECT doc_id, 'language' AS field, 'pattern' AS rule FROM documents WHERE doc_id % 5 = 1
UNION ALL SELECT doc_id, 'prompt', 'max_length' FROM documents WHERE n_chars > 800
UNION ALL SELECT doc_id, 'split_channels', 'boolean' FROM documents WHERE doc_id % 5 = 2
UNION ALL SELECT doc_id, 'model', 'unknown' FROM documents WHERE doc_id % 5 = 3"""
)
def option_violations(spark, sf_dir):
    v = F.col("doc_id") % 5
    options = F.to_json(
        F.struct(
            F.when(v == 1, "english").otherwise(F.col("lang")).alias("language"),
            F.col("text").alias("prompt"),
            F.when(v == 2, "maybe").otherwise("true").alias("split_channels"),
            F.when(v == 3, "big").alias("model"),
        )
    )
    docs = load(spark, sf_dir, "documents").select("doc_id", options.alias("options"))
    broken = docs.select("doc_id", F.explode(jobs.option_violations(F.col("options"))).alias("_b"))
    return broken.select("doc_id", "_b.field", "_b.rule")


# --- concurrency and metrics ----------------------------------------------------------------


@query(
    f"""WITH {INTERVALS_SQL}, chg AS (SELECT start AS us, 1 AS d FROM iv UNION ALL SELECT "end", -1 FROM iv),
t AS (SELECT us, sum(d) AS d FROM chg GROUP BY us)
SELECT us, sum(d) OVER (ORDER BY us)::BIGINT AS active FROM t"""
)
def concurrency(spark, sf_dir):
    return jobs.concurrency(event_intervals(spark, sf_dir))


_CENTS_SQL = f"""{EVENTS_SQL}, c AS (SELECT *, round(value * 100)::BIGINT AS cents FROM ev)"""


def _cents(spark, sf_dir) -> DataFrame:
    return event_rows(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))


@query(
    f"""WITH {_CENTS_SQL} SELECT event_type, count(*) AS total, sum(cents)::BIGINT AS cents FROM c GROUP BY event_type"""
)
def metric_counts(spark, sf_dir):
    rows = _cents(spark, sf_dir)
    amounts = metrics.counters(rows, ["event_type"], F.col("cents")).withColumnRenamed("total", "cents")
    return metrics.counters(rows, ["event_type"]).join(amounts, "event_type")


_LES = BUCKETS["job_processing_seconds"]


@query(
    f"""WITH {EVENTS_SQL}, le(label, bound) AS (VALUES {', '.join(f"('{b}', {b}::DOUBLE)" for b in _LES)}, ('+Inf', 1e300::DOUBLE))
SELECT event_type, label AS le, count(*) FILTER (WHERE value <= bound) AS count, count(*) AS n
FROM ev CROSS JOIN le GROUP BY event_type, label"""
)
def metric_histogram(spark, sf_dir):
    found = metrics.histogram(event_rows(spark, sf_dir), F.col("value"), _LES, ["event_type"])
    return found.select("event_type", "le", "count", "n")


@query(
    f"""WITH {EVENTS_SQL} SELECT event_type, arg_max(value, us) AS value FROM ev GROUP BY event_type"""
)
def metric_gauges(spark, sf_dir):
    return metrics.gauges(event_rows(spark, sf_dir), ["event_type"], "value", ["us"])


@query(
    f"""WITH {_CENTS_SQL} SELECT us // {HOUR_US} * {HOUR_US} AS start_us, event_type, count(*) AS n,
sum(cents)::BIGINT AS total FROM c GROUP BY 1, 2"""
)
def tumbling(spark, sf_dir):
    found = metrics.windows(_cents(spark, sf_dir), ["event_type"], length="1 hour", value="cents")
    return found.withColumn("start_us", epoch_us(F.col("window_start"))).drop("window_start")


@query(
    f"""WITH {_CENTS_SQL}, w AS (SELECT *, us // {HOUR_US} * {HOUR_US} - o * {HOUR_US} AS start_us
  FROM c CROSS JOIN (SELECT unnest(range(6)) AS o))
SELECT start_us, event_type, count(*) AS n, sum(cents)::BIGINT AS total FROM w GROUP BY 1, 2"""
)
def sliding(spark, sf_dir):
    found = metrics.windows(
        _cents(spark, sf_dir), ["event_type"], length="6 hours", slide="1 hour", value="cents"
    )
    return found.withColumn("start_us", epoch_us(F.col("window_start"))).drop("window_start")


@query(
    f"""WITH {EVENTS_SQL}, p AS (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS prev FROM ev),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev > {2 * HOUR_US} THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY us) AS sid FROM p)
SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def sessions(spark, sf_dir):
    return metrics.activity_sessions(event_rows(spark, sf_dir), ["user_id"], gap_us=2 * HOUR_US)
