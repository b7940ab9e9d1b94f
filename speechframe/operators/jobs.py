"""Job tables: filters, joins, pages, claims, dedupe. ``now`` is always an argument."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechframe.operators.ordered import HOT_ROWS, Hot, prefix_scan
from speechframe.schema import ERROR_CODES

ACTIVE = ("queued", "processing")
TERMINAL = ("succeeded", "failed")


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def _ago(now: str, seconds: int) -> Column:
    return at(now) - F.make_interval(secs=F.lit(seconds))


def is_active(status: Column | str = "status") -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*ACTIVE)


def authenticate(requests: DataFrame, api_keys: DataFrame, raw_key: str = "raw_key") -> DataFrame:
    """Resolve raw keys to active API keys; ``api_key_id`` is NULL and ``error_code``
    ``unauthorized`` for missing, unknown or revoked ones."""
    active = api_keys.where(F.col("revoked_at").isNull()).select(
        F.col("key_hash").alias("_hash"), F.col("id").alias("api_key_id")
    )
    hashed = requests.withColumn("_hash", F.sha2(F.col(raw_key), 256)).drop(raw_key)
    return (
        hashed.join(active, "_hash", "left")
        .drop("_hash")
        .withColumn("error_code", F.when(F.col("api_key_id").isNull(), "unauthorized"))
    )


def owned(jobs: DataFrame, api_key_id: str, job_id: str | None = None) -> DataFrame:
    rows = jobs.where(F.col("api_key_id") == api_key_id)
    return rows if job_id is None else rows.where(F.col("id") == job_id)


def list_page(
    jobs: DataFrame,
    api_key_id: str,
    *,
    limit: int = 20,
    before: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """One owner's newest jobs, one row beyond the page to know whether there is another."""
    rows = jobs.where(F.col("api_key_id") == api_key_id)
    if before is not None:
        rows = rows.where(F.col("created_at") < at(before))
    if status is not None:
        rows = rows.where(F.col("status") == status)
    newest = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit + 1)
    return _page(newest.withColumn("_one", F.lit(1)), ["_one"], limit).drop("_one")


def first_pages(jobs: DataFrame, *, limit: int = 20) -> DataFrame:
    """The first page of every owner. The rank filter is applied before the shuffle as well, so
    an owner of most rows sends only a page from each partition."""
    rank = Window.partitionBy("api_key_id").orderBy(F.desc("created_at"), F.desc("id"))
    top = jobs.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= limit + 1)
    return _page(top.drop("_rank"), ["api_key_id"], limit)


def _page(rows: DataFrame, owner: Sequence[str], limit: int) -> DataFrame:
    order = Window.partitionBy(*owner).orderBy(F.desc("created_at"), F.desc("id"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        rows.withColumn("position", F.row_number().over(order))
        .withColumn(
            "next_cursor",
            F.when(
                F.count(F.lit(1)).over(everything) > limit,
                F.max(F.when(F.col("position") == limit, F.col("created_at"))).over(everything),
            ),
        )
        .where(F.col("position") <= limit)
    )


def latest_by_fingerprint(jobs: DataFrame) -> DataFrame:
    """Most recent job that has not failed, per API key and fingerprint."""
    return (
        jobs.where(F.col("status") != "failed")
        .groupBy("api_key_id", "request_fingerprint")
        .agg(F.max_by("id", F.struct("created_at", "id")).alias("job_id"),
             F.max("created_at").alias("created_at"))
    )


def claim_outcomes(
    claims: DataFrame, jobs: DataFrame, *, now: str, max_attempts: int
) -> DataFrame:
    """What a claim of each job id would get at ``now``."""
    state = jobs.select(F.col("id").alias("job_id"), "status", "attempts", "lease_expires_at")
    live = (F.col("status") == "processing") & F.coalesce(
        F.col("lease_expires_at") >= at(now), F.lit(False)
    )
    expired = (F.col("status") == "processing") & F.coalesce(
        F.col("lease_expires_at") < at(now), F.lit(False)
    )
    outcome = (
        F.when(F.col("status").isNull(), "missing")
        .when(
            (F.col("attempts") < max_attempts) & ((F.col("status") == "queued") | expired),
            "claimed",
        )
        .when(F.col("status").isin(*TERMINAL), "terminal")
        .when(live, "busy")
        .when(F.col("attempts") >= max_attempts, "exhausted")
        .otherwise("busy")
    )
    return claims.join(state, "job_id", "left").select(*claims.columns, outcome.alias("outcome"))


def orphans(
    jobs: DataFrame,
    *,
    now: str,
    queued_older_than_s: int,
    lease_grace_s: int,
    limit: int | None = None,
    backlog: bool = False,
) -> DataFrame:
    """Jobs whose wake-up message may be lost, longest untouched first. With a backlog, queued
    jobs are merely waiting and are left alone."""
    grace = _ago(now, lease_grace_s)
    lost = (
        (F.col("status") == "processing")
        & (F.col("lease_expires_at") < grace)
        & (F.col("updated_at") < grace)
    )
    if not backlog:
        lost = lost | (
            (F.col("status") == "queued") & (F.col("updated_at") < _ago(now, queued_older_than_s))
        )
    found = jobs.where(lost)
    return found if limit is None else found.orderBy("updated_at", "id").limit(limit)


def due_deliveries(
    jobs: DataFrame, api_keys: DataFrame | None = None, *, now: str, limit: int | None = None
) -> DataFrame:
    """Deliveries due at ``now``, most overdue first, with the key's secret."""
    due = jobs.where(
        F.col("webhook_status").isin("pending", "sending") & (F.col("webhook_next_at") <= at(now))
    )
    if limit is not None:
        due = due.orderBy("webhook_next_at", "id").limit(limit)
    if api_keys is None:
        return due
    secrets = api_keys.select(F.col("id").alias("api_key_id"), "webhook_secret")
    return due.join(secrets, "api_key_id")


def touch_selected(jobs: DataFrame, selected: DataFrame, *, now: str) -> DataFrame:
    """Set ``updated_at`` of the selected jobs (ids) to ``now``."""
    marked = selected.select("id", F.lit(True).alias("_hit")).distinct()
    return (
        jobs.join(marked, "id", "left")
        .withColumn("updated_at", F.when(F.col("_hit"), at(now)).otherwise(F.col("updated_at")))
        .drop("_hit")
    )


def cascade_delete(chunk_results: DataFrame, deleted: DataFrame) -> DataFrame:
    """Chunk results that remain after their jobs are deleted."""
    return chunk_results.join(deleted.select(F.col("id").alias("job_id")), "job_id", "left_anti")


def upsert_latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``; partial aggregation keeps a busy key cheap."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def coalesce_once(old: str, new: Column) -> Column:
    """A time stamp that is set once (first start, audio deletion)."""
    return F.coalesce(F.col(old), new)


def keep_old_on_null(old: str, new: Column) -> Column:
    return F.coalesce(new, F.col(old))


def record_audio(jobs: DataFrame, facts: DataFrame) -> DataFrame:
    """Store probe facts; hash and size only where they were computed."""
    new = facts.select(
        F.col("job_id").alias("id"),
        F.col("audio_info").alias("_info"),
        F.col("audio_sha256").alias("_sha"),
        F.col("audio_bytes").alias("_bytes"),
    )
    return (
        jobs.join(new, "id", "left")
        .withColumn("audio_info", keep_old_on_null("audio_info", F.col("_info")))
        .withColumn("audio_sha256", keep_old_on_null("audio_sha256", F.col("_sha")))
        .withColumn("audio_bytes", keep_old_on_null("audio_bytes", F.col("_bytes")))
        .drop("_info", "_sha", "_bytes")
    )


def earliest_per_fingerprint(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Content dedupe: the earliest row of each group of copies, and the copies' count."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(
            F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select(*keys, "_row.*", "copies")
    )


def first_writer(
    requests: DataFrame,
    keys: Sequence[str] = ("api_key", "idempotency_key"),
    *,
    order: Sequence[str] = ("ts", "request_id"),
    fingerprint: str = "fingerprint",
    request: str = "request_id",
) -> DataFrame:
    """``outcome`` per request: created, replayed (same request again) or conflict; requests
    without an idempotency key are always created. The winner comes from a partial aggregate,
    so a key of many retries is not gathered in one task."""
    keyed = requests.where(F.col(keys[-1]).isNotNull())
    winners = keyed.groupBy(*keys).agg(
        F.min_by(F.struct(request, fingerprint), F.struct(*order)).alias("_w")
    )
    outcome = (
        F.when(F.col("_w")[request] == F.col(request), "created")
        .when(F.col("_w")[fingerprint] == F.col(fingerprint), "replayed")
        .otherwise("conflict")
    )
    decided = keyed.join(winners, list(keys)).select(
        *requests.columns, F.col("_w")[request].alias("winner"), outcome.alias("outcome")
    )
    free = requests.where(F.col(keys[-1]).isNull()).select(
        *requests.columns, F.col(request).alias("winner"), F.lit("created").alias("outcome")
    )
    return decided.unionByName(free)


def asof_duplicate(
    requests: DataFrame,
    jobs: DataFrame,
    *,
    pos: str = "us",
    keys: Sequence[str] = ("api_key_id", "request_fingerprint"),
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Most recent non-failed job with the same key and fingerprint created before each request.

    One ordered scan over both tables; at equal times a job counts as later."""
    wanted = requests.withColumn("_req", F.struct(*requests.columns)).select(
        *keys, F.col(pos).alias("_us"), F.lit(0).alias("_kind"), F.col("request_id").alias("_id"),
        "_req", F.lit(None).cast(jobs.schema["id"].dataType).alias("_job"),
    )
    known = jobs.where(F.col("status") != "failed").select(
        *keys, F.col(pos).alias("_us"), F.lit(1).alias("_kind"), F.col("id").alias("_id"),
        F.lit(None).cast(wanted.schema["_req"].dataType).alias("_req"), F.col("id").alias("_job"),
    )
    scanned = prefix_scan(
        wanted.unionByName(known), keys, ["_us", "_kind", "_id"],
        {"duplicate_of": ("last", F.col("_job"), False)}, hot_rows=hot_rows,
    )
    return scanned.where(F.col("_kind") == 0).select("_req.*", "duplicate_of")


def concurrency(
    intervals: DataFrame, *, start: str = "start", end: str = "end", hot_rows: int | None | Hot = HOT_ROWS
) -> DataFrame:
    """Number of open intervals after every change, ``(us, active)``. Times are microseconds.

    Changes are summed per instant, scanned within their day, and days carry over."""
    day_us = 86_400_000_000
    changes = (
        intervals.select(
            F.explode(
                F.array(
                    F.struct(F.col(start).alias("us"), F.lit(1).alias("d")),
                    F.struct(F.col(end).alias("us"), F.lit(-1).alias("d")),
                )
            ).alias("_c")
        )
        .select("_c.*")
        .groupBy("us")
        .agg(F.sum("d").alias("delta"))
        .withColumn("_day", F.floor(F.col("us") / day_us))
    )
    within = prefix_scan(
        changes, ["_day"], ["us"], {"_open": ("sum", F.col("delta"), True)}, hot_rows=hot_rows
    )
    # One row per day of the log: the only ungrouped window, and it is over days, not rows.
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        changes.groupBy("_day")
        .agg(F.sum("delta").alias("_net"))
        .select("_day", F.coalesce(F.sum("_net").over(earlier), F.lit(0)).alias("_carried"))
    )
    return within.join(carried, "_day").select(
        "us", (F.col("_carried") + F.col("_open")).alias("active")
    )


def progress(done: Column, total: Column) -> Column:
    """Percent of chunks done; NULL before there is a plan, 100 for an empty plan."""
    return (
        F.when(total.isNull(), F.lit(None).cast("double"))
        .when(total == 0, F.lit(100.0))
        .otherwise(100 * done / total)
    )


JOBS_PATH = "/v1/transcriptions"


def job_view(jobs: DataFrame, *, include_result: bool = False, include_segments: bool = True):
    """The client's view of jobs. Parts that do not apply are NULL: progress before the plan,
    audio before the probe, error without a code, webhook without a URL."""
    path = F.concat(F.lit(f"{JOBS_PATH}/"), F.col("id"))
    none = F.lit(None)
    done = F.col("status") == "succeeded"
    columns = [
        "id",
        "status",
        "created_at",
        "updated_at",
        "started_at",
        "finished_at",
        "options",
        F.when(
            F.col("chunks_total").isNotNull(),
            F.struct(
                "chunks_done",
                "chunks_total",
                progress(F.col("chunks_done"), F.col("chunks_total")).alias("percent"),
            ),
        ).alias("progress"),
        F.when(
            F.col("audio_info").isNotNull(),
            F.struct(
                F.col("audio_info.container"),
                F.col("audio_info.codec"),
                F.col("audio_info.channels"),
                F.col("duration_s"),
            ),
        ).alias("audio"),
        "language",
        "language_probability",
        F.when(
            F.col("error_code").isNotNull(),
            F.struct(
                F.col("error_code").alias("code"),
                F.col("error_status").alias("status"),
                F.col("error_message").alias("message"),
            ),
        ).alias("error"),
        F.when(
            F.col("webhook_url").isNotNull(),
            F.struct(
                F.col("webhook_url").alias("url"),
                F.col("webhook_status").alias("status"),
                F.col("webhook_attempts").alias("attempts"),
            ),
        ).alias("webhook"),
        F.struct(
            path.alias("self"), F.when(done, F.concat(path, F.lit("/subtitles"))).alias("subtitles")
        ).alias("links"),
    ]
    if include_result:
        segments = F.col("result.segments") if include_segments else none
        columns.append(
            F.when(
                done & F.col("result").isNotNull(),
                F.struct(
                    F.col("result.text").alias("text"),
                    segments.alias("segments"),
                    F.col("result.stats").alias("stats"),
                ),
            ).alias("result")
        )
    return jobs.select(*columns)


def option_violations(options: Column) -> Column:
    """Broken rules of request options, as ``array<struct<field, rule>>``. ``options`` is JSON
    text, so that unknown fields can be told."""
    known = ("language", "prompt", "split_channels", "word_timestamps")
    fields = F.coalesce(F.json_object_keys(options), F.array().cast("array<string>"))
    language = F.lower(F.trim(F.get_json_object(options, "$.language")))
    prompt = F.get_json_object(options, "$.prompt")

    def broken(when: Column, field: str, rule: str) -> Column:
        return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule")))

    flags = [
        broken(
            F.coalesce(~F.get_json_object(options, f"$.{name}").isin("true", "false"), F.lit(False)),
            name,
            "boolean",
        )
        for name in known[2:]
    ]
    checks = F.array(
        broken(F.coalesce(~language.rlike("^[a-z]{2,3}$"), F.lit(False)), "language", "pattern"),
        broken(F.coalesce(F.length(prompt) > 800, F.lit(False)), "prompt", "max_length"),
        *flags,
    )
    extra = F.transform(
        F.filter(fields, lambda f: ~f.isin(*known)),
        lambda f: F.struct(f.alias("field"), F.lit("unknown").alias("rule")),
    )
    return F.concat(F.filter(checks, lambda c: c.isNotNull()), extra)


def expired_objects(objects: DataFrame, *, prefix: str, days: int, now: str) -> DataFrame:
    """Objects under ``prefix`` older than ``days``."""
    return objects.where(
        F.startswith("path", F.lit(prefix))
        & (F.col("modificationTime") < at(now) - F.make_dt_interval(days=F.lit(days)))
    )


#: Intervals a round of the search for the oldest message kept divides its range into.
INTERVALS = 1024


def newest_messages(messages: DataFrame, keep: int, order: str = "id") -> DataFrame:
    """Trim a message table to the newest ``keep`` (the retention of the stream).

    The value of ``order``, a whole number, that the oldest kept message has is found by counting messages in
    ever smaller intervals, at most 1024 counts each time; then messages are filtered by it. Nothing is sorted,
    and no task holds more than its own rows, however many are kept. Of messages with that value, those
    with the greatest hash of all their columns stay, and of wholly equal ones as many as there is room
    for. Messages without a value are older than all others.
    """
    value = F.coalesce(F.col(order).cast("bigint"), F.lit(-(1 << 63)))
    ranked = messages.withColumns({"_value": value, "_hash": F.xxhash64(*messages.columns)})
    newer, at, room = _cutoff(ranked, "_value", keep)
    if at is None:
        return messages.limit(0) if keep <= 0 else messages
    kept = ranked.where(F.col("_value") > at)
    ties = ranked.where(F.col("_value") == at)
    _, tie, places = _cutoff(ties, "_hash", room)
    if tie is None:
        kept = kept.union(ties)
    else:
        # Equal hashes are equal messages but by rare chance, so which of them stay makes no difference.
        kept = kept.union(ties.where(F.col("_hash") > tie)).union(ties.where(F.col("_hash") == tie).limit(places))
    return kept.drop("_value", "_hash")


def _cutoff(rows: DataFrame, column: str, keep: int) -> tuple[int, int | None, int]:
    """How many rows lie above the ``keep``-th greatest value, that value, and how many rows of that value there is room
    for. No value if there is room for all rows, or for none."""
    low, high, total = rows.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
    if keep <= 0 or total <= keep:
        return 0, None, 0
    newer = 0
    while low < high:
        width = (high - low) // INTERVALS + 1
        # As decimals: the range of all whole numbers doesn't fit into one.
        behind = F.col(column).cast("decimal(20,0)") - F.lit(low)
        place = F.call_function("div", behind, F.lit(Decimal(width))).cast("int").alias("i")
        inside = rows.where(F.col(column).between(low, high))
        counts = dict(inside.groupBy(place).count().collect())
        for i in sorted(counts, reverse=True):
            if newer + counts[i] >= keep:
                break
            newer += counts[i]
        low, high = low + i * width, min(high, low + (i + 1) * width - 1)
    return newer, low, keep - newer


def error_facts(df: DataFrame, code: str = "error_code") -> DataFrame:
    """Attach HTTP status and retryability of error codes (a fixed table of twenty)."""
    flat = [F.lit(x) for name, (status, _) in ERROR_CODES.items() for x in (name, status)]
    retry = [F.lit(x) for name, (_, again) in ERROR_CODES.items() for x in (name, again)]
    return df.withColumn("error_status", F.try_element_at(F.create_map(*flat), F.col(code))).withColumn(
        "retryable", F.try_element_at(F.create_map(*retry), F.col(code))
    )
