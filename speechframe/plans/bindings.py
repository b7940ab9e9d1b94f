"""The given tables read as speech-corpus tables.

Every binding exists twice: as a DataFrame and as the equal SQL text (``*_SQL``) that the checks
run in DuckDB. Scores and flags that the tables lack are computed from their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframe.functions.text import SPACES, strip
from speechframe.functions.timing import epoch_us

NOW = "2001-08-01 12:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of texts for work that is heavy per row. A scan with fewer partitions than cores
    (one small file) is spread by key; a scan of many files is left alone."""
    rows = load(spark, sf_dir, name)
    if rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(spark.sparkContext.defaultParallelism, key)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACES}+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split({sql_squeeze(x)}, ' '), lambda t: t <> '')"


# --- documents: one line is one raw segment, fifty lines are one chunk ---------------------


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load_texts(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")
    )
    doc, ord_ = F.col("doc_id"), F.col("ord")
    logprob = -((doc * 31 + ord_ * 17) % 150) / F.lit(100.0)
    return lines.select(
        "doc_id",
        F.floor(ord_ / 50).alias("chunk"),
        ord_.cast("bigint").alias("ord"),
        (ord_ * F.lit(2.0)).alias("start"),
        (ord_ * F.lit(2.0) + 1.5).alias("end"),
        strip(F.col("line")).alias("text"),
        logprob.alias("avg_logprob"),
        (((doc * 13 + ord_ * 7) % 100) / F.lit(100.0)).alias("no_speech_prob"),
        F.when(
            (doc + ord_) % 10 != 0, ((doc * 7 + ord_ * 3) % 300) / F.lit(100.0)
        ).alias("compression_ratio"),
        (logprob < -0.7).alias("low_confidence"),
    )


LINES_SQL = f"""
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord
  FROM documents),
segments AS (
  SELECT doc_id, ord // 50 AS chunk, ord, ord * 2.0::DOUBLE AS start,
         {sql_strip('line')} AS text,
         -((doc_id * 31 + ord * 17) % 150) / 100.0::DOUBLE AS avg_logprob,
         ((doc_id * 13 + ord * 7) % 100) / 100.0::DOUBLE AS no_speech_prob,
         CASE WHEN (doc_id + ord) % 10 <> 0
              THEN ((doc_id * 7 + ord * 3) % 300) / 100.0::DOUBLE END AS compression_ratio
  FROM lines)"""


# --- conversations: one turn is one segment, the role is the channel -----------------------


def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load_texts(spark, sf_dir, "conversations", "conv_id")
    text = strip(F.col("text"))
    start = F.col("turn") * F.lit(15.25)
    return turns.select(
        "conv_id",
        F.lit(0).cast("bigint").alias("chunk"),
        F.col("turn").alias("ord"),
        F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).alias("channel"),
        start.alias("start"),
        (start + F.length(text) * F.lit(0.0625)).alias("end"),
        text.alias("text"),
        F.lit(False).alias("low_confidence"),
    )


TURNS_SQL = f"""
turns AS (
  SELECT conv_id, turn AS ord,
         CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS channel,
         turn * 15.25::DOUBLE AS start,
         turn * 15.25::DOUBLE + length({sql_strip('text')}) * 0.0625::DOUBLE AS "end",
         {sql_strip('text')} AS text
  FROM conversations)"""


# --- events: intervals, words, requests, attempts, logs -------------------------------------


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return events.select(
        "event_id", "ts", epoch_us(F.col("ts")).alias("us"), "user_id", "event_type", "value",
        k.alias("k"),
    )


EVENTS_SQL = """
ev AS (
  SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, value,
         regexp_extract(props, '[0-9]+')::BIGINT AS k
  FROM events)"""


def length_us(seconds_per_unit: int) -> Column:
    return F.floor(F.col("value") * F.lit(seconds_per_unit * 1_000_000.0)).cast("bigint")


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of five minutes per unit of ``value`` per user, in microseconds."""
    return event_rows(spark, sf_dir).select(
        "user_id", F.col("us").alias("start"), (F.col("us") + length_us(300)).alias("end")
    )


INTERVALS_SQL = (
    EVENTS_SQL
    + """,
iv AS (
  SELECT user_id, us AS start, us + floor(value * 300000000.0::DOUBLE)::BIGINT AS "end" FROM ev)"""
)


# --- orders and line items: jobs and their chunks -------------------------------------------


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "O", "queued")
        .when(F.col("o_orderstatus") == "P", "processing")
        .when(key % 4 == 0, "failed")
        .otherwise("succeeded")
    )

    def later(seconds: Column, base: str = "created_at") -> Column:
        return F.timestamp_add("SECOND", seconds.cast("int"), F.col(base))

    jobs = load(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("api_key_id"),
        status.alias("status"),
        (key % 5).alias("attempts"),
        F.col("o_orderpriority").alias("request_fingerprint"),
        F.timestamp_add("SECOND", (key % 86400).cast("int"), F.col("o_orderdate").cast("timestamp"))
        .alias("created_at"),
    )
    done = F.col("status").isin("succeeded", "failed")
    jobs = jobs.withColumn("updated_at", later(F.col("id") % 7200))
    return jobs.withColumns(
        {
            "lease_expires_at": F.when(
                F.col("status") == "processing", later(F.col("id") % 600, "updated_at")
            ),
            "webhook_status": F.when(
                done & (F.col("id") % 3 == 0),
                F.when(F.col("id") % 2 == 0, "pending").otherwise("sending"),
            ),
            "webhook_next_at": F.when(
                done & (F.col("id") % 3 == 0), later((F.col("id") % 40) * 864000, "updated_at")
            ),
            "error_code": F.when(F.col("status") == "failed", "undecodable_audio"),
            "chunks_total": F.when(F.col("status") != "queued", (F.col("id") % 7).cast("int")),
        }
    )


JOBS_SQL = """
jobs0 AS (
  SELECT o_orderkey AS id, o_custkey AS api_key_id,
         CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'processing'
              WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
         o_orderkey % 5 AS attempts, o_orderpriority AS request_fingerprint,
         o_orderdate + to_seconds(o_orderkey % 86400) AS created_at
  FROM orders),
jobs1 AS (SELECT *, created_at + to_seconds(id % 7200) AS updated_at FROM jobs0),
jobs AS (
  SELECT *,
    CASE WHEN status = 'processing' THEN updated_at + to_seconds(id % 600) END AS lease_expires_at,
    CASE WHEN status IN ('succeeded', 'failed') AND id % 3 = 0
         THEN CASE WHEN id % 2 = 0 THEN 'pending' ELSE 'sending' END END AS webhook_status,
    CASE WHEN status IN ('succeeded', 'failed') AND id % 3 = 0
         THEN updated_at + to_seconds((id % 40) * 864000) END AS webhook_next_at,
    CASE WHEN status = 'failed' THEN 'undecodable_audio' END AS error_code,
    CASE WHEN status <> 'queued' THEN id % 7 END AS chunks_total
  FROM jobs1)"""
