"""Readers: audio objects, manifests, logs, engine responses, operational tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechframe.functions.ids import parse_object_key
from speechframe.operators.audio import Opened, audio_info, by_place
from speechframe.schema import CLIPS, DLQ, PROBE, RESPONSE


def audio_objects(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Audio objects with lazily read ``content``: queries that do not touch it never load it."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def object_digests(objects: DataFrame, *, piece_bytes: int = 1 << 20) -> DataFrame:
    """``(path, length, sha256)`` of listed objects, whatever their size: a task reads an object in
    pieces and holds one of them. The bytes are counted as they are read, so ``length`` is that of
    what was hashed; both are NULL for objects that can't be read. With columns ``recording_id``, ``offset`` and ``length``
    they are parts of objects: ``(recording_id, path, offset, length, sha256)``."""
    parts = "offset" in objects.columns
    kept = ["recording_id", "path", "offset"] if parts else ["path"]
    wanted = objects.select(*kept, "length") if parts else objects.select(
        "path", F.lit(0).cast("bigint").alias("offset"), F.lit(None).cast("bigint").alias("length")
    )
    schema = T.StructType([wanted.schema[c] for c in kept])
    schema = schema.add("length", T.LongType()).add("sha256", T.StringType())

    def digest(path: str | None, offset: int, length: int | None, opened: Opened) -> tuple[int | None, str | None]:
        total, state = 0, hashlib.sha256()
        try:
            if path is None:
                return None, None
            source = opened(path)
            while length is None or total < length:
                count = piece_bytes if length is None else min(piece_bytes, length - total)
                piece = source.read_at(count, offset + total)
                if not piece:
                    break
                total += len(piece)
                state.update(piece)
        except OSError:
            return None, None
        return total, state.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Opened() as opened:
            for batch in batches:
                places = zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")))
                found = [digest(*place, opened) for place in places]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in kept],
                        pa.array([size for size, _ in found], pa.int64()),
                        pa.array([value for _, value in found], pa.string()),
                    ],
                    names=schema.names,
                )

    return by_place(wanted, F.col("offset")).mapInArrow(run, schema)


def owned_objects(objects: DataFrame, prefix: str) -> DataFrame:
    """Objects under ``prefix`` with the ids their keys carry; foreign keys have NULL ids."""
    key = F.regexp_extract("path", f"({prefix}.*)$", 1)
    ids = parse_object_key(key, prefix)
    return objects.withColumn("_k", ids).select("*", "_k.*").drop("_k")


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation clips of JSON lines: ``(clips, rejects)``. ``audio`` is resolved against the
    file's directory. Lines that are no JSON of a clip, or have no id, are rejects ``(file, line)``;
    blank lines are neither."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    clip = F.from_json("value", f"{CLIPS}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value") != "").select("file", "value", clip.alias("_c"))
    complete = F.col("_c._bad").isNull() & F.col("_c.id").isNotNull()
    folder = F.regexp_replace("file", "/[^/]*$", "")
    clips = rows.where(complete).select(
        "_c.id", F.concat(folder, F.lit("/"), F.col("_c.audio")).alias("audio"), "_c.reference", "_c.tags"
    )
    return clips, rows.where(~complete).select("file", F.col("value").alias("line"))


def log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Structured log lines: fixed fields as columns, the rest as a variant. Works on streams."""
    parsed = F.try_parse_json(F.col(column))

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(parsed, f"$.{name}", kind).alias(name)

    return lines.select(
        field("ts", "timestamp"), field("level", "string"), field("logger", "string"),
        field("msg", "string"), parsed.alias("rest"),
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return log_lines(spark.read.text(path))


def stream_logs(spark: SparkSession, path: str) -> DataFrame:
    return log_lines(spark.readStream.text(path))


def engine_responses(raw: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """Hosted recogniser responses: ``(good, bad)``. Good rows carry ``response``; malformed JSON
    or a missing required field makes a bad row with an error code."""
    parsed = F.from_json(F.col(column), RESPONSE)
    complete = F.forall(
        F.col("response.words"),
        lambda w: w["text"].isNotNull() & w["start"].isNotNull() & w["end"].isNotNull()
        & w["type"].isNotNull(),
    )
    rows = raw.withColumn("response", parsed).withColumn("_ok", F.coalesce(complete, F.lit(False)))
    good = rows.where("_ok").drop("_ok", column)
    bad = rows.where("NOT _ok").select(
        *[c for c in raw.columns], F.lit("asr_engine_error").alias("error_code")
    )
    return good, bad


def response_words(good: DataFrame, keys: list[str]) -> DataFrame:
    return good.select(*keys, F.posexplode("response.words").alias("ord", "_w")).select(
        *keys, "ord", "_w.*"
    )


def probe_results(raw: DataFrame, column: str = "probe") -> DataFrame:
    """Probe JSON to ``audio_info`` or an error code."""
    parsed = F.from_json(F.col(column), PROBE)
    info = audio_info(F.col("_p"))
    known = F.col("_p.format.format_name").isNotNull()
    return (
        raw.withColumn("_p", parsed)
        .withColumn("audio_info", F.when(known, info))
        .withColumn(
            "error_code",
            F.when(~known, "unsupported_media_type").when(
                F.col("audio_info").isNull(), "no_audio_stream"
            ),
        )
        .drop("_p")
    )


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Snapshot of an operational table; filters and columns are pushed into the files."""
    return spark.read.schema(schema).parquet(path)


def jdbc_table(
    spark: SparkSession, url: str, name: str, *, column: str, lower: str, upper: str, partitions: int
) -> DataFrame:
    """Operational table read in parallel ranges of ``column``."""
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", name)
        .option("partitionColumn", column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", str(partitions))
        .load()
    )


def dead_letters(spark: SparkSession, path: str, count: int) -> DataFrame:
    """The oldest ``count`` dead letters."""
    return spark.read.schema(DLQ).json(path).orderBy("id").limit(count)

