"""Audio objects to transcripts as they arrive, with resume.

A batch is a table of objects (path, length, etag). For each, the plan and the results that the store has of
this very object are used again, only the missing chunks go to the recogniser, and guarded segments,
the transcript and errors are written back. The store is read in the buckets of the batch's recordings alone, so
a batch costs what it brings, however long the history is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframe.functions.language import normalise_language
from speechframe.operators import assemble, audio, chunks, engine, guards, onepass
from speechframe.operators.engine import Engine
from speechframe.operators.ordered import cut_lineage
from speechframe.schema import RAW_CHUNKS, WORD
from speechframe.sources.store import BUCKETS, RecordingStore

VERSION = "recording_id string, etag string"
TABLES = {
    # One row for each planned object: what its plan was made from.
    "recordings": f"{VERSION}, audio_samples bigint, channels int, speech_samples bigint",
    "plans": f"{VERSION}, channel int, index int, start bigint, end bigint, forced_cut boolean",
    "results": f"{RAW_CHUNKS}, etag string, channel int, start bigint, end bigint",
    "segments": (
        f"{VERSION}, chunk int, ord int, channel int, start double, end double, text string, "
        f"low_confidence boolean, reason string, words array<{WORD}>"
    ),
    "transcripts": (
        f"{VERSION}, language string, language_probability double, text string, "
        "segments array<struct<start:double,end:double,text:string,channel:int,low_confidence:boolean>>, "
        "audio_seconds double, speech_seconds double, transcribed_seconds double, speech_ratio double, "
        "chunks bigint, forced_cuts bigint, low_confidence_segments bigint, "
        "dropped_segments map<string,bigint>, engines map<string,bigint>"
    ),
    # Objects that can't be read (chunk is NULL) and chunks the recogniser failed on.
    "errors": f"{VERSION}, chunk int, error_code string, attempts int",
}
OBJECT = ["recording_id", "etag"]


def new_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the objects that appear under ``folder`` (any depth), by path. A file source sees each path
    once; where objects are replaced, read the store's notices (:func:`notices`)."""
    files = (
        spark.readStream.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .load(folder)
    )
    # The content isn't read: the path, time and length come from the listing.
    etag = F.concat_ws("-", F.unix_micros("modificationTime"), "length")
    return files.select("path", "length", etag.alias("etag"))


def notices(spark: SparkSession, inbox: str) -> DataFrame:
    """Stream of an object store's notices: JSON lines (path, length, etag[, language]). The notice of a replaced
    object names the same path with another etag; a repeated notice asks for what is missing."""
    return spark.readStream.schema("path string, length bigint, etag string, language string").json(inbox)


def recording_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> RecordingStore:
    return RecordingStore(spark, path, TABLES, buckets)


def transcribe_batch(
    batch: DataFrame,
    epoch: int,
    store: RecordingStore,
    engine_factory: Callable[[], Engine],
    *,
    split_channels: bool = False,
    max_seconds: int = audio.MAX_SECONDS,
    scan: dict | None = None,
    decoder: onepass.Decoder = onepass.read_frames,
    **options,
) -> None:
    """Bring the store up to date for objects ``(path, length, etag[, language])``.

    A recording is its whole path: equal base names in different folders are different recordings. Of several
    versions of a path in one batch the last etag in order counts. ``language`` is a requested one. An object
    that can't be read gives an error row and no transcript, and takes no other object down. Finished chunks are
    added to the store round by round; after a failure the next try of the batch finds them. A recording has a
    transcript when all its chunks have results; one without speech has an empty one.
    """
    asked = F.col("language") if "language" in batch.columns else F.lit(None).cast("string")
    newest = F.max_by(F.struct("etag", "length", asked.alias("language")), "etag").alias("_o")
    files = cut_lineage(
        batch.groupBy(F.col("path").alias("recording_id")).agg(newest)
        .select("recording_id", F.col("recording_id").alias("path"), "_o.*")
    )
    if files.isEmpty():
        return
    buckets = store.buckets_of(files)
    objects = files.select(*OBJECT)
    layouts = cut_lineage(audio.pcm_layouts(files, max_seconds=max_seconds).join(objects, "recording_id"))
    good = layouts.where(F.col("error_code").isNull())
    tracks = F.when(F.lit(split_channels), F.col("channels")).otherwise(F.lit(1))
    decoded = good.select(*OBJECT, audio.output_samples().alias("audio_samples"), tracks.alias("channels"))

    # Plans: those of this very decode are kept, the others made from one pass over the audio.
    stored = store.latest("recordings", OBJECT, buckets).join(objects, OBJECT)
    reused = cut_lineage(chunks.reusable_plans(stored, decoded.drop("etag")))
    fresh = good.join(reused.select("recording_id"), "recording_id", "left_anti")
    scans, regions, made = onepass.scan_files(
        fresh, split_channels=split_channels, decoder=decoder, **(scan or {})
    )
    versions = fresh.select(*OBJECT)
    store.put("plans", made.join(versions, "recording_id"), epoch)
    speech = regions.groupBy("recording_id").agg(F.sum(F.col("end") - F.col("start")).alias("speech_samples"))
    headers = decoded.join(versions, OBJECT, "left_semi").join(speech, "recording_id", "left").fillna(0, ["speech_samples"])
    # Written after the plans: a recording with a header has its whole plan.
    store.put("recordings", headers, epoch)
    recordings = cut_lineage(
        reused.select(*headers.columns).unionByName(headers)
    )
    kept = store.latest("plans", [*OBJECT, "index"], buckets).join(reused.select(*OBJECT), OBJECT)
    plan = cut_lineage(kept.drop("etag").unionByName(made))

    # Results: those of chunks as they are planned now are kept, the others heard.
    def finished() -> DataFrame:
        """The last result of each planned chunk."""
        rows = store.latest("results", [*OBJECT, "chunk"], buckets).join(objects, OBJECT)
        rows = rows.withColumnRenamed("chunk", "index")
        same = chunks.reusable_results(rows, plan, ["recording_id", "index"], ["channel", "start", "end"])
        return same.withColumnRenamed("index", "chunk")

    done = cut_lineage(finished().where(F.col("error_code").isNull()))
    requested = files.select("recording_id", normalise_language(F.col("language")).alias("_asked"))
    found = assemble.pin_language(done).select("recording_id", F.col("language").alias("_found"))
    known = requested.join(found, "recording_id", "left").select(
        "recording_id", F.coalesce("_asked", "_found").alias("language")
    )
    pending = chunks.pending_chunks(
        plan, done.withColumnRenamed("chunk", "index"), ["recording_id", "index"]
    )
    pending = cut_lineage(pending)
    spans = pending.select("recording_id", "channel", "index", "start", "end")

    def hear(wanted: DataFrame) -> DataFrame:
        rows = spans.join(wanted, ["recording_id", "index"])
        return engine.transcribe_spans(rows, good, engine_factory, decoder=decoder, **options)

    def save(rows: DataFrame) -> None:
        placed = rows.join(spans.withColumnRenamed("index", "chunk"), ["recording_id", "chunk"])
        store.add("results", placed.join(objects, "recording_id"), epoch)

    if not pending.isEmpty():
        engine.transcribe_pinned(spans.select("recording_id", "index"), hear, known, save=save)

    _publish(store, epoch, objects, layouts, plan, recordings, finished(), requested)


def _publish(store, epoch, objects, layouts, plan, recordings, results, requested) -> None:
    """Errors, guarded segments and the transcripts of recordings whose chunks are all there."""
    results = cut_lineage(results)
    unreadable = layouts.where(F.col("error_code").isNotNull()).select(
        *OBJECT, F.lit(None).cast("int").alias("chunk"), "error_code", F.lit(0).alias("attempts")
    )
    failed = results.where(F.col("error_code").isNotNull())
    store.put("errors", unreadable.unionByName(failed.select(*OBJECT, "chunk", "error_code", "attempts")), epoch)

    heard = results.where(F.col("error_code").isNull())
    wanted = plan.groupBy("recording_id").agg(F.count(F.lit(1)).alias("_planned"))
    there = heard.groupBy("recording_id").agg(F.count(F.lit(1)).alias("_heard"))
    whole = recordings.join(wanted, "recording_id", "left").join(there, "recording_id", "left")
    whole = cut_lineage(
        whole.where(F.coalesce("_planned", F.lit(0)) == F.coalesce("_heard", F.lit(0))).select(*recordings.columns)
    )
    complete = whole.select("recording_id")
    raw = engine.raw_segments(heard).join(complete, "recording_id")
    placed = guards.to_absolute(raw, plan)
    reasons = cut_lineage(guards.guard_reasons(placed))
    store.put("segments", reasons.join(objects, "recording_id"), epoch)

    texts = assemble.assemble_text(reasons.where(F.col("reason").isNull()))
    languages = assemble.pin_language(heard, requested.withColumnRenamed("_asked", "language"))
    stats = assemble.transcript_stats(
        plan.join(complete, "recording_id"),
        whole.select("recording_id", F.lit(0).alias("start"), F.col("speech_samples").alias("end")),
        heard.join(complete, "recording_id"),
        reasons,
        whole.select("recording_id", "audio_samples"),
    )
    out = (
        stats.join(objects, "recording_id")
        .join(texts.select("recording_id", "text", "segments"), "recording_id", "left")
        .join(languages, "recording_id", "left")
        .join(requested, "recording_id", "left")
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("segments", F.coalesce("segments", F.array().cast(_SEGMENTS)))
        .withColumn("language", F.coalesce("language", "_asked"))
        .withColumnRenamed("probability", "language_probability")
    )
    store.put("transcripts", out, epoch)


_SEGMENTS = "array<struct<start:double,end:double,text:string,channel:int,low_confidence:boolean>>"


def transcribe_stream(
    objects: DataFrame,
    store: RecordingStore,
    checkpoint: str,
    engine_factory: Callable[[], Engine],
    **options,
):
    """Bring the store up to date with a stream of objects (:func:`new_objects`, :func:`notices`), as far as it
    goes now. Returns the started query; await it. See :func:`transcribe_batch`."""

    def work(batch: DataFrame, epoch: int) -> None:
        transcribe_batch(batch, epoch, store, engine_factory, **options)

    return (
        objects.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def transcripts(store: RecordingStore) -> DataFrame:
    """The transcript of each version of each recording, as of the last batch that completed it."""
    return store.latest("transcripts", OBJECT)
