"""Recogniser seam: chunks with audio in, raw segments out, with bounded retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from speechframe.functions.language import normalise_language
from speechframe.operators import onepass
from speechframe.operators.assemble import serve_with_fallback
from speechframe.operators.ordered import cut_lineage
from speechframe.schema import RAW_CHUNKS


# A segment as an engine may leave it: scores and words it does not report are missing.
EMPTY_SEGMENT = dict.fromkeys(
    ("channel", "avg_logprob", "no_speech_prob", "compression_ratio", "words")
) | {"low_confidence": False}


class EngineFailure(Exception):
    """A failure an engine reports; anything else counts as permanent."""

    def __init__(self, code: str = "asr_engine_error", retryable: bool = True):
        super().__init__(code)
        self.code, self.retryable = code, retryable


class Engine(Protocol):
    name: str

    def transcribe(
        self, audio: np.ndarray, *, language: str | None, prompt: str | None, word_timestamps: bool
    ) -> dict:
        """``{"segments": [...], "language": ..., "language_probability": ...}`` of float32 audio
        in [-1, 1), times relative to its start."""
        ...


def transcribe_chunks(
    chunks: DataFrame,
    engine_factory: Callable[[], Engine],
    *,
    prompt: str | None = None,
    word_timestamps: bool = False,
    max_retries: int = 3,
    base_delay_s: float = 1.0,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Rows of ``RAW_CHUNKS`` for chunks ``(recording_id, index, samples, language)``.

    The engine is built once per task. Retryable failures are tried again with full jitter; what
    still fails becomes a row with ``error_code`` instead of failing the task.
    """
    wanted = chunks if "language" in chunks.columns else chunks.withColumn(
        "language", F.lit(None).cast("string")
    )

    def heard(batch: pa.RecordBatch) -> Iterator[tuple]:
        names = ("recording_id", "index", "language")
        for i, facts in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
            yield *facts, np.asarray(batch.column("samples")[i].values)

    task = _recogniser(
        engine_factory, heard, prompt, word_timestamps, max_retries, base_delay_s, sleep
    )
    return wanted.select("recording_id", "index", "language", "samples").mapInArrow(task, RAW_CHUNKS)


def transcribe_spans(
    chunks: DataFrame,
    layouts: DataFrame,
    engine_factory: Callable[[], Engine],
    *,
    decoder: onepass.Decoder = onepass.read_frames,
    prompt: str | None = None,
    word_timestamps: bool = False,
    max_retries: int = 3,
    base_delay_s: float = 1.0,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """As :func:`transcribe_chunks`, for chunks ``(recording_id, channel, index, start, end[, language])``
    of files with these layouts: each task reads the byte ranges of its own chunks. A chunk that can't be read is a
    row with ``undecodable_audio``, without an attempt."""
    wanted = chunks if "language" in chunks.columns else chunks.withColumn(
        "language", F.lit(None).cast("string")
    )

    def heard(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row in batch.to_pylist():
            try:
                samples = onepass.read_span(row, decoder)
            except (OSError, ValueError):
                samples = None
            yield row["recording_id"], row["index"], row["language"], samples

    task = _recogniser(
        engine_factory, heard, prompt, word_timestamps, max_retries, base_delay_s, sleep
    )
    spans = wanted.select("recording_id", "channel", "index", "start", "end", "language")
    placed = onepass.with_layouts(spans, layouts)
    # Chunks of one file are many, and each is expensive: deal them out one by one.
    return placed.repartition("recording_id", "index").mapInArrow(task, RAW_CHUNKS)


def _recogniser(engine_factory, heard, prompt, word_timestamps, max_retries, base_delay_s, sleep):
    schema = StructType.fromDDL(RAW_CHUNKS)
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = None
        for batch in batches:
            for rid, index, language, samples in heard(batch):
                engine = engine or engine_factory()
                if samples is None:
                    row = engine.name, None, None, None, "undecodable_audio", 0
                else:
                    scaled = samples.astype(np.float32) / np.float32(32768)
                    row = _attempt(
                        engine, scaled, language, prompt, word_timestamps, max_retries, base_delay_s, sleep
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], type=k) for v, k in zip((rid, index, *row), kinds)], names=schema.names
                )

    return run


def _attempt(engine, audio, language, prompt, word_timestamps, max_retries, base_delay_s, sleep):
    attempts = 0
    while True:
        attempts += 1
        try:
            found = engine.transcribe(
                audio, language=language, prompt=prompt, word_timestamps=word_timestamps
            )
        except EngineFailure as failure:
            if failure.retryable and attempts <= max_retries:
                sleep(random.uniform(0, base_delay_s * 2 ** (attempts - 1)))
                continue
            return engine.name, None, None, None, failure.code, attempts
        except Exception:  # a bad chunk must not take the other chunks of its task down
            return engine.name, None, None, None, "internal_error", attempts
        probability = None if language else found.get("language_probability")
        segments = [{**EMPTY_SEGMENT, **s} for s in found["segments"]]
        return (
            found.get("engine", engine.name), found.get("language"), probability, segments, None,
            attempts,
        )


def transcribe_recordings(
    chunks: DataFrame,
    engine_factory: Callable[[], Engine],
    requested: DataFrame | None = None,
    **options,
) -> DataFrame:
    """All chunks ``(recording_id, index, samples)``, the language pinned per recording by the first chunk that
    detects one, or as ``requested``."""
    def hear(wanted: DataFrame) -> DataFrame:
        own = chunks.drop("language").join(wanted, ["recording_id", "index"])
        return transcribe_chunks(own, engine_factory, **options)

    return transcribe_pinned(chunks.select("recording_id", "index"), hear, requested)


def transcribe_pinned(
    chunks: DataFrame,
    hear: Callable[[DataFrame], DataFrame],
    known: DataFrame | None = None,
    *,
    save: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Rows of ``RAW_CHUNKS`` for all ``(recording_id, index)``, as if each recording's chunks were heard in order:
    without a language until one detects it, with that language from the next chunk on.

    ``known`` ``(recording_id, language)`` are languages asked for or found before. ``hear`` transcribes rows
    ``(recording_id, index, language)``. Recordings without a language go on in rounds from their lowest
    undecided chunk, 1, 2, 4, ... chunks at a time; what lies behind a chunk that detects is heard again with its
    language. So there are as many rounds as the logarithm of the longest plan, at most twice the work until a
    language is known, and recordings and pinned chunks run side by side. ``save`` gets each round's rows.
    """
    ranked = chunks.select(
        "recording_id",
        "index",
        (F.row_number().over(Window.partitionBy("recording_id").orderBy("index")) - 1).alias("_rank"),
    )
    if known is None:
        ranked = ranked.withColumn("language", F.lit(None).cast("string"))
    else:
        code = normalise_language(F.col("language")).alias("language")
        ranked = ranked.join(known.select("recording_id", code), "recording_id", "left")
    ranked = cut_lineage(ranked)
    pinned = [ranked.where(F.col("language").isNotNull())]
    undecided = ranked.where(F.col("language").isNull())
    done, low, width = [], 0, 1

    def finish(rows: DataFrame) -> None:
        if save is not None:
            save(rows)
        done.append(rows)

    while not undecided.isEmpty():
        front = undecided.where((F.col("_rank") >= low) & (F.col("_rank") < low + width))
        # Read several times, and recognition is by far the most expensive step.
        heard = cut_lineage(hear(front.drop("_rank")))
        found = normalise_language(F.col("language"))
        detected = heard.where(found.isNotNull()).groupBy("recording_id").agg(
            F.min("chunk").alias("_at"), F.min_by(found, "chunk").alias("_pin")
        )
        in_order = F.col("_at").isNull() | (F.col("chunk") <= F.col("_at"))
        finish(heard.join(detected, "recording_id", "left").where(in_order).drop("_at", "_pin"))
        after = undecided.join(detected, "recording_id", "left")
        after = cut_lineage(
            after.where((F.col("index") > F.col("_at")) | (F.col("_at").isNull() & (F.col("_rank") >= low + width)))
            .withColumn("language", F.col("_pin"))
            .drop("_at", "_pin")
        )
        pinned.append(after.where(F.col("language").isNotNull()))
        undecided = after.where(F.col("language").isNull())
        low, width = low + width, 2 * width
    rest = pinned[0]
    for part in pinned[1:]:
        rest = rest.union(part)
    last = hear(rest.drop("_rank"))
    finish(last if save is None else cut_lineage(last))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


class Failover:
    """An engine with a second one behind it and a breaker between: a chunk that the first is
    unavailable for goes to the second at once, without a retry. After ``threshold`` of these in a
    row the first is left alone for ``reset_s``; then one chunk is its trial. Any other failure
    shows that the first is there, and stays the chunk's own.

    Built by :func:`transcribe_chunks` once per task, so every task has a breaker of its own. Rows
    name the engine that answered; errors are under the first one's name."""

    def __init__(
        self, primary: Engine, second: Engine, *, threshold: int = 3, reset_s: float = 60.0,
        clock: Callable[[], float] = time.monotonic,
    ):
        self.primary, self.second, self.name = primary, second, primary.name
        self.threshold, self.reset_s, self.clock = threshold, reset_s, clock
        self.failures, self.retry_at = 0, 0.0

    def transcribe(self, audio: np.ndarray, **options) -> dict:
        if self.failures < self.threshold or self.clock() >= self.retry_at:
            try:
                found = self.primary.transcribe(audio, **options)
            except EngineFailure as failure:
                if failure.code != "asr_engine_unavailable":
                    self.failures = 0
                    raise
                self.failures += 1
                self.retry_at = self.clock() + self.reset_s
            else:
                self.failures = 0
                return {"engine": self.primary.name, **found}
        return {"engine": self.second.name, **self.second.transcribe(audio, **options)}


def with_fallback(
    chunks: DataFrame, primary: DataFrame, fallback_factory: Callable[[], Engine], **options
) -> DataFrame:
    """Chunks the primary engine was unavailable for go to the fallback engine; other errors stay
    (the primary answered, a second engine would not help)."""
    primary = cut_lineage(primary)
    down = primary.where(F.col("error_code") == "asr_engine_unavailable").select(
        "recording_id", F.col("chunk").alias("index")
    )
    again = chunks.join(down, ["recording_id", "index"], "left_semi")
    served = primary.where(~F.col("error_code").eqNullSafe(F.lit("asr_engine_unavailable")))
    return serve_with_fallback(
        served, transcribe_chunks(again, fallback_factory, **options), ["recording_id", "chunk"]
    )


def raw_segments(raw: DataFrame) -> DataFrame:
    """Engine rows to the common segment shape, one row per segment; failed chunks have none."""
    return raw.where(F.col("error_code").isNull()).select(
        "recording_id", "chunk", "engine",
        F.posexplode("segments").alias("ord", "_s"),
    ).select(
        "recording_id", "chunk", "engine", "ord", "_s.start", "_s.end", "_s.text",
        "_s.avg_logprob", "_s.no_speech_prob", "_s.compression_ratio", "_s.words",
    )
