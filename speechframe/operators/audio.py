"""Audio objects as tables: identification, decoding to PCM blocks, energy, speech regions."""

from __future__ import annotations

import io
import math
import struct as binary
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.operators.regions import close_gaps
from speechframe.schema import PCM_BLOCKS, SAMPLE_RATE

BLOCK_SAMPLES = 10 * SAMPLE_RATE
MAX_SECONDS = 4 * 3600
#: The resampling filter: zero crossings of the sinc at each side, the band of higher rates that passes
#: as a share of half of 16 kHz, and the shape of its Kaiser window.
ZERO_CROSSINGS = 32
PASS_BAND = 0.92
KAISER_BETA = 8.6
#: Weights that a task keeps for a rate, and those it multiplies at a time.
TABLE_WEIGHTS = 2_000_000
PIECE_WEIGHTS = 1_000_000
#: Bytes of a recording that are read with its first chunk, and those of an object that go to one task.
HEAD_BYTES = 256
PLACE_BYTES = 1 << 18
#: Samples of the blocks that a task gives back at a time, or little more.
BATCH_SAMPLES = 1 << 20


def container(content: Column) -> Column:
    """Container by magic numbers, NULL for anything not on the list; names and extensions are
    ignored, so playlists and scripts fall through."""

    def at(offset: int, length: int) -> Column:
        return F.hex(F.substring(content, offset + 1, length))

    def text(value: str) -> str:
        return value.encode().hex().upper()

    sync = F.conv(at(0, 2), 16, 10).cast("int")
    layer = sync.bitwiseAND(0x0006)
    is_sync = sync.bitwiseAND(0xFFE0) == 0xFFE0
    return (
        F.when((at(0, 4) == text("RIFF")) & (at(8, 4) == text("WAVE")), "wav")
        .when((at(0, 4) == text("FORM")) & at(8, 4).isin(text("AIFF"), text("AIFC")), "aiff")
        .when(at(0, 4) == text("fLaC"), "flac")
        .when(at(0, 4) == text("OggS"), "ogg")
        .when(at(4, 4) == text("ftyp"), "mov")
        .when(at(0, 4) == "1A45DFA3", "matroska")
        .when(at(0, 3) == text("ID3"), "mp3")
        .when(sync.bitwiseAND(0xFFF6) == 0xFFF0, "aac")
        .when(is_sync & (layer != 0), "mp3")
    )


def _wav_facts(content: pd.Series) -> pd.DataFrame:
    names = ["channels", "rate", "bits", "frames", "size"]
    rows = []
    for data in content:
        facts = None
        if data is not None and data[:4] == b"RIFF":
            facts = _header_facts(io.BytesIO(data), len(data))
        if facts is None:
            rows.append((None,) * 5)
            continue
        width = facts["channels"] * facts["bits"] // 8
        frames = facts["declared"] // width if width else None
        rows.append((facts["channels"], facts["rate"], facts["bits"], frames, facts["declared"]))
    return pd.DataFrame(rows, columns=names, dtype="Int64")


def wav_header(content: Column) -> Column:
    """``struct<channels, rate, bits, frames, duration_s>`` of a WAV file, as its chunks declare it,
    wherever they stand. NULL for other files, and for those without format or data."""
    facts = F.pandas_udf(_wav_facts, "channels int, rate int, bits int, frames bigint, size bigint")(content)
    seconds = F.try_divide(facts["frames"].cast("double"), facts["rate"].cast("double"))
    return F.when(
        facts["size"].isNotNull(),
        F.struct(
            facts["channels"].alias("channels"), facts["rate"].alias("rate"), facts["bits"].alias("bits"),
            facts["frames"].alias("frames"), seconds.alias("duration_s"),
        ),
    )


def audio_info(probe: Column) -> Column:
    """First audio stream of parsed probe output, NULL without one."""
    stream = F.try_element_at(
        F.filter(probe["streams"], lambda s: s["codec_type"] == "audio"), F.lit(1)
    )
    channels = F.coalesce(F.nullif(stream["channels"], F.lit(0)), F.lit(1))
    return F.when(
        stream.isNotNull(),
        F.struct(
            probe["format"]["format_name"].alias("container"),
            stream["codec_name"].alias("codec"),
            channels.alias("channels"),
            stream["sample_rate"].try_cast("int").alias("sample_rate"),
            probe["format"]["duration"].try_cast("double").alias("header_duration_s"),
        ),
    )


def open_object(path: str):
    """An object of any file system, for reading at any place; read inside tasks."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(inner)


class ObjectPart:
    """A recording inside an object, read from any place of it as if it were an object of its own."""

    def __init__(self, source, offset: int, length: int):
        self.source, self.offset, self.length, self.at = source, offset, length, 0
        self.head = source.read_at(min(length, HEAD_BYTES), offset)

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, count: int) -> bytes:
        end = min(self.at + count, self.length)
        if end <= len(self.head):
            data = self.head[self.at : end]
        else:
            data = self.source.read_at(end - self.at, self.offset + self.at) if self.at < end else b""
        self.at += len(data)
        return data


class Opened:
    """The object that a task has open: rows of one object that follow each other open it once."""

    def __init__(self):
        self.path = self.source = None

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_) -> None:
        self._close()

    def _close(self) -> None:
        if self.source is not None:
            self.source.close()
        self.path = self.source = None

    def __call__(self, path: str):
        if path != self.path:
            self._close()
            self.source, self.path = open_object(path), path
        return self.source


def by_place(rows: DataFrame, at: Column) -> DataFrame:
    """Rows ``(path, ...)`` dealt by where in their object they read (``at``, in bytes), and each task's in that order:
    what lies near each other is read by one task, and a large object by many. They are spread over the session's
    number of partitions whatever they weigh themselves, as it is the bytes they name that take the time."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "path", F.floor(at / PLACE_BYTES)).sortWithinPartitions("path", at)


def _pcm_layout(source, size: int) -> dict | None:
    """Channels, rate, bits, byte order and data range of PCM or float WAV, AIFF or AIFC, else None."""
    facts = _header_facts(source, size)
    if facts is None:
        return None
    widths = {"int": (8, 16, 24, 32), "float": (32, 64)}.get(facts["encoding"], ())
    return facts if facts["bits"] in widths else None


def _header_facts(source, size: int) -> dict | None:
    """What the chunks of a WAV or AIFF file say, wherever they stand: the reader goes from one
    chunk's head to the next."""
    head = source.read(12)
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        order, wanted, read = "<", (b"fmt ", b"data"), _wav_chunk
    elif head[:4] == b"FORM" and head[8:12] in (b"AIFF", b"AIFC"):
        order, wanted, read = ">", (b"COMM", b"SSND"), _aiff_chunk
    else:
        return None
    at, facts = 12, {"order": order, "compressed": head[8:12] == b"AIFC"}
    while at + 8 <= size and not ("offset" in facts and "bits" in facts):
        source.seek(at)
        name_and_length = source.read(8)
        if len(name_and_length) < 8:
            break
        name, length = name_and_length[:4], binary.unpack(f"{order}I", name_and_length[4:])[0]
        if name in wanted:
            read(name, source.read(min(length, 40)), at + 8, length, facts)
        at += 8 + length + length % 2
    if "offset" not in facts or "bits" not in facts:
        return None
    return facts | {"bytes": min(facts["declared"], size - facts["offset"])}


def _wav_chunk(name, body, at, length, facts):
    if name == b"fmt " and len(body) >= 16:
        kind, facts["channels"], facts["rate"], _, _, facts["bits"] = binary.unpack("<HHIIHH", body[:16])
        if kind == 0xFFFE and len(body) >= 26:  # the real tag begins the sub-format
            kind = binary.unpack("<H", body[24:26])[0]
        facts["encoding"] = {1: "int", 3: "float"}.get(kind)
    elif name == b"data":
        facts["offset"], facts["declared"] = at, length


# Compression types of AIFC that hold plain samples, with their encoding and byte order.
AIFC_KINDS = {
    b"NONE": ("int", ">"),
    b"twos": ("int", ">"),
    b"in24": ("int", ">"),
    b"in32": ("int", ">"),
    b"sowt": ("int", "<"),
    b"fl32": ("float", ">"),
    b"FL32": ("float", ">"),
    b"fl64": ("float", ">"),
    b"FL64": ("float", ">"),
}


def _aiff_chunk(name, body, at, length, facts):
    if name == b"COMM" and len(body) >= 18:
        facts["channels"], _, facts["bits"] = binary.unpack(">hIh", body[:8])
        kind = body[18:22] if facts["compressed"] else b"NONE"
        facts["encoding"], facts["order"] = AIFC_KINDS.get(kind, (None, ">"))
        exponent, mantissa = binary.unpack(">HQ", body[8:18])
        facts["rate"] = int(math.ldexp(mantissa, (exponent & 0x7FFF) - 16383 - 63))
    elif name == b"SSND":
        facts["offset"], facts["declared"] = at + 8, length - 8


_LAYOUT = (
    "recording_id string, path string, channels int, rate int, bits int, byte_order string, "
    "data_offset bigint, frames bigint, error_code string, encoding string"
)


def pcm_layouts(files: DataFrame, *, max_seconds: int = MAX_SECONDS) -> DataFrame:
    """Header facts of audio files ``(recording_id, path, length)``; only the heads of the chunks
    of each file are read. Unreadable ones, and those of more than ``max_seconds``, carry
    ``error_code``. With a column ``offset``, a file is the part of an object that begins there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Opened() as opened:
            for batch in batches:
                yield facts_of(batch, opened)

    def facts_of(batch: pa.RecordBatch, opened: Opened) -> pa.RecordBatch:
        rows = []
        for rid, path, size, offset in zip(*(batch.column(c).to_pylist() for c in wanted)):
            facts = None
            try:
                facts = _pcm_layout(ObjectPart(opened(path), offset, size), size)
            except OSError:
                facts = None
            if facts is None or facts["channels"] <= 0 or facts["rate"] <= 0:
                rows.append((rid, path, *[None] * 6, "undecodable_audio", None))
                continue
            frames = facts["bytes"] // (facts["channels"] * facts["bits"] // 8)
            error = None
            if frames <= 0:
                error = "undecodable_audio"
            elif frames > max_seconds * facts["rate"]:
                error = "audio_too_long"
            rows.append((rid, path, facts["channels"], facts["rate"], facts["bits"],
                         facts["order"], offset + facts["offset"], frames, error, facts["encoding"]))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(),
                 pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows)) or [[] for _ in kinds]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(v), type=k) for v, k in zip(columns, kinds)],
            names=[c.split()[0] for c in _LAYOUT.split(", ")],
        )

    wanted = ["recording_id", "path", "length", "offset"]
    if "offset" not in files.columns:
        files = files.withColumn("offset", F.lit(0).cast("bigint"))
    return by_place(files.select(*wanted), F.col("offset")).mapInArrow(run, _LAYOUT)


def output_samples() -> Column:
    return F.floor(F.col("frames") * F.lit(SAMPLE_RATE) / F.col("rate"))


def track_lengths(layouts: DataFrame, *, split_channels: bool = False) -> DataFrame:
    """``(recording_id, channel, audio_samples)`` of readable files, from their headers."""
    several = F.lit(split_channels) & (F.col("channels") > 1)
    tracks = F.when(several, F.sequence(F.lit(0), F.col("channels") - 1)).otherwise(
        F.array(F.lit(None).cast("int"))
    )
    return layouts.where(F.col("error_code").isNull()).select(
        "recording_id", F.explode(tracks).alias("channel"), output_samples().alias("audio_samples")
    )


def decode_blocks(
    layouts: DataFrame, *, split_channels: bool = False, block_samples: int = BLOCK_SAMPLES
) -> DataFrame:
    """16 kHz int16 blocks of readable files. A block is the unit of work: each task seeks to the
    byte ranges it needs, so one long file is decoded in parallel. Channels are averaged, or kept
    apart with ``split_channels``; other rates are resampled (:func:`read_frames`)."""
    names = ["recording_id", "channel", "block_idx", "start_sample", "samples"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int16())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        with decoding() as decode:
            for batch in batches:
                for row in batch.to_pylist():
                    first = row["block_idx"] * block_samples
                    count = min(block_samples, row["_n"] - first)
                    frames = decode(row, first, count)
                    tracks = (
                        [(c, frames[:, c]) for c in range(row["channels"])]
                        if split_channels and row["channels"] > 1
                        else [(None, frames.mean(axis=1))]
                    )
                    for channel, track in tracks:
                        samples = np.clip(np.rint(track), -32768, 32767).astype(np.int16)
                        out.append((row["recording_id"], channel, row["block_idx"], first, samples))
                        held += len(samples)
                    if held >= BATCH_SAMPLES:
                        yield column_batch(out, kinds, names)
                        out, held = [], 0
                if out:
                    yield column_batch(out, kinds, names)
                    out, held = [], 0

    return block_rows(layouts, block_samples).mapInArrow(run, PCM_BLOCKS)


def column_batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """Rows as they were gathered by a task."""
    columns = list(zip(*rows)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(v), type=k) for v, k in zip(columns, kinds)], names=names)


def block_rows(layouts: DataFrame, block_samples: int) -> DataFrame:
    """A row with ``block_idx`` and ``_n`` (the file's output samples) for every block of readable files, dealt by
    where in their objects the blocks lie."""
    last = F.ceil(F.col("_n") / block_samples).cast("int") - 1
    rows = (
        layouts.where(F.col("error_code").isNull())
        .withColumn("_n", output_samples())
        .where(F.col("_n") > 0)
        .withColumn("block_idx", F.explode(F.sequence(F.lit(0), last)))
    )
    return by_place(rows, sample_place(F.col("block_idx").cast("bigint") * block_samples))


def sample_place(sample: Column) -> Column:
    """Where an output sample of a layout's file lies in its object, in bytes. A decoder of one's own may have files
    whose headers don't say it; there it need only grow with the sample."""
    width = F.coalesce(F.col("rate") * F.col("channels") * F.col("bits") / (8 * SAMPLE_RATE), F.lit(2.0))
    return F.coalesce("data_offset", F.lit(0).cast("bigint")) + F.floor(sample * width)


@contextmanager
def decoding(decoder: Callable | None = None):
    """What one task decodes with: :func:`read_frames`, keeping its object open, or a decoder of one's own."""
    if decoder is None or decoder is read_frames:
        with Opened() as opened:
            yield partial(read_frames, opened=opened)
    else:
        yield decoder


def read_frames(row: dict, first: int, count: int, opened: Opened | None = None) -> np.ndarray:
    """Output samples ``[first, first + count)`` as float64, shape (count, channels).

    Other rates than 16 kHz go through a windowed sinc filter, whose halo before and behind the range
    is read along, so the samples don't depend on how a file is cut. Of higher rates what lies above 8 kHz is
    taken out; samples of lower ones pass as they are where a place meets them. Before its start and
    behind its end a file goes on with its outermost sample."""
    rate, channels, width = row["rate"], row["channels"], row["bits"] // 8
    halo = 0 if rate == SAMPLE_RATE else _half_taps(rate)
    low = max(0, first * rate // SAMPLE_RATE - halo)
    high = min(row["frames"], (first + count - 1) * rate // SAMPLE_RATE + halo + 1)
    with nullcontext(opened) if opened else Opened() as held:
        start = row["data_offset"] + low * channels * width
        data = held(row["path"]).read_at(max(0, high - low) * channels * width, start)
    if row["encoding"] == "float":
        values = np.frombuffer(data[: len(data) // width * width], f"{row['byte_order']}f{width}")
        # As far over full scale as a sample may be, it is clipped later; what is no number is silence.
        frames = np.nan_to_num(values.astype(np.float64), nan=0.0) * 32768.0
    else:
        frames = _as_int16_scale(data, width, row["byte_order"])
    frames = frames[: len(frames) // channels * channels].reshape(-1, channels)
    if rate == SAMPLE_RATE or not len(frames):
        return frames[:count]
    return _resample(frames, rate, low, first, count)


def _cutoff(rate: int) -> float:
    """Band that passes, as a share of half the input rate."""
    return PASS_BAND * SAMPLE_RATE / rate if rate > SAMPLE_RATE else 1.0


def _half_taps(rate: int) -> int:
    """Input samples at each side of a place that weigh in."""
    return math.ceil(ZERO_CROSSINGS / _cutoff(rate))


def _weights(rate: int, phases: np.ndarray) -> np.ndarray:
    """One row of filter weights for each phase (in 16000ths of an input sample), adding up to one."""
    half, cutoff = _half_taps(rate), _cutoff(rate)
    away = np.arange(1 - half, half + 1) - phases[:, None] / SAMPLE_RATE
    taper = np.i0(KAISER_BETA * np.sqrt(np.clip(1 - np.square(away / half), 0, None)))
    weights = np.sinc(cutoff * away) * taper
    return weights / weights.sum(axis=1, keepdims=True)


@lru_cache(maxsize=4)
def _phase_table(rate: int) -> np.ndarray:
    """The weights of all phases that a rate has, in steps of its common divisor with 16000."""
    return _weights(rate, np.arange(0, SAMPLE_RATE, math.gcd(rate, SAMPLE_RATE)))


def _resample(frames: np.ndarray, rate: int, low: int, first: int, count: int) -> np.ndarray:
    """Output samples from input ``frames`` that begin at input sample ``low``."""
    half, step = _half_taps(rate), math.gcd(rate, SAMPLE_RATE)
    held = SAMPLE_RATE // step * 2 * half <= TABLE_WEIGHTS
    offsets = np.arange(1 - half, half + 1)
    out = np.empty((count, frames.shape[1]))
    piece = max(1, PIECE_WEIGHTS // (2 * half))
    for start in range(0, count, piece):
        places = (first + np.arange(start, min(count, start + piece), dtype=np.int64)) * rate
        base, phase = places // SAMPLE_RATE, places % SAMPLE_RATE
        weights = _phase_table(rate)[phase // step] if held else _weights(rate, phase)
        near = np.clip(base[:, None] + offsets - low, 0, len(frames) - 1)
        for c in range(frames.shape[1]):
            out[start : start + piece, c] = np.einsum("ij,ij->i", frames[near, c], weights)
    return out


def _as_int16_scale(data: bytes, width: int, order: str) -> np.ndarray:
    if width == 1:
        if order == "<":
            return (np.frombuffer(data, np.uint8).astype(np.float64) - 128) * 256
        return np.frombuffer(data, np.int8).astype(np.float64) * 256
    if width == 3:
        parts = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        parts = parts if order == "<" else parts[:, ::-1]
        value = parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16
        return (value - ((value & 0x800000) << 1)) / 256.0
    values = np.frombuffer(data[: len(data) // width * width], f"{order}i{width}").astype(np.float64)
    return values if width == 2 else values / 65536.0


def durations(blocks: DataFrame, *more: Column, max_seconds: int = MAX_SECONDS) -> DataFrame:
    """True length per track from decoded samples, with the error code of empty or overlong. ``more`` are further
    aggregates over the blocks of a track, found in the same pass."""
    samples = F.sum(F.size("samples").cast("bigint"))
    return (
        blocks.groupBy("recording_id", "channel")
        .agg(samples.alias("audio_samples"), *more)
        .withColumn("duration_s", F.col("audio_samples") / F.lit(float(SAMPLE_RATE)))
        .withColumn(
            "error_code",
            F.when(F.col("audio_samples") == 0, "undecodable_audio").when(
                F.col("audio_samples") > max_seconds * SAMPLE_RATE, "audio_too_long"
            ),
        )
    )


def to_float(samples: Column) -> Column:
    return F.transform(samples, lambda x: (x / F.lit(32768.0)).cast("float"))


def to_int16(audio: Column) -> Column:
    return F.transform(
        audio,
        lambda x: F.least(
            F.greatest(F.rint(x.cast("double") * 32768), F.lit(-32768.0)), F.lit(32767.0)
        ).cast("smallint"),
    )


def frames_of(blocks: DataFrame, keys: list[str], samples: str, frame: int) -> DataFrame:
    """Rows ``(keys, frame_idx, frame_start, power_sum)`` of whole frames inside each block."""
    whole = F.floor(F.size(samples) / frame).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), whole - 1),
        lambda i: F.struct(
            i.alias("frame_idx"),
            (i * frame).alias("frame_start"),
            F.aggregate(
                F.slice(samples, i * frame + 1, F.lit(frame)),
                F.lit(0.0),
                lambda total, x: total + x.cast("double") * x.cast("double"),
            ).alias("energy"),
        ),
    )
    return blocks.where(whole > 0).select(*keys, F.explode(cut).alias("_f")).select(*keys, "_f.*")


def active_power(frames: DataFrame, keys: list[str], frame: int) -> DataFrame:
    """Mean power of frames within 40 dB of the loudest, and the level of all of them.

    Two small aggregates instead of a window, so a long clip is not gathered in one task."""
    power = F.col("energy") / frame
    loudest = frames.groupBy(*keys).agg(F.max(power).alias("_loudest"))
    return (
        frames.join(loudest, keys)
        .groupBy(*keys)
        .agg(
            F.avg(F.when(power > F.col("_loudest") * 1e-4, power)).alias("active_power"),
            F.sqrt(F.avg(power)).alias("rms"),
        )
    )


def snr_gain(speech_power: Column, noise_power: Column, snr_db: float) -> Column:
    """Factor for noise so that speech stands ``snr_db`` above it."""
    return F.sqrt(speech_power / (noise_power * F.pow(F.lit(10.0), F.lit(snr_db / 10))))


Scorer = Callable[[np.ndarray], np.ndarray]


def energy_scorer(threshold: float) -> Scorer:
    """Frame scores by root mean square against full scale."""

    def score(frames: np.ndarray) -> np.ndarray:
        level = np.sqrt(np.square(frames.astype(np.float64) / 32768).mean(axis=1))
        return level >= threshold

    return score


def detect_regions(
    blocks: DataFrame,
    *,
    scorer: Scorer | None = None,
    lengths: DataFrame | None = None,
    threshold: float = 0.01,
    frame: int = SAMPLE_RATE // 50,
    min_silence_ms: int = 500,
    speech_pad_ms: int = 200,
) -> DataFrame:
    """Speech regions per track. ``scorer`` maps frames (rows of samples) to booleans; runs of
    active frames are joined over block edges like any touching intervals. ``lengths`` as from
    :func:`track_lengths` saves decoding the audio again to know where tracks end."""
    decide = scorer or energy_scorer(threshold)
    schema = "recording_id string, channel int, start bigint, end bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            names = zip(*(batch.column(c).to_pylist() for c in ("recording_id", "channel", "start_sample")))
            for i, (rid, channel, origin) in enumerate(names):
                samples = np.asarray(batch.column("samples")[i].values)
                padded = np.zeros(-(-len(samples) // frame) * frame, dtype=samples.dtype)
                padded[: len(samples)] = samples
                active = np.asarray(decide(padded.reshape(-1, frame)), dtype=np.int8)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], active, [0]))))
                for a, b in edges.reshape(-1, 2).tolist():
                    out.append((rid, channel, origin + a * frame,
                                origin + min(b * frame, len(samples))))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), type=k) for v, k in zip(columns, kinds)],
                names=["recording_id", "channel", "start", "end"],
            )

    active = blocks.select("recording_id", "channel", "start_sample", "samples").mapInArrow(run, schema)
    ms = SAMPLE_RATE // 1000
    regions = close_gaps(active, min_silence_ms * ms, speech_pad_ms * ms)
    if lengths is None:
        lengths = blocks.groupBy("recording_id", "channel").agg(
            F.max(F.col("start_sample") + F.size("samples")).alias("audio_samples")
        )
    ends = lengths.select(
        F.col("recording_id").alias("_r"), F.col("channel").alias("_c"),
        F.col("audio_samples").alias("_len"),
    )
    return (
        regions.join(
            ends,
            (F.col("recording_id") == F.col("_r")) & F.col("channel").eqNullSafe(F.col("_c")),
        )
        .withColumn("end", F.least("end", "_len"))
        .drop("_r", "_c", "_len")
    )
