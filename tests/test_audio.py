"""Audio objects to transcripts: headers, decoding, regions, engine seam, incremental runs, sources and sinks."""

import hashlib
import io
import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechframe.operators import audio, captions, chunks, engine, evaluation, front_ends, guards
from speechframe.schema import PCM_BLOCKS
from speechframe.sources import readers, sinks

RATE = 16_000


def wav(samples, channels=1, rate=RATE, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples.tobytes())
    return out.getvalue()


def aiff(samples, rate=RATE):
    body = samples.astype(">i2").tobytes()
    comm = struct.pack(">hIh", 1, len(samples), 16) + struct.pack(">HQ", 16383 + 13, rate << 50)
    ssnd = struct.pack(">II", 0, 0) + body
    chunk = b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">I", len(ssnd)) + ssnd
    return b"FORM" + struct.pack(">I", 4 + len(chunk)) + b"AIFF" + chunk


def speech(seconds, seed=1, level=8000):
    return np.random.default_rng(seed).integers(-level, level, int(seconds * RATE)).astype("<i2")


def quiet(seconds):
    return np.zeros(int(seconds * RATE), dtype="<i2")


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "audio"
    place.mkdir()
    talk = np.concatenate([quiet(1), speech(2), quiet(3), speech(1.5), quiet(1)])
    (place / "a.wav").write_bytes(wav(talk))
    stereo = np.stack([talk, quiet(8.5)], axis=1)
    (place / "b.bin").write_bytes(wav(stereo, channels=2))
    (place / "c.aiff").write_bytes(aiff(talk))
    (place / "d.wav").write_bytes(b"#EXTM3U\nfile:///etc/passwd\n")
    (place / "e.wav").write_bytes(wav(np.zeros(0, dtype="<i2")))
    return place


def files(spark, folder):
    return readers.audio_objects(spark, str(folder)).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("recording_id"), "path", "length")


def test_containers_and_headers(spark, folder):
    objects = readers.audio_objects(spark, str(folder))
    facts = {r.n: r for r in objects.select(F.regexp_extract("path", "([^/]+)$", 1).alias("n"), audio.container(F.col("content")).alias("c"),
                                            audio.wav_header(F.col("content")).alias("h")).collect()}
    assert {n: r.c for n, r in facts.items()} == {"a.wav": "wav", "b.bin": "wav", "c.aiff": "aiff", "d.wav": None, "e.wav": "wav"}
    assert (facts["b.bin"].h.channels, facts["b.bin"].h.rate, facts["b.bin"].h.bits, facts["b.bin"].h.duration_s) == (2, RATE, 16, 8.5)
    layouts = {r.recording_id: r for r in audio.pcm_layouts(files(spark, folder)).collect()}
    assert layouts["a.wav"].frames == 8.5 * RATE and layouts["c.aiff"].rate == RATE
    assert {n for n, r in layouts.items() if r.error_code == "undecodable_audio"} == {"d.wav", "e.wav"}


def whole(blocks, name, channel=None):
    rows = blocks.where((F.col("recording_id") == name) & F.col("channel").eqNullSafe(F.lit(channel))).orderBy("block_idx").collect()
    return np.concatenate([np.array(r.samples, dtype=np.int16) for r in rows])


def test_decoding(spark, folder):
    with wave.open(str(folder / "a.wav")) as w:
        talk = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2")
    layouts = audio.pcm_layouts(files(spark, folder))
    blocks = audio.decode_blocks(layouts, block_samples=RATE)
    assert np.array_equal(whole(blocks, "a.wav"), talk)
    assert np.array_equal(whole(blocks, "c.aiff"), talk)
    assert np.array_equal(whole(blocks, "b.bin"), np.rint(talk / 2).astype(np.int16))
    apart = audio.decode_blocks(layouts, split_channels=True, block_samples=RATE)
    assert np.array_equal(whole(apart, "b.bin", 0), talk) and not whole(apart, "b.bin", 1).any()
    rows = {(r.recording_id, r.channel): r for r in audio.durations(apart, max_seconds=8).collect()}
    assert rows["a.wav", None].duration_s == 8.5 and rows["a.wav", None].error_code == "audio_too_long"
    (folder / "f.wav").write_bytes(wav(np.arange(0, 8000, dtype="<i2"), rate=8000))
    slow = audio.decode_blocks(audio.pcm_layouts(files(spark, folder)).where("recording_id = 'f.wav'"), block_samples=700)
    samples = whole(slow, "f.wav")
    assert len(samples) == RATE and np.array_equal(samples[:-1:2], np.arange(8000))
    (folder / "g.wav").write_bytes(wav(np.array([0, 128, 255], dtype=np.uint8), width=1))
    eight = audio.decode_blocks(audio.pcm_layouts(files(spark, folder)).where("recording_id = 'g.wav'"))
    assert list(whole(eight, "g.wav")) == [-32768, 0, 32512]


def tone(hertz, rate, seconds=1.0, level=10_000):
    return np.rint(level * np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)).astype("<i2")


def decoded(path, rate, size, cuts=(16_000,), channels=1):
    """All output samples of a WAV file of the module's writer, read in ranges of the given sizes."""
    row = {"path": str(path), "rate": rate, "channels": channels, "bits": 16, "byte_order": "<",
           "encoding": "int", "data_offset": 44, "frames": size}
    total, parts, at = size * RATE // rate, [], 0
    while at < total:
        count = min(cuts[len(parts) % len(cuts)], total - at)
        parts.append(audio.read_frames(row, at, count))
        at += count
    return np.concatenate(parts)


@pytest.mark.parametrize("rate", [8_000, 11_025, 22_050, 44_100, 48_000, 96_000, 44_101])
def test_tones_of_other_rates(tmp_path, rate):
    path = tmp_path / "t.wav"
    path.write_bytes(wav(tone(1000, rate), rate=rate))
    got = decoded(path, rate, rate)[:, 0]
    assert len(got) == RATE
    wanted = 10_000 * np.sin(2 * np.pi * 1000 * np.arange(RATE) / RATE)
    inner = slice(200, -200)
    assert np.abs(got[inner] - wanted[inner]).max() < 5
    # What the new rate can't hold is gone instead of coming back as another tone.
    if rate > 2 * 11_000:
        path.write_bytes(wav(tone(11_000, rate), rate=rate))
        assert np.abs(decoded(path, rate, rate)[inner]).max() < 5
    path.write_bytes(wav(np.full(rate // 2, 321, dtype="<i2"), rate=rate))
    assert np.allclose(decoded(path, rate, rate // 2), 321)


@pytest.mark.parametrize("rate", [8_000, 44_100, 48_000, 44_101])
def test_resampling_does_not_depend_on_the_ranges(tmp_path, rate, monkeypatch):
    path = tmp_path / "n.wav"
    noise = np.random.default_rng(3).integers(-9000, 9000, (rate // 4, 2)).astype("<i2")
    path.write_bytes(wav(noise, channels=2, rate=rate))
    whole_file = decoded(path, rate, len(noise), channels=2)
    assert np.allclose(whole_file, decoded(path, rate, len(noise), (1, 7, 160, 3), channels=2), atol=1e-6)
    monkeypatch.setattr(audio, "TABLE_WEIGHTS", 0)
    monkeypatch.setattr(audio, "PIECE_WEIGHTS", 5000)
    assert np.allclose(whole_file, decoded(path, rate, len(noise), channels=2), atol=1e-6)


def test_aifc_with_plain_samples(spark, tmp_path):
    sound = np.arange(-500, 500, dtype="<i2")
    kinds = {"none": (b"NONE", 16, ">i2"), "sowt": (b"sowt", 16, "<i2"), "fl32": (b"fl32", 32, ">f4"), "ulaw": (b"ulaw", 16, ">i2")}
    for name, (kind, bits, form) in kinds.items():
        data = (sound / 32768 if "f" in form else sound).astype(form).tobytes()
        comm = struct.pack(">hIhHQ", 1, len(sound), bits, 16383 + 13, RATE << 50) + kind + bytes(2)
        body = b"AIFC" + b"FVER" + struct.pack(">II", 4, 0xA2805140)
        body += b"COMM" + struct.pack(">I", len(comm)) + comm
        body += b"SSND" + struct.pack(">III", 8 + len(data), 0, 0) + data
        (tmp_path / f"{name}.aifc").write_bytes(b"FORM" + struct.pack(">I", len(body)) + body)
    layouts = audio.pcm_layouts(files(spark, tmp_path)).cache()
    errors = {r.recording_id: r.error_code for r in layouts.collect()}
    assert {n for n, e in errors.items() if e} == {"ulaw.aifc"} and errors["ulaw.aifc"] == "undecodable_audio"
    blocks = audio.decode_blocks(layouts)
    for name in ("none", "sowt", "fl32"):
        assert np.array_equal(whole(blocks, f"{name}.aifc"), sound)


def riff(kind, bits, data, before=b"", sub=None):
    """A mono WAV of 16 kHz with other chunks before its sound."""
    fmt = struct.pack("<HHIIHH", kind, 1, RATE, RATE * bits // 8, bits // 8, bits)
    if sub is not None:
        fmt += struct.pack("<HHIH", 22, bits, 0, sub) + bytes.fromhex("000000001000800000aa00389b71")
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + before + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_headers_of_any_length_and_floats(spark, tmp_path):
    sound = np.arange(-500, 500, dtype="<i2")
    half = np.array([0.5, -0.5, 2.0, np.nan])
    long_list = b"LIST" + struct.pack("<I", 1 << 20) + bytes(1 << 20)
    (tmp_path / "long.wav").write_bytes(riff(1, 16, sound.tobytes(), long_list))
    (tmp_path / "f32.wav").write_bytes(riff(3, 32, half.astype("<f4").tobytes()))
    (tmp_path / "ext.wav").write_bytes(riff(0xFFFE, 32, half.astype("<f4").tobytes(), sub=3))
    (tmp_path / "f64.wav").write_bytes(riff(3, 64, half.astype("<f8").tobytes()))
    (tmp_path / "law.wav").write_bytes(riff(7, 8, bytes(100)))
    sounds = b"SSND" + struct.pack(">III", 8 + 2000, 0, 0) + sound.astype(">i2").tobytes()
    common = b"COMM" + struct.pack(">IhIhHQ", 18, 1, 1000, 16, 16383 + 13, RATE << 50) + bytes(0)
    form = b"AIFF" + sounds + common
    (tmp_path / "late.aiff").write_bytes(b"FORM" + struct.pack(">I", len(form)) + form)
    layouts = audio.pcm_layouts(files(spark, tmp_path)).cache()
    errors = {r.recording_id: r.error_code for r in layouts.collect()}
    assert {n for n, e in errors.items() if e} == {"law.wav"} and errors["law.wav"] == "undecodable_audio"
    blocks = audio.decode_blocks(layouts)
    assert np.array_equal(whole(blocks, "long.wav"), sound) and np.array_equal(whole(blocks, "late.aiff"), sound)
    for name in ("f32.wav", "ext.wav", "f64.wav"):
        assert list(whole(blocks, name)) == [16384, -16384, 32767, 0]
    heads = {r.n: r.h for r in readers.audio_objects(spark, str(tmp_path)).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("n"), audio.wav_header(F.col("content")).alias("h")).collect()}
    assert (heads["long.wav"].frames, heads["long.wav"].rate) == (1000, RATE) and heads["late.aiff"] is None
    short = audio.pcm_layouts(files(spark, tmp_path), max_seconds=0).where("recording_id = 'long.wav'")
    assert short.first().error_code == "audio_too_long"


def test_regions_and_plan(spark, folder):
    blocks = audio.decode_blocks(audio.pcm_layouts(files(spark, folder)), block_samples=RATE // 2)
    found = audio.detect_regions(blocks).where("recording_id = 'a.wav'").orderBy("start").collect()
    pad, s = RATE // 5, RATE
    assert [(r.start, r.end) for r in found] == [(1 * s - pad, 3 * s + pad), (6 * s - pad, int(7.5 * s) + pad)]
    layouts = audio.pcm_layouts(files(spark, folder))
    lengths = audio.track_lengths(layouts, split_channels=True).orderBy("recording_id", "channel").collect()
    assert [(r.recording_id, r.channel, r.audio_samples) for r in lengths] == [
        ("a.wav", None, 136_000), ("b.bin", 0, 136_000), ("b.bin", 1, 136_000), ("c.aiff", None, 136_000)]
    again = audio.detect_regions(blocks, lengths=audio.track_lengths(layouts))
    assert again.where("recording_id = 'a.wav'").orderBy("start").collect() == found
    frame = audio.frames_of(blocks.where("recording_id = 'a.wav'"), ["recording_id", "block_idx"], "samples", 320)
    power = audio.active_power(frame, ["recording_id"], 320).first()
    assert 8000**2 / 3 * 0.9 < power.active_power < 8000**2 / 3 * 1.1 and power.rms < power.active_power**0.5
    gain = spark.range(1).select(audio.snr_gain(F.lit(4.0), F.lit(1.0), 0.0)).first()[0]
    assert gain == 2.0
    energies = spark.createDataFrame([("r", 0, 0, 5), ("r", 1, 4, 2), ("r", 2, 8, 2)], "r string, frame_idx int, frame_start int, energy bigint")
    assert chunks.quietest_frame(energies, ["r"]).first().frame_idx == 1
    loud = spark.createDataFrame([([32767] * 4,)], "s array<smallint>")
    assert loud.select(chunks.frame_energy(F.col("s"))).first()[0] == 4 * 32767**2
    assert list(loud.select(audio.to_int16(audio.to_float(F.col("s")))).first()[0]) == [32767] * 4
    with pytest.raises(ValueError):
        chunks.check_cut(10, 10, 1)
    with pytest.raises(ValueError):
        chunks.check_cut(10, 5, 2)


class Fake:
    """Deterministic engine: one segment naming the chunk's length."""

    name = "fake"

    def __init__(self, language="eng", fail=None):
        self.language, self.fail, self.calls = language, fail, 0

    def transcribe(self, audio, *, language, prompt, word_timestamps):
        self.calls += 1
        if self.fail and self.calls <= self.fail[0]:
            raise engine.EngineFailure(*self.fail[1:])
        end = len(audio) / RATE
        row = {"start": 0.0, "end": end, "text": f" {len(audio)} ", "channel": None, "avg_logprob": -0.2, "no_speech_prob": 0.1,
               "compression_ratio": 1.0, "words": None, "low_confidence": False}
        return {"segments": [row], "language": language or self.language, "language_probability": 0.75}


def cut_chunks(spark):
    rows = [("r", i, [i] * 160 * (i + 1)) for i in range(3)] + [("s", 0, [1] * 32)]
    return spark.createDataFrame(rows, "recording_id string, index int, samples array<smallint>")


def test_engine_retries_and_errors(spark):
    one = cut_chunks(spark).where("recording_id = 's'")
    quick = dict(sleep=lambda s: None)
    ok = engine.transcribe_chunks(one, lambda: Fake(fail=(2,)), **quick).first()
    assert (ok.attempts, ok.error_code, ok.segments[0].text, ok.language_probability) == (3, None, " 32 ", 0.75)
    spent = engine.transcribe_chunks(one, lambda: Fake(fail=(9, "asr_engine_unavailable")), max_retries=2, **quick).first()
    assert (spent.attempts, spent.error_code, spent.segments) == (3, "asr_engine_unavailable", None)
    final = engine.transcribe_chunks(one, lambda: Fake(fail=(9, "invalid_input", False)), **quick).first()
    assert (final.attempts, final.error_code) == (1, "invalid_input")


def test_language_pin_and_fallback(spark):
    raw = engine.transcribe_recordings(cut_chunks(spark), Fake).orderBy("recording_id", "chunk").collect()
    assert [(r.language, r.language_probability) for r in raw] == [("eng", 0.75), ("en", None), ("en", None), ("eng", 0.75)]
    asked = spark.createDataFrame([("r", "DE"), ("s", None)], "recording_id string, language string")
    raw = engine.transcribe_recordings(cut_chunks(spark), Fake, asked).orderBy("recording_id", "chunk").collect()
    assert [r.language for r in raw] == ["de", "de", "de", "eng"]
    down = engine.transcribe_chunks(cut_chunks(spark), lambda: Fake(fail=(99, "asr_engine_unavailable")), max_retries=0)

    class Spare(Fake):
        name = "spare"

    both = engine.with_fallback(cut_chunks(spark), down, Spare).collect()
    assert len(both) == 4 and {r.engine for r in both} == {"spare"}


    def guarded():
        return engine.Failover(Fake(fail=(99, "asr_engine_unavailable")), Spare())

    rows = engine.transcribe_chunks(cut_chunks(spark), guarded).collect()
    assert len(rows) == 4 and {(r.engine, r.error_code, r.attempts) for r in rows} == {("spare", None, 1)}


def test_failover_breaker():
    now, ask = [0.0], {"language": None, "prompt": None, "word_timestamps": False}
    audio_, first = np.zeros(160, np.float32), Fake(fail=(3, "asr_engine_unavailable"))
    second = Fake()
    second.name = "spare"
    both = engine.Failover(first, second, threshold=2, reset_s=30, clock=lambda: now[0])
    assert [both.transcribe(audio_, **ask)["engine"] for _ in range(4)] == ["spare"] * 4 and first.calls == 2
    now[0] = 30.0  # the trial fails, and the first is left alone again
    assert [both.transcribe(audio_, **ask)["engine"] for _ in range(2)] == ["spare"] * 2 and first.calls == 3
    now[0] = 60.0
    assert both.transcribe(audio_, **ask)["engine"] == "fake" and both.failures == 0
    other = engine.Failover(Fake(fail=(9, "asr_engine_error", True)), second, threshold=2)
    for _ in range(5):
        with pytest.raises(engine.EngineFailure):
            other.transcribe(audio_, **ask)
    assert other.primary.calls == 5 and other.failures == 0


def test_files_to_captions(spark, folder):
    blocks = audio.decode_blocks(audio.pcm_layouts(files(spark, folder)), block_samples=RATE)
    regions = audio.detect_regions(blocks)
    plan = chunks.number_chunks(chunks.pack_chunks(regions))
    heard = chunks.slice_audio(plan, blocks, block_samples=RATE)
    raw = engine.raw_segments(engine.transcribe_chunks(heard, Fake))
    kept = guards.guard_reasons(guards.to_absolute(raw, plan)).where("reason IS NULL")
    body = captions.render_srt(kept).where("recording_id = 'a.wav'").first().body
    assert body == "1\n00:00:00,800 --> 00:00:03,200\n38400\n\n2\n00:00:05,800 --> 00:00:07,700\n30400\n\n"


def test_front_ends(spark, folder):
    blocks = audio.decode_blocks(audio.pcm_layouts(files(spark, folder)), block_samples=RATE)
    clips = blocks.groupBy(F.col("recording_id").alias("clip_id")).agg((F.sum(F.size("samples")) / float(RATE)).alias("audio_s"))
    clips = clips.withColumn("reference", F.lit("thirty eight"))
    grid = {name: (lambda c, run=run, more=more: run(blocks, Fake, block_samples=RATE, **more))
            for name, run, more in (("pipeline", front_ends.FRONT_ENDS["pipeline"], {}), ("naive30", front_ends.FRONT_ENDS["naive30"], {"window_s": 3}))}
    tokens, seams, runs = evaluation.run_grid(clips, grid)
    got = {(r.clip_id, r.config): r for r in evaluation.score(clips, tokens, seams, runs).collect()}
    one, two = got["a.wav", "pipeline"], got["a.wav", "naive30"]
    assert (one.hypothesis, one.seams) == ("38400 30400", 2) and (two.hypothesis, two.seams) == ("48000 48000 40000", 2)
    assert one.substitutions == 2 and len(got) == 6


def test_readers(spark, tmp_path):
    lines = [{"id": "a", "audio": "x/a.wav", "reference": "ref", "tags": ["t"]}, {"id": "b", "audio": "b.wav", "reference": "", "tags": []}]
    (tmp_path / "m.jsonl").write_text(json.dumps(lines[0]) + "\n\n" + json.dumps(lines[1]) + "\n{broken\n" + '{"audio":"c.wav"}\n')
    clips, rejects = readers.manifest(spark, str(tmp_path / "m.jsonl"))
    got = clips.orderBy("id").collect()
    assert sorted(r.line for r in rejects.collect()) == ['{"audio":"c.wav"}', "{broken"]
    assert [r.id for r in got] == ["a", "b"] and got[0].audio.endswith(f"{tmp_path}/x/a.wav")
    (tmp_path / "log.json").write_text('{"ts":"2024-05-01T10:00:00.123+00:00","level":"info","logger":"l","msg":"m","job_id":"j","n":3}\nnot json\n')
    log = readers.read_logs(spark, str(tmp_path / "log.json")).where("level IS NOT NULL").first()
    assert (log.level, str(log.ts)) == ("info", "2024-05-01 10:00:00.123000")
    bodies = spark.createDataFrame([(1, '{"words":[{"text":"a","start":0,"end":1,"type":"word"}],"extra":1}'), (2, '{"words":[{"text":"a"}]}'), (3, "x"), (4, "{}"), (5, '{"words":[]}')], "n int, body string")
    good, bad = readers.engine_responses(bodies)
    assert {r.n for r in good.collect()} == {1, 5} and {r.n for r in bad.collect()} == {2, 3, 4}
    assert readers.response_words(good, ["n"]).first().text == "a"
    (tmp_path / "dlq").mkdir()
    (tmp_path / "dlq" / "x.json").write_text("\n".join(json.dumps({"id": f"{i}", "reason": "r"}) for i in (3, 1, 2)))
    assert [r.id for r in readers.dead_letters(spark, str(tmp_path / "dlq"), 2).collect()] == ["1", "2"]
    owned = readers.owned_objects(spark.createDataFrame([("s3://b/up/" + "0" * 8 + "-0000-0000-0000-" + "0" * 12 + "/" + "1" * 8 + "-1111-1111-1111-" + "1" * 12,), ("s3://b/up/x",)], "path string"), "up/")
    assert [r.upload_id is None for r in owned.collect()] == [False, True]


def test_digests_of_objects_in_pieces(spark, tmp_path):
    rng = np.random.default_rng(4)
    bodies = {f"{n}.bin": rng.bytes(n) for n in (0, 1, 999, 1000, 1001, 70_000)}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    listed = readers.audio_objects(spark, str(tmp_path)).where("length > 0")
    # Spark's listing leaves empty files out, so that one is named.
    gone = spark.createDataFrame([(f"{tmp_path}/0.bin",), (f"{tmp_path}/gone.bin",), (None,)], "path string")
    got = {r.path and r.path.rsplit("/", 1)[1]: (r.length, r.sha256)
           for r in readers.object_digests(listed.select("path").unionByName(gone), piece_bytes=1000).collect()}
    assert got.pop("gone.bin") == (None, None) and got.pop(None) == (None, None)
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items()}


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("r", 0, "WEBVTT\n\n"), ("s", 0, "a\n\nb\n\n"), ("s", 1, "c\n")], "recording_id string, part bigint, body string")
    sinks.write_documents(docs, str(tmp_path / "rows"), buckets=4)
    rows = spark.read.parquet(str(tmp_path / "rows")).select("recording_id", "part", "body")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, docs.collect()))
    sinks.export_documents(docs, str(tmp_path / "out"))
    text = {p.parent.name + p.parent.parent.name: p.read_text() for p in (tmp_path / "out").rglob("*.txt")}
    assert text["part=0recording_id=r"] == "WEBVTT\n\n" and text["part=0recording_id=s"] == "a\n\nb\n\n"
    schema = "job_id string, idx int, engine string, ts int"
    path = str(tmp_path / "cp")
    for version, rows in enumerate(([("j", 0, "a", 1), ("j", 1, "a", 1), ("j", 1, "b", 2)], [("j", 0, "c", 5), ("k", 0, "d", 1)])):
        for _ in range(2):
            sinks.merge_checkpoint(spark, path, spark.createDataFrame(rows, schema), ["job_id", "idx"], ["ts"], version=version)
    got = sinks.read_checkpoint(spark, path, schema, ["job_id", "idx"], ["ts"])
    assert sorted((r.job_id, r.idx, r.engine) for r in got.collect()) == [("j", 0, "c"), ("j", 1, "b"), ("k", 0, "d")]
    sinks.compact_checkpoint(spark, path, str(tmp_path / "flat"), schema, ["job_id", "idx"], ["ts"])
    assert spark.read.parquet(str(tmp_path / "flat")).count() == 3
    report = spark.createDataFrame([(2, 1, "b"), (1, 1, "a"), (2, 2, "c")], "section int, position int, line string")
    sinks.write_report(report, str(tmp_path / "report"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*"))) == "a\nb\nc\n"
    sinks.write_json(docs, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    assert spark.createDataFrame([], PCM_BLOCKS).columns[0] == "recording_id"
