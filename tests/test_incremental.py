"""One pass over the audio, the language frontier, and incremental transcription with its store."""

import json
import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_audio import RATE, Fake, files, folder, quiet, speech, wav  # noqa: F401

from speechframe.operators import audio, chunks, engine, onepass
from speechframe.sources.store import RecordingStore
from speechframe.streaming import incremental

BLOCK = RATE  # one second


def note(path, line):
    with open(path, "a") as out:
        out.write(line + "\n")


def counting(row, first, count, log=None):
    note(log, f"{row['path'].rsplit('/', 1)[-1]} {first} {count}")
    return audio.read_frames(row, first, count)


def by_row(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# --- one pass --------------------------------------------------------------------------------


def test_one_pass_equals_decoded_blocks(spark, folder, tmp_path):
    log = str(tmp_path / "reads")
    layouts = audio.pcm_layouts(files(spark, folder)).cache()
    scans, regions, plan = onepass.scan_files(layouts, block_samples=BLOCK, decoder=partial(counting, log=log))
    blocks = audio.decode_blocks(layouts, block_samples=BLOCK)
    old = audio.detect_regions(blocks)
    order = ("recording_id", "channel", "start")
    columns = ["recording_id", "channel", "start", "end"]
    assert by_row(regions.select(columns), *order) == by_row(old.select(columns), *order)
    wanted = chunks.number_chunks(chunks.pack_chunks(old)).select(plan.columns)
    assert by_row(plan, *order) == by_row(wanted, *order)
    # Each block of each readable file was decoded once, for regions, cuts and plan together.
    reads = open(log).read().split("\n")[:-1]
    assert len(reads) == len(set(reads)) == scans.count() == 3 * 9
    # Recogniser tasks read the ranges of their chunks, and hear what slicing would give.
    energy = onepass.span_energy(plan, layouts, ["recording_id", "index"], partial(counting, log=log))
    heard = chunks.slice_audio(plan, blocks, block_samples=BLOCK).select(
        "recording_id", "index", F.size("samples").cast("long"), chunks.frame_energy(F.col("samples"))
    )
    assert sorted(tuple(r) for r in energy.collect()) == by_row(heard, "recording_id", "index")
    again = open(log).read().split("\n")[len(reads) : -1]
    assert len(again) == plan.count()
    # What is shuffled on the way has no samples in it.
    raw = engine.transcribe_spans(plan, layouts, Fake)
    for df in (onepass.scan_blocks(layouts, cell=160), raw):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in text and "samples" not in "".join(x for x in text.split("\n") if "Exchange" in x)
    sizes = {(r.recording_id, r.chunk): int(r.segments[0].text) for r in raw.collect()}
    assert sizes == {(r["recording_id"], r["index"]): r["end"] - r["start"] for r in plan.collect()}


def lingering(frames):
    """Active while any of the five frames around is loud: needs two frames of its neighbours."""
    loud = np.abs(frames.astype(np.int32)).max(axis=1) > 500
    near = np.convolve(loud.astype(int), np.ones(5, dtype=int), "same")
    return near > 0


@pytest.mark.parametrize("split", [False, True])
def test_verdicts_do_not_depend_on_blocks(spark, tmp_path, split):
    rng = np.random.default_rng(4)
    loud = (rng.random(200) < 0.1).repeat(320) * rng.integers(1000, 9000, 64_000)
    both = np.stack([loud, np.roll(loud, 4000)], axis=1).astype("<i2")
    (tmp_path / "x.wav").write_bytes(wav(both, channels=2))
    layouts = audio.pcm_layouts(files(spark, tmp_path))
    found = []
    for size in (3200, 6400, 160_000):
        scans = onepass.scan_blocks(
            layouts, cell=160, scorer=lingering, halo=2, split_channels=split, block_samples=size
        )
        regions = onepass.scanned_regions(scans, min_silence_ms=0, speech_pad_ms=0)
        found.append(by_row(regions, "channel", "start"))
    assert found[0] == found[1] == found[2] and len(found[0]) > 10
    assert {r[1] for r in found[0]} == ({0, 1} if split else {None})


def test_forced_cuts_from_cells(spark, tmp_path):
    parts = []
    for seed in range(6):
        parts += [speech(3.1 + seed / 7, seed), speech(0.15, seed, level=600)]
    (tmp_path / "long.wav").write_bytes(wav(np.concatenate([quiet(1), *parts, quiet(1)])))
    layouts = audio.pcm_layouts(files(spark, tmp_path))
    cut = dict(max_chunk=4 * RATE, cut_window=2 * RATE, cut_frame=1600)
    _, regions, plan = onepass.scan_files(layouts, block_samples=BLOCK, max_gap=RATE, **cut)
    blocks = audio.decode_blocks(layouts, block_samples=BLOCK)
    pieces = chunks.split_long_regions(regions, blocks, block_samples=BLOCK, **cut)
    wanted = chunks.number_chunks(chunks.pack_chunks(regions, max_chunk=4 * RATE, max_gap=RATE, pieces=pieces))
    assert by_row(plan, "index") == by_row(wanted.select(plan.columns), "index")
    assert plan.where("forced_cut").count() >= 4
    assert chunks.plan_violations(plan, max_chunk=4 * RATE, max_gap=RATE).count() == 0
    with pytest.raises(ValueError):
        onepass.split_by_cells(regions, None, cell=7, block_samples=BLOCK)
    with pytest.raises(ValueError):
        onepass.scan_blocks(layouts, cell=160, block_samples=1000)


def test_audio_that_is_not_there(spark, folder):
    layouts = audio.pcm_layouts(files(spark, folder)).where("recording_id = 'a.wav'")
    gone = layouts.withColumn("path", F.concat("path", F.lit(".gone")))
    plan = spark.createDataFrame([("a.wav", None, 0, 0, 100)], "recording_id string, channel int, index int, start long, end long")
    row = engine.transcribe_spans(plan, gone, Fake).first()
    assert (row.error_code, row.attempts, row.segments) == ("undecodable_audio", 0, None)
    scans, regions, none = onepass.scan_files(layouts.limit(0), block_samples=BLOCK)
    assert scans.count() == regions.count() == none.count() == 0


# --- language frontier -----------------------------------------------------------------------


class Detecting:
    """Detects a language from the chunk whose length is named, and says what it was asked with."""

    name = "detecting"

    def __init__(self, lengths, log=None):
        self.lengths, self.log = lengths, log

    def transcribe(self, audio_, *, language, prompt, word_timestamps):
        if self.log:
            note(self.log, f"{len(audio_)} {language}")
        found = language or ("deu" if len(audio_) in self.lengths else None)
        row = {"start": 0.0, "end": len(audio_) / RATE, "text": f"{len(audio_)}:{language}"}
        return {"segments": [row], "language": found, "language_probability": 0.9 if found else None}


@pytest.mark.parametrize("seed", range(3))
def test_languages_as_if_heard_in_order(spark, seed):
    rng = random.Random(seed)
    rows, lengths, want = [], set(), {}
    for r in range(6):
        n = rng.randrange(1, 12)
        at = rng.choice([None, *range(n)])
        for i in range(n):
            size = 1000 * r + 10 * i + 10
            rows.append((f"r{r}", 2 * i, [1] * size))
            if at is not None and i >= at:
                lengths.add(size)
            want[f"r{r}", 2 * i] = f"{size}:{'de' if at is not None and i > at else None}"
    table = spark.createDataFrame(rows, "recording_id string, index int, samples array<smallint>")
    got = engine.transcribe_recordings(table, lambda: Detecting(lengths)).collect()
    assert {(r.recording_id, r.chunk): r.segments[0].text for r in got} == want and len(got) == len(rows)
    asked = spark.createDataFrame([("r0", "FR")], "recording_id string, language string")
    pinned = engine.transcribe_recordings(table, lambda: Detecting(lengths), asked).where("recording_id = 'r0'")
    assert {r.segments[0].text.split(":")[1] for r in pinned.collect()} == {"fr"}


# --- store and incremental runs --------------------------------------------------------------


def test_store_reads_the_buckets_of_a_batch(spark, tmp_path):
    store = RecordingStore(spark, str(tmp_path / "s"), {"t": "recording_id string, etag string, n int"}, buckets=16)
    rows = spark.createDataFrame([(f"r{i}", "e", i) for i in range(60)], "recording_id string, etag string, n int")
    store.put("t", rows, 0)
    store.put("t", rows.limit(0), 1)
    assert store.get("t").count() == 60
    store.put("t", rows.withColumn("n", F.col("n") + 100), 0)  # the batch again
    assert store.get("t").count() == 60 and store.get("t").agg(F.min("n")).first()[0] == 100
    some = rows.where("n < 2")
    buckets = store.buckets_of(some)
    read = store.get("t", buckets)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert {r.bucket for r in read.collect()} == set(buckets) and 0 < read.count() < 60
    store.add("t", some, 5)
    store.add("t", some, 5)
    last = {r.recording_id: r.n for r in store.latest("t", ["recording_id", "etag"], buckets).collect()}
    assert last["r0"] == 0 and last["r1"] == 1
    store.compact("t", ["recording_id", "etag"], str(tmp_path / "c"))
    flat = spark.read.parquet(str(tmp_path / "c" / "t"))
    assert flat.count() == 60 and flat.where("n < 2").count() == 2


TALK = [quiet(1), speech(2), quiet(3), speech(1.5), quiet(3), speech(1), quiet(1)]
SIZES = [int(x * RATE) for x in (2.4, 1.9, 1.4)]  # the three chunks with their pads


class Run:
    """Objects with notices, and runs of the stream over them."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, root, 0
        (root / "inbox").mkdir()
        self.log = str(root / "calls")
        open(self.log, "w").close()
        self.store = incremental.recording_store(spark, str(root / "store"), buckets=8)

    def object(self, name, data, etag="v1", language=None):
        path = self.root / "objects" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        self.notice(name, len(data), etag, language)

    def notice(self, name, length, etag="v1", language=None):
        self.n += 1
        line = {"path": str(self.root / "objects" / name), "length": length, "etag": etag, "language": language}
        (self.root / "inbox" / f"{self.n}.json").write_text(json.dumps(line))

    def go(self, factory=None, checkpoint="cp", **options):
        """The recogniser's calls of one run."""
        before = len(open(self.log).read().split("\n"))
        objects = incremental.notices(self.spark, str(self.root / "inbox"))
        query = incremental.transcribe_stream(
            objects, self.store, str(self.root / checkpoint), factory or partial(Detecting, {SIZES[1]}, self.log),
            scan={"block_samples": BLOCK}, max_retries=0, **options,
        )
        assert query.awaitTermination(300)
        return sorted(open(self.log).read().split("\n")[before - 1 : -1])

    def texts(self):
        rows = incremental.transcripts(self.store).collect()
        return {(r.recording_id.split("objects/")[1], r.etag): r for r in rows}

    def errors(self):
        rows = self.store.get("errors").collect()
        return {(r.recording_id.split("objects/")[1], r.chunk, r.error_code) for r in rows}


@pytest.fixture
def run(spark, tmp_path):
    return Run(spark, tmp_path)


def test_objects_to_transcripts(run):
    talk = wav(np.concatenate(TALK))
    run.object("a/x.wav", talk)
    run.object("b/x.wav", wav(np.concatenate(TALK[:3])))  # the same base name elsewhere
    run.object("bad.wav", b"#EXTM3U\n")
    run.object("still.wav", wav(quiet(2)))
    calls = run.go()
    assert calls == sorted([f"{SIZES[0]} None", f"{SIZES[1]} None", f"{SIZES[2]} None", f"{SIZES[2]} de", f"{SIZES[0]} None"])
    found = run.texts()
    assert set(found) == {("a/x.wav", "v1"), ("b/x.wav", "v1"), ("still.wav", "v1")}
    a = found["a/x.wav", "v1"]
    # The first chunk detects nothing, the second does, the third is heard in its language.
    assert a.text == f"{SIZES[0]}:None {SIZES[1]}:None {SIZES[2]}:de"
    assert (a.language, a.language_probability, a.chunks, a.engines) == ("de", 0.9, 3, {"detecting": 3})
    assert a.audio_seconds == 12.5 and a.speech_seconds == a.transcribed_seconds == sum(SIZES) / RATE
    assert [(round(s.start, 6), round(s.end, 6)) for s in a.segments] == [(0.8, 3.2), (5.8, 7.7), (10.3, 11.7)]
    assert found["still.wav", "v1"].text == "" and found["still.wav", "v1"].segments == []
    assert run.errors() == {("bad.wav", None, "undecodable_audio")}
    # Nothing new, and a notice again of what is done: no call.
    assert run.go() == []
    run.notice("a/x.wav", len(talk))
    assert run.go() == [] and run.texts()["a/x.wav", "v1"].text == a.text
    # A checkpoint that was lost: all notices come again, and still nothing is heard twice.
    assert run.go(checkpoint="cp2") == []
    # A replaced object is another version.
    run.object("a/x.wav", wav(np.concatenate(TALK[2:])), etag="v2", language="eng")
    assert run.go() == sorted([f"{SIZES[1]} en", f"{SIZES[2]} en"])
    assert run.texts()["a/x.wav", "v2"].language == "en" and run.texts()["a/x.wav", "v1"].text == a.text


def test_resume_hears_only_missing_chunks(run, spark):
    class Half(Detecting):
        def transcribe(self, audio_, **options):
            if len(audio_) == SIZES[2]:
                raise engine.EngineFailure("asr_engine_error", retryable=False)
            return super().transcribe(audio_, **options)

    data = wav(np.concatenate(TALK))
    run.object("a.wav", data)
    assert len(run.go(partial(Half, {SIZES[1]}, run.log))) == 2
    assert run.texts() == {} and run.errors() == {("a.wav", 2, "asr_engine_error")}
    # The stored language is used for the chunk that is missing.
    run.notice("a.wav", len(data))
    assert run.go() == [f"{SIZES[2]} de"]
    assert run.texts()["a.wav", "v1"].text.endswith(f"{SIZES[2]}:de")


def test_results_of_other_bounds_are_heard_again(run, spark):
    data = wav(np.concatenate(TALK))
    run.object("a.wav", data)
    run.go()
    rows = run.store.get("results").where("chunk = 0").drop("bucket", "epoch")
    run.store.add("results", rows.withColumn("end", F.col("end") + 1), 90)
    run.notice("a.wav", len(data))
    assert run.go() == [f"{SIZES[0]} de"]
    # A plan of another decode is replaced, and its results are not used.
    heads = run.store.get("recordings").drop("bucket", "epoch")
    run.store.put("recordings", heads.withColumn("audio_samples", F.col("audio_samples") - 1), 95)
    run.store.add("results", rows.withColumn("start", F.col("start") + 7), 96)
    run.notice("a.wav", len(data))
    assert run.go() == [f"{SIZES[0]} de"]


def test_split_channels_and_folders(run, spark):
    left, right = np.concatenate(TALK[:3]), np.concatenate([quiet(3), speech(2, 9), quiet(1)])
    run.object("deep/down/s.wav", wav(np.stack([left, right], axis=1), channels=2))
    query = incremental.transcribe_stream(
        incremental.new_objects(spark, str(run.root / "objects")), run.store, str(run.root / "cp"),
        partial(Detecting, set(), None), scan={"block_samples": BLOCK}, split_channels=True,
    )
    assert query.awaitTermination(300)
    row = incremental.transcripts(run.store).first()
    assert [(s.channel, round(s.start, 6), round(s.end, 6)) for s in row.segments] == [(0, 0.8, 3.2), (1, 2.8, 5.2)]
    assert row.language is None and row.chunks == 2 and row.recording_id.endswith("deep/down/s.wav")
