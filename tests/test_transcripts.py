"""Guards, words, captions, chunk plans, languages: boundary cases and golden texts."""

import math
import random
import textwrap

import numpy as np
from pyspark.sql import functions as F

from speechframe.functions.language import normalise_language
from speechframe.functions.text import guard_key, tokens
from speechframe.operators import assemble, captions, chunks, guards, words
from speechframe.schema import CHUNKS, PCM_BLOCKS, RAW_SEGMENTS, REGIONS

SEGMENT = "recording_id string, ord int, start double, end double, text string, channel int"


def guarded(spark, segments, **options):
    chunk = spark.createDataFrame([("r", 3, 1, 160_000, 320_000, False)], CHUNKS)
    rows = [("r", 3, i, *s) for i, s in enumerate(segments)]
    raw = spark.createDataFrame(rows, RAW_SEGMENTS)
    absolute = guards.to_absolute(raw, chunk)
    return guards.guard_reasons(absolute, ["recording_id", "chunk"], **options).orderBy("ord").collect()


def seg(start=0.0, end=1.0, text="words", logprob=None, no_speech=None, compression=None, words=None):
    return (start, end, text, logprob, no_speech, compression, words)


def test_absolute_times_and_words(spark):
    inner = [(0.25, 0.5, " hello ", 0.9), (20.0, 19.0, "x", None)]
    got = guarded(spark, [seg(0.25, 0.9, " hello world ", words=inner), seg(-1.0, 11.0), seg(2.0, 1.0)])
    assert [(r.start, r.end, r.text, r.channel) for r in got] == [
        (10.25, 10.9, "hello world", 1), (10.0, 20.0, "words", 1), (12.0, 12.0, "words", 1)]
    assert [(w.start, w.end, w.text) for w in got[0].words] == [(10.25, 10.5, "hello"), (20.0, 20.0, "x")]


def reasons(spark, segments):
    shifted = [(i * 1.0, i * 1.0 + 0.5, *s[2:]) for i, s in enumerate(segments)]
    return [r.reason for r in guarded(spark, [tuple(s) for s in shifted])]


def test_guard_thresholds_are_exclusive(spark):
    got = reasons(spark, [
        seg(text=""), seg(text="   \n"), seg(text="a", no_speech=0.61, logprob=-1.01),
        seg(text="b", no_speech=0.6, logprob=-2.0), seg(text="c", no_speech=0.9, logprob=-1.0),
        seg(text="d", compression=2.41), seg(text="e", compression=2.4), seg(text="f"),
        seg(text="thanks for watching", no_speech=0.7, logprob=-1.5, compression=3.0)])
    assert got == ["empty", "empty", "silence_hallucination", None, None, "repetition", None, None,
                   "silence_hallucination"]


def test_repetition_and_boilerplate(spark):
    assert reasons(spark, [seg(text=t) for t in ("Go.", "go", "GO!", "go", "stop", "go")]) == [
        None, None, "repetition", "repetition", None, None]
    assert reasons(spark, [seg(text=t) for t in ("go", "go", "", "go")]) == [None, None, "empty", "repetition"]
    assert reasons(spark, [seg(text=t) for t in ("कि", "का", "के")]) == [None] * 3
    line = "Thanks for watching!"
    assert reasons(spark, [seg(text=line, logprob=-0.71), seg(text="x"), seg(text=line, no_speech=0.31), seg(text="y"),
                           seg(text=line, logprob=-0.7, no_speech=0.3), seg(text="♪ ♪", logprob=-0.9)]) == [
        "known_hallucination", None, "known_hallucination", None, None, "known_hallucination"]


def decided(rows):
    """Reasons of (text key, pre-reason, boilerplate) rows from the kept rows so far."""
    kept, out = [], []
    for key, pre, known in rows:
        repeated = kept[-2:] == [key, key]
        out.append(pre or (repeated and "repetition") or (known and "known_hallucination") or None)
        if out[-1] is None:
            kept.append(key)
    return out


def test_guard_windows_by_definition(spark):
    rng = random.Random(1)
    rows, want = [], []
    for group in range(40):
        own = []
        for i in range(rng.randrange(1, 40)):
            text = rng.choice(["a", "b", "", "thanks for watching", "♪"])
            logprob, high = rng.choice([None, -0.9]), rng.choice([None, 3.0, 1.0])
            rows.append((str(group), 0, i, float(i), i + 0.5, text, logprob, None, high, None))
            key = "" if text == "♪" else text
            pre = "empty" if text == "" else "repetition" if high == 3.0 else None
            own.append((key, pre, logprob is not None and text in ("thanks for watching", "♪")))
        want += [(str(group), i, r) for i, r in enumerate(decided(own))]
    df = spark.createDataFrame(rows, RAW_SEGMENTS).withColumn("low_confidence", guards.below(F.col("avg_logprob"), -0.7))
    for hot_rows in (None, 5):
        got = guards.guard_reasons(df, ["recording_id", "chunk"], hot_rows=hot_rows)
        assert sorted((r.recording_id, r.ord, r.reason) for r in got.collect()) == sorted(want)


def test_counts_as_maps(spark):
    df = spark.createDataFrame([("r", "empty"), ("r", "empty"), ("r", "repetition"), ("r", None)], "id string, reason string")
    counts = guards.dropped_by_reason(df, ["id"])
    assert guards.count_map(counts, ["id"], "reason", "dropped").first().counts == {"empty": 2, "repetition": 1}


def test_guard_key_and_tokens(spark):
    df = spark.createDataFrame([("  Héllo, WORLD—ok! $5 ",), ("कि, का",), ("\x1ca\x85b c\n",)], "t string")
    assert [r[0] for r in df.select(guard_key(F.col("t"))).collect()] == ["héllo worldok 5", "कि का", "a b c"]
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()][2] == ["a", "b", "c"]


def test_languages(spark):
    cases = {"en-US": "en", "en_GB": "en", "eng": "en", "CMN": "zh", "yue": "yue", "haw": "haw", "yue-HK": "yue",
             "": None, "   ": None, "-US": None, None: None, "XX": "xx", " deu ": "de", "jv": "jw", "iw": "he"}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r.c: r.n for r in df.select("c", normalise_language(F.col("c")).alias("n")).collect()}
    assert got == cases


def test_word_groups(spark):
    stream = [(" ", 0.0, 0.0, "spacing", None), ("Hi", 0.0, 0.2, "word", -0.1), (" ", 0.2, 0.3, "spacing", None),
              ("you.", 0.3, 0.6, "word", -0.3), (" ", 0.6, 0.7, "spacing", None), ("(noise)", 0.7, 0.8, "audio_event", None),
              ("Ok", 1.4, 1.5, "word", None), (" ", 1.5, 1.6, "spacing", None), ("wait", 2.31, 2.5, "word", -0.6),
              ("fine", 3.31, 3.4, "word", -0.2)]
    df = spark.createDataFrame([("r", 0, i, *s) for i, s in enumerate(stream)],
                               "recording_id string, chunk int, ord int, text string, start double, end double, type string, logprob double")
    got = words.group_words(df).orderBy("start").collect()
    assert [(r.text, r.start, r.end) for r in got] == [
        ("Hi you.", 0.0, 0.6), ("Ok", 1.4, 1.5), ("wait", 2.31, 2.5), ("fine", 3.31, 3.4)]
    assert math.isclose(got[0].avg_logprob, -0.2) and got[1].avg_logprob is None
    assert math.isclose(got[0].words[0].probability, math.exp(-0.1))
    exact = [("a", 0.0, 0.2, "word", None), ("b", 1.0, 1.2, "word", None)]
    df = spark.createDataFrame([("r", 0, i, *s) for i, s in enumerate(exact)], df.schema)
    assert [r.text for r in words.group_words(df).collect()] == ["ab"]


def sentences(items, pause=0.8):
    """Texts by definition: split the words first, then hand spacing to the word before it."""
    spoken = [i for i, item in enumerate(items) if item[3] == "word"]
    ended = {i: items[i][0].rstrip()[-1:] in set(".?!…。？！") for i in spoken}
    firsts = [
        i
        for n, i in enumerate(spoken)
        if n == 0 or ended[spoken[n - 1]] or items[i][1] - items[spoken[n - 1]][2] > pause
    ]
    out = []
    for a, b in zip(firsts, [*firsts[1:], len(items)]):
        last = max(i for i in spoken if a <= i < b)
        tail = last + 1 if ended[last] else b
        out.append("".join(x[0] for x in items[a:tail] if x[3] in ("word", "spacing")).strip())
    return out


def test_word_groups_by_definition_also_when_sliced(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for key in "abc":
        t, items = 0.0, []
        for i in range(120):
            t += rng.choice([0.1, 0.3, 1.5])
            kind = rng.choice(["word", "word", "spacing", "audio_event"])
            text = " " if kind == "spacing" else rng.choice(["x", "y.", "z? ", "w"])
            items.append((text, t, t + 0.05, kind, None))
            t += 0.05
        rows += [(key, 0, i, *s) for i, s in enumerate(items)]
        want[key] = sentences(items)
    df = spark.createDataFrame(rows, "recording_id string, chunk int, ord int, text string, start double, end double, type string, logprob double")
    for hot_rows in (None, 25):
        got = words.group_words(df, hot_rows=hot_rows).orderBy("recording_id", "start").collect()
        assert {k: [r.text for r in got if r.recording_id == k] for k in "abc"} == want


# --- captions -------------------------------------------------------------------------------


def segments(spark, rows):
    return spark.createDataFrame([("r", i, *r) for i, r in enumerate(rows)], SEGMENT)


def test_golden_captions(spark):
    df = segments(spark, [(0.0, 2.5, "Hello there.", None), (3.25, 5.0, "General Kenobi!", None)])
    assert captions.render_srt(df).first().body == (
        "1\n00:00:00,000 --> 00:00:02,500\nHello there.\n\n2\n00:00:03,250 --> 00:00:05,000\nGeneral Kenobi!\n\n")
    assert captions.render_vtt(df).first().body == (
        "WEBVTT\n\n00:00:00.000 --> 00:00:02.500\nHello there.\n\n00:00:03.250 --> 00:00:05.000\nGeneral Kenobi!\n\n")
    assert captions.render_text(df).first().body == "Hello there.\nGeneral Kenobi!\n"


def test_speakers_and_escapes(spark):
    df = segments(spark, [(0.0, 1.0, "a < b & c", 0), (1.0, 2.0, "ok > no", 1)])
    assert captions.render_text(df).first().body == "[Speaker 1] a < b & c\n[Speaker 2] ok > no\n"
    assert "[Speaker 2] ok > no" in captions.render_srt(df).first().body
    vtt = captions.render_vtt(df).first().body
    assert "<v Speaker 1>a &lt; b &amp; c" in vtt and "<v Speaker 2>ok &gt; no" in vtt


def test_empty_recordings(spark):
    df = segments(spark, [(0.0, 1.0, "  ", None)])
    assert captions.render_srt(df).count() == 0
    assert captions.render_vtt(df, recordings=df).first().body == "WEBVTT\n\n"


def cue_rows(df, **options):
    got = captions.caption_cues(df, **options).orderBy("start_ms", "cue").collect()
    return [(r.start_ms, r.end_ms, list(r.lines)) for r in got]


def test_cue_splits_and_times(spark):
    assert cue_rows(segments(spark, [(0.0, 1.0, "the quick brown fox", None)]), width=10) == [(0, 1000, ["the quick", "brown fox"])]
    df = segments(spark, [(10.0, 20.0, "aaaa bbbb cc dd eeeeeeee", None)])
    assert cue_rows(df, width=9, max_lines=1) == [
        (10000, 14000, ["aaaa bbbb"]), (14000, 16000, ["cc dd"]), (16000, 20000, ["eeeeeeee"])]
    word = "array<struct<start:double,end:double>>"
    timed = df.withColumn("words", F.expr(f"cast(transform(sequence(0, 4), i -> named_struct('start', 10.5 + i, 'end', 10.75 + i)) as {word})"))
    assert [c[:2] for c in cue_rows(timed, width=9, max_lines=1)] == [(10500, 11750), (12500, 13750), (14500, 14750)]
    short = df.withColumn("words", F.expr(f"cast(array(named_struct('start', 1.0, 'end', 2.0)) as {word})"))
    assert cue_rows(short, width=9, max_lines=1)[0][:2] == (10000, 14000)
    odd = segments(spark, [(3725.5, 3726.0, "x", None), (360000.0, 360001.0, "x", None), (-0.5, -0.2, "x", None), (5.0, 5.0, "x", None)])
    assert [c[:2] for c in cue_rows(odd)] == [(0, 1), (5000, 5001), (3725500, 3726000), (360000000, 360001000)]
    assert "100:00:00,000 --> 100:00:01,000" in captions.render_srt(odd).first().body


def test_wrap_equals_textwrap(spark):
    rng = random.Random(3)
    texts = [" ".join("x" * rng.randrange(1, 14) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(F.transform(captions.wrap(F.split("t", " "), 12), lambda x: x["t"]).alias("l"), "t").collect()
    for row in got:
        assert list(row.l) == textwrap.wrap(row.t, width=12, break_long_words=False, break_on_hyphens=False)


def test_long_recordings_come_in_parts(spark):
    df = segments(spark, [(float(i), i + 0.5, f"t{i}", i % 2) for i in range(60)]).withColumn("chunk", F.lit(0)).withColumn("low_confidence", F.lit(False))
    # The first segments have no cue, and no rendering is cut unless asked for.
    df = df.withColumn("text", F.when(F.col("start") < 12, "").otherwise(F.col("text")))
    for render in (captions.render_text, captions.render_srt, captions.render_vtt):
        whole = render(df).collect()
        parts = render(df, part_rows=15).orderBy("part").collect()
        assert len(whole) == 1 and [p.part for p in parts] == [0, 1, 2, 3]
        assert "".join(p.body for p in parts) == whole[0].body
    assert parts[0].body.startswith("WEBVTT\n\n")
    texts = assemble.assemble_text(df, part_rows=15).orderBy("part").collect()
    assert [t.part for t in texts] == [0, 1, 2, 3]
    assert " ".join(t.text for t in texts) == assemble.assemble_text(df).first().text


# --- chunk plans ----------------------------------------------------------------------------

S = 16_000


def cut_points(start, end, audio, max_chunk, window, frame):
    """Cuts of one long region by the definition: centre of the quietest frame of each window."""
    while end - start > max_chunk:
        frames = [
            (int((audio[a : a + frame].astype(np.int64) ** 2).sum()), a)
            for a in range(start + max_chunk - window, start + max_chunk, frame)
        ]
        start = min(frames)[1] + frame // 2
        yield start


def expected_plan(regions, audio, max_chunk, window, frame, max_gap):
    pieces = []  # (start, end, forced, opens a chunk in any case)
    for start, end in regions:
        edges = [start, *cut_points(start, end, audio, max_chunk, window, frame), end]
        pieces += [(a, b, b != end, len(edges) > 2) for a, b in zip(edges, edges[1:])]
    plan, head = [], 0
    for i in range(1, len(pieces) + 1):
        if i < len(pieces):
            start, end, _, alone = pieces[i]
            if not alone and end - pieces[head][0] <= max_chunk and start - pieces[i - 1][1] <= max_gap:
                continue
        plan.append((pieces[head][0], pieces[i - 1][1], pieces[i - 1][2]))
        head = i
    return plan


def blocks(spark, audio, size, recording="r"):
    rows = [(recording, None, i, i * size, audio[i * size : (i + 1) * size].tolist()) for i in range(-(-len(audio) // size))]
    return spark.createDataFrame(rows, PCM_BLOCKS)


def plan(spark, regions, audio=None, size=1000, **sizes):
    df = spark.createDataFrame([("r", None, *r) for r in regions], REGIONS)
    pieces = None
    if audio is not None:
        cut = {k: v for k, v in sizes.items() if k != "max_gap"}
        pieces = chunks.split_long_regions(df, blocks(spark, audio, size), block_samples=size, **cut)
    pack = {k: v for k, v in sizes.items() if k in ("max_chunk", "max_gap")}
    packed = chunks.number_chunks(chunks.pack_chunks(df, pieces=pieces, **pack))
    return [(r.start, r.end, r.forced_cut) for r in packed.orderBy("index").collect()]


def test_packing_limits(spark):
    assert plan(spark, [(0, S), (2 * S, 3 * S), (10 * S, 11 * S)]) == [(0, 3 * S, False), (10 * S, 11 * S, False)]
    assert len(plan(spark, [(0, S), (3 * S, 4 * S)])) == 1
    assert len(plan(spark, [(0, S), (3 * S + 1, 4 * S)])) == 2
    assert len(plan(spark, [(0, 20 * S), (21 * S, 40 * S)])) == 2
    assert plan(spark, [(0, 30 * S)]) == [(0, 30 * S, False)]


def test_forced_cut_in_silence(spark):
    rng = np.random.default_rng(1)
    audio = rng.integers(-9000, 9000, 75 * S).astype(np.int16)
    audio[27 * S : 27 * S + S // 5] = 0
    got = plan(spark, [(0, 70 * S)], audio, size=10 * S, max_chunk=30 * S, cut_window=5 * S, cut_frame=1600)
    assert [g[2] for g in got] == [True, True, False]
    assert 27 * S <= got[0][1] <= 27 * S + S // 5
    closed = plan(spark, [(0, 40 * S), (41 * S, 42 * S)], audio, size=10 * S, max_chunk=30 * S, cut_window=5 * S, cut_frame=1600)
    assert closed[0][2] and closed[-1][1] == 42 * S and len(closed) == 2


def test_plan_by_definition(spark):
    rng = random.Random(21)
    nrng = np.random.default_rng(21)
    for case in range(5):
        audio = nrng.integers(-300, 300, 6000).astype(np.int16)
        regions, t = [], 0
        while t < 5000:
            t += rng.randrange(1, 60)
            end = min(t + rng.choice([5, 30, 80, 400, 1100]), 6000)
            regions.append((t, end))
            t = end
        frame = (4, 6, 5, 8, 10)[case]
        sizes = dict(max_chunk=150 + case, window=frame * 8, frame=frame, max_gap=25)
        want = expected_plan(regions, audio, **sizes)
        got = plan(spark, regions, audio, size=700, max_chunk=sizes["max_chunk"], cut_window=sizes["window"], cut_frame=frame, max_gap=25)
        assert got == want


def test_numbering_resume_and_audio(spark):
    df = spark.createDataFrame(
        [("r", 1, 0, 10, False), ("r", None, 50, 60, False), ("r", 0, 5, 9, False), ("r", 0, 1, 3, True), ("s", 0, 0, 4, False)],
        "recording_id string, channel int, start bigint, end bigint, forced_cut boolean")
    numbered = chunks.number_chunks(df)
    got = {(r.recording_id, r.channel, r.start): r["index"] for r in numbered.collect()}
    assert got == {("r", None, 50): 0, ("r", 0, 1): 1, ("r", 0, 5): 2, ("r", 1, 0): 3, ("s", 0, 0): 0}
    done = numbered.where("index < 2").select("recording_id", "index")
    assert chunks.pending_chunks(numbered, done, ["recording_id", "index"]).count() == 2
    moved = numbered.withColumn("start", F.when(F.col("index") == 0, F.col("start") + 1).otherwise(F.col("start")))
    same = chunks.reusable_results(numbered, moved, ["recording_id", "index"], ["channel", "start", "end"])
    assert same.count() == 3
    audio = np.arange(100, dtype=np.int16)
    cut = chunks.slice_audio(numbered.where("channel IS NULL"), blocks(spark, audio, 7), block_samples=7)
    assert list(cut.first().samples) == list(range(50, 60))
    stored = spark.createDataFrame([("r", 100, [None]), ("s", 7, [0])], "recording_id string, audio_samples bigint, channels array<int>")
    fresh = spark.createDataFrame([("r", 100, [None]), ("s", 8, [0])], stored.schema)
    assert [r.recording_id for r in chunks.reusable_plans(stored, fresh).collect()] == ["r"]


def test_stats_language_and_fallback(spark):
    p = spark.createDataFrame([("r", 0, 160000, True), ("r", 200000, 240000, False)], "recording_id string, start bigint, end bigint, forced_cut boolean")
    results = spark.createDataFrame([("r", 0, "a", None, 0.5), ("r", 1, "b", "eng", 0.9), ("r", 2, "a", "de", 0.8)],
                                    "recording_id string, chunk int, engine string, language string, language_probability double")
    kept = spark.createDataFrame([("r", None, True), ("r", "empty", False), ("r", "empty", True)], "recording_id string, reason string, low_confidence boolean")
    audio = spark.createDataFrame([("r", 0, 320000), ("r", 1, 300000)], "recording_id string, channel int, audio_samples bigint")
    row = assemble.transcript_stats(p, p, results, kept, audio).first()
    assert (row.audio_seconds, row.transcribed_seconds, row.chunks, row.forced_cuts) == (20.0, 12.5, 2, 1)
    assert row.dropped_segments == {"empty": 2} and row.engines == {"a": 2, "b": 1} and row.low_confidence_segments == 1
    assert tuple(assemble.pin_language(results).first()) == ("r", "en", 0.9)
    asked = spark.createDataFrame([("r", "FR-ca")], "recording_id string, language string")
    assert tuple(assemble.pin_language(results, asked).first()) == ("r", "fr", None)
    first = results.where("chunk = 0")
    served = assemble.serve_with_fallback(first, results.withColumn("engine", F.lit("z")), ["recording_id", "chunk"])
    assert sorted(r.engine for r in served.collect()) == ["a", "z", "z"]
    ratios = spark.createDataFrame([(10.0, 4.0), (10.0, 0.0)], "audio_seconds double, processing_seconds double")
    assert [r.realtime_factor for r in assemble.processing_ratio(ratios).collect()] == [2.5, None]
