"""Normaliser table, alignment, seams, scores, roll-ups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechframe.functions import align
from speechframe.functions.text import wer_text
from speechframe.operators import evaluation

WORDS = "array<struct<start:double,end:double,text:string,probability:double>>"

PAIRS = [
    ("Hello, World!", "hello world"),
    ("[music] hi (laughs) there <unk>", "hi there"),
    ("the nation's self-evident", "the nations self evident"),
    ("don’t ‘quote’", "dont quote"),
    ("1,000 and 12,345,678", "1000 and 12345678"),
    ("7 of 100, 42 or 101", "seven of one hundred forty two or 101"),
    ("um, hmm well uh", "well"),
    ("Café naïve ÉCOLE", "cafe naive ecole"),
    ("ﬁne ①", "fine one"),
    ("a_b $5 50%", "a b five fifty"),
    ("007 7", "007 seven"),
    ("", ""),
    ("♪ ♪", ""),
    ("umbrella um", "umbrella"),
    ("20 30 99 0", "twenty thirty ninety nine zero"),
    ("one,two 3,a", "one two three a"),
]


def test_normaliser_table_and_idempotence(spark):
    df = spark.createDataFrame(PAIRS, "t string, want string").withColumn("got", wer_text(F.col("t")))
    rows = df.withColumn("again", wer_text(F.col("got"))).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]
    assert [r.again for r in rows] == [r.got for r in rows]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def traced(ref, hyp):
    """Operations by the documented preference, from the whole table."""
    cost = [[distance(ref[:i], hyp[:j]) for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    i, j, found = len(ref), len(hyp), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            found.append(("equal" if ref[i] == hyp[j] else "substitute", i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            found.append(("delete", i, j))
        else:
            j -= 1
            found.append(("insert", i, j))
    return found[::-1]


def test_alignment_is_the_documented_one_at_any_length(monkeypatch):
    rng = random.Random(2)
    for rows in (align.BLOCK_ROWS, 1, 3):
        monkeypatch.setattr(align, "BLOCK_ROWS", rows)
        for _ in range(60):
            ref = [rng.choice("abcd") for _ in range(rng.randrange(0, 18))]
            hyp = [rng.choice("abcde") for _ in range(rng.randrange(0, 18))]
            ops = align.align_words(ref, hyp)
            assert ops == traced(ref, hyp)
            assert sum(o[0] != "equal" for o in ops) == distance(ref, hyp)
            assert [o[1] for o in ops if o[0] != "insert"] == list(range(len(ref)))
            assert [o[2] for o in ops if o[0] != "delete"] == list(range(len(hyp)))
            assert all(ref[o[1]] == hyp[o[2]] for o in ops if o[0] == "equal")


def test_alignment_in_bands_of_any_width(monkeypatch):
    rng = random.Random(5)
    for half, rows in ((1, 1), (2, 3), (3, 256)):
        monkeypatch.setattr(align, "FIRST_BAND", half)
        monkeypatch.setattr(align, "BLOCK_ROWS", rows)
        for _ in range(80):
            ref = [rng.choice("abcd") for _ in range(rng.randrange(0, 30))]
            hyp = [w for w in ref if rng.random() > 0.2] if rng.random() < 0.5 else [
                rng.choice("abcde") for _ in range(rng.randrange(0, 30))]
            assert align.align_words(ref, hyp) == traced(ref, hyp)


def test_alignment_of_long_clips_with_few_errors(monkeypatch):
    cells = 0
    plain = align._next_row

    def counted(row, *rest):
        nonlocal cells
        cells += len(row)
        return plain(row, *rest)

    monkeypatch.setattr(align, "_next_row", counted)
    ref = [f"w{i % 997}" for i in range(20_000)]
    hyp = [w for i, w in enumerate(ref) if i % 1000 != 7]
    hyp[5000:5000] = ["extra"] * 5
    ops = align.align_words(ref, hyp)
    assert sum(o[0] != "equal" for o in ops) == 25
    assert cells < len(ref) * len(hyp) / 50


def test_word_errors_equals_alignment(spark):
    rng = random.Random(4)
    rows = [([rng.choice(["a", "bb", "ç", "d"]) for _ in range(rng.randrange(0, 12))],
             [rng.choice(["a", "bb", "ç", "e"]) for _ in range(rng.randrange(0, 12))]) for _ in range(120)]
    df = spark.createDataFrame(rows, "r array<string>, h array<string>")
    got = df.select("r", "h", align.word_errors(F.col("r"), F.col("h")).alias("n")).collect()
    assert [r.n for r in got] == [distance(r.r, r.h) for r in got]


def test_boundaries(spark):
    df = spark.createDataFrame([("r", 0, 0.0, 21.0), ("r", 1, 22.3, 48.8), ("s", 0, 0.0, 5.0), ("t", 0, 0.0, 5.0), ("t", 1, 5.0, 6.0)],
                               "recording_id string, index int, start double, end double")
    got = sorted((r.recording_id, r.t) for r in evaluation.boundaries(df).collect())
    assert got == [("r", 21.0), ("r", 22.3), ("t", 5.0)]


def test_seam_coverage(spark):
    df = spark.createDataFrame([("r", t, 30.0) for t in (0.5, 21.0, 21.5, 29.5)], "k string, t double, duration double")
    for hot_rows in (None, 2):
        assert evaluation.seam_coverage(df, ["k"], 1.0, hot_rows=hot_rows).first().near_seam_s == pytest.approx(5.5)


def test_near_seams_equals_all_pairs(spark):
    rng = random.Random(5)
    spans = [("ab"[i % 2], i, s := rng.random() * 100, s + rng.choice([0.0, 0.5, 9.0])) for i in range(150)]
    marks = [("ab"[i % 2], rng.random() * 100) for i in range(12)]
    want = {i: any(k == m and t - 1.0 <= e and s <= t + 1.0 for m, t in marks) for k, i, s, e in spans}
    a = spark.createDataFrame(spans, "k string, i int, start double, end double")
    b = spark.createDataFrame(marks, "k string, t double")
    for hot_rows in (None, 20):
        got = {r.i: r.near for r in evaluation.near_seams(a, b, ["k"], 1.0, hot_rows=hot_rows).collect()}
        assert got == want


def score(spark, reference, tokens, seams=(), audio_s=60.0):
    clips = spark.createDataFrame([("c", reference, audio_s)], "clip_id string, reference string, audio_s double")
    toks = spark.createDataFrame([("c", "p", s, e, i, 0, 0, t) for i, (t, s, e) in enumerate(tokens)],
                                 "clip_id string, config string, start double, end double, ord int, word int, sub int, text string")
    marks = spark.createDataFrame([("c", "p", float(t)) for t in seams], "clip_id string, config string, t double")
    runs = spark.createDataFrame([("c", "p", 2.0)], "clip_id string, config string, seconds double")
    return evaluation.score(clips, toks, marks, runs).first()


def test_lost_word_at_a_seam(spark):
    got = score(spark, "Fathers brought forth on", [("fathers", 1.0, 2.0), ("brought", 3.0, 29.8), ("on", 30.3, 31.0)], [30.0])
    assert (got.deletions, got.substitutions, got.insertions, got.seam_errors) == (1, 0, 0, 1)
    assert got.near_seam_s == pytest.approx(2.0) and got.seams == 1 and got.ref_words == 4


def test_empty_sides(spark):
    silent = score(spark, "[music]", [("you", 0.0, 1.0), ("know", 1.0, 2.0)])
    assert (silent.insertions, silent.char_errors, silent.ref_words, silent.hyp_words) == (2, 0, 0, 2)
    deaf = score(spark, "four score", [])
    assert (deaf.deletions, deaf.char_errors, deaf.hypothesis) == (2, len("four score"), "")


def test_timed_tokens(spark):
    rows = [("c", 0, 0.0, 4.0, "ignored", [(1.0, 1.5, "1,000", 0.5), (2.0, 2.5, "self-evident", None), (3.0, 3.1, "um", None)]),
            ("c", 1, 5.0, 6.0, "Two words", None), ("c", 2, 7.0, 8.0, "last", [])]
    df = spark.createDataFrame(rows, f"clip_id string, ord int, start double, end double, text string, words {WORDS}")
    got = evaluation.timed_tokens(df, ["clip_id"], F.lit(10.0)).orderBy("ord", "word", "sub").collect()
    assert [(r.text, r.start, r.end) for r in got] == [
        ("1000", 11.0, 11.5), ("self", 12.0, 12.5), ("evident", 12.0, 12.5), ("two", 15.0, 16.0), ("words", 15.0, 16.0), ("last", 17.0, 18.0)]


def test_rollup_and_report(spark):
    columns = ("clip_id string, config string, tags array<string>, audio_s double, seconds double, ref_words bigint, hyp_words bigint, "
               "substitutions bigint, deletions bigint, insertions bigint, ref_chars bigint, char_errors bigint, seams bigint, "
               "seam_errors bigint, near_seam_s double")
    df = spark.createDataFrame([
        ("a", "p", ["x", "y"], 10.0, 2.0, 10, 9, 1, 1, 0, 50, 5, 2, 1, 4.0),
        ("b", "p", ["x"], 30.0, 2.0, 30, 31, 0, 0, 2, 150, 5, 1, 0, 2.0),
        ("c", "p", ["quiet"], 20.0, 1.0, 0, 7, 0, 0, 7, 0, 0, 3, 0, 1.0)], columns)
    rates = {(r.config, r.tag): r for r in evaluation.rollup_with_tags(df).collect()}
    everything = rates["p", None]
    assert (everything.clips, everything.wer, everything.cer) == (3, 4 / 40, 10 / 200)
    assert (everything.hallucinated_words, everything.seams, everything.seam_error_share) == (7, 3, 0.25)
    assert everything.x_realtime == 12.0 and everything.near_seam_audio_share == 6 / 40
    assert rates["p", "x"].clips == 2 and rates["p", "x"].hallucinated_words is None
    assert rates["p", "quiet"].wer is None and rates["p", "quiet"].hallucinated_words == 7
    lines = {(r.config, r.tag): r.line for r in evaluation.report_lines(evaluation.rollup_with_tags(df)).collect()}
    assert lines["p", None] == "| p | 10.0% | 5.0% | 1 / 1 / 2 | 7 | 3 | 1 | 25.0% | 15.0% | 12.0 |"
    assert lines["p", "quiet"] == "| quiet | 1 | p | 7 words on no-speech |"
    both = df.unionByName(df.where("clip_id = 'a'").withColumn("config", F.lit("q")).withColumn("substitutions", F.lit(4).cast("bigint")))
    report = [r.line for r in evaluation.markdown_report(both, ["p", "q"], "Eval", "notes").orderBy("section", "position").collect()]
    assert report[0] == "# Eval" and "| tag | clips | p | q |" in report
    assert "| x | 2 | 10.0% | 50.0% |" in report and "| quiet | 1 | 7 words on no-speech |  |" in report
    assert "| a | 10.0 | 20.0% (1 errors near 2 seams) | 50.0% (1 errors near 2 seams) |" in report
    assert report.index("## By tag (WER; hallucinated words where the reference is empty)") < report.index("## Per clip")
    _, clips = evaluation.json_report(df)
    assert {r.clip_id: r.wer for r in clips.collect()} == {"a": 0.2, "b": 2 / 30, "c": None}
    with pytest.raises(ValueError):
        evaluation.run_grid(df, {})


def test_last_row_matches_plain():
    band = align._Band(np.array([1, 2, 3]), np.array([2, 3, 4]), 3)
    row = band.first
    for i in range(1, 4):
        row = band.after(row, i)
    assert row[3] == 2


def test_percent_rounds_the_exact_value(spark):
    rates = [n / d for d in (3, 7, 40, 200, 400, 1000, 2000) for n in range(0, 2 * d, 1 + d // 150)] + [1234567.25 / 100]
    df = spark.createDataFrame([(v,) for v in rates], "v double")
    got = df.select("v", evaluation.percent(F.col("v")).alias("p"), evaluation.one_decimal(F.col("v")).alias("d")).collect()
    assert [(r.p, r.d) for r in got] == [(f"{r.v:.1%}", f"{r.v:.1f}") for r in got]
    assert df.select(evaluation.percent(F.lit(None).cast("double"))).first()[0] == "n/a"
