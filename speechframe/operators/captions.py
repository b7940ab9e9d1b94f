"""Caption cues and the plain text, SubRip and WebVTT renderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.functions import timing
from speechframe.functions.text import tokens
from speechframe.operators.assemble import number_parts
from speechframe.operators.ordered import HOT_ROWS, Hot, measure, prefix_scan, without_slices

WIDTH = 42
MAX_LINES = 2


def wrap(words: Column, width: int) -> Column:
    """Greedy lines of at most ``width`` characters; a longer word stays whole on its line.

    Returns ``array<struct<t, n, c>>``: line text, its words, and their characters.
    """
    line = "struct<t:string,n:int,c:int>"
    start = F.struct(
        F.array().cast(f"array<{line}>").alias("done"),
        F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(0).alias("c"))
        .cast(line).alias("cur"),
    )

    def add(state: Column, word: Column) -> Column:
        cur = state["cur"]
        size = F.length(word)
        fits = F.length(cur["t"]) + 1 + size <= width
        alone = F.struct(word.alias("t"), F.lit(1).alias("n"), size.alias("c")).cast(line)
        longer = F.struct(
            F.concat(cur["t"], F.lit(" "), word).alias("t"),
            (cur["n"] + 1).alias("n"),
            (cur["c"] + size).alias("c"),
        ).cast(line)
        return (
            F.when(cur["n"] == 0, F.struct(state["done"].alias("done"), alone.alias("cur")))
            .when(fits, F.struct(state["done"].alias("done"), longer.alias("cur")))
            .otherwise(
                F.struct(
                    F.concat(state["done"], F.array(cur)).alias("done"), alone.alias("cur")
                )
            )
        )

    return F.aggregate(
        words, start, add, lambda s: F.concat(s["done"], F.filter(F.array(s["cur"]), lambda c: c["n"] > 0))
    )


def caption_cues(
    segments: DataFrame,
    keys: Sequence[str] = ("recording_id",),
    *,
    width: int = WIDTH,
    max_lines: int = MAX_LINES,
) -> DataFrame:
    """Cues ``(keys, ord, cue, start_ms, end_ms, lines, channel)`` of segments
    ``(keys, ord, start, end, text, channel[, words])``.

    A segment that needs several cues is timed by its words when there is one per token, else by
    the share of characters. All of it is local to a segment's row.
    """
    if width < 1 or max_lines < 1:
        raise ValueError("width and max_lines must be at least 1")
    if "words" not in segments.columns:
        segments = segments.withColumn(
            "words", F.lit(None).cast("array<struct<start:double,end:double>>")
        )
    wrapped = (
        segments.withColumn("_tokens", tokens(F.col("text")))
        .where(F.size("_tokens") > 0)
        .withColumn("_lines", wrap(F.col("_tokens"), width))
        .withColumn("_groups", F.ceil(F.size("_lines") / F.lit(max_lines)).cast("int"))
        .withColumn(
            "_timed", F.coalesce(F.size("words") == F.size("_tokens"), F.lit(False))
        )
        .withColumn("_chars", _line_sum(F.col("_lines"), "c"))
    )

    def cue(g: Column) -> Column:
        lines = F.col("_lines")
        before = F.slice(lines, F.lit(1), g * max_lines)
        here = F.slice(lines, g * max_lines + 1, F.lit(max_lines))
        first = _line_sum(before, "n")
        until = first + _line_sum(here, "n")
        c0 = _line_sum(before, "c")
        c1 = c0 + _line_sum(here, "c")
        start, duration = F.col("start"), F.col("end") - F.col("start")
        single = F.col("_groups") == 1
        by_word = F.col("_timed")
        begin = (
            F.when(single, start)
            .when(by_word, F.try_element_at("words", first + 1)["start"])
            .otherwise(start + duration * c0 / F.col("_chars"))
        )
        finish = (
            F.when(single, F.col("end"))
            .when(by_word, F.try_element_at("words", until)["end"])
            .otherwise(start + duration * c1 / F.col("_chars"))
        )
        return F.struct(
            g.alias("cue"),
            begin.alias("begin"),
            finish.alias("finish"),
            F.transform(here, lambda x: x["t"]).alias("lines"),
        )

    cues = F.transform(F.sequence(F.lit(0), F.col("_groups") - 1), cue)
    start_ms = timing.cue_start_ms(F.col("_c.begin"))
    return (
        wrapped.select(*keys, "ord", "channel", F.explode(cues).alias("_c"))
        .select(
            *keys,
            "ord",
            "_c.cue",
            start_ms.alias("start_ms"),
            timing.cue_end_ms(F.col("_c.finish"), start_ms).alias("end_ms"),
            "_c.lines",
            "channel",
        )
    )


def _line_sum(lines: Column, field: str) -> Column:
    return F.aggregate(lines, F.lit(0), lambda total, x: total + x[field])


def number_cues(
    cues: DataFrame, keys: Sequence[str] = ("recording_id",), *, hot_rows: int | None | Hot = HOT_ROWS
) -> DataFrame:
    """Cue numbers per recording by start."""
    numbered = prefix_scan(
        cues,
        keys,
        ["start_ms", "ord", "cue"],
        {"number": ("count", F.lit(1), True)},
        hot_rows=hot_rows,
    )
    return without_slices(numbered)


def _numbered(segments, keys, width, max_lines, part_rows) -> DataFrame:
    """Numbered cues; hot keys are found by their segments, before any text is wrapped. ``part`` is
    0, or counts the document's parts of ``part_rows`` cues."""
    timed = segments.withColumn("start_ms", timing.cue_start_ms(F.col("start")))
    hot = measure(timed, keys, "start_ms")
    cues = caption_cues(segments, keys, width=width, max_lines=max_lines)
    number = F.lit(0) if part_rows is None else F.floor((F.col("number") - 1) / F.lit(part_rows))
    return number_cues(cues, keys, hot_rows=hot).withColumn("part", number.cast("bigint"))


def _document(lines: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return (
        lines.groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct(*order, "_line"))).alias("_l"))
        .select(*keys, "part", F.array_join(F.transform("_l", lambda x: x["_line"]), "").alias("body"))
    )


def render_text(
    segments: DataFrame,
    keys: Sequence[str] = ("recording_id",),
    *,
    part_rows: int | None = None,
) -> DataFrame:
    """``(keys, part, body)``: one labelled line per non-empty segment. Like all renderings, one row
    per recording, or parts of ``part_rows`` if asked for."""
    spoken = segments.where(F.col("text") != "").withColumn("_ch", F.coalesce("channel", F.lit(0)))
    order = ["start", "_ch", "ord"]
    line = F.concat(timing.speaker_label(F.col("channel")), F.col("text"), F.lit("\n"))
    return _document(number_parts(spoken, keys, order, part_rows).withColumn("_line", line), keys, order)


def render_srt(
    segments: DataFrame,
    keys: Sequence[str] = ("recording_id",),
    *,
    width: int = WIDTH,
    max_lines: int = MAX_LINES,
    part_rows: int | None = None,
) -> DataFrame:
    cues = _numbered(segments, keys, width, max_lines, part_rows)
    line = F.concat(
        F.col("number").cast("string"),
        F.lit("\n"),
        _span(","),
        timing.speaker_label(F.col("channel")),
        F.array_join("lines", "\n"),
        F.lit("\n\n"),
    )
    return _document(cues.withColumn("_line", line), keys, ["number"])


def render_vtt(
    segments: DataFrame,
    keys: Sequence[str] = ("recording_id",),
    *,
    recordings: DataFrame | None = None,
    width: int = WIDTH,
    max_lines: int = MAX_LINES,
    part_rows: int | None = None,
) -> DataFrame:
    """With ``recordings`` (their keys), recordings without segments get the bare header."""
    cues = _numbered(segments, keys, width, max_lines, part_rows)
    line = F.concat(
        _span("."),
        timing.voice_tag(F.col("channel")),
        timing.markup_escape(F.array_join("lines", "\n")),
        F.lit("\n\n"),
    )
    body = _document(cues.withColumn("_line", line), keys, ["number"])
    if recordings is not None:
        body = recordings.select(*keys).distinct().join(body, list(keys), "left")
    part = F.coalesce("part", F.lit(0).cast("bigint"))
    first = F.when(part == 0, F.lit("WEBVTT\n\n")).otherwise(F.lit(""))
    return body.select(
        *keys,
        part.alias("part"),
        F.concat(first, F.coalesce("body", F.lit(""))).alias("body"),
    )


def _span(separator: str) -> Column:
    return F.concat(
        timing.time_stamp(F.col("start_ms"), separator),
        F.lit(" --> "),
        timing.time_stamp(F.col("end_ms"), separator),
        F.lit("\n"),
    )
