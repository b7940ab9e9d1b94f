"""Error rates: timed tokens, alignment, seams, scores, corpus roll-ups, report lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.functions.align import alignment, char_errors
from speechframe.functions.text import wer_text
from speechframe.operators.ordered import HOT_ROWS, Hot, cut_lineage, prefix_scan

SEAM_TOLERANCE_S = 1.0


def timed_tokens(
    segments: DataFrame, keys: Sequence[str] = ("clip_id", "config"), offset: Column | None = None
) -> DataFrame:
    """Normalised words ``(keys, start, end, ord, word, sub, text)`` of segments.

    A word keeps its own time; a segment without words lends its span to all of its text.
    ``(start order)`` is ``(ord, word, sub)``."""
    shift = F.lit(0.0) if offset is None else offset
    own = F.array(F.struct("start", "end", "text"))
    timed = F.transform(
        "words", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"),
                                    w["text"].alias("text"))
    )
    source = F.when(F.size("words") > 0, timed).otherwise(own)
    words = segments.select(
        *keys, "ord", shift.alias("_shift"), F.posexplode(source).alias("word", "_w")
    )
    return (
        words.withColumn("_t", wer_text(F.col("_w.text")))
        .where(F.col("_t") != "")
        .select(
            *keys,
            (F.col("_shift") + F.col("_w.start")).alias("start"),
            (F.col("_shift") + F.col("_w.end")).alias("end"),
            "ord",
            "word",
            F.posexplode(F.split("_t", " ")).alias("sub", "text"),
        )
    )


def boundaries(
    chunks: DataFrame,
    keys: Sequence[str] = ("recording_id",),
    order: Sequence[str] = ("index",),
    *,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Distinct seams ``(keys, t)``: where one chunk ends and where the next begins."""
    following = prefix_scan(
        chunks, keys, order, {"_next": ("last", F.col("start"), False)}, reverse=True,
        hot_rows=hot_rows,
    )
    return (
        following.where(F.col("_next").isNotNull())
        .select(*keys, F.explode(F.array("end", "_next")).alias("t"))
        .distinct()
    )


def near_seams(
    spans: DataFrame,
    seams: DataFrame,
    keys: Sequence[str],
    tolerance: float,
    *,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Add ``near`` to spans ``(keys, start, end, ...)``: a seam ``t`` with
    ``t - tolerance <= end`` and ``start <= t + tolerance`` exists.

    The earliest seam that reaches ``start`` decides, so this is one ordered scan over spans and
    seams together instead of a range join."""
    rows = spans.withColumn("_span", F.struct(*spans.columns)).select(
        *keys, F.col("start").cast("double").alias("_at"), F.lit(0).alias("_kind"), "_span",
        F.lit(None).cast("double").alias("_t"),
    )
    marks = seams.select(
        *keys,
        (F.col("t") + F.lit(tolerance)).cast("double").alias("_at"),
        F.lit(1).alias("_kind"),
        F.col("t").cast("double").alias("_t"),
    )
    both = rows.unionByName(marks, allowMissingColumns=True)
    scanned = prefix_scan(
        both, keys, ["_at", "_kind"], {"_seam": ("last", F.col("_t"), False)}, reverse=True,
        hot_rows=hot_rows,
    ).where(F.col("_kind") == 0)
    near = F.coalesce(F.col("_seam") - F.lit(tolerance) <= F.col("_span.end"), F.lit(False))
    return scanned.select("_span.*", near.alias("near"))


def seam_coverage(
    seams: DataFrame,
    keys: Sequence[str],
    tolerance: float,
    duration: str = "duration",
    *,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Length within ``tolerance`` of a seam, overlaps counted once, clipped to
    ``[0, duration]``; ``seams`` carries ``duration`` per row."""
    until = F.least(F.col("t") + F.lit(tolerance), F.col(duration))
    scanned = prefix_scan(
        seams, keys, ["t"], {"_reach": ("max", until, False)}, hot_rows=hot_rows
    )
    low = F.greatest(F.col("t") - F.lit(tolerance), F.col("_reach"), F.lit(0.0))
    return scanned.groupBy(*keys).agg(
        F.sum(F.greatest(F.lit(0.0), until - low)).alias("near_seam_s")
    )


def error_spans(pairs: DataFrame, duration: str = "audio_s") -> DataFrame:
    """One time span per word error of ``pairs (..., ref array, hyp array<struct>, audio_s)``.

    A missing word was never heard, so it gets the gap between its neighbours."""
    ops = pairs.withColumn(
        "_ops", alignment("ref", F.transform("hyp", lambda t: t["text"]))
    ).withColumn("_op", F.explode(F.filter("_ops", lambda o: o["op"] != "equal")))
    token = F.try_element_at("hyp", F.col("_op.hyp_idx") + 1)
    # Index 0 is an error for element_at, so the neighbour before the first token is NULL.
    before = F.when(
        F.col("_op.hyp_idx") > 0, F.try_element_at("hyp", F.greatest(F.col("_op.hyp_idx"), F.lit(1)))
    )
    gone = F.col("_op.op") == "delete"
    return ops.select(
        *[c for c in pairs.columns if c not in ("ref", "hyp", duration)],
        "_op.op",
        F.when(gone, F.coalesce(before["end"], F.lit(0.0))).otherwise(token["start"]).alias("start"),
        F.when(gone, F.coalesce(token["start"], F.col(duration))).otherwise(token["end"]).alias("end"),
    )


def score(
    clips: DataFrame,
    tokens: DataFrame,
    seams: DataFrame,
    runs: DataFrame,
    *,
    tolerance: float = SEAM_TOLERANCE_S,
) -> DataFrame:
    """Raw counts per clip and configuration.

    ``clips (clip_id, reference, audio_s)``, ``runs (clip_id, config, seconds)`` (the grid),
    ``tokens`` from :func:`timed_tokens`, ``seams (clip_id, config, t)``.
    A clip's tokens form one row: a recording is at most the longest accepted audio."""
    keys = ["clip_id", "config"]
    heard = tokens.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ord", "word", "sub", "text", "start", "end"))).alias("hyp")
    )
    none = F.array().cast(heard.schema["hyp"].dataType)
    pairs = (
        runs.join(clips, "clip_id")
        .join(heard, keys, "left")
        .withColumn("hyp", F.coalesce("hyp", none))
        .withColumn("_ref", wer_text(F.col("reference")))
        .withColumn("ref", F.filter(F.split("_ref", " "), lambda t: t != ""))
    )
    # Read several times below; what is before it may be recognition.
    pairs = cut_lineage(pairs)
    spoken = pairs.where(F.col("_ref") != "")
    spans = error_spans(spoken.select(*keys, "ref", "hyp", "audio_s"))
    counted = near_seams(spans, seams, keys, tolerance).groupBy(*keys).agg(
        F.count_if(F.col("op") == "substitute").alias("substitutions"),
        F.count_if(F.col("op") == "delete").alias("deletions"),
        F.count_if(F.col("op") == "insert").alias("_insertions"),
        F.count_if("near").alias("seam_errors"),
    )
    lengths = pairs.select(*keys, F.col("audio_s").alias("duration"))
    covered = seam_coverage(seams.join(lengths, keys), keys, tolerance)
    seam_count = seams.groupBy(*keys).agg(F.count(F.lit(1)).alias("seams"))
    text = F.array_join(F.transform("hyp", lambda t: t["text"]), " ")
    zero = F.lit(0).cast("bigint")
    return (
        pairs.join(counted, keys, "left")
        .join(covered, keys, "left")
        .join(seam_count, keys, "left")
        .select(
            *keys,
            "audio_s",
            "seconds",
            F.size("ref").cast("bigint").alias("ref_words"),
            F.size("hyp").cast("bigint").alias("hyp_words"),
            F.coalesce("substitutions", zero).alias("substitutions"),
            F.coalesce("deletions", zero).alias("deletions"),
            F.when(F.col("_ref") == "", F.size("hyp"))
            .otherwise(F.coalesce("_insertions", zero))
            .cast("bigint")
            .alias("insertions"),
            F.length("_ref").cast("bigint").alias("ref_chars"),
            char_errors(F.col("_ref"), text).alias("char_errors"),
            F.coalesce("seams", zero).alias("seams"),
            F.coalesce("seam_errors", zero).alias("seam_errors"),
            F.coalesce("near_seam_s", F.lit(0.0)).alias("near_seam_s"),
            text.alias("hypothesis"),
        )
    )


def rollup(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Corpus rates per key: sums of errors over sums of reference sizes, never mean rates."""
    speech = F.col("ref_words") > 0

    def total(column: str, when: Column = speech) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(0))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.try_divide(top, F.nullif(bottom, F.lit(0)))

    errors = total("substitutions") + total("deletions") + total("insertions")
    everything = F.lit(True)
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clips"),
        ratio(errors, total("ref_words")).alias("wer"),
        ratio(total("char_errors"), total("ref_chars")).alias("cer"),
        total("substitutions").alias("substitutions"),
        total("deletions").alias("deletions"),
        total("insertions").alias("insertions"),
        total("ref_words").alias("ref_words"),
        F.sum(F.when(~speech, F.col("hyp_words"))).alias("hallucinated_words"),
        total("seams").alias("seams"),
        total("seam_errors").alias("seam_errors"),
        ratio(total("seam_errors"), errors).alias("seam_error_share"),
        ratio(total("near_seam_s"), total("audio_s")).alias("near_seam_audio_share"),
        ratio(total("audio_s", everything), total("seconds", everything)).alias("x_realtime"),
    )


def rollup_with_tags(scores: DataFrame, tags: str = "tags", config: str = "config") -> DataFrame:
    """Overall rows (``tag`` NULL) and one row per tag, in one pass: a clip counts once for each
    of its tags and once under NULL."""
    own = F.array_compact(F.array_distinct(tags))
    named = F.concat(own, F.array(F.lit(None).cast("string")))
    return rollup(scores.withColumn("tag", F.explode(named)), [config, "tag"])


def one_decimal(value: Column) -> Column:
    """Text of a number of 0 or more with one decimal, rounded from its exact binary value; only a
    value that is itself half-way goes to the even neighbour. The built-in formatter rounds the
    shortest decimal text of the value instead."""
    low = F.floor(value * 10)
    middle = (low * 2 + 1) / F.lit(20.0)
    # The nearest double to the middle: whether it lies above or below, in two exact products.
    coarse = F.floor(middle * (1 << 20)) / F.lit(float(1 << 20))
    beyond = (coarse * 20 - (low * 2 + 1)) + (middle - coarse) * 20
    up = (value > middle) | ((value == middle) & ((beyond > 0) | ((beyond == 0) & (low % 2 == 1))))
    tenths = low + up.cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def percent(value: Column) -> Column:
    """A rate of 0 or more in percent with one decimal."""
    return F.when(value.isNull(), "n/a").otherwise(F.concat(one_decimal(value * 100), F.lit("%")))


def number(value: Column, fmt: str = "%d") -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string(fmt, value))


def report_lines(rates: DataFrame, *, cells_only: bool = False) -> DataFrame:
    """Markdown rows ``(config, tag, clips, line)`` of :func:`rollup_with_tags`: the aggregate
    table's row for a configuration, or a row (or only the cell) of a tag."""
    overall = F.format_string(
        "| %s | %s | %s | %d / %d / %d | %s | %d | %d | %s | %s | %s |",
        "config",
        percent(F.col("wer")),
        percent(F.col("cer")),
        "substitutions",
        "deletions",
        "insertions",
        number(F.col("hallucinated_words")),
        "seams",
        "seam_errors",
        percent(F.col("seam_error_share")),
        percent(F.col("near_seam_audio_share")),
        F.coalesce(one_decimal(F.col("x_realtime")), F.lit("n/a")),
    )
    cell = F.concat_ws(
        "; ",
        F.when(F.col("wer").isNotNull(), percent(F.col("wer"))),
        F.when(
            F.col("hallucinated_words").isNotNull(),
            F.format_string("%d words on no-speech", "hallucinated_words"),
        ),
    )
    tagged = (
        cell if cells_only else F.format_string("| %s | %d | %s | %s |", "tag", "clips", "config", cell)
    )
    return rates.select(
        "config", "tag", "clips", F.when(F.col("tag").isNull(), overall).otherwise(tagged).alias("line")
    )


def clip_cell(scores: DataFrame) -> Column:
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return F.when(F.col("ref_words") == 0, F.format_string("%d words", "hyp_words")).otherwise(
        F.format_string(
            "%s (%d errors near %d seams)",
            percent(F.try_divide(errors, "ref_words")),
            "seam_errors",
            "seams",
        )
    )


# The report's headings.
_AGGREGATE_HEAD = (
    "| config | WER | CER | sub / del / ins | hallucinated words (no-speech clips) | seams "
    "| errors ≤1 s from a seam | share of errors | share of audio | speed (x realtime) |"
)


def markdown_report(scores: DataFrame, configs: Sequence[str], title: str, notes: str) -> DataFrame:
    """The whole report as ``(section, position, line)``: head, aggregate table, a row per tag and
    a row per clip with one cell per configuration. ``scores`` carries ``tags``."""
    spark = scores.sparkSession
    rates = report_lines(rollup_with_tags(scores), cells_only=True)

    def lines(section: int, texts: Sequence[str]) -> DataFrame:
        rows = [(section, f"{i:04d}", text) for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "section int, position string, line string")

    rule = "|---|---|" + "---|" * len(configs)
    names = " | ".join(configs)
    rank = F.array_position(F.array(*[F.lit(c) for c in configs]), F.col("config"))
    overall = rates.where(F.col("tag").isNull()).select(
        F.lit(1).alias("section"), F.format_string("%04d", rank).alias("position"), "line"
    )

    def table(section: int, cells: DataFrame, key: str, second: Column) -> DataFrame:
        by_config = cells.groupBy(key).agg(
            second.alias("_second"),
            F.map_from_entries(F.collect_list(F.struct("config", "cell"))).alias("_cells"),
        )
        row = F.concat_ws(
            " | ",
            F.col(key),
            F.col("_second"),
            *[F.coalesce(F.try_element_at("_cells", F.lit(c)), F.lit("")) for c in configs],
        )
        return by_config.select(
            F.lit(section).alias("section"), F.col(key).alias("position"),
            F.concat(F.lit("| "), row, F.lit(" |")).alias("line"),
        )

    tagged = rates.where(F.col("tag").isNotNull()).withColumnRenamed("line", "cell")
    clips = scores.withColumn("cell", clip_cell(scores))
    return (
        lines(0, [f"# {title}", "", notes, "", "## Aggregate", "", _AGGREGATE_HEAD, "|---" * 10 + "|"])
        .unionByName(overall)
        .unionByName(lines(2, ["", "## By tag (WER; hallucinated words where the reference is empty)", "",
                               f"| tag | clips | {names} |", rule]))
        .unionByName(table(3, tagged, "tag", F.max("clips").cast("string")))
        .unionByName(lines(4, ["", "## Per clip", "", f"| clip | audio s | {names} |", rule]))
        .unionByName(table(5, clips, "clip_id", one_decimal(F.max("audio_s"))))
    )


def json_report(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows for the JSON report: rates overall and by tag, and clips with their error rate."""
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    own = F.try_divide(errors, F.nullif("ref_words", F.lit(0)))
    return rollup_with_tags(scores), scores.withColumn("wer", own)


FrontEnd = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def run_grid(
    clips: DataFrame, front_ends: dict[str, FrontEnd]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clip x configuration grid ``(tokens, seams, runs)`` of named front ends, each a function
    of the clips that returns tokens and seams."""
    tokens = seams = runs = None
    for name, front_end in front_ends.items():
        found, marks = (part.withColumn("config", F.lit(name)) for part in front_end(clips))
        run = clips.select("clip_id", F.lit(name).alias("config"), F.lit(0.0).alias("seconds"))
        tokens = found if tokens is None else tokens.unionByName(found)
        seams = marks if seams is None else seams.unionByName(marks)
        runs = run if runs is None else runs.unionByName(run)
    if tokens is None:
        raise ValueError("at least one front end is needed")
    return tokens, seams, runs
