"""Timed word streams to sentence-like segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe.functions.text import SPACES, strip
from speechframe.operators.assemble import number_parts
from speechframe.operators.ordered import HOT_ROWS, Hot, measure, prefix_scan, without_slices

PAUSE_S = 0.8
# Characters that end a sentence.
SENTENCE_END = r"[.?!…。？！]$"


def grouped_words(
    words: DataFrame,
    keys: Sequence[str] = ("recording_id", "chunk"),
    *,
    order: str = "ord",
    pause: float = PAUSE_S,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """The words and spacings ``(keys, ord, text, start, end, type, logprob)`` that segments consist of, as rows of
    their own with the number ``group`` of their segment and, for words, the ``probability``.

    A word opens a segment after a sentence end or a pause longer than ``pause``. Spacing belongs
    to the word before it and is dropped after a sentence end; other types are ignored. The rows of a hot
    key stay spread over its slices, however long a segment is.
    """
    is_word = F.col("type") == "word"
    ends = F.regexp_replace("text", f"{SPACES}+$", "").rlike(SENTENCE_END)
    rows = words.where(F.col("type").isin("word", "spacing"))
    last_word = F.when(is_word, F.struct(F.col("end").alias("end"), ends.alias("ends")))
    hot = measure(rows, keys, order, hot_rows)
    seen = prefix_scan(
        rows, keys, [order], {"_prev": ("last", last_word, False)}, hot_rows=hot
    )
    opens = is_word & (
        F.col("_prev").isNull()
        | F.col("_prev.ends")
        | (F.col("start") - F.col("_prev.end") > pause)
    )
    grouped = prefix_scan(
        seen, keys, [order], {"group": ("sum", opens.cast("bigint"), True)}, hot_rows=hot
    ).where(is_word | ~F.coalesce(F.col("_prev.ends"), F.lit(True)))
    probability = F.when(is_word, F.exp("logprob"))
    return without_slices(grouped.drop("_prev")).withColumn("probability", probability)


def segment_spans(grouped: DataFrame, keys: Sequence[str], *, order: str = "ord") -> DataFrame:
    """``(keys, group, start, end, words, avg_logprob, least_probability)`` of the rows of :func:`grouped_words`.

    Every value is a partial aggregate of a fixed size, so a segment of any length is summed up where its rows
    are and only the sums meet."""
    is_word = F.col("type") == "word"
    place = F.when(is_word, F.col(order))
    return grouped.groupBy(*keys, "group").agg(
        F.min_by("start", place).alias("start"),
        F.max_by("end", place).alias("end"),
        F.count_if(is_word).alias("words"),
        F.avg(F.when(is_word, F.col("logprob"))).alias("avg_logprob"),
        F.min("probability").alias("least_probability"),
    )


def segment_texts(
    grouped: DataFrame, keys: Sequence[str], *, order: str = "ord", part_rows: int = 10_000
) -> DataFrame:
    """``(keys, group, part, text)``: the text of each segment in parts of at most ``part_rows`` words and
    spacings, numbered from 0 without gaps. Joined in order, and stripped, they are the segment's text."""
    numbered = number_parts(grouped, [*keys, "group"], [order], part_rows)
    entry = F.struct(F.col(order).alias("o"), F.col("text").alias("t"))
    parts = numbered.groupBy(*keys, "group", "part").agg(F.array_sort(F.collect_list(entry)).alias("_t"))
    text = F.array_join(F.transform("_t", lambda t: t["t"]), "")
    return parts.select(*keys, "group", "part", text.alias("text"))


def group_words(
    words: DataFrame,
    keys: Sequence[str] = ("recording_id", "chunk"),
    *,
    order: str = "ord",
    pause: float = PAUSE_S,
    hot_rows: int | None | Hot = HOT_ROWS,
) -> DataFrame:
    """Segments ``(keys, group, start, end, text, avg_logprob, words)`` from rows
    ``(keys, ord, text, start, end, type, logprob)``, each one row with its words in an array: for segments as
    long as people talk without a pause. For any length see :func:`segment_spans` and :func:`segment_texts`.
    """
    is_word = F.col("type") == "word"
    grouped = grouped_words(words, keys, order=order, pause=pause, hot_rows=hot_rows)
    word = F.struct(
        "start", "end", "text", F.exp("logprob").alias("probability")
    )
    return (
        grouped.groupBy(*keys, "group")
        .agg(
            F.min_by("start", F.when(is_word, F.col(order))).alias("start"),
            F.max_by("end", F.when(is_word, F.col(order))).alias("end"),
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
            .alias("_texts"),
            F.avg(F.when(is_word, F.col("logprob"))).alias("avg_logprob"),
            F.array_sort(F.collect_list(F.when(is_word, F.struct(F.col(order).alias("o"), word.alias("w")))))
            .alias("_words"),
        )
        .withColumn("text", strip(F.array_join(F.transform("_texts", lambda t: t["t"]), "")))
        .withColumn("words", F.transform("_words", lambda x: x["w"]))
        .drop("_texts", "_words")
    )
