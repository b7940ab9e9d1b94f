"""Sample positions, seconds and caption time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechframe.schema import SAMPLE_RATE


def seconds(samples: Column) -> Column:
    """Samples to seconds; positions stay integers until here."""
    return samples / F.lit(float(SAMPLE_RATE))


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970, the same for TIMESTAMP (in UTC) and TIMESTAMP_NTZ."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", zero, ts.cast("timestamp_ntz"))


def clamp(t: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(t, low), high)


def cue_start_ms(start: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.rint(start * 1000).cast("bigint"))


def cue_end_ms(end: Column, start_ms: Column) -> Column:
    """A cue lasts at least one millisecond."""
    return F.greatest(F.rint(end * 1000).cast("bigint"), start_ms + 1)


def time_stamp(ms: Column, separator: str) -> Column:
    """``HH:MM:SS<separator>mmm`` with unbounded hours."""
    return F.format_string(
        f"%02d:%02d:%02d{separator}%03d",
        F.floor(ms / 3_600_000),
        F.floor(ms / 60_000) % 60,
        F.floor(ms / 1000) % 60,
        ms % 1000,
    )


def speaker_label(channel: Column) -> Column:
    """``[Speaker N] `` for text and SubRip, empty without a channel."""
    return F.when(channel.isNull(), "").otherwise(F.format_string("[Speaker %d] ", channel + 1))


def voice_tag(channel: Column) -> Column:
    return F.when(channel.isNull(), "").otherwise(F.format_string("<v Speaker %d>", channel + 1))


def markup_escape(text: Column) -> Column:
    amp = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
