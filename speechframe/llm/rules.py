"""Quality rules: counts of words and lines, then bands of compression ratios."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.llm.common import let_go

LEVEL = 3
#: Least (compressed size / size) by the text's UTF-8 bytes, up to the first number; repeated phrases
#: lie below. Texts below 256 bytes have none: the base rules tell their repetitions.
LOW = ((256, 0.0), (1024, 0.25), (4096, 0.22), (16384, 0.20), (float("inf"), 0.18))
#: Largest ratio of a text or chunk of so many characters, in between by the logarithm, level outside. Prose lies
#: below (the given tables reach 0.82, 0.72, 0.60, 0.53 and 0.48 in chunks of 256 to 4096 bytes), base64
#: above (0.91, 0.83, 0.78, 0.75 and 0.74 at least). Characters, as a byte of a script with two or three bytes to
#: a character tells less: 256 bytes of Korean prose reach 0.86 and of Chinese 0.90, in about 100 characters.
HIGH = ((64, 1.0), (128, 0.92), (256, 0.855), (512, 0.78), (1024, 0.70), (2048, 0.66), (4096, 0.63), (16384, 0.60))
#: Chunks cover every byte, the last one being the end of the text. Texts below LONG_BYTES have
#: small chunks, so that they have several too. A text is rejected if more than the given share of
#: its bytes is in repetitive or incompressible chunks.
LONG_BYTES = 4096
CHUNK_BYTES = 1024
SMALL_CHUNK_BYTES = 256
CHUNK_LOW = 0.15
CHUNK_SHARE = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_chunks long, chunks long, reason string"
)
_SIZES = np.log2([size for size, _ in HIGH])
_RATIOS = [ratio for _, ratio in HIGH]
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    first: dict[tuple, int] = {}
    marked = bytearray(n)
    three = b"\1\1\1"
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        seen = first.setdefault(window, i)
        if seen != i:
            marked[i : i + 3] = three
            marked[seen : seen + 3] = three
    return sum(marked)


def highest(characters: int) -> float:
    """The largest ratio that a text or chunk of so many characters may have."""
    return float(np.interp(np.log2(max(characters, 1)), _SIZES, _RATIOS))


def characters(data: bytes) -> int:
    """Characters that begin in some UTF-8 bytes."""
    return len(data) if data.isascii() else int(np.count_nonzero(np.frombuffer(data, np.int8) >= -64))


def judge(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple:
    """The row of :data:`SCHEMA` for one text."""
    text = text or ""
    data = text.encode()
    words = data.split()  # ASCII white space: \x20 and \x09 to \x0D
    n_words = len(words)
    word_chars = len(b"".join(words).decode())
    lines = [line for line in data.split(b"\n") if line.split()]
    repeat = repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n_words
    size = len(data)
    ratio = len(compressor.compress(data)) / size if size else None
    width = min(CHUNK_BYTES if size >= LONG_BYTES else SMALL_CHUNK_BYTES, size)
    chunks = bad = bad_bytes = 0
    plain = len(text) == size
    high = highest(width) if plain else None
    for start in range(0, size, width or 1):
        # The last chunk reaches back over bytes that count for the one before it.
        begin = min(start, size - width)
        chunk = data[begin : begin + width]
        share = len(compressor.compress(chunk)) / width
        chunks += 1
        if not CHUNK_LOW <= share <= (high if plain else highest(characters(chunk))):
            bad += 1
            bad_bytes += min(width, size - start)
    reason = "base" if failed else None
    if size and not failed:
        if ratio < next(low for limit, low in LOW if size < limit):
            reason = "repetitive"
        elif ratio > highest(len(text)):
            reason = "incompressible"
        elif bad_bytes > CHUNK_SHARE * size:
            reason = "chunks"
    symbols = len(_SYMBOLS.findall(text))
    counts = (n_words, word_chars, symbols, len(lines) - len(set(lines)), repeat)
    return (*counts, failed, reason is None, ratio, bad, chunks, reason)


def verdict(text: Column | str) -> Column:
    """A struct of counts, ratios and ``kept`` for a column of texts, whole texts each.

    Words are runs without ASCII white space. NULL and empty texts have no words, no ratio and
    aren't kept. ``reason`` names what rejects a text, NULL if nothing does.
    """

    @F.pandas_udf(SCHEMA)
    def judged(texts: pd.Series) -> pd.DataFrame:
        let_go()
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        return pd.DataFrame([judge(t, compressor) for t in texts], columns=names)

    return judged(text)


def apply_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, ...) of every row: the columns of :data:`SCHEMA`. Only doc_id and text are read."""
    return docs.select("doc_id", verdict("text").alias("v")).select("doc_id", "v.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows whose text is kept, all columns as they are."""
    return docs.filter(verdict(docs["text"])["kept"])
