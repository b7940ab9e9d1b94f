"""Word alignment: edit totals in native expressions, operations in one vectorised function."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least number of table rows that are held at once.
BLOCK_ROWS = 256
#: Columns of the first band at each side of the diagonal.
FIRST_BAND = 64
#: Edits of entries that no path reaches.
_FAR = 1 << 29
_FIRST_CODE = 0x4E00
_VOCABULARY = 20_000

OPERATION = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("ref_idx", T.IntegerType()),
        T.StructField("hyp_idx", T.IntegerType()),
    ]
)


def char_errors(reference: Column, hypothesis: Column) -> Column:
    """Character edits; an empty reference has none."""
    return F.when(reference == "", 0).otherwise(F.levenshtein(reference, hypothesis)).cast("bigint")


def word_errors(ref: Column, hyp: Column) -> Column:
    """Word edits of two token arrays without Python.

    Each pair's vocabulary becomes one character per distinct word, so the built-in character
    distance counts words. Pairs with more distinct words than fit take the alignment instead.
    """
    words = F.array_distinct(F.concat(ref, hyp))
    ids = F.map_from_arrays(words, F.sequence(F.lit(1), F.size(words)))

    def coded(tokens: Column) -> Column:
        pairs = F.transform(
            tokens, lambda t: F.lpad(F.hex(F.element_at(ids, t) + _FIRST_CODE - 1), 4, "0")
        )
        return F.decode(F.unhex(F.array_join(pairs, "")), "UTF-16BE")

    small = F.size(words) <= _VOCABULARY
    empty = (F.size(ref) == 0) | (F.size(hyp) == 0)
    aligned = alignment(F.when(~small, ref), F.when(~small, hyp))
    return (
        F.when(empty, F.greatest(F.size(ref), F.size(hyp)))
        .when(small, F.levenshtein(coded(ref), coded(hyp)))
        .otherwise(F.size(F.filter(aligned, lambda o: o["op"] != "equal")))
        .cast("bigint")
    )


def _next_row(row, word, ahead, columns):
    """The next row of a band: entry ``c`` lies ``c`` columns after the band's left edge, which moves
    one column with every row, so the entry diagonally before is at ``c`` in ``row``, the one above at
    ``c + 1``. ``ahead`` are the words under the band."""
    best = row + (ahead != word)
    np.minimum(best[:-1], row[1:] + 1, out=best[:-1])
    return np.minimum.accumulate(best - columns) + columns


class _Band:
    """The table of edits within ``half`` columns of its diagonal. A path of at most ``half`` edits
    never leaves it, so a distance up to ``half`` is exact, and with it every step back from it."""

    def __init__(self, ref: np.ndarray, hyp: np.ndarray, half: int):
        n, m = len(ref), len(hyp)
        self.ref, self.half = ref, half
        self.columns = np.arange(2 * half + 1, dtype=np.int32)
        # Before and behind the words stands one that equals none.
        self.words = np.full(max(n + 2 * half, half + m), -1, dtype=np.int64)
        self.words[half : half + m] = hyp
        self.first = np.where(self.columns < half, _FAR, self.columns - half).astype(np.int32)

    def after(self, row: np.ndarray, i: int) -> np.ndarray:
        """Row ``i`` from row ``i - 1``."""
        ahead = self.words[i - 1 : i + 2 * self.half]
        return _next_row(row, self.ref[i - 1], ahead, self.columns)


def _operations(ref: np.ndarray, hyp: np.ndarray) -> list[tuple[str, int, int]]:
    """``(op, ref index, hyp index)`` from the end of both to the start.

    The band around the diagonal is widened until it holds the distance, so the work grows with the
    length times the number of edits; it begins at the words that one side has more of than the
    other, the least the distance can be. Of its rows only every so many are kept; those between two
    of them are computed again when the way back comes through. The way taken is that of the whole
    table at any length."""
    n, m = len(ref), len(hyp)
    every = max(BLOCK_ROWS, isqrt(n))
    kinds = max(ref.max(initial=0), hyp.max(initial=0)) + 1
    shared = np.minimum(np.bincount(ref, minlength=kinds), np.bincount(hyp, minlength=kinds)).sum()
    longest = max(n, m)
    half = min(max(FIRST_BAND, longest - int(shared)), longest)
    while True:
        band = _Band(ref, hyp, half)
        kept, table = [band.first], [band.first]
        for i in range(1, n + 1):
            if len(table) > every:
                kept.append(table[-1])
                table = table[-1:]
            table.append(band.after(table[-1], i))
        bound = int(table[-1][m - n + half])
        if bound <= half:
            break
        half = min(4 * half, bound)
    i, j, found = n, m, []
    while kept:
        start = (len(kept) - 1) * every
        first = kept.pop()
        if table is None:
            table = [first]
            for k in range(start, i):
                table.append(band.after(table[-1], k + 1))
        while i > start or (start == 0 and j):
            column = j - i + half
            here = table[i - start][column]
            above = table[i - start - 1] if i else None
            diagonal = above[column] if i and j else None
            if i and j and ref[i - 1] == hyp[j - 1] and here == diagonal:
                i, j = i - 1, j - 1
                found.append(("equal", i, j))
            elif i and j and here == diagonal + 1:
                i, j = i - 1, j - 1
                found.append(("substitute", i, j))
            elif i and column < 2 * half and here == above[column + 1] + 1:
                i -= 1
                found.append(("delete", i, j))
            else:
                j -= 1
                found.append(("insert", i, j))
        table = None
    return found


def align_words(ref, hyp) -> list[tuple[str, int, int]]:
    ids: dict[str, int] = {}
    codes = [
        np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
        for words in (ref, hyp)
    ]
    return _operations(*codes)[::-1]


@F.pandas_udf(T.ArrayType(OPERATION))
def alignment(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Operations of a minimal word alignment of two token arrays, in order.

    Of equally short alignments a match or substitution is preferred to a deletion, and that to
    an insertion, reading from the end."""
    names = OPERATION.names
    return pd.Series(
        [
            None if r is None or h is None else [dict(zip(names, op)) for op in align_words(r, h)]
            for r, h in zip(ref, hyp)
        ]
    )
