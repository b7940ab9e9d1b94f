"""Text keys and normalisation as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters str.split() treats as white space.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Boilerplate that recognisers invent on silence, matched on the guard key.
BOILERPLATE = (
    "(?:thanks|thank you)(?: so much| very much)? for watching"
    "|(?:please )?(?:like and )?subscribe(?: to (?:my|our|the) channel)?"
    "|(?:subtitles|captions|transcribed|transcription|translated|translation) by .*"
)

# Filler words and spelled numbers.
FILLERS = ("hmm", "mm", "mhm", "mmm", "uh", "um")
UNITS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    "fifteen sixteen seventeen eighteen nineteen"
).split()
DECADES = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def spelled(n: int) -> str:
    """English words for 0..100."""
    if n < 20:
        return UNITS[n]
    if n == 100:
        return "one hundred"
    decade = DECADES[n // 10 - 2]
    return f"{decade} {UNITS[n % 10]}" if n % 10 else decade


SPELLED = {str(n): spelled(n) for n in range(101)}


_SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_TO_SQUEEZE = f"{SPACES}{{2,}}|{SPACES.replace('x20', 'x1f', 1)}"


def strip(text: Column) -> Column:
    """Trim the same white space as ``str.strip``."""
    return F.trim(text, F.lit(_SPACE_CHARS))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends. Single plain spaces, by far the
    most, are not touched."""
    return F.trim(F.regexp_replace(text, _TO_SQUEEZE, " "))


def tokens(text: Column) -> Column:
    """``str.split()``: an array without empty strings."""
    return F.filter(F.split(text, f"{SPACES}+"), lambda t: t != "")


def guard_key(text: Column) -> Column:
    """Lower case, punctuation and symbols dropped, white space squeezed, marks kept."""
    return squeeze(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}]", ""))


def is_boilerplate(key: Column) -> Column:
    """On a guard key: nothing but symbols, or a known stock phrase."""
    return (key == "") | key.rlike(f"^(?:{BOILERPLATE})$")


# Patterns of the words-only form.
_PLAIN = r"^[\t-\r\x1c-\x7e]*$"
_BRACKETED = r"\[[^\]]*\]|\([^)]*\)|<[^>]*>"


def wer_text(text: Column) -> Column:
    """Words-only form used for error rates.

    Plain ASCII stays in native expressions; only rows with other characters, which need Unicode
    decomposition, reach the Python function (it gets NULL for the rest).
    """
    plain = text.rlike(_PLAIN)
    return F.when(plain, _wer_ascii(text)).otherwise(_wer_unicode(F.when(~plain, text)))


def _wer_ascii(text: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(text), _BRACKETED, " ")
    cleaned = F.regexp_replace(cleaned, "'", "")
    cleaned = F.regexp_replace(cleaned, r"(?<=\d),(?=\d)", "")
    cleaned = F.regexp_replace(cleaned, r"[\p{P}\p{S}]", " ")
    numbers = F.create_map(*[F.lit(x) for pair in SPELLED.items() for x in pair])
    words = F.filter(tokens(cleaned), lambda t: ~t.isin(*FILLERS))
    spoken = F.transform(words, lambda t: F.coalesce(F.try_element_at(numbers, t), t))
    return F.array_join(spoken, " ")


# Small numbers standing alone.
_NUMBERS = re.compile(r"\b(?:100|[1-9]?[0-9])\b")
_FILLER_WORDS = re.compile(rf"\b(?:{'|'.join(FILLERS)})\b")
_APOSTROPHES = frozenset("'‘’ʼ")


class _Marks(dict):
    """Translation that drops combining marks and apostrophes; learns each character once."""

    def __missing__(self, code: int):
        char = chr(code)
        gone = char in _APOSTROPHES or unicodedata.combining(char)
        self[code] = None if gone else char
        return self[code]


class _Signs(dict):
    """Translation of punctuation and symbols to spaces."""

    def __missing__(self, code: int):
        char = chr(code)
        self[code] = " " if unicodedata.category(char)[0] in "PS" else char
        return self[code]


_MARKS, _SIGNS = _Marks(), _Signs()


def _unicode_words(text: str) -> str:
    folded = unicodedata.normalize("NFKD", re.sub(_BRACKETED, " ", text.lower()))
    folded = re.sub(r"(?<=\d),(?=\d)", "", folded.translate(_MARKS)).translate(_SIGNS)
    folded = _NUMBERS.sub(lambda m: SPELLED[str(int(m[0]))], folded)
    return " ".join(_FILLER_WORDS.sub(" ", folded).split())


@F.pandas_udf(T.StringType())
def _wer_unicode(texts: pd.Series) -> pd.Series:
    return texts.map(_unicode_words, na_action="ignore")
