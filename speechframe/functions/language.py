"""Language codes in the spelling the recogniser expects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechframe.functions.text import strip

# Three-letter and legacy codes -> canonical code.
CANONICAL = {
    "afr": "af", "amh": "am", "ara": "ar", "asm": "as", "aze": "az", "bak": "ba", "bel": "be",
    "ben": "bn", "bod": "bo", "tib": "bo", "bos": "bs", "bre": "br", "bul": "bg", "cat": "ca",
    "ces": "cs", "cze": "cs", "chi": "zh", "cmn": "zh", "zho": "zh", "cym": "cy", "wel": "cy",
    "dan": "da", "deu": "de", "ger": "de", "ell": "el", "gre": "el", "eng": "en", "est": "et",
    "eus": "eu", "baq": "eu", "fao": "fo", "fas": "fa", "per": "fa", "fin": "fi", "fra": "fr",
    "fre": "fr", "glg": "gl", "guj": "gu", "hat": "ht", "hau": "ha", "heb": "he", "hin": "hi",
    "hrv": "hr", "hun": "hu", "hye": "hy", "arm": "hy", "ind": "id", "isl": "is", "ice": "is",
    "ita": "it", "jav": "jw", "jpn": "ja", "kan": "kn", "kat": "ka", "geo": "ka", "kaz": "kk",
    "khm": "km", "kor": "ko", "lao": "lo", "lat": "la", "lav": "lv", "lin": "ln", "lit": "lt",
    "ltz": "lb", "mal": "ml", "mar": "mr", "mkd": "mk", "mac": "mk", "mlg": "mg", "mlt": "mt",
    "mon": "mn", "mri": "mi", "mao": "mi", "msa": "ms", "may": "ms", "mya": "my", "bur": "my",
    "nep": "ne", "nld": "nl", "dut": "nl", "nno": "nn", "nob": "no", "nor": "no", "oci": "oc",
    "pan": "pa", "pol": "pl", "por": "pt", "pus": "ps", "ron": "ro", "rum": "ro", "rus": "ru",
    "san": "sa", "sin": "si", "slk": "sk", "slo": "sk", "slv": "sl", "sna": "sn", "snd": "sd",
    "som": "so", "spa": "es", "sqi": "sq", "alb": "sq", "srp": "sr", "sun": "su", "swa": "sw",
    "swh": "sw", "swe": "sv", "tam": "ta", "tat": "tt", "tel": "te", "tgk": "tg", "tgl": "tl",
    "fil": "tl", "tha": "th", "tuk": "tk", "tur": "tr", "ukr": "uk", "urd": "ur", "uzb": "uz",
    "vie": "vi", "yid": "yi", "yor": "yo", "jv": "jw", "iw": "he", "nb": "no",
}


def normalise_language(code: Column) -> Column:
    """Primary subtag, lower case, aliases mapped; unknown codes pass; blank is NULL."""
    subtag = F.split(F.replace(F.lower(strip(code)), F.lit("_"), F.lit("-")), "-")[0]
    primary = F.nullif(subtag, F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    return F.coalesce(F.try_element_at(table, primary), primary)
