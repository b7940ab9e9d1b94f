"""Language of a text by compression: the language whose text helps zstandard most."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Texts are compressed in chunks of so many bytes, each with the dictionary alone in view, so
#: that a long text can't become its own dictionary.
CHUNK_BYTES = 2048
#: Bounds of the sample the dictionaries are made of.
DICTIONARY_DOCS = 800
DICTIONARY_BYTES = 400 * 1024
#: Lead of the best language over the next one, as a share of the size, below which it is narrow.
MARGIN = 0.02
LEVEL = 9
_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower case, with one space for whatever lies between letters: signs and capitals say nothing
    about the language, but would fill dictionaries."""
    return _OTHER.sub(" ", text.lower())


def dictionaries(
    docs: DataFrame,
    learn: Column,
    *,
    max_docs: int = DICTIONARY_DOCS,
    max_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """Raw dictionary content for each language of the rows (doc_id, text, lang) that ``learn``
    marks: the texts of ``max_docs`` documents for each language at most, chosen by a hash of
    the text, ``max_bytes`` in all. A text longer than a fortieth of the dictionary gives an excerpt of
    that size, at a place by its hash. A bounded sample, chosen over all rows of any length (predictions
    read whole texts); rows without text or language teach nothing; a text counts once."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    keyed = rows.select("lang", F.xxhash64("text").alias("h"))
    # The least hash of each of max_docs classes: minima combine before the shuffle, and a language
    # with most of the rows spreads over its classes.
    picked = keyed.groupBy("lang", F.pmod("h", F.lit(max_docs)).alias("r"))
    picked = picked.agg(F.min("h").alias("h"))
    # As many characters as a fortieth of the dictionary holds, at the text's mean bytes a character.
    size = F.length("text").cast("bigint")
    share = F.greatest(F.lit(1), F.call_function("div", size * (max_bytes // 40), F.octet_length("text")))
    place = F.pmod(F.xxhash64("text", F.lit(1)), size - share + 1) + 1
    excerpt = F.when(F.octet_length("text") <= max_bytes // 40, F.col("text")).otherwise(
        F.substring("text", place.cast("int"), share.cast("int"))
    )
    # At most max_docs rows for each language.
    chosen = rows.select("lang", F.xxhash64("text").alias("h"), excerpt.alias("text")).join(
        F.broadcast(picked), ["lang", "h"]
    )
    texts = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"), F.min("r").alias("r"))
    out: dict[str, bytes] = {}
    for row in texts.orderBy("lang", F.desc("r")).toLocalIterator():
        # What comes last is nearest to the text, and cheapest to refer to.
        out[row["lang"]] = (out.get(row["lang"], b"") + plain(row["text"]).encode() + b"\n")[-max_bytes:]
    return out


class Classifier:
    def __init__(self, contents: dict[str, bytes], level: int = LEVEL):
        self.languages = sorted(contents)
        self.compressors = []
        for language in self.languages:
            data = zstandard.ZstdCompressionDict(
                contents[language], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            data.precompute_compress(level=level)
            self.compressors.append(
                zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False)
            )

    def sizes(self, text: str) -> list[int]:
        data = plain(text).encode()
        parts = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the lead of its size over the next larger one, 0 to 1."""
        if not text or not self.languages or not any(ch.isalpha() for ch in text):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        if len(sizes) == 1:
            return self.languages[0], 1.0
        ranked = sorted(zip(sizes, self.languages))
        (best, language), (second, _) = ranked[:2]
        return language, (second - best) / second


def identify(docs: DataFrame, contents: dict[str, bytes], *, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, narrow) for every row of ``docs`` (doc_id, text).

    The whole text is compressed with every language's dictionary. NULL, empty or letterless texts,
    and all texts if nothing was learned, are ``und`` with score 0. Of equal sizes the first
    language in alphabetical order wins, with score 0. ``narrow`` rejects the decision: the lead is
    below ``margin`` (always for ``und``). Only doc_id and text are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(contents)
        for batch in batches:
            found = [classifier.predict(text) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "lang_pred": [x[0] for x in found],
                    "score": [float(x[1]) for x in found],
                    "narrow": [x[1] < margin for x in found],
                }
            )

    schema = "doc_id long, lang_pred string, score double, narrow boolean"
    return docs.select("doc_id", "text").mapInPandas(run, schema)
