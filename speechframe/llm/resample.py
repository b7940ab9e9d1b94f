"""Target-distribution importance resampling over hashed n-grams.

Every text becomes a bag of n-gram buckets. The ratio of a bucket's share among target texts to its share
among all documents is its gain, the sum of gains is a document's log weight, and a Gumbel draw over the
weights picks documents without replacement as if by importance.

A task works on Arrow arrays: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode`` turn a batch into indices of its different words; an n-gram is a pair of the code of
its first words and the index of its last, so that a checksum is computed once for each different pair of a
batch. Buckets are counted by task and summed in Spark; gains are taken by bucket and reduced by document.

Words are runs of digits, ``a``-``z`` (after A-Z were lower-cased) and everything beyond ASCII.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe.llm.common import number_rows, tidy

#: What lies between words, in lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Texts of about so many bytes are worked on at a time, a longer one alone.
PART_BYTES = 4 << 20


class Grams:
    """Buckets of all n-grams of some texts, in order; ``counts`` has their number for each text."""

    def __init__(self, texts: pa.Array, width: int, buckets: int):
        lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
        owners = pc.list_parent_indices(lists)
        flat = pc.list_flatten(lists)
        filled = pc.greater(pc.binary_length(flat), 0)
        owner = owners.filter(filled).to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = flat.filter(filled).dictionary_encode()
        index = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.cast(encoded.dictionary, pa.binary()).to_pylist()
        self.words = np.bincount(owner, minlength=len(texts))
        sums = np.array([zlib.crc32(w) for w in words], dtype=np.int64)
        code, found, owned = index, [sums[index] % buckets], [owner]
        for n in range(2, width + 1):
            inside = owner[: 1 - n] == owner[n - 1 :]
            last, owned_here = index[n - 1 :][inside], owner[n - 1 :][inside]
            pairs, code_inside = np.unique(
                code[:-1][inside] * np.int64(len(words) or 1) + last, return_inverse=True
            )
            longer = [
                zlib.crc32(b" " + words[p % len(words)], int(sums[p // len(words)]))
                for p in pairs.tolist()
            ]
            sums = np.array(longer, dtype=np.int64)
            # Places that run over the end of a text keep a code nothing reads: theirs are masked again.
            code = np.zeros(len(inside), dtype=np.int64)
            code[inside] = code_inside
            found.append(sums[code_inside] % buckets)
            owned.append(owned_here)
        self.buckets, self.owners = np.concatenate(found), np.concatenate(owned)
        self.counts = np.bincount(self.owners, minlength=len(texts))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of its n-grams' values."""
        taken = values[self.buckets]
        order = np.argsort(self.owners, kind="stable")
        ends = np.cumsum(self.counts)
        running = np.concatenate([[0], np.cumsum(taken[order])])
        return running[ends] - running[ends - self.counts]


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about PART_BYTES together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + PART_BYTES, side="right")))
        yield start, end
        start = end


def bucket_counts(texts: DataFrame, text: str = "text", *, width: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how often n-grams of up to ``width`` words fall into each bucket, over all rows.

    NULL is a text without words. A task sums its own rows, so what is shuffled is at most ``buckets`` rows
    of each task, however often a word occurs. Buckets nothing falls into have no row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for start, end in _parts(batch.column(0)):
                grams = Grams(batch.column(0).slice(start, end - start), width, buckets)
                total += np.bincount(grams.buckets, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    rows = texts.select(F.col(text).alias("text")).mapInArrow(tidy(count), "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, *, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) for every bucket: thousandths of the natural log of the ratio of its smoothed share in
    ``target`` to that in ``source`` (both from ``bucket_counts``), rounded down."""
    spark = source.sparkSession
    both = (
        spark.range(buckets)
        .select(F.col("id").alias("bucket"))
        .join(source.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .fillna(0, ["s", "t"])
    )
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    # One row of two sums stands beside each of the buckets.
    return both.crossJoin(F.broadcast(sums)).select(
        "bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain")
    )


def weigh(
    docs: DataFrame, gains: DataFrame, text: str = "text", *, width: int = 1, buckets: int = 10_000
) -> DataFrame:
    """The rows with ``n_words``, ``n_features`` and ``weight`` in place of the text.

    ``gains`` has one row for each bucket: a parameter bounds it, not the data, so it travels with the tasks.
    Other columns are kept; any of the three names among them is replaced.
    """
    table = np.zeros(buckets, dtype=np.int64)
    for bucket, gain in gains.collect():
        table[bucket] = gain
    made = ("n_words", "n_features", "weight")
    kept = [c for c in docs.columns if c not in (text, *made)]
    fields = [docs.schema[c] for c in kept]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{m} long" for m in made]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            for start, end in _parts(texts):
                grams = Grams(texts.slice(start, end - start), width, buckets)
                arrays = [batch.column(i).slice(start, end - start) for i in range(len(kept))]
                arrays += [pa.array(x) for x in (grams.words, grams.counts, grams.sums(table))]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *made])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(tidy(task), schema)


def draw(weighed: DataFrame, *, seed: int, percent: int, least_words: int, id: str = "doc_id") -> DataFrame:
    """The rows of ``weigh`` with ``score`` and ``rank``.

    The score is the weight and a Gumbel number that the seed and the row's id decide, so a draw can be
    repeated on any layout. Of the rows with at least ``least_words`` words the given percentage with the
    highest scores is drawn and ranked from 1, ties by smaller id (then by the other columns); ``rank`` is
    NULL for all others. A NULL id has no Gumbel number: its score is NULL and it is drawn last.
    Ranks come from one distributed sort of the narrow rows.
    """
    name = F.concat(F.lit(f"{seed}:"), F.col(id).cast("string"))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + gumbel)
    eligible = F.col("n_words") >= least_words
    last = F.coalesce(-F.col("score"), F.lit((1 << 63) - 1))
    ordered, total = number_rows(
        scored.filter(eligible).withColumn("__last", last), ["__last", id], "__place"
    )
    drawn = percent * total // 100
    rank = F.when(F.col("__place") < drawn, F.col("__place") + 1)
    ranked = ordered.withColumn("rank", rank).drop("__last", "__place")
    return ranked.unionByName(scored.filter(~eligible).withColumn("rank", F.lit(None).cast("long")))
