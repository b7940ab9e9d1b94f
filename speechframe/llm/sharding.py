"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Built-in DataFrame operations only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframe.llm.common import number_rows

ROUNDS = 6
#: Modulus of the round function. Halves and keys are below it, so squares fit into 63 bits.
PRIME = (1 << 31) - 1


def round_keys(seed: int) -> list[int]:
    digest = hashlib.sha512(str(seed).encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") % PRIME for i in range(2 * ROUNDS)]


def halves(rows: int) -> tuple[int, int]:
    """Two radices whose product covers the row numbers with less than one radix to spare."""
    high = isqrt(max(rows - 1, 0)) + 1
    return high, max(1, -(-rows // high))


def _round(value: Column, keys: Column, number: Column) -> Column:
    """Two squarings in a prime field, each behind a key."""
    once = (value + F.element_at(keys, number * 2 + 1)) % PRIME
    twice = (once * once + F.element_at(keys, number * 2 + 2)) % PRIME
    return twice * twice % PRIME


def permute_once(number: Column, rows: int, seed: int) -> Column:
    """One pass of the Feistel network over [0, high * low)."""
    high, low = halves(rows)
    keys = F.array(*[F.lit(k).cast("bigint") for k in round_keys(seed)])

    def step(state: Column, i: Column) -> Column:
        left, right = state["left"], state["right"]
        even = i % 2 == 0
        return F.struct(
            F.when(even, (left + _round(right, keys, i)) % high).otherwise(left).alias("left"),
            F.when(even, right).otherwise((right + _round(left, keys, i)) % low).alias("right"),
        )

    start = F.struct(
        _div(number, low).alias("left"),
        (number % low).alias("right"),
    )
    end = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(end, start, step, lambda s: s["left"] * low + s["right"])


def _div(number: Column, by: int) -> Column:
    """Integer division; exact above 2^53, unlike a division of doubles."""
    return F.call_function("div", number, F.lit(by).cast("bigint"))


def walk_length(spark: SparkSession, rows: int, seed: int) -> int:
    """How often the network has to be applied at most until every number lands below ``rows``:
    the longest chain inside the few numbers from ``rows`` up, followed in Spark. Chains begin at the
    numbers that no other of these leads to; a cycle among these has no beginning, and no number
    below ``rows`` ever reaches it."""
    high, low = halves(rows)
    if high * low <= rows:
        return 1

    def follow(numbers: DataFrame) -> DataFrame:
        found = numbers.select(permute_once(F.col("id"), rows, seed).alias("id"))
        return found.filter(F.col("id") >= rows)

    outside = spark.range(rows, high * low).select("id")
    outside = outside.join(follow(outside), "id", "left_anti")
    steps = 1
    while not outside.isEmpty():
        outside = follow(outside)
        steps += 1
    return steps


def permute(number: Column, rows: int, seed: int, steps: int) -> Column:
    """The permutation of [0, rows): the network, walked on while it lands outside."""
    again = F.sequence(F.lit(1), F.lit(steps))
    # The first pass always applies; a later one only to numbers still outside.
    return F.aggregate(
        again,
        number,
        lambda y, i: F.when((i == 1) | (y >= rows), permute_once(y, rows, seed)).otherwise(y),
    )


def shard_rows(
    df: DataFrame, shards: int, *, order: Sequence[str] | None = None, seed: int = 0
) -> DataFrame:
    """``df`` with row_number, shard (0 .. shards-1) and slot (0 .. in its shard).

    Row numbers follow ``order`` (all columns by default), so that layout and partition count of
    the input don't matter. A keyed Feistel network with cycle walking permutes them; number p
    goes to shard ``p % shards``, slot ``p / shards``: shard sizes differ by one row at most, slots
    have no gaps, and a place is computable from the row number alone (:func:`locate`). NULL keys
    sort first; equal rows get neighbouring numbers in any order; an empty table stays empty.
    Only the columns given are moved, so large ones are better left out and joined by key.
    """
    for name in ("row_number", "shard", "slot"):
        if name in df.columns:
            raise ValueError(f"rename or drop the column {name}")
    if shards < 1:
        raise ValueError("shards must be positive")
    numbered, rows = number_rows(df, list(order or df.columns), "row_number")
    steps = walk_length(df.sparkSession, rows, seed) if rows else 1
    place = "__place"
    placed = numbered.withColumn(place, permute(F.col("row_number"), max(rows, 1), seed, steps))
    return placed.select(
        *numbered.columns,
        (F.col(place) % shards).cast("int").alias("shard"),
        _div(F.col(place), shards).alias("slot"),
    )


def locate(number: int, rows: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one row number, without Spark."""
    high, low = halves(rows)
    keys = round_keys(seed)
    y = number
    while True:
        left, right = divmod(y, low)
        for i in range(ROUNDS):
            value = right if i % 2 == 0 else left
            mixed = (((value + keys[2 * i]) % PRIME) ** 2 + keys[2 * i + 1]) % PRIME
            mixed = mixed * mixed % PRIME
            if i % 2 == 0:
                left = (left + mixed) % high
            else:
                right = (right + mixed) % low
        y = left * low + right
        if y < rows:
            return y % shards, y // shards
