"""Tables of recordings in hash buckets: written by batch, read for the recordings of a batch only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256


class RecordingStore:
    """Parquet tables under one folder, partitioned by (bucket, epoch); a recording's rows are in the bucket of
    its ``recording_id``. Every row has the ``etag`` of the object it was made from, so rows of a replaced
    object stay apart from those of the new one.

    ``put`` replaces what the same epoch has written in these buckets before, so a repeated batch leaves the same
    rows; ``add`` only adds, for rows that are wanted even if their batch fails later, and readers keep the last of
    each key. ``get`` reads the buckets it is asked for: partitions of others aren't listed as input.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schemas = {name: f"{columns}, bucket int, epoch bigint" for name, columns in tables.items()}
        for name, schema in self.schemas.items():
            # Makes the folder if it isn't there; an empty table is no file.
            empty = spark.createDataFrame([], schema)
            empty.write.mode("append").partitionBy("bucket", "epoch").parquet(f"{path}/{name}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("recording_id"), F.lit(self.buckets)).cast("int")

    def buckets_of(self, recordings: DataFrame) -> list[int]:
        """The buckets of some recordings: at most as many numbers as there are buckets."""
        return [r[0] for r in recordings.select(self.bucket()).distinct().collect()]

    def _write(self, name: str, rows: DataFrame, epoch: int, mode: str) -> None:
        columns = StructType.fromDDL(self.schemas[name]).names[:-2]
        placed = rows.select(*columns).withColumn("bucket", self.bucket()).withColumn("epoch", F.lit(epoch))
        (
            placed.repartition("bucket")
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "epoch")
            .parquet(f"{self.path}/{name}")
        )

    def put(self, name: str, rows: DataFrame, epoch: int) -> None:
        self._write(name, rows, epoch, "overwrite")

    def add(self, name: str, rows: DataFrame, epoch: int) -> None:
        self._write(name, rows, epoch, "append")

    def get(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")
        return rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))

    def latest(self, name: str, keys: Sequence[str], buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of :meth:`get` without ``bucket`` and ``epoch``, the last epoch's one of each key."""
        rows = self.get(name, buckets)
        columns = [c for c in rows.columns if c not in ("bucket", "epoch", *keys)]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "epoch").alias("_r"))
        return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])

    def compact(self, name: str, keys: Sequence[str], target: str) -> None:
        """Write the last row of each key to a store at ``target``, one file for a bucket."""
        rows = self.latest(name, keys)
        into = RecordingStore(self.spark, target, {name: self.schemas[name].rsplit(", bucket", 1)[0]}, self.buckets)
        into.put(name, rows, 0)

