"""Recordings that lie one behind the other in objects."""

import hashlib
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechframe.operators import audio, onepass
from speechframe.sources import readers, sinks

RATE = 16_000


def wav(pcm: bytes) -> bytes:
    return struct.pack(
        "<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(pcm)
    ) + pcm


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    """(sounds, listing): 60 recordings of 0 to 5,000 bytes, in objects of 20,000 bytes or little more."""
    draw = np.random.default_rng(5)
    sounds = {f"r{i}": draw.integers(0, 256, 0 if i % 20 == 0 else int(draw.integers(1, 5000)), dtype=np.uint8).tobytes()
              for i in range(60)}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in sounds.items()], "recording_id string, pcm binary")
    folder = str(tmp_path_factory.mktemp("packs"))
    return sounds, sinks.write_wav(rows.coalesce(2), folder, rate=RATE, pack_bytes=20_000), folder


def test_objects_follow_bytes_not_recordings(packed):
    sounds, listing, folder = packed
    rows = listing.collect()
    assert {r.recording_id for r in rows} == set(sounds) and len(rows) == 60
    used = {r.path.rsplit("/", 1)[1] for r in rows}
    total = sum(len(v) + 44 for v in sounds.values())
    # Full ones, and the last one of each of two tasks.
    assert len(used) <= total // 20_000 + 2
    sizes = [os.path.getsize(f"{folder}/{name}") for name in used]
    assert sum(sizes) == total and max(sizes) < 20_000 + 5_044


def test_parts_are_read_as_objects_of_their_own(spark, packed):
    sounds, listing, _ = packed
    found = {r.recording_id: (r.length, r.sha256) for r in readers.object_digests(listing, piece_bytes=700).collect()}
    assert found == {k: (44 + len(v), hashlib.sha256(wav(v)).hexdigest()) for k, v in sounds.items()}
    layouts = audio.pcm_layouts(listing).cache()
    bad = {r.recording_id for r in layouts.where("error_code = 'undecodable_audio'").collect()}
    assert bad == {k for k, v in sounds.items() if not v}
    blocks = audio.decode_blocks(layouts, block_samples=640)
    decoded = {}
    for r in blocks.orderBy("recording_id", "start_sample").collect():
        decoded.setdefault(r.recording_id, []).extend(r.samples)
    assert decoded == {
        k: ((np.frombuffer(v, np.uint8).astype(int) - 128) * 256).tolist() for k, v in sounds.items() if v
    }
    sums = F.sum(F.aggregate("samples", F.lit(0).cast("bigint"), lambda t, x: t + x)).alias("total")
    lengths = {r.recording_id: (r.audio_samples, r.total) for r in audio.durations(blocks, sums).collect()}
    assert lengths == {k: (len(v), sum(v)) for k, v in decoded.items()}
    spans = layouts.where("error_code IS NULL").select(
        "recording_id", F.lit(None).cast("int").alias("channel"), F.lit(0).cast("bigint").alias("start"),
        F.least("frames", F.lit(100)).alias("end"),
    )
    energy = {r.recording_id: r.energy for r in onepass.span_energy(spans, layouts, ["recording_id"]).collect()}
    assert energy == {k: sum(x * x for x in v[:100]) for k, v in decoded.items()}


def test_reading_is_spread_however_narrow_its_rows(spark, packed):
    _, listing, _ = packed
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    layouts = audio.pcm_layouts(listing)
    for rows in (readers.object_digests(listing), layouts, audio.decode_blocks(layouts),
                 onepass.scan_blocks(layouts, cell=160, block_samples=640, frame=320)):
        assert rows.rdd.getNumPartitions() == parts


def test_parts_that_cannot_be_read(spark, packed):
    _, listing, folder = packed
    gone = listing.limit(1).withColumn("path", F.lit(f"{folder}/gone.pack"))
    row = readers.object_digests(gone).collect()[0]
    assert row.length is None and row.sha256 is None
    assert audio.pcm_layouts(gone).collect()[0].error_code == "undecodable_audio"
