"""The newest messages at any number, and segments longer than a task should hold."""

import random

import pytest
from pyspark.sql import functions as F

from speechframe.operators import jobs, words


@pytest.mark.parametrize("keep", [0, 1, 50, 299, 1000])
def test_newest_messages(spark, keep, monkeypatch):
    monkeypatch.setattr(jobs, "INTERVALS", 64)
    rng = random.Random(keep)
    ids = [rng.choice([-(1 << 63), (1 << 63) - 1, *range(-20, 20), rng.randrange(1 << 60)]) for _ in range(295)]
    rows = [(i, f"t{n}") for n, i in enumerate(ids)] + [(None, "x")] * 5
    table = spark.createDataFrame(rows, "id long, text string").repartition(5)
    kept = jobs.newest_messages(table, keep)
    got = sorted((r.id is not None, r.id or 0) for r in kept.collect())
    want = sorted(((i is not None, i or 0) for i, _ in rows), reverse=True)[:keep]
    # Messages without an id are as old as the oldest id there can be.
    assert kept.columns == ["id", "text"] and len(got) == len(want)
    floor = (True, -(1 << 63))
    assert [max(x, floor) for x in got] == sorted(max(x, floor) for x in want)
    assert sorted(map(tuple, jobs.newest_messages(table.repartition(3), keep).collect()), key=repr) == sorted(map(tuple, kept.collect()), key=repr)


def test_no_sort_and_no_single_task(spark):
    table = spark.range(1000).withColumn("n", F.col("id") % 2)
    plan = jobs.newest_messages(table, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "TakeOrdered" not in plan


def test_long_segments_stay_spread(spark):
    """One user without a pause has a third of all words: summed up in slices, their text in bounded parts."""
    rows = [("hot", i, f"w{i} ", i * 0.1, i * 0.1 + 0.05, "word", -0.5) for i in range(900)]
    rows += [(f"u{i % 60}", i, "a. ", i * 1.0, i + 0.5, "word", None) for i in range(1800)]
    table = spark.createDataFrame(rows, "u string, ord long, text string, start double, end double, type string, logprob double")
    grouped = words.grouped_words(table.repartition(4), ["u"], hot_rows=100)
    spans = {(r.u, r.group): r for r in words.segment_spans(grouped, ["u"]).collect()}
    hot = spans["hot", 1]
    assert (hot.start, hot.words, hot.avg_logprob) == (0.0, 900, -0.5) and hot.end == pytest.approx(89.95)
    assert hot.least_probability == pytest.approx(0.60653066)
    assert len(spans) == 1801 and all(s.words == 1 for (u, _), s in spans.items() if u != "hot")
    parts = words.segment_texts(grouped, ["u"], part_rows=128).where("u = 'hot'").orderBy("part").collect()
    assert [r.part for r in parts] == list(range(8)) and "".join(r.text for r in parts) == "".join(f"w{i} " for i in range(900))
    whole = words.group_words(table, ["u"]).where("u = 'hot'").first()
    assert whole.text == "".join(r.text for r in parts).strip()
    # The rows of the hot user come out of several tasks.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        again = words.grouped_words(table.repartition(4), ["u"], hot_rows=100).where("u = 'hot'")
        tasks = again.select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1
