"""Scans and folds: hot keys sliced across tasks give the plain result."""

import random

from pyspark.sql import functions as F

from speechframe.operators import breaker, chunks, outbox, ratelimit, regions
from speechframe.operators.ordered import (
    NEVER,
    Machine,
    apply_table,
    measure,
    prefix_scan,
    transition_table,
    with_slices,
)


def collect(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def skewed(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = [(("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}"), i * 7 + rng.randrange(5), rng.randrange(40)) for i in range(n)]
    rows += [(None, 10_000 + i, i) for i in range(40)]
    return spark.createDataFrame(rows, "k string, pos bigint, v int")


def test_measure_finds_only_hot_keys(spark):
    df = skewed(spark)
    assert measure(df, ["k"], "pos", 10_000).stats is None
    hot = measure(df, ["k"], "pos", 100)
    assert [r[0] for r in hot.stats.collect()] == ["hot"]
    assert measure(df, ["k"], "pos", hot) is hot
    assert measure(df, ["k"], "pos", None).stats is None


def test_prefix_scan_sliced_equals_plain(spark):
    df = skewed(spark).withColumn("m", F.when(F.col("v") % 3 == 0, F.col("v")))
    scans = {
        "s": ("sum", F.col("v"), True),
        "x": ("sum", F.col("v"), False),
        "c": ("count", F.col("m"), False),
        "mx": ("max", F.col("v"), False),
        "l": ("last", F.col("m"), False),
    }
    for reverse in (False, True):
        plain = prefix_scan(df, ["k"], ["pos"], scans, reverse=reverse, hot_rows=None)
        for hot_rows in (30, 100):
            cut = prefix_scan(df, ["k"], ["pos"], scans, reverse=reverse, hot_rows=hot_rows)
            assert cut.select("_slice").distinct().count() > 5
            cut = cut.select(*plain.columns)
            assert collect(cut, "k", "pos") == collect(plain, "k", "pos")


def test_slices_follow_the_rows_not_the_range(spark):
    rows = [("hot", i) for i in range(400)] + [("hot", 10**12), ("hot", -(10**12)), ("cold", 5)]
    df = spark.createDataFrame(rows, "k string, pos bigint")
    hot = measure(df, ["k"], "pos", 50)
    cut = with_slices(df, ["k"], "pos", hot)
    sizes = [r["count"] for r in cut.where("_hot").groupBy("_slice").count().collect()]
    assert max(sizes) <= 50 and sum(sizes) == 402
    ordered = [r._slice for r in cut.where("_hot").orderBy("pos").collect()]
    assert ordered == sorted(ordered)
    beyond = spark.createDataFrame([("hot", -(10**15)), ("hot", 10**15)], df.schema)
    ends = [r._slice for r in with_slices(beyond, ["k"], "pos", hot).orderBy("pos").collect()]
    assert ends[0] <= ordered[0] and ends[1] >= ordered[-1]


class Chain(Machine):
    def due(self, tag, row):
        return 0, row["pos"] + 50


def run(machine, state, rows, force=None):
    for row in rows:
        state = machine.next(state, row, row["pos"], bool(force and row[force])) or state
    return state


def test_transition_table_covers_every_start():
    rng = random.Random(5)
    for trial in range(60):
        pos = sorted(rng.sample(range(1000), 40))
        forced = trial % 2 == 0
        rows = [
            {"pos": p, "_us": p, "us": p, "_ok": rng.random() < 0.4, "f": forced and rng.random() < 0.05,
             "event": rng.choice(["claim", "claim", "result"]), "http_status": rng.choice([200, 503, 503, 503, 404] if trial % 3 else [503])}
            for p in pos
        ]
        for machine in (Chain(), breaker.Breaker(3, 60), breaker.Breaker(1, 60), outbox.Entry(70, 3)):
            force = "f" if isinstance(machine, Chain) else None
            table = [
                dict(zip(("tag", "upto", "exit_tag", "exit_wake"), t))
                for t in transition_table(machine, rows, "pos", force)
            ]
            starts = [(t, w) for t in range(machine.tags) for w in (NEVER, *range(0, 1100, 7)) if w == NEVER or t not in machine.sleepless]
            for start in starts:
                want = run(machine, start, rows, force)
                got = apply_table(table, start)
                # A wake that has passed is as good as none.
                assert got[0] == want[0] and (got[1] == want[1] or max(got[1], want[1]) <= pos[-1]), (start, got, want)


def requests(spark, n=700, seed=1, periodic=False):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += 7 if periodic else rng.randrange(1, 30)
        rows.append((f"r{i:05d}", t, "hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", "write", rng.randrange(1, 3), 5))
    df = spark.createDataFrame(rows, "request_id string, s bigint, api_key string, bucket string, cost int, `limit` bigint")
    return df.withColumn("ts", F.timestamp_seconds("s"))


def limiter(rows):
    state, out = {}, []
    for r in sorted(rows, key=lambda r: (r["s"], r["request_id"])):
        key = (r["api_key"], r["bucket"])
        opened, count = state.get(key, (None, 0))
        if opened is None or r["s"] >= opened + 60:
            opened, count = r["s"], 0
        count += r["cost"]
        state[key] = opened, count
        out.append((r["request_id"], count <= r["limit"], max(0, r["limit"] - count), max(1, opened + 60 - r["s"])))
    return sorted(out)


def test_rate_windows_sliced_and_plain(spark):
    for periodic in (False, True):
        df = requests(spark, periodic=periodic)
        want = limiter(df.collect())
        for hot_rows in (None, 40, 150):
            got = ratelimit.rate_limit(df, hot_rows=hot_rows)
            assert collect(got.select("request_id", "allowed", "remaining", "reset_s"), "request_id") == want


def test_rate_limit_cases(spark):
    rows = [(f"r{i}", i, "a", "write", 1, 3) for i in range(5)]
    df = spark.createDataFrame(rows, "request_id string, s bigint, api_key string, bucket string, cost int, `limit` bigint")
    got = ratelimit.rate_limit(df.withColumn("ts", F.timestamp_seconds("s"))).orderBy("request_id").collect()
    assert [r.allowed for r in got] == [True, True, True, False, False]
    assert [r.remaining for r in got] == [2, 1, 0, 0, 0]


def attempts(spark, n=500, seed=9):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.randrange(1, 25)
        rows.append(("hot" if rng.random() < 0.8 else "cold", i, t, rng.random() < 0.35))
    return spark.createDataFrame(rows, "engine string, seq bigint, s bigint, ok boolean").withColumn("ts", F.timestamp_seconds("s"))


def breaker_oracle(rows, threshold, reset):
    out, states = [], {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        failures, opened = states.get(r["engine"], (0, None))
        state = "closed" if opened is None else "open" if r["s"] - opened < reset else "half_open"
        if state != "open":
            if r["ok"]:
                failures, opened = 0, None
            else:
                failures += 1
                if opened is not None or failures >= threshold:
                    opened = r["s"]
        states[r["engine"]] = failures, opened
        out.append((r["seq"], state, state != "open"))
    return out


def test_breaker_sliced_and_plain(spark):
    df = attempts(spark)
    want = breaker_oracle(df.collect(), 3, 60)
    assert {"closed", "open", "half_open"} == {w[1] for w in want}
    for hot_rows in (None, 40):
        got = breaker.breaker_timeline(df, threshold=3, reset_s=60, hot_rows=hot_rows)
        assert collect(got.select("seq", "state", "admitted"), "seq") == want


def test_outbox_sliced_and_plain(spark):
    rng = random.Random(6)
    rows, want, states, t = [], [], {}, 0
    for i in range(500):
        t += rng.randrange(1, 20) if i % 40 else 300
        job = "hot" if rng.random() < 0.7 else f"j{rng.randrange(4)}"
        rows.append((job, t, i, rng.choice(["claim", "claim", "result"]), rng.choice([503, 503, 429, None] if i < 450 else [200, 503])))
        event = {"us": t * 1_000_000, "event": rows[-1][3], "http_status": 503 if rows[-1][4] is None and i < 400 else rows[-1][4]}
        rows[-1] = (*rows[-1][:4], event["http_status"])
        states[job], outcome = outbox.advance(states.get(job, outbox.IDLE), event, max_attempts=40)
        want.append((i, outcome, states[job]["status"], states[job]["attempts"], states[job]["next_us"]))
    df = spark.createDataFrame(rows, "job_id string, s bigint, seq bigint, event string, http_status int").withColumn("ts", F.timestamp_seconds("s"))
    assert {"sending", "pending", "not_due", "ignored"} <= {w[1] for w in want}
    for hot_rows in (None, 40):
        got = outbox.delivery_states(df, max_attempts=40, hot_rows=hot_rows)
        assert collect(got.select("seq", "outcome", "status", "attempts", "next_us"), "seq") == want


def packed_by_hand(rows, max_chunk, max_gap):
    """Index of the first row that does not fit behind ``head``, again and again."""
    out, head = [], 0
    while head < len(rows):
        stop = next(
            (
                i
                for i in range(head + 1, len(rows))
                if rows[i][1] - rows[head][0] > max_chunk or rows[i][0] - rows[i - 1][1] > max_gap
            ),
            len(rows),
        )
        out.append((rows[head][0], rows[stop - 1][1]))
        head = stop
    return out


def test_packing_sliced_and_plain(spark):
    rng = random.Random(2)
    rows, want = [], []
    for key, n in (("hot", 400), ("a", 20), ("b", 1)):
        t, own = 0, []
        for _ in range(n):
            t += rng.choice((1, 3, 9, 12))
            end = t + rng.randrange(1, 20)
            own.append((t, end))
            t = end
        rows += [(key, *r) for r in own]
        want += [(key, *s) for s in packed_by_hand(own, 60, 10)]
    df = spark.createDataFrame(rows, "k string, start bigint, end bigint")
    for hot_rows in (None, 25, 100):
        got = chunks.pack_chunks(df, ["k"], max_chunk=60, max_gap=10, hot_rows=hot_rows)
        assert collect(got.select("k", "start", "end"), "k", "start") == sorted(want)


def test_merge_regions_sliced_and_plain(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else "c", s := rng.randrange(5000), s + rng.randrange(1, 30)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, start bigint, end bigint")
    want = []
    for key in ("c", "hot"):
        covered = sorted({2 * x for k, a, b in rows if k == key for x in range(a, b + 1)}
                         | {2 * x + 1 for k, a, b in rows if k == key for x in range(a, b)})
        edges = [0, *(i for i in range(1, len(covered)) if covered[i] - covered[i - 1] > 1), len(covered)]
        want += [(key, covered[a] // 2, covered[b - 1] // 2) for a, b in zip(edges, edges[1:])]
    for hot_rows in (None, 50):
        got = regions.merge_regions(df, ["k"], hot_rows=hot_rows)
        assert collect(got, "k", "start") == want
