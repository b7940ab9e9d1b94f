"""Importance resampling, block naming and the Merkle manifest on small tables: brute force and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from speechframe.llm import merkle, naming, resample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, name string, n string"


def documents(spark, rows):
    """Rows (doc_id, text, source) with the other columns, and extra ones whose names operators use too."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", None) for i, t, s in rows], DOCS)


LONG = "Long wörd " * 40_000
ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t", None),
    (None, "no id here", "a"),
    (4, "a", "b"),
    (4, "a", "b"),
    (5, LONG, "c"),
    (6, LONG.upper().replace("Ö", "ö"), "c"),
    (7, LONG + "x", None),
]


# --- importance resampling -------------------------------------------------------------------


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))


def plain_grams(text, width):
    words = plain_words(text)
    return [" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]


def brute_draw(docs, target, *, width, buckets, seed, percent, least):
    def count(texts):
        return collections.Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in plain_grams(t, width))

    s, t = count(x for _, x in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))

    rows = []
    for i, text in docs:
        grams = plain_grams(text, width)
        weight = sum(gain(zlib.crc32(g.encode()) % buckets) for g in grams)
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(plain_words(text)), len(grams), weight, score])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: n for n, r in enumerate(able[: percent * len(able) // 100], 1)}
    return {r[0]: (*r[1:], rank.get(r[0])) for r in rows}


def drawn(spark, docs, target, *, width, buckets, seed, percent, least):
    gains = resample.bucket_gains(
        resample.bucket_counts(docs, width=width, buckets=buckets),
        resample.bucket_counts(target, width=width, buckets=buckets),
        buckets=buckets,
    )
    weighed = resample.weigh(docs, gains, width=width, buckets=buckets)
    return resample.draw(weighed, seed=seed, percent=percent, least_words=least)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_draw_equals_the_plain_form(spark, width, monkeypatch):
    monkeypatch.setattr(resample, "PART_BYTES", 300)
    rng = random.Random(width)
    words = [rng.choice(["", "É", "x9"]) + "".join(rng.choices("abAB", k=3)) for _ in range(30)]
    docs = [
        (i, rng.choice([" ", ", ", "--"]).join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 40]))))
        for i in range(150)
    ]
    target = [" ".join(rng.choices(words[:8], k=20)) for _ in range(5)]
    how = dict(width=width, buckets=97, seed=5, percent=30, least=2)
    source = spark.createDataFrame([(i, t, None) for i, t in docs], "doc_id long, text string, weight string")
    found = drawn(spark, source, spark.createDataFrame([(t,) for t in target], "text string"), **how)
    names = ("n_words", "n_features", "weight", "score", "rank")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in found.collect()}
    assert got == brute_draw(docs, target, **how)


def test_draw_of_odd_rows(spark):
    docs = documents(spark, ODD).drop("n")
    how = dict(width=2, buckets=50, seed=1, percent=100, least=0)
    empty = spark.createDataFrame([], "text string")
    rows = drawn(spark, docs, empty, **how).collect()
    assert len(rows) == len(ODD) and sorted(r["rank"] for r in rows) == list(range(1, len(ODD) + 1))
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["weight"] == by_id[2]["weight"] == 0 and by_id[1]["n_features"] == 0
    assert by_id[None]["score"] is None and by_id[None]["rank"] == len(ODD)
    assert by_id[5]["n_words"] == 80_000 and by_id[5]["name"] == "x"
    assert drawn(spark, docs.limit(0), empty, **how).count() == 0


# --- block naming ----------------------------------------------------------------------------


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[lowered(text)].append(i)
    return {
        i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest())
        for t, g in groups.items()
        for i in g
    }


@pytest.mark.parametrize("block", [1, 3, 16])
def test_groups_of_equal_texts(spark, block):
    rng = random.Random(block)
    rows = [(i, "".join(rng.choices("abAé", k=rng.choice([0, 1, 2, 3, 7, 16, 17])))) for i in range(400)]
    rows += [(1000 + i, "abab" * 20 + rng.choice(["", "a", "ab"])) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = naming.exact_duplicates(table, block_bytes=block).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == brute_groups(rows) and len(found) == len(rows)


def test_names_are_ranks_of_runs_over_many_tasks(spark):
    values = [5] * 500 + [7] * 3 + [1] * 200 + [9]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row long, value long")
    named = naming.name_runs(rows.repartition(5), ["value"], ["row"]).collect()
    rank = {v: n for n, v in enumerate(sorted(set(values)))}
    assert {r["row"]: r["name"] for r in named} == {i: rank[v] for i, v in enumerate(values)}


def test_duplicates_of_odd_rows(spark):
    rows = naming.exact_duplicates(documents(spark, ODD)).collect()
    found = collections.defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
    assert len(rows) == len(ODD)
    assert found[1][0]["keep_id"] == 2 and not found[1][0]["kept"] and found[2][0]["kept"]
    assert found[None][0]["kept"] and found[None][0]["group_size"] == 1
    # Of repeated rows one stays.
    assert sorted(r["kept"] for r in found[4]) == [False, True] and found[4][0]["group_size"] == 2
    assert found[5][0]["keep_id"] == 6 and found[7][0]["group_size"] == 1
    assert naming.exact_duplicates(documents(spark, ODD).limit(0)).count() == 0


def test_blocks_are_the_text(spark):
    table = documents(spark, ODD)
    blocks = naming.cut_blocks(table, "text", "doc_id", 64).collect()
    texts = collections.defaultdict(dict)
    for b in blocks:
        texts[b["row"]][b["place"]] = bytes(b["block"])
        assert len(b["block"]) <= 64 and (b["place"] == 0) == (b["sha"] is not None)
    whole = sorted(b"".join(t[p] for p in sorted(t)) for t in texts.values())
    assert whole == sorted(lowered(t).encode() for _, t, _ in ODD)


def test_normalising_leaves_other_capitals():
    assert naming.normalised(pa.array(["AÉZ[", None])).to_pylist() == ["aÉz[".encode(), b""]


# --- Merkle manifest -------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_tree(leaves, arity):
    """The root, and for each leaf its siblings level by level."""
    found, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for x, i in enumerate(at):
            run = level[i - i % arity : i - i % arity + arity]
            found[x].append((run[: i % arity], run[i % arity + 1 :]))
            at[x] = i // arity
        level = [sha(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], found


def brute_manifest(rows, arity):
    groups = collections.defaultdict(list)
    for i, g, text in rows:
        groups[g].append((i, sha(plain_field(i), plain_field(g), plain_field(text))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x))
        trees[g] = brute_tree([d for _, d in groups[g]], arity)
    root, tops = brute_tree([trees[g][0] for g in names], arity)
    out = []
    for g, top in zip(names, tops):
        for (i, d), path in zip(groups[g], trees[g][1]):
            flat = "".join("".join(a + b) for a, b in path + top)
            out.append((i, g, d, trees[g][0], root, sha(flat)))
    return sorted(out, key=repr)


def entries(table, arity):
    found = merkle.manifest(table, ["doc_id", "source", "text"], group="source", order="doc_id", arity=arity)
    proof = merkle.digest(merkle.proof(F.col("path")))
    return found.select("doc_id", "source", "leaf", "subroot", "root", proof.alias("proof"), "path")


@pytest.mark.parametrize("arity,sizes", [(2, [1, 2, 5, 8]), (3, [1, 3, 4, 10, 28]), (4, [17]), (3, [1])])
def test_manifest_equals_the_plain_form(spark, arity, sizes):
    rows = [
        (100 * s + i, None if s == 0 and len(sizes) > 1 else f"é{s}", f"text {i}")
        for s, n in enumerate(sizes)
        for i in range(n)
    ]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    found = entries(table, arity).drop("path").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_manifest(rows, arity)


def test_proofs_tell_changed_rows(spark):
    rows = [(i, "abc"[i % 3], f"line {i}\n") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    now = F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text"))
    changed = table.withColumn("now", merkle.leaf(["doc_id", "source", now]))
    found = merkle.manifest(
        changed, ["doc_id", "source", "text"], group="source", order="doc_id", carry=["now"]
    ).withColumn("folded", merkle.fold(F.col("now"), F.col("path")))
    assert {r["doc_id"] for r in found.collect() if r["folded"] != r["root"]} == {7}
    # One path serves a later check of the same row, without the other rows.
    kept = found.filter("doc_id = 8").select(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root"))
    assert kept.first()[0]


def test_manifest_of_odd_rows(spark):
    table = documents(spark, ODD).withColumnRenamed("name", "leaf").withColumnRenamed("n", "group")
    rows = entries(table, 3).drop("path").collect()
    plain = [(i, s, t) for i, t, s in ODD]
    assert sorted((tuple(r) for r in rows), key=repr) == brute_manifest(plain, 3)
    assert entries(table.limit(0), 3).count() == 0
