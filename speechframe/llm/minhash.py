"""Near-duplicate texts: bottom-k sketches, inverted lists, exact Jaccard, components.

1. A document's set: hashes of its word shingles by one hash function; its sketch: the ``k`` smallest.
   Documents of equal sets are one class from here on.
2. Inverted lists of retained values. Two sets as similar as asked share many retained values, so
   each class needs to stand only in the lists of its rarest ones (a prefix of its sketch in the order of
   frequency): a passage that many documents share makes a list only for documents made of such.
3. In every list each class meets the list's smallest class; sketches estimate their overlap (the
   union's sketch is part of both), and what passes is verified on the full sets.
4. Classes of lists that are not yet connected are dealt in blocks, and two blocks that a list joins
   are compared inside a task: by their sketches, then on the full sets of the classes that
   sketches leave a partner for. Tasks return spanning forests of components. So no list is written
   out as pairs, yet no link between different components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from speechframe.llm.common import components, cut, label_roots, let_go, number_rows, runs, small, tidy

SKETCH = 64
#: Retained values that two sets of similarity 0.8 share at least, when both sets are larger than
#: the sketch. The expected number is 51 with deviation 3.2; fewer than this has odds below 1e-8.
SHARED = 30
#: Classes of a block, if their sets have up to so many shingles; two blocks are compared at once.
BLOCK = 1024
BLOCK_SET = 1024
#: Edges that a task of the search for components takes at least.
EDGES = 50_000
#: Words a worker remembers with their hashes.
MEMO_WORDS = 1_000_000

SKETCHES = "doc_id long, n long, fp binary, sketch array<long>"
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Shingler:
    def __init__(self, width: int):
        self.width = width
        self.hashes: dict[bytes, int] = {}

    def _words(self, words: list[bytes]) -> np.ndarray:
        hashes = self.hashes
        try:
            return np.fromiter(map(hashes.__getitem__, words), "u8", len(words))
        except KeyError:
            if len(hashes) > MEMO_WORDS:
                hashes.clear()
            for word in set(words):
                if word not in hashes:
                    hashes[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(hashes.__getitem__, words), "u8", len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 63-bit hashes of the text's shingles; of all its words as one if it has
        fewer than a shingle; nothing without words."""
        words = (text or "").encode().lower().split()  # ASCII letters and white space only
        if not words:
            return np.empty(0, "i8")
        hashed = self._words(words)
        width = min(self.width, len(words))
        rows = len(words) - width + 1
        total = np.full(rows, width, "u8")
        with np.errstate(over="ignore"):
            for i in range(width):
                total = (total ^ hashed[i : i + rows]) * _MUL
                total ^= total >> np.uint64(29)
            total = total * _MIX
            total ^= total >> np.uint64(32)
        return np.unique(total >> np.uint64(1)).view("i8")


def sketch_documents(docs: DataFrame, *, width: int, k: int = SKETCH) -> DataFrame:
    """(doc_id, n, fp, sketch): set size, a 128-bit print of the set and its ``k`` smallest hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Shingler(width)
        for batch in batches:
            sets = [own.shingles(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "n": [len(s) for s in sets],
                    "fp": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "sketch": [s[:k] for s in sets],
                }
            )

    return docs.select("doc_id", "text").mapInPandas(tidy(run), SKETCHES)


def prefix_length(n: Column, k: int, similarity: float) -> Column:
    """How many of a sketch's rarest values are enough to meet every set as similar as asked. If no
    such set is larger than ``k``, sketches are the sets and the bound is exact."""
    shared = max(1, round(SHARED * k / SKETCH * similarity / 0.8))
    held = F.least(n, F.lit(k))
    exact = n - F.ceil(n * F.lit(similarity) - 1e-9) + 1
    return F.when(n <= ceil(similarity * k) - 1, exact).otherwise(F.greatest(held - shared + 1, F.lit(1)))


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, k: int) -> float:
    """Similarity of two sets by the sketch of their union, which both sketches hold; exact where
    they hold the whole sets."""
    shared = np.intersect1d(a, b, assume_unique=True)
    if n_a <= k and n_b <= k:
        return len(shared) / (n_a + n_b - len(shared))
    union = np.union1d(a, b)[:k]
    return np.searchsorted(shared, union[-1], side="right") / len(union)


def slack(k: int) -> float:
    """What an estimate may fall short of the similarity: 6.3 deviations."""
    return 6.3 * 0.4 / k**0.5


def _passes(a, b, n_a: int, n_b: int, k: int, similarity: float) -> tuple[bool, float]:
    if min(n_a, n_b) < similarity * max(n_a, n_b) - 1e-9:
        return False, 0.0
    value = estimate(a, b, n_a, n_b, k)
    bound = similarity - 1e-9 if n_a <= k and n_b <= k else similarity - slack(k)
    return value >= bound, value


def _lists(classes: DataFrame, k: int, similarity: float) -> DataFrame:
    """(value, fp, n, m): the lists a class stands in, and their lengths m over 1."""
    held = classes.select("fp", "n", F.explode("sketch").alias("value"))
    frequent = held.groupBy("value").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = held.join(frequent, "value")
    own = Window.partitionBy("fp")
    # Values of one class alone come first in the order; they need no list.
    ranked = shared.select(
        "*",
        F.row_number().over(own.orderBy("m", "value")).alias("r"),
        F.count(F.lit(1)).over(own).alias("common"),
    )
    alone = F.least(F.col("n"), F.lit(k)) - F.col("common")
    kept = ranked.filter(F.col("r") + alone <= prefix_length(F.col("n"), k, similarity))
    lists = kept.select("value", "fp", "n", alone.alias("alone"))
    # The class with least of its own is most likely what the others were made from.
    central = F.min(F.struct("alone", "fp")).getField("fp")
    sizes = lists.groupBy("value").agg(F.count(F.lit(1)).alias("m"), central.alias("hub"))
    return lists.join(sizes.filter("m > 1"), "value")


def _with_sketches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    a = classes.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = classes.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    return pairs.join(a, "a").join(b, "b")


def _estimated(pairs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Pairs with sketches to (a, b, estimate) of those that may be links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = (batch[c] for c in ("s_a", "s_b", "n_a", "n_b"))
            found = [_passes(*row, k, similarity) for row in zip(*columns)]
            out = batch[["a", "b"]].assign(estimate=[x[1] for x in found])
            yield out[[x[0] for x in found]]

    return pairs.mapInPandas(tidy(run), "a binary, b binary, estimate double")


def _full_sets(wanted: DataFrame, docs: DataFrame, sketched: DataFrame, width: int) -> DataFrame:
    """(fp, whole): the sets of the classes (fp) in ``wanted``; one document of each is read again."""
    first = sketched.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    chosen = cut(first.join(wanted, "fp").select("doc_id", F.col("fp").alias("wanted")))
    ids = small(chosen.select("doc_id").distinct().withColumnRenamed("doc_id", "__id"))
    texts = docs.select("doc_id", "text")
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(F.col("__id")), "left_semi")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Shingler(width)
        for batch in batches:
            found = [own.shingles(t).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"fp": [xxhash.xxh3_128_digest(s) for s in found], "whole": found})

    full = texts.mapInPandas(tidy(sets), "fp binary, whole binary")
    full = full.join(small(chosen.select(F.col("wanted").alias("fp"))), "fp", "left_semi")
    # Several rows may show the same set.
    return cut(full.dropDuplicates(["fp"]))


def _verify(
    pairs: DataFrame, docs: DataFrame, sketched: DataFrame, *, width: int, similarity: float
) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked, counted on the sets themselves."""
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    full = _full_sets(wanted, docs, sketched, width)
    a = full.select(F.col("fp").alias("a"), F.col("whole").alias("whole_a"))
    b = full.select(F.col("fp").alias("b"), F.col("whole").alias("whole_b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        percent = round(100 * similarity)
        for batch in batches:
            links = []
            for one, two in zip(batch["whole_a"], batch["whole_b"]):
                x, y = np.frombuffer(one, "i8"), np.frombuffer(two, "i8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                links.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.loc[links, ["a", "b"]]

    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInPandas(tidy(run), "a binary, b binary")


def shared_counts(sets: list[np.ndarray], first: int, columns: int = 1024) -> np.ndarray:
    """How many elements each of the ``first`` sets shares with each of the others: products of
    their incidence matrices, a few elements at a time, without those that only one set has. If all
    sets are first ones, they are compared among themselves."""
    second = first % len(sets)
    rows = np.repeat(np.arange(len(sets), dtype="i4"), [len(s) for s in sets])
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[element] > 1
    number = (np.cumsum(times > 1) - 1)[element[common]]
    rows = rows[common]
    del element, common
    order = np.argsort(number, kind="stable")
    number, rows = number[order], rows[order]
    shared = np.zeros((first, len(sets) - second), dtype="f4")
    total = int(number[-1]) + 1 if len(number) else 0
    for start in range(0, total, columns):
        at = slice(*np.searchsorted(number, [start, start + columns]))
        held = np.zeros((len(sets), min(columns, total - start)), dtype="f4")
        held[rows[at], number[at] - start] = 1
        shared += held[:first] @ held[second:].T
    return shared


def _blocks(members: DataFrame) -> tuple[DataFrame, int]:
    """(fp, n, root, block) of the classes in ``members``, and how many they are. Classes of common lists
    stand side by side. A block holds at most ``BLOCK`` sets of up to ``BLOCK_SET`` shingles, half as many
    for every doubling of their size, so its sets stay within a bound in bytes too."""
    doubled = F.floor(F.log2(F.col("n") / BLOCK_SET)).cast("int")
    level = F.least(F.greatest(doubled, F.lit(0)), F.lit(20))
    placed = members.groupBy("fp").agg(
        F.first("n").alias("n"), F.first("root").alias("root"), F.min("near").alias("near")
    )
    numbered, total = number_rows(placed.withColumn("level", level), ["level", "near", "fp"], "number")
    size = F.greatest(F.call_function("shiftright", F.lit(BLOCK), F.col("level")), F.lit(1))
    block = F.shiftleft(F.col("level").cast("long"), 48) + F.call_function("div", F.col("number"), size)
    return cut(numbered.select("fp", "n", "root", block.alias("block"))), total


def _candidates(rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """Of the rows (i, j, block, fp, root, n, sketch) of pairs of blocks, those whose class has a class of another
    component and of the other block that the sketch of their union doesn't rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["i", "j"]):
            sketches = group["sketch"].tolist()
            sizes = group["n"].to_numpy("f8")
            first = int((group["block"] == group["i"].iloc[0]).sum())
            second = first % len(sketches)
            known = pd.factorize(group["root"])[0]
            found = np.zeros(len(sketches), dtype=bool)
            for i, counts in enumerate(shared_counts(sketches, first)):
                # No estimate is above what the two sketches share.
                whole = np.maximum(sizes[i], sizes[second:]) <= k
                union = np.where(whole, sizes[i] + sizes[second:] - counts, k)
                bound = np.where(whole, similarity, similarity - slack(k))
                near = (counts >= (bound - 1e-9) * union) & (known[i] != known[second:])
                for j in (np.flatnonzero(near) + second).tolist():
                    if found[i] and found[j]:
                        continue
                    if _passes(sketches[i], sketches[j], sizes[i], sizes[j], k, similarity)[0]:
                        found[i] = found[j] = True
            yield group.loc[found, ["i", "j", "block", "fp", "root"]]

    dealt = rows.repartition("i", "j").sortWithinPartitions("i", "j", "block")
    return dealt.mapInPandas(tidy(run), "i long, j long, block long, fp binary, root binary")


def _across(
    lists: DataFrame,
    roots: DataFrame,
    classes: DataFrame,
    docs: DataFrame,
    sketched: DataFrame,
    *,
    width: int,
    similarity: float,
    k: int,
) -> DataFrame:
    """(a, b): edges between components (roots) that connect all those with a link between classes of one list.

    Classes of lists that aren't one component yet are dealt in blocks, and every two blocks that some list
    joins are compared once: first their sketches, then the full sets of the classes that
    have a likely partner there. A task returns a spanning forest of the links it found, so copies of
    each other give no pairs."""
    labelled = lists.join(roots.select(F.col("v").alias("fp"), "root"), "fp", "left")
    labelled = labelled.select("value", "fp", "n", F.coalesce("root", "fp").alias("root"))
    ends = labelled.groupBy("value").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.min("fp").alias("near")
    )
    open_lists = ends.filter(F.col("x") != F.col("y")).select("value", "near")
    members = cut(labelled.join(open_lists, "value"))
    blocks, total = _blocks(members)
    if not total:
        return lists.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    held = members.select("value", "fp").join(blocks.select("fp", "block"), "fp").select("value", "block").distinct()
    other = held.select("value", F.col("block").alias("j"))
    pairs = held.join(other, "value").filter(F.col("block") <= F.col("j"))
    pairs = cut(pairs.select(F.col("block").alias("i"), "j").distinct())
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    outlined = blocks.join(classes.select("fp", "sketch"), "fp")
    likely = cut(_candidates(sides.join(outlined, "block"), k, similarity))
    full = _full_sets(likely.select("fp").distinct(), docs, sketched, width)
    rows = likely.join(full, "fp").select("i", "j", "block", "root", "whole")
    percent = round(100 * similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["i", "j"]):
            sets = [np.frombuffer(w, "i8") for w in group["whole"]]
            sizes = np.array([len(s) for s in sets], dtype="f8")
            first = int((group["block"] == group["i"].iloc[0]).sum())
            second = first % len(sets)
            shared = shared_counts(sets, first)
            # Only links between components that are still apart.
            known, names = pd.factorize(group["root"])
            x, y = [], []
            for i, counts in enumerate(shared.astype("i4")):
                union = sizes[i] + sizes[second:] - counts
                alike = (100.0 * counts >= percent * union) & (known[i] != known[second:])
                met = np.unique(known[second:][alike])
                x.append(np.full(len(met), known[i]))
                y.append(met)
            root = label_roots(len(names), np.concatenate(x), np.concatenate(y))
            linked = np.flatnonzero(root != np.arange(len(names)))
            if len(linked):
                yield pd.DataFrame({"a": names[linked], "b": names[root[linked]]})

    dealt = rows.repartition("i", "j").sortWithinPartitions("i", "j", "block")
    return dealt.mapInPandas(tidy(run), "a binary, b binary")


def near_duplicates(
    docs: DataFrame, *, width: int = 5, similarity: float = 0.8, k: int = SKETCH
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, fp) for every row of ``docs`` (doc_id, text).

    Documents are linked if their shingle sets have at least this Jaccard similarity;
    component_id is the smallest doc_id reachable over links, kept whether it is the row's own. Texts
    without words (NULL and empty ones) have no shingles and are linked with nothing, not even with
    each other. Rows of one doc_id and text are one document and all kept or not. A NULL doc_id is
    linked by its text, but never a component's id while others are there; alone it stays NULL and
    is kept. Only doc_id and text are read.
    """
    sketched = cut(sketch_documents(docs, width=width, k=k))
    some = sketched.filter("n > 0")
    classes = cut(
        some.groupBy("fp").agg(
            F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least")
        )
    )
    lists = cut(_lists(classes, k, similarity))
    stars = lists.filter(F.col("fp") != F.col("hub")).select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    likely = _estimated(_with_sketches(stars.distinct(), classes), k, similarity)
    # One partner each is enough here; what stays apart meets again below.
    best = cut(likely.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("x")).select("a", "x.b"))
    options = {"width": width, "similarity": similarity}
    links = cut(_verify(best, docs, sketched, **options))
    apart = components(links, rows=EDGES)
    joined = components(_across(lists, apart, classes, docs, sketched, **options, k=k), rows=EDGES)
    inner = apart.select(F.col("v").alias("fp"), F.col("root").alias("inner"))
    outer = joined.select(F.col("v").alias("inner"), "root")
    owners = classes.select("fp", "least").join(inner, "fp", "left")
    owners = owners.withColumn("inner", F.coalesce("inner", "fp")).join(outer, "inner", "left")
    owners = cut(owners.select("fp", "least", F.coalesce("root", "inner").alias("root")))
    ids = owners.groupBy("root").agg(F.min("least").alias("component_id"))
    owners = owners.select("fp", "root").join(ids, "root").select("fp", "component_id")
    # A class of many copies is a hot key on the left side only, which adaptive execution splits.
    joined = some.select("doc_id", "n", "fp").join(owners, "fp")
    alone = sketched.filter("n = 0").select("doc_id", "n", "fp", F.col("doc_id").alias("component_id"))
    rows = joined.select("doc_id", "n", "fp", "component_id").union(alone)
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "fp",
    )


def keep_one(docs: DataFrame, *, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one of the smallest doc_id, all
    columns as they are. Rows without words all stay; of repeated rows of one doc_id and text one
    stays."""
    found = near_duplicates(docs, width=width, similarity=similarity)
    per_row = found.groupBy("doc_id", "fp").agg(
        F.first("kept").alias("kept"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n")
    )
    marked = cut(per_row.filter(~F.col("kept") | ((F.col("copies") > 1) & (F.col("n") > 0))))
    marked = small(marked.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), F.col("kept").alias("__kept")))

    @F.pandas_udf("binary")
    def print_of(texts: pd.Series) -> pd.Series:
        let_go()
        own = Shingler(width)
        return pd.Series([xxhash.xxh3_128_digest(own.shingles(t).tobytes()) for t in texts])

    columns = docs.columns
    printed = docs.withColumn("__print", print_of("text"))
    same = printed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__fp"))
    joined = printed.join(marked, same, "left")
    single = joined.filter(F.col("__kept").isNull()).select(*[docs[c] for c in columns])
    repeated = joined.filter("__kept").dropDuplicates(["__id", "__print"])
    return single.union(repeated.select(*[docs[c] for c in columns]))
