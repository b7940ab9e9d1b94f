"""Near-duplicate vectors by an epsilon grid order join.

Vectors of one length are points on a sphere: a cosine of c is a distance of sqrt(2 - 2c). They are
rotated onto principal dimensions, sorted by the grid cells (as wide as that distance) of the
leading ones, and cut into blocks of this sequence. Intervals of the sequence are joined with each
other recursively: pairs of intervals whose bounding boxes are farther apart than the distance are
skipped, first between blocks in Spark, then inside the tasks that compare two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframe.llm.common import components, cut, label_roots, number_rows, small

#: Vectors of a block, and of an interval inside a task that is compared as a whole.
BLOCK_ROWS = 2048
LEAF_ROWS = 256
#: Intervals that make one at the level above.
FAN_OUT = 8
#: Leading principal dimensions that are sorted by, and those that bounding boxes have.
GRID_DIMS, BOX_DIMS = 4, 16
#: Vectors the principal dimensions are fitted on. They steer the skipping only, not the result.
SAMPLE_ROWS = 20_000
#: Between vectors of different sizes, which have no cosine, in the boxes' first dimension.
APART = 100.0
_TINY = 1e-9


@contextmanager
def _small_batches(spark: SparkSession, rows: int):
    """Blocks are large rows: few of them go to a Python worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _units(values: np.ndarray) -> np.ndarray:
    values = values.astype("f8")
    # Scaled first, so that squares neither overflow nor vanish.
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _prints(vectors: DataFrame) -> DataFrame:
    """(vec_id, fp, raw): raw bytes of a usable vector and a print of them; NULL for others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = []
            for x in batch["embedding"]:
                x = None if x is None else np.asarray(x, dtype="f8")
                usable = x is not None and len(x) and np.isfinite(x).all() and x.any()
                raw.append(x.tobytes() if usable else None)
            fps = [None if x is None else xxhash.xxh3_128_digest(x) for x in raw]
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "fp": fps, "raw": raw})

    kept = vectors.select("vec_id", "embedding")
    return kept.mapInPandas(run, "vec_id long, fp binary, raw binary")


def _axes(classes: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Principal axes for each vector size, of the first ``rows`` vectors by their prints."""
    sample = classes.orderBy("fp").limit(rows).select("raw").toPandas()["raw"]
    by_size: dict[int, list[np.ndarray]] = {}
    for raw in sample:
        x = np.frombuffer(raw, "f8")
        by_size.setdefault(len(x), []).append(x)
    axes = {}
    for size, values in by_size.items():
        units = _units(np.array(values))
        _, found = np.linalg.eigh(np.cov(units.T).reshape(size, size) if len(units) > 1 else np.eye(size))
        axes[size] = found[:, ::-1][:, :BOX_DIMS]
    return axes


def _project(units: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates for boxes: the vector's size, then principal ones (or its own first ones, if no
    vector of its size was in the sample)."""
    size = units.shape[1]
    at = units @ axes[size] if size in axes else units[:, :BOX_DIMS]
    out = np.zeros((len(units), BOX_DIMS + 1))
    out[:, 0] = APART * size
    out[:, 1 : 1 + at.shape[1]] = at
    return out


def _by_size(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(r) // 8 for r in raws])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer(b"".join(raws[i] for i in rows), "f8").reshape(len(rows), size)


def _cells(classes: DataFrame, axes: dict[int, np.ndarray], width: float) -> DataFrame:
    names = ["size", *[f"c{i}" for i in range(GRID_DIMS)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws = batch["raw"].tolist()
            cells = np.zeros((len(raws), 1 + GRID_DIMS), dtype="i8")
            for rows, values in _by_size(raws):
                at = _project(_units(values), axes)[:, 1 : 1 + GRID_DIMS]
                cells[rows, 0] = values.shape[1]
                cells[rows, 1:] = np.floor(at / width)
            yield pd.DataFrame(cells, columns=names).assign(fp=batch["fp"].to_numpy())

    schema = ", ".join(f"{n} long" for n in names) + ", fp binary"
    return classes.select("fp", "raw").mapInPandas(run, schema)


def _blocks(classes: DataFrame, axes: dict[int, np.ndarray], width: float, block_rows: int) -> DataFrame:
    """(block, fps, weights, raws, lo, hi): the sequence in rows of ``block_rows`` vectors."""
    cells = _cells(classes, axes, width)
    numbered, _ = number_rows(cells, cells.columns, "number")
    at = numbered.select("fp", F.call_function("div", F.col("number"), F.lit(block_rows)).alias("block"), "number")
    rows = at.join(classes, "fp")

    def box(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number")
        raws = group["raw"].tolist()
        lo, hi = np.full(BOX_DIMS + 1, np.inf), np.full(BOX_DIMS + 1, -np.inf)
        for _, values in _by_size(raws):
            places = _project(_units(values), axes)
            lo, hi = np.minimum(lo, places.min(axis=0)), np.maximum(hi, places.max(axis=0))
        return pd.DataFrame(
            {
                "block": [group["block"].iloc[0]],
                "fps": [group["fp"].tolist()],
                "weights": [group["weight"].tolist()],
                "raws": [raws],
                "lo": [lo],
                "hi": [hi],
            }
        )

    schema = "block long, fps array<binary>, weights array<long>, raws array<binary>, lo array<double>, hi array<double>"
    return rows.groupBy("block").applyInPandas(box, schema)


def _near(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column, width: float) -> Column:
    """Whether two boxes are no farther apart than ``width``."""
    gaps = F.zip_with(
        F.arrays_zip(lo_a.alias("lo"), hi_a.alias("hi")),
        F.arrays_zip(lo_b.alias("lo"), hi_b.alias("hi")),
        lambda a, b: F.greatest(F.lit(0.0), a["lo"] - b["hi"], b["lo"] - a["hi"]),
    )
    square = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    return square <= (width + _TINY) ** 2


def _block_pairs(boxes: DataFrame, blocks: int, width: float) -> DataFrame:
    """(a, b), a <= b, of blocks that may hold near vectors: intervals are joined from the whole
    sequence down, each pair of intervals by the pairs of their parts."""
    levels = [boxes.select(F.col("block").alias("node"), "lo", "hi")]
    count = blocks
    while count > 1:
        below = levels[-1].withColumn("above", F.call_function("div", F.col("node"), F.lit(FAN_OUT)))
        sides = below.select("above", F.posexplode(F.arrays_zip("lo", "hi")).alias("dim", "side"))
        sides = sides.groupBy("above", "dim").agg(F.min("side.lo").alias("lo"), F.max("side.hi").alias("hi"))
        # One entry for each dimension of a box.
        whole = sides.groupBy("above").agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("x"))
        parts = [F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi")]
        levels.append(cut(whole.select(F.col("above").alias("node"), *parts)))
        count = -(-count // FAN_OUT)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        parent = F.call_function("div", F.col("node"), F.lit(FAN_OUT))
        named = level.select("node", parent.alias("above"), "lo", "hi")
        left = named.select(F.col("above").alias("a"), F.col("node").alias("x"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
        right = named.select(F.col("above").alias("b"), F.col("node").alias("y"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
        joined = pairs.join(left, "a").join(right, "b").filter(F.col("x") <= F.col("y"))
        near = joined.filter(_near(*map(F.col, ("lo_a", "hi_a", "lo_b", "hi_b")), width))
        pairs = cut(near.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return pairs


class _Side:
    """One block: unit vectors padded to one width, sizes, places and weights, in sequence order."""

    def __init__(self, raws, weights, axes):
        raws = list(raws)
        self.size = np.array([len(r) // 8 for r in raws])
        self.units = np.zeros((len(raws), self.size.max()))
        self.places = np.zeros((len(raws), BOX_DIMS + 1))
        for rows, values in _by_size(raws):
            units = _units(values)
            self.units[rows, : values.shape[1]] = units
            self.places[rows] = _project(units, axes)
        self.weights = np.asarray(weights, dtype="i8")


def _links(a: _Side, b: _Side, same: bool, cosine: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked positions of two blocks, each pair once; intervals are halved and far ones skipped."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    wide = max(a.units.shape[1], b.units.shape[1])
    left, right = (np.pad(s.units, ((0, 0), (0, wide - s.units.shape[1]))) for s in (a, b))
    stack = [(0, len(left), 0, len(right))]
    while stack:
        i, j, k, m = stack.pop()
        if same and m <= i:
            continue  # the mirror image of a pair that is met
        p, q = a.places[i:j], b.places[k:m]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if gap @ gap > (width + _TINY) ** 2:
            continue
        if j - i > LEAF_ROWS or m - k > LEAF_ROWS:
            x, y = (i + j) // 2, (k + m) // 2
            firsts = [(i, x), (x, j)] if j - i > LEAF_ROWS else [(i, j)]
            seconds = [(k, y), (y, m)] if m - k > LEAF_ROWS else [(k, m)]
            stack += [(*f, *s) for f in firsts for s in seconds]
            continue
        close = left[i:j] @ right[k:m].T >= cosine
        close &= a.size[i:j, None] == b.size[None, k:m]
        rows, columns = np.nonzero(close)
        rows, columns = rows + i, columns + k
        if same:
            once = rows < columns
            rows, columns = rows[once], columns[once]
        found.append((rows, columns))
    if not found:
        return np.empty(0, "i8"), np.empty(0, "i8")
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def near_duplicates(
    vectors: DataFrame, *, cosine: float = 0.9, block_rows: int = BLOCK_ROWS, sample: int = SAMPLE_ROWS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Two vectors of one size are linked if their cosine, in double precision, is at least
    ``cosine`` (between 0 and 1). NULL, empty and zero vectors, and those with NULL or non-finite
    components, are linked with nothing. Rows of equal vectors are one class that counts as often
    as it comes, so copies aren't compared; tasks return counts and a spanning forest, not links.
    component_id is the smallest vec_id reachable, kept whether it is the row's own; NULL vec_ids
    come last. Only vec_id and embedding are read.
    """
    width = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    printed = cut(_prints(vectors))
    usable = printed.filter(F.col("fp").isNotNull())
    classes = usable.groupBy("fp").agg(
        F.first("raw").alias("raw"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least")
    )
    classes = cut(classes)
    axes = _axes(classes, sample)
    spark = vectors.sparkSession

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                a = _Side(row.raws_a, row.weights_a, axes)
                same = row.a == row.b
                b = a if same else _Side(row.raws_b, row.weights_b, axes)
                x, y = _links(a, b, same, cosine, width)
                if not len(x):
                    continue
                fps = [*row.fps_a, *([] if same else row.fps_b)]
                weights = np.concatenate([a.weights, *([] if same else [b.weights])])
                y = y if same else y + len(a.weights)
                counts = np.bincount(x, weights[y], len(fps)) + np.bincount(y, weights[x], len(fps))
                root = label_roots(len(fps), x, y)
                rows = np.flatnonzero(counts)
                yield pd.DataFrame(
                    {
                        "fp": [fps[i] for i in rows],
                        "links": counts[rows].astype("i8"),
                        "root": [fps[root[i]] for i in rows],
                    }
                )

    with _small_batches(spark, 4):
        blocks = cut(_blocks(classes.select("fp", "raw", "weight"), axes, width, block_rows))
        boxes = blocks.select("block", "lo", "hi")
        pairs = _block_pairs(boxes, blocks.count(), width)
        a = blocks.select(*[F.col(c).alias(n) for c, n in (("block", "a"), ("fps", "fps_a"), ("weights", "weights_a"), ("raws", "raws_a"))])
        b = blocks.select(*[F.col(c).alias(n) for c, n in (("block", "b"), ("fps", "fps_b"), ("weights", "weights_b"), ("raws", "raws_b"))])
        both = pairs.join(a, "a").join(b, "b")
        found = cut(both.mapInPandas(join, "fp binary, links long, root binary"))
    counts = found.groupBy("fp").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    ids = roots.join(classes.select(F.col("fp").alias("v"), "least"), "v").groupBy("root").agg(F.min("least").alias("id"))
    merged = roots.join(ids, "root").select(F.col("v").alias("fp"), "id")
    owners = classes.select("fp", "weight", "least").join(merged, "fp", "left").join(counts, "fp", "left")
    owners = cut(
        owners.select(
            "fp",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("id", "least").alias("component_id"),
        )
    )
    joined = usable.select("vec_id", "fp").join(small(owners), "fp").select("vec_id", "n_links", "component_id")
    others = printed.filter(F.col("fp").isNull())
    alone = others.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = joined.union(alone)
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
