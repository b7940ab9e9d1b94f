"""Merkle manifest of a table: leaves, roots of its groups, one root, and a proof for each row.

Nodes of a level are rows (group, index, digest). The siblings of a node have indices that can be computed
(its slot moved on inside its run), so each level equijoins its nodes with those indices, one join for each
offset, and the rows in slot zero emit the parents: the digest over all of the run. Roots of the groups are
the leaves of a last tree, whose root stands for the table. Proofs come down again: the path of a node is its own
siblings and its parent's path.

Everything is built-in functions. A level has as many rows as the one below divided by the arity, a
row at most the siblings of one run; no group or path passes through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.llm.common import number_rows, small, written

#: So many levels are joined on the way down before the paths are written.
PLAN_LEVELS = 4
#: One level of a path: the digests, 32 bytes each, of the siblings before and after the node.
PATH = "array<struct<before: binary, after: binary>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, strings, written one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hexed(digests: Column) -> Column:
    """Digests in bytes as lowercase hex."""
    return F.lower(F.hex(digests))


def field(column: Column | str) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, ``:`` and the value."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    size = F.octet_length(text).cast("string")
    return F.coalesce(F.concat(size, F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column | str]) -> Column:
    """The digest of a row's values, lowercase hex."""
    return digest(*[field(c) for c in columns])


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (group, index, digest) with the digests of the run's nodes before and after them. For each
    offset the index of a sibling is computed and joined; a run may end early."""
    slot = F.pmod("index", F.lit(arity)).cast("int")
    found = nodes
    for offset in range(1, arity):
        wanted = F.col("index") - slot + (slot + offset) % arity
        siblings = nodes.select(
            "group", F.col("index").alias("wanted"), F.col("digest").alias(f"at_{offset}")
        )
        found = found.withColumn("wanted", wanted).join(siblings, ["group", "wanted"], "left")
        found = found.drop("wanted")
    nothing = F.lit(b"")

    def beside(own: int, slots: range) -> Column:
        """What stands in these slots of the run of a node in slot ``own``."""
        return F.concat(nothing, *[F.coalesce(F.col(f"at_{(s - own) % arity}"), nothing) for s in slots])

    before, after = nothing, nothing
    for own in range(arity):
        before = F.when(slot == own, beside(own, range(own))).otherwise(before)
        after = F.when(slot == own, beside(own, range(own + 1, arity))).otherwise(after)
    return found.select("group", "index", "digest", before.alias("before"), after.alias("after"))


def grow(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels (group, index, digest, before, after) of one tree for each group, leaves first, and the
    roots (group, digest, height). ``leaves`` are (group, index, digest) with indices 0 .. n-1 in each group.

    A group's tree ends where it has one node left, so a lone leaf is a root of height 0. Each level is
    written.
    """
    nodes, levels, roots = written(leaves.select("group", "index", "digest")), [], None
    widest = nodes.agg(F.max("index")).first()[0]
    while True:
        height = F.lit(len(levels)).alias("height")
        if not widest:
            left = nodes.select("group", "digest", height)
            return levels, left if roots is None else roots.union(left)
        level = written(_with_siblings(nodes, arity))
        # Only a node without others has index 0 and no siblings.
        alone = (F.col("index") == 0) & (F.length("before") + F.length("after") == 0)
        done = level.filter(alone).select("group", "digest", height)
        roots = done if roots is None else roots.union(done)
        levels.append(level.filter(~alone))
        nodes = levels[-1].filter(F.pmod("index", F.lit(arity)) == 0).select(
            "group",
            F.expr(f"index div {arity}").alias("index"),
            F.unhex(digest(hexed(F.col("digest")), hexed(F.col("after")))).alias("digest"),
        )
        widest //= arity


def paths(levels: list[DataFrame], roots: DataFrame, leaves: DataFrame, arity: int) -> DataFrame:
    """The rows of ``leaves`` (group, index, others) with ``path``, their siblings level by level. ``roots``
    (group, height, path) have what follows above each group's own tree.

    A parent's path goes to the at most ``arity`` nodes of its run, so what is shuffled for the leaves is one
    path for each run of them.
    """

    def ends(height: int) -> DataFrame:
        own = roots.filter(F.col("height") == height)
        return own.select("group", F.lit(0).cast("long").alias("parent"), F.col("path").alias("rest"))

    above = None
    for depth in range(len(levels) - 1, -1, -1):
        step = F.array(F.struct("before", "after")).cast(PATH)
        parent = F.expr(f"index div {arity}").alias("parent")
        keyed = levels[depth].select("group", "index", parent, step.alias("step"))
        if depth == 0:
            keyed = keyed.join(leaves, ["group", "index"])
        rest = ends(depth + 1)
        if above is not None:
            rest = above.select("group", F.col("index").alias("parent"), F.col("path").alias("rest")).union(rest)
        joined = keyed.join(rest, ["group", "parent"]).withColumn("path", F.concat("step", "rest"))
        above = joined.drop("parent", "step", "rest")
        if depth and depth % PLAN_LEVELS == 0:
            above = written(above)
    lone = ends(0).join(leaves, "group").withColumn("path", F.col("rest")).drop("parent", "rest")
    return lone if above is None else above.unionByName(lone)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(
        path, start, lambda node, step: digest(hexed(step["before"]), node, hexed(step["after"]))
    )


def proof(path: Column) -> Column:
    """All siblings of a path in hex, one after the other."""
    return F.concat_ws(
        "", F.transform(path, lambda step: hexed(F.concat(step["before"], step["after"])))
    )


def manifest(
    rows: DataFrame,
    columns: Sequence[str],
    *,
    group: str,
    order: str,
    arity: int = 3,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(``order``, ``group``, ``carry``, leaf, subroot, root, path) for each row of a table; the three
    digests are lowercase hex.

    The leaf is the digest of ``columns``. In each group (NULL is one, the first) leaves stand by ``order``, NULL
    first, rows of equal order by their leaf; groups stand by their name, bytewise. Every ``arity`` consecutive
    nodes, fewer in the last run, become their digest until one node is left; the groups' roots do the same.
    Repeated rows are leaves of their own. An empty table gives no rows. Other columns may have any names.

    Leaves are numbered by one distributed sort and a group's first number, which partial aggregates find,
    so a group with a third of all rows is spread like the others.
    """
    extra = [f"carry_{i}" for i in range(len(carry))]
    narrow = rows.select(
        F.col(group).alias("g"),
        F.col(order).alias("o"),
        F.unhex(leaf(columns)).alias("digest"),
        *[F.col(c).alias(e) for c, e in zip(carry, extra)],
    )
    numbered, _ = number_rows(narrow, ["g", "o", "digest"], "place")
    numbered = written(numbered)
    # From here on a group is known by the number of its first leaf.
    firsts = small(written(numbered.groupBy(F.col("g").alias("name")).agg(F.min("place").alias("group"))))
    leaves = numbered.join(firsts, F.col("g").eqNullSafe(F.col("name"))).select(
        "group", (F.col("place") - F.col("group")).alias("index"), "g", "o", "digest", *extra
    )
    leaves = written(leaves)
    levels, subroots = grow(leaves, arity)
    ranked, _ = number_rows(subroots, ["group"], "index")
    zero = F.lit(0).cast("long").alias("group")
    ranked = written(ranked.select(zero, "index", "digest", F.col("group").alias("member"), "height"))
    top_levels, tops = grow(ranked, arity)
    top = tops.select("group", "digest").first()
    root = None if top is None else bytes(top["digest"]).hex()
    start = tops.select("group", "height", F.array().cast(PATH).alias("path"))
    above = written(paths(top_levels, start, ranked, arity))
    subroot = hexed(F.col("digest")).alias("subroot")
    roots = above.select(F.col("member").alias("group"), "height", "path", subroot)
    whole = paths(levels, roots, leaves, arity).join(small(roots.select("group", "subroot")), "group")
    return whole.select(
        F.col("o").alias(order),
        F.col("g").alias(group),
        *[F.col(e).alias(c) for c, e in zip(carry, extra)],
        hexed(F.col("digest")).alias("leaf"),
        "subroot",
        F.lit(root).cast("string").alias("root"),
        "path",
    )
