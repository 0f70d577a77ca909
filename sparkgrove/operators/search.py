"""Finding leaves: point location, bounds in Morton order, owners by partition cuts, and top-down searches with predicates."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quadrant as Q
from ..plans.lineage import cut, filled
from .forest import Forest, containing, joinable, key_names, level_counts, levels_of, sort_keys


def locate(points: DataFrame, leaves: DataFrame, dim: int = 2) -> DataFrame:
    """points (tree, x, y[, z], any columns) with the leaf that holds each, its columns prefixed `l_`; points outside are dropped.

    Points on the far side of the root belong to the last cells. One equi-join on the ancestors of the levels present.
    """
    inside = points.withColumns({a: F.when(F.col(a) == Q.ROOT, Q.ROOT - 1).otherwise(F.col(a)).cast("long") for a in Q.axes(dim)})
    return containing(inside.withColumn("level", F.lit(Q.MAX)), leaves, dim).drop("level")


def counts_in_leaves(points: DataFrame, leaves: DataFrame, dim: int = 2) -> DataFrame:
    """leaves with n, the number of points inside. Points are counted by finest cell first, so hot cells are small before the join."""
    keys = key_names(dim)
    top = max(levels_of(leaves), default=0)
    fine = points.withColumn("level", F.lit(Q.MAX)).select("tree", *Q.columns(Q.ancestor(Q.cell(dim), F.lit(top)))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    per = containing(fine, leaves.select(*keys), dim).groupBy(*[F.col(f"l_{k}").alias(k) for k in keys]).agg(F.sum("n").alias("n"))
    return leaves.join(per, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def bound(cells: DataFrame, leaves: DataFrame, dim: int, lower: bool = True) -> DataFrame:
    """cells with `bound`, the gid of the lowest leaf at or after the cell (lower) or of the highest at or before it; else null.

    leaves: cells with gid, in any selection. An as-of join: both sides are ranged together and filled from their neighbours,
    so no tree is ordered in one task.
    """
    keys = key_names(dim)
    a = cells.withColumn("__id", F.monotonically_increasing_id())
    a = cut(a)
    both = a.select(*keys, "__id", F.lit(None).cast("long").alias("gid")).unionByName(leaves.select(*keys, F.lit(None).cast("long").alias("__id"), "gid"))
    # among equal keys leaves come first if the bound looks back, last if it looks ahead, so that equal counts on both sides
    tie = F.col("__id").isNull() if lower else F.col("__id").isNotNull()
    near = filled(both, [*sort_keys(dim), tie, F.coalesce("__id", "gid")], "gid", "bound", forward=not lower)
    return a.join(near.where("__id is not null").select("__id", "bound"), "__id").drop("__id")


def positions(ranked_leaves: DataFrame, dim: int) -> DataFrame:
    """rank and the first leaf of each rank that has any: tree, x, y[, z], level."""
    keys = key_names(dim)
    return ranked_leaves.groupBy("rank").agg(F.min_by(F.struct(*keys), "gid").alias("f")).select("rank", *[F.col("f")[k].alias(k) for k in keys])


def owners(cells: DataFrame, first: DataFrame, dim: int) -> DataFrame:
    """cells with `owner`, the rank whose range holds the cell's first descendant. first: what positions() gives; ranks without leaves own nothing."""
    keys = key_names(dim)
    a = cut(cells.withColumn("__id", F.monotonically_increasing_id()))
    marks = first.select("tree", *Q.axes(dim), F.lit(-1).alias("level"), F.lit(None).cast("long").alias("__id"), "rank")
    both = a.select(*keys, "__id", F.lit(None).cast("int").alias("rank")).unionByName(marks)
    near = filled(both, [*sort_keys(dim), F.coalesce("__id", F.lit(-1))], "rank", "owner")
    return a.join(near.where("__id is not null").select("__id", "owner"), "__id").drop("__id")


def contained_in_rank(cells: DataFrame, first: DataFrame, dim: int) -> DataFrame:
    """cells with first_owner and last_owner, of their first and last descendants; a cell lies in one rank if these are equal."""
    a = owners(cells, first, dim).withColumnRenamed("owner", "first_owner").withColumn("__q", F.struct(*key_names(dim)))
    end = Q.last_descendant(Q.cell(dim))
    b = owners(a.select("__q", "first_owner", *[c for c in a.columns if c not in (*key_names(dim), "__q", "first_owner")], "tree", *Q.columns(end)), first, dim)
    rest = [c for c in b.columns if c not in (*key_names(dim), "__q", "owner")]
    return b.select(*[F.col("__q")[k].alias(k) for k in key_names(dim)], *rest, F.col("owner").alias("last_owner"))


def children_counts(leaves: DataFrame, dim: int, level: int) -> DataFrame:
    """tree, cell of a level with leaves inside, child number, and how many leaves each child holds."""
    q = Q.cell(dim)
    up = Q.ancestor(q, F.lit(level))
    inside = leaves.where(F.col("level") > level)
    return inside.groupBy("tree", *[c.alias(a) for c, a in zip(up.xyz, Q.axes(dim))], Q.ancestor_id(q, F.lit(level + 1)).alias("child")).agg(F.count(F.lit(1)).alias("n"))


def branches_and_leaves(forest: Forest) -> DataFrame:
    """level, branches, leaves: how many internal nodes and leaves each level has."""
    b = forest.internal().groupBy("level").agg(F.count(F.lit(1)).alias("branches"))
    n = forest.leaves.groupBy("level").agg(F.count(F.lit(1)).alias("leaves"))
    return b.join(n, "level", "full").select("level", F.coalesce("branches", F.lit(0)).alias("branches"), F.coalesce("leaves", F.lit(0)).alias("leaves"))


def search(forest: Forest, queries: DataFrame, match: Callable[[DataFrame], Column], order: Column | None = None, owner_cuts: DataFrame | None = None, alike: tuple[str, ...] = ()) -> DataFrame:
    """Leaves that queries reach top-down: every query starts at the root of its `tree` and goes on into the children of cells that match.

    queries: tree and any columns but the cell's. match sees the query's columns and the cell's (x, y[, z], level, is_leaf), and has to hold for every
    cell that contains a matching leaf. Returns the queries' columns and the leaf's keys (and `owner`, with owner_cuts from positions(); and
    sort key `visit` by `order`). All queries advance level by level; a branch that no query matches is never expanded.
    alike: the only columns that match and order look at. Queries that are equal in these are searched once, and all get what it finds.
    """
    dim, keys = forest.dim, forest.keys
    if alike:
        kinds = cut(queries.select("tree", *alike).distinct().withColumn("__kind", F.monotonically_increasing_id()))
        same = functools.reduce(lambda a, b: a & b, [queries[c].eqNullSafe(kinds[c]) for c in ("tree", *alike)])
        # a number of tasks of its own: few rows come in, but a row goes out for each query and leaf
        n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every = queries.join(kinds.hint("merge"), same).select(*[queries[c] for c in queries.columns], "__kind").repartition(n, "__kind")
        found = search(forest, kinds, match, order, owner_cuts).drop("tree", *alike).repartition(n, "__kind")
        rest = [c for c in found.columns if c != "__kind"]
        return found.join(every.hint("merge"), "__kind").select("tree", *[c for c in queries.columns if c != "tree"], *rest)
    nodes = cut(forest.internal().withColumn("is_leaf", F.lit(False)).unionByName(forest.leaves.select(*keys).withColumn("is_leaf", F.lit(True))))
    counts, tasks = level_counts(nodes), int(forest.spark.conf.get("spark.sql.shuffle.partitions"))
    own = [c for c in queries.columns if c != "tree"]
    front = queries.withColumns({a: F.lit(0).cast("long") for a in Q.axes(dim)}).withColumn("level", F.lit(0))
    found = []
    for level in range(Q.QMAX + 1):
        front = front.repartition(tasks)  # a few rows in one file grow by each level
        here = joinable(nodes.where(f"level = {level}"), counts.get(level, 0))
        seen = cut(front.join(here, keys).transform(lambda d: d.where(F.coalesce(match(d), F.lit(False)))))
        found.append(seen.where("is_leaf").drop("is_leaf"))
        going = seen.where("not is_leaf").drop("is_leaf")
        if going.isEmpty():
            break
        front = going.select("tree", *own, F.explode(Q.children(Q.cell(dim))).alias("q")).select("tree", *own, *[F.col("q")[k].alias(k) for k in keys[1:]])
    out = functools.reduce(DataFrame.unionByName, found)
    if owner_cuts is not None:
        out = owners(out, owner_cuts, dim)
    return out.withColumn("visit", order) if order is not None else out


def over_trees(queries: DataFrame, trees: int) -> DataFrame:
    """Each query once for each tree, for searches that may match in any: rows grow with the number of trees by definition."""
    return queries.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))))


def face_cells_before(m: Column, level, face: int, dim: int, base, deep: int = Q.QMAX) -> Column:
    """Cells of level `deep` on a face of the cell with key `base` and level `level` that come before key m in Morton order (2D keys).

    Digit by digit: as long as m follows the face, each child on the face before its digit adds its whole share.
    """
    axis, side = divmod(face, 2)
    on = [d for d in range(1 << dim) if (d >> axis & 1) == side]

    def step(acc: Column, k: Column) -> Column:
        d = Q.shr(m - base, dim * (F.lit(Q.MAX) - k)).bitwiseAND((1 << dim) - 1).cast("int")
        before = sum(((F.lit(c) < d).cast("long") for c in on), F.lit(0))
        n = acc["n"] + F.when(acc["alive"], before * Q.shl(1, (dim - 1) * (F.lit(deep) - k))).otherwise(0)
        return F.struct(n.alias("n"), (acc["alive"] & d.isin(*on)).alias("alive"))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("alive"))
    return F.aggregate(F.sequence(Q._int(level) + 1, F.lit(deep)), start, step, lambda a: a["n"])


def range_boundaries(first: Q.Cell, last: Q.Cell, level) -> dict[str, Column]:
    """Which faces and corners of their common level's cell the Morton range [first, last] touches, as bit masks `faces`, `corners` (2D).

    first and last are cells of the finest level inside one cell of `level`.
    """
    dim = 2
    box = Q.ancestor(first, level)
    base, lo, hi = Q.morton(box), Q.morton(first), Q.morton(last)
    step = 1 << dim * (Q.MAX - Q.QMAX)
    faces = F.lit(0)
    for f in range(2 * dim):
        hit = face_cells_before(hi + step, level, f, dim, base) > face_cells_before(lo, level, f, dim, base)
        whole = (hi + step - base) >= Q.shl(1, dim * (F.lit(Q.MAX) - Q._int(level)))  # behind the last cell no digit is left
        axis, side = divmod(f, 2)
        end_on = last.xyz[axis] + Q.length(last.level) == box.xyz[axis] + Q.length(box.level) if side else last.xyz[axis] == box.xyz[axis]
        faces = faces + F.when(F.when(whole, end_on | (Q.shl(1, (dim - 1) * (F.lit(Q.QMAX) - Q._int(level))) > face_cells_before(lo, level, f, dim, base))).otherwise(hit), 1 << f).otherwise(0)
    corners = F.lit(0)
    for c in range(1 << dim):
        m = Q.morton(Q.corner_descendant(box, c))
        corners = corners + F.when((m >= lo) & (m <= hi), 1 << c).otherwise(0)
    return {"faces": faces.cast("int"), "corners": corners.cast("int")}
