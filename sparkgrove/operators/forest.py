"""Forests: tables of leaves (tree, x, y[, z], level, payload...) that tile every tree, and the operators on them.

Leaves are unique, disjoint and complete; order is (tree, Morton key). Predicates are functions from a DataFrame of cells to a
boolean Column, so they run inside the plan. All operators return new objects; `revision` grows only if the mesh changed.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quadrant as Q
from ..plans.lineage import cut, ranked
from ..sources.topology import Topology

#: Transform rows of a topology that are broadcast at most; a larger table is joined by shuffle.
MAX_BROADCAST_ROWS = 1_000_000
#: Cells of a forest that are broadcast at most, some 40 MB of the driver; more are joined by shuffle.
MAX_BROADCAST_CELLS = 200_000
Predicate = Callable[[DataFrame], Column]
#: Levels of recursive refinement that run as one pipeline before the rows are written.
STEPS = 4


def key_names(dim: int) -> list[str]:
    return ["tree", *Q.axes(dim), "level"]


def sort_keys(dim: int, prefix: str = "") -> list[Column]:
    """Columns that order cells: tree, Morton key, level."""
    return [F.col(prefix + "tree"), Q.morton(Q.cell(dim, prefix)), F.col(prefix + "level")]


def small(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= MAX_BROADCAST_ROWS else frame


def joinable(frame: DataFrame, rows: int) -> DataFrame:
    """Cells as one side of a join, broadcast only if they are few.

    Left to itself, Spark takes an exploded table for as small as the file it comes from, and may send that to the driver instead.
    """
    return F.broadcast(frame) if rows <= MAX_BROADCAST_CELLS else frame.hint("merge")


@dataclass(frozen=True)
class Forest:
    topology: Topology
    leaves: DataFrame
    revision: int = 0

    @property
    def dim(self) -> int:
        return self.topology.dim

    @property
    def spark(self) -> SparkSession:
        return self.leaves.sparkSession

    @property
    def keys(self) -> list[str]:
        return key_names(self.dim)

    @property
    def payload(self) -> list[str]:
        return [c for c in self.leaves.columns if c not in self.keys]

    def changed(self, leaves: DataFrame, did: bool = True) -> Forest:
        return replace(self, leaves=leaves, revision=self.revision + bool(did))

    # --- creation ------------------------------------------------------------------------------------------------------
    @staticmethod
    def uniform(spark: SparkSession, topology: Topology, level: int = 0, init: dict[str, Column] | None = None) -> Forest:
        """Every tree cut into 2**(dim * level) equal leaves. init: payload columns as expressions."""
        dim = topology.dim
        if not 0 <= level * dim <= 62:
            raise ValueError("level out of range")
        per = 1 << dim * level
        id_ = F.col("id").bitwiseAND(per - 1)
        q = Q.from_linear_id(id_, level, dim)
        frame = spark.range(topology.n * per).select(Q.shr(F.col("id"), dim * level).alias("tree"), *Q.columns(q))
        return Forest(topology, frame.withColumns(init) if init else frame)

    @staticmethod
    def new(spark: SparkSession, topology: Topology, min_level: int = 0, min_leaves: int = 0, ranks: int = 1, init: dict[str, Column] | None = None) -> Forest:
        """Uniform at the least level >= min_level with at least min_leaves leaves for each rank."""
        level = max(0, min_level)
        while topology.n << topology.dim * level < min_leaves * ranks:
            level += 1
        return Forest.uniform(spark, topology, level, init)

    @staticmethod
    def of(topology: Topology, leaves: DataFrame) -> Forest:
        """From a table of leaves; coordinates and trees are widened, other columns are payload."""
        types = {c: "int" if c == "level" else "long" for c in key_names(topology.dim)}
        return Forest(topology, leaves.withColumns({c: F.col(c).cast(t) for c, t in types.items()}))

    def copy(self, payload: bool = True) -> Forest:
        return Forest(self.topology, self.leaves if payload else self.leaves.select(*self.keys))

    def reset_payload(self, init: dict[str, Column] | None = None) -> Forest:
        frame = self.leaves.select(*self.keys)
        return replace(self, leaves=frame.withColumns(init) if init else frame)

    # --- adaptation ----------------------------------------------------------------------------------------------------
    def _children(self, frame: DataFrame) -> DataFrame:
        kids = frame.select("tree", F.explode(Q.children(Q.cell(self.dim))).alias("q"), *self.payload)
        return kids.select("tree", *[F.col("q")[c].alias(c) for c in self.keys[1:]], *self.payload)

    def refine(self, where: Predicate, recursive: bool = False, max_level: int = Q.QMAX, replace_payload: dict[str, Column] | None = None) -> Forest:
        """Leaves where the predicate holds become their 2**dim children, which inherit the payload or get replace_payload.

        A null predicate does not refine. Recursive: new leaves are asked again, up to max_level. No shuffle.
        """
        keep = lambda df: F.coalesce(where(df), F.lit(False)) & (F.col("level") < max_level)
        made = lambda df: self._children(df).withColumns(replace_payload) if replace_payload else self._children(df)
        if not recursive:
            marked = self.leaves.withColumn("__go", keep(self.leaves))
            out = marked.where(~F.col("__go")).drop("__go").unionByName(made(marked.where("__go").drop("__go")))
            return self.changed(out)
        # settled rows pass through, open ones explode into their children: STEPS levels in one pipeline without a shuffle
        frame, did = self.leaves.withColumn("__open", F.lit(True)), False
        while True:
            for _ in range(STEPS):
                frame = self._step(frame, keep, replace_payload or {})
            frame = cut(frame.withColumn("__go", F.col("__open") & keep(frame)))
            seen = frame.agg(F.bool_or("__go"), F.bool_or("__made") if "__made" in frame.columns else F.lit(False)).first()
            did = did or bool(seen[1])
            frame = frame.drop("__go", "__made")
            if not seen[0]:
                return self.changed(frame.drop("__open"), did)

    def _step(self, frame: DataFrame, keep: Predicate, fresh: dict[str, Column]) -> DataFrame:
        """One level of recursive refinement: open rows that the predicate holds for are replaced by their children."""
        made = F.col("__made") if "__made" in frame.columns else F.lit(False)
        frame = frame.withColumn("__made", made).withColumn("__go", F.col("__open") & keep(frame))
        q = Q.cell(self.dim)
        one = frame.select("*", F.explode(F.when(F.col("__go"), Q.children(q)).otherwise(F.array(Q.packed(q)))).alias("__q"))
        cells = one.select("tree", *[F.col("__q")[c].alias(c) for c in self.keys[1:]], *self.payload, F.col("__go").alias("__open"), (F.col("__made") | F.col("__go")).alias("__made"))
        return cells.withColumns({p: F.when(F.col("__open"), c).otherwise(F.col(p)) for p, c in fresh.items()}) if fresh else cells

    def coarsen(self, where: Predicate, recursive: bool = False, orphans: bool = False, replace_payload: dict[str, Column] | None = None) -> Forest:
        """Complete families whose parent satisfies the predicate become that parent.

        The predicate sees the parent's cell and, for each payload column, the array of the children's values in order; the
        parent's payload is the first child's value, or replace_payload over the same arrays. One aggregate by parent; recursive: one
        for each level, finest first. orphans only matters to callbacks with side effects, which predicates have not.
        """

        def families(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
            up = Q.parent(Q.cell(self.dim))
            key = [F.col("tree"), *[c.alias(n) for c, n in zip(up.xyz, Q.axes(self.dim))], (F.col("level") - 1).alias("level")]
            cid = Q.child_id(Q.cell(self.dim))
            kids = frame.where("level > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), *([F.sort_array(F.collect_list(F.struct(cid.alias("c"), *self.payload))).alias("__kids")] if self.payload else []))
            kids = kids.where(F.col("__n") == 1 << self.dim)
            for p in self.payload:
                kids = kids.withColumn(p, F.col(f"__kids.{p}"))
            go = kids.where(F.coalesce(where(kids), F.lit(False)))
            keep = {p: (replace_payload or {}).get(p, F.get(p, 0)) for p in self.payload}
            parents = go.select(*self.keys, *[c.alias(p) for p, c in keep.items()])
            above = [c.alias(f"__{n}") for n, c in zip(self.keys, ["tree", *up.xyz, F.col("level") - 1]) if n != "tree"]
            gone = frame.select("*", F.col("tree").alias("__tree"), *above)
            on = [f"__{n}" for n in self.keys]
            return gone.join(parents.select(*[F.col(n).alias(f"__{n}") for n in self.keys]), on, "left_anti").select(*frame.columns), parents

        if not recursive:
            rest, parents = families(self.leaves)
            return self.changed(rest.unionByName(parents))
        frame = cut(self.leaves)
        top = frame.agg(F.max("level")).first()[0] or 0
        did, done = False, []
        for level in range(top, 0, -1):
            rest, parents = families(frame.where(f"level = {level}"))
            parents = cut(parents)
            done.append(rest)
            did = did or not parents.isEmpty()
            frame = frame.where(f"level < {level}").unionByName(parents)
        return self.changed(functools.reduce(DataFrame.unionByName, [*done, frame]), did)

    def internal(self) -> DataFrame:
        """Strict ancestors of all leaves (tree, x, y[, z], level), each once."""
        q = Q.cell(self.dim)
        up = self.leaves.where("level > 0").select("tree", *Q.columns(Q.parent(q))).distinct()
        spread = up.select("tree", *Q.axes(self.dim), F.explode(F.sequence(F.lit(0), "level")).alias("level"))
        return spread.select("tree", *Q.columns(Q.ancestor(Q.cell(self.dim), F.col("level")))).distinct()

    def balance(self, kind: str = "corner", across_trees: bool = True, replace_payload: dict[str, Column] | None = None) -> Forest:
        """The least refinement in which leaves that meet by face, edge or corner differ by at most one level.

        One sweep over levels of internal nodes, finest first: each asks for the parents of its same-size neighbours. New
        leaves inherit the payload of the leaf that held them, or get replace_payload.
        """
        base = Forest(self.topology, cut(self.leaves))
        inner = cut(base.internal())
        top = max(levels_of(inner), default=-1)
        parts, nodes = [], None
        for high in range(top, -1, -STEPS):
            # levels high, high - 1, ... in one job: each follows from the one before, whose shuffle is reused
            chain = []
            for level in range(high, max(-1, high - STEPS), -1):
                here = inner.where(f"level = {level}")
                nodes = here if nodes is None else here.unionByName(self._asked(nodes, kind, across_trees)).distinct()
                chain.append(nodes)
            done = cut(functools.reduce(DataFrame.unionByName, chain))
            parts.append(done)
            nodes = done.where(F.col("level") == max(0, high - STEPS + 1))
        if not parts:
            return self
        split = functools.reduce(DataFrame.unionByName, parts)
        kids = split.select("tree", F.explode(Q.children(Q.cell(self.dim))).alias("q")).select("tree", *[F.col("q")[c].alias(c) for c in self.keys[1:]])
        roots = self.topology.tree_frame(self.spark).select("tree", *[F.lit(0).cast("long").alias(a) for a in Q.axes(self.dim)], F.lit(0).alias("level"))
        cells = kids.unionByName(roots).join(split, self.keys, "left_anti")
        if not self.payload:
            out = cells
        else:
            same = cells.join(base.leaves, self.keys)
            fresh = cells.join(base.leaves.select(*self.keys), self.keys, "left_anti")
            given = inherit(fresh, base.leaves, self.dim)
            out = same.unionByName(given.withColumns(replace_payload) if replace_payload else given)
        out = cut(out)
        return self.changed(out, out.count() != base.leaves.count())

    def _asked(self, nodes: DataFrame, kind: str, across_trees: bool) -> DataFrame:
        """Parents of internal nodes of one level and of their same-size neighbours: internal nodes of the balanced forest too."""
        up = Q.parent(Q.cell(self.dim))
        near = same_size_neighbors(nodes, self.topology, kind, across_trees).drop("way")
        return near.select("tree", *Q.columns(up)).unionByName(nodes.select("tree", *Q.columns(up)))

    # --- order, partition and checks -----------------------------------------------------------------------------------------
    def numbered(self, weight: Column | None = None) -> DataFrame:
        """Leaves with their global number gid in (tree, Morton) order, and with weight `gid_weight`, its inclusive prefix sum."""
        frame = self.leaves if weight is None else self.leaves.withColumn("__w", weight)
        return ranked(frame, sort_keys(self.dim), "gid", "__w" if weight is not None else None).drop("__w")

    def partition(self, ranks: int, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Leaves with gid and rank, and the cuts (rank, first_gid), ranks + 1 rows.

        Without weights rank p starts at N * p // ranks. With weights it starts at the first leaf whose inclusive prefix weight
        reaches W * p / ranks; if all weights are 0 the cuts are those without weights.
        """
        frame = cut(self.numbered(weight))
        n = frame.count()
        firsts = [n * p // ranks for p in range(ranks + 1)]
        if weight is not None and n:
            total = frame.agg(F.max("gid_weight")).first()[0]
            if total:
                # rank p starts at the first leaf whose inclusive prefix reaches W * p / ranks; leaves count by the goals they reach
                reach = F.least(F.lit(ranks), F.floor(F.col("gid_weight") * ranks / F.lit(total))).cast("int")
                starts = sorted((r["r"], r["g"]) for r in frame.groupBy(reach.alias("r")).agg(F.min("gid").alias("g")).collect())
                for p in range(1, ranks):
                    firsts[p] = next((g for r, g in starts if r >= p), n)
        return with_rank(frame.drop("gid_weight"), firsts), cut_frame(self.spark, firsts)

    def partition_given(self, counts: list[int]) -> DataFrame:
        """Leaves with gid and the rank of prescribed numbers of leaves per rank; ValueError if these do not add up."""
        frame = cut(self.numbered())
        firsts = [0, *np.cumsum(counts).tolist()]
        if firsts[-1] != frame.count():
            raise ValueError("counts do not add up to the number of leaves")
        return with_rank(frame, firsts)

    def family_safe(self, firsts: list[int]) -> list[int]:
        """Cuts moved so that no complete family is split: the family goes to the rank that holds most of it, ties to the lower."""
        if len(firsts) < 3:
            return list(firsts)
        frame = self.numbered()
        up = Q.parent(Q.cell(self.dim))
        marks = self.spark.createDataFrame([(int(g),) for g in sorted(set(firsts[1:-1]))], "g long")
        fam = frame.where("level > 0").groupBy("tree", *[c.alias(a) for c, a in zip(up.xyz, Q.axes(self.dim))], "level").agg(F.min("gid").alias("lo"), F.count(F.lit(1)).alias("n")).where(f"n = {1 << self.dim}")
        inside = fam.select("lo", "n", F.explode(F.sequence(F.col("lo") + 1, F.col("lo") + F.col("n") - 1)).alias("g"))
        hit = inside.join(small(marks, len(firsts)), "g").collect()  # at most one family a cut
        moved = {r["g"]: r["lo"] if r["lo"] + r["n"] - r["g"] > r["g"] - r["lo"] else r["lo"] + r["n"] for r in hit}
        return [moved.get(g, g) for g in firsts]

    def checksum(self) -> int:
        """Adler-32 of x, y[, z], level as big-endian 32-bit words in order; independent of partitioning.

        3D coordinates of levels up to 18 are shifted right by 11.
        """
        return folded(self.leaves, self.dim, sort_keys(self.dim))

    def counts_by_tree(self) -> DataFrame:
        """tree, n of each tree that has leaves, and the cumulative count before it."""
        per = self.leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
        return ranked(per, [F.col("tree")], "rn", "n").select("tree", "n", (F.col("rn_weight") - F.col("n")).alias("before"))

    def level_histogram(self) -> DataFrame:
        return self.leaves.groupBy("tree", "level").agg(F.count(F.lit(1)).alias("n"))

    def validity(self) -> dict[str, int]:
        """Numbers of leaves that break an invariant: invalid cells, unknown trees, overlaps or gaps behind a leaf, and trees without a first or last cell.

        Leaves are compared with the next in the global order by a join on their numbers, so no tree is ordered in one task.
        """
        q, n = Q.cell(self.dim), self.topology.n
        frame = cut(self.numbered().select("gid", *self.keys))
        first, last = F.lit(True), F.lit(True)
        for c in q.xyz:
            first, last = first & (c == 0), last & (c + Q.length(q.level) == Q.ROOT)
        bad = frame.agg(F.count_if(~F.coalesce(Q.is_valid(q), F.lit(False))).alias("invalid"), F.count_if(~F.coalesce(F.col("tree").between(0, n - 1), F.lit(False))).alias("unknown_trees"), F.max("level").alias("top")).first()
        following = frame.select((F.col("gid") - 1).alias("gid"), *[F.col(c).alias(f"n{c}") for c in self.keys])
        nxt = Q.cell(self.dim, "n")
        pair = frame.join(following, "gid").where("tree = ntree")
        broken = pair.agg(F.count_if(Q.overlaps(q, nxt)).alias("overlaps"), F.count_if(~Q.overlaps(q, nxt) & ~Q.is_next(q, nxt)).alias("gaps")).first()
        closed = frame.where(F.col("tree").between(0, n - 1)).groupBy("tree").agg(F.bool_or(first).alias("first"), F.bool_or(last).alias("last")).where("first and last").count()
        return {"invalid": bad["invalid"], "unknown_trees": bad["unknown_trees"], "overlaps": broken["overlaps"] or 0, "gaps": broken["gaps"] or 0, "open_trees": n - closed, "top": bad["top"] or 0}

    def is_valid(self) -> bool:
        found = self.validity()
        return not any(v for k, v in found.items() if k != "top")

    def equals(self, other: Forest, payload: bool = False) -> bool:
        columns = self.leaves.columns if payload else self.keys
        if self.topology.n != other.topology.n or (payload and set(self.payload) != set(other.payload)):
            return False
        a, b = self.leaves.select(*columns), other.leaves.select(*columns)
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# --- helpers that work on tables of cells -------------------------------------------------------------------------------------
def adler_combine(a: int, b: int, size: int) -> int:
    """Adler-32 of two byte strings from those of each and the size of the second."""
    m = 65521
    low = (a & 0xFFFF) + (b & 0xFFFF) - 1
    high = (a >> 16) + (b >> 16) + size * ((a & 0xFFFF) - 1)
    return (high % m) << 16 | low % m


def folded(cells: DataFrame, dim: int, order: list[Column]) -> int:
    """Adler-32 of the cells' x, y[, z], level in an order. Each range partition folds its own rows; the driver combines one value per partition."""
    axes, shift = Q.axes(dim), 11 if dim == 3 else 0
    frame = cells.repartitionByRange(*order).sortWithinPartitions(*order).select(*axes, "level", F.spark_partition_id().alias("p"))

    def fold(batches):
        import pandas as pd

        adler, size, part = 1, 0, None
        for pdf in batches:
            if len(pdf):
                part = int(pdf["p"].iloc[0])
                level = pdf["level"].to_numpy()
                down = np.where(level <= 18, shift, 0)
                words = np.stack([pdf[a].to_numpy().astype(np.int64) >> down for a in axes] + [level], axis=1).astype(">u4").tobytes()
                adler, size = zlib.adler32(words, adler), size + len(words)
        if part is not None:
            yield pd.DataFrame({"p": [part], "adler": [adler], "size": [size]})

    out = 1
    for r in sorted(frame.mapInPandas(fold, "p int, adler long, size long").collect(), key=lambda r: r["p"]):
        out = adler_combine(out, r["adler"], r["size"])
    return out


def next_nonempty(firsts: list[int], rank: int) -> int:
    """The first rank after `rank` that has leaves, or the number of ranks; firsts: cuts, ranks + 1 entries."""
    return next((p for p in range(rank + 1, len(firsts) - 1) if firsts[p + 1] > firsts[p]), len(firsts) - 1)


def cut_frame(spark: SparkSession, firsts: list[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(firsts)), "rank int, first_gid long")


def with_rank(frame: DataFrame, firsts: list[int], gid: str = "gid") -> DataFrame:
    """frame with the rank whose range of gids holds each row; firsts: one entry a rank, from 0, and the end.

    An equi-join: gids and ranges meet in blocks of the mean length of a range. Ranges lie in at most two blocks each on average, so a row
    compares with about two ranges. Rows beyond the end get the last rank.
    """
    ranks = len(firsts) - 1
    spans = [(p, firsts[p], firsts[p + 1] if p + 1 < ranks else None) for p in range(ranks) if firsts[p] < firsts[p + 1] or p + 1 == ranks]
    step = max(1, -(-firsts[-1] // max(1, ranks)))
    rows = [(b, p, lo, hi) for p, lo, hi in spans for b in range(lo // step, (firsts[-1] if hi is None else hi - 1) // step + 1)]
    table = frame.sparkSession.createDataFrame(rows, "__block long, rank int, __lo long, __hi long")
    block = F.least(F.floor(F.col(gid) / step), F.lit(firsts[-1] // step))
    inside = (F.col(gid) >= F.col("__lo")) & (F.col("__hi").isNull() | (F.col(gid) < F.col("__hi")))
    return frame.withColumn("__block", block).join(small(table, len(rows)), "__block").where(inside).drop("__block", "__lo", "__hi")


def same_size_neighbors(frame: DataFrame, topology: Topology, kind: str, across_trees: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """tree, x, y[, z], level of every same-size neighbour of every cell, moved into its tree, with the columns carry.

    `way` is the base-3 code of the direction in the cell's own tree. Neighbours beyond a boundary are left out; across a
    tree's edge or corner there may be several. One explode, and a join with the topology's transforms (broadcast up to MAX_BROADCAST_ROWS).
    """
    dim = topology.dim
    q = Q.cell(dim)
    most = {"face": 1, "edge": min(2, dim), "corner": dim}[kind]
    ways = [[i // 3**a % 3 - 1 for a in range(dim)] for i in range(3**dim)]
    ways = [(i, w) for i, w in enumerate(ways) if 0 < sum(map(abs, w)) <= most]
    n = Q.length(q.level)
    cells = F.array(*[F.struct(F.lit(i).alias("way"), *[(c + n * s if s else c).alias(a) for c, s, a in zip(q.xyz, w, Q.axes(dim))]) for i, w in ways])
    out = frame.select("tree", "level", *carry, F.explode(cells).alias("n"))
    out = out.select("tree", "level", *carry, F.col("n.way").alias("way"), *[F.col(f"n.{a}").alias(a) for a in Q.axes(dim)])
    sides = [F.when(F.col(a) < 0, -1).when(F.col(a) >= Q.ROOT, 1).otherwise(0) for a in Q.axes(dim)]
    code = sum((s + 1) * 3**i for i, s in enumerate(sides)).cast("int")
    middle = sum(3**i for i in range(dim))
    out = out.withColumn("__way", code)
    inside = out.where(F.col("__way") == middle).drop("__way")
    if not across_trees:
        return inside.select("tree", *Q.axes(dim), "level", "way", *carry)
    rows = topology.transform_rows()
    if not rows:
        return inside.select("tree", *Q.axes(dim), "level", "way", *carry)
    moves = small(frame.sparkSession.createDataFrame(rows, "t_tree long, t_way int, ntree long, perm array<int>, sign array<int>, shift array<int>"), len(rows))
    gone = out.where(F.col("__way") != middle).join(moves, (F.col("tree") == F.col("t_tree")) & (F.col("__way") == F.col("t_way")))
    moved = Q.transform(Q.cell(dim), F.col("perm"), F.col("sign"), F.col("shift"))
    gone = gone.select(F.col("ntree").alias("tree"), *Q.columns(moved), "way", *carry)
    return inside.select("tree", *Q.axes(dim), "level", "way", *carry).unionByName(gone)


def levels_of(leaves: DataFrame) -> list[int]:
    """Distinct levels, at most 31 values."""
    return sorted(level_counts(leaves))


def level_counts(cells: DataFrame) -> dict[int, int]:
    """Number of cells of each level, at most 31 entries."""
    return {r[0]: r[1] for r in cells.groupBy("level").agg(F.count(F.lit(1))).collect()}


def containing(cells: DataFrame, leaves: DataFrame, dim: int, keep: str = "inner", levels: list[int] | None = None, prefix: str = "l_") -> DataFrame:
    """Each cell with the leaf that holds it (columns prefixed): an equi-join on the ancestors of the levels present.

    This replaces a range join: cells are spread over the leaves' levels, at most theirs, and joined on masked coordinates.
    Cells without such a leaf are dropped ("inner"); disjoint leaves give at most one row.
    """
    counts = level_counts(leaves)
    levels = sorted(counts) if levels is None else levels
    at = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v <= F.col("level")) if levels else F.array().cast("array<int>")
    spread = cells.withColumn("__l", F.explode(at))
    up = Q.ancestor(Q.cell(dim), F.col("__l"))
    spread = spread.withColumns({f"__{a}": c for a, c in zip(Q.axes(dim), up.xyz)})
    right = leaves.select(*[F.col(c).alias(prefix + c) for c in leaves.columns])
    on = [spread["tree"] == right[f"{prefix}tree"], spread["__l"] == right[f"{prefix}level"]] + [spread[f"__{a}"] == right[f"{prefix}{a}"] for a in Q.axes(dim)]
    return spread.join(joinable(right, sum(counts.values())), on).drop("__l", *[f"__{a}" for a in Q.axes(dim)])


def inherit(cells: DataFrame, leaves: DataFrame, dim: int) -> DataFrame:
    """Cells with the payload of the leaf that holds each."""
    keys = key_names(dim)
    payload = [c for c in leaves.columns if c not in keys]
    return containing(cells, leaves, dim).select(*keys, *[F.col(f"l_{p}").alias(p) for p in payload])


def linearize(cells: DataFrame, dim: int) -> DataFrame:
    """Cells without repeats and without ancestors of others: where cells overlap, the finest stay.

    Ancestors are found by an equi-join with the strict ancestors of all cells, so no tree is ordered in one task.
    """
    keys = key_names(dim)
    one = cells.dropDuplicates(keys)
    up = Forest(_Shape(dim), one).internal()
    return one.join(up, keys, "left_anti")


class _Shape:
    """Stands in for a topology where only the dimension matters."""

    def __init__(self, dim: int):
        self.dim = dim


def complete(cells: DataFrame, topology: Topology) -> Forest:
    """The coarsest forest that has all the given disjoint cells as leaves; gaps get the largest cells that fit.

    Every child of a strict ancestor of a cell that is neither such an ancestor nor a cell is a gap's leaf.
    """
    dim, keys = topology.dim, key_names(topology.dim)
    base = Forest.of(topology, linearize(cells, dim))
    inner = cut(base.internal())
    kids = inner.select("tree", F.explode(Q.children(Q.cell(dim))).alias("q")).select("tree", *[F.col("q")[c].alias(c) for c in keys[1:]])
    roots = topology.tree_frame(cells.sparkSession).select("tree", *[F.lit(0).cast("long").alias(a) for a in Q.axes(dim)], F.lit(0).alias("level"))
    out = kids.unionByName(roots).join(inner, keys, "left_anti").dropDuplicates(keys)
    return Forest(topology, out.join(base.leaves, keys, "left") if base.payload else out)


def complete_region(spark: SparkSession, first: tuple, last: tuple, dim: int, tree: int = 0) -> DataFrame:
    """The coarsest cells strictly between two cells (x, y[, z], level) of one tree, in driver-sized output: O(levels * 2**dim)."""
    ends = spark.createDataFrame([(tree, *first), (tree, *last)], f"tree long, {', '.join(f'{a} long' for a in Q.axes(dim))}, level int")
    whole = complete(ends, _OneTree(dim, tree))
    m = Q.morton(Q.cell(dim))
    low, high = (spark.createDataFrame([e], f"{', '.join(f'{a} long' for a in Q.axes(dim))}, level int").select(m.alias("m")).first()[0] for e in (first, last))
    lit = (lambda v: F.lit(v)) if dim == 2 else (lambda v: F.struct(F.lit(v["hi"]).alias("hi"), F.lit(v["lo"]).alias("lo")))
    return whole.leaves.where((m > lit(low)) & (m < lit(high))).join(ends, key_names(dim), "left_anti")


class _OneTree(_Shape):
    def __init__(self, dim: int, tree: int):
        super().__init__(dim)
        self.tree, self.n = tree, 1

    def tree_frame(self, spark):
        return spark.range(self.tree, self.tree + 1).toDF("tree")


def points_forest(points: DataFrame, topology: Topology, max_points: int, max_level: int = 12) -> Forest:
    """A forest whose leaves hold at most max_points points each (tree, x, y[, z]), down to max_level; payload n: points inside.

    A cell is split if it holds more. All levels are counted in one aggregate over the points' ancestors; max_points < 0 splits nothing.
    Points that repeat count each; points on the far side of the root are clamped inside; an empty table gives roots.
    """
    dim, keys = topology.dim, key_names(topology.dim)
    inside = points.select(F.col("tree").cast("long").alias("tree"), *[F.least(F.greatest(F.col(a).cast("long"), F.lit(0)), F.lit(Q.ROOT - 1)).alias(a) for a in Q.axes(dim)])
    cells = inside.withColumn("level", F.lit(max_level))
    finest = cells.select("tree", *Q.columns(Q.ancestor(Q.cell(dim), F.lit(max_level)))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    spread = finest.select("tree", *Q.axes(dim), F.explode(F.sequence(F.lit(0), F.lit(max_level))).alias("level"), "n")
    counted = cut(spread.select("tree", *Q.columns(Q.ancestor(Q.cell(dim), F.col("level"))), "n").groupBy(*keys).agg(F.sum("n").alias("n")))
    split = counted.where((F.col("n") > max_points) & (F.col("level") < max_level) & F.lit(max_points >= 0)).select(*keys)
    kids = split.select("tree", F.explode(Q.children(Q.cell(dim))).alias("q")).select("tree", *[F.col("q")[c].alias(c) for c in keys[1:]])
    roots = topology.tree_frame(points.sparkSession).select("tree", *[F.lit(0).cast("long").alias(a) for a in Q.axes(dim)], F.lit(0).alias("level"))
    leaves = kids.unionByName(roots).join(split.hint("merge"), keys, "left_anti").join(counted.hint("merge"), keys, "left")
    return Forest(topology, leaves.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))))


def image_forest(pixels: DataFrame, value: str, topology: Topology, tolerance: float, max_level: int = 12) -> Forest:
    """A forest refined where an image varies: a cell is split while its pixels (tree, x, y[, z], value) differ by more than tolerance, down to max_level.

    Payload: low and high, the extremes inside, and n pixels; low and high are null in cells without pixels. Null values count for nothing.
    All levels come from one aggregate over the pixels' ancestors, after one over the finest cells.
    """
    dim, keys = topology.dim, key_names(topology.dim)
    inside = pixels.select(F.col("tree").cast("long").alias("tree"), *[F.least(F.greatest(F.col(a).cast("long"), F.lit(0)), F.lit(Q.ROOT - 1)).alias(a) for a in Q.axes(dim)], F.lit(max_level).alias("level"), F.col(value).alias("low"), F.col(value).alias("high"), F.lit(1).cast("long").alias("n"))
    extremes = [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")]
    finest = inside.select("tree", *Q.columns(Q.ancestor(Q.cell(dim), F.lit(max_level))), "low", "high", "n").groupBy(*keys).agg(*extremes)
    spread = finest.select("tree", *Q.axes(dim), F.explode(F.sequence(F.lit(0), F.lit(max_level))).alias("level"), "low", "high", "n")
    seen = cut(spread.select("tree", *Q.columns(Q.ancestor(Q.cell(dim), F.col("level"))), "low", "high", "n").groupBy(*keys).agg(*extremes))
    split = seen.where((F.col("high") - F.col("low") > tolerance) & (F.col("level") < max_level)).select(*keys)
    kids = split.select("tree", F.explode(Q.children(Q.cell(dim))).alias("q")).select("tree", *[F.col("q")[c].alias(c) for c in keys[1:]])
    roots = topology.tree_frame(pixels.sparkSession).select("tree", *[F.lit(0).cast("long").alias(a) for a in Q.axes(dim)], F.lit(0).alias("level"))
    leaves = kids.unionByName(roots).join(split.hint("merge"), keys, "left_anti").join(seen.hint("merge"), keys, "left")
    return Forest(topology, leaves.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))))
