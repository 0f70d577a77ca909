"""The adaptation cycle in one object: marks by leaf, refine, coarsen, balance, then a weighted partition."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..sources import topology as T
from .adjacency import ghosts, mesh
from .forest import Forest, containing


@dataclass(frozen=True)
class Adaptive:
    """A balanced forest whose leaves carry `age`, the cycles since they were made. hollow: without ghost and mesh."""

    forest: Forest
    kind: str = "corner"
    delay: int = 0
    keep_families: bool = False
    hollow: bool = False
    ranks: int = 1
    firsts: tuple = ()
    marks: DataFrame | None = field(default=None, compare=False)

    @staticmethod
    def new(spark: SparkSession, domain: T.Topology | str, level: int = 0, dim: int = 2, **options) -> Adaptive:
        """On a topology or a domain of the catalogue, uniform at a level."""
        top = T.by_name(domain, dim) if isinstance(domain, str) else domain
        return Adaptive(Forest.uniform(spark, top, level, {"age": F.lit(0)}), **options)

    @staticmethod
    def of(forest: Forest, **options) -> Adaptive:
        """Takes over a forest."""
        leaves = forest.leaves if "age" in forest.payload else forest.leaves.withColumn("age", F.lit(0))
        return Adaptive(replace(forest, leaves=leaves), **options)

    def hollow_copy(self) -> Adaptive:
        return replace(self, hollow=True, marks=None)

    def with_options(self, **options) -> Adaptive:
        """delay: cycles that a new leaf waits before it can be coarsened; keep_families: partitions do not split families."""
        return replace(self, **options)

    # --- marks --------------------------------------------------------------------------------------------------------------
    def _mark(self, cells: DataFrame, sign: int) -> Adaptive:
        order = 0 if self.marks is None else (self.marks.agg(F.max("order")).first()[0] or 0) + 1
        new = cells.select(*self.forest.keys, F.lit(sign).alias("sign"), F.lit(order).alias("order")).distinct()
        return replace(self, marks=new if self.marks is None else self.marks.unionByName(new))

    def mark_refine(self, cells: DataFrame) -> Adaptive:
        """Leaves (by key) to refine; the last mark of a leaf counts."""
        return self._mark(cells, 1)

    def mark_coarsen(self, cells: DataFrame) -> Adaptive:
        """Leaves to coarsen; a family becomes its parent if all its leaves are marked and old enough."""
        return self._mark(cells, -1)

    def adapt(self) -> tuple[Adaptive, DataFrame]:
        """After refining, coarsening and balancing the marked leaves; and the leaves that are new, with `change` 1 or -1."""
        f, keys = self.forest, self.forest.keys
        if self.marks is None:
            return self, f.leaves.select(*keys).withColumn("change", F.lit(0)).limit(0)
        last = self.marks.groupBy(*keys).agg(F.max_by("sign", "order").alias("sign"))
        flagged = cut(f.leaves.join(last, keys, "left").withColumn("sign", F.coalesce("sign", F.lit(0))).withColumn("age", F.col("age") + 1))
        old = Forest(f.topology, flagged)
        fine = old.refine(lambda d: F.col("sign") == 1, replace_payload={"sign": F.lit(0), "age": F.lit(0)})
        ripe = lambda d: F.forall("sign", lambda s: s == -1) & F.forall("age", lambda a: a > self.delay)
        coarse = fine.coarsen(ripe, replace_payload={"sign": F.lit(0), "age": F.lit(0)})
        done = Forest(f.topology, cut(coarse.leaves)).balance(self.kind, replace_payload={"age": F.lit(0), "sign": F.lit(0)})
        now = cut(done.leaves.drop("sign"))
        fresh = cut(now.select(*keys).join(f.leaves.select(*keys), keys, "left_anti"))
        finer = containing(fresh, f.leaves.select(*keys), f.dim).select(*keys)
        changed = finer.withColumn("change", F.lit(1)).unionByName(fresh.join(finer, keys, "left_anti").withColumn("change", F.lit(-1)))
        after = replace(self, forest=Forest(f.topology, now, f.revision + (not fresh.isEmpty())), marks=None)
        return after, changed

    # --- partition ------------------------------------------------------------------------------------------------------------
    def partition(self, ranks: int, exponent: int = 0) -> tuple[Adaptive, DataFrame, dict[int, tuple[int, int]]]:
        """With weights 2**(level * exponent): this with its cuts, leaves with gid and rank, and for each rank the range of gids (first, length) it keeps."""
        weight = None if exponent == 0 else F.pow(F.lit(2.0), F.col("level") * exponent).cast("long")
        leaves, cuts = self.forest.partition(ranks, weight)
        firsts = [r["first_gid"] for r in sorted(cuts.collect(), key=lambda r: r["rank"])]  # ranks + 1 rows
        if self.keep_families:
            from .forest import with_rank

            firsts = self.forest.family_safe(firsts)
            leaves = with_rank(leaves.drop("rank"), firsts)
        before = list(self.firsts) if len(self.firsts) == len(firsts) else firsts
        kept = {p: (lo := max(before[p], firsts[p]), max(0, min(before[p + 1], firsts[p + 1]) - lo)) for p in range(ranks)}
        return replace(self, ranks=ranks, firsts=tuple(firsts)), leaves, kept

    def ranked(self) -> DataFrame:
        return self.forest.partition(self.ranks)[0]

    def ghost(self) -> DataFrame:
        """Ghost leaves of every rank; ValueError if hollow."""
        if self.hollow:
            raise ValueError("a hollow object has no ghost layer")
        return ghosts(cut(self.ranked()), self.forest.topology, self.kind)

    def mesh(self) -> DataFrame:
        if self.hollow:
            raise ValueError("a hollow object has no mesh")
        return mesh(cut(self.forest.numbered()), self.forest.topology)

    def leaves(self):
        """Leaves in order, one at a time, fetched by partition."""
        return self.forest.numbered().orderBy("gid").toLocalIterator()


class Builder:
    """Collects leaves, in any order and with repeats, and completes them to a forest."""

    def __init__(self, topology: T.Topology):
        self.topology, self.parts = topology, []

    def add(self, cells: DataFrame) -> Builder:
        self.parts.append(cells.withColumn("added", F.lit(True)))
        return self

    def complete(self) -> Forest:
        """The coarsest forest with all added leaves (the finest where they overlap); payload `added` is false for gaps."""
        from functools import reduce

        from .forest import complete

        if not self.parts:
            raise ValueError("nothing was added")
        out = complete(reduce(DataFrame.unionByName, self.parts), self.topology)
        return replace(out, leaves=out.leaves.withColumn("added", F.coalesce("added", F.lit(False))))


def weight_by_level(exponent: int):
    return F.pow(F.lit(2.0), F.col("level") * exponent).cast("long")


def moved(before: list[int], after: list[int]) -> int:
    """Leaves that change rank between two lists of cuts."""
    return before[-1] - sum(max(0, min(b1, a1) - max(b0, a0)) for b0, b1, a0, a1 in zip(before, before[1:], after, after[1:]))


def transfer(data: DataFrame, ranked_leaves: DataFrame) -> DataFrame:
    """Per-leaf data (gid, any columns, arrays of items included) with the rank that holds its leaf now."""
    return data.join(ranked_leaves.select("gid", "rank"), "gid")

