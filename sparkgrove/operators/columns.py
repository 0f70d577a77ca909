"""Column forests: a 2D forest of columns, each cut into layers along z by binary splits: tree, x, y, level, z, zlevel.

Columns and layers adapt on their own. A layer is a 1D cell, z a multiple of its length; a column's root may be several
layers high (roots at zlevel 0 follow each other).
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quadrant as Q
from ..plans.lineage import cut, ranked
from ..sources.topology import Topology
from . import adjacency
from .forest import Forest, Predicate, adler_combine, containing, key_names, small, sort_keys, with_rank

COLUMN = key_names(2)


def _zlen(level) -> Column:
    return Q.length(level)


def _zmask(z: Column, level) -> Column:
    n = F.lit(Q.MAX) - Q._int(level)
    return Q.shl(Q.shr(z, n), n)


@dataclass(frozen=True)
class Columns:
    topology: Topology
    layers: DataFrame
    roots: int = 1

    @staticmethod
    def new(spark: SparkSession, topology: Topology, level: int = 0, zlevel: int = 0, roots: int = 1) -> Columns:
        return Columns.over(Forest.uniform(spark, topology, level), zlevel, roots)

    @staticmethod
    def over(forest: Forest, zlevel: int = 0, roots: int = 1) -> Columns:
        """Every leaf of a 2D forest as a column of equal layers."""
        n = roots << zlevel
        at = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        cells = forest.leaves.select(*COLUMN, at.alias("__i"))
        return Columns(forest.topology, cells.select(*COLUMN, (F.col("__i") * (Q.ROOT >> zlevel)).alias("z"), F.lit(zlevel).alias("zlevel")), roots)

    @property
    def payload(self) -> list[str]:
        return [c for c in self.layers.columns if c not in (*COLUMN, "z", "zlevel")]

    def columns(self) -> Forest:
        """The columns as a 2D forest."""
        return Forest(self.topology, self.layers.select(*COLUMN).distinct())

    # --- adaptation ---------------------------------------------------------------------------------------------------------
    def refine_columns(self, where: Predicate, recursive: bool = False, max_level: int = Q.QMAX) -> Columns:
        """Columns where the predicate holds become four, each with the same layers."""
        frame = self.layers
        after = self.columns().refine(where, recursive, max_level).leaves
        return replace(self, layers=self._spread(frame, after))

    def _spread(self, frame: DataFrame, after: DataFrame) -> DataFrame:
        """Layers of finer columns: those of the column that holds each."""
        old = frame.select(*COLUMN).distinct()
        held = containing(after, old, 2).select(*COLUMN, *[F.col("l_" + k) for k in COLUMN])
        inner = frame.select(*[F.col(k).alias("l_" + k) for k in COLUMN], "z", "zlevel", *self.payload)
        return held.join(inner, ["l_" + k for k in COLUMN]).select(*frame.columns)

    def refine_layers(self, where: Predicate, recursive: bool = False, max_level: int = Q.QMAX) -> Columns:
        """Layers where the predicate holds become two."""
        frame = self.layers.withColumn("__open", F.lit(True))
        while True:
            marked = frame.withColumn("__go", F.col("__open") & F.coalesce(where(frame), F.lit(False)) & (F.col("zlevel") < max_level))
            half = Q.shr(_zlen(F.col("zlevel")), 1)
            kids = F.when(F.col("__go"), F.array(F.col("z"), F.col("z") + half)).otherwise(F.array("z"))
            frame = marked.withColumn("__z", F.explode(kids)).select(*COLUMN, F.col("__z").alias("z"), (F.col("zlevel") + F.col("__go").cast("int")).alias("zlevel"), *self.payload, F.col("__go").alias("__open"))
            if not recursive:
                break
            frame = cut(frame)
            if frame.where("__open").isEmpty():
                break
        return replace(self, layers=frame.drop("__open"))

    def coarsen_layers(self, where: Predicate, recursive: bool = False) -> Columns:
        """Pairs of sibling layers whose parent (z, zlevel, arrays of payload) satisfies the predicate become it; payload: the lower one's."""
        frame = cut(self.layers)
        top = frame.agg(F.max("zlevel")).first()[0] or 0
        done = []
        for level in range(top, 0, -1):
            here = frame.where(f"zlevel = {level}")
            up = [*COLUMN, _zmask(F.col("z"), F.col("zlevel") - 1).alias("z")]
            pair = here.groupBy(*up).agg(F.count(F.lit(1)).alias("__n"), *[F.min_by(p, "z").alias(p) for p in self.payload]).where("__n = 2").withColumn("zlevel", F.lit(level - 1))
            parents = cut(pair.where(F.coalesce(where(pair), F.lit(False))).select(*self.layers.columns))
            gone = parents.select(*COLUMN, F.explode(F.array("z", F.col("z") + (Q.ROOT >> level))).alias("z"))
            done.append(here.join(gone, [*COLUMN, "z"], "left_anti"))
            frame = frame.where(f"zlevel < {level}").unionByName(parents) if recursive else frame.where(f"zlevel < {level}")
            if not recursive:
                done.append(parents)
        return replace(self, layers=functools.reduce(DataFrame.unionByName, [*done, frame]))

    def coarsen_columns(self, where: Predicate) -> Columns:
        """Families of four columns whose parent satisfies the predicate become it; at each height the coarsest of the four layers stays."""
        before = self.columns()
        after = before.coarsen(where)
        parents = cut(after.leaves.join(before.leaves, COLUMN, "left_anti"))
        up = Q.parent(Q.cell(2))
        mine = self.layers.where("level > 0").withColumns({f"__{a}": c for a, c in zip(("x", "y"), up.xyz)}).withColumn("__level", F.col("level") - 1)
        gone = mine.join(parents.select("tree", *[F.col(k).alias(f"__{k}") for k in COLUMN[1:]]), ["tree", "__x", "__y", "__level"])
        cells = cut(gone.select("tree", F.col("__x").alias("x"), F.col("__y").alias("y"), F.col("__level").alias("level"), "z", "zlevel", *self.payload).dropDuplicates([*COLUMN, "z", "zlevel"]))
        # a layer stays if no other layer of the four is its strict ancestor
        zs = F.filter(F.transform(F.sequence(F.lit(0), F.col("zlevel")), lambda k: F.struct(k.alias("k"), _zmask(F.col("z"), k).alias("z"))), lambda s: s["k"] < F.col("zlevel"))
        above = cells.withColumn("__a", F.explode(zs)).select(*COLUMN, F.col("__a.z").alias("__az"), F.col("__a.k").alias("__ak"), "z", "zlevel")
        hit = above.join(cells.select(*COLUMN, F.col("z").alias("__az"), F.col("zlevel").alias("__ak")), [*COLUMN, "__az", "__ak"], "left_semi").select(*COLUMN, "z", "zlevel").distinct()
        kept = cells.join(hit, [*COLUMN, "z", "zlevel"], "left_anti")
        stay = self.layers.join(after.leaves, COLUMN, "left_semi")
        return replace(self, layers=stay.unionByName(kept.select(*self.layers.columns)))

    def balance(self, kind: str = "corner", max_diff: int = 0, min_diff: int = 1) -> Columns:
        """2:1 in the columns, in each column's layers, and between touching layers of neighbouring columns.

        max_diff > 0 first splits columns whose layers are thinner by more levels; min_diff < 1 then splits layers that are
        thicker by more levels than -min_diff. Layers then follow one sweep over levels of internal z nodes, finest first: each asks for the
        parents of its z neighbours in its own column and for its parent in touching columns.
        """
        this = self
        if max_diff > 0:
            deep = this.layers.groupBy(*COLUMN).agg(F.max("zlevel").alias("__deep"))
            marked = Forest(this.topology, cut(deep))
            fine = marked.refine(lambda d: F.col("level") + max_diff < F.col("__deep"), recursive=True)
            this = replace(this, layers=this._spread(this.layers, fine.leaves.select(*COLUMN)))
        flat = this.columns().balance("face" if kind == "face" else "corner")
        frame = cut(this._spread(this.layers, flat.leaves))
        if min_diff < 1:
            this = replace(this, layers=frame).refine_layers(lambda d: F.col("zlevel") < F.col("level") + min_diff - 1, recursive=True)
            frame = cut(this.layers)
        numbered = cut(Forest(this.topology, frame.select(*COLUMN).distinct()).numbered())
        near = cut(adjacency.both_ways(adjacency.pairs(numbered, this.topology, "face" if kind == "face" else "corner")))
        cells = cut(frame.join(numbered, COLUMN).select("gid", "z", "zlevel"))
        height = this.roots * Q.ROOT
        ancestors = F.transform(F.sequence(F.lit(0), F.col("zlevel") - 1), lambda k: F.struct(_zmask(F.col("z"), k).alias("z"), k.alias("zlevel")))
        inner = cut(cells.where("zlevel > 0").select("gid", F.explode(ancestors).alias("a")).select("gid", "a.*").distinct())
        top = inner.agg(F.max("zlevel")).first()[0]
        parts, asked = [], None
        for level in range(-1 if top is None else top, -1, -1):
            nodes = inner.where(f"zlevel = {level}")
            nodes = cut(nodes.unionByName(asked).distinct() if asked is not None else nodes)
            parts.append(nodes)
            if level:
                n = Q.ROOT >> level
                own = nodes.select("gid", F.explode(F.array(F.col("z") - n, F.col("z"), F.col("z") + n)).alias("z")).where((F.col("z") >= 0) & (F.col("z") < height))
                side = own if kind == "corner" else nodes.select("gid", "z")
                other = side.join(near, "gid").select(F.col("ngid").alias("gid"), "z")
                asked = own.unionByName(other).select("gid", _zmask(F.col("z"), F.lit(level - 1)).alias("z"), F.lit(level - 1).alias("zlevel")).distinct()
        if not parts:
            return replace(this, layers=frame)
        split = functools.reduce(DataFrame.unionByName, parts)
        half = Q.shr(_zlen(F.col("zlevel")), 1)
        kids = split.select("gid", F.explode(F.array("z", F.col("z") + half)).alias("z"), (F.col("zlevel") + 1).alias("zlevel"))
        roots = numbered.select("gid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(this.roots - 1).cast("long"))).alias("z")).select("gid", (F.col("z") * Q.ROOT).alias("z"), F.lit(0).alias("zlevel"))
        out = kids.unionByName(roots).join(split, ["gid", "z", "zlevel"], "left_anti").join(numbered.select("gid", *COLUMN), "gid")
        if this.payload:  # new layers take the payload of the one that held them
            up = F.transform(F.sequence(F.lit(0), F.col("zlevel")), lambda k: F.struct(_zmask(F.col("z"), k).alias("z"), k.alias("zlevel")))
            spread = out.withColumn("__a", F.explode(up)).withColumns({"__z": F.col("__a.z"), "__l": F.col("__a.zlevel")})
            old = frame.select(*COLUMN, F.col("z").alias("__z"), F.col("zlevel").alias("__l"), *this.payload)
            out = spread.join(old, [*COLUMN, "__z", "__l"])
        return replace(this, layers=cut(out.select(*frame.columns)))

    # --- order, partition, checksum, neighbours -----------------------------------------------------------------------------
    def numbered(self) -> DataFrame:
        """Layers with gid in the order (column, z)."""
        return ranked(self.layers, [*sort_keys(2), F.col("z")], "gid")

    def partition(self, ranks: int, weight: Column | None = None) -> tuple[DataFrame, list[int]]:
        """Layers with gid and rank in near-equal numbers (or weights) of layers, with cuts moved so that no column is split: to the start of the column."""
        frame = self.layers if weight is None else self.layers.withColumn("__w", weight)
        frame = cut(ranked(frame, [*sort_keys(2), F.col("z")], "gid", None if weight is None else "__w"))
        n = frame.count()
        wanted = [n * p // ranks for p in range(ranks + 1)]
        total = None if weight is None else frame.agg(F.max("gid_weight")).first()[0]
        if total:
            reach = F.least(F.lit(ranks), F.floor(F.col("gid_weight") * ranks / F.lit(total))).cast("int")
            starts = sorted((r["r"], r["g"]) for r in frame.groupBy(reach.alias("r")).agg(F.min("gid").alias("g")).collect())
            wanted = [0, *[next((g for r, g in starts if r >= p), n) for p in range(1, ranks)], n]
        frame = frame.drop("__w", "gid_weight")
        firsts = self._column_starts(frame, wanted)
        return with_rank(frame, firsts), firsts

    def partition_given(self, counts: list[int]) -> tuple[DataFrame, list[int]]:
        """Layers with gid and the rank of prescribed numbers of layers; cuts inside a column move to its start. ValueError if the numbers do not add up."""
        frame = cut(self.numbered())
        wanted = [0, *itertools.accumulate(counts)]
        if wanted[-1] != frame.count():
            raise ValueError("counts do not add up to the number of layers")
        firsts = self._column_starts(frame, wanted)
        return with_rank(frame, firsts), firsts

    def _column_starts(self, frame: DataFrame, wanted: list[int]) -> list[int]:
        marks = frame.sparkSession.createDataFrame([(g,) for g in sorted(set(wanted[1:-1]))], "gid long")
        at = frame.join(small(marks, len(wanted)), "gid").select("gid", *COLUMN)  # the layer at each cut, and the first one of its column
        start = frame.join(at.select(*COLUMN).distinct(), COLUMN, "left_semi").groupBy(*COLUMN).agg(F.min("gid").alias("lo"))
        moved = {r["gid"]: r["lo"] for r in at.join(start, COLUMN).select("gid", "lo").collect()}
        return [0, *[moved.get(g, g) for g in wanted[1:-1]], wanted[-1]]

    def column_cuts(self, layer_cuts: list[int]) -> list[int]:
        """Cuts between columns that belong to cuts between layers: the number of columns that start before each."""
        per = self.numbered().groupBy(*COLUMN).agg(F.min("gid").alias("lo"))
        before = with_rank(per.where(F.col("lo") < layer_cuts[-1]), [0, *layer_cuts], "lo")
        found = {r["rank"]: r["n"] for r in before.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row a cut
        return list(itertools.accumulate(found.get(p, 0) for p in range(len(layer_cuts))))

    def checksum(self) -> int:
        """Adler-32 of the columns, then of all layers' (z, zlevel) in order, combined."""
        frame = self.layers.repartitionByRange(*sort_keys(2)[:2]).sortWithinPartitions(*sort_keys(2), "z").select("z", "zlevel", F.spark_partition_id().alias("p"))

        def fold(batches):
            import numpy as np
            import pandas as pd

            adler, size, part = 1, 0, None
            for pdf in batches:
                if len(pdf):
                    part = int(pdf["p"].iloc[0])
                    raw = np.stack([pdf["z"].to_numpy(), pdf["zlevel"].to_numpy()], axis=1).astype(">u4").tobytes()
                    adler, size = zlib.adler32(raw, adler), size + len(raw)
            if part is not None:
                yield pd.DataFrame({"p": [part], "adler": [adler], "size": [size]})

        out = self.columns().checksum()
        for r in sorted(frame.mapInPandas(fold, "p int, adler long, size long").collect(), key=lambda r: r["p"]):
            out = adler_combine(out, r["adler"], r["size"])
        return out

    def profiles(self) -> DataFrame:
        """Each column's layer levels from bottom to top, as an array (a column's own layers only)."""
        return self.layers.groupBy(*COLUMN).agg(F.transform(F.sort_array(F.collect_list(F.struct("z", "zlevel"))), lambda s: s["zlevel"]).alias("levels"))

    def ghosts(self, ranked_layers: DataFrame, kind: str = "corner") -> DataFrame:
        """rank, owner, gid of the layers in columns of other ranks that touch a rank's columns and overlap in height or meet there."""
        column = cut(ranked_layers.groupBy(*COLUMN).agg(F.min("rank").alias("rank"), F.min("gid").alias("gid")))
        met = adjacency.both_ways(adjacency.pairs(column, self.topology, kind, ("rank",)), ("rank",)).where("rank <> nrank").select("rank", F.col("ngid").alias("cgid"), F.col("nrank").alias("owner")).distinct()
        inner = ranked_layers.join(column.select(*COLUMN, F.col("gid").alias("cgid")), COLUMN).select("cgid", "gid")
        return met.join(inner, "cgid").select("rank", "owner", "gid").distinct()

    def expand_ghosts(self, ghost: DataFrame, ranked_layers: DataFrame, kind: str = "corner") -> DataFrame:
        """The ghost layers and those of other ranks in columns that touch the columns of ghosts."""
        column = cut(ranked_layers.groupBy(*COLUMN).agg(F.min("rank").alias("rank"), F.min("gid").alias("cgid")).withColumnRenamed("cgid", "gid"))
        met = adjacency.both_ways(adjacency.pairs(column, self.topology, kind, ("rank",)), ("rank",)).select(F.col("gid").alias("from"), F.col("ngid").alias("cgid"), F.col("nrank").alias("owner"))
        inner = cut(ranked_layers.join(column.select(*COLUMN, F.col("gid").alias("cgid")), COLUMN).select("cgid", "gid"))
        held = ghost.select("rank", "gid").join(inner, "gid").select("rank", F.col("cgid").alias("from")).distinct()
        more = held.join(met, "from").where("rank <> owner").select("rank", "owner", "cgid").distinct().join(inner, "cgid").select("rank", "owner", "gid")
        return ghost.unionByName(more).distinct()

    def save(self, path: str) -> None:
        """A folder of Parquet layers in order, the topology, and the height in roots."""
        from ..sources.meshfiles import Output

        ranged = self.layers.repartitionByRange(*sort_keys(2)[:2]).sortWithinPartitions(*sort_keys(2), "z")
        ranged.write.mode("overwrite").parquet(f"{path}/layers")
        with Output(self.layers.sparkSession, f"{path}/topology.bin") as out:
            out.write(self.topology.deflate())
        with Output(self.layers.sparkSession, f"{path}/columns.json") as out:
            out.write(json.dumps({"roots": self.roots}).encode())

    @staticmethod
    def load(spark: SparkSession, path: str) -> Columns:
        from ..sources.meshfiles import read_bytes

        top = Topology.inflate(read_bytes(spark, f"{path}/topology.bin"))
        return Columns(top, spark.read.parquet(f"{path}/layers"), json.loads(read_bytes(spark, f"{path}/columns.json"))["roots"])

    def positions(self, top: DataFrame | None = None, height: float = 1.0) -> DataFrame:
        """Layers with px, py, pz of their lower corner: the tree's bilinear map at the bottom, moved towards `top` (tree, corner, vx, vy, vz) or up by height."""
        from ..functions.geometry import vertex_map

        base = vertex_map(self.layers.withColumnRenamed("z", "__z"), self.topology, ("x", "y"), ("px", "py", "pz")).withColumnRenamed("__z", "z")
        part = F.col("z") / F.lit(float(Q.ROOT * self.roots))
        if top is None:
            return base.withColumn("pz", F.col("pz") + part * height)
        both = vertex_map(base.withColumnRenamed("z", "__z"), self.topology, ("x", "y"), ("tx", "ty", "tz"), top).withColumnRenamed("__z", "z")
        return both.withColumns({f"p{a}": F.col(f"p{a}") * (1 - part) + F.col(f"t{a}") * part for a in "xyz"}).drop("tx", "ty", "tz")

    def write_vtk(self, path: str, top: DataFrame | None = None, height: float = 1.0, fields: tuple[str, ...] = (), ranks: int = 1) -> list[str]:
        """VTK files of all layers as hexahedra, with tree, level, zlevel, rank and payload fields; positions as in positions()."""
        from ..sources.meshfiles import write_cells

        layers, _ = self.partition(ranks)
        n, h = Q.length(F.col("level")), _zlen(F.col("zlevel"))
        spots = F.array(*[F.struct(F.lit(c).alias("c"), *[(F.col(a) + (d if c >> i & 1 else 0)).alias(a) for i, (a, d) in enumerate((("x", n), ("y", n), ("z", h)))]) for c in range(8)])
        keep = ("gid", "rank", "tree", "level", "zlevel", *fields)
        each = layers.select(*keep, F.explode(spots).alias("s")).select(*keep, "s.*")
        return write_cells(replace(self, layers=each).positions(top, height), path, 3, ("tree", "level", "zlevel", "rank"), fields, {}, {})
