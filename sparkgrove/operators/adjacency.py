"""Leaves that meet: pairs across faces, edges and corners, interface tables, the neighbour mesh, ghost layers, 2:1 checks.

All operators start from one relation, `pairs`: of two leaves that touch, the smaller (or either of equal ones) has a same-size
neighbour cell that lies in the other. So one explode into same-size neighbours and one equi-join on the ancestors of the
levels present find every contact, whatever the difference in size; no range join and no loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quadrant as Q
from ..plans.lineage import cut
from ..sources.topology import Topology
from .forest import Forest, containing, folded, key_names, same_size_neighbors, small


def pairs(leaves: DataFrame, topology: Topology, kind: str = "corner", carry: tuple[str, ...] = ()) -> DataFrame:
    """gid, way, level, ngid, nlevel (and carry, n<carry>) of touching leaves, with nlevel <= level.

    leaves: cells with gid. way: base-3 code of the direction from the smaller leaf; a leaf can meet another, or itself on a
    periodic tree, in several ways. Equal leaves appear from both sides, unequal ones from the smaller.
    """
    dim = topology.dim
    mine = ("gid", *carry)
    near = same_size_neighbors(leaves, topology, kind, carry=mine)
    found = containing(near, leaves.select(*key_names(dim), *mine), dim)
    return found.select(*mine, "way", "level", F.col("l_gid").alias("ngid"), F.col("l_level").alias("nlevel"), *[F.col(f"l_{c}").alias(f"n{c}") for c in carry])


def both_ways(found: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """gid, ngid (and carry, n<carry>) of every contact from each of its two leaves, each once."""
    a = found.select("gid", "ngid", *carry, *[f"n{c}" for c in carry])
    b = found.where("nlevel < level").select(F.col("ngid").alias("gid"), F.col("gid").alias("ngid"), *[F.col(f"n{c}").alias(c) for c in carry], *[F.col(c).alias(f"n{c}") for c in carry])
    return a.unionByName(b).distinct()


def unbalanced(forest: Forest, kind: str = "corner") -> DataFrame:
    """Contacts whose levels differ by more than one: gid, ngid, level, nlevel."""
    return pairs(cut(forest.numbered()), forest.topology, kind).where("level - nlevel > 1").select("gid", "ngid", "level", "nlevel").distinct()


def is_balanced(forest: Forest, kind: str = "corner") -> bool:
    return unbalanced(forest, kind).isEmpty()


# --- interface tables ------------------------------------------------------------------------------------------------------
def way_of_face(face: int, dim: int) -> int:
    axis, side = divmod(face, 2)
    return sum((1 + (2 * side - 1) * (a == axis)) * 3**a for a in range(dim))


def face_of(way: Column, dim: int) -> Column:
    """Face number of a direction; null for edges and corners."""
    out = F.lit(None).cast("int")
    for f in range(2 * dim):
        out = F.when(way == way_of_face(f, dim), F.lit(f)).otherwise(out)
    return out


def _leaves_tree(face: Column, q: Q.Cell) -> Column:
    """Is a cell's face on the boundary of its tree?"""
    out = F.lit(False)
    for f in range(2 * q.dim):
        axis, side = divmod(f, 2)
        at = q.xyz[axis] + Q.length(q.level) == Q.ROOT if side else q.xyz[axis] == 0
        out = F.when(face == f, at).otherwise(out)
    return out


def faces(leaves: DataFrame, topology: Topology) -> DataFrame:
    """One row per face side: gid, face, level, ngid, nface, nlevel, orient, tree_boundary, hanging.

    A side looks from the smaller leaf (or either of equal ones). hanging: the neighbour is larger. Sides on the domain's boundary have
    ngid, nface, nlevel and orient null.
    """
    dim = topology.dim
    met = pairs(leaves, topology, "face").withColumn("face", face_of(F.col("way"), dim)).drop("way", "level")
    side = leaves.select("gid", *key_names(dim), F.explode(F.array(*[F.lit(f) for f in range(2 * dim)])).alias("face"))
    side = side.withColumn("tree_boundary", _leaves_tree(F.col("face"), Q.cell(dim)))
    glue = [(t, f, *v) for (t, f), v in topology.faces.items()]
    conn = small(leaves.sparkSession.createDataFrame(glue, "tree long, face int, t_ntree long, t_nface int, t_orient int"), len(glue))
    side = side.join(conn, ["tree", "face"], "left").join(met, ["gid", "face"], "left")
    # a larger leaf's own side of a hanging face has no row: its small neighbours have one each
    side = side.where(F.col("ngid").isNotNull() | (F.col("tree_boundary") & F.col("t_ntree").isNull()))
    inner = F.col("ngid").isNotNull()
    nface = F.when(F.col("tree_boundary"), F.col("t_nface")).otherwise(F.col("face").bitwiseXOR(1))
    orient = F.when(F.col("tree_boundary"), F.col("t_orient")).otherwise(0)
    return side.select("gid", "face", "level", "ngid", F.when(inner, nface).alias("nface"), "nlevel", F.when(inner, orient).alias("orient"), "tree_boundary", F.coalesce(F.col("nlevel") < F.col("level"), F.lit(False)).alias("hanging"))


def interfaces(leaves: DataFrame, topology: Topology) -> DataFrame:
    """Each face of the mesh once, from its full or small sides: lo, hi (gids), face (of lo), hanging, boundary.

    A hanging face has one row for each small side; equal neighbours are listed from the lower (gid, face).
    """
    f = faces(leaves, topology)
    keep = F.col("ngid").isNull() | F.col("hanging") | (F.struct(F.col("gid").alias("g"), F.col("face").alias("f")) <= F.struct(F.col("ngid").alias("g"), F.col("nface").alias("f")))
    return f.where(keep).select(F.col("gid").alias("lo"), F.col("ngid").alias("hi"), "face", "nface", "hanging", F.col("ngid").isNull().alias("boundary"))


def points_of(leaves: DataFrame, topology: Topology, kind: str = "corner") -> DataFrame:
    """Corner points (kind corner) or octant edge mid-points (kind edge) of leaves: gid, part, tree, x, y[, z] in the leaf's tree."""
    dim = topology.dim
    q = Q.cell(dim)
    make, n = (Q.corner_point, 1 << dim) if kind == "corner" else (Q.edge_point, Q.EDGES[dim])
    at = F.array(*[F.struct(F.lit(i).alias("part"), *[c.alias(a) for c, a in zip(make(q, i), Q.axes(dim))]) for i in range(n)])
    return leaves.select("gid", "tree", F.explode(at).alias("p")).select("gid", "tree", "p.*")


def canonical(points: DataFrame, topology: Topology, scale: int = 1, out: str = "c_") -> DataFrame:
    """points (tree, x, y[, z], any columns) with the lowest (tree, x, y[, z]) that is the same place, in columns with prefix out.

    Corner, edge and face classes of a topology are complete, so every image is one transform away. Only points on a tree's
    boundary take part in the join. Coordinates run from 0 to scale * ROOT.
    """
    dim, axes = topology.dim, Q.axes(topology.dim)
    end = scale * Q.ROOT
    names = [out + c for c in ("tree", *axes)]
    side = [F.when(F.col(a) == 0, -1).when(F.col(a) == end, 1).otherwise(0) for a in axes]
    on = sum((F.abs(s) for s in side), F.lit(0)) > 0
    plain = points.where(~on).withColumns({out + c: F.col(c) for c in ("tree", *axes)})
    rows = topology.transform_rows()
    border = points.where(on)
    own = F.struct(*[F.col(c).cast("long").alias(c) for c in ("tree", *axes)])
    if not rows:
        return plain.unionByName(border.withColumns({out + c: F.col(c) for c in ("tree", *axes)}))
    table = points.sparkSession.createDataFrame(rows, "tree long, way int, ntree long, perm array<int>, sign array<int>, shift array<int>")
    # all moves of a tree in one row: the images of a point are then a projection, and no aggregate is needed
    moves = table.groupBy("tree").agg(F.collect_list(F.struct("way", "ntree", "perm", "sign", "shift")).alias("__moves"))  # at most a few hundred a tree
    joined = border.join(small(moves, topology.n), "tree", "left")

    def fits(way: Column) -> Column:
        ok = F.lit(True)
        for i, s in enumerate(side):
            digit = F.floor(way / 3**i).cast("int") % 3 - 1
            ok = ok & ((digit == 0) | (digit == s))
        return ok

    def image(m: Column) -> Column:
        xyz = F.array(*[F.col(a).cast("long") for a in axes])
        return F.struct(m["ntree"].alias("tree"), *[(F.get(m["sign"], i) * F.get(xyz, F.get(m["perm"], i)) + F.get(m["shift"], i).cast("long") * end).alias(a) for i, a in enumerate(axes)])

    images = F.transform(F.filter(F.coalesce("__moves", F.array().cast(moves.schema["__moves"].dataType)), lambda m: fits(m["way"])), image)
    least = F.array_min(F.concat(F.array(own), images))
    moved = joined.withColumn("__c", least).withColumns({out + c: F.col("__c")[c] for c in ("tree", *axes)}).drop("__c", "__moves")
    return plain.unionByName(moved.select(*points.columns, *names))


def corners(leaves: DataFrame, topology: Topology, kind: str = "corner") -> DataFrame:
    """gid, part and the canonical place (c_tree, c_x, ...) of every corner (or octant edge mid-point) of every leaf.

    Rows of one place are the sides of one corner; a place at which a larger leaf has no corner of its own hangs there.
    """
    names = ["c_" + c for c in ("tree", *Q.axes(topology.dim))]
    return canonical(points_of(leaves, topology, kind), topology).select("gid", "part", *names)


# --- neighbour mesh ---------------------------------------------------------------------------------------------------------
def mesh(leaves: DataFrame, topology: Topology) -> DataFrame:
    """gid, face, neighbors (sorted gids), code of every face of every leaf of a face-balanced forest.

    code, with F = 2 * dim faces and r the orientation: F * r + nface for an equal neighbour (and the leaf itself on the
    boundary), F * R * (1 + h) + F * r + nface for a larger one of which this is subface h, F * r + nface - F * R for smaller
    ones; R is the number of orientations.
    """
    dim = topology.dim
    kinds = 2 * dim * (2 if dim == 2 else 4)
    f = cut(faces(leaves, topology).join(leaves.select("gid", *Q.axes(dim)), "gid"))
    base = 2 * dim * F.coalesce("orient", F.lit(0)) + F.coalesce("nface", F.col("face"))
    cid = Q.child_id(Q.cell(dim))
    # position of the small leaf on the large face: its child number without the face's axis
    sub = F.lit(0)
    for face in range(2 * dim):
        tangent = [a for a in range(dim) if a != face // 2]
        h = sum((F.shiftright(cid, a).bitwiseAND(1) * (1 << i) for i, a in enumerate(tangent)), F.lit(0))
        sub = F.when(F.col("face") == face, h).otherwise(sub)
    up = f.select("gid", "face", F.array(F.coalesce("ngid", F.col("gid"))).alias("neighbors"), F.when(F.col("hanging"), kinds * (1 + sub) + base).otherwise(base).cast("int").alias("code"))
    # the large leaf's own side: at most 2**(dim - 1) small leaves each
    down = f.where("hanging").groupBy(F.col("ngid").alias("gid"), F.col("nface").alias("face")).agg(F.sort_array(F.collect_list("gid")).alias("neighbors"), F.first(2 * dim * F.col("orient") + F.col("face") - kinds).cast("int").alias("code"))
    return up.unionByName(down)


# --- ghost layers -------------------------------------------------------------------------------------------------------------
def ghosts(ranked_leaves: DataFrame, topology: Topology, kind: str = "corner") -> DataFrame:
    """rank, owner, gid: leaves of other ranks that touch a rank's own. ranked_leaves: cells with gid and rank."""
    met = both_ways(pairs(ranked_leaves, topology, kind, ("rank",)), ("rank",))
    return met.where("rank <> nrank").select("rank", F.col("nrank").alias("owner"), F.col("ngid").alias("gid")).distinct()


def mirrors(ghost: DataFrame) -> DataFrame:
    """rank, gid: leaves that are ghosts elsewhere, from their owner's side, with the number of ranks that hold them."""
    return ghost.groupBy(F.col("owner").alias("rank"), "gid").agg(F.count(F.lit(1)).alias("holders"))


def expand_ghosts(ghost: DataFrame, ranked_leaves: DataFrame, topology: Topology, kind: str = "corner") -> DataFrame:
    """The ghost layer and the leaves of other ranks that touch it."""
    met = both_ways(pairs(ranked_leaves, topology, kind, ("rank",)), ("rank",)).select("gid", F.col("ngid").alias("n"), F.col("nrank").alias("owner"))
    more = ghost.select("rank", "gid").join(met.hint("merge"), "gid").where(F.col("owner") != F.col("rank")).select("rank", "owner", F.col("n").alias("gid"))
    return ghost.unionByName(more).distinct()


def ghosts_by_nodes(element_nodes: DataFrame, ranked_leaves: DataFrame, ghost: DataFrame | None = None) -> DataFrame:
    """rank, owner, gid: leaves of other ranks that use a node that a rank's own leaves use; with a ghost layer, the layer and all that use a node of it or of their own.

    element_nodes: gid and node_id of nodes.number(). A node has a bounded number of elements, so the join on nodes is linear.
    """
    at = element_nodes.select("gid", "node_id").join(ranked_leaves.select("gid", "rank"), "gid")
    mine = at.select("rank", "node_id")
    if ghost is not None:
        mine = mine.unionByName(ghost.select("rank", "gid").join(element_nodes.select("gid", "node_id"), "gid").select("rank", "node_id"))
    met = mine.distinct().join(at.select("node_id", "gid", F.col("rank").alias("owner")), "node_id").where("rank <> owner").select("rank", "owner", "gid")
    return (met if ghost is None else met.unionByName(ghost.select("rank", "owner", "gid"))).distinct()


def ghost_problems(ghost: DataFrame, ranked_leaves: DataFrame) -> dict[str, int]:
    """Numbers of ghosts that are listed twice, that their own rank holds, that are no leaves, and whose owner is another rank."""
    found = ghost.join(ranked_leaves.select("gid", F.col("rank").alias("real")), "gid", "left")
    seen = found.agg(F.count_if(F.col("rank") == F.col("owner")).alias("own"), F.count_if(F.col("real").isNull()).alias("unknown"), F.count_if(F.col("real") != F.col("owner")).alias("misplaced")).first()
    twice = ghost.groupBy("rank", "gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
    return {"twice": twice, **seen.asDict()}


def ghost_checksum(ghost: DataFrame, leaves: DataFrame, dim: int) -> int:
    """Adler-32 of all ranks' ghost cells in the order of rank and gid. leaves: cells with gid."""
    cells = ghost.select("rank", "gid").join(leaves.select("gid", *key_names(dim)), "gid")
    return folded(cells, dim, [F.col("rank"), F.col("gid")])


def trees_of_ranks(ranked_leaves: DataFrame, dim: int) -> DataFrame:
    """rank, tree, first and last gid of each rank's part of a tree, and whether it holds the tree's begin and end."""
    q = Q.cell(dim)
    begin, end = F.lit(True), F.lit(True)
    for c in q.xyz:
        begin, end = begin & (c == 0), end & (c + Q.length(q.level) == Q.ROOT)
    return ranked_leaves.groupBy("rank", "tree").agg(F.min("gid").alias("first"), F.max("gid").alias("last"), F.bool_or(begin).alias("has_begin"), F.bool_or(end).alias("has_end"))


def owned_neighborhoods(ranked_leaves: DataFrame, topology: Topology, kind: str = "corner") -> DataFrame:
    """gid, rank, owned: whether all leaves that touch a leaf belong to its rank."""
    met = both_ways(pairs(ranked_leaves, topology, kind, ("rank",)), ("rank",))
    foreign = met.where("rank <> nrank").select("gid").distinct().withColumn("owned", F.lit(False))
    return ranked_leaves.select("gid", "rank").join(foreign, "gid", "left").withColumn("owned", F.coalesce("owned", F.lit(True)))


def neighbor_data(meshed: DataFrame, data: DataFrame) -> DataFrame:
    """gid, face, position, neighbor and the columns of data (by gid) of every neighbour in a mesh, ghosts included."""
    each = meshed.select("gid", "face", F.posexplode("neighbors").alias("position", "neighbor"))
    return each.join(data.withColumnRenamed("gid", "neighbor"), "neighbor").select("gid", "face", "position", "neighbor", *[c for c in data.columns if c != "gid"])


def exchange(ghost: DataFrame, data: DataFrame, min_level: int | None = None, max_level: int | None = None) -> DataFrame:
    """ghost with the columns of data (by gid, and of its level if limits are given): what the holders receive."""
    if min_level is not None or max_level is not None:
        data = data.where(F.col("level").between(0 if min_level is None else min_level, Q.MAX if max_level is None else max_level))
    return ghost.join(data.hint("merge"), "gid")  # data has a row for every leaf


def existing(cells: DataFrame, leaves: DataFrame, dim: int) -> DataFrame:
    """cells with gid of the leaf that is exactly the cell, null if there is none."""
    return cells.join(leaves.select(*key_names(dim), "gid"), key_names(dim), "left")


def face_existing(cells: DataFrame, leaves: DataFrame, topology: Topology, face: int) -> DataFrame:
    """cells (with any columns) and, of the same-size neighbour across a face: found (gid; -1 if it is no leaf, -2 beyond the boundary)."""
    dim, keys = topology.dim, key_names(topology.dim)
    near = same_size_neighbors(cells.select(*keys).distinct(), topology, "face", carry=("id__",)) if "id__" in cells.columns else None
    tagged = cells.withColumn("id__", F.struct(*keys)) if near is None else cells
    near = same_size_neighbors(tagged.select(*keys, "id__").distinct(), topology, "face", carry=("id__",)).where(F.col("way") == way_of_face(face, dim))
    hit = existing(near, leaves, dim).select("id__", F.coalesce("gid", F.lit(-1).cast("long")).alias("found"))
    return tagged.join(hit, "id__", "left").withColumn("found", F.coalesce("found", F.lit(-2).cast("long"))).drop("id__")
