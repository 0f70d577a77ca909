"""Node numbering: continuous nodes of any degree, entity nodes, hanging corners and what they depend on, shared-node reductions.

A node is a place: the canonical (tree, coordinates) in units of ROOT * scale. Nodes on a hanging face or edge are replaced by
those of the larger neighbour's entity, which is the parent's; so an element only needs to know which of its parent's outer faces and edges hang.
Everything is an explode, a projection, and joins on places; ids are exact ranks by (owner, place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quadrant as Q
from ..plans.lineage import cut, ranked
from ..sources.topology import Topology
from .adjacency import canonical, pairs


def hanging(leaves: DataFrame, topology: Topology) -> DataFrame:
    """gid, hang_faces, hang_edges: bit a is set if the leaf's outer face across axis a (its outer edge along a) hangs. Only leaves with any.

    The forest has to be balanced over faces (2D) or edges (3D).
    """
    dim = topology.dim
    larger = pairs(leaves, topology, "edge" if dim == 3 else "face").where("nlevel < level")
    out = [F.floor(F.col("way") / 3**a).cast("int") % 3 - 1 for a in range(dim)]
    count = sum((F.abs(s) for s in out), F.lit(0))
    face_bit = sum((F.abs(s) * (1 << a) for a, s in enumerate(out)), F.lit(0))
    edge_bit = sum((F.when(s == 0, 1 << a).otherwise(0) for a, s in enumerate(out)), F.lit(0))
    bits = larger.groupBy("gid").agg(F.bit_or(F.when(count == 1, face_bit).otherwise(0)).alias("hang_faces"), F.bit_or(F.when(count == 2, edge_bit).otherwise(0) if dim == 3 else F.lit(0)).alias("hang_edges"))
    if dim == 2:
        return bits
    # an outer edge of a hanging face hangs as well: faces a and b share the edge along the third axis
    more = sum((F.when(F.col("hang_faces").bitwiseAND(7 ^ (1 << a)) != 0, 1 << a).otherwise(0) for a in range(3)), F.lit(0))
    return bits.withColumn("hang_edges", F.col("hang_edges").bitwiseOR(more).cast("int"))


def with_codes(leaves: DataFrame, topology: Topology) -> DataFrame:
    """leaves with hang_faces, hang_edges and face_code: child number, then one bit a hanging face's axis, in 3D one a hanging edge's axis."""
    dim = topology.dim
    out = leaves.join(hanging(leaves, topology), "gid", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("int") for c in ("hang_faces", "hang_edges")})
    cid = Q.child_id(Q.cell(dim))
    bits = F.shiftleft("hang_faces", dim) + (F.shiftleft("hang_edges", 2 * dim) if dim == 3 else F.lit(0))
    return out.withColumn("face_code", F.when(bits > 0, cid + bits).otherwise(0).cast("int"))


def decode(face_code: Column, dim: int) -> tuple[Column, list[Column]]:
    """Child number and, for each face, whether it hangs."""
    cid = face_code.bitwiseAND((1 << dim) - 1)
    return cid, [(F.shiftright(face_code, dim + f // 2).bitwiseAND(1) == 1) & (F.shiftright(cid, f // 2).bitwiseAND(1) == f % 2) for f in range(2 * dim)]


def _places(coded: DataFrame, topology: Topology, p: int, keep: Column | None = None) -> DataFrame:
    """gid, pos, tree, x, y[, z] (times p) of the (p + 1)**dim lattice points of each element, moved to parents' entities where these hang."""
    dim = topology.dim
    q, cid = Q.cell(dim), Q.child_id(Q.cell(dim))
    up = Q.ancestor(q, F.greatest(q.level - 1, F.lit(0)))
    each = coded.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit((p + 1) ** dim - 1))))
    index = [F.floor(F.col("pos") / (p + 1) ** a).cast("long") % (p + 1) for a in range(dim)]
    if keep is not None:
        each = each.where(keep)
    outer = [i == F.shiftright(cid, a).bitwiseAND(1) * p for a, i in enumerate(index)]
    n = Q.length(q.level)
    xyz = []
    for t in range(dim):
        stretched = F.lit(False)
        for a in range(dim):
            if a != t:
                stretched = stretched | (outer[a] & (F.shiftright("hang_faces", a).bitwiseAND(1) == 1))
        if dim == 3:
            a, b = [i for i in range(3) if i != t]
            stretched = stretched | (outer[a] & outer[b] & (F.shiftright("hang_edges", t).bitwiseAND(1) == 1))
        xyz.append(F.when(stretched, up.xyz[t] * p + index[t] * 2 * n).otherwise(q.xyz[t] * p + index[t] * n))
    return each.select("gid", "pos", "tree", *[c.alias(a) for c, a in zip(xyz, Q.axes(dim))])


def lattice(degree: int, dim: int) -> tuple[int, Column | None]:
    """Lattice width and filter on `pos`: degree >= 1 all points; -1 faces, -2 in 3D also edges, -dim also corners, by their centres."""
    if degree >= 1:
        return degree, None
    if not -dim <= degree <= -1:
        raise ValueError("degree has to be positive or between -dim and -1")
    middle = sum((F.when(F.floor(F.col("pos") / 3**a).cast("long") % 3 == 1, 1).otherwise(0) for a in range(dim)), F.lit(0))
    return 2, (middle < dim) & (middle >= dim + degree)


def number(leaves: DataFrame, topology: Topology, degree: int = 1) -> tuple[DataFrame, DataFrame]:
    """(element_nodes, nodes): gid, pos, node_id of every element, and node_id, owner and place of every node.

    owner: the lowest gid among the elements that use the node. leaves: cells with gid, balanced. pos counts the lattice, x fastest.
    """
    dim = topology.dim
    p, keep = lattice(degree, dim)
    place = ["c_" + c for c in ("tree", *Q.axes(dim))]
    used = cut(canonical(_places(with_codes(leaves, topology), topology, p, keep), topology, p).select("gid", "pos", *place))
    per = used.groupBy(*place).agg(F.min("gid").alias("owner"))
    nodes = cut(ranked(per, [F.col("owner"), *map(F.col, place)], "node_id"))
    return used.join(nodes.select("node_id", *place), place).select("gid", "pos", "node_id"), nodes


def hanging_corners(leaves: DataFrame, topology: Topology) -> DataFrame:
    """place (c_tree, c_x, ...) of every hanging corner and of each independent corner it depends on (d_tree, d_x, ...), 2 or 4 each."""
    dim = topology.dim
    q = Q.cell(dim)
    cid = Q.child_id(q)
    up = Q.ancestor(q, F.greatest(q.level - 1, F.lit(0)))
    coded = with_codes(leaves, topology).where("face_code > 0")
    rows = []
    for moved in range(1, 1 << dim):
        axes = [a for a in range(dim) if moved >> a & 1]
        if len(axes) == dim:
            continue
        face_hangs = sum((F.shiftright("hang_faces", a).bitwiseAND(1) for a in range(dim) if a not in axes), F.lit(0)) > 0
        edge_hangs = F.shiftright("hang_edges", axes[0]).bitwiseAND(1) == 1 if dim == 3 and len(axes) == 1 else F.lit(False)
        hit = face_hangs | edge_hangs
        corner = lambda c, mask, cell, n: F.struct(*[(cell.xyz[a] + F.shiftright(c.bitwiseXOR(mask), a).bitwiseAND(1) * n).alias(x) for a, x in enumerate(Q.axes(dim))])
        subsets = [sum(1 << a for j, a in enumerate(axes) if s >> j & 1) for s in range(1 << len(axes))]
        n = Q.length(q.level)
        rows.append(F.when(hit, F.array(*[F.struct(corner(cid, F.lit(moved), q, n).alias("h"), corner(cid, F.lit(s), up, 2 * n).alias("d")) for s in subsets])).otherwise(F.array().cast(f"array<struct<h:struct<{','.join(f'{a}:bigint' for a in Q.axes(dim))}>,d:struct<{','.join(f'{a}:bigint' for a in Q.axes(dim))}>>>")))
    each = coded.select("tree", F.explode(F.flatten(F.array(*rows))).alias("r")).distinct()
    h = canonical(each.select("tree", "r", *[F.col(f"r.h.{a}").alias(a) for a in Q.axes(dim)]), topology)
    held = ["c_" + c for c in ("tree", *Q.axes(dim))]
    d = canonical(h.select("tree", *held, *[F.col(f"r.d.{a}").alias(a) for a in Q.axes(dim)]), topology, out="d_")
    return d.select(*held, *["d_" + c for c in ("tree", *Q.axes(dim))]).distinct()


def corner_nodes(leaves: DataFrame, topology: Topology) -> DataFrame:
    """place, hanging of every distinct corner of the mesh, and touching, the number of leaves with a corner there."""
    from .adjacency import corners

    place = ["c_" + c for c in ("tree", *Q.axes(topology.dim))]
    every = corners(leaves, topology).groupBy(*place).agg(F.count(F.lit(1)).alias("touching"))
    hung = hanging_corners(leaves, topology).select(*place).distinct().withColumn("hanging", F.lit(True))
    return every.join(hung, place, "left").withColumn("hanging", F.coalesce("hanging", F.lit(False)))


def problems(element_nodes: DataFrame, made: DataFrame, leaves: DataFrame, per_element: int) -> dict[str, int]:
    """What is wrong with a numbering of full degree: elements without all their nodes, numbers that are not 0, 1, ..., unused nodes, owners that are not the least element."""
    n = made.count()
    per = element_nodes.groupBy("gid").agg(F.countDistinct("pos").alias("p"))
    short = leaves.select("gid").join(per, "gid", "left").where(F.coalesce("p", F.lit(0)) != per_element).count()
    used = element_nodes.groupBy("node_id").agg(F.min("gid").alias("least"))
    both = made.select("node_id", "owner").join(used, "node_id", "full")
    seen = both.agg(F.count_if(F.col("owner").isNull()).alias("unknown"), F.count_if(F.col("least").isNull()).alias("unused"), F.count_if(F.col("owner") != F.col("least")).alias("misowned")).first()
    gaps = n - made.where(F.col("node_id").between(0, n - 1)).select("node_id").distinct().count()
    return {"short": short, "gaps": gaps, **seen.asDict()}


# --- sharing values at nodes ------------------------------------------------------------------------------------------------------
def sharers(element_nodes: DataFrame, ranked_leaves: DataFrame) -> DataFrame:
    """node_id, rank: ranks with an element that uses a node."""
    return element_nodes.join(ranked_leaves.select("gid", "rank"), "gid").select("node_id", "rank").distinct()


def share_owned(values: DataFrame, element_nodes: DataFrame, nodes: DataFrame, ranked_leaves: DataFrame) -> DataFrame:
    """node_id, rank and values (node_id, rank, ...) of the owner, at every rank that shares the node."""
    owner = nodes.join(ranked_leaves.select(F.col("gid").alias("owner"), "rank"), "owner").select("node_id", "rank")
    return values.join(owner, ["node_id", "rank"], "left_semi").drop("rank").join(sharers(element_nodes, ranked_leaves), "node_id")


def share_all(values: DataFrame, *how: Column) -> DataFrame:
    """One row a node: aggregates over the values of all its sharers or elements."""
    return values.groupBy("node_id").agg(*how)


def node_weights(leaves: DataFrame, topology: Topology, degree: int = 1) -> DataFrame:
    """leaves with weight: the number of nodes that each element owns, for a partition that evens out nodes."""
    _, nodes = number(leaves, topology, degree)
    per = nodes.groupBy(F.col("owner").alias("gid")).agg(F.count(F.lit(1)).alias("weight"))
    return leaves.join(per, "gid", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


# --- exports for other mesh libraries -------------------------------------------------------------------------------------------
def entity_graph(leaves: DataFrame, topology: Topology) -> tuple[DataFrame, DataFrame]:
    """(points, cones): every cell, face, [edge] and corner once with its dimension, and from each cell the entities of its closure.

    points: id, depth (dim of the entity), owner. cones: cell (gid), pos on the 3**dim lattice, id. Cells keep their gid and
    entities are numbered behind them. Hanging entities are replaced by the larger neighbour's, as in node numbering.
    """
    dim = topology.dim
    n = leaves.count()
    used, nodes = number(leaves, topology, -dim)
    depth = sum((F.when(F.floor(F.col("pos") / 3**a).cast("long") % 3 == 1, 1).otherwise(0) for a in range(dim)), F.lit(0))
    cones = used.select(F.col("gid").alias("cell"), "pos", (F.col("node_id") + n).alias("id"))
    kinds = used.groupBy("node_id").agg(F.max(depth).alias("depth"))
    points = nodes.join(kinds, "node_id").select((F.col("node_id") + n).alias("id"), "depth", "owner")
    return leaves.select(F.col("gid").alias("id"), F.lit(dim).alias("depth"), F.col("gid").alias("owner")).unionByName(points), cones


def entity_numbers(leaves: DataFrame, topology: Topology) -> dict[str, DataFrame]:
    """Numbers of corners and of faces, each from 0, for every element: gid, pos (corner or face number), number."""
    dim = topology.dim
    corner, _ = number(leaves, topology, 1)
    face, _ = number(leaves, topology, -1)
    spot = F.lit(None).cast("int")
    for f in range(2 * dim):
        axis, side = divmod(f, 2)
        spot = F.when(F.col("pos") == sum((2 * side if a == axis else 1) * 3**a for a in range(dim)), F.lit(f)).otherwise(spot)
    return {"corners": corner.withColumnRenamed("node_id", "number"), "faces": face.select("gid", spot.alias("pos"), F.col("node_id").alias("number"))}
