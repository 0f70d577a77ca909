"""Queries of forests in several trees and in 3D, and of further operators of the quadtree, each with its SQL.

Octrees are those of all events on a grid of 64 cells a side, with at most 50 points a leaf; the SQL is written for any dimension.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quadrant as Q
from ..operators import adapt, adjacency, nodes, search
from ..operators.columns import Columns
from ..operators.forest import Forest, complete, image_forest, linearize, points_forest
from ..sources import topology as T
from .cellqueries import NAMES, points, points_sql, weave
from .lineage import cut
from .queries import _BAL, _CORNER, _D9, _LEAF, _NEAR, MOST, ORACLE, _grid, _m, event_forest, numbered, query

#: Levels of the octree, and the shift from its grid to coordinates.
DEEP = 6
FINE = Q.MAX - DEEP


def _at(c: str) -> F.Column:
    return Q.shr(F.col(c), FINE).alias(c)


def octree(spark, sf_dir) -> Forest:
    return points_forest(points(spark, sf_dir, 3), T.unit(3), MOST, DEEP)


def octants(spark, sf_dir, balanced: str = "") -> DataFrame:
    f = octree(spark, sf_dir)
    if balanced:
        f = Forest(f.topology, cut(f.leaves.select(*f.keys))).balance(balanced)
    return cut(f.numbered())


# --- SQL pieces -----------------------------------------------------------------------------------------------------------------
_I3 = range(3)
_C3 = "c0, c1, c2"
_LOW3 = [f"(c{i} << ({DEEP} - level))" for i in _I3]
_D8 = "d8(" + ", ".join(f"e{i}" for i in _I3) + ") AS (SELECT a.range, b.range, c.range FROM range(0, 2) a, range(0, 2) b, range(0, 2) c)"
_D27 = "d27(d0, d1, d2) AS (SELECT a.range - 1, b.range - 1, c.range - 1 FROM range(0, 3) a, range(0, 3) b, range(0, 3) c)"
_OCT = f"""{points_sql(3)},
 cnt AS (SELECT l AS level, {', '.join(f'p{i} >> (12 - l) AS c{i}' for i in _I3)}, count(*) AS n FROM pts, (SELECT CAST(range AS INTEGER) AS l FROM range(0, {DEEP + 1})) GROUP BY ALL),
 split AS (SELECT level, {_C3} FROM cnt WHERE n > {MOST} AND level < {DEEP}), {_D8},
 kids AS (SELECT level + 1 AS level, {', '.join(f'2 * c{i} + e{i} AS c{i}' for i in _I3)} FROM split, d8 UNION ALL SELECT 0, 0, 0, 0),
 leaf0 AS (SELECT k.level, {', '.join(f'k.c{i}' for i in _I3)}, coalesce(cnt.n, 0) AS n FROM kids k ANTI JOIN split USING (level, {_C3}) LEFT JOIN cnt USING (level, {_C3})),
 leaf AS (SELECT *, {', '.join(f'{c} AS {NAMES[i]}' for i, c in enumerate(_LOW3))}, row_number() OVER (ORDER BY {weave(_LOW3, DEEP)}) - 1 AS gid FROM leaf0)"""


def _balanced_sql(kind: str) -> str:
    """s: internal nodes, bl: leaves of the balanced octree, on top of _OCT."""
    most = {"face": 1, "edge": 2, "corner": 3}[kind]
    inside = " AND ".join(f"c{i} + d{i} BETWEEN 0 AND (1 << level) - 1" for i in _I3)
    return f"""{_OCT}, {_D27},
 s(level, {_C3}) AS (SELECT DISTINCT level - 1, {', '.join(f'c{i} >> 1' for i in _I3)} FROM leaf WHERE level > 0
   UNION SELECT level - 1, {', '.join(f'(c{i} + d{i}) >> 1' for i in _I3)} FROM s, d27 WHERE level > 0 AND abs(d0) + abs(d1) + abs(d2) <= {most} AND {inside}),
 bk AS (SELECT level + 1 AS level, {', '.join(f'2 * c{i} + e{i} AS c{i}' for i in _I3)} FROM s, d8 UNION ALL SELECT 0, 0, 0, 0),
 bl AS (SELECT *, {', '.join(f'{c} AS {NAMES[i]}' for i, c in enumerate(_LOW3))}, row_number() OVER (ORDER BY {weave(_LOW3, DEEP)}) - 1 AS gid FROM bk ANTI JOIN s USING (level, {_C3}))"""


_NEAR3 = f"""{_D27}, near AS (SELECT a.gid, a.level, d0, d1, d2, b.gid AS ngid, b.level AS nlevel, a.n, b.n AS nn FROM leaf a, d27 JOIN leaf b
  ON b.level <= a.level AND {' AND '.join(f'(a.c{i} + d{i}) >> (a.level - b.level) = b.c{i}' for i in _I3)}
  WHERE (d0 <> 0 OR d1 <> 0 OR d2 <> 0) AND {' AND '.join(f'a.c{i} + d{i} BETWEEN 0 AND (1 << a.level) - 1' for i in _I3)})"""


# --- octrees ---------------------------------------------------------------------------------------------------------------------
@query(f"WITH {_OCT} SELECT level, x, y, z, n FROM leaf")
def points_octree(spark, sf_dir):
    """Leaves of the octree in which no cell above level 6 holds more than 50 events."""
    return octree(spark, sf_dir).leaves.select("level", _at("x"), _at("y"), _at("z"), "n")


@query(f"WITH {_OCT} SELECT level, coalesce(branches, 0) AS branches, coalesce(leaves, 0) AS leaves FROM (SELECT level, count(*) AS branches FROM split GROUP BY level) FULL JOIN (SELECT level, count(*) AS leaves FROM leaf GROUP BY level) USING (level)")
def octree_branches(spark, sf_dir):
    return search.branches_and_leaves(octree(spark, sf_dir))


@query(f"WITH {_OCT} SELECT level + 1 AS level, {', '.join(f'{NAMES[i]} + e{i} * ({1 << DEEP - 1} >> level) AS {NAMES[i]}' for i in _I3)} FROM leaf, d8 WHERE n > 25 AND level < {DEEP} UNION ALL SELECT level, x, y, z FROM leaf WHERE n <= 25 OR level = {DEEP}")
def octree_refined(spark, sf_dir):
    """Leaves with more than 25 points become eight."""
    return octree(spark, sf_dir).refine(lambda d: F.col("n") > 25, max_level=DEEP).leaves.select("level", _at("x"), _at("y"), _at("z"))


@query(
    f"""WITH {_OCT}, fam AS (SELECT level - 1 AS level, {', '.join(f'c{i} >> 1 AS c{i}' for i in _I3)}, CAST(sum(n) AS BIGINT) AS n FROM leaf WHERE level > 0 GROUP BY ALL HAVING count(*) = 8 AND sum(n) <= 90)
 SELECT level, {', '.join(f'c{i} << ({DEEP} - level) AS {NAMES[i]}' for i in _I3)}, n FROM fam UNION ALL
 SELECT level, x, y, z, n FROM leaf l WHERE NOT EXISTS (SELECT 1 FROM fam f WHERE f.level = l.level - 1 AND {' AND '.join(f'f.c{i} = l.c{i} >> 1' for i in _I3)})"""
)
def octree_coarsened(spark, sf_dir):
    """Families with at most 90 points together become their parent."""
    total = lambda: F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)
    return octree(spark, sf_dir).coarsen(lambda d: total() <= 90, replace_payload={"n": total()}).leaves.select("level", _at("x"), _at("y"), _at("z"), "n")


def _balanced(kind: str):
    def run(spark, sf_dir):
        return octants(spark, sf_dir, kind).select("gid", "level", _at("x"), _at("y"), _at("z"))

    run.__name__, run.__doc__ = f"{kind}_balanced_octree", f"The least refinement in which leaves that meet by {kind} or closer differ by one level at most."
    return query(f"WITH RECURSIVE {_balanced_sql(kind)} SELECT gid, level, x, y, z FROM bl")(run)


for _kind in ("face", "edge", "corner"):
    _balanced(_kind)


@query(f"WITH {_OCT}, w AS (SELECT gid, sum(n) OVER (ORDER BY gid) AS upto, sum(n) OVER () AS total FROM leaf) SELECT gid, CAST(least(5, upto * 6 // total) AS INTEGER) AS rank FROM w")
def octree_partition(spark, sf_dir):
    """Six ranks with near-equal numbers of points."""
    return octree(spark, sf_dir).partition(6, F.col("n"))[0].select("gid", "rank")


@query(f"WITH {_OCT}, {_NEAR3} SELECT gid, CAST((d0 + 1) + 3 * (d1 + 1) + 9 * (d2 + 1) AS INTEGER) AS way, ngid, level, nlevel FROM near")
def octree_contacts(spark, sf_dir):
    """Leaves that meet across faces, edges and corners, from the smaller one."""
    return adjacency.pairs(octants(spark, sf_dir), T.unit(3), "corner").select("gid", "way", "ngid", "level", "nlevel")


@query(f"WITH {_OCT}, {_NEAR3} SELECT gid, CAST(CASE WHEN d0 <> 0 THEN (d0 + 1) // 2 WHEN d1 <> 0 THEN 2 + (d1 + 1) // 2 ELSE 4 + (d2 + 1) // 2 END AS INTEGER) AS face, ngid, nlevel, nlevel < level AS hanging FROM near WHERE abs(d0) + abs(d1) + abs(d2) = 1")
def octree_face_sides(spark, sf_dir):
    return adjacency.faces(octants(spark, sf_dir), T.unit(3)).where("ngid is not null").select("gid", "face", "ngid", "nlevel", "hanging")


@query(f"WITH {_OCT}, {_NEAR3}, r AS (SELECT gid, n, (SELECT count(*) FROM range(1, 3) t(p) WHERE ((SELECT count(*) FROM leaf) * p) // 3 <= gid) AS rank FROM leaf), e AS (SELECT gid, ngid FROM near UNION SELECT ngid, gid FROM near), g AS (SELECT DISTINCT a.rank, b.rank AS owner, b.gid, b.n FROM e JOIN r a ON a.gid = e.gid JOIN r b ON b.gid = e.ngid WHERE a.rank <> b.rank) SELECT CAST(rank AS INTEGER) AS rank, CAST(owner AS INTEGER) AS owner, count(*) AS ghosts, CAST(sum(n) AS BIGINT) AS points FROM g GROUP BY ALL")
def octree_ghosts(spark, sf_dir):
    """For each rank of three and each owner: ghost leaves, and the points that their owners send along."""
    f = octree(spark, sf_dir)
    leaves = cut(f.partition(3)[0])
    g = adjacency.exchange(adjacency.ghosts(leaves, f.topology), leaves.select("gid", "n"))
    return g.groupBy("rank", "owner").agg(F.count(F.lit(1)).alias("ghosts"), F.sum("n").alias("points"))


@query(f"WITH {_OCT} SELECT event_id, level, x, y, z FROM pts JOIN leaf ON {' AND '.join(f'p{i} >> (12 - level) = c{i}' for i in _I3)}")
def point_in_octant(spark, sf_dir):
    """Every event with the leaf that holds it."""
    hit = search.locate(points(spark, sf_dir, 3), cut(octree(spark, sf_dir).leaves), 3)
    return hit.select("event_id", F.col("l_level").alias("level"), *[Q.shr(F.col(f"l_{a}"), FINE).alias(a) for a in NAMES])


_OCORNER = f"""{_balanced_sql("corner")}, cor AS (SELECT gid, level, {_C3}, e0, e1, e2, {', '.join(f'(c{i} + e{i}) << ({DEEP} - level) AS q{i}' for i in _I3)} FROM bl, d8), pl AS (SELECT q0, q1, q2, count(*) AS touching FROM cor GROUP BY ALL),
 hung AS (SELECT q0, q1, q2, touching, EXISTS (SELECT 1 FROM bl WHERE {' AND '.join(f'q{i} BETWEEN {NAMES[i]} AND {NAMES[i]} + ({1 << DEEP} >> level)' for i in _I3)} AND NOT ({' AND '.join(f'q{i} IN ({NAMES[i]}, {NAMES[i]} + ({1 << DEEP} >> level))' for i in _I3)})) AS hanging FROM pl)"""


@query(f"WITH RECURSIVE {_OCORNER} SELECT q0 AS x, q1 AS y, q2 AS z, touching, hanging FROM hung")
def octree_corners(spark, sf_dir):
    """Distinct corners of the balanced octree, and which of them hang on faces or edges."""
    c = nodes.corner_nodes(octants(spark, sf_dir, "corner"), T.unit(3))
    return c.select(*[Q.shr(F.col(f"c_{a}"), FINE).alias(a) for a in NAMES], "touching", "hanging")


@query(
    f"""WITH RECURSIVE {_OCORNER}, u AS (SELECT gid, {', '.join(f'CASE WHEN hanging THEN ((c{i} >> 1) + e{i}) << ({DEEP + 1} - level) ELSE q{i} END AS {NAMES[i]}' for i in _I3)} FROM cor JOIN hung USING (q0, q1, q2))
 SELECT x, y, z, count(*) AS uses, CAST(min(gid) AS BIGINT) AS owner, CAST(sum(gid) AS BIGINT) AS gids FROM u GROUP BY ALL"""
)
def octree_nodes(spark, sf_dir):
    """Continuous nodes of degree 1: place, how many elements use them, the owner, and the sum of a value over the elements."""
    leaves = octants(spark, sf_dir, "corner")
    used, made = nodes.number(leaves, T.unit(3), 1)
    per = nodes.share_all(used.withColumn("value", F.col("gid")), F.count(F.lit(1)).alias("uses"), F.sum("value").alias("gids"))
    return per.join(made, "node_id").select(*[Q.shr(F.col(f"c_{a}"), FINE).alias(a) for a in NAMES], "uses", "owner", "gids")


_MIXED3 = f"c AS (SELECT DISTINCT CAST(event_id % 4 + 2 AS INTEGER) AS level, {', '.join(f'p{i} >> (12 - CAST(event_id % 4 + 2 AS INTEGER)) AS c{i}' for i in _I3)} FROM pts)"
_FINEST3 = f"f AS (SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.level > a.level AND {' AND '.join(f'b.c{i} >> (b.level - a.level) = a.c{i}' for i in _I3)}))"


def _mixed_octants(spark, sf_dir) -> DataFrame:
    q = Q.ancestor(Q.Cell(tuple(F.col(a) for a in NAMES), F.lit(Q.MAX)), (F.col("event_id") % 4 + 2).cast("int"))
    return points(spark, sf_dir, 3).select("tree", *Q.columns(q))


@query(f"WITH {points_sql(3)}, {_MIXED3}, {_FINEST3} SELECT level, {', '.join(f'c{i} << ({DEEP} - level) AS {NAMES[i]}' for i in _I3)} FROM f")
def finest_octants(spark, sf_dir):
    """Overlapping cells of levels 2 to 5, made linear: the finest stay."""
    return linearize(_mixed_octants(spark, sf_dir), 3).select("level", _at("x"), _at("y"), _at("z"))


@query(
    f"""WITH {points_sql(3)}, {_MIXED3}, {_D8}, i AS (SELECT DISTINCT k AS level, {', '.join(f'c{i} >> (level - k) AS c{i}' for i in _I3)} FROM c, (SELECT CAST(range AS INTEGER) AS k FROM range(0, {DEEP})) WHERE k < level),
 k AS (SELECT level + 1 AS level, {', '.join(f'2 * c{i} + e{i} AS c{i}' for i in _I3)} FROM i, d8) SELECT level, {', '.join(f'c{i} << ({DEEP} - level) AS {NAMES[i]}' for i in _I3)} FROM k ANTI JOIN i USING (level, {_C3})"""
)
def completed_octree(spark, sf_dir):
    """The coarsest octree with those cells, the finest where they overlap, as leaves."""
    return complete(_mixed_octants(spark, sf_dir), T.unit(3)).leaves.select("level", _at("x"), _at("y"), _at("z"))


_OWHERE = f"c AS (SELECT event_id, {weave([f'(p{i} >> {12 - DEEP})' for i in _I3], DEEP)} AS m FROM pts), k AS (SELECT gid, level, {weave(list(NAMES), DEEP)} AS m FROM leaf)"


@query(f"WITH {_OCT}, {_OWHERE} SELECT event_id, (SELECT min(gid) FROM k WHERE k.m > c.m OR (k.m = c.m AND level >= {DEEP})) AS low, (SELECT max(gid) FROM k WHERE k.m <= c.m) AS high FROM c")
def octant_bounds(spark, sf_dir):
    """The lowest leaf at or after and the highest at or before each event's cell of level 6."""
    q = Q.ancestor(Q.Cell(tuple(F.col(a) for a in NAMES), F.lit(Q.MAX)), F.lit(DEEP))
    cells, leaves = points(spark, sf_dir, 3).select("event_id", "tree", *Q.columns(q)), octants(spark, sf_dir)
    low = search.bound(cells, leaves, 3).withColumnRenamed("bound", "low")
    return search.bound(low, leaves, 3, lower=False).select("event_id", "low", F.col("bound").alias("high"))


# --- more of the quadtree -----------------------------------------------------------------------------------------------------------
@query(f"WITH {_LEAF}, {_D9}, {_NEAR} SELECT gid, CAST((dx + 1) + 3 * (dy + 1) AS INTEGER) AS way, ngid, level, nlevel FROM near")
def contacts(spark, sf_dir):
    """Leaves that meet across faces and corners, from the smaller one."""
    return adjacency.pairs(numbered(spark, sf_dir), T.unit(2), "corner").select("gid", "way", "ngid", "level", "nlevel")


_FACES2 = f"{_LEAF}, {_D9}, {_NEAR}, side AS (SELECT gid, CASE WHEN dx = -1 THEN 0 WHEN dx = 1 THEN 1 WHEN dy = -1 THEN 2 ELSE 3 END AS face, ngid, level, nlevel FROM near WHERE (dx = 0) <> (dy = 0)), fs AS (SELECT range AS face FROM range(0, 4)), edge AS (SELECT gid, face FROM leaf, fs WHERE CASE face WHEN 0 THEN x = 0 WHEN 1 THEN x + (4096 >> level) = 4096 WHEN 2 THEN y = 0 ELSE y + (4096 >> level) = 4096 END)"


@query(f"WITH {_FACES2} SELECT gid AS lo, ngid AS hi, CAST(face AS INTEGER) AS face, nlevel < level AS hanging, false AS boundary FROM side WHERE nlevel < level OR gid < ngid UNION ALL SELECT gid, NULL, CAST(face AS INTEGER), false, true FROM edge")
def interfaces(spark, sf_dir):
    """Every face of the mesh once, from its small or lower side."""
    return adjacency.interfaces(numbered(spark, sf_dir), T.unit(2)).select("lo", "hi", F.col("face").cast("int").alias("face"), "hanging", "boundary")


_MESH = f"""{_BAL}, near AS (SELECT a.gid, a.level, a.cx, a.cy, dx, dy, b.gid AS ngid, b.level AS nlevel FROM bl a, d9 JOIN bl b
   ON b.level <= a.level AND (a.cx + dx) >> (a.level - b.level) = b.cx AND (a.cy + dy) >> (a.level - b.level) = b.cy
   WHERE (dx = 0) <> (dy = 0) AND a.cx + dx BETWEEN 0 AND (1 << a.level) - 1 AND a.cy + dy BETWEEN 0 AND (1 << a.level) - 1),
 side AS (SELECT gid, CASE WHEN dx = -1 THEN 0 WHEN dx = 1 THEN 1 WHEN dy = -1 THEN 2 ELSE 3 END AS face, ngid, level, nlevel, CASE WHEN dx <> 0 THEN cy & 1 ELSE cx & 1 END AS sub FROM near),
 mesh AS (SELECT gid, face, CAST(ngid AS VARCHAR) AS neighbors, CASE WHEN nlevel < level THEN 8 * (1 + sub) + xor(face, 1) ELSE xor(face, 1) END AS code FROM side
   UNION ALL SELECT ngid, xor(face, 1), string_agg(CAST(gid AS VARCHAR), ',' ORDER BY gid), min(face) - 8 FROM side WHERE nlevel < level GROUP BY ngid, face
   UNION ALL SELECT gid, f.range, CAST(gid AS VARCHAR), f.range FROM bl, range(0, 4) f WHERE CASE f.range WHEN 0 THEN x = 0 WHEN 1 THEN x + (4096 >> level) = 4096 WHEN 2 THEN y = 0 ELSE y + (4096 >> level) = 4096 END)"""


@query(f"WITH RECURSIVE {_MESH} SELECT gid, CAST(face AS INTEGER) AS face, neighbors, CAST(code AS INTEGER) AS code FROM mesh")
def neighbor_mesh(spark, sf_dir):
    """Neighbours of every face of every leaf of the balanced quadtree, coded by how they meet."""
    m = adjacency.mesh(numbered(spark, sf_dir, balanced=True), T.unit(2))
    return m.select("gid", F.col("face").cast("int").alias("face"), F.array_join(F.transform("neighbors", lambda n: n.cast("string")), ",").alias("neighbors"), "code")


@query(f"WITH {_LEAF}, w AS (SELECT gid, {_m('x', 'y')} AS m FROM leaf), c AS (SELECT o_orderkey, {_m('px', 'py')} AS m FROM (SELECT o_orderkey, (o_orderkey * 2654435761) % 4096 AS px, (o_custkey * 40503) % 4096 AS py FROM orders)) SELECT o_orderkey, (SELECT min(w.gid) FROM w JOIN leaf USING (gid) WHERE w.m > c.m OR (w.m = c.m AND leaf.level >= 12)) AS bound FROM c")
def lower_bound(spark, sf_dir):
    """The lowest leaf at or after each order's cell of level 12."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    up = Q.MAX - 12
    cells = o.select("o_orderkey", F.lit(0).cast("long").alias("tree"), Q.shl(F.col("o_orderkey") * 2654435761 % 4096, up).alias("x"), Q.shl(F.col("o_custkey") * 40503 % 4096, up).alias("y"), F.lit(12).alias("level"))
    return search.bound(cells, numbered(spark, sf_dir), 2).select("o_orderkey", "bound")


_RANKS4 = f"{_LEAF}, {_D9}, {_NEAR}, r AS (SELECT gid, n, CAST((SELECT count(*) FROM range(1, 4) t(p) WHERE ((SELECT count(*) FROM leaf) * p) // 4 <= gid) AS INTEGER) AS rank FROM leaf), e AS (SELECT gid, ngid FROM near UNION SELECT ngid, gid FROM near), g AS (SELECT DISTINCT a.rank, b.rank AS owner, b.gid FROM e JOIN r a ON a.gid = e.gid JOIN r b ON b.gid = e.ngid WHERE a.rank <> b.rank)"


@query(f"WITH {_RANKS4} SELECT rank, owner, gid FROM g UNION SELECT g.rank, r.rank, e.ngid FROM g JOIN e USING (gid) JOIN r ON r.gid = e.ngid WHERE r.rank <> g.rank")
def expanded_ghosts(spark, sf_dir):
    """Two layers of ghosts of four ranks."""
    f = event_forest(spark, sf_dir)
    leaves = cut(f.partition(4)[0])
    return adjacency.expand_ghosts(adjacency.ghosts(leaves, f.topology), leaves, f.topology)


@query(f"WITH {_RANKS4} SELECT owner AS rank, gid, count(*) AS holders FROM g GROUP BY ALL")
def mirrors(spark, sf_dir):
    """Leaves that are ghosts elsewhere, and of how many ranks."""
    f = event_forest(spark, sf_dir)
    return adjacency.mirrors(adjacency.ghosts(cut(f.partition(4)[0]), f.topology))


@query(f"WITH {_LEAF}, cut AS (SELECT CAST(p AS INTEGER) AS rank, ((SELECT count(*) FROM leaf) * p) // 9 AS g FROM range(0, 10) t(p)), fam AS (SELECT min(gid) AS lo FROM leaf WHERE level > 0 GROUP BY level, cx >> 1, cy >> 1 HAVING count(*) = 4) SELECT rank, coalesce((SELECT CASE WHEN lo + 4 - g > g - lo THEN lo ELSE lo + 4 END FROM fam WHERE lo < g AND g < lo + 4), g) AS first_gid FROM cut")
def family_cuts(spark, sf_dir):
    """Cuts between nine ranks, moved so that no family is split."""
    f = event_forest(spark, sf_dir)
    n = f.leaves.count()
    moved = f.family_safe([n * p // 9 for p in range(10)])
    return spark.createDataFrame(list(enumerate(moved)), "rank int, first_gid long")


@query(f"WITH {_LEAF}, t AS (SELECT count(*) AS m FROM leaf) SELECT gid, level, x, y, CAST(CASE WHEN gid < m // 10 THEN 0 WHEN gid < m // 10 + m // 2 THEN 2 ELSE 3 END AS INTEGER) AS rank FROM leaf, t")
def partition_given(spark, sf_dir):
    """Four ranks with prescribed numbers of leaves, one of them without any."""
    f = event_forest(spark, sf_dir)
    n = f.leaves.count()
    return f.partition_given([n // 10, 0, n // 2, n - n // 10 - n // 2]).select("gid", "level", _grid("x"), _grid("y"), "rank")


@query(f"WITH {_LEAF}, t AS (SELECT count(*) AS n FROM leaf), r AS (SELECT leaf.gid, leaf.n, CAST((SELECT count(*) FROM range(1, 5) q(p) WHERE t.n * p // 5 <= gid) AS INTEGER) AS rank FROM leaf, t) SELECT rank, count(*) AS leaves, CAST(sum(n) AS BIGINT) AS points FROM r GROUP BY rank")
def transferred(spark, sf_dir):
    """Data of leaves moved to the ranks that hold them after a partition: leaves and points of each of five."""
    f = event_forest(spark, sf_dir)
    data = cut(f.numbered()).select("gid", "n")
    after = adapt.transfer(data, f.partition(5)[0])
    return after.groupBy("rank").agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("points"))


@query(
    f"""WITH RECURSIVE {_CORNER}, u AS (SELECT gid, CASE WHEN hanging THEN ((cx >> 1) + dx) << (13 - level) ELSE px END AS x, CASE WHEN hanging THEN ((cy >> 1) + dy) << (13 - level) ELSE py END AS y FROM cor JOIN hung USING (px, py)),
 t AS (SELECT count(*) AS n FROM bl), r AS (SELECT gid, CAST((SELECT count(*) FROM range(1, 3) q(p) WHERE t.n * p // 3 <= gid) AS INTEGER) AS rank FROM bl, t), o AS (SELECT x, y, min(gid) AS owner FROM u GROUP BY ALL)
 SELECT x, y, s.rank, ro.rank AS owner_rank FROM (SELECT DISTINCT x, y, rank FROM u JOIN r USING (gid)) s JOIN o USING (x, y) JOIN r ro ON ro.gid = o.owner"""
)
def shared_nodes(spark, sf_dir):
    """Nodes of degree 1 at every rank of three that uses them, with the value of the rank that owns them."""
    leaves = numbered(spark, sf_dir, balanced=True)
    used, made = nodes.number(leaves, T.unit(2), 1)
    ranked = cut(Forest(T.unit(2), leaves.drop("gid")).partition(3)[0])
    values = made.join(ranked.select(F.col("gid").alias("owner"), "rank"), "owner").select("node_id", "rank", F.col("rank").alias("owner_rank"))
    held = nodes.share_owned(values, used, made, ranked)
    return held.join(made, "node_id").select(Q.shr(F.col("c_x"), Q.MAX - 12).alias("x"), Q.shr(F.col("c_y"), Q.MAX - 12).alias("y"), "rank", "owner_rank")


@query(f"WITH {_RANKS4} SELECT r.gid, r.rank, NOT EXISTS (SELECT 1 FROM e JOIN r o ON o.gid = e.ngid WHERE e.gid = r.gid AND o.rank <> r.rank) AS owned FROM r")
def owned_neighborhoods(spark, sf_dir):
    """Whether all leaves around a leaf belong to its rank, of four."""
    f = event_forest(spark, sf_dir)
    return adjacency.owned_neighborhoods(cut(f.partition(4)[0]), f.topology)


@query(f"WITH RECURSIVE {_MESH} SELECT m.gid, CAST(face AS INTEGER) AS face, count(*) AS neighbors, CAST(sum(b.level) AS BIGINT) AS levels FROM mesh m JOIN bl b ON list_contains(string_split(m.neighbors, ','), CAST(b.gid AS VARCHAR)) GROUP BY ALL")
def mesh_data(spark, sf_dir):
    """Levels of the neighbours of every face of every leaf of the balanced quadtree, summed."""
    leaves = numbered(spark, sf_dir, balanced=True)
    each = adjacency.neighbor_data(adjacency.mesh(leaves, T.unit(2)), leaves.select("gid", "level"))
    return each.groupBy("gid", F.col("face").cast("int").alias("face")).agg(F.count(F.lit(1)).alias("neighbors"), F.sum("level").alias("levels"))


_USES = f"""{_CORNER}, u AS (SELECT gid, CASE WHEN hanging THEN ((cx >> 1) + dx) << (13 - level) ELSE px END AS x, CASE WHEN hanging THEN ((cy >> 1) + dy) << (13 - level) ELSE py END AS y FROM cor JOIN hung USING (px, py)),
 t AS (SELECT count(*) AS n FROM bl), r AS (SELECT gid, CAST((SELECT count(*) FROM range(1, 3) q(p) WHERE t.n * p // 3 <= gid) AS INTEGER) AS rank FROM bl, t), ur AS (SELECT DISTINCT x, y, gid, rank FROM u JOIN r USING (gid))"""


@query(f"WITH RECURSIVE {_USES} SELECT DISTINCT a.rank, b.rank AS owner, b.gid FROM (SELECT DISTINCT x, y, rank FROM ur) a JOIN ur b USING (x, y) WHERE a.rank <> b.rank")
def ghosts_by_nodes(spark, sf_dir):
    """Leaves of other ranks, of three, that share a node with a rank's own."""
    leaves = numbered(spark, sf_dir, balanced=True)
    used, _ = nodes.number(leaves, T.unit(2), 1)
    ranked = cut(Forest(T.unit(2), leaves.drop("gid")).partition(3)[0])
    return adjacency.ghosts_by_nodes(used, ranked)


@query(f"WITH {_LEAF}, t AS (SELECT count(*) AS n FROM leaf), r AS (SELECT leaf.gid, x, y, level, CAST((SELECT count(*) FROM range(1, 5) q(p) WHERE t.n * p // 5 <= gid) AS INTEGER) AS rank FROM leaf, t) SELECT rank, CAST(0 AS BIGINT) AS tree, min(gid) AS first, max(gid) AS last, bool_or(x = 0 AND y = 0) AS has_begin, bool_or(x + (4096 >> level) = 4096 AND y + (4096 >> level) = 4096) AS has_end FROM r GROUP BY rank")
def trees_of_ranks(spark, sf_dir):
    """Each rank's part of the tree, of five, and whether it holds the tree's begin and end."""
    return adjacency.trees_of_ranks(event_forest(spark, sf_dir).partition(5)[0], 2)


@query(f"WITH {_LEAF}, t AS (SELECT count(*) AS n FROM leaf), b AS (SELECT {_m('x', 'y')} AS lo, gid FROM leaf), w AS (SELECT max(b.lo) FILTER (WHERE b.gid = n // 3) AS lo, coalesce(max(b.lo) FILTER (WHERE b.gid = 2 * n // 3), 1 << 24) AS hi FROM b, t), c AS (SELECT o_orderkey, CAST(o_orderkey % 6 + 1 AS INTEGER) AS l, (o_orderkey * 2654435761) % 4096 AS px, (o_custkey * 40503) % 4096 AS py FROM orders), k AS (SELECT o_orderkey, {_m('(px >> (12 - l) << (12 - l))', '(py >> (12 - l) << (12 - l))')} AS m, 1 << (2 * (12 - l)) AS size FROM c) SELECT o_orderkey, m < hi AND m + size > lo AS overlaps, m >= lo AND m + size <= hi AS inside FROM k, w")
def cells_in_range(spark, sf_dir):
    """Whether each order's cell of level 1 to 6 meets and lies in the middle third of the leaves."""
    leaves = numbered(spark, sf_dir)
    n = leaves.count()
    q = Q.cell(2)
    ends = leaves.where(F.col("gid").isin(n // 3, 2 * n // 3 - 1)).orderBy("gid").select(F.struct(*Q.columns(Q.first_descendant(q))).alias("first"), F.struct(*Q.columns(Q.last_descendant(q))).alias("last")).collect()  # two rows
    first, last = (Q.Cell((F.lit(e["x"]), F.lit(e["y"])), F.lit(e["level"])) for e in (ends[0]["first"], ends[-1]["last"]))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    up = Q.MAX - 12
    cell = Q.ancestor(Q.Cell((Q.shl(F.col("o_orderkey") * 2654435761 % 4096, up), Q.shl(F.col("o_custkey") * 40503 % 4096, up)), F.lit(Q.MAX)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    inside = o.select("o_orderkey", *Q.columns(cell))
    return inside.select("o_orderkey", Q.overlaps_range(q, first, last).alias("overlaps"), Q.is_inside_range(q, first, last).alias("inside"))


@query(
    f"""WITH {points_sql(2)}, px AS (SELECT p0, p1, value FROM pts JOIN events USING (event_id)),
 cnt AS (SELECT l AS level, p0 >> (12 - l) AS cx, p1 >> (12 - l) AS cy, count(*) AS n, min(value) AS low, max(value) AS high FROM px, (SELECT CAST(range AS INTEGER) AS l FROM range(0, 8)) GROUP BY ALL),
 split AS (SELECT level, cx, cy FROM cnt WHERE high - low > 40 AND level < 7), d2(dx, dy) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)),
 kids AS (SELECT level + 1 AS level, 2 * cx + dx AS cx, 2 * cy + dy AS cy FROM split, d2 UNION ALL SELECT 0, 0, 0)
 SELECT level, k.cx << (12 - level) AS x, k.cy << (12 - level) AS y, coalesce(n, 0) AS n, low, high FROM kids k ANTI JOIN split USING (level, cx, cy) LEFT JOIN cnt USING (level, cx, cy)"""
)
def image_quadtree(spark, sf_dir):
    """A quadtree refined where the events' values differ by more than 40, down to level 7."""
    p = points(spark, sf_dir, 2).join(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value"), "event_id")
    return image_forest(p, "value", T.unit(2), 40.0, 7).leaves.select("level", _grid("x"), _grid("y"), "n", "low", "high")


# --- several trees --------------------------------------------------------------------------------------------------------------------
_TREES = f"""{points_sql(2)},
 cnt AS (SELECT event_id % 6 AS tree, l AS level, p0 >> (12 - l) AS cx, p1 >> (12 - l) AS cy, count(*) AS n FROM pts, (SELECT CAST(range AS INTEGER) AS l FROM range(0, 7)) GROUP BY ALL),
 split AS (SELECT tree, level, cx, cy FROM cnt WHERE n > 30 AND level < 6),
 kids AS (SELECT tree, level + 1 AS level, 2 * cx + a.range AS cx, 2 * cy + b.range AS cy FROM split, range(0, 2) a, range(0, 2) b UNION ALL SELECT range, 0, 0, 0 FROM range(0, 6)),
 leaf AS (SELECT * FROM kids ANTI JOIN split USING (tree, level, cx, cy))"""


def star_forest(spark, sf_dir) -> Forest:
    """A forest of six trees around a point, refined where the events of each tree are."""
    p = points(spark, sf_dir, 2).withColumn("tree", F.col("event_id") % 6)
    return points_forest(p, T.star(), 30, 6)


@query(f"WITH {_TREES}, t AS (SELECT tree, count(*) AS n FROM leaf GROUP BY tree) SELECT tree, n, CAST(sum(n) OVER (ORDER BY tree) AS BIGINT) - n AS before FROM t")
def tree_counts(spark, sf_dir):
    """Leaves of each tree of a star, and those of the trees before."""
    return star_forest(spark, sf_dir).counts_by_tree().select("tree", "n", F.col("before").cast("long").alias("before"))


@query(f"WITH {_TREES} SELECT tree, level, count(*) AS n FROM leaf GROUP BY ALL")
def tree_levels(spark, sf_dir):
    return star_forest(spark, sf_dir).level_histogram()


@query("SELECT CAST(0 AS BIGINT) AS invalid, CAST(0 AS BIGINT) AS unknown_trees, CAST(0 AS BIGINT) AS overlaps, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS open_trees")
def valid_forest(spark, sf_dir):
    """What is wrong with a balanced forest on a star: nothing."""
    f = star_forest(spark, sf_dir)
    found = Forest(f.topology, f.leaves.select(*f.keys)).balance("corner").validity()
    return spark.createDataFrame([tuple(found[k] for k in ("invalid", "unknown_trees", "overlaps", "gaps", "open_trees"))], "invalid long, unknown_trees long, overlaps long, gaps long, open_trees long")


# --- columns of layers -------------------------------------------------------------------------------------------------------------------
@query(f"WITH {_LEAF}, l AS (SELECT gid AS g, level, x, y, k, row_number() OVER (ORDER BY gid, k) - 1 AS gid FROM leaf, (SELECT range AS k FROM range(0, 4))), t AS (SELECT count(*) AS n FROM l) SELECT level, x, y, CAST(k * 1024 AS BIGINT) AS z, gid, CAST((SELECT count(*) FROM range(1, 3) q(p) WHERE (t.n * p // 3) // 4 * 4 <= gid) AS INTEGER) AS rank FROM l, t")
def column_partition(spark, sf_dir):
    """Columns of four layers over the quadtree's leaves in three ranks, no column split."""
    c = Columns.over(event_forest(spark, sf_dir), 2)
    return c.partition(3)[0].select("level", _grid("x"), _grid("y"), _grid("z"), "gid", "rank")


@query(f"WITH {_LEAF}, l AS (SELECT level, x, y, k, gid AS g, n + 1 AS w, row_number() OVER (ORDER BY gid, k) - 1 AS gid FROM leaf, (SELECT range AS k FROM range(0, 2))), s AS (SELECT *, sum(w) OVER (ORDER BY gid) AS upto, sum(w) OVER () AS total FROM l), cuts AS (SELECT p, min(gid) // 2 * 2 AS g FROM s, range(1, 4) t(p) WHERE upto * 4 // total >= p GROUP BY p) SELECT gid, CAST((SELECT count(*) FROM cuts WHERE cuts.g <= l.gid) AS INTEGER) AS rank FROM l")
def column_weights(spark, sf_dir):
    """Columns of two layers in four ranks of near-equal weight, which is one more than the column's points for each layer."""
    f = event_forest(spark, sf_dir)
    c = Columns.over(f, 1)
    weighted = Columns(f.topology, c.layers.join(f.leaves, ["tree", "x", "y", "level"]))
    return weighted.partition(4, F.col("n") + 1)[0].select("gid", "rank")


@query(f"WITH {_LEAF}, fam AS (SELECT level - 1 AS level, cx >> 1 AS cx, cy >> 1 AS cy FROM leaf WHERE level > 3 GROUP BY ALL HAVING count(*) = 4), c AS (SELECT level, cx << (12 - level) AS x, cy << (12 - level) AS y FROM fam UNION ALL SELECT level, x, y FROM leaf l WHERE NOT EXISTS (SELECT 1 FROM fam f WHERE f.level = l.level - 1 AND f.cx = l.cx >> 1 AND f.cy = l.cy >> 1)) SELECT level, x, y, CAST(1 AS INTEGER) AS zlevel, CAST(k * 2048 AS BIGINT) AS z FROM c, (SELECT range AS k FROM range(0, 2))")
def column_families(spark, sf_dir):
    """Families of columns of level 4 and finer become their parents; their layers are merged in pairs first."""
    c = Columns.over(event_forest(spark, sf_dir), 2).coarsen_layers(lambda d: F.lit(True))
    out = c.coarsen_columns(lambda d: F.col("level") >= 3).layers
    return out.select("level", _grid("x"), _grid("y"), "zlevel", _grid("z"))


@query(f"WITH {_LEAF}, r AS (SELECT level + 1 AS level, x + dx * (2048 >> level) AS x, y + dy * (2048 >> level) AS y FROM leaf, d2 WHERE level < 5 UNION ALL SELECT level, x, y FROM leaf WHERE level >= 5) SELECT level, x, y, CAST(2 AS INTEGER) AS layers FROM r")
def column_refinement(spark, sf_dir):
    """Columns below level 5 become four, each with both layers: the profile of every column."""
    c = Columns.over(event_forest(spark, sf_dir), 1).refine_columns(lambda d: F.col("level") < 5)
    return c.profiles().select("level", _grid("x"), _grid("y"), F.size("levels").alias("layers"))


# --- SQL of earlier queries ------------------------------------------------------------------------------------------------------------------
ORACLE["stream_counts"] = f"WITH {_LEAF} SELECT CAST(0 AS BIGINT) AS tree, x << 18 AS x, y << 18 AS y, level, date_trunc('hour', ts) AS start, count(*) AS n FROM pts JOIN events USING (event_id) JOIN leaf ON px >> (12 - level) = cx AND py >> (12 - level) = cy GROUP BY ALL"

_CYCLE = f"""{points_sql(2)}, d2(dx, dy) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)), {_D9},
 g AS (SELECT a.range AS cx, b.range AS cy, coalesce(n, 0) AS n FROM range(0, 16) a, range(0, 16) b LEFT JOIN (SELECT p0 >> 8 AS px, p1 >> 8 AS py, count(*) AS n FROM pts GROUP BY ALL) ON px = a.range AND py = b.range),
 m AS (SELECT avg(n) AS mean FROM g), fam AS (SELECT cx >> 1 AS fx, cy >> 1 AS fy FROM g, m GROUP BY ALL HAVING bool_and(n <= mean / 2)),
 leaf AS (SELECT 5 AS level, 2 * cx + dx AS cx, 2 * cy + dy AS cy FROM g, m, d2 WHERE n > mean UNION ALL SELECT 3, fx, fy FROM fam
   UNION ALL SELECT 4, cx, cy FROM g, m WHERE n <= mean AND NOT EXISTS (SELECT 1 FROM fam WHERE fx = cx >> 1 AND fy = cy >> 1)),
 s(level, cx, cy) AS (SELECT DISTINCT level - 1, cx >> 1, cy >> 1 FROM leaf UNION SELECT level - 1, (cx + dx) >> 1, (cy + dy) >> 1 FROM s, d9 WHERE level > 0 AND cx + dx BETWEEN 0 AND (1 << level) - 1 AND cy + dy BETWEEN 0 AND (1 << level) - 1),
 bk AS (SELECT level + 1 AS level, 2 * cx + dx AS cx, 2 * cy + dy AS cy FROM s, d2)"""
ORACLE["adapt_cycle"] = f"WITH RECURSIVE {_CYCLE} SELECT CAST(0 AS BIGINT) AS tree, cx << (30 - level) AS x, cy << (30 - level) AS y, CAST(level AS INTEGER) AS level, CAST(CASE WHEN level > 4 THEN 1 ELSE -1 END AS INTEGER) AS change FROM bk ANTI JOIN s USING (level, cx, cy) WHERE level <> 4"
