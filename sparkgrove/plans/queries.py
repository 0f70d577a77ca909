"""Queries of the engine's own operators over the driver's tables, each with the SQL that it is compared with.

Points come from ids on a grid of 4,096 x 4,096, events crowded towards the origin; leaves are those of a quadtree with at most 50 points each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import quadrant as Q
from ..operators import adjacency, nodes, search
from ..operators.adapt import Adaptive
from ..operators.columns import Columns
from ..operators.forest import Forest, complete, linearize, points_forest, same_size_neighbors
from ..sources import topology as T
from ..streaming import counts
from .lineage import cut

BITS, MOST = 12, 50
UP = Q.MAX - BITS

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, tree, x, y of all events."""
    return placed(_table(spark, sf_dir, "events")).drop("ts")


def placed(events: DataFrame) -> DataFrame:
    """event_id, ts, tree, x, y: ids scattered over the grid and squared, so that points crowd towards the origin."""
    e = events.select("event_id", "ts", (F.col("event_id") * 2654435761 % 4096).alias("a"), (F.col("user_id") * 40503 % 4096).alias("b"))
    return e.select("event_id", "ts", F.lit(0).cast("long").alias("tree"), *[Q.shl(Q.shr(F.col(c) * F.col(c), BITS), UP).alias(n) for c, n in (("a", "x"), ("b", "y"))])


def event_forest(spark: SparkSession, sf_dir: str) -> Forest:
    return points_forest(event_points(spark, sf_dir), T.unit(2), MOST, BITS)


def numbered(spark: SparkSession, sf_dir: str, balanced: bool = False) -> DataFrame:
    f = event_forest(spark, sf_dir)
    if balanced:
        f = Forest(f.topology, cut(f.leaves.select(*f.keys))).balance("corner")
    return cut(f.numbered())


def _grid(c: str) -> F.Column:
    """A coordinate in units of the 4,096 grid."""
    return Q.shr(F.col(c), UP).alias(c)


# --- SQL pieces ---------------------------------------------------------------------------------------------------------------
def _m(x: str, y: str, bits: int = BITS) -> str:
    return "(" + " + ".join(f"((({x} >> {i}) & 1) << {2 * i}) + ((({y} >> {i}) & 1) << {2 * i + 1})" for i in range(bits)) + ")"


_PTS = "pts AS (SELECT event_id, (a * a) >> 12 AS px, (b * b) >> 12 AS py FROM (SELECT event_id, (event_id * 2654435761) % 4096 AS a, (user_id * 40503) % 4096 AS b FROM events))"
_LEAF = f"""{_PTS},
 cnt AS (SELECT l AS level, px >> (12 - l) AS cx, py >> (12 - l) AS cy, count(*) AS n FROM pts, (SELECT CAST(range AS INTEGER) AS l FROM range(0, 13)) GROUP BY ALL),
 split AS (SELECT level, cx, cy FROM cnt WHERE n > {MOST} AND level < 12),
 d2(dx, dy) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)),
 kids AS (SELECT level + 1 AS level, 2 * cx + dx AS cx, 2 * cy + dy AS cy FROM split, d2 UNION ALL SELECT 0, 0, 0),
 leaf0 AS (SELECT k.level, k.cx, k.cy, coalesce(cnt.n, 0) AS n FROM kids k ANTI JOIN split USING (level, cx, cy) LEFT JOIN cnt USING (level, cx, cy)),
 leaf AS (SELECT *, cx << (12 - level) AS x, cy << (12 - level) AS y, row_number() OVER (ORDER BY {_m("(cx << (12 - level))", "(cy << (12 - level))")}) - 1 AS gid FROM leaf0)"""
_D9 = "d9(dx, dy) AS (SELECT a.range - 1, b.range - 1 FROM range(0, 3) a, range(0, 3) b)"
_BAL = f"""{_LEAF}, {_D9},
 s(level, cx, cy) AS (SELECT DISTINCT level - 1, cx >> 1, cy >> 1 FROM leaf WHERE level > 0
   UNION SELECT level - 1, (cx + dx) >> 1, (cy + dy) >> 1 FROM s, d9 WHERE level > 0 AND cx + dx BETWEEN 0 AND (1 << level) - 1 AND cy + dy BETWEEN 0 AND (1 << level) - 1),
 bk AS (SELECT level + 1 AS level, 2 * cx + dx AS cx, 2 * cy + dy AS cy FROM s, d2 UNION ALL SELECT 0, 0, 0),
 bl AS (SELECT *, cx << (12 - level) AS x, cy << (12 - level) AS y, row_number() OVER (ORDER BY {_m("(cx << (12 - level))", "(cy << (12 - level))")}) - 1 AS gid FROM bk ANTI JOIN s USING (level, cx, cy))"""
_NEAR = """near AS (SELECT a.gid, a.level, dx, dy, b.gid AS ngid, b.level AS nlevel, a.n, b.n AS nn FROM leaf a, d9 JOIN leaf b
   ON b.level <= a.level AND (a.cx + dx) >> (a.level - b.level) = b.cx AND (a.cy + dy) >> (a.level - b.level) = b.cy
   WHERE (dx <> 0 OR dy <> 0) AND a.cx + dx BETWEEN 0 AND (1 << a.level) - 1 AND a.cy + dy BETWEEN 0 AND (1 << a.level) - 1)"""


# --- keys and scalar functions ----------------------------------------------------------------------------------------------------
@query(f"WITH {_PTS} SELECT event_id, {_m('px', 'py')} AS id FROM pts")
def morton_encode(spark, sf_dir):
    """Index of every point on the uniform grid of level 12."""
    p = event_points(spark, sf_dir)
    return p.select("event_id", Q.linear_id(Q.Cell((F.col("x"), F.col("y")), F.lit(Q.MAX)), BITS).alias("id"))


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(" + ".join(f"((((l_orderkey * 8 + l_linenumber) >> {2 * i + k}) & 1) << {i})" for i in range(20)) + f" AS {c}" for k, c in enumerate("xy")) + " FROM lineitem")
def morton_decode(spark, sf_dir):
    """The cell of level 20 with the index 8 * order + line, in units of its length."""
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    q = Q.from_linear_id(F.col("l_orderkey") * 8 + F.col("l_linenumber"), 20)
    return li.select("*", *[Q.shr(c, 10).alias(a) for c, a in zip(q.xyz, "xy")])


@query(
    f"""WITH {_PTS}, c AS (SELECT *, CAST(event_id % 11 + 2 AS INTEGER) AS l FROM pts), q AS (SELECT *, px >> (12 - l) AS cx, py >> (12 - l) AS cy FROM c)
 SELECT event_id, l AS level, (cx & 1) + 2 * (cy & 1) AS child, (cx >> 1) << (13 - l) AS parent_x, (cy >> 1) << (13 - l) AS parent_y,
  {_m('cx', 'cy')} + 1 AS next_id, (SELECT max(k) FROM (SELECT CAST(range AS INTEGER) AS k FROM range(0, 13)) WHERE k <= l AND px >> (12 - k) = py >> (12 - k)) AS shared_level,
  ((px >> 11) & 1) + 2 * ((py >> 11) & 1) AS top_child FROM q"""
)
def cell_relatives(spark, sf_dir):
    """Child number, parent, index of the next cell, level of the nearest common ancestor with the mirrored cell, child number at level 1."""
    p = event_points(spark, sf_dir)
    level = (F.col("event_id") % 11 + 2).cast("int")
    q = Q.ancestor(Q.Cell((F.col("x"), F.col("y")), F.lit(Q.MAX)), level)
    up, other = Q.parent(q), Q.Cell(q.xyz[::-1], q.level)
    return p.select("event_id", level.alias("level"), Q.child_id(q).cast("long").alias("child"), Q.shr(up.xyz[0], UP).alias("parent_x"), Q.shr(up.xyz[1], UP).alias("parent_y"), (Q.linear_id(q, q.level) + 1).alias("next_id"), Q.nearest_common_ancestor(q, other).level.alias("shared_level"), Q.ancestor_id(q, F.lit(1)).cast("long").alias("top_child"))


# --- forests -------------------------------------------------------------------------------------------------------------------
@query(f"WITH {_LEAF} SELECT level, x, y, n FROM leaf")
def points_quadtree(spark, sf_dir):
    """Leaves of the quadtree in which no cell above level 12 holds more than 50 events."""
    return event_forest(spark, sf_dir).leaves.select("level", _grid("x"), _grid("y"), "n")


@query(f"WITH {_LEAF} SELECT level, count(*) AS leaves, CAST(sum(n) AS BIGINT) AS points FROM leaf GROUP BY level")
def level_histogram(spark, sf_dir):
    return event_forest(spark, sf_dir).leaves.groupBy("level").agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("points"))


@query(f"WITH {_LEAF} SELECT level, branches, leaves FROM (SELECT level, count(*) AS branches FROM split GROUP BY level) FULL JOIN (SELECT level, count(*) AS leaves FROM leaf GROUP BY level) USING (level)".replace("SELECT level, branches, leaves", "SELECT level, coalesce(branches, 0) AS branches, coalesce(leaves, 0) AS leaves"))
def branches_and_leaves(spark, sf_dir):
    return search.branches_and_leaves(event_forest(spark, sf_dir))


@query(f"WITH {_LEAF} SELECT level + 1 AS level, x + dx * (2048 >> level) AS x, y + dy * (2048 >> level) AS y FROM leaf, d2 WHERE n > 25 AND level < 12 UNION ALL SELECT level, x, y FROM leaf WHERE n <= 25 OR level = 12")
def refine_once(spark, sf_dir):
    """Leaves with more than 25 points become four."""
    return event_forest(spark, sf_dir).refine(lambda d: F.col("n") > 25, max_level=BITS).leaves.select("level", _grid("x"), _grid("y"))


@query(
    f"""WITH {_LEAF}, fam AS (SELECT level - 1 AS level, cx >> 1 AS cx, cy >> 1 AS cy, CAST(sum(n) AS BIGINT) AS n FROM leaf WHERE level > 0 GROUP BY ALL HAVING count(*) = 4 AND sum(n) <= 80)
 SELECT level, cx << (12 - level) AS x, cy << (12 - level) AS y, n FROM fam UNION ALL
 SELECT level, x, y, n FROM leaf l WHERE NOT EXISTS (SELECT 1 FROM fam f WHERE f.level = l.level - 1 AND f.cx = l.cx >> 1 AND f.cy = l.cy >> 1)"""
)
def coarsen_families(spark, sf_dir):
    """Families with at most 80 points together become their parent."""
    total = lambda: F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)
    return event_forest(spark, sf_dir).coarsen(lambda d: total() <= 80, replace_payload={"n": total()}).leaves.select("level", _grid("x"), _grid("y"), "n")


@query(f"WITH RECURSIVE {_BAL} SELECT level, x, y FROM bl")
def balanced_quadtree(spark, sf_dir):
    """The least refinement in which leaves that touch differ by one level at most."""
    return numbered(spark, sf_dir, balanced=True).select("level", _grid("x"), _grid("y"))


@query(f"WITH {_PTS}, c AS (SELECT DISTINCT CAST(event_id % 6 + 3 AS INTEGER) AS level, px >> (12 - CAST(event_id % 6 + 3 AS INTEGER)) AS cx, py >> (12 - CAST(event_id % 6 + 3 AS INTEGER)) AS cy FROM pts) SELECT level, cx << (12 - level) AS x, cy << (12 - level) AS y FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.level > a.level AND b.cx >> (b.level - a.level) = a.cx AND b.cy >> (b.level - a.level) = a.cy)")
def finest_cells(spark, sf_dir):
    """Overlapping cells of levels 3 to 8, made linear: the finest stay."""
    return linearize(_mixed(spark, sf_dir), 2).select("level", _grid("x"), _grid("y"))


def _mixed(spark, sf_dir) -> DataFrame:
    level = (F.col("event_id") % 6 + 3).cast("int")
    q = Q.ancestor(Q.Cell((F.col("x"), F.col("y")), F.lit(Q.MAX)), level)
    return event_points(spark, sf_dir).select("tree", *Q.columns(q))


@query(
    """WITH pts AS (SELECT (c_custkey * 2654435761) % 4096 AS px, (c_custkey * 40503) % 4096 AS py FROM customer), d2(dx, dy) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)),
 i AS (SELECT DISTINCT l AS level, px >> (12 - l) AS cx, py >> (12 - l) AS cy FROM pts, (SELECT CAST(range AS INTEGER) AS l FROM range(0, 8))),
 k AS (SELECT level + 1 AS level, 2 * cx + dx AS cx, 2 * cy + dy AS cy FROM i, d2)
 SELECT level, cx << (12 - level) AS x, cy << (12 - level) AS y FROM k ANTI JOIN i USING (level, cx, cy)"""
)
def completed_tree(spark, sf_dir):
    """The coarsest tree with the cells of level 8 around all customers as leaves."""
    c = _table(spark, sf_dir, "customer")
    p = c.select(F.lit(0).cast("long").alias("tree"), Q.shl(F.col("c_custkey") * 2654435761 % 4096, UP).alias("x"), Q.shl(F.col("c_custkey") * 40503 % 4096, UP).alias("y"))
    cells = p.select("tree", *Q.columns(Q.ancestor(Q.Cell((F.col("x"), F.col("y")), F.lit(Q.MAX)), F.lit(8))))
    return complete(cells, T.unit(2)).leaves.select("level", _grid("x"), _grid("y"))


# --- order and partition -------------------------------------------------------------------------------------------------------
@query(f"WITH {_LEAF} SELECT gid, level, x, y, CAST((SELECT count(*) FROM range(1, 7) t(p) WHERE ((SELECT count(*) FROM leaf) * p) // 7 <= gid) AS INTEGER) AS rank FROM leaf")
def partition_uniform(spark, sf_dir):
    """Seven ranks with equal numbers of leaves."""
    return event_forest(spark, sf_dir).partition(7)[0].select("gid", "level", _grid("x"), _grid("y"), "rank")


@query(f"WITH {_LEAF}, w AS (SELECT gid, sum(n) OVER (ORDER BY gid) AS upto, sum(n) OVER () AS total FROM leaf) SELECT gid, CAST(least(4, upto * 5 // total) AS INTEGER) AS rank FROM w")
def partition_weighted(spark, sf_dir):
    """Five ranks with near-equal numbers of points."""
    return event_forest(spark, sf_dir).partition(5, F.col("n"))[0].select("gid", "rank")


@query(f"WITH {_LEAF}, f AS (SELECT CAST(rank AS INTEGER) AS rank, ((SELECT count(*) FROM leaf) * rank) // 4 AS g FROM range(0, 4) t(rank)), o AS (SELECT rank, x, y FROM f JOIN leaf ON gid = g), p AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4096 AS px, (o_custkey * 40503) % 4096 AS py FROM orders) SELECT o_orderkey, (SELECT max(rank) FROM o WHERE {_m('o.x', 'o.y')} <= {_m('p.px', 'p.py')}) AS owner FROM p")
def point_owner(spark, sf_dir):
    """The rank of four whose range of the curve holds each order's point: an as-of join."""
    f = event_forest(spark, sf_dir)
    first = search.positions(f.partition(4)[0], 2)
    o = _table(spark, sf_dir, "orders")
    p = o.select("o_orderkey", F.lit(0).cast("long").alias("tree"), Q.shl(F.col("o_orderkey") * 2654435761 % 4096, UP).alias("x"), Q.shl(F.col("o_custkey") * 40503 % 4096, UP).alias("y"), F.lit(Q.QMAX).alias("level"))
    return search.owners(p, first, 2).select("o_orderkey", "owner")


# --- search -----------------------------------------------------------------------------------------------------------------------
@query(f"WITH {_LEAF} SELECT event_id, level, x, y FROM pts JOIN leaf ON px >> (12 - level) = cx AND py >> (12 - level) = cy")
def point_in_leaf(spark, sf_dir):
    """Every event with the leaf that holds it."""
    hit = search.locate(event_points(spark, sf_dir), cut(event_forest(spark, sf_dir).leaves), 2)
    return hit.select("event_id", F.col("l_level").alias("level"), Q.shr(F.col("l_x"), UP).alias("x"), Q.shr(F.col("l_y"), UP).alias("y"))


@query(
    f"""WITH {_LEAF}, disc AS (SELECT s_suppkey, (s_suppkey * 2654435761) % 4096 AS px, (s_suppkey * 40503) % 4096 AS py FROM supplier)
 SELECT s_suppkey, level, x, y FROM disc JOIN leaf ON power(greatest(x - px, px - (x + (4096 >> level)), 0), 2) + power(greatest(y - py, py - (y + (4096 >> level)), 0), 2) <= 62500"""
)
def disc_search(spark, sf_dir):
    """Leaves that meet a disc of radius 250 around each supplier, by a top-down search of all discs at once."""
    s = _table(spark, sf_dir, "supplier")
    discs = s.select("s_suppkey", F.lit(0).cast("long").alias("tree"), (F.col("s_suppkey") * 2654435761 % 4096).alias("px"), (F.col("s_suppkey") * 40503 % 4096).alias("py"))

    def near(d):
        side = Q.shr(Q.length(F.col("level")), UP)
        out = F.lit(0).cast("long")
        for a, p in (("x", "px"), ("y", "py")):
            low = Q.shr(F.col(a), UP)
            gap = F.greatest(low - F.col(p), F.col(p) - (low + side), F.lit(0).cast("long"))
            out = out + gap * gap
        return out <= 250 * 250

    return search.search(event_forest(spark, sf_dir), discs, near, alike=("px", "py")).select("s_suppkey", "level", _grid("x"), _grid("y"))


@query(f"WITH {_LEAF}, c AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4096 AS px, (o_custkey * 40503) % 4096 AS py FROM orders) SELECT o_orderkey, (SELECT max(gid) FROM leaf WHERE {_m('x', 'y')} <= {_m('px', 'py')} AND NOT ({_m('x', 'y')} = {_m('px', 'py')} AND level > 12)) AS bound FROM c")
def higher_bound(spark, sf_dir):
    """The highest leaf at or before each order's cell of level 12, by an as-of join on the curve."""
    o = _table(spark, sf_dir, "orders")
    cells = o.select("o_orderkey", F.lit(0).cast("long").alias("tree"), Q.shl(F.col("o_orderkey") * 2654435761 % 4096, UP).alias("x"), Q.shl(F.col("o_custkey") * 40503 % 4096, UP).alias("y"), F.lit(BITS).alias("level"))
    return search.bound(cells, numbered(spark, sf_dir), 2, lower=False).select("o_orderkey", "bound")


# --- adjacency -------------------------------------------------------------------------------------------------------------------------
@query(f"WITH {_LEAF}, {_D9}, {_NEAR} SELECT gid, CASE WHEN dx = -1 THEN 0 WHEN dx = 1 THEN 1 WHEN dy = -1 THEN 2 ELSE 3 END AS face, ngid, nlevel, nlevel < level AS hanging FROM near WHERE (dx = 0) <> (dy = 0)")
def face_sides(spark, sf_dir):
    """Face sides with a neighbour, from the smaller leaf."""
    return adjacency.faces(numbered(spark, sf_dir), T.unit(2)).where("ngid is not null").select("gid", "face", "ngid", "nlevel", "hanging")


@query(f"WITH {_LEAF}, {_D9}, {_NEAR} SELECT DISTINCT gid, ngid, level, nlevel FROM near WHERE level - nlevel > 1")
def unbalanced_contacts(spark, sf_dir):
    return adjacency.unbalanced(event_forest(spark, sf_dir))


_GHOST = f"{_LEAF}, {_D9}, {_NEAR}, r AS (SELECT gid, n, (SELECT count(*) FROM range(1, 4) t(p) WHERE ((SELECT count(*) FROM leaf) * p) // 4 <= gid) AS rank FROM leaf), e AS (SELECT gid, ngid FROM near UNION SELECT ngid, gid FROM near), g AS (SELECT DISTINCT a.rank, b.rank AS owner, b.gid, b.n FROM e JOIN r a ON a.gid = e.gid JOIN r b ON b.gid = e.ngid WHERE a.rank <> b.rank)"


@query(f"WITH {_GHOST} SELECT CAST(rank AS INTEGER) AS rank, CAST(owner AS INTEGER) AS owner, count(*) AS ghosts, CAST(sum(n) AS BIGINT) AS points FROM g GROUP BY ALL")
def ghost_exchange(spark, sf_dir):
    """For each rank of four and each owner: ghost leaves, and the points that their owners send along."""
    f = event_forest(spark, sf_dir)
    leaves = cut(f.partition(4)[0])
    g = adjacency.exchange(adjacency.ghosts(leaves, f.topology), leaves.select("gid", "n"))
    return g.groupBy("rank", "owner").agg(F.count(F.lit(1)).alias("ghosts"), F.sum("n").alias("points"))


# --- nodes -----------------------------------------------------------------------------------------------------------------------------
_CORNER = f"{_BAL}, cor AS (SELECT gid, level, cx, cy, dx, dy, (cx + dx) << (12 - level) AS px, (cy + dy) << (12 - level) AS py FROM bl, d2), pl AS (SELECT px, py, count(*) AS touching FROM cor GROUP BY ALL), hung AS (SELECT px, py, touching, EXISTS (SELECT 1 FROM bl WHERE px BETWEEN x AND x + (4096 >> level) AND py BETWEEN y AND y + (4096 >> level) AND NOT (px IN (x, x + (4096 >> level)) AND py IN (y, y + (4096 >> level)))) AS hanging FROM pl)"


@query(f"WITH RECURSIVE {_CORNER} SELECT px AS x, py AS y, touching, hanging FROM hung")
def corner_places(spark, sf_dir):
    """Distinct corners of the balanced tree, and which of them hang."""
    c = nodes.corner_nodes(numbered(spark, sf_dir, balanced=True), T.unit(2))
    return c.select(Q.shr(F.col("c_x"), UP).alias("x"), Q.shr(F.col("c_y"), UP).alias("y"), "touching", "hanging")


@query(
    f"""WITH RECURSIVE {_CORNER}, u AS (SELECT gid, CASE WHEN hanging THEN ((cx >> 1) + dx) << (13 - level) ELSE px END AS x, CASE WHEN hanging THEN ((cy >> 1) + dy) << (13 - level) ELSE py END AS y FROM cor JOIN hung USING (px, py))
 SELECT x, y, count(*) AS uses, CAST(min(gid) AS BIGINT) AS owner FROM u GROUP BY ALL"""
)
def linear_nodes(spark, sf_dir):
    """Continuous nodes of degree 1: place, how many elements use them, and the owner."""
    used, made = nodes.number(numbered(spark, sf_dir, balanced=True), T.unit(2), 1)
    per = used.groupBy("node_id").agg(F.count(F.lit(1)).alias("uses"))
    return per.join(made, "node_id").select(Q.shr(F.col("c_x"), UP).alias("x"), Q.shr(F.col("c_y"), UP).alias("y"), "uses", "owner")


# --- topology and geometry --------------------------------------------------------------------------------------------------------------
_BRICK = "t AS (SELECT tx, ty, row_number() OVER (ORDER BY " + _m("tx", "ty", 3) + ") - 1 AS tree FROM (SELECT a.range AS tx, b.range AS ty FROM range(0, 5) a, range(0, 3) b))"


@query(f"WITH {_BRICK}, {_PTS}, n AS (SELECT event_id, event_id % 15 AS tree, px, py FROM pts) SELECT event_id, round(tx + px / 4096.0, 9) AS px, round(ty + py / 4096.0, 9) AS py FROM n JOIN t USING (tree)")
def brick_positions(spark, sf_dir):
    """Points spread over the trees of a 5 x 3 brick, at their bilinear position."""
    p = event_points(spark, sf_dir).withColumn("tree", F.col("event_id") % 15)
    return G.vertex_map(p, T.brick((5, 3))).select("event_id", F.round("px", 9).alias("px"), F.round("py", 9).alias("py"))


@query(
    f"""WITH {_PTS}, a AS (SELECT event_id, event_id % 8 AS tree, px / 4096.0 AS u, py / 4096.0 AS v FROM pts), b AS (SELECT *, tan((u - 1 + tree % 2) * pi() / 4) AS t, 0.55 * 0.55 / 1.0 * power(1.0 / 0.55, 1 + v) AS r FROM a), c AS (SELECT *, r / sqrt(t * t + 1) AS q FROM b)
 SELECT event_id, round(CASE tree // 2 WHEN 0 THEN q WHEN 1 THEN -q * t WHEN 2 THEN -q ELSE q * t END, 6) + 0.0 AS px, round(CASE tree // 2 WHEN 0 THEN q * t WHEN 1 THEN q WHEN 2 THEN -q * t ELSE -q END, 6) + 0.0 AS py FROM c"""
)
def annulus_positions(spark, sf_dir):
    """Points spread over the eight trees of an annulus."""
    p = event_points(spark, sf_dir).withColumn("tree", F.col("event_id") % 8)
    out = G.place(p, T.shell2d(), G.shell2d(1.0, 0.55))
    return out.select("event_id", (F.round("px", 6) + 0.0).alias("px"), (F.round("py", 6) + 0.0).alias("py"))


@query(
    f"""WITH {_PTS}, p AS (SELECT event_id, px >> 7 AS cx, py >> 7 AS cy FROM pts WHERE px >> 7 IN (0, 31) OR py >> 7 IN (0, 31)), d(dx, dy) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)), o AS (SELECT event_id, cx + dx AS cx, cy + dy AS cy, dy FROM p, d)
 SELECT event_id, CASE WHEN dy <> 0 AND cy NOT BETWEEN 0 AND 31 THEN 31 - cx ELSE (cx + 32) % 32 END AS x, (cy + 32) % 32 AS y FROM o WHERE cx NOT BETWEEN 0 AND 31 OR cy NOT BETWEEN 0 AND 31"""
)
def wrapped_neighbors(spark, sf_dir):
    """Face neighbours across the seam of a tree that is periodic in x and twisted in y, of all cells of level 5 with points at the border."""
    p = event_points(spark, sf_dir)
    cells = p.select("event_id", "tree", *Q.columns(Q.ancestor(Q.Cell((F.col("x"), F.col("y")), F.lit(Q.MAX)), F.lit(5))))
    at = lambda c: Q.shr(F.col(c), 25)
    near = same_size_neighbors(cells.withColumns({"cx": at("x"), "cy": at("y")}), T.rotwrap(2), "face", carry=("event_id", "cx", "cy"))
    way = {a: F.floor(F.col("way") / 3**i).cast("int") % 3 - 1 for i, a in enumerate("xy")}
    crossed = ~(F.col("cx") + way["x"]).between(0, 31) | ~(F.col("cy") + way["y"]).between(0, 31)
    return near.where(crossed).select("event_id", at("x").alias("x"), at("y").alias("y"))


# --- columns of layers ---------------------------------------------------------------------------------------------------------------------
@query(f"WITH {_LEAF} SELECT level, x, y, CAST(CASE WHEN n > 25 AND k < 2 THEN 2 ELSE 1 END AS INTEGER) AS zlevel, k << 10 AS z FROM leaf, (VALUES (0), (1), (2)) t(k) WHERE n > 25 OR k < 2".replace("k << 10 AS z", "CASE WHEN n > 25 AND k < 2 THEN k * 1024 WHEN n > 25 THEN 2048 ELSE k * 2048 END AS z"))
def column_layers(spark, sf_dir):
    """Columns over the quadtree's leaves with two layers; the lower one is split where a column has more than 25 points."""
    f = event_forest(spark, sf_dir)
    c = Columns.over(f, 1)
    joined = Columns(f.topology, c.layers.join(f.leaves, ["tree", "x", "y", "level"]))
    out = joined.refine_layers(lambda d: (F.col("n") > 25) & (F.col("z") == 0)).layers
    return out.select("level", _grid("x"), _grid("y"), "zlevel", _grid("z"))


# --- without SQL: tests compare these with brute force ---------------------------------------------------------------------------------------
@query()
def moebius_mesh(spark, sf_dir):
    """Neighbour mesh of a balanced forest on a Moebius band, refined around all customers."""
    c = _table(spark, sf_dir, "customer").select((F.col("c_custkey") % 5).alias("tree"), Q.shl(F.col("c_custkey") * 2654435761 % 4096, UP).alias("x"), Q.shl(F.col("c_custkey") * 40503 % 4096, UP).alias("y"))
    f = points_forest(c, T.moebius(), 5, 6)
    b = Forest(f.topology, cut(f.leaves.select(*f.keys))).balance("face")
    return adjacency.mesh(cut(b.numbered()), f.topology)


@query()
def adapt_cycle(spark, sf_dir):
    """Leaves that one cycle of adaptation changes: busy leaves of a uniform tree are refined, empty corners coarsened."""
    a = Adaptive.new(spark, "unit", 4)
    n = cut(search.counts_in_leaves(event_points(spark, sf_dir), a.forest.leaves, 2))
    mean = n.agg(F.avg("n")).first()[0]
    return a.mark_refine(n.where(F.col("n") > mean)).mark_coarsen(n.where(F.col("n") <= mean / 2)).adapt()[1]


@query()
def stream_counts(spark, sf_dir):
    """Events a leaf and hour, by a stream over the events' file joined with the leaves."""
    leaves = cut(event_forest(spark, sf_dir).leaves.drop("n"))
    return counts.run_once(spark, f"{sf_dir}/events.parquet", leaves, placed)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_quadtree(spark, sf_dir)
