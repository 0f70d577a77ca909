"""Queries of the cell functions in 2D and 3D over the points of all events, with SQL that works on a grid of 4,096 cells a side.

Both the queries and their SQL are written for any dimension. Coordinates in results are in units of the grid; a weighted sum over
faces, edges or corners stands for all of them in one number a row.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quadrant as Q
from ..operators.forest import same_size_neighbors
from ..sources import topology as T
from .queries import BITS, ORACLE, QUERIES, UP, _table

NAMES = "xyz"


def register(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLE[name] = run, sql


def points(spark, sf_dir: str, dim: int) -> DataFrame:
    """event_id, tree, x, y[, z]: ids scattered over the grid and squared, so that points crowd towards the origin."""
    e = _table(spark, sf_dir, "events")
    raw = (F.col("event_id") * 2654435761 % 4096, F.col("user_id") * 40503 % 4096, (F.col("event_id") * 40503 + F.col("user_id") * 7) % 4096)
    return e.select("event_id", F.lit(0).cast("long").alias("tree"), *[Q.shl(Q.shr(c * c, BITS), UP).alias(n) for c, n in zip(raw[:dim], NAMES)])


def points_sql(dim: int) -> str:
    """pts(event_id, p0, p1[, p2])."""
    raw = ("(event_id * 2654435761) % 4096", "(user_id * 40503) % 4096", "(event_id * 40503 + user_id * 7) % 4096")[:dim]
    return f"pts AS (SELECT event_id, {', '.join(f'(a{i} * a{i}) >> 12 AS p{i}' for i in range(dim))} FROM (SELECT event_id, {', '.join(f'{c} AS a{i}' for i, c in enumerate(raw))} FROM events))"


def weave(xyz: list[str], bits: int = BITS) -> str:
    """Interleaved bits of SQL expressions."""
    d = len(xyz)
    return "(" + " + ".join(f"((({c} >> {i}) & 1) << {d * i + k})" for k, c in enumerate(xyz) for i in range(bits)) + ")"


def unweave(key: str, axis: int, dim: int, bits: int = BITS + 1) -> str:
    return "(" + " + ".join(f"((({key} >> {dim * i + axis}) & 1) << {i})" for i in range(bits)) + ")"


def cells(spark, sf_dir: str, dim: int) -> tuple[DataFrame, Q.Cell]:
    """Every event's cell of level 2 to 11."""
    p = points(spark, sf_dir, dim)
    q = Q.ancestor(Q.Cell(tuple(F.col(a) for a in NAMES[:dim]), F.lit(Q.MAX)), (F.col("event_id") % 10 + 2).cast("int"))
    frame = p.select("event_id", "tree", *[c.alias(a) for c, a in zip(q.xyz, NAMES)], q.level.alias("level"))
    return frame, Q.cell(dim)


def cells_sql(dim: int) -> str:
    """c(event_id, l, h, x0.. lower corner, k0.. index, r0.. the point's coordinates turned by one axis): h is the cell's side."""
    turned = [(i + 1) % dim for i in range(dim)]
    return f"""{points_sql(dim)}, b AS (SELECT *, CAST(event_id % 10 + 2 AS INTEGER) AS l FROM pts),
 c AS (SELECT event_id, l, 4096 >> l AS h, {', '.join(f'p{i} >> (12 - l) AS k{i}, (p{i} >> (12 - l)) << (12 - l) AS x{i}, (p{j} >> (12 - l)) << (12 - l) AS r{i}' for i, j in enumerate(turned))} FROM b)"""


def grid(columns, names) -> list:
    return [Q.shr(c, UP).alias(n) for c, n in zip(columns, names)]


def total(parts: list) -> list:
    """Weighted sums of places, an axis at a time: the first counts once, the second twice, ..."""
    return [sum((F.lit(k + 1) * p[a] for k, p in enumerate(parts)), F.lit(0).cast("long")) for a in range(len(parts[0]))]


def total_sql(parts: list[list[str]], names: list[str]) -> str:
    return ", ".join(" + ".join(f"{k + 1} * ({p[a]})" for k, p in enumerate(parts)) + f" AS {n}" for a, n in enumerate(names))


def turn(q: Q.Cell) -> Q.Cell:
    return Q.Cell(tuple(q.xyz[(i + 1) % q.dim] for i in range(q.dim)), q.level)


# --- kin: cells above, below and beside in order --------------------------------------------------------------------------------
def kin(spark, sf_dir, dim: int) -> DataFrame:
    """Sibling, child, descendants, successor, predecessor and index of cells, and the level of the common ancestor with the turned cell."""
    frame, q = cells(spark, sf_dir, dim)
    axes, last = NAMES[:dim], (1 << dim) - 1
    frame = frame.withColumn("id", Q.linear_id(q, q.level))
    parts = [("sib", Q.sibling(q, last)), ("kid", Q.child(q, 1)), ("first", Q.first_descendant(q, F.lit(BITS))), ("last", Q.last_descendant(q, F.lit(BITS))), ("corner", Q.corner_descendant(q, last - 1, F.lit(BITS))), ("next", Q.successor(q)), ("before", Q.predecessor(q))]
    out = [c for name, cell in parts for c in grid(cell.xyz, [f"{name}_{a}" for a in axes])]
    return frame.select("event_id", "id", *out, Q.ancestor_id(q, F.lit(2)).cast("long").alias("child_of_one"), Q.nearest_common_ancestor(q, turn(q)).level.cast("int").alias("shared_level"))


def kin_sql(dim: int) -> str:
    axes = range(dim)
    key = weave([f"k{i}" for i in axes])
    low = (1 << dim) - 2
    cols = [f"((k{i} >> 1) * 2 + 1) * h AS sib_{NAMES[i]}" for i in axes]
    cols += [f"x{i}{' + h // 2' if i == 0 else ''} AS kid_{NAMES[i]}" for i in axes] + [f"x{i} AS first_{NAMES[i]}" for i in axes] + [f"x{i} + h - 1 AS last_{NAMES[i]}" for i in axes]
    cols += [f"x{i}{' + h - 1' if low >> i & 1 else ''} AS corner_{NAMES[i]}" for i in axes]
    cols += [f"{unweave('(id + 1)', i, dim)} * h AS next_{NAMES[i]}" for i in axes]
    cols += [f"CASE WHEN id > 0 THEN {unweave('(id - 1)', i, dim)} * h END AS before_{NAMES[i]}" for i in axes]
    same = " AND ".join(f"x{i} >> (12 - k) = x{(i + 1) % dim} >> (12 - k)" for i in axes)
    return f"""WITH {cells_sql(dim)}, i AS (SELECT *, {key} AS id FROM c)
 SELECT event_id, id, {', '.join(cols)}, {' + '.join(f'((x{i} >> 10) & 1) * {1 << i}' for i in axes)} AS child_of_one,
  CAST((SELECT max(k) FROM (SELECT CAST(range AS INTEGER) AS k FROM range(0, 13)) WHERE k <= l AND {same}) AS INTEGER) AS shared_level FROM i"""


# --- relations of two cells --------------------------------------------------------------------------------------------------------
def relations(spark, sf_dir, dim: int) -> DataFrame:
    """How each cell relates to the turned cell and to ancestors of it: order, equality, containment, kinship."""
    frame, q = cells(spark, sf_dir, dim)
    t = turn(q)
    up, above, last = Q.ancestor(t, q.level - 1), Q.ancestor(t, q.level - 2), (1 << dim) - 1
    flags = {
        "same": Q.is_equal(q, t), "siblings": Q.is_sibling(q, t), "child": Q.is_parent(up, q), "below": Q.is_ancestor(above, q), "meets": Q.overlaps(q, above),
        "next": Q.is_next(q, t), "face": Q.is_ancestor_face(above, q, 1), "corner": Q.is_ancestor_corner(above, q, last),
        "ends": Q.is_first_last(q, Q.corner_descendant(up, last, q.level), up), "node": Q.contains_node(above, Q.Cell(tuple(c + Q.length(q.level) for c in q.xyz), F.lit(Q.MAX))),
    }
    numbers = {"order": Q.compare(q, t), "apart": Q.disjoint(q, above), "grown_first": Q.enlarge_first(q, F.lit(1)).level, "grown_last": Q.enlarge_last(q, F.lit(1)).level}
    return frame.select("event_id", *[c.alias(n) for n, c in flags.items()], *[c.cast("int").alias(n) for n, c in numbers.items()])


def relations_sql(dim: int) -> str:
    axes = range(dim)
    every = lambda f: "(" + " AND ".join(f(i) for i in axes) + ")"
    mine, other = weave([f"x{i}" for i in axes]), weave([f"r{i}" for i in axes])
    above = weave([f"a{i}" for i in axes])
    grown = "(SELECT min(k) FROM (SELECT CAST(range AS INTEGER) AS k FROM range(1, 13)) WHERE {})"
    return f"""WITH {cells_sql(dim)}, a AS (SELECT *, {', '.join(f'(r{i} // (4 * h)) * 4 * h AS a{i}, (r{i} // (2 * h)) * 2 * h AS u{i}' for i in axes)} FROM c),
 k AS (SELECT *, {mine} AS mk, {other} AS rk, {above} AS ak, {every(lambda i: f'x{i} // (4 * h) = a{i} // (4 * h)')} AS inside FROM a)
 SELECT event_id, mk = rk AS same, mk <> rk AND {every(lambda i: f'x{i} // (2 * h) = r{i} // (2 * h)')} AS siblings, {every(lambda i: f'x{i} // (2 * h) * 2 * h = u{i}')} AS child, inside AS below, inside AS meets,
  rk = mk + CAST(pow(h, {dim}) AS BIGINT) AS next, inside AND x0 + h = a0 + 4 * h AS face, {every(lambda i: f'x{i} + h = a{i} + 4 * h')} AS corner, {every(lambda i: f'x{i} = u{i}')} AS ends,
  {every(lambda i: f'(CASE WHEN x{i} + h = 4096 THEN 4095 ELSE x{i} + h END) // (4 * h) = a{i} // (4 * h)')} AS node,
  CAST(sign(mk - rk) AS INTEGER) AS order, CASE WHEN inside THEN 0 ELSE CAST(sign(mk - ak) AS INTEGER) END AS apart,
  CAST(least(l, {grown.format(' AND '.join(f'x{i} % (4096 >> k) = 0' for i in axes))}) AS INTEGER) AS grown_first, CAST(least(l, {grown.format(' AND '.join(f'(x{i} + h) % (4096 >> k) = 0' for i in axes))}) AS INTEGER) AS grown_last FROM k""".replace(" AS order,", ' AS "order",')


# --- inside and outside the root ------------------------------------------------------------------------------------------------------
def outside(spark, sf_dir, dim: int) -> DataFrame:
    """Cells moved by up to a root's length along each axis: where they are, and whether nodes and coordinates there are valid."""
    frame, q = cells(spark, sf_dir, dim)
    by = [F.col("event_id") % 3 - 1, F.floor(F.col("event_id") / 3) % 3 - 1, F.floor(F.col("event_id") / 9) % 3 - 1]
    m = Q.Cell(tuple(c + b * Q.ROOT for c, b in zip(q.xyz, by)), q.level)
    far = tuple(c + Q.length(q.level) for c in m.xyz)
    node = Q.Cell(far, F.lit(Q.MAX))
    flags = {
        "inside": Q.is_inside_root(m), "around": Q.is_inside_3x3(m), "face": Q.is_outside_face(m), "corner": Q.is_outside_corner(m), "extended": Q.is_extended(m), "valid": Q.is_valid(m),
        "point": Q.point_inside_root(far), "point_valid": Q.point_is_valid(far, q.level), "node": Q.is_node(node), "clamped": Q.is_node(Q.clamp(node), inside=True), "touches": Q.touches_corner(m, 0), "touches_out": Q.touches_corner(m, 0, inside=False),
    }
    if dim == 3:
        flags |= {"edge": Q.is_outside_edge(m), "touches_edge": Q.touches_edge(m, 0), "touches_edge_out": Q.touches_edge(m, 3, inside=False)}
    numbers = {"edge_number": Q.outside_edge(m)} if dim == 3 else {}
    back = Q.unclamp(Q.clamp(node))
    return frame.select("event_id", *[c.alias(n) for n, c in flags.items()], *[c.cast("int").alias(n) for n, c in numbers.items()], *grid(back.xyz, [f"back_{a}" for a in NAMES[:dim]]))


def outside_sql(dim: int) -> str:
    axes = range(dim)
    out = [f"(CASE WHEN m{i} < 0 OR m{i} >= 4096 THEN 1 ELSE 0 END)" for i in axes]
    count = " + ".join(out)
    every = lambda f: "(" + " AND ".join(f(i) for i in axes) + ")"
    inside = every(lambda i: f"m{i} >= 0 AND m{i} < 4096")
    around = every(lambda i: f"m{i} >= -4096 AND m{i} < 8192")
    point = every(lambda i: f"m{i} + h BETWEEN 0 AND 4096")
    cols = [f"{inside} AS inside", f"{around} AS around", f"{count} = 1 AS face", f"{count} = {dim} AS corner", f"{around} AS extended", f"{inside} AS valid", f"{point} AS point", f"{point} AS point_valid", f"{point} AS node", f"{point} AS clamped"]
    cols += [f"{every(lambda i: f'm{i} = 0')} AS touches", f"{every(lambda i: f'm{i} = -h')} AS touches_out"]
    if dim == 3:
        side = "CASE WHEN {0} < 0 THEN 0 ELSE 1 END"
        number = " ".join(f"WHEN m{a} BETWEEN 0 AND 4095 THEN {4 * a} + ({side.format(f'm{b}')}) + 2 * ({side.format(f'm{c}')})" for a, b, c in ((0, 1, 2), (1, 0, 2), (2, 0, 1)))
        cols += [f"{count} = 2 AS edge", "m1 = 0 AND m2 = 0 AS touches_edge", "m1 = 4096 AND m2 = 4096 AS touches_edge_out", f"CAST(CASE WHEN {count} = 2 THEN CASE {number} END END AS INTEGER) AS edge_number"]
    cols += [f"m{i} + h AS back_{NAMES[i]}" for i in axes]
    shift = ("event_id % 3 - 1", "(event_id // 3) % 3 - 1", "(event_id // 9) % 3 - 1")
    return f"WITH {cells_sql(dim)}, m AS (SELECT *, {', '.join(f'x{i} + ({shift[i]}) * 4096 AS m{i}' for i in axes)} FROM c) SELECT event_id, {', '.join(cols)} FROM m"


# --- neighbours and places --------------------------------------------------------------------------------------------------------------
def around(spark, sf_dir, dim: int) -> DataFrame:
    """Neighbours across faces, edges and corners, half-size ones, and the places of faces, edges, corners and centre."""
    frame, q = cells(spark, sf_dir, dim)
    faces, n = range(2 * dim), 1 << dim
    parts = {
        "face": [Q.face_neighbor(q, f).xyz for f in faces], "half": [h.xyz for f in faces for h in Q.half_face_neighbors(q, f)], "face_at": [Q.face_point(q, f) for f in faces],
        "corner": [Q.corner_neighbor(q, c).xyz for c in range(n)], "half_corner": [Q.half_corner_neighbor(q, c).xyz for c in range(n)], "corner_at": [Q.corner_node(q, c).xyz for c in range(n)], "centre": [Q.volume_point(q)],
    }
    if dim == 3:
        parts |= {"edge": [Q.edge_neighbor(q, e).xyz for e in range(12)], "edge_at": [Q.edge_point(q, e) for e in range(12)]}
    out = [Q.shr(c, UP).alias(f"{name}_{a}") for name, places in parts.items() for c, a in zip(total(places), NAMES)]
    return frame.select("event_id", *out, F.size(Q.all_face_neighbors(q, 0)).alias("candidates"))


def around_sql(dim: int) -> str:
    axes = range(dim)
    faces = [divmod(f, 2) for f in range(2 * dim)]
    move = lambda by: [f"x{i} + {by[i]}" if i in by else f"x{i}" for i in axes]
    face = [move({a: "h" if s else "(-h)"}) for a, s in faces]
    half = []
    for a, s in faces:
        for c in range(1 << dim):
            if (c >> a & 1) == 1 - s:
                half.append([f"x{i} + {('h' if s else '(-h // 2)') if i == a else ('h // 2' if c >> i & 1 else '0')}" for i in axes])
    face_at = [[f"x{i} + {('h' if s else '0') if i == a else 'h // 2'}" for i in axes] for a, s in faces]
    corners = range(1 << dim)
    corner = [[f"x{i} + {'h' if c >> i & 1 else '(-h)'}" for i in axes] for c in corners]
    half_corner = [[f"x{i} + {'h' if c >> i & 1 else '(-h // 2)'}" for i in axes] for c in corners]
    corner_at = [[f"x{i} + {'h' if c >> i & 1 else '0'}" for i in axes] for c in corners]
    parts = {"face": face, "half": half, "face_at": face_at, "corner": corner, "half_corner": half_corner, "corner_at": corner_at, "centre": [[f"x{i} + h // 2" for i in axes]]}
    if dim == 3:
        sides = [(e // 4, dict(zip([i for i in range(3) if i != e // 4], (e & 1, e >> 1 & 1)))) for e in range(12)]
        parts["edge"] = [[f"x{i}" if i == a else f"x{i} + {'h' if s[i] else '(-h)'}" for i in axes] for a, s in sides]
        parts["edge_at"] = [[f"x{i} + {'h // 2' if i == a else 'h' if s[i] else '0'}" for i in axes] for a, s in sides]
    cols = ", ".join(total_sql(p, [f"{name}_{NAMES[i]}" for i in axes]) for name, p in parts.items())
    return f"WITH {cells_sql(dim)} SELECT event_id, {cols}, CAST({(1 << dim - 1) + 2} AS INTEGER) AS candidates FROM c"


# --- transforms between trees -------------------------------------------------------------------------------------------------------------
def periodic(spark, sf_dir, dim: int) -> DataFrame:
    """All neighbours (across faces, edges and corners) of cells of level 3 in a tree that meets itself on every side."""
    p = points(spark, sf_dir, dim)
    q = Q.ancestor(Q.Cell(tuple(F.col(a) for a in NAMES[:dim]), F.lit(Q.MAX)), F.lit(3))
    found = p.select("tree", *Q.columns(q)).distinct()
    key = Q.linear_id(Q.cell(dim), 3)
    near = same_size_neighbors(found.withColumn("id", key), T.periodic(dim), "corner", carry=("id",))
    return near.select("id", "way", Q.linear_id(Q.cell(dim), 3).alias("neighbor"))


def periodic_sql(dim: int) -> str:
    axes = range(dim)
    ways = ", ".join(f"w{i} AS (SELECT CAST(range AS INTEGER) AS d{i} FROM range(0, 3))" for i in axes)
    moved = [f"((k{i} + d{i} + 7) % 8)" for i in axes]
    middle = sum(3**i for i in axes)
    return f"""WITH {points_sql(dim)}, {ways}, k AS (SELECT DISTINCT {', '.join(f'p{i} >> 9 AS k{i}' for i in axes)} FROM pts)
 SELECT {weave([f'k{i}' for i in axes], 3)} AS id, {' + '.join(f'd{i} * {3**i}' for i in axes)} AS way, {weave(moved, 3)} AS neighbor FROM k, {', '.join(f'w{i}' for i in axes)} WHERE {' + '.join(f'd{i} * {3**i}' for i in axes)} <> {middle}"""


def wide_keys(spark, sf_dir) -> DataFrame:
    """128-bit index of cells at the finest level of a 3D tree, and the cell that it gives back."""
    frame, q = cells(spark, sf_dir, 3)
    keyed = frame.select("event_id", Q.linear_id128(q, F.lit(Q.QMAX)).alias("id"))
    back = Q.from_linear_id128(F.col("id"), F.lit(Q.QMAX))
    return keyed.select("event_id", F.col("id")["hi"].alias("hi"), F.col("id")["lo"].alias("lo"), *grid(back.xyz, ["back_x", "back_y", "back_z"]))


def wide_keys_sql() -> str:
    low = Q.QMAX - BITS  # levels below the grid
    bit = lambda k: f"((CAST(x{k % 3} AS HUGEINT) >> {k // 3 - low}) & 1)"
    at = [k for k in range(3 * low, 3 * Q.QMAX)]
    word = lambda ks, base: " + ".join(f"({bit(k)} << {k - base})" for k in ks) or "0"
    lo = word([k for k in at if k < 64], 0)
    return f"WITH {cells_sql(3)}, w AS (SELECT event_id, x0, x1, x2, {word([k for k in at if k >= 64], 64)} AS hi, {lo} AS lo FROM c) SELECT event_id, CAST(hi AS BIGINT) AS hi, CAST(CASE WHEN lo >= 9223372036854775808 THEN lo - 18446744073709551616 ELSE lo END AS BIGINT) AS lo, x0 AS back_x, x1 AS back_y, x2 AS back_z FROM w"


for _dim, _suffix in ((2, ""), (3, "_3d")):
    for _name, _run, _sql in (("cell_kin", kin, kin_sql), ("cell_relations", relations, relations_sql), ("cell_outside", outside, outside_sql), ("cell_surroundings", around, around_sql), ("periodic_neighbors", periodic, periodic_sql)):
        register(_name + _suffix, partial(_run, dim=_dim), _sql(_dim))
register("wide_keys_3d", wide_keys, wide_keys_sql())
