"""Maps from a tree's reference coordinates in [0, 1]**dim to space, as Columns: multilinear, shells, disks, spheres, torus, pillows.

A map is a function (tree, abc) -> (x, y, z) of Columns. Curved maps first go through the topology's vertices where their domain
is given by them. Everything is a projection; vertices come in by a broadcast join of 2**dim rows a tree, in one row each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.topology import Topology
from . import quadrant as Q

Map = Callable[[Column, list[Column]], tuple[Column, Column, Column]]
QUARTER = math.pi / 4


def _pick(key: Column, cases: list) -> Column:
    """cases[k] where key is k."""
    out = cases[-1]
    for k in range(len(cases) - 2, -1, -1):
        out = F.when(key == k, cases[k]).otherwise(out)
    return out


def _turned(key: Column, patches: tuple[str, ...], parts: dict[str, Column]) -> tuple[Column, Column, Column]:
    """For each patch a word like `+q -x 0`: a sign and the name of a part for each coordinate."""
    value = lambda w: F.lit(0.0) if w == "0" else parts[w[1:]] if w[0] == "+" else -parts[w[1:]]
    return tuple(_pick(key, [value(p.split()[i]) for p in patches]) for i in range(3))


def multilinear(corner: Callable[[int, int], Column], abc: list[Column]) -> tuple[Column, Column, Column]:
    """Weighted sum of 2**dim corners; corner(c, axis) is a coordinate of corner c."""
    out = []
    for axis in range(3):
        total = F.lit(0.0)
        for c in range(1 << len(abc)):
            w = F.lit(1.0)
            for i, r in enumerate(abc):
                w = w * (r if c >> i & 1 else 1 - r)
            total = total + w * corner(c, axis)
        out.append(total)
    return tuple(out)


def _with_vertices(df: DataFrame, topology: Topology, vertices: DataFrame | None = None) -> DataFrame:
    """df with __v, the vertices of the row's tree by corner."""
    frame = topology.vertex_frame(df.sparkSession) if vertices is None else vertices
    wide = frame.groupBy("tree").agg(F.transform(F.sort_array(F.collect_list(F.struct("corner", "vx", "vy", "vz"))), lambda s: F.struct(s["vx"].alias("vx"), s["vy"].alias("vy"), s["vz"].alias("vz"))).alias("__v"))
    return df.join(F.broadcast(wide) if topology.n <= 100_000 else wide, "tree")


def reference(df_axes: tuple[str, ...]) -> list[Column]:
    """Reference coordinates of integer coordinates."""
    return [F.col(a) / F.lit(float(Q.ROOT)) for a in df_axes]


def vertex_map(df: DataFrame, topology: Topology, axes: tuple[str, ...] = ("x", "y"), out: tuple[str, str, str] = ("px", "py", "pz"), vertices: DataFrame | None = None) -> DataFrame:
    """df (tree, integer coordinates) with the multilinear position in `out`."""
    return place(df, topology, lambda tree, abc: tuple(abc), axes, out, vertices)


def place(df: DataFrame, topology: Topology, how: Map, axes: tuple[str, ...] = ("x", "y"), out: tuple[str, str, str] = ("px", "py", "pz"), vertices: DataFrame | None = None) -> DataFrame:
    """df with the position of `how` applied to the multilinear position of the topology's vertices."""
    abc = multilinear(lambda c, i: F.col("__v")[c]["v" + "xyz"[i]], reference(axes))
    # the multilinear position is bound once, so that curved maps stay small expressions
    joined = _with_vertices(df, topology, vertices).withColumn("__abc", F.struct(*[v.alias(n) for v, n in zip(abc, "xyz")]))
    xyz = how(F.col("tree"), [F.col("__abc")[n] for n in "xyz"])
    return joined.withColumns(dict(zip(out, xyz))).drop("__v", "__abc")


def place_reference(df: DataFrame, how: Map, axes: tuple[str, ...] = ("x", "y"), out: tuple[str, str, str] = ("px", "py", "pz")) -> DataFrame:
    """df with the position of a map that takes reference coordinates as they are."""
    return df.withColumns(dict(zip(out, how(F.col("tree"), reference(axes)))))


def _graded(outer: float, inner: float, t: Column) -> Column:
    """Radius that grows geometrically from inner at t = 1 to outer at t = 2."""
    return F.lit(inner * inner / outer) * F.pow(F.lit(outer / inner), t)


def shell2d(outer: float, inner: float) -> Map:
    """Annulus of eight trees, two a quarter."""

    def how(tree, abc):
        x = F.tan(abc[0] * QUARTER)
        q = _graded(outer, inner, abc[1]) / F.sqrt(x * x + 1)
        return _turned(F.floor(tree / 2), ("+q +s 0", "-s +q 0", "-q -s 0", "+s -q 0"), {"q": q, "s": q * x})

    return how


def _blend(a: Column, p: Column, sign: int = 1) -> tuple[Column, Column]:
    """Between a flat and an angular grading: the graded coordinate, and its tangent."""
    tan = F.tan(a * QUARTER) * sign
    return p * a * sign + (1 - p) * tan, tan


def disk2d(core: float, outer: float) -> Map:
    """Disk of a square with half diagonal `core` and four trees around it."""

    def how(tree, abc):
        p = 2 - abc[1]
        x, tan = _blend(abc[0], p, -1)
        q = _graded(outer, core, abc[1]) / F.sqrt(1 + (1 - p) * tan * tan + p)
        ring = _turned(tree, ("+q +s 0", "+s -q 0", "-q -s 0", "-s +q 0"), {"q": q, "s": q * x})
        side = core / math.sqrt(2)
        return tuple(F.when(tree < 4, r).otherwise(c * side if i < 2 else F.lit(0.0)) for i, (r, c) in enumerate(zip(ring, abc)))

    return how


def sphere2d(radius: float) -> Map:
    """Surface of a cube blown up to a sphere."""

    def how(tree, abc):
        c = [a - 0.5 for a in abc]
        scale = radius / F.sqrt(sum((v * v for v in c), F.lit(0.0)))
        return tuple(v * scale for v in c)

    return how


def shell(outer: float, inner: float) -> Map:
    """Spherical shell of 24 trees, four a side."""

    def how(tree, abc):
        x, y = F.tan(abc[0] * QUARTER), F.tan(abc[1] * QUARTER)
        q = _graded(outer, inner, abc[2]) / F.sqrt(x * x + y * y + 1)
        return _turned(F.floor(tree / 4), ("+q -s -t", "-t -s -q", "-q -s +t", "+t -s +q", "-s +q +t", "+s -q +t"), {"q": q, "s": q * x, "t": q * y})

    return how


def sphere(outer: float, middle: float, core: float) -> Map:
    """Ball of six outer trees, six inner ones and a cube, with a correction of the grading in the middle of the outer shell."""

    def how(tree, abc):
        z = abc[2] - 1.625
        wide = 0.125
        bump = F.when(F.abs(z) < wide, 0.008873 * F.exp(1 / (wide * wide) - 1 / ((z + wide) * (wide - z)))).otherwise(0.0)
        x, y = F.tan(abc[0] * QUARTER), F.tan(abc[1] * QUARTER)
        q_out = _graded(outer, middle, abc[2] + bump) / F.sqrt(x * x + y * y + 1)
        p = 2 - abc[2]
        xi, _ = _blend(abc[0], p)
        yi, _ = _blend(abc[1], p)
        q_in = _graded(middle, core, abc[2]) / F.sqrt(1 + (1 - p) * (x * x + y * y) + 2 * p)
        far = tree < 6
        q = F.when(far, q_out).otherwise(q_in)
        s, t = q * F.when(far, x).otherwise(xi), q * F.when(far, y).otherwise(yi)
        patch = _turned(tree % 6, ("+s -q +t", "+s +t +q", "+s +q -t", "+q -s -t", "-t -s -q", "-q -s +t"), {"q": q, "s": s, "t": t})
        side = core / math.sqrt(3)
        return tuple(F.when(tree < 12, v).otherwise(a * side) for v, a in zip(patch, abc))

    return how


def torus(core: float, tube: float, ring: float, segments: int) -> Map:
    """Disk of radius `tube`, turned about the y axis at distance `ring`."""
    flat = disk2d(core, tube)

    def how(tree, abc):
        x, y, _ = flat(tree % 5, abc)
        phi = (F.floor(tree / 5) + abc[2]) * (2 * math.pi / segments)
        return (x + ring) * F.cos(phi), y, (x + ring) * F.sin(phi)

    return how


def _arc(a: Column, b: Column, near: Column, radius: Column) -> tuple[Column, Column]:
    """Point on the arc through the square of half side near: |a|, |b| are the square's coordinates, the larger one bends outwards."""
    d = F.greatest(F.abs(a), F.abs(b))
    centre = near - F.sqrt(radius * radius - near * near)
    scale = F.when(d > 0, near / d).otherwise(0.0)
    u, v = scale * F.abs(a), scale * F.abs(b)
    v2 = F.when(F.abs(b) >= F.abs(a), centre + F.sqrt(F.greatest(radius * radius - u * u, F.lit(0.0)))).otherwise(v)
    u2 = F.when(F.abs(a) >= F.abs(b), centre + F.sqrt(F.greatest(radius * radius - v2 * v2, F.lit(0.0)))).otherwise(u)
    return F.signum(a) * u2, F.signum(b) * v2


def pillow(radius: float) -> Map:
    """Two trees bent to the lower and upper half of a sphere."""

    def how(tree, abc):
        a, b = 2 * abc[0] - 1, 2 * abc[1] - 1
        d = F.greatest(F.abs(a), F.abs(b))
        r = F.sin(d * (math.pi / 2)) * radius
        x, y = _arc(a, b, r / math.sqrt(2), r)
        return x, y, (2 * tree - 1) * F.sqrt(F.greatest(F.lit(radius * radius) - x * x - y * y, F.lit(0.0)))

    return how


def pillow_disk(radius: float, kind: str = "A") -> Map:
    """One tree bent to a disk: squares become arcs of growing (A) or fixed (B, C) radius, or are blended with circles (D)."""

    def how(tree, abc):
        a, b = 2 * abc[0] - 1, 2 * abc[1] - 1
        d = F.greatest(F.abs(a), F.abs(b))
        if kind == "D":
            r = F.greatest(F.sqrt(a * a + b * b), F.lit(1e-10))
            return tuple(d * d * (radius * d * v / r) + (1 - d * d) * v / math.sqrt(2) for v in (a, b)) + (F.lit(0.0),)
        near = radius * (d * (2 - d) if kind == "C" else d) / math.sqrt(2)
        return *_arc(a, b, near, radius * d if kind == "A" else F.lit(float(radius))), F.lit(0.0)

    return how


def pillow_shell(outer: float, inner: float) -> Map:
    """Two trees bent to the halves of a spherical shell: tree 0 above, tree 1 below."""

    def how(tree, abc):
        a, b = 2 * abc[0] - 1, 2 * abc[1] - 1
        d = F.greatest(F.abs(a), F.abs(b), F.lit(1e-10))
        x, y = _arc(a, b, d * (2 - d) / math.sqrt(2), F.lit(1.0))
        z = F.sqrt(F.greatest(1 - x * x - y * y, F.lit(0.0)))
        r = inner + abc[2] * (outer - inner)
        return r * x, r * y, r * F.when(tree == 1, -z).otherwise(z)

    return how


def pillow_sphere(radius: float, blended: bool = False) -> Map:
    """One tree bent to a ball: cubes become spheres, on demand blended with cubes towards the middle."""

    def how(tree, abc):
        c = [2 * a - 1 for a in abc]
        d = F.greatest(*[F.abs(v) for v in c])
        r = F.greatest(F.sqrt(sum((v * v for v in c), F.lit(0.0))), F.lit(1e-10))
        w = d * d if blended else F.lit(1.0)
        return tuple(w * (radius * d * v / r) + (1 - w) * v / math.sqrt(3) for v in c)

    return how


def icosahedron(radius: float) -> Map:
    """Ten trees over a sphere, by spherical interpolation along one axis, then the other, between an icosahedron's nodes."""
    g = 2 / (1 + math.sqrt(5))
    size = math.sqrt(1 + g * g)
    # nodes: a pole 0 with its five neighbours 1..5, their opposites, the pole 11; cyclic images of (0, +-g, +-1)
    nodes = [(0, -g, 1), (g, -1, 0), (1, 0, g), (0, g, 1), (-1, 0, g), (-g, -1, 0), (1, 0, -g), (g, 1, 0), (-g, 1, 0), (-1, 0, -g), (0, -g, -1), (0, g, -1)]
    trees = []
    for i in range(5):
        j = (i + 1) % 5
        trees += [(1 + i, 6 + i, 0, 1 + j), (6 + i, 11, 1 + j, 6 + j)]
    angle = math.acos(sum(a * b for a, b in zip(nodes[0], nodes[1])) / size**2)  # all edges are alike

    def slerp(u, v, t, theta):
        return [(F.sin((1 - t) * theta) * a + F.sin(t * theta) * b) / F.sin(theta) for a, b in zip(u, v)]

    def how(tree, abc):
        corner = [[_pick(tree, [F.lit(float(nodes[t[k]][i])) for t in trees]) for i in range(3)] for k in range(4)]
        low, high = slerp(corner[0], corner[1], abc[0], F.lit(angle)), slerp(corner[2], corner[3], abc[0], F.lit(angle))
        between = F.acos(sum((a * b for a, b in zip(low, high)), F.lit(0.0)) / size**2)
        return tuple(v * (radius / size) for v in slerp(low, high, abc[1], between))

    return how
