"""Scalar functions of quadrants (2D) and octants (3D) as Column expressions that stay inside whole-stage codegen.

A cell is a `Cell(xyz, level)` of Columns: integer coordinates of its lower corner on a root of side ROOT = 2**30, and a
level from 0 (root) to QMAX = 29; a point (node) has level MAX = 30. The Morton order interleaves the coordinates' bits,
z before y before x, ancestors before descendants. Coordinates are BIGINT, so neighbours outside the root do not overflow.
A null coordinate or level makes every result null.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX, QMAX = 30, 29
ROOT = 1 << MAX
#: Corner pairs of the 12 octant edges follow from (axis = e // 4, low bits = side of the other two axes in order).
FACES = {2: 4, 3: 6}
CORNERS = {2: 4, 3: 8}
EDGES = {2: 0, 3: 12}


class Cell(NamedTuple):
    xyz: tuple
    level: Column

    @property
    def dim(self) -> int:
        return len(self.xyz)


def axes(dim: int) -> tuple[str, ...]:
    return ("x", "y", "z")[:dim]


def cell(dim: int = 2, prefix: str = "", alias: str | None = None) -> Cell:
    """The cell in columns x, y[, z], level, with a prefix or of an aliased DataFrame."""
    at = (lambda n: F.col(f"{alias}.{prefix}{n}")) if alias else (lambda n: F.col(prefix + n))
    return Cell(tuple(at(a).cast("long") for a in axes(dim)), at("level").cast("int"))


def columns(q: Cell, prefix: str = "") -> list[Column]:
    return [c.alias(prefix + a) for c, a in zip(q.xyz, axes(q.dim))] + [q.level.cast("int").alias(prefix + "level")]


def packed(q: Cell) -> Column:
    """The cell as a struct, for arrays of cells."""
    return F.struct(*columns(q))


def unpacked(struct: Column, dim: int) -> Cell:
    return Cell(tuple(struct[a] for a in axes(dim)), struct["level"])


def _int(v) -> Column:
    return v.cast("int") if isinstance(v, Column) else F.lit(int(v))


def _long(v) -> Column:
    return v.cast("long") if isinstance(v, Column) else F.lit(int(v)).cast("long")


def shl(a, n) -> Column:
    return F.call_function("shiftleft", _long(a), _int(n))


def shr(a, n) -> Column:
    return F.call_function("shiftright", _long(a), _int(n))


def ushr(a, n) -> Column:
    return F.call_function("shiftrightunsigned", _long(a), _int(n))


def length(level) -> Column:
    """Side of a cell of this level."""
    return shl(1, F.lit(MAX) - _int(level))


def _mask(c: Column, level) -> Column:
    """Lower corner of the level's cell around coordinate c; right for negative coordinates too."""
    n = F.lit(MAX) - _int(level)
    return shl(shr(c, n), n)


# --- Morton keys ---------------------------------------------------------------------------------------------------
#: Bits of a coordinate, and of a key, that one look-up takes.
_PIECE = 8
_KEY_PIECE = {2: 8, 3: 9}


@functools.cache
def _table(values: tuple[int, ...]) -> str:
    return f"array({', '.join(f'{v}L' for v in values)})"


def _looked_up(values: tuple[int, ...], at: Column) -> Column:
    """values[at]; the array is a constant of the plan."""
    return F.get(F.expr(_table(values)), at.cast("int"))


@functools.cache
def _spreads(dim: int) -> tuple[int, ...]:
    return tuple(sum((v >> i & 1) << dim * i for i in range(_PIECE)) for v in range(1 << _PIECE))


@functools.cache
def _squeezes(dim: int) -> tuple[int, ...]:
    n = _KEY_PIECE[dim]
    return tuple(sum((v >> dim * i & 1) << i for i in range(n // dim)) for v in range(1 << n))


def _spread(c: Column, dim: int) -> Column:
    """The low 32 (2D) or 21 (3D) bits of a coordinate, dim places apart. A column names c four (three) times: the usual doubling steps name it 32 times."""
    out = None
    for at in range(0, 32 if dim == 2 else 21, _PIECE):
        mask = (1 << (_PIECE if dim == 2 else min(_PIECE, 21 - at))) - 1
        part = shl(_looked_up(_spreads(dim), shr(c, at).bitwiseAND(F.lit(mask))), dim * at)
        out = part if out is None else out.bitwiseOR(part)
    return out


def _squeeze(c: Column, dim: int) -> Column:
    """The inverse: every dim-th bit of a key, from the lowest."""
    n, out = _KEY_PIECE[dim], None
    for at in range(0, 64 if dim == 2 else 63, n):
        part = shl(_looked_up(_squeezes(dim), shr(c, at).bitwiseAND(F.lit((1 << n) - 1))), at // dim)
        out = part if out is None else out.bitwiseOR(part)
    return out


def interleave(xyz, dim: int) -> Column:
    """Interleaved bits of coordinates below 2**31 (2D) or 2**21 (3D)."""
    out = _spread(xyz[0], dim)
    for i in range(1, dim):
        out = out.bitwiseOR(shl(_spread(xyz[i], dim), i))
    return out


def morton(q: Cell) -> Column:
    """Sort key of a cell's lower corner: BIGINT in 2D, struct<hi, lo> of 15 levels each in 3D.

    Coordinates outside the root wrap, as two's complement does, behind all inside ones.
    """
    if q.dim == 2:
        return interleave([c.bitwiseAND(F.lit((1 << 31) - 1)) for c in q.xyz], 2)
    hi = interleave([shr(c, 15).bitwiseAND(F.lit(0xFFFF)) for c in q.xyz], 3)
    lo = interleave([c.bitwiseAND(F.lit(0x7FFF)) for c in q.xyz], 3)
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def linear_id(q: Cell, level) -> Column:
    """Index of the cell at a level's uniform grid in Morton order: 2 * level (3 * level) bits, level <= 21 in 3D.

    Cells outside the root give the two's complement wrap of 2 (1) further bits.
    """
    n = F.lit(MAX) - _int(level)
    bits = F.when(_int(level) >= 0, shl(1, _int(level) + (2 if q.dim == 2 else 0)) - 1)
    return interleave([shr(c, n).bitwiseAND(bits).bitwiseAND(F.lit(0x7FFFFFFF if q.dim == 2 else 0x1FFFFF)) for c in q.xyz], q.dim)


def linear_id128(q: Cell, level) -> Column:
    """Index at any level as struct<hi, lo> of 64 bits each (lo as a signed BIGINT)."""
    n = F.lit(MAX) - _int(level)
    if q.dim == 2:
        return F.struct(F.lit(0).cast("long").alias("hi"), linear_id(q, level).alias("lo"))
    c = [shr(v, n) for v in q.xyz]
    low = interleave([v.bitwiseAND(F.lit(0x1FFFFF)) for v in c], 3)  # 63 bits
    high = interleave([shr(v, 21).bitwiseAND(F.lit(0x1FFFFF)) for v in c], 3)
    return F.struct(shr(high, 1).alias("hi"), low.bitwiseOR(shl(high, 63)).alias("lo"))


def from_linear_id(id_, level, dim: int = 2) -> Cell:
    """The level's cell with this index."""
    n = F.lit(MAX) - _int(level)
    return Cell(tuple(shl(_squeeze(ushr(id_, i), dim), n) for i in range(dim)), _int(level))


def from_linear_id128(id_: Column, level) -> Cell:
    n = F.lit(MAX) - _int(level)
    high = shl(id_["hi"], 1).bitwiseOR(ushr(id_["lo"], 63))
    return Cell(tuple(shl(_squeeze(ushr(id_["lo"].bitwiseAND(F.lit((1 << 63) - 1)), i), 3).bitwiseOR(shl(_squeeze(ushr(high, i), 3), 21)), n) for i in range(3)), _int(level))


def _stepped(q: Cell, on: bool) -> Cell:
    """The next (on) or previous cell of the same level, from coordinates alone.

    One more flips the lowest bits of the index up to its first 0, one less up to its first 1. That bit is at place k of some axis: axes up
    to this one flip their bits 0 to k, those behind it 0 to k - 1.
    """
    n = F.lit(MAX) - _int(q.level)
    v = [shr(c, n) for c in q.xyz]
    full = [v[0] if on else F.bitwise_not(v[0])]  # ones at the places that flip in all axes up to each
    for c in v[1:]:
        full.append(full[-1].bitwiseAND(c if on else F.bitwise_not(c)))
    flip = F.when(full[-1] != -1, full[-1].bitwiseXOR(full[-1] + 1))
    out = [v[0].bitwiseXOR(flip)]
    for c, ones in zip(v[1:], full):
        out.append(c.bitwiseXOR(F.when(ones.bitwiseAND(flip) == flip, flip).otherwise(shr(flip, 1))))
    return Cell(tuple(shl(c, n) for c in out), _int(q.level))


def successor(q: Cell, index: Column | None = None) -> Cell:
    """Next cell of the same level in Morton order, behind the last one the root's neighbour along x. index: the next cell's, to be decoded instead."""
    return _stepped(q, True) if index is None else from_linear_id(index, q.level, q.dim)


def predecessor(q: Cell, index: Column | None = None) -> Cell:
    """Previous cell of the same level in Morton order; null before the first. index: the previous cell's, to be decoded instead."""
    return _stepped(q, False) if index is None else from_linear_id(index, q.level, q.dim)


def seed(q: Cell, tree=None) -> Column:
    """A deterministic 64-bit seed of a cell."""
    return F.xxhash64(*([tree] if tree is not None else []), *q.xyz, q.level)


# --- order and containment -------------------------------------------------------------------------------------------
def compare(a: Cell, b: Cell) -> Column:
    """-1, 0 or 1: Morton order, then level. The axis with the highest bit that differs decides, the last of those that share it; no key is made.

    Coordinates outside the root wrap as in morton().
    """
    sides = [(x.bitwiseAND(F.lit((1 << 31) - 1)), y.bitwiseAND(F.lit((1 << 31) - 1))) for x, y in zip(a.xyz, b.xyz)]
    seen, out = None, None
    for x, y in sides:
        differs, order = x.bitwiseXOR(y), F.when(x < y, -1).otherwise(1)
        seen = differs if seen is None else seen.bitwiseOR(differs)
        out = order if out is None else F.when(seen.bitwiseXOR(differs) <= differs, order).otherwise(out)
    return F.when(seen == 0, F.signum(a.level - b.level).cast("int")).when(seen.isNotNull(), out)


def disjoint(a: Cell, b: Cell) -> Column:
    """compare(), but 0 where the cells overlap."""
    return F.when(overlaps(a, b), 0).otherwise(compare(a, b))


def _differs(a: Cell, b: Cell) -> Column:
    """Bits in which coordinates differ: one value to compare takes fewer bytes of generated code than a chain of conditions."""
    return functools.reduce(Column.bitwiseOR, [x.bitwiseXOR(y) for x, y in zip(a.xyz, b.xyz)])


def is_equal(a: Cell, b: Cell) -> Column:
    return _differs(a, b).bitwiseOR(_long(a.level).bitwiseXOR(_long(b.level))) == 0


def ancestor(q: Cell, level) -> Cell:
    return Cell(tuple(_mask(c, level) for c in q.xyz), _int(level))


def parent(q: Cell) -> Cell:
    """Parent; null for a root."""
    up = F.when(q.level > 0, q.level - 1)
    return ancestor(q, up)


def ancestor_id(q: Cell, level) -> Column:
    """Child number of the level's ancestor (or of the cell itself); 0 at level 0."""
    n = F.lit(MAX) - _int(level)
    out = F.lit(0).cast("long")
    for i, c in enumerate(q.xyz):
        out = out + shl(shr(c, n).bitwiseAND(F.lit(1)), i)
    return F.when(_int(level) == 0, F.lit(0)).otherwise(out.cast("int"))


def child_id(q: Cell) -> Column:
    return ancestor_id(q, q.level)


def child(q: Cell, i: int) -> Cell:
    half = shl(1, F.lit(MAX - 1) - q.level)
    return Cell(tuple(c + half if i >> a & 1 else c for a, c in enumerate(q.xyz)), q.level + 1)


def children(q: Cell) -> Column:
    """Array of the 2**dim children in Morton order; explode it to refine."""
    return F.array(*[packed(child(q, i)) for i in range(CORNERS[q.dim])])


def sibling(q: Cell, i: int) -> Cell:
    return Cell(tuple(x + (length(q.level) if i >> a & 1 else 0) for a, x in enumerate(parent(q).xyz)), q.level)


def is_sibling(a: Cell, b: Cell) -> Column:
    return (a.level == b.level) & (a.level > 0) & ~is_equal(a, b) & is_equal(parent(a), parent(b))


def is_parent(a: Cell, b: Cell) -> Column:
    """Is a the parent of b?"""
    return (b.level > 0) & F.coalesce(is_equal(a, parent(b)), F.lit(False))


def is_ancestor(a: Cell, b: Cell) -> Column:
    """Is a a strict ancestor of b?"""
    return (a.level < b.level) & is_equal(a, ancestor(b, F.least(a.level, b.level)))


def overlaps(a: Cell, b: Cell) -> Column:
    """Is one cell the other, or inside it?"""
    low = F.least(a.level, b.level)
    return is_equal(ancestor(a, low), ancestor(b, low))


def is_family(cells: list[Cell]) -> Column:
    """Are these 2**dim cells the children of one cell, in order?"""
    up = parent(cells[0])
    out = cells[0].level > 0
    for i, c in enumerate(cells):
        out = out & is_equal(c, child(up, i))
    return F.coalesce(out, F.lit(False))


def first_descendant(q: Cell, level=QMAX) -> Cell:
    return Cell(q.xyz, _int(level))


def last_descendant(q: Cell, level=QMAX) -> Cell:
    shift = length(q.level) - length(level)
    return Cell(tuple(c + shift for c in q.xyz), _int(level))


def corner_descendant(q: Cell, corner: int, level=QMAX) -> Cell:
    shift = length(q.level) - length(level)
    return Cell(tuple(c + shift if corner >> i & 1 else c for i, c in enumerate(q.xyz)), _int(level))


def is_next(a: Cell, b: Cell) -> Column:
    """Does b follow a directly in Morton order, whatever its size?"""
    return _differs(successor(a), b) == 0


def is_first_last(first: Cell, last: Cell, q: Cell) -> Column:
    """Are first and last the first and last descendants of q at their levels?"""
    return is_equal(first, first_descendant(q, first.level)) & is_equal(last, last_descendant(q, last.level))


def enlarge_first(q: Cell, lowest) -> Cell:
    """The largest ancestor (down to level `lowest`) of which q is the first descendant."""
    low = F.lit(0).cast("long")
    for c in q.xyz:
        low = low.bitwiseOR(c)
    free = F.bit_count(low.bitwiseAND(-low) - 1)  # trailing zeros; 64 of 0
    return Cell(q.xyz, F.least(q.level, F.greatest(F.lit(MAX) - free, _int(lowest))).cast("int"))


def enlarge_last(q: Cell, lowest) -> Cell:
    """The largest ancestor (down to level `lowest`) of which q is the last descendant."""
    end = Cell(tuple(c + length(q.level) for c in q.xyz), q.level)
    return ancestor(q, enlarge_first(end, lowest).level)


def nearest_common_ancestor(a: Cell, b: Cell) -> Cell:
    bits = F.lit(0).cast("long")
    for x, y in zip(a.xyz, b.xyz):
        bits = bits.bitwiseOR(x.bitwiseXOR(y))
    top = F.when(bits == 0, F.lit(0)).otherwise(F.length(F.bin(bits)))
    return ancestor(a, F.least(a.level, b.level, F.lit(MAX) - top))


def is_ancestor_face(a: Cell, b: Cell, face: int) -> Column:
    """Is a an ancestor of b (or b) whose face `face` holds b's?"""
    axis, side = divmod(face, 2)
    same = a.xyz[axis] + length(a.level) == b.xyz[axis] + length(b.level) if side else a.xyz[axis] == b.xyz[axis]
    return (is_ancestor(a, b) | is_equal(a, b)) & same


def is_ancestor_corner(a: Cell, b: Cell, corner: int) -> Column:
    """Is a an ancestor of b (or b) whose corner `corner` is b's?"""
    return (is_ancestor(a, b) | is_equal(a, b)) & is_equal(corner_descendant(a, corner, b.level), b)


# --- validity and the root's surroundings ---------------------------------------------------------------------------
def _all(parts) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _count(parts) -> Column:
    return sum((p.cast("int") for p in parts), F.lit(0))


def is_inside_root(q: Cell) -> Column:
    return _all((c >= 0) & (c < ROOT) for c in q.xyz)


def point_inside_root(xyz) -> Column:
    return _all((c >= 0) & (c <= ROOT) for c in xyz)


def is_inside_3x3(q: Cell) -> Column:
    return _all((c >= -ROOT) & (c < 2 * ROOT) for c in q.xyz)


def outside_axes(q: Cell) -> Column:
    """Number of axes in which the cell is outside the root: 1 face, 2 edge (2D: corner), 3 corner."""
    return _count((c < 0) | (c >= ROOT) for c in q.xyz)


def is_outside_face(q: Cell) -> Column:
    return outside_axes(q) == 1


def is_outside_edge(q: Cell) -> Column:
    return outside_axes(q) == 2


def outside_edge(q: Cell) -> Column:
    """Number of the octant edge beyond which the cell is; null if it is not beyond one."""
    out = F.lit(None).cast("int")
    for axis in range(3):
        a, b = [i for i in range(3) if i != axis]
        hit = (q.xyz[axis] >= 0) & (q.xyz[axis] < ROOT) & ((q.xyz[a] < 0) | (q.xyz[a] >= ROOT)) & ((q.xyz[b] < 0) | (q.xyz[b] >= ROOT))
        out = F.when(hit, 4 * axis + (q.xyz[a] > 0).cast("int") + 2 * (q.xyz[b] > 0).cast("int")).otherwise(out)
    return out


def is_outside_corner(q: Cell) -> Column:
    return outside_axes(q) == q.dim


def _aligned(xyz, level) -> Column:
    return _all(c.bitwiseAND(length(level) - 1) == 0 for c in xyz)


def is_extended(q: Cell) -> Column:
    return (q.level >= 0) & (q.level <= QMAX) & _aligned(q.xyz, q.level) & is_inside_3x3(q)


def is_valid(q: Cell) -> Column:
    return is_extended(q) & is_inside_root(q)


def is_node(q: Cell, inside: bool = False) -> Column:
    """Is it a point of the grid in the closed root, or clamped inside?"""
    end = ROOT - 1 if inside else ROOT
    return (q.level == MAX) & _all((c >= 0) & (c <= ROOT) & ((c.bitwiseAND(F.lit(1)) == 0) | (c == end)) for c in q.xyz)


def point_is_valid(xyz, level=MAX) -> Column:
    return point_inside_root(xyz) & _aligned(xyz, level)


def clamp(q: Cell) -> Cell:
    """A node on the far side of the root moves one unit inside."""
    return Cell(tuple(F.when(c == ROOT, ROOT - 1).otherwise(c) for c in q.xyz), q.level)


def unclamp(q: Cell) -> Cell:
    return Cell(tuple(F.when(c == ROOT - 1, ROOT).otherwise(c) for c in q.xyz), q.level)


def node_to_cell(q: Cell, level) -> Cell:
    """The level's cell that holds a clamped node."""
    return ancestor(q, level)


def contains_node(q: Cell, node: Cell) -> Column:
    return is_equal(q, node_to_cell(clamp(node), q.level))


# --- neighbours inside one coordinate system ---------------------------------------------------------------------------
def volume_point(q: Cell) -> tuple:
    half = ushr(length(q.level), 1)
    return tuple(c + half for c in q.xyz)


def face_neighbor(q: Cell, face: int) -> Cell:
    axis, side = divmod(face, 2)
    step = length(q.level) if side else -length(q.level)
    return Cell(tuple(c + step if i == axis else c for i, c in enumerate(q.xyz)), q.level)


def half_face_neighbors(q: Cell, face: int) -> list[Cell]:
    """The 2**(dim - 1) half-size neighbours across a face, in Morton order."""
    axis, side = divmod(face, 2)
    out = face_neighbor(q, face)
    return [child(out, i) for i in range(CORNERS[q.dim]) if (i >> axis & 1) == 1 - side]


def all_face_neighbors(q: Cell, face: int) -> Column:
    """Array of candidates across a face: the half-size ones, the same-size one and the double-size one (where there is one)."""
    same = face_neighbor(q, face)
    double = F.when(q.level > 0, packed(parent(same)))
    return F.array_compact(F.array(*[packed(h) for h in half_face_neighbors(q, face)], packed(same), double))


def face_point(q: Cell, face: int) -> tuple:
    axis, side = divmod(face, 2)
    n = length(q.level)
    return tuple((c + n if side else c) if i == axis else c + ushr(n, 1) for i, c in enumerate(q.xyz))


def edge_sides(edge: int) -> tuple[int, dict[int, int]]:
    """Axis of an octant edge, and the side of each other axis."""
    axis = edge // 4
    a, b = [i for i in range(3) if i != axis]
    return axis, {a: edge & 1, b: edge >> 1 & 1}


def edge_neighbor(q: Cell, edge: int) -> Cell:
    _, sides = edge_sides(edge)
    n = length(q.level)
    return Cell(tuple(c if i not in sides else c + n if sides[i] else c - n for i, c in enumerate(q.xyz)), q.level)


def edge_point(q: Cell, edge: int) -> tuple:
    _, sides = edge_sides(edge)
    n = length(q.level)
    return tuple(c + ushr(n, 1) if i not in sides else c + n if sides[i] else c for i, c in enumerate(q.xyz))


def corner_neighbor(q: Cell, corner: int) -> Cell:
    n = length(q.level)
    return Cell(tuple(c + n if corner >> i & 1 else c - n for i, c in enumerate(q.xyz)), q.level)


def half_corner_neighbor(q: Cell, corner: int) -> Cell:
    return child(corner_neighbor(q, corner), (CORNERS[q.dim] - 1) ^ corner)


def corner_point(q: Cell, corner: int) -> tuple:
    n = length(q.level)
    return tuple(c + n if corner >> i & 1 else c for i, c in enumerate(q.xyz))


def corner_node(q: Cell, corner: int) -> Cell:
    return Cell(corner_point(q, corner), F.lit(MAX))


def touches_corner(q: Cell, corner: int, inside: bool = True) -> Column:
    """Does the cell touch the root's corner, from inside or from outside?"""
    n = length(q.level)
    at = [(F.lit(ROOT) - n if corner >> i & 1 else F.lit(0).cast("long")) if inside else (F.lit(ROOT).cast("long") if corner >> i & 1 else -n) for i in range(q.dim)]
    return _all(c == p for c, p in zip(q.xyz, at))


def touches_edge(q: Cell, edge: int, inside: bool = True) -> Column:
    _, sides = edge_sides(edge)
    n = length(q.level)
    at = {i: (F.lit(ROOT) - n if s else F.lit(0).cast("long")) if inside else (F.lit(ROOT).cast("long") if s else -n) for i, s in sides.items()}
    return _all(q.xyz[i] == p for i, p in at.items())


def at_corner(q: Cell, corner: int, inside: bool = True) -> Cell:
    """A cell of q's level in the root's corner, inside or just outside."""
    n = length(q.level)
    return Cell(tuple((F.lit(ROOT) - n if corner >> i & 1 else F.lit(0).cast("long")) if inside else (F.lit(ROOT).cast("long") if corner >> i & 1 else -n) for i in range(q.dim)), q.level)


def shift_corner(q: Cell, corner: int) -> Cell:
    """The finest ancestor of q (or q) that touches the root's corner from inside."""
    deepest = F.greatest(*[F.when((q.level >= k) & touches_corner(ancestor(q, k), corner), F.lit(k)).otherwise(F.lit(0)) for k in range(QMAX + 1)])
    return ancestor(q, deepest)


def shift_edge(q: Cell, edge: int) -> Cell:
    """The finest ancestor of q (or q) that touches the root's octant edge from inside."""
    deepest = F.greatest(*[F.when((q.level >= k) & touches_edge(ancestor(q, k), edge), F.lit(k)).otherwise(F.lit(0)) for k in range(QMAX + 1)])
    return ancestor(q, deepest)


def overlaps_range(q: Cell, first: Cell, last: Cell) -> Column:
    """Does q meet the Morton range of two cells of the finest level, such as a rank's part of a tree?"""
    return (compare(last_descendant(q), first) >= 0) & (compare(q, last) <= 0)


def is_inside_range(q: Cell, first: Cell, last: Cell) -> Column:
    """Does q lie in the Morton range of two cells of the finest level?"""
    return (compare(first_descendant(q), first) >= 0) & (compare(last_descendant(q), last) <= 0)


def neighbors(q: Cell, kind: str) -> list[Cell]:
    """Same-size neighbours of kind face, edge (faces and edges) or corner (all 3**dim - 1)."""
    most = {"face": 1, "edge": min(2, q.dim), "corner": q.dim}[kind]
    n = length(q.level)
    out = []
    for i in range(3**q.dim):
        d = [i // 3**a % 3 - 1 for a in range(q.dim)]
        if 0 < sum(map(abs, d)) <= most:
            out.append(Cell(tuple(c if s == 0 else c + n if s > 0 else c - n for c, s in zip(q.xyz, d)), q.level))
    return out


# --- transforms between coordinate systems -----------------------------------------------------------------------------
def transform(q: Cell, perm: Column, sign: Column, shift: Column, point: bool = False) -> Cell:
    """Affine map: axis i of the result is sign[i] * xyz[perm[i]] + shift[i] * ROOT; a reversed cell moves by its length."""
    n = F.lit(0).cast("long") if point else length(q.level)
    source = F.array(*q.xyz)
    out = []
    for i in range(q.dim):
        c = F.get(source, perm[i])
        out.append(sign[i] * c + shift[i].cast("long") * ROOT - F.when(sign[i] < 0, n).otherwise(0))
    return Cell(tuple(out), q.level)


def transform_back(q: Cell, perm: Column, sign: Column, shift: Column, point: bool = False) -> Cell:
    """Inverse of transform()."""
    n = F.lit(0).cast("long") if point else length(q.level)
    out = []
    for i in range(q.dim):
        j = F.array_position(perm, i) - 1
        value = F.get(F.array(*q.xyz), j)
        s, o = F.get(sign, j), F.get(shift, j).cast("long") * ROOT
        out.append(s * (value + F.when(s < 0, n).otherwise(0) - o))
    return Cell(tuple(out), q.level)


def balance_seed_level(q: Cell, box: Cell) -> Column:
    """Level of the finest cell that a balanced box must have next to q: q.level - floor(log2(distance + 1)).

    q is outside the box and finer than it; distance counts q-sized cells between q's family and the box. A result of at most the box's level asks for no split.
    """
    n = length(q.level - 1)
    up = parent(q)
    far = F.greatest(*[F.greatest(F.lit(0).cast("long"), b - (c + n), c - (b + length(box.level))) for c, b in zip(up.xyz, box.xyz)])
    steps = shr(far, F.lit(MAX) - q.level)
    return q.level - F.length(F.bin(steps + 1))
