"""Cell functions, adjacency, nodes, search, columns, files and adaptation against brute force in plain Python."""

import itertools
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparkgrove.functions import geometry as G
from sparkgrove.functions import quadrant as Q
from sparkgrove.operators import adjacency, nodes, search
from sparkgrove.operators.adapt import Adaptive, Builder, moved
from sparkgrove.operators.columns import Columns
from sparkgrove.operators.forest import Forest, adler_combine, complete_region, next_nonempty, points_forest
from sparkgrove.plans import registry
from sparkgrove.plans.lineage import cut, ranked
from sparkgrove.sources import meshfiles, sections
from sparkgrove.sources import topology as T

SIDE = 1 << 30
slow = pytest.mark.skipif(not os.environ.get("GROVE_ALL"), reason="takes minutes; run with GROVE_ALL=1")


def ln(level):
    return 1 << 30 - level


def interleave(xyz, level):
    n = len(xyz)
    return sum((c >> 30 - level >> b & 1) << n * b + i for i, c in enumerate(xyz) for b in range(level))


def some_cells(dim, count, most, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        level = rng.randrange(0, most + 1)
        out.append((*(rng.randrange(1 << level) * ln(level) for _ in range(dim)), level))
    return out


@pytest.mark.parametrize("dim,most", [(2, 29), (3, 20)])
def test_cell_functions(spark, dim, most):
    axes = Q.axes(dim)
    cells = some_cells(dim, 60, most, 1) + some_cells(dim, 60, 3, 2)
    pairs = [(i, *a, *b) for i, (a, b) in enumerate(zip(cells, cells[7:] + cells[:7]))]
    names = ["i", *axes, "level", *("b" + a for a in axes), "blevel"]
    df = spark.createDataFrame(pairs, ", ".join(f"{n} {'int' if 'level' in n else 'long'}" for n in names))
    a, b = Q.cell(dim), Q.cell(dim, "b")
    id_ = Q.linear_id(a, a.level)
    df = cut(df.withColumn("id", id_))  # an index and its inverse in one expression would be very large
    back = Q.from_linear_id(F.col("id"), a.level, dim)
    out = df.select(
        *names, "id", Q.is_equal(a, back).alias("same"), Q.is_ancestor(a, b).alias("anc"), Q.overlaps(a, b).alias("over"), Q.compare(a, b).alias("cmp"),
        Q.packed(Q.nearest_common_ancestor(a, b)).alias("nca"), Q.child_id(a).alias("cid"), Q.is_sibling(a, b).alias("sib"), Q.is_next(a, b).alias("next"),
        F.array(*[Q.packed(n) for n in Q.neighbors(a, "corner")]).alias("near"), Q.children(a).alias("kids"), Q.packed(Q.last_descendant(a)).alias("last"), Q.is_valid(a).alias("valid"),
    )
    for r in out.collect():
        p, q = tuple(r[x] for x in axes), tuple(r["b" + x] for x in axes)
        l, m = r["level"], r["blevel"]
        up = lambda c, k: tuple(v >> 30 - k << 30 - k for v in c)
        assert r["id"] == interleave(p, l) and r["same"] and r["valid"]
        assert r["anc"] == (l < m and up(q, l) == p)
        assert r["over"] == (up(p, min(l, m)) == up(q, min(l, m)))
        key = lambda c, k: (interleave(c, 30), k)
        assert r["cmp"] == (key(p, l) > key(q, m)) - (key(p, l) < key(q, m))
        best = max(k for k in range(min(l, m) + 1) if up(p, k) == up(q, k))
        assert (tuple(r["nca"][x] for x in axes), r["nca"]["level"]) == (up(p, best), best)
        assert r["cid"] == (sum((c >> 30 - l & 1) << i for i, c in enumerate(p)) if l else 0)
        assert r["sib"] == (l == m and l > 0 and p != q and up(p, l - 1) == up(q, l - 1))
        assert r["next"] == (interleave(p, 30) + (1 << dim * (30 - l)) == interleave(q, 30))
        want = {tuple(c + d * ln(l) for c, d in zip(p, way)) for way in itertools.product((-1, 0, 1), repeat=dim) if any(way)}
        assert {tuple(n[x] for x in axes) for n in r["near"]} == want
        if l < 29:
            assert [interleave(tuple(k[x] for x in axes), l + 1) for k in r["kids"]] == [interleave(p, l) * 2**dim + i for i in range(2**dim)]
        assert tuple(r["last"][x] for x in axes) == tuple(c + ln(l) - ln(29) for c in p)


def test_wide_keys_in_3d(spark):
    cells = some_cells(3, 80, 29, 5)
    df = spark.createDataFrame(cells, "x long, y long, z long, level int")
    q = Q.cell(3)
    df = cut(df.withColumn("w", Q.linear_id128(q, q.level)))
    back = Q.from_linear_id128(F.col("w"), q.level)
    for r in df.select("*", Q.is_equal(q, back).alias("same")).collect():
        got = r["w"]["hi"] * (1 << 64) + (r["w"]["lo"] % (1 << 64))
        assert got == interleave((r["x"], r["y"], r["z"]), r["level"]) and r["same"]


@slow
def test_enlarge_and_range_boundaries(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        level = 26 + rng.randrange(3)
        box = tuple(rng.randrange(1 << level) * ln(level) for _ in range(2))
        inside = sorted(itertools.product(*[range(c, c + ln(level), 2) for c in box]), key=lambda p: interleave(p, 30))
        a, b = sorted(rng.sample(range(len(inside)), 2)) if i % 5 else (0, len(inside) - 1)
        rows.append((i, level, *inside[a], *inside[b]))
    df = spark.createDataFrame(rows, "i int, l int, x long, y long, bx long, by long")
    first, last = Q.Cell((F.col("x"), F.col("y")), F.lit(29)), Q.Cell((F.col("bx"), F.col("by")), F.lit(29))
    hit = search.range_boundaries(first, last, F.col("l"))
    for r in df.select("*", hit["faces"].alias("f"), hit["corners"].alias("c"), Q.enlarge_first(first, F.col("l")).level.alias("e")).collect():
        n = ln(r["l"])
        low = tuple(c // n * n for c in (r["x"], r["y"]))
        inside = [p for p in itertools.product(*[range(c, c + n, 2) for c in low]) if interleave((r["x"], r["y"]), 30) <= interleave(p, 30) <= interleave((r["bx"], r["by"]), 30)]
        faces = sum(any(p[a] == low[a] + s * (n - 2) for p in inside) << 2 * a + s for a in (0, 1) for s in (0, 1))
        corners = sum((tuple(low[a] + (c >> a & 1) * (n - 2) for a in (0, 1)) in inside) << c for c in range(4))
        assert (r["f"], r["c"]) == (faces, corners)
        up = 29
        while up > r["l"] and all(c % ln(up - 1) == 0 for c in (r["x"], r["y"])):
            up -= 1
        assert r["e"] == up


def random_forest(spark, top, seed, most=4, count=25, kind="corner"):
    """A balanced forest around random points, and its leaves in plain Python by gid."""
    rng = random.Random(seed)
    dim = top.dim
    rows = [(rng.randrange(top.n), *(rng.randrange(SIDE) // rng.choice([1, 9]) for _ in range(dim))) for _ in range(count)]
    df = spark.createDataFrame(rows, "tree long, " + ", ".join(f"{a} long" for a in Q.axes(dim)))
    f = points_forest(df, top, 3, most)
    f = Forest(top, cut(f.leaves.select(*f.keys))).balance(kind)
    leaves = cut(f.numbered())
    return f, leaves, {r["gid"]: r for r in leaves.collect()}


@pytest.mark.parametrize("name,dim", [("brick23", 2), *(pytest.param(n, d, marks=slow) for n, d in (("moebius", 2), ("rotwrap", 2), ("twowrap", 3)))])
def test_mesh_is_symmetric_and_nodes_match_places(spark, name, dim):
    top = T.by_name(name, dim)
    f, leaves, plain = random_forest(spark, top, 3, most=3 if dim == 3 else 4)
    assert f.is_valid() and adjacency.is_balanced(f, "corner")
    rows = adjacency.mesh(leaves, top).collect()
    assert len({(r["gid"], r["face"]) for r in rows}) == len(rows) == 2 * dim * len(plain)
    kinds = 2 * dim * (2 if dim == 2 else 4)
    by = {(r["gid"], r["face"]): r for r in rows}
    for r in rows:
        for n in r["neighbors"]:
            nface = r["code"] % kinds % (2 * dim)
            other = by[n, nface]
            assert r["gid"] in other["neighbors"]
            assert plain[r["gid"]]["level"] - plain[n]["level"] == (r["code"] >= kinds) - (r["code"] < 0)
        assert len(r["neighbors"]) == (2 ** (dim - 1) if r["code"] < 0 else 1)
    # nodes of degree 1 are the distinct corners that do not hang, each element has 2**dim of them
    used, made = nodes.number(leaves, top, 1)
    places = nodes.corner_nodes(leaves, top).collect()
    assert made.count() == sum(not p["hanging"] for p in places)
    assert used.count() == len(plain) * 2**dim
    seen = {}
    for g, r in plain.items():
        for c in range(2**dim):
            p = top.canonical(r["tree"], tuple(r[a] + (c >> i & 1) * ln(r["level"]) for i, a in enumerate(Q.axes(dim))), SIDE)
            seen.setdefault(p, set()).add((g, c))
    axes = Q.axes(dim)
    assert {(p["c_tree"], tuple(p["c_" + a] for a in axes)) for p in places} == set(seen)
    assert all(p["touching"] == len(seen[p["c_tree"], tuple(p["c_" + a] for a in axes)]) for p in places)
    if dim == 2:
        deps = nodes.hanging_corners(leaves, top)
        assert deps.groupBy("c_tree", "c_x", "c_y").count().where("count <> 2").isEmpty()
    # quadratic nodes and entities: as many as Euler's formula says on the two-dimensional domains
    if dim == 2:
        entity, cones = nodes.entity_graph(leaves, top)
        count = {r["depth"]: r["n"] for r in entity.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert count[0] == made.count() and count[2] == len(plain)
        euler = {"brick23": 1, "moebius": 0, "rotwrap": 0}[name]
        # a hanging face counts once for its two small sides, so each adds one corner and two faces to the conforming count
        hung = sum(p["hanging"] for p in places)
        assert count[0] + hung - (count[1] + hung) + count[2] == euler + hung or count[0] - count[1] + count[2] == euler


def test_ghosts_match_brute_force(spark):
    top = T.brick((2, 2))
    f, _, _ = random_forest(spark, top, 8)
    ranked_leaves = cut(f.partition(3)[0])
    rows = ranked_leaves.collect()
    boxes = {}
    for r in rows:
        at = top.vertices[r["tree"]][0]
        lo = tuple(int(at[i]) * SIDE + r[a] for i, a in enumerate("xy"))
        boxes[r["gid"]] = (r["rank"], lo, tuple(c + ln(r["level"]) for c in lo))
    touch = {(a, b) for a, (_, la, ha) in boxes.items() for b, (_, lb, hb) in boxes.items() if a != b and all(x <= v and w <= y for x, y, w, v in zip(la, ha, lb, hb))}
    got = {(r["rank"], r["owner"], r["gid"]) for r in adjacency.ghosts(ranked_leaves, top).collect()}
    assert got == {(boxes[a][0], boxes[b][0], b) for a, b in touch if boxes[a][0] != boxes[b][0]}
    more = {(r["rank"], r["gid"]) for r in adjacency.expand_ghosts(adjacency.ghosts(ranked_leaves, top), ranked_leaves, top).collect()}
    wide = {(r, b) for r, _, g in got for a, b in touch if a == g and boxes[b][0] != r} | {(r, g) for r, _, g in got}
    assert more == wide


def test_partition_order_and_bounds(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i % 3) for i in range(1000)], "k long, w long")
    got = sorted((r["gid"], r["k"], r["gid_weight"]) for r in ranked(df, [F.col("k")], "gid", "w").collect())
    total, weight = 0, {i * 7919 % 1000: i % 3 for i in range(1000)}
    for i, (gid, k, w) in enumerate(got):
        total += weight[k]
        assert gid == k == i and w == total
    f = Forest.uniform(spark, T.brick((3, 1)), 2)
    assert f.partition(5)[1].orderBy("rank").select("first_gid").collect() == [(48 * p // 5,) for p in range(6)]
    assert all(g % 4 == 0 for g in f.family_safe([48 * p // 5 for p in range(6)]))
    assert moved([0, 10, 20], [0, 12, 20]) == 2
    leaves = cut(f.numbered()).where("gid % 3 = 0")
    cells = f.leaves.select("tree", "x", "y", "level")
    numbered = {(r["tree"], r["x"], r["y"]): r["gid"] for r in f.numbered().collect()}
    for lower in (True, False):
        for r in search.bound(cells, leaves, 2, lower).collect():
            g = numbered[r["tree"], r["x"], r["y"]]
            want = -(-g // 3) * 3 if lower else g // 3 * 3
            assert r["bound"] == (want if want < 48 else None)


def test_build_and_complete(spark):
    top = T.unit(2)
    cells = spark.createDataFrame([(0, 0, 0, 3), (0, SIDE // 2, 0, 2), (0, 0, 0, 3), (0, 0, 0, 1)], "tree long, x long, y long, level int")
    f = Builder(top).add(cells).complete()
    assert f.is_valid() and f.leaves.where("added").count() == 2 and f.leaves.count() == 13
    between = complete_region(spark, (0, 0, 3), (SIDE // 2, SIDE // 2, 1), 2).collect()
    assert sum(4.0 ** -r["level"] for r in between) == 3 / 4 - 1 / 64
    assert Forest(top, f.leaves.where("level < 3")).validity()["open_trees"] == 1


def test_adapt_cycle(spark):
    a = Adaptive.new(spark, "unit", 2)
    mark = lambda rows: spark.createDataFrame(rows, "tree long, x long, y long, level int")
    q = SIDE // 4
    b, changed = a.mark_refine(mark([(0, 0, 0, 2)])).mark_coarsen(mark([(0, 2 * q + i * q, 2 * q + j * q, 2) for i in (0, 1) for j in (0, 1)])).adapt()
    assert b.forest.revision == 1 and b.forest.is_valid()
    assert sorted((r["level"], r["change"]) for r in changed.collect()) == [(1, -1), (3, 1), (3, 1), (3, 1), (3, 1)]
    c, leaves, kept = b.partition(4, exponent=1)
    assert leaves.count() == 16 and sum(n for _, n in kept.values()) == 16 and len(c.firsts) == 5
    assert b.adapt()[1].count() == 0


def test_columns_balance_and_counts(spark):
    c = Columns.new(spark, T.unit(2), 1, 1)
    deep = c.refine_layers(lambda d: (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0) & (F.col("zlevel") < 5), recursive=True).balance()
    rows = deep.layers.collect()
    spans = [((r["x"], r["y"]), r["z"], r["z"] + ln(r["zlevel"]), r["zlevel"]) for r in rows]
    for a, b in itertools.product(spans, spans):  # all four columns touch
        if a[1] <= b[2] and b[1] <= a[2]:
            assert abs(a[3] - b[3]) <= 1
    assert sum(h - lo for _, lo, h, _ in spans) == 4 * SIDE
    back = deep.coarsen_columns(lambda d: F.col("level") == 0)
    assert back.columns().leaves.count() == 1 and sum(ln(r["zlevel"]) for r in back.layers.collect()) == SIDE
    assert Columns.new(spark, T.unit(2), 1, 2).coarsen_layers(lambda d: F.lit(True)).layers.count() == 8
    split = c.refine_columns(lambda d: F.col("x") == 0)
    assert split.layers.count() == 2 * (2 * 4 + 2)
    ranked_layers, firsts = split.partition(3)
    assert ranked_layers.groupBy("tree", "x", "y", "level").agg(F.countDistinct("rank").alias("n")).where("n > 1").isEmpty() and split.column_cuts(firsts)[-1] == 10


def test_files_round_trip(spark, tmp_path):
    top = T.brick((2, 1))
    f = Forest.uniform(spark, top, 1, {"v": F.rand(3)}).refine(lambda d: F.col("x") == 0)
    meshfiles.save(f, str(tmp_path / "forest"))
    g = meshfiles.load(spark, str(tmp_path / "forest"))
    assert g.equals(f, payload=True) and g.topology.same(top)
    raw = b"".join(meshfiles.deflate(f))
    assert meshfiles.inflate(spark, raw).equals(f)
    for bad in (raw[:-4], b"x" + raw, raw[:40]):
        with pytest.raises(ValueError):
            meshfiles.inflate(spark, bad)
    files = meshfiles.write_vtk(f, str(tmp_path / "out"), ranks=2, fields=("v",))
    assert len(files) == 4 and "NumberOfCells" in open(files[0]).read()
    more = meshfiles.write_vtk(Forest(f.topology, f.leaves.withColumn("w", F.lit(1.0))), str(tmp_path / "more"), vectors={"flow": ("w", "w", "w")}, point_fields={"height": F.col("px") * 2})
    text = open(more[0]).read()
    assert 'Name="flow" NumberOfComponents="3"' in text and "<PointData>" in text and "PPointData" in open(more[-2]).read()
    pts = spark.createDataFrame([(0.5, 1.0, -2.0), (3.0, 4.0, 5.0)], "x double, y double, z double")
    assert meshfiles.write_points(pts, str(tmp_path / "pts")) == 2
    assert sorted(meshfiles.read_points(spark, str(tmp_path / "pts")).collect()) == sorted(pts.collect())


def test_sectioned_files(spark, tmp_path):
    f, _, _ = random_forest(spark, T.star(), 2, 2, 6)
    f = Forest(f.topology, f.leaves.withColumn("v", F.col("tree") + 0.5))
    path = str(tmp_path / "forest.dat")
    sections.write_forest(spark, path, f, "a test", ("v",))
    again = sections.read_forest(spark, path)
    assert again.equals(f, payload=True) and again.topology.same(f.topology)
    raw, n = open(path, "rb").read(), f.leaves.count()
    found = sections.info(raw)
    assert (found["dim"], found["user"], found["n"]) == (2, "a test", n) and [s[:2] for s in found["sections"]][1:] == [("B", 56), ("F", 12), ("F", 8)]
    assert len(raw) % 16 == 0 and raw[80:97] == b"%016d\n" % n and raw[112:114] == b"B "
    assert [len(sections.padding(k)) for k in (0, 1, 14, 15, 16)] == [16, 15, 2, 17, 16]
    for bad in (b"", raw[:-1], raw[:112] + b"X" + raw[113:], b"x" + raw[1:]):
        with pytest.raises(ValueError):
            sections.info(bad)


def test_domain_files():
    two = meshfiles.parse_inp("*Heading\n x\n*Node\n1,0,0,0\n2,1,0,0\n3,1,1,0\n4,0,1,0\n5,2,0,0\n6,2,1,0\n*Element, type=C2D4\n1,1,2,3,4\n2,2,5,6,3\n*Nset\n1,2\n", 2)
    assert two.n == 2 and two.face_neighbor(0, 1) == (1, 0, 0) and not two.problems()
    with pytest.raises(ValueError):
        meshfiles.parse_inp("*Node\n1,0,0,0\n", 2)
    points, tets, _ = meshfiles.parse_tets("5 3 0 0\n1 0 0 0\n2 1 0 0\n3 0 1 0\n4 0 0 1\n5 1 1 1 # last\n", "2 4 0\n1 1 2 3 4\n2 2 3 4 5\n")
    right, flips = meshfiles.right_handed(points, tets)
    box = meshfiles.tets_topology(points, right)
    assert box.n == 8 and flips == 1 or flips == 0
    assert not box.problems() and len(box.faces) == 2 * (2 * 6 + 3)


def test_topologies_are_sound(spark):
    for (dim, name), make in T.CATALOGUE.items():
        top = make()
        assert not top.problems(), name
        assert top.inflate(top.deflate()).same(top)
        for t, way in itertools.product(range(top.n), itertools.product((-1, 0, 1), repeat=dim)):
            for nt, perm, sign, shift in top.transforms(t, way):
                # the cell just outside comes to lie inside the neighbour
                p = [{-1: -1, 0: 3, 1: 8}[s] for s in way]
                q = [sign[i] * p[perm[i]] + shift[i] * 8 - (sign[i] < 0) for i in range(dim)]
                assert all(0 <= c < 8 for c in q) and 0 <= nt < top.n
    assert T.brick((4, 4)).vertices[3][0] == (1.0, 1.0, 0.0)
    perm = T.brick((2, 2)).permute([3, 1, 2, 0])
    assert perm.permute([3, 1, 2, 0]).same(T.brick((2, 2)))
    assert T.unit(2).refine(3).n == 9 and not T.moebius().refine(2).problems()


@slow
def test_maps_agree_where_trees_meet(spark):
    cases = [(T.shell2d(), G.shell2d(1.0, 0.5)), (T.disk2d(), G.disk2d(0.4, 1.0)), (T.cubed(), G.sphere2d(1.0)), (T.shell(), G.shell(1.0, 0.5)), (T.sphere(), G.sphere(1.0, 0.7, 0.4)), (T.torus(4), G.torus(0.2, 0.5, 2.0, 4)), (T.icosahedron(), G.icosahedron(1.0))]
    for top, how in cases:
        dim, axes = top.dim, Q.axes(top.dim)
        rows = []
        for (t, face), (nt, nf, _) in list(top.faces.items()):
            p = [SIDE // 4, SIDE // 2, SIDE // 8][:dim]
            p[face // 2] = SIDE * (face % 2)
            _, perm, sign, shift = top.face_transform(t, face)
            q = [sign[i] * p[perm[i]] + shift[i] * SIDE for i in range(dim)]
            rows += [(len(rows), t, *p), (len(rows) + 1, nt, *q)]
        df = spark.createDataFrame(rows, "i long, tree long, " + ", ".join(f"{a} long" for a in axes))
        put = G.place_reference(df, how, axes) if top.name == "icosahedron" else G.place(df, top, how, axes)
        got = {r["i"]: (r["px"], r["py"], r["pz"]) for r in put.collect()}
        for i in range(0, len(rows), 2):
            assert all(abs(a - b) < 1e-9 for a, b in zip(got[i], got[i + 1])), (top.name, rows[i], rows[i + 1])


def test_adler_combination():
    import zlib

    a, b = b"some bytes" * 99, b"others" * 1234
    assert adler_combine(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def test_moebius_mesh_reads_all_customers(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparkgrove.plans import queries

    meshes = []
    for nation in (1, 2):
        spark.range(60).select(F.col("id").alias("c_custkey"), F.lit(nation).alias("c_nationkey")).write.parquet(f"{tmp_path}/{nation}/customer.parquet")
        meshes.append(sorted(map(str, queries.moebius_mesh(spark, f"{tmp_path}/{nation}").collect())))
    assert meshes[0] == meshes[1]


def test_checks_of_ghosts_and_nodes(spark):
    f, _, _ = random_forest(spark, T.unit(2), 4, 4, 12)
    leaves, cuts = f.partition(3)
    leaves = leaves.cache()
    ghost = adjacency.ghosts(leaves, f.topology).cache()
    assert adjacency.ghost_problems(ghost, leaves) == {"twice": 0, "own": 0, "unknown": 0, "misplaced": 0}
    one = ghost.limit(1)
    spoilt = ghost.unionByName(one).unionByName(one.withColumn("gid", F.lit(10**6).cast("long"))).unionByName(one.withColumn("owner", F.col("rank")))
    assert all(adjacency.ghost_problems(spoilt, leaves).values())
    cells = [r for r in ghost.join(leaves.drop("rank"), "gid").orderBy("rank", "gid").collect()]
    want = zlib.adler32(b"".join(int(r[c]).to_bytes(4, "big") for r in cells for c in ("x", "y", "level")))
    assert adjacency.ghost_checksum(ghost, leaves, 2) == want
    used, made = nodes.number(leaves, f.topology, 1)
    used, made = used.cache(), made.cache()
    assert not any(nodes.problems(used, made, leaves, 4).values())
    assert nodes.problems(used.where("pos > 0"), made, leaves, 4)["short"] == leaves.count()
    both = adjacency.ghosts_by_nodes(used, leaves, ghost)
    assert ghost.join(both, ["rank", "gid"], "left_anti").isEmpty()
    assert [next_nonempty([0, 0, 5, 5, 9], p) for p in range(4)] == [1, 3, 3, 4]


def firsts_of(c):
    return c.partition(2)[1]


def test_columns_are_saved_and_dealt(spark, tmp_path):
    f, _, _ = random_forest(spark, T.star(), 2, 2, 6)
    c = Columns.over(Forest(f.topology, f.leaves.select(*f.keys)), 1)
    c.save(str(tmp_path / "columns"))
    again = Columns.load(spark, str(tmp_path / "columns"))
    assert again.roots == c.roots and again.topology.same(c.topology) and again.layers.exceptAll(c.layers).isEmpty() and again.layers.count() == c.layers.count()
    n = c.layers.count()
    dealt, firsts = c.partition_given([3, n - 10, 7])
    assert firsts == [0, 2, (n - 7) // 2 * 2, n] and dealt.groupBy("tree", "x", "y", "level").agg(F.countDistinct("rank").alias("r")).where("r > 1").isEmpty()
    with pytest.raises(ValueError):
        c.partition_given([1, 2])
    files = c.write_vtk(str(tmp_path / "layers"), ranks=2)
    assert len(files) == 4 and f'NumberOfCells="{firsts_of(c)[1]}"' in open(files[0]).read()
    ghost = c.ghosts(dealt)
    more = c.expand_ghosts(ghost, dealt)
    assert ghost.join(more, ["rank", "owner", "gid"], "left_anti").isEmpty() and more.where("rank = owner").isEmpty()


def test_shifts_and_attributes(spark):
    rng = random.Random(5)
    cells = [(rng.randrange(1 << 5) << 25, rng.randrange(1 << 5) << 25, rng.randrange(1 << 5) << 25, 5) for _ in range(60)]
    df = spark.createDataFrame(cells, "x long, y long, z long, level int")
    got = df.select("x", "y", "z", Q.shift_edge(Q.cell(3), 5).level.alias("l")).collect()  # edge 5: along y, at the far side of x and the near one of z
    for r in got:
        touches = [k for k in range(6) if (r["x"] >> 30 - k) == (1 << k) - 1 and (r["z"] >> 30 - k) == 0]
        assert r["l"] == max(touches)
    top = T.star().with_attr("colour", [bytes([i]) for i in range(6)])
    assert top.attr["colour"] == bytes(range(6)) and T.Topology.inflate(top.deflate()).attr == top.attr
    with pytest.raises(ValueError):
        T.star().with_attr("colour", [b"a"] * 5)


# --- large tables ----------------------------------------------------------------------------------------------------------------
def test_containment_never_broadcasts_the_cells(spark, monkeypatch):
    """The exploded cells look as small as their file; beyond a number of leaves neither side is broadcast."""
    leaves = cut(Forest.uniform(spark, T.unit(3), 3).numbered())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = adjacency.pairs(leaves, T.unit(3))
    few = sorted(found.collect())
    monkeypatch.setattr("sparkgrove.operators.forest.MAX_BROADCAST_CELLS", 100, raising=False)
    found = adjacency.pairs(leaves, T.unit(3))
    assert "BroadcastHashJoin" not in plan(found) and "SortMergeJoin" in plan(found)
    assert sorted(found.collect()) == few and len(few) == 22**3 - 8**3


def test_ghosts_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr("sparkgrove.operators.forest.MAX_BROADCAST_CELLS", 10, raising=False)
    leaves = cut(Forest.uniform(spark, T.unit(2), 3).partition(4)[0])
    ghost = cut(adjacency.ghosts(leaves, T.unit(2)))
    more = adjacency.expand_ghosts(ghost, leaves, T.unit(2))
    assert "BroadcastHashJoin" not in more._jdf.queryExecution().executedPlan().toString()
    # four quarters of 4 x 4: a layer is 4 + 4 + 1 leaves, two are 8 + 8 + 4
    assert ghost.count() == 4 * 9 and more.count() == 4 * 20
    assert "BroadcastHashJoin" not in adjacency.exchange(ghost, leaves.select("gid", "level"))._jdf.queryExecution().executedPlan().toString()


def test_bounds_ahead_read_each_row_once(spark):
    """A frame that reaches to the end of its partition is read again for each row; the bound ahead must not use one."""
    leaves = cut(Forest.uniform(spark, T.unit(2), 3).numbered())
    cells = leaves.where("gid % 3 = 1").select(*[c for c in leaves.columns if c != "gid"], F.col("gid").alias("want"))
    found = search.bound(cells, leaves.where("gid % 2 = 0"), 2)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    got = [(r["want"], r["bound"]) for r in found.collect()]
    assert len(got) == 21 and all(b == (w if w % 2 == 0 else w + 1 if w < 63 else None) for w, b in got)


def test_alike_queries_are_searched_once(spark):
    f = Forest.uniform(spark, T.unit(2), 3)
    asked = spark.createDataFrame([(i, 0, None if i % 5 == 4 else i % 5) for i in range(40)], "k long, tree long, to int")
    seen = []

    def match(d):
        seen.append(set(d.columns))
        return Q.shr(F.col("x"), 27) <= F.coalesce("to", F.lit(0))

    plain = sorted(search.search(f, asked, match).select("k", "to", "x", "y", "level").collect(), key=str)
    seen.clear()
    got = search.search(f, asked, match, alike=("to",))
    assert sorted(got.select("k", "to", "x", "y", "level").collect(), key=str) == plain and len(plain) == 8 * 8 * (1 + 2 + 3 + 4 + 1)
    assert not any("k" in s for s in seen)


def test_bounds_ahead_of_octants(spark):
    leaves = cut(Forest.uniform(spark, T.unit(3), 2).numbered())
    found = search.bound(leaves.select(*[c for c in leaves.columns if c != "gid"], F.col("gid").alias("want")), leaves.where("gid % 7 = 3"), 3)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert {r["want"]: r["bound"] for r in found.collect()} == {w: next((g for g in range(w, 64) if g % 7 == 3), None) for w in range(64)}


def test_an_index_names_its_coordinates_a_few_times(spark):
    """Plans grow with every mention: 32 for each coordinate made the cell functions slow to plan and to run."""
    q = Q.Cell((F.col("east"), F.col("north")), F.lit(30))
    assert str(Q.linear_id(q, 30)).count("east") <= 4 and str(Q.from_linear_id(F.col("east"), 30).xyz[0]).count("east") <= 8
    big = [(0, 0), (SIDE - 1, 0), (SIDE - 1, SIDE - 1), (0x2AAAAAAA, 0x15555555)]
    got = spark.createDataFrame(big, "east long, north long").select("east", "north", Q.linear_id(q, 30).alias("id"), *Q.columns(Q.successor(q))).collect()
    assert [r["id"] for r in got] == [interleave(v, 30) for v in big]
    back = spark.createDataFrame([(interleave(v, 30),) for v in big], "id long").select(*Q.columns(Q.from_linear_id(F.col("id"), 30)))
    assert [(r["x"], r["y"]) for r in back.collect()] == big


def test_an_octant_index_names_its_coordinates_a_few_times(spark):
    q = Q.Cell((F.col("east"), F.col("north"), F.col("up")), F.lit(21))
    assert str(Q.linear_id(q, 21)).count("east") <= 3 and str(Q.from_linear_id(F.col("east"), 21, 3).xyz[0]).count("east") <= 7
    big = [tuple(v << 9 for v in t) for t in [(0, 0, 0), ((1 << 21) - 1,) * 3, (0x155555, 0xAAAAA, 1), (0, (1 << 21) - 1, 1 << 20)]]
    frame = spark.createDataFrame(big, "east long, north long, up long").withColumn("id", Q.linear_id(q, 21))
    got = frame.select("id", *Q.columns(Q.from_linear_id(F.col("id"), 21, 3)), *Q.columns(Q.predecessor(q, F.col("id")), "same_")).collect()
    assert [r["id"] for r in got] == [interleave(v, 21) for v in big]
    assert [(r["x"], r["y"], r["z"]) for r in got] == big == [(r["same_x"], r["same_y"], r["same_z"]) for r in got]


@pytest.mark.parametrize("dim", [2, 3])
def test_next_and_previous_cells(spark, dim):
    """From coordinates alone, so at every level; null before the first cell, and behind the last the root's neighbour along x."""
    axes, corner = Q.axes(dim), lambda level: ((1 << 30) - ln(level),) * dim
    cells = some_cells(dim, 200, 29, 8) + [(*(0,) * dim, k) for k in (0, 1, 21, 29)] + [(*corner(k), k) for k in (0, 1, 21, 29)]
    cells += [(*(c if keep >> i & 1 else 0 for i, c in enumerate(corner(k))), k) for k in (4, 22, 29) for keep in range(1 << dim)]
    df = spark.createDataFrame(cells, ", ".join(f"{a} long" for a in axes) + ", level int")
    q = Q.cell(dim)
    for r in df.select(*axes, "level", Q.packed(Q.successor(q)).alias("after"), Q.packed(Q.predecessor(q)).alias("before")).collect():
        level, at = r["level"], interleave([r[a] for a in axes], r["level"])
        place = lambda k: tuple(sum((k >> dim * b + i & 1) << b for b in range(31)) * ln(level) for i in range(dim))  # noqa: B023, E731
        assert tuple(r["after"][a] for a in axes) == place(at + 1) and r["after"]["level"] == r["before"]["level"] == level
        assert tuple(r["before"][a] for a in axes) == (place(at - 1) if at else (None,) * dim)


@pytest.mark.parametrize("name", ["cell_kin", "cell_kin_3d", "cell_relations", "cell_relations_3d"])
def test_cell_queries_fit_the_compiler(spark, name):
    """The JVM interprets methods of more than 8,000 bytes for ever, ten times slower."""
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    assert 0 < max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)) < 8000
