"""Reading and writing: domains from ABAQUS and TetGen files, point files, forests as Parquet or one binary file, VTK output.

Domain files describe trees, of which there are few, and are read on the driver. Leaves and points can be many: they are read and
written by executors as Parquet, or in pieces of one partition at a time where a foreign format asks for a single file.
"""

from __future__ import annotations

import base64
import itertools
import json
import struct
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quadrant as Q
from ..operators.forest import Forest, key_names, sort_keys
from .topology import Topology, complete

#: Cells of a VTK file at most.
CELLS = 1 << 17
#: Element types of ABAQUS files that are read, by dimension.
_INP_TYPES = {2: ("C2D4", "CPS4", "S4"), 3: ("C3D8",)}
#: Their corners run around a face; these are their places in Morton order.
_AROUND = {2: (0, 1, 3, 2), 3: (0, 1, 3, 2, 4, 5, 7, 6)}


# --- files through Spark's file systems, so that paths in any store work ----------------------------------------------------
def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A whole small file (a domain, a header)."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    if len(rows) != 1:
        raise ValueError(f"one file is expected: {path}")
    return bytes(rows[0][0])


class Output:
    """A file written from the driver, one piece at a time."""

    def __init__(self, spark: SparkSession, path: str):
        fs, where = _fs(spark, path)
        self.stream = fs.create(where, True)

    def write(self, data: bytes) -> None:
        self.stream.write(bytearray(data))

    def __enter__(self) -> Output:
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()


# --- domains -------------------------------------------------------------------------------------------------------------------
def parse_inp(text: str, dim: int) -> Topology:
    """ABAQUS text: *Node sections (id, x, y, z) and *Element sections of quadrilaterals or hexahedra; other sections are passed over.

    ValueError without nodes or elements, or if an element names an unknown node.
    """
    section, points, trees = "", {}, []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("**"):
            continue
        if line.startswith("*"):
            words = [w.strip().upper() for w in line[1:].split(",")]
            kind = next((w.split("=")[1].strip() for w in words if w.startswith("TYPE")), "")
            section = "node" if words[0] == "NODE" else "element" if words[0] == "ELEMENT" and any(kind.startswith(t) for t in _INP_TYPES[dim]) else ""
            continue
        cells = [c for c in line.split(",") if c.strip()]
        if section == "node":
            points[int(cells[0])] = tuple(float(c) for c in (cells[1:] + ["0", "0"])[:3])
        elif section == "element":
            around = [int(c) for c in cells[1:]]
            if len(around) != 1 << dim:
                raise ValueError(f"an element with {len(around)} corners")
            trees.append([around[i] for i in _AROUND[dim]])
    if not points or not trees:
        raise ValueError("no nodes or no elements")
    if unknown := {v for t in trees for v in t} - points.keys():
        raise ValueError(f"unknown nodes: {sorted(unknown)[:5]}")
    number = {v: i for i, v in enumerate(sorted(points))}
    return complete(dim, [[number[v] for v in t] for t in trees], [points[v] for v in sorted(points)], "inp")


def read_inp(spark: SparkSession, path: str, dim: int = 2) -> Topology:
    return parse_inp(read_bytes(spark, path).decode(), dim)


def _rows(text: str) -> Iterator[list[str]]:
    for line in text.splitlines():
        line = line.split("#")[0].split()
        if line:
            yield line


def parse_tets(node_text: str, ele_text: str) -> tuple[list[tuple], list[list[int]], list[list[float]]]:
    """TetGen .node and .ele texts: points, tetrahedra (0-based) and their attributes."""
    rows = _rows(node_text)
    n = int(next(rows)[0])
    points = {int(r[0]): tuple(map(float, r[1:4])) for r in rows}
    if len(points) != n:
        raise ValueError("the number of nodes is wrong")
    rows = _rows(ele_text)
    n = int(next(rows)[0])
    found = list(rows)
    if len(found) != n:
        raise ValueError("the number of tetrahedra is wrong")
    number = {v: i for i, v in enumerate(sorted(points))}
    return [points[v] for v in sorted(points)], [[number[int(v)] for v in r[1:5]] for r in found], [list(map(float, r[5:])) for r in found]


def right_handed(points: list[tuple], tets: list[list[int]]) -> tuple[list[list[int]], int]:
    """Tetrahedra with a positive volume, two corners swapped where needed, and how many were."""
    out, flips = [], 0
    for t in tets:
        a, b, c = ([points[v][i] - points[t[0]][i] for i in range(3)] for v in t[1:])
        volume = a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
        flips += volume < 0
        out.append([t[1], t[0], *t[2:]] if volume < 0 else list(t))
    return out, flips


def tets_topology(points: list[tuple], tets: list[list[int]]) -> Topology:
    """Each tetrahedron as four hexahedra: one a corner, between mid-points of edges, faces and the whole."""
    place, number = [], {}

    def mid(*vs: int) -> int:
        key = tuple(sorted(vs))
        if key not in number:
            number[key] = len(place)
            place.append(tuple(sum(points[v][i] for v in key) / len(key) for i in range(3)))
        return number[key]

    trees = []
    for t in tets:
        for k in range(4):
            # the other three corners in the order that keeps the hexahedron right-handed
            u, v, w = [t[j] for j in ((1, 2, 3), (2, 0, 3), (0, 1, 3), (1, 0, 2))[k]]
            c = t[k]
            trees.append([mid(c), mid(c, u), mid(c, v), mid(c, u, v), mid(c, w), mid(c, u, w), mid(c, v, w), mid(c, u, v, w)])
    return complete(3, trees, place, "tets")


def read_tets(spark: SparkSession, base: str) -> Topology:
    points, tets, _ = parse_tets(read_bytes(spark, f"{base}.node").decode(), read_bytes(spark, f"{base}.ele").decode())
    return tets_topology(points, right_handed(points, tets)[0])


# --- points ----------------------------------------------------------------------------------------------------------------------
def write_points(points: DataFrame, path: str) -> int:
    """x, y, z (doubles) as a count (64 bits) and 24 bytes a point, in order of the columns; returns the count."""
    n = points.count()

    def pack(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"raw": [np.ascontiguousarray(pdf[["x", "y", "z"]].to_numpy(float)).astype("<f8").tobytes()]})

    with Output(points.sparkSession, path) as out:
        out.write(struct.pack("<q", n))
        for r in points.orderBy("x", "y", "z").select("x", "y", "z").mapInPandas(pack, "raw binary").toLocalIterator():
            out.write(bytes(r["raw"]))
    return n


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of a point file. ValueError if its size does not fit its count."""
    frame = spark.read.format("binaryFile").load(path)

    def unpack(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                n = struct.unpack("<q", raw[:8])[0]
                if len(raw) != 8 + 24 * n:
                    raise ValueError("the size does not fit the count")
                yield pd.DataFrame(np.frombuffer(raw, "<f8", offset=8).reshape(-1, 3), columns=["x", "y", "z"])

    return frame.select("content").mapInPandas(unpack, "x double, y double, z double")


# --- forests ------------------------------------------------------------------------------------------------------------------------
def save(forest: Forest, path: str, payload: bool = True) -> None:
    """A folder of Parquet leaves, ranged along the curve so that readers can prune files, the topology, and a description."""
    leaves = forest.leaves if payload else forest.leaves.select(*forest.keys)
    ranged = leaves.repartitionByRange(*sort_keys(forest.dim)[:2]).sortWithinPartitions(*sort_keys(forest.dim))
    ranged.write.mode("overwrite").parquet(f"{path}/leaves")
    with Output(forest.spark, f"{path}/topology.bin") as out:
        out.write(forest.topology.deflate())
    with Output(forest.spark, f"{path}/forest.json") as out:
        out.write(json.dumps({"dim": forest.dim, "payload": forest.payload if payload else []}).encode())


def load(spark: SparkSession, path: str, payload: bool = True) -> Forest:
    top = Topology.inflate(read_bytes(spark, f"{path}/topology.bin"))
    leaves = spark.read.parquet(f"{path}/leaves")
    return Forest(top, leaves if payload else leaves.select(*key_names(top.dim)))


def deflate(forest: Forest) -> Iterator[bytes]:
    """A forest as one binary stream: a header, the topology, then rows of tree, x, y[, z] and level (big-endian 32-bit words) in order, by partition."""
    words = ["tree", *Q.axes(forest.dim), "level"]
    top = forest.topology.deflate()
    yield b"grovefor" + struct.pack("<QQQ", forest.dim, len(top), forest.leaves.count()) + top
    frame = forest.leaves.select(*words).repartitionByRange(*sort_keys(forest.dim)[:2]).sortWithinPartitions(*sort_keys(forest.dim))

    def pack(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"raw": [pdf[words].to_numpy().astype(">u4").tobytes()]})

    for r in frame.mapInPandas(pack, "raw binary").toLocalIterator():
        yield bytes(r["raw"])


def inflate(spark: SparkSession, raw: bytes) -> Forest:
    """Inverse of deflate() for forests that fit the driver; ValueError if the bytes are no whole, valid forest."""
    if raw[:8] != b"grovefor" or len(raw) < 32:
        raise ValueError("not a forest")
    dim, size, n = struct.unpack("<QQQ", raw[8:32])
    top = Topology.inflate(raw[32 : 32 + size])
    width = 4 * (dim + 2)
    if len(raw) != 32 + size + n * width:
        raise ValueError("the forest is cut off")
    import numpy as np
    import pandas as pd

    rows = np.frombuffer(raw, ">u4", offset=32 + size).reshape(n, dim + 2).astype(np.int64)
    out = Forest.of(top, spark.createDataFrame(pd.DataFrame(rows, columns=["tree", *Q.axes(dim), "level"])))
    if not out.is_valid():
        raise ValueError("the leaves do not make a forest")
    return out


# --- VTK --------------------------------------------------------------------------------------------------------------------------------
def _array(kind: str, name: str, values, parts: int = 1) -> str:
    import numpy as np

    raw = np.ascontiguousarray(values).tobytes()
    packed = zlib.compress(raw)
    body = (base64.b64encode(struct.pack("<IIII", 1, len(raw), 0, len(packed))) + base64.b64encode(packed)).decode()
    wide = f' NumberOfComponents="{parts}"' if parts > 1 else ""
    return f'<DataArray type="{kind}" Name="{name}"{wide} format="binary">{body}</DataArray>'


def write_vtk(forest: Forest, path: str, how: Callable | None = None, fields: tuple[str, ...] = (), scale: float = 0.95, ranks: int = 1, vectors: dict[str, tuple[str, str, str]] | None = None, point_fields: dict[str, Column] | None = None) -> list[str]:
    """`<path>_NNNN.vtu` for each rank, `<path>.pvtu` and `<path>.visit`: cells shrunk by `scale`, with tree, level, rank and fields.

    how: a map of functions.geometry on top of the topology's vertices. fields: payload columns, one value a cell. vectors: names, each with
    three payload columns. point_fields: values at the corners, as expressions of their position px, py, pz. Returns the files.
    """
    from ..functions.geometry import place

    dim, axes = forest.dim, Q.axes(forest.dim)
    corners = 1 << dim
    own = (*fields, *itertools.chain(*(vectors or {}).values()))
    leaves, _ = forest.partition(ranks)
    frame = leaves.select("gid", "rank", "tree", "level", *own, *axes)
    n = Q.length(F.col("level")).cast("double")
    middle = {a: F.col(a) + n / 2 for a in axes}
    spots = F.array(*[F.struct(F.lit(c).alias("c"), *[(middle[a] + n * (scale / 2 * (1 if c >> i & 1 else -1))).alias(a) for i, a in enumerate(axes)]) for c in range(corners)])
    each = frame.select("gid", "rank", "tree", "level", *own, F.explode(spots).alias("s")).select("gid", "rank", "tree", "level", *own, "s.*")
    put = place(each, forest.topology, how or (lambda tree, abc: tuple(abc)), axes)
    return write_cells(put, path, dim, ("tree", "level", "rank"), fields, vectors or {}, point_fields or {})


def write_cells(put: DataFrame, path: str, dim: int, numbers: tuple[str, ...], fields: tuple[str, ...], vectors: dict[str, tuple[str, str, str]], point_fields: dict[str, Column]) -> list[str]:
    """VTK files of cells given by their corners: gid, rank, c (corner in Morton order), px, py, pz and the data columns.

    A file holds at most CELLS cells of one rank, so neither a task nor the driver has more at once: executors make the XML, the driver writes
    file after file. A rank's files beyond the first are called `<path>_NNNN_MMMM.vtu`.
    """
    import numpy as np

    kind, corners = (8, 4) if dim == 2 else (11, 8)  # pixel and voxel: corners in Morton order
    own = (*numbers, *fields, *itertools.chain(*vectors.values()))
    low = put.groupBy("rank").agg(F.min("gid").alias("low"))
    put = put.withColumns({f"point_{f}": c for f, c in point_fields.items()}).join(F.broadcast(low), "rank").withColumn("part", F.floor((F.col("gid") - F.col("low")) / CELLS))  # one row a rank
    at_points = list(point_fields)
    put = put.select("gid", "part", "c", *dict.fromkeys(("rank", *own)), "px", "py", "pz", *[f"point_{f}" for f in at_points])

    def piece(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["gid", "c"])
        cells = pdf[pdf["c"] == 0]
        m = len(cells)
        data = "".join(_array("Float64" if f in fields else "Int32", f, cells[f].to_numpy(np.float64 if f in fields else np.int32)) for f in (*numbers, *fields))
        data += "".join(_array("Float64", f, cells[list(c)].to_numpy(np.float64), 3) for f, c in vectors.items())
        at = "".join(_array("Float64", f, pdf[f"point_{f}"].to_numpy(np.float64)) for f in at_points)
        xml = (
            '<?xml version="1.0"?><VTKFile type="UnstructuredGrid" version="0.1" byte_order="LittleEndian" compressor="vtkZLibDataCompressor"><UnstructuredGrid>'
            f'<Piece NumberOfPoints="{m * corners}" NumberOfCells="{m}"><Points>{_array("Float64", "Position", pdf[["px", "py", "pz"]].to_numpy(np.float64), 3)}</Points>'
            f'<Cells>{_array("Int32", "connectivity", np.arange(m * corners, dtype=np.int32))}{_array("Int32", "offsets", np.arange(1, m + 1, dtype=np.int32) * corners)}{_array("UInt8", "types", np.full(m, kind, np.uint8))}</Cells>'
            f'<CellData Scalars="{",".join(numbers)}">{data}</CellData>{f"<PointData>{at}</PointData>" if at else ""}</Piece></UnstructuredGrid></VTKFile>'
        )
        return pd.DataFrame({"rank": [int(key[0])], "part": [int(key[1])], "xml": [xml]})

    files, spark = [], put.sparkSession
    base = path.rsplit("/", 1)[-1]
    for r in put.groupBy("rank", "part").applyInPandas(piece, "rank int, part long, xml string").toLocalIterator():
        files.append(f"{path}_{r['rank']:04d}{f'_{r['part']:04d}' if r['part'] else ''}.vtu")
        with Output(spark, files[-1]) as out:
            out.write(r["xml"].encode())
    files.sort()
    heads = "".join(f'<PDataArray type="{"Float64" if f in fields else "Int32"}" Name="{f}"/>' for f in (*numbers, *fields)) + "".join(f'<PDataArray type="Float64" Name="{f}" NumberOfComponents="3"/>' for f in vectors)
    spots = "".join(f'<PDataArray type="Float64" Name="{f}"/>' for f in point_fields)
    sources = "".join(f'<Piece Source="{base}{f[len(path):]}"/>' for f in files)
    with Output(spark, f"{path}.pvtu") as out:
        out.write(f'<?xml version="1.0"?><VTKFile type="PUnstructuredGrid" version="0.1" byte_order="LittleEndian" compressor="vtkZLibDataCompressor"><PUnstructuredGrid GhostLevel="0"><PPoints><PDataArray type="Float64" Name="Position" NumberOfComponents="3"/></PPoints><PCellData Scalars="{",".join(numbers)}">{heads}</PCellData>{f"<PPointData>{spots}</PPointData>" if spots else ""}{sources}</PUnstructuredGrid></VTKFile>'.encode())
    with Output(spark, f"{path}.visit") as out:
        out.write((f"!NBLOCKS {len(files)}\n" + "".join(f"{base}{f[len(path):]}\n" for f in files)).encode())
    return [*files, f"{path}.pvtu", f"{path}.visit"]
