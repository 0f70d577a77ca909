"""Forest checksums that are known for whole pipelines: refine, coarsen, balance. Fixed values."""

import os

import pytest
from pyspark.sql import functions as F

from sparkgrove.functions import quadrant as Q
from sparkgrove.operators.forest import Forest
from sparkgrove.sources import topology as T

V = [
    ("unitsquare", 2, (94, 70, 148), 0xEF45243B),
    ("rotwrap", 2, (94, 70, 160), 0x266D2739),
    ("corner", 2, (666, 498, 1302), 0x9DAD92CC),
    ("moebius", 2, (950, 710, 1790), 0xBBC10F7F),
    ("star", 2, (1332, 996, 2595), 0xFB28233F),
    ("unitcube", 3, (281, 218, 407), 0x2574801F),
    ("periodic", 3, None, 0xDC7E8A93),
    ("rotwrap", 3, (281, 218, 540), 0xA675888D),
    ("twocubes", 3, (1129, 877, 2228), 0x7188978A),
    ("twowrap", 3, (1129, 877, 2263), 0x8E3F994C),
    ("rotcubes", 3, (7356, 5718, 16449), 0xC0E1B235),
    ("shell", 3, (29424, 22872, 75687), 0x558723A2),
    ("brick234", 3, None, 0x82174E14),
]
N = [
    ("corner", 7, (5439, 6009), 0xA8D85863),
    ("moebius", 6, (2717, 3203), 0x98AB6CB2),
    ("star", 6, (2796, 3288), 0x38D3736F),
    ("rotwrap", 6, (1045, 1276), 0x9DD600C5),
    ("bowtie", 3, (41, 41), 0x63BA0805),
]
#: The two largest only with GROVE_ALL=1.
if not os.environ.get("GROVE_ALL"):
    V = [v for v in V if v[0] not in ("rotcubes", "shell")]


@pytest.mark.parametrize("name,dim,counts,golden", V)
def test_refine_coarsen_balance(spark, name, dim, counts, golden):
    top = T.brick((2, 3, 4), (False, False, True)) if name == "brick234" else T.by_name(name, dim)
    deep, ids = (5, (0, 3)) if dim == 2 else (4, (0, 3, 6))

    def split(df):
        return (F.col("level") < deep + F.col("tree") % 3) & ((F.col("level") == 0) | Q.child_id(Q.cell(dim)).isin(*ids))

    a = Forest.uniform(spark, top).refine(split, recursive=True)
    b = a.coarsen(lambda df: (F.col("level") >= 2) & (Q.child_id(Q.cell(dim)) == 3), recursive=True)
    c = b.balance("corner")
    if counts:
        assert (a.leaves.count(), b.leaves.count(), c.leaves.count()) == counts
    assert c.checksum() == golden


@pytest.mark.parametrize("name,deep,counts,golden", N)
def test_pattern_balance(spark, name, deep, counts, golden):
    last, quarter = Q.ROOT - (Q.ROOT >> 2), Q.ROOT >> 2

    def split(df):
        level, x, y = F.col("level"), F.col("x"), F.col("y")
        return F.when(level >= deep - F.col("tree") % 3, False).when((level == 1) & (Q.child_id(Q.cell(2)) == 3), True).when((x == last) & (y == last), True).otherwise(x < quarter)

    a = Forest.uniform(spark, T.by_name(name)).refine(split, recursive=True)
    b = a.balance("corner")
    assert (a.leaves.count(), b.leaves.count()) == counts
    assert b.checksum() == golden
