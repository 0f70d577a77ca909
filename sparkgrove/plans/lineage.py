"""Lineage cuts in the shared folder, and exact global ranks without a single-task window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset, a temporary one in local mode and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="sparkgrove-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again; the files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/grove-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, keys: list, name: str = "gid", weight: str | None = None) -> DataFrame:
    """df with the exact 0-based rank of each row in the order of keys, and on demand `<name>_weight`: the inclusive prefix sum.

    Range partitions are sorted on their own; one offset per partition (a driver-side list as long as the number of
    partitions) makes local ranks global. Only the prefix sum inside a partition needs a window, and it is keyed by partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__mid", F.monotonically_increasing_id())
    local = cut(local).withColumn("__pid", F.shiftright("__mid", 33)).withColumn("__idx", F.col("__mid").bitwiseAND((1 << 33) - 1))
    sums = [F.count(F.lit(1)).alias("n")] + ([F.sum(weight).alias("w")] if weight else [])
    rows = sorted(local.groupBy("__pid").agg(*sums).collect(), key=lambda r: r["__pid"])
    offsets, at, heavy = [], 0, 0
    for r in rows:
        offsets.append((r["__pid"], at, heavy))
        at += r["n"]
        heavy += (r["w"] or 0) if weight else 0
    table = spark.createDataFrame(offsets, f"__pid long, __off long, __woff {'double' if any(isinstance(o[2], float) for o in offsets) else 'long'}")
    out = local.join(F.broadcast(table), "__pid").withColumn(name, F.col("__off") + F.col("__idx"))
    if weight:
        from pyspark.sql import Window

        inside = F.sum(weight).over(Window.partitionBy("__pid").orderBy("__idx").rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(f"{name}_weight", F.col("__woff") + inside)
    return out.drop("__pid", "__mid", "__idx", "__off", "__woff")


def filled(df: DataFrame, keys: list, column: str, name: str, forward: bool = True) -> DataFrame:
    """df with `name`: the last non-null `column` at or before each row in the order of keys (forward=False: first at or after).

    The basis of as-of joins. Range partitions are filled on their own; the value that reaches into a partition comes from a
    driver-side list with one entry per partition. Rows of equal keys share a partition, but their order is open: make keys unique.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__mid", F.monotonically_increasing_id())).withColumn("__pid", F.shiftright("__mid", 33))
    end = F.max_by(column, "__mid") if forward else F.min_by(column, "__mid")
    ends = {r["__pid"]: r["v"] for r in local.where(F.col(column).isNotNull()).groupBy("__pid").agg(end.alias("v")).collect()}
    pids = sorted(r[0] for r in local.select("__pid").distinct().collect())
    rows, reach = [], None
    for p in pids if forward else pids[::-1]:
        rows.append((p, reach))
        reach = ends.get(p, reach)
    from pyspark.sql import types as T

    table = spark.createDataFrame(rows, T.StructType([T.StructField("__pid", T.LongType()), T.StructField("__in", df.schema[column].dataType)]))
    # backward: forward in the reverse order, as a frame that shrinks to the end is read again for each of its rows
    w = Window.partitionBy("__pid").orderBy("__mid" if forward else F.desc("__mid"))
    near = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return local.join(F.broadcast(table), "__pid").withColumn(name, F.coalesce(near, "__in")).drop("__pid", "__mid", "__in")
