"""Streams of points against a static forest: counts by leaf and time window, with a watermark for late data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quadrant as Q
from ..operators.search import locate
from ..plans.lineage import shared_dir


def by_leaf(points: DataFrame, leaves: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "1 day", dim: int = 2) -> DataFrame:
    """tree, x, y[, z], level, start, n of a stream (or table) of points with a timestamp.

    The leaves are static, so the join has no state; only the open windows are kept, until the watermark passes them.
    """
    hit = locate(points.withWatermark(ts, late), leaves, dim)
    keys = ["l_tree", *[f"l_{a}" for a in Q.axes(dim)], "l_level"]
    return hit.groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*[F.col(k).alias(k[2:]) for k in keys], F.col("w.start").alias("start"), "n")


def run_once(spark: SparkSession, path: str, leaves: DataFrame, place) -> DataFrame:
    """Everything in the events' file as one finite stream, moved to tree, x, y by place, written to the shared folder and read again."""
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as the source takes single files only so
    points = place(events.withColumn("ts", F.col("ts").cast("timestamp")))
    found = by_leaf(points, leaves, late="36500 days")  # the stream is finite, so no window has to be given up

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={number}")  # by batch number, so a batch that is repeated replaces itself

    run = found.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{where}/state").foreachBatch(put).start()
    run.awaitTermination()
    keys = [c for c in found.columns if c != "n"]
    out = spark.read.schema(T.StructType([*found.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{where}/out")
    return out.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))  # the last update of a window counts
