"""Shared helpers: lineage cuts in the cluster's shared folder, table access, word patterns."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import ranked

#: White space of the word contract: space and U+0009..U+000D. Everything else is part of a word.
WS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a temporary one in local mode, which has no other machines; on a cluster an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="sparkgrove-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lineage cut that survives lost executors.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that cut() returned, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    roots = {f.rsplit("/part-", 1)[0] for f in df.inputFiles()}
    for root in roots:
        if "/cut-" in root:
            where = jvm.org.apache.hadoop.fs.Path(root)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names, from the wanted ones, that df does not have yet."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def words(text) -> F.Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a string column; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+"), lambda w: w != "")


def row_keys(docs: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """docs with a unique long key: doc_id where one row alone has it, else a number that no doc_id is.

    Rows without a doc_id get numbers below all doc_ids, rows that share one get numbers above. Both are numbered in the order of doc_id
    and text, so the keys are the same at each run but for rows that agree in both.
    """
    shared = cut(docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key))
    lone = docs.where(F.col(key).isNotNull())
    none, several = docs.where(F.col(key).isNull()), not shared.isEmpty()
    missing = not none.isEmpty()
    if not several and not missing:
        return docs.withColumn(name, F.col(key).cast("long"))
    ends = docs.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    if low < -(1 << 62) or high > 1 << 62:
        raise ValueError("doc_ids beyond 2**62 leave no room for keys of rows without one")
    order = [F.col(key), F.sha2(F.coalesce("text", F.lit("")), 256)]
    parts = [(lone.join(shared, key, "left_anti") if several else lone).withColumn(name, F.col(key).cast("long"))]
    if missing:
        parts.append(ranked(none, order, name).withColumn(name, F.lit(low - 1) - F.col(name)))
    if several:
        parts.append(ranked(docs.join(shared, key, "left_semi"), order, name).withColumn(name, F.lit(high + 1) + F.col(name)))
    return cut(functools.reduce(DataFrame.unionByName, parts))
