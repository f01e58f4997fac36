"""Connected components of links as DataFrame joins, and shared-folder checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  A temporary one serves only a local session, whose executor is the driver."""
    where = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="mensura-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder.

    A table has the size that it has.  Spark's own checkpoint keeps the size that was estimated for the plan, which a loop of joins
    squares with each round, until planning alone takes minutes.
    """
    path = f"{shared_folder(df.sparkSession)}/mensura-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the table of a checkpoint that nothing needs any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._table)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) with the smallest node of each component, by large-star and small-star steps (Kiveris et al. 2014).

    The number of edges never grows, so a node with many links costs no more in later rounds.
    """
    edges, before = checkpoint(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = star.groupBy("u").agg(F.min("v").alias("m"))
        old, edges = edges, checkpoint(star.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        drop(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            labels = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
            return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
