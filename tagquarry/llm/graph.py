"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints, as it is named; one of our own only where none is and all runs on this machine, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = f"file://{tempfile.mkdtemp(prefix='tagquarry-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there, so that a lost executor doesn't bring its work back."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: a long, b long. Returns id, root: the least id of its component, for every id on an edge, once.

    Edges to oneself, repeated edges and edges with a null count for nothing. Rounds grow with the
    logarithm of a component's diameter; RuntimeError if max_rounds aren't enough.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.repartition("u")
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(lowest.hint("merge"), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            ids = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
            return ids.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")
