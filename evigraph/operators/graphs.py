"""Iterative operators over edge tables: components, longest-path depth, simple paths.

Each round is stored in the folder that the cluster shares, so plans don't grow with the number of rounds.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    folder = tempfile.mkdtemp(prefix="evigraph-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` as read back from the shared folder; removed when the application ends."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(frame.schema).parquet(path)


def numbered(frame: DataFrame, *order: Column) -> DataFrame:
    """``frame`` with ``index`` from 0 in an order, without bringing its rows to one task: ranges are numbered by themselves,
    and begin where the ranges before them end."""
    ranged = stored(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("_part", "_first", "_start")
    return ranged.join(F.broadcast(starts), "_part").withColumn("index", F.col("_start") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_start")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) for every row of ``nodes`` (node): the least node connected by ``links`` (a, b).

    Every round takes the least label of all neighbours and then the label of that label.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    own = stored(nodes.select("node").distinct())
    labels = own.select("node", F.col("node").alias("component"))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component")
        least = labels.union(seen).groupBy("node").agg(F.min("component").alias("component"))
        jump = least.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = stored(least.join(jump, "component").select("node", F.least("component", "further").alias("component")))
        changed = moved.join(labels.withColumnRenamed("component", "before"), "node").where("component <> before")
        if changed.isEmpty():
            return moved
        labels = moved


def depth(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth): the longest path to each node of an acyclic graph of edges (a, b), in at most ``most`` rounds.

    By default as many rounds as there are nodes, which any acyclic graph does with.
    """
    edges = stored(edges.select("a", "b").distinct())
    depths = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("depth", F.lit(0)))
    for _ in range(depths.count() if most is None else most):
        deeper = edges.join(depths.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), (F.col("depth") + 1).alias("depth"))
        moved = stored(depths.union(deeper).groupBy("node").agg(F.max("depth").alias("depth")))
        if moved.join(depths.withColumnRenamed("depth", "before"), "node").where("depth <> before").isEmpty():
            return moved
        depths = moved
    raise ValueError("the graph has a cycle or is deeper than allowed")


def simple_paths(edges: DataFrame, most: int) -> DataFrame:
    """(path): all paths of edges (a, b) from a source to a sink without repeats, of at most ``most`` edges."""
    edges = stored(edges.select("a", "b").where("a <> b").distinct())
    starts = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti")
    ends = edges.select(F.col("b").alias("last")).distinct().join(edges.select(F.col("a").alias("last")), "last", "left_anti")
    growing = starts.select(F.array("a").alias("path"), F.col("a").alias("last"))
    found = None
    for number in range(1, most + 1):
        if number == most:  # what doesn't end now is too long
            edges = edges.join(ends.withColumnRenamed("last", "b"), "b", "left_semi")
        growing = stored(growing.join(edges.withColumnRenamed("a", "last"), "last").where(~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("last")))
        done = growing.join(ends, "last", "left_semi").select("path")
        found = done if found is None else found.union(done)
        if growing.isEmpty():
            break
    return found
