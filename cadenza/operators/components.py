"""Connected components of a graph given as an edge table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which what a query has shuffled is deleted when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so no lineage is kept and lost executors do no harm. What was shuffled for it is deleted at once."""
    spark: SparkSession = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(df: DataFrame) -> None:
    """Delete the files of a table that `written` made and nothing reads any more."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """A2: (node, component) of every node with an edge; component is the smallest node reachable.

    Every node points to its smallest neighbour; edges are replaced by edges between those they
    point to, which at least halves the nodes that are left in each round, and pointers are
    followed once more until they stay. A node with very many edges is one row after aggregation.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    # The edges may be the end of a long plan, which runs once.
    given = written(both.distinct(), "links")
    label = written(given.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    links = given.filter("x <> y")
    for _ in range(rounds):
        if links.isEmpty():
            return label
        ways = links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = ways.groupBy("x").agg(F.min("y").alias("to")).select("x", F.least("x", "to").alias("to"))
        least = written(least, "pointers")
        while True:  # follow pointers to their ends
            ahead = least.select(F.col("x").alias("to"), F.col("to").alias("next"))
            new = written(least.join(ahead, "to", "left").select("x", F.coalesce("next", "to").alias("to"), F.coalesce(F.col("next") != F.col("to"), F.lit(False)).alias("moved")), "pointers")
            settled = new.filter("moved").isEmpty()
            forgotten(least)
            least = new
            if settled:
                break
        old = label, links, least
        label = written(label.join(least, label["component"] == least["x"], "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        ends = least.select(F.col("x").alias("y"), F.col("to").alias("ty"))
        links = links.join(least, "x").select("y", F.col("to").alias("tx")).join(ends, "y").select(F.col("tx").alias("x"), F.col("ty").alias("y"))
        links = written(links.filter("x <> y").distinct(), "links")
        for table in old:
            forgotten(table)
    raise RuntimeError("components did not settle")
