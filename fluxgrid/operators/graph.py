"""Connected components of an edge table."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only in a local session without."""
    if not spark.sparkContext.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(root or os.path.join(tempfile.gettempdir(), "fluxgrid-checkpoints"))
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, root) of every node named in edges (a, b); root is the least node of its component.

    Labels spread over edges and jump to their label's label, so rounds grow with the logarithm of the diameter.
    """
    checkpoint_folder(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    for _ in range(most):
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("r"))
        new = label.join(near, "node").select("node", F.least("root", "r").alias("root"))
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = new.join(jump, "root").select("node", F.least("root", "up").alias("root")).checkpoint()
        if new.join(label.withColumnRenamed("root", "old"), "node").where("root <> old").isEmpty():
            return new
        label = new
    raise RuntimeError("components did not settle")
