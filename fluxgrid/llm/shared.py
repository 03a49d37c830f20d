"""Helpers of the corpus operators: written intermediates, text batches, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; bounds the numpy buffers.
CHUNK_BYTES = 1 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only in a local session where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "fluxgrid-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once under the shared checkpoint folder and read it back: lineage ends there."""
    path = f"{checkpoint_root(df.sparkSession)}/fluxgrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_intermediates(spark: SparkSession) -> None:
    """Removes what `materialise` and the writers of this subpackage have left; for use when no result that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/fluxgrid")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `limit` bytes (one longer text stands alone), as UTF-8, null as empty, with the first one's row."""
    lo, size, out = 0, 0, []
    for i, t in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        t = t or b""
        if out and size + len(t) > limit:
            yield lo, out
            lo, size, out = i, 0, []
        out.append(t)
        size += len(t) + 1
    if out:
        yield lo, out


def components(edges: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """(node, root) of every node that an edge names; root is the least node of its component.

    Alternating large-star and small-star steps; each is an aggregation and a
    join, so no task or driver holds a component. Raises if `most` rounds do not settle it.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialise(small.where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == last:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        last = now
    raise RuntimeError("components did not settle")
