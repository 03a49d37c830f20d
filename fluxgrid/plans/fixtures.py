"""Views over the test tables that stand for recordings: traces, frames, regions, files, events, shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

H = WIDTH = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trace_events(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("roi"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("value").alias("v"))


def trace_aligned(spark: SparkSession, sf: str) -> DataFrame:
    t = trace_events(spark, sf)
    n = t.groupBy("roi").agg(F.count("*").alias("n")).agg(F.min("n").alias("n"))
    return t.join(n, F.col("i") < F.col("n")).drop("n")


def trace_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    w = Window.partitionBy("roi").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.withColumn("roi", F.col("l_suppkey") % 8).select("roi", (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("l_extendedprice").alias("v"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("frame_idx"), F.floor(F.col("vec_id") / 100).cast("int").alias("file_idx"), F.lit(H).alias("h"), F.lit(WIDTH).alias("w"), F.col("embedding").alias("px"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    from fluxgrid.operators import movie

    return movie.pixels(frames(spark, sf))


def files(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).groupBy("file_idx").agg(F.concat(F.lit("rec_"), F.lpad(F.col("file_idx").cast("string"), 4, "0"), F.lit(".tif")).alias("name"), F.count("*").cast("int").alias("n"), F.max("h").alias("y"), F.max("w").alias("x"), F.lit(0.1).alias("Ts"))


def roi_pixels(spark: SparkSession) -> DataFrame:
    inside = "CASE roi_id WHEN 0 THEN y < 4 AND x < 4 WHEN 1 THEN y >= 4 AND x >= 4 WHEN 2 THEN y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 ELSE y BETWEEN 2 AND 3 AND x BETWEEN 2 AND 3 END"
    cells = spark.range(4 * 64).selectExpr("CAST(0 AS INT) AS roi_set", "CAST(id DIV 64 AS INT) AS roi_id", "CAST(id % 64 DIV 8 AS INT) AS y", "CAST(id % 8 AS INT) AS x")
    return cells.where(inside)


def slices(spark: SparkSession, n: int = 5, every: int = 40, length: int = 20) -> DataFrame:
    return spark.range(n).selectExpr("CAST(id AS INT) AS slice_id", f"id * {every} + 10 AS start", f"id * {every} + {10 + length} AS stop")


def motion(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("frame_idx") % 5 - 2, F.col("frame_idx") % 3 - 1
    return frames(spark, sf).select("frame_idx", F.col("file_idx").alias("chunk"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(1.0).alias("metric"), x.cast("double").alias("x_local"), y.cast("double").alias("y_local"))


def events_i2c(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").crossJoin(files(spark, sf).agg(F.count("*").alias("n_files")))  # one row: every event falls into a file
    return e.select("event_id", F.col("value").alias("si_timestamp"), (F.floor(F.col("event_id") / 10) + (F.col("event_id") % 10) / 10).alias("data"), (F.col("event_id") % 100).alias("frame_idx"), (F.floor(F.col("event_id") / 100) % F.col("n_files")).cast("int").alias("file_idx"))


SQL = {
    "trace_events": "SELECT event_type AS roi, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, value AS v FROM events",
    "trace_lineitem": "SELECT l_suppkey % 8 AS roi, row_number() OVER (PARTITION BY l_suppkey % 8 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_extendedprice AS v FROM lineitem",
    "aligned": "SELECT * FROM s WHERE i < (SELECT min(n) FROM (SELECT count(*) AS n FROM s GROUP BY roi))",
    "pixels": "SELECT vec_id AS frame_idx, (p - 1) // 8 AS y, (p - 1) % 8 AS x, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, generate_series(1, 64) AS g(p)",
    "files": "SELECT vec_id // 100 AS file_idx, count(*) AS n FROM embeddings GROUP BY 1",
    "roi_pixels": "SELECT r AS roi_id, c // 8 AS y, c % 8 AS x FROM range(4) a(r), range(64) b(c) WHERE CASE r WHEN 0 THEN c // 8 < 4 AND c % 8 < 4 WHEN 1 THEN c // 8 >= 4 AND c % 8 >= 4 WHEN 2 THEN c // 8 BETWEEN 2 AND 5 AND c % 8 BETWEEN 2 AND 5 ELSE c // 8 BETWEEN 2 AND 3 AND c % 8 BETWEEN 2 AND 3 END",
    "slices": "SELECT k AS slice_id, k * 40 + 10 AS start, k * 40 + 30 AS stop FROM range(5) a(k)",
    "motion": "SELECT vec_id AS frame_idx, CAST(vec_id % 5 - 2 AS DOUBLE) AS x, CAST(vec_id % 3 - 1 AS DOUBLE) AS y FROM embeddings",
    "events_i2c": "SELECT event_id, event_id // 10 + (event_id % 10) / 10.0 AS data, event_id % 100 AS frame_idx, (event_id // 100) % (SELECT count(DISTINCT vec_id // 100) FROM embeddings) AS file_idx FROM events",
}
