"""Correlation of traces with one another and of pixels with traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.operators import windows as W


def pairs(df: DataFrame) -> DataFrame:
    """(ra, rb, i, va, vb) of trace pairs ra < rb: an equi-join on the sample index."""
    a = df.select(F.col("roi").alias("ra"), "i", F.col("v").alias("va"))
    b = df.select(F.col("roi").alias("rb"), "i", F.col("v").alias("vb"))
    return a.join(b, "i").where("ra < rb")


def rolling_correlation(df: DataFrame, size: int, block: int = W.BLOCK) -> DataFrame:
    """(i, r): mean over all trace pairs of their correlation in a centred window; null where the window is cut or a trace is constant in it."""
    before, after = W.reach(size, "center")
    p = W.halo(pairs(df), before, after, block)
    spec = Window.partitionBy("ra", "rb", "blk").orderBy("i").rowsBetween(-before, after)
    ok = (F.stddev_pop("va").over(spec) > 0) & (F.stddev_pop("vb").over(spec) > 0)
    p = W.own(p.withColumn("r", F.when(ok, F.corr("va", "vb").over(spec))).withColumn("k", F.count("*").over(spec)), block)
    full = (F.min("k") == size) & (F.count("r") == F.count("*"))
    return p.groupBy("i").agg(F.when(full, F.avg("r")).alias("r"))


def pair_correlation(df: DataFrame) -> DataFrame:
    """(ra, rb, r) over whole traces."""
    return pairs(df).groupBy("ra", "rb").agg(F.corr("va", "vb").alias("r"))


def similar(df: DataFrame, limit: float = 0.8) -> DataFrame:
    """(a, b): trace pairs that correlate above limit."""
    return pair_correlation(df).where(F.col("r") > limit).select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def neighbourhoods(df: DataFrame, limit: float = 0.8) -> DataFrame:
    """(roi_id, comp): components of similar traces; traces similar to none are left out."""
    from fluxgrid.operators.graph import components

    return components(similar(df, limit)).select(F.col("node").alias("roi_id"), F.col("root").alias("comp"))


def pixel_correlation(px: DataFrame, traces: DataFrame, ref_scaling: bool = False) -> DataFrame:
    """(roi, y, x, r): correlation of every pixel with every trace; with ref_scaling times sqrt(n / (n - 1))."""
    j = px.select(F.col("frame_idx").alias("i"), "y", "x", F.col("v").alias("p")).join(traces.select("roi", "i", "v"), "i")
    r = F.corr("p", "v")
    if ref_scaling:
        n = F.count("*")
        r = r * F.sqrt(n / (n - 1))
    return j.groupBy("roi", "y", "x").agg(r.alias("r"))
