"""Sliding windows over traces (roi, i, v), in blocks with halos.

A window partitioned by roi alone puts a whole trace into one task. `halo`
deals a trace into blocks of `block` samples and copies the samples that
windows reach across a border, so a long trace uses many tasks and the result
is that of the plain window.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 1 << 16


def halo(df: DataFrame, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """df with column blk; rows also appear in other blocks whose windows reach them."""
    lo, hi = F.floor((F.col("i") - after) / block), F.floor((F.col("i") + before) / block)
    return df.withColumn("blk", F.explode(F.sequence(lo, hi)))


def own(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Drops the halo rows again."""
    return df.where(F.col("blk") == F.floor(F.col("i") / block)).drop("blk")


def frame(before: int, after: int) -> WindowSpec:
    return Window.partitionBy("roi", "blk").orderBy("i").rowsBetween(-before, after)


def reach(size: int, pos: str) -> tuple[int, int]:
    """Samples before and after the current one in a window of `size`; pos is where padding goes: right (trailing), left or center."""
    if size < 1:
        raise ValueError("window size must be positive")
    if pos == "right":
        return size - 1, 0
    if pos == "left":
        return 0, size - 1
    if pos == "center":
        return ceil((size - 1) / 2), floor((size - 1) / 2)
    raise ValueError("pos must be 'right', 'left' or 'center'")


def sliding(df: DataFrame, agg: Column, name: str, size: int, step: int = 1, pos: str = "right", full: bool = True, block: int = BLOCK) -> DataFrame:
    """df with agg over a sliding window; with full, null where the window reaches beyond the trace; step keeps every step-th window."""
    before, after = reach(size, pos)
    spec = frame(before, after)
    out = halo(df, before, after, block).withColumn(name, agg.over(spec))
    if full:
        out = out.withColumn(name, F.when(F.count("*").over(spec) == size, F.col(name)))
    out = own(out, block)
    return out if step == 1 else out.where(F.pmod(F.col("i") - before, F.lit(step)) == 0)


def filled(df: DataFrame, value: Column, name: str, by: list[str] = ["roi"], order: str = "i", back: bool = False, block: int = BLOCK, blk: Column | None = None) -> DataFrame:  # noqa: B006
    """df with `name`: the last value that is not null before each row (with back: the next one after it) in order of `order`.

    A block is scanned on its own; the values that blocks hand on come from a scan of one row a block, so no task holds a
    whole trace. blk: the block of each row, by default `block` samples of `order`; blocks must be in the order of their rows.
    """
    df = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / block) if blk is None else blk)
    inner = Window.partitionBy(*by, "_b").orderBy(F.desc(order) if back else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy(F.desc("_b") if back else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min_by if back else F.max_by
    held = df.groupBy(*by, "_b").agg(pick("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_h"))
    held = held.withColumn("_h", F.last("_h", True).over(outer)).where("_h is not null")
    held = held.select(*[F.col(c).alias("_k" + c) for c in by], F.col("_b").alias("_kb"), "_h")
    same = F.col("_b") == F.col("_kb")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col("_k" + c))
    out = df.withColumn("_l", F.last("_v", True).over(inner)).join(held, same, "left")
    return out.withColumn(name, F.coalesce("_l", "_h")).drop("_v", "_b", "_l", "_h", "_kb", *["_k" + c for c in by])


def lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("roi").agg((F.max("i") + 1).alias("c"))


def mirrored(df: DataFrame, size: int) -> DataFrame:
    """df with size - 1 samples before each trace, mirrored without repeating the edge."""
    head = df.where(F.col("i").between(1, size - 1)).withColumn("i", -F.col("i"))
    return df.unionByName(head)


def edge_repeated(df: DataFrame, first: int, half: int) -> DataFrame:
    """df, whose traces begin at sample `first`, with `half` samples on both sides, mirrored with the edge repeated."""
    left = df.where(F.col("i").between(first, first + half - 1)).withColumn("i", 2 * first - 1 - F.col("i"))
    right = df.join(lengths(df), "roi").where(F.col("i") >= F.col("c") - half)
    right = right.withColumn("i", 2 * F.col("c") - 1 - F.col("i")).drop("c")
    return df.unionByName(left).unionByName(right)


def median_filter(df: DataFrame, size: int, first: int = 0, block: int = BLOCK, into: str = "v") -> DataFrame:
    """Centred running median of odd size, in column `into`; edges mirrored with the edge sample repeated."""
    half = size // 2
    padded = edge_repeated(df.select("roi", "i", "v"), first, half)
    spec = frame(half, half)  # only a mirrored end lacks neighbours, so full windows are the trace's own samples
    out = halo(padded, half, half, block).withColumn("k", F.count("*").over(spec))
    out = own(out.withColumn(into, median("v", size, spec)), block)
    return out.where((F.col("i") >= first) & (F.col("k") == size)).drop("k")


def median(column: str, size: int, spec: WindowSpec) -> Column:
    """Median of a full window of odd size: the middle of its sorted values, missing ones last as in `percentile` of few samples."""
    values = F.array_sort(F.collect_list(column).over(spec))
    return F.when(F.size(values) == size, F.element_at(values, size // 2 + 1)).otherwise(F.percentile(column, F.lit(0.5)).over(spec))


def causal_median_filter(df: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """Trailing running median; the first size - 1 samples stay raw. size is odd."""
    if size % 2 == 0:
        raise ValueError("size must be odd")
    med = F.percentile("v", F.lit(0.5)).over(frame(size - 1, 0))
    return own(halo(df, size - 1, 0, block).withColumn("f", F.when(F.col("i") < size - 1, F.col("v")).otherwise(med)), block)
