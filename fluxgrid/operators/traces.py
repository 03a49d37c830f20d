"""Operators on traces, tables (roi, i, v) with sample index i from 0.

NaN counts as missing where a function says so: `clean` turns NaN into null
once, after which Spark's aggregates skip it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.operators import windows as W


def clean(df: DataFrame) -> DataFrame:
    """NaN values as null."""
    return df.withColumn("v", F.nanvl(F.col("v").cast("double"), F.lit(None).cast("double")))


def samples(seconds: float, ts: float) -> int:
    """Whole samples in a duration, cut off."""
    return int(seconds / ts)


def rounded_samples(seconds: float, ts: float) -> int:
    """Samples nearest to a duration, halves to even."""
    return round(seconds / ts)


def compute_dff(df: DataFrame, window: int, filter_size: int | None = None, step: int = 1, root_f: bool = False, block: int = W.BLOCK) -> DataFrame:
    """(roi, i, v, f0, dff): baseline f0 is the trailing minimum over `window` samples, of the median-filtered trace if filter_size is given.

    Traces are mirrored at their start; with step > 1 the baseline is held for step samples. dff is (v - f0) / f0, or
    / sqrt(f0) with root_f; null where f0 is 0 (or negative with root_f). Windows must be shorter than every trace.
    """
    if window < 1 or step < 1:
        raise ValueError("window and step must be positive")
    padded, of = W.mirrored(df.select("roi", "i", "v"), window), "v"
    if filter_size and filter_size > 1:
        odd, of = filter_size + (filter_size % 2 == 0), "m"
        padded = W.median_filter(padded, odd, first=-(window - 1), block=block, into=of)
    # the sample itself is carried beside its filtered value: nothing is joined back
    low = W.halo(padded, window - 1, 0, block).withColumn("f0", F.min(of).over(W.frame(window - 1, 0)))
    low = W.own(low, block).where("i >= 0").select("roi", "i", "v", "f0")
    if step > 1:
        held = low.where(F.col("i") % step == 0).select("roi", (F.col("i") / step).cast("long").alias("g"), "f0")
        low = low.select("roi", "i", "v", F.floor(F.col("i") / step).alias("g")).join(held, ["roi", "g"]).select("roi", "i", "v", "f0")
    return _relative(low, root_f)


def _relative(out: DataFrame, root_f: bool) -> DataFrame:
    """out (roi, i, v, f0) with dff."""
    under = F.when(F.col("f0") >= 0, F.sqrt(F.greatest(F.col("f0"), F.lit(0.0)))) if root_f else F.col("f0")
    return out.withColumn("dff", F.try_divide(F.col("v") - F.col("f0"), under))


def dff_filled(dff: DataFrame) -> DataFrame:
    """Missing and infinite dff as 0."""
    bad = F.col("dff").isNull() | F.isnan("dff") | (F.abs("dff") == float("inf"))
    return dff.withColumn("dff", F.when(bad, 0.0).otherwise(F.col("dff")))


def percentile_dff(df: DataFrame, window: int, percentile: float = 8.0, block: int = W.BLOCK) -> DataFrame:
    """(roi, i, v, f0, dff) with f0 a trailing percentile; the start is padded with its first sample."""
    first = df.where("i = 0").select("roi", F.col("v").alias("v"))
    head = first.withColumn("i", F.explode(F.sequence(F.lit(-(window - 1)).cast("long"), F.lit(-1).cast("long")))) if window > 1 else df.limit(0)
    padded = df.select("roi", "i", "v").unionByName(head.select("roi", "i", "v"))
    f0 = F.percentile("v", F.lit(percentile / 100)).over(W.frame(window - 1, 0))
    out = W.own(W.halo(padded, window - 1, 0, block).withColumn("f0", f0), block).where("i >= 0")
    return out.withColumn("dff", F.try_divide(F.col("v") - F.col("f0"), F.col("f0")))


def window_dff(df: DataFrame, smooth: int, window: int, tao0: float | None = None, ts: float = 1.0, block: int = W.BLOCK) -> DataFrame:
    """(roi, i, v, f0, dff): baseline is the minimum over `window` trailing samples of the centred mean over `smooth`.

    At the start of a trace the window looks ahead by what it lacks. With tao0, dff is smoothed by causal weights
    exp(-lag * ts / tao0), normalised, over the lags that carry weight above 1e-6.
    """
    before, after = W.reach(smooth, "center")
    mean = W.own(W.halo(df.select("roi", "i", "v"), before, after, block).withColumn("m", F.avg("v").over(W.frame(before, after))), block)
    low = W.own(W.halo(mean, window - 1, window - 1, block).withColumn("f0", F.min("m").over(W.frame(window - 1, 0))), block)
    start = mean.where(F.col("i") < window).groupBy("roi").agg(F.min("m").alias("start"))
    out = low.join(start, "roi").withColumn("f0", F.when(F.col("i") < window - 1, F.col("start")).otherwise(F.col("f0"))).drop("m", "start")
    out = out.withColumn("dff", F.coalesce(F.try_divide(F.col("v") - F.col("f0"), F.col("f0")), F.col("v")))
    if tao0 is None:
        return out
    lags = max(1, int(tao0 / ts * 14))
    weight = lambda lag: F.exp(-lag * ts / tao0)
    spread = out.select("roi", F.col("dff").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "i").withColumn("i", F.col("i") + F.col("lag"))
    smoothed = spread.groupBy("roi", "i").agg((F.sum(F.col("x") * weight(F.col("lag"))) / F.sum(weight(F.col("lag")))).alias("s"))
    return out.join(smoothed, ["roi", "i"]).withColumn("dff", F.col("s")).drop("s")


def resample(df: DataFrame, n: int) -> DataFrame:
    """Mean of every n samples, missing ones skipped; an incomplete tail is dropped."""
    if n < 1:
        raise ValueError("n must be positive")
    ends = W.lengths(df)
    whole = df.join(ends, "roi").where(F.col("i") < F.col("c") - F.col("c") % n)
    return whole.groupBy("roi", F.floor(F.col("i") / n).alias("i")).agg(F.avg("v").alias("v"))


def decimate(df: DataFrame, n: int) -> DataFrame:
    """Every n-th sample."""
    return df.where(F.col("i") % n == 0).withColumn("i", (F.col("i") / n).cast("long"))


def normalize(df: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Each trace rescaled to [low, high]; null where it is constant. Extremes come from an aggregation, not from a whole-trace window."""
    ends = df.groupBy("roi").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    unit = F.try_divide(F.col("v") - F.col("a"), F.col("b") - F.col("a"))
    return df.join(ends, "roi").withColumn("v", unit * (high - low) + low).drop("a", "b")


def stats(df: DataFrame) -> DataFrame:
    """Mean, population deviation, median and standard error (over all samples, missing ones too) of each trace."""
    sd = F.stddev_pop("v")
    return df.groupBy("roi").agg(F.avg("v").alias("mean"), sd.alias("std"), F.percentile("v", F.lit(0.5)).alias("median"), (sd / F.sqrt(F.count("*"))).alias("sem"))


def autocovariance(df: DataFrame, lags: int) -> DataFrame:
    """(roi, lag, acov): biased autocovariance at lags 0..lags. Each sample is sent to lags + 1 groups, never paired with a whole trace."""
    mean = df.groupBy("roi").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    d = df.join(mean, "roi").select("roi", "i", (F.col("v") - F.col("m")).alias("d"), "n")
    ahead = d.select("roi", F.col("d").alias("e"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lags).cast("long"))).alias("lag"), F.col("i").alias("j"))
    ahead = ahead.withColumn("i", F.col("j") - F.col("lag"))
    return d.join(ahead, ["roi", "i"]).groupBy("roi", "lag").agg((F.sum(F.col("d") * F.col("e")) / F.max("n")).alias("acov"))


def transients(df: DataFrame, window: int, low: float = 0.0, high: float = 2.5, width: tuple[int, int] = (1, 20), skip_last: bool = False) -> DataFrame:
    """(roi, start, stop) of events: runs above median + high * deviation of a trailing window, widened to where the trace
    falls to median + low * deviation on both sides, with a width within limits. skip_last leaves out a trace's last run."""
    spec = W.frame(window - 1, 0)
    b = W.halo(df.select("roi", "i", "v"), window - 1, 0).withColumn("med", F.percentile("v", F.lit(0.5)).over(spec)).withColumn("sd", F.stddev_samp("v").over(spec))
    b = W.own(b)
    above = F.coalesce(F.col("v") > F.col("med") + high * F.col("sd"), F.lit(False))
    below = F.coalesce(F.col("v") <= F.col("med") + low * F.col("sd"), F.lit(False))
    b = b.select("roi", "i", above.alias("ab"), below.alias("be"))
    # a sample above is never below, so a run's borders are the nearest samples below on both sides of any of its samples
    at = F.when(F.col("be"), F.col("i"))
    marked = W.filled(W.filled(b, at, "lb"), at, "nb", back=True).where("ab")
    if skip_last:
        last = b.where("ab").groupBy("roi").agg(F.max("i").alias("top"))
        low = b.join(last, "roi").where("not ab and i < top").groupBy("roi").agg(F.max("i").alias("cut"))
        marked = marked.join(low, "roi").where("i < cut")
    runs = marked.where("lb is not null and nb is not null").select("roi", (F.col("lb") + 1).alias("start"), F.col("nb").alias("stop"))
    return runs.where(F.col("stop") - F.col("start") >= width[0]).where(F.col("stop") - F.col("start") <= width[1]).distinct()


def transient_mask(df: DataFrame, events: DataFrame) -> DataFrame:
    """df with column event, 1 inside an event and 0 elsewhere."""
    inside = events.select("roi", F.explode(F.sequence("start", F.col("stop") - 1)).alias("i"), F.lit(1).alias("event")).distinct()
    return df.join(inside, ["roi", "i"], "left").withColumn("event", F.coalesce("event", F.lit(0)))


def tail_metric(df: DataFrame, mode: DataFrame) -> DataFrame:
    """(roi, tail): h is the 1st percentile of the values below the mode m, and the tail is |mean of values above m + h, less m| / |h|,
    infinite where h is 0. mode: (roi, m)."""
    j = df.join(mode, "roi")
    h = j.where("v < m").groupBy("roi").agg(F.percentile("v", F.lit(0.01)).alias("h"))
    j = j.join(h, "roi").where("v > m + h")
    over, h = F.avg("v") - F.max("m"), F.max("h")
    # Spark has no division by 0 that yields infinity (or NaN for 0 / 0); times infinity does
    return j.groupBy("roi").agg(F.abs(F.when(h == 0, over * float("inf")).otherwise(F.try_divide(over, h))).alias("tail"))


def arithmetic(df: DataFrame, expression: Column) -> DataFrame:
    """Each sample replaced by an expression of v."""
    return df.withColumn("v", expression)
