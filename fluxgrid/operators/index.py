"""Indexing: slices, nearest times, files and frames, stimulus events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.operators import windows as W

#: Time ranges that an irregular search is dealt into.
RANGES = 256


def take(df: DataFrame, slices: DataFrame, index: str = "i") -> DataFrame:
    """Rows of each slice (slice_id, start, stop), with rel counted from its start.

    Slices are exploded to their indexes, so that the join is an equi-join on the index and no range join.
    """
    at = slices.select("slice_id", "start", F.explode(F.sequence("start", F.col("stop") - 1)).alias(index))
    return df.join(at, index).withColumn("rel", F.col(index) - F.col("start")).drop("start")


def align(df: DataFrame, slices: DataFrame) -> DataFrame:
    """(slice_id, roi, rel, v) of full length: null where a slice leaves the trace."""
    grid = slices.select("slice_id", "start", F.explode(F.sequence("start", F.col("stop") - 1)).alias("i")).withColumn("rel", F.col("i") - F.col("start"))
    grid = grid.join(df.select("roi").distinct().withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one")).drop("_one")
    return grid.join(df.select("roi", "i", "v"), ["roi", "i"], "left").select("slice_id", "roi", "rel", "v")


def event_average(df: DataFrame, slices: DataFrame, by: list[str]) -> DataFrame:
    """Mean over slices at each relative index. Slices must have one length."""
    return take(df, slices, "i" if "i" in df.columns else "frame_idx").groupBy(*by, "rel").agg(F.avg("v").alias("v"))


def nearest(times: DataFrame, queries: DataFrame, ts: float = 1.0, t0: float = 0.0) -> DataFrame:
    """(t, i): index of each trace sample nearest to t; ties to the lower index. times: one row (n) with the number of samples.

    The sampling is uniform, so the index is arithmetic; nothing is searched.
    """
    n = times.select("n")
    guess = F.ceil((F.col("t") - t0) / ts - 0.5)
    return queries.join(n, F.lit(True)).select("t", F.greatest(F.lit(0), F.least(guess, F.col("n") - 1)).cast("long").alias("i"))


def nearest_irregular(samples: DataFrame, queries: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(t, i) for samples (i, t) at any times, ties to the lower index.

    Samples and queries are dealt into time ranges of about equal size; in each the neighbours before and after are found
    by one sort of both, and a range whose edge has none takes the last sample of the ranges before, or the first after.
    """
    cuts = sorted(set(samples.approxQuantile("t", [k / ranges for k in range(1, ranges)], 1 / (2 * ranges)))) if ranges > 1 else []
    both = samples.select("t", "i").withColumn("q", F.lit(0)).unionByName(queries.select("t").withColumn("i", F.lit(None).cast("long")).withColumn("q", F.lit(1)))
    at = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    blk = F.size(F.filter(at, lambda c: c <= F.col("t")))
    near = F.when(F.col("q") == 0, F.struct("t", "i"))
    # queries come after the samples of their time, and before them in the other direction; of one time the lowest index stays
    both = both.groupBy("t", "q").agg(F.min("i").alias("i"), F.count("*").alias("n")).withColumn("one", F.lit(1))
    found = W.filled(both.withColumn("o", F.struct("t", "q")), near, "a", ["one"], "o", blk=blk)
    found = W.filled(found.withColumn("o", F.struct("t", (-F.col("q")).alias("q"))), near, "b", ["one"], "o", back=True, blk=blk).where("q = 1")
    before, after = F.abs(F.col("t") - F.col("a.t")), F.abs(F.col("b.t") - F.col("t"))
    first = F.col("b").isNull() | (before < after) | ((before == after) & (F.col("a.i") < F.col("b.i")))
    found = found.withColumn("r", F.when(F.col("a").isNotNull() & first, F.col("a.i")).otherwise(F.col("b.i")))
    return found.select("t", F.col("r").alias("i"), F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("t", "i")


def offsets(files: DataFrame) -> DataFrame:
    """files (file_idx, n, ...) with off, the first global frame of each; one row a file."""
    w = Window.orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("off", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def frame_to_file(frames: DataFrame, files: DataFrame) -> DataFrame:
    """(frame_idx, file_idx, local) of global frames.

    Frames and files meet in bins as wide as the longest file, an equi-join: a file lies in at most two bins.
    """
    width = files.agg(F.greatest(F.lit(1), F.max("n")).cast("long").alias("width"))  # one row
    o = offsets(files).where("n > 0").select("file_idx", "off", "n").join(width, F.lit(True))
    o = o.withColumn("bin", F.explode(F.sequence(F.floor(F.col("off") / F.col("width")), F.floor((F.col("off") + F.col("n") - 1) / F.col("width"))))).drop("width")
    f = frames.select("frame_idx").join(width, F.lit(True)).withColumn("bin", F.floor(F.col("frame_idx") / F.col("width"))).drop("width")
    both = f.join(o, "bin").where("frame_idx >= off and frame_idx < off + n")
    return both.select("frame_idx", "file_idx", (F.col("frame_idx") - F.col("off")).alias("local"))


def file_to_frame(local: DataFrame, files: DataFrame) -> DataFrame:
    """Global frame of (file_idx, local)."""
    return local.join(offsets(files).select("file_idx", "off"), "file_idx").select("file_idx", "local", (F.col("off") + F.col("local")).alias("frame_idx"))


def enrich_events(events: DataFrame, files: DataFrame) -> DataFrame:
    """events (frame_idx, file_idx, data, ...) with abs_frame_idx, trial and phase: data = trial + phase / 10."""
    o = offsets(files).select("file_idx", "off")
    trial = F.col("data").cast("int")
    phase = F.bround(F.col("data") - trial, 1) * 10
    return events.join(o, "file_idx").withColumn("abs_frame_idx", F.col("off") + F.col("frame_idx")).withColumn("trial", trial).withColumn("phase", phase.cast("int")).drop("off")


def pulses(df: DataFrame, base: int, gap: int, least: int = 1, block: int = W.BLOCK) -> DataFrame:
    """(roi, start, stop) of stimulus pulses: above 4 times the mean of the first `base` samples; a pulse ends after more than `gap` low samples."""
    level = df.where(F.col("i") < base).groupBy("roi").agg((4 * F.avg("v")).alias("thr"))
    high = df.join(level, "roi").where("v > thr").select("roi", "i")
    high = W.filled(high, F.col("i"), "before", block=block)
    new = F.col("before").isNull() | (F.col("i") - F.col("before") > gap + 1)
    runs = W.filled(high.withColumn("new", new), F.when(F.col("new"), F.col("i")), "open", block=block)
    runs = runs.withColumn("start", F.when(F.col("new"), F.col("i")).otherwise(F.col("open")))
    out = runs.groupBy("roi", "start").agg((F.max("i") + 1).alias("stop"))
    return out.where(F.col("stop") - F.col("start") >= least)


def uniform_pulses(p: DataFrame, digits: int) -> DataFrame:
    """Pulses with rounded duration (halves to even) and stop computed anew."""
    return p.withColumn("stop", F.col("start") + F.bround((F.col("stop") - F.col("start")).cast("double"), digits).cast("long"))


def stimulus_dff(df: DataFrame, slices: DataFrame, base: int) -> DataFrame:
    """(slice_id, roi, rel, dff): each slice against the mean of its first `base` samples."""
    cut = take(df, slices)
    mean = cut.where(F.col("rel") < base).groupBy("slice_id", "roi").agg(F.avg("v").alias("b"))
    return cut.join(mean, ["slice_id", "roi"]).select("slice_id", "roi", "rel", F.try_divide(F.col("v") - F.col("b"), F.col("b")).alias("dff"))


def split_channels(frames: DataFrame, n: int) -> DataFrame:
    """frames with channel and its own frame index: page k belongs to channel k mod n."""
    return frames.withColumn("channel", F.col("frame_idx") % n).withColumn("frame_idx", F.floor(F.col("frame_idx") / n))


def sampling_period(times: DataFrame) -> DataFrame:
    """(Ts, irregular) of samples (i, t): mean step, and whether the steps' deviation exceeds their mean. Neighbours meet by an equi-join on i."""
    after = times.select((F.col("i") - 1).alias("i"), F.col("t").alias("next"))
    step = times.select("i", "t").join(after, "i").select((F.col("next") - F.col("t")).alias("d"))
    return step.agg(F.avg("d").alias("Ts"), (F.try_divide(F.stddev_pop("d"), F.avg("d")) > 1).alias("irregular"))
