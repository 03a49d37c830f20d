"""Operators on movies: frames (frame_idx, h, w, px) with row-major px, or pixels (frame_idx, y, x, v).

The long form is for anything Catalyst should optimise; the block functions
work on Arrow batches of whole frames and send one partial row a batch, for
frames whose pixels are too many to be rows. Both give the same numbers up to
the order of summation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes of masks that extract_blocks sends to each task at most.
MASK_BYTES = 64 << 20


def pixels(frames: DataFrame) -> DataFrame:
    """(frame_idx, y, x, v), NaN as null."""
    rows = frames.select("frame_idx", "w", F.posexplode("px").alias("pos", "v"))
    v = F.nanvl(F.col("v").cast("double"), F.lit(None).cast("double"))
    return rows.select("frame_idx", F.floor(F.col("pos") / F.col("w")).cast("int").alias("y"), (F.col("pos") % F.col("w")).cast("int").alias("x"), v.alias("v"))


def project(px: DataFrame, by: list[str], agg: Column) -> DataFrame:
    """An aggregate over all axes but `by` ("frame_idx", "y", "x")."""
    return px.groupBy(*by).agg(agg.alias("v"))


def standard_deviation(px: DataFrame, by: list[str]) -> DataFrame:
    """Sample deviation (n - 1) over time."""
    return project(px, by, F.stddev_samp("v"))


def project_blocks(frames: DataFrame) -> DataFrame:
    """(y, x, v): mean over time by per-batch sums of whole frames."""
    schema = pa.schema([("pos", pa.int64()), ("w", pa.int32()), ("s", pa.float64()), ("n", pa.int64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                px = b.column(1)
                m = px.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                n = np.count_nonzero(~np.isnan(m), 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.shape[1])), pa.array(np.full(m.shape[1], b.column(0)[0].as_py(), np.int32)), pa.array(np.nansum(m, 0)), pa.array(n)], schema=schema)

    part = frames.select("w", "px").mapInArrow(sums, "pos long, w int, s double, n long")
    out = part.groupBy("pos", "w").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("v"))
    return out.select(F.floor(F.col("pos") / F.col("w")).cast("int").alias("y"), (F.col("pos") % F.col("w")).cast("int").alias("x"), "v")


def extract(px: DataFrame, roi: DataFrame) -> DataFrame:
    """(roi, i, v): mean of each region's pixels in each frame, null if one of them is missing."""
    joined = px.join(roi.select("roi_id", "y", "x"), ["y", "x"])
    mean = F.when(F.count("v") == F.count("*"), F.avg("v"))
    return joined.groupBy(F.col("roi_id").alias("roi"), F.col("frame_idx").alias("i")).agg(mean.alias("v"))


def extract_blocks(frames: DataFrame, masks: dict[int, np.ndarray]) -> DataFrame:
    """As `extract`, by one product of masks and frames a batch. masks: boolean images by region; a few, given by the caller."""
    if sum(m.size for m in masks.values()) * 8 > MASK_BYTES:
        raise ValueError("masks are sent to every task: use extract for so many")
    names = sorted(masks)
    weight = np.stack([masks[k].ravel() / max(1, masks[k].sum()) for k in names], 1) if names else np.zeros((0, 0))
    schema = pa.schema([("roi", pa.int32()), ("i", pa.int64()), ("v", pa.float64())])

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and names:
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                out = m @ weight
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.array(names, np.int32), len(m))), pa.array(np.repeat(b.column(0).to_numpy(), len(names))), pa.array(out.ravel())], schema=schema)

    return frames.select("frame_idx", "px").mapInArrow(dot, "roi int, i long, v double")


def minus_global_min(traces: DataFrame, px: DataFrame) -> DataFrame:
    """Traces less the least pixel value of the movie."""
    low = px.agg(F.min("v").alias("low"))
    return traces.join(low, F.lit(True)).withColumn("v", F.col("v") - F.col("low")).drop("low")


def resample(px: DataFrame, n: int, total: int) -> DataFrame:
    """Mean of every n frames; the tail of total % n frames is dropped."""
    kept = px.where(F.col("frame_idx") < total - total % n)
    return kept.groupBy(F.floor(F.col("frame_idx") / n).alias("frame_idx"), "y", "x").agg(F.avg("v").alias("v"))


def generate(px: DataFrame, size: int, total: int, start: int = 0, stop: int | None = None, enforce_size: bool = False, pad: bool = False) -> DataFrame:
    """(chunk, rel, frame_idx, y, x, v): the frames start..stop in chunks of `size`, with each frame's place in its chunk and its index.

    The last chunk may be short; enforce_size drops it, and pad fills it with rows of missing values (frame_idx null).
    """
    stop = total if stop is None else min(stop, total)
    part = px.where((F.col("frame_idx") >= start) & (F.col("frame_idx") < stop))
    at = F.col("frame_idx") - start
    out = part.select(F.floor(at / size).alias("chunk"), (at % size).alias("rel"), F.col("frame_idx").cast("long").alias("frame_idx"), "y", "x", "v")
    short = max(0, stop - start) % size
    if short and enforce_size:
        out = out.where(F.col("chunk") < (stop - start) // size)
    elif short and pad:
        fill = px.select("y", "x").distinct().withColumn("rel", F.explode(F.sequence(F.lit(short).cast("long"), F.lit(size - 1).cast("long"))))
        out = out.unionByName(fill.select(F.lit((stop - start) // size).cast("long").alias("chunk"), "rel", F.lit(None).cast("long").alias("frame_idx"), "y", "x", F.lit(None).cast("double").alias("v")))
    return out


def chunks(px: DataFrame, size: int, n: int = 1, subtract_mean: bool = False) -> DataFrame:
    """(chunk, frame_idx, y, x, v): tumbling chunks of `size` frames, each reduced to means of n frames (its own remainder
    dropped), optionally less the movie's pixel means."""
    c = px.withColumn("chunk", F.floor(F.col("frame_idx") / size)).withColumn("g", F.floor((F.col("frame_idx") % size) / n))
    c = c.where(F.col("g") < size // n).groupBy("chunk", "g", "y", "x").agg(F.avg("v").alias("v"))
    out = c.withColumn("frame_idx", F.col("chunk") * (size // n) + F.col("g")).drop("g")
    if subtract_mean:
        mean = px.groupBy("y", "x").agg(F.avg("v").alias("m"))
        out = out.join(mean, ["y", "x"]).withColumn("v", F.col("v") - F.col("m")).drop("m")
    return out


def means(frames: DataFrame, size: int, n: int) -> DataFrame:
    """As `chunks`, of whole frames: (chunk, frame_idx, y, x, v) with h and w."""
    shape = frames.select("h", "w").limit(1)  # one row
    return chunks(pixels(frames), size, n).join(shape, F.lit(True))


def frames_of(px: DataFrame) -> DataFrame:
    """Frames (chunk, frame_idx, h, w, px) of pixel rows that also have chunk, h and w."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    return px.groupBy("chunk", "frame_idx", "h", "w").agg(F.transform(cells, lambda p: p["v"]).alias("px"))


def max_movie(px: DataFrame, size: int, n: int) -> DataFrame:
    """(chunk, y, x, v): highest value above the mean, over the n-frame means of each chunk."""
    return chunks(px, size, n).groupBy("chunk", "y", "x").agg((F.max("v") - F.avg("v")).alias("v"))


def mean_movie(px: DataFrame, slices: DataFrame) -> DataFrame:
    """(rel, y, x, v): mean over slices of each relative frame."""
    at = slices.select("start", F.explode(F.sequence("start", F.col("stop") - 1)).alias("frame_idx"))
    return px.join(at, "frame_idx").groupBy((F.col("frame_idx") - F.col("start")).alias("rel"), "y", "x").agg(F.avg("v").alias("v"))


def camera_trace(px: DataFrame, roi: DataFrame, times: DataFrame) -> DataFrame:
    """(roi, i, t, v): traces of regions of a side movie with its own timestamps (frame_idx, t)."""
    return extract(px, roi).join(times.select(F.col("frame_idx").alias("i"), "t"), "i").select("roi", "i", "t", "v")


def camera_example(px: DataFrame, times: DataFrame, t0: float, t1: float) -> DataFrame:
    """(frame_idx, t, y, x, v): frames of a side movie whose timestamps lie in [t0, t1)."""
    at = times.where((F.col("t") >= t0) & (F.col("t") < t1)).select("frame_idx", "t")
    return px.join(at, "frame_idx").select("frame_idx", "t", "y", "x", "v")


def append(px: DataFrame, more: DataFrame, index: str = "frame_idx") -> DataFrame:
    """Both movies (or, with index "i", traces), the second one's samples numbered on."""
    top = px.agg((F.coalesce(F.max(index), F.lit(-1)) + 1).alias("_n"))  # one row
    return px.unionByName(more.join(top, F.lit(True)).withColumn(index, (F.col(index) + F.col("_n")).cast(px.schema[index].dataType)).drop("_n"))


def crop_padded(px: DataFrame, boxes: DataFrame, pad: int) -> DataFrame:
    """(roi_id, frame_idx, y, x, v): the box (roi_id, y0, y1, x0, x1) of each region in all frames, from its own corner, with a margin; outside the image missing."""
    cells = boxes.select("roi_id", F.explode(F.sequence(F.col("y0") - pad, F.col("y1") + pad - 1)).alias("y"), "y0", "x0", "x1")
    cells = cells.select("roi_id", "y", (F.col("y0") - pad).alias("y0"), (F.col("x0") - pad).alias("x0"), F.explode(F.sequence(F.col("x0") - pad, F.col("x1") + pad - 1)).alias("x"))
    grid = cells.join(px.select("frame_idx").distinct().withColumn("one", F.lit(1)), F.lit(1) == F.col("one")).drop("one")
    return grid.join(px, ["frame_idx", "y", "x"], "left").select("roi_id", "frame_idx", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")


def example_movie(px: DataFrame, total: int, blocks: int = 10, size: int = 100, n: int = 3) -> DataFrame:
    """Means of n frames over the concatenation of `blocks` stretches centred evenly in the movie."""
    spans = []
    for i in range(1, blocks + 1):
        mid = i * total // (blocks + 1)
        lo = max(0, mid - size // 2)
        spans.append((lo, min(total, lo + size)))
    k = 0
    rows = None
    for lo, hi in spans:
        part = px.where(F.col("frame_idx").between(lo, hi - 1)).withColumn("k", F.col("frame_idx") - lo + k)
        rows, k = part if rows is None else rows.unionByName(part), k + hi - lo
    kept = rows.where(F.col("k") < k - k % n)
    return kept.groupBy(F.floor(F.col("k") / n).alias("frame_idx"), "y", "x").agg(F.avg("v").alias("v"))


def tiles(h: int, w: int, rows: float, cols: float) -> list[tuple[int, int, int, int, int]]:
    """(tile, y0, y1, x0, x1) of a grid; a float counts tiles as a share of the dimension."""
    r, c = (int(round(d * k)) if isinstance(k, float) else k for d, k in ((h, rows), (w, cols)))
    ys, xs = np.linspace(0, h, r + 1).astype(int), np.linspace(0, w, c + 1).astype(int)
    return [(i * c + j, int(ys[i]), int(ys[i + 1]), int(xs[j]), int(xs[j + 1])) for i in range(r) for j in range(c)]


def tile_of(px: DataFrame, h: int, w: int, rows: int, cols: int) -> DataFrame:
    """px with the tile that each pixel lies in."""
    grid = px.sparkSession.createDataFrame(tiles(h, w, rows, cols), "tile int, y0 int, y1 int, x0 int, x1 int")
    at = grid.select("tile", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1").select("tile", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
    return px.join(at, ["y", "x"])


def crop(px: DataFrame, y0: float, y1: float, x0: float, x1: float) -> DataFrame:
    """Pixels with floor(y0) <= y < ceil(y1), likewise x."""
    return px.where((F.col("y") >= F.floor(F.lit(y0))) & (F.col("y") < F.ceil(F.lit(y1))) & (F.col("x") >= F.floor(F.lit(x0))) & (F.col("x") < F.ceil(F.lit(x1))))


def scaled(px: DataFrame, low: float, high: float) -> DataFrame:
    """Values clipped to [low, high] and scaled to 0..255."""
    v = F.greatest(F.lit(low), F.least(F.lit(high), F.col("v")))
    return px.withColumn("v", F.bround(F.try_divide(v - low, F.lit(high - low)) * 255).cast("int"))


def min_max(image: DataFrame) -> DataFrame:
    """An image (y, x, v) rescaled to 0..1."""
    ends = image.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return image.join(ends, F.lit(True)).select("y", "x", F.try_divide(F.col("v") - F.col("a"), F.col("b") - F.col("a")).alias("v"))


def shift_integer(px: DataFrame, shifts: DataFrame, h: int, w: int) -> DataFrame:
    """Frames moved by whole pixels (frame_idx, x, y); what comes from outside is 0."""
    s = shifts.select("frame_idx", F.col("x").cast("int").alias("dx"), F.col("y").cast("int").alias("dy"))
    moved = px.join(s, "frame_idx").select("frame_idx", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "v")
    moved = moved.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    return px.select("frame_idx", "y", "x").join(moved, ["frame_idx", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def motion_borders(motion: DataFrame, h: int, w: int) -> DataFrame:
    """(xmin, xmax, ymin, ymax) that shifts leave valid."""
    return motion.agg(F.max("x").alias("xmin"), F.least(F.lit(float(w)), w + F.min("x")).alias("xmax"), F.max("y").alias("ymin"), F.least(F.lit(float(h)), h + F.min("y")).alias("ymax"))
