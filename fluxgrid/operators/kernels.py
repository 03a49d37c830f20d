"""Operators whose numeric kernel runs in Python: one group a trace, frame batch, chunk, component or region.

Frame kernels see Arrow batches of whole frames; trace kernels one trace at a
time (deconvolution is sequential in time), so a task's memory is one batch
or one trace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.functions import deconvolution
from fluxgrid.functions import kernels as K

#: Partial matrices that the driver adds up at most.
GROUPS = 8


def modes(df: DataFrame, fixed: bool = False) -> DataFrame:
    """(roi, m): half-sample mode of each trace."""
    return df.groupBy("roi").applyInPandas(lambda t: pd.DataFrame({"roi": t["roi"][:1], "m": [K.half_sample_mode(t["v"].to_numpy(float), fixed)]}), f"roi {dict(df.dtypes)['roi']}, m double")


def apply_shifts(frames: DataFrame, motion: DataFrame) -> DataFrame:
    """Frames moved by their shifts (frame_idx, x, y), bilinear, 0 outside."""
    j = frames.join(motion.select("frame_idx", F.col("x").alias("_x"), F.col("y").alias("_y")), "frame_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            t["px"] = [K.shift(np.asarray(p, float).reshape(h, w), x, y).ravel() for p, h, w, x, y in zip(t["px"], t["h"], t["w"], t["_x"], t["_y"])]
            yield t.drop(columns=["_x", "_y"])

    out = j.drop("_x", "_y").withColumn("px", F.col("px").cast("array<double>"))
    return j.mapInPandas(run, out.schema)


def template(frames: DataFrame, n: int = 1) -> np.ndarray:
    """Pixel medians over the n-frame means: one image, computed by aggregation."""
    from fluxgrid.operators import movie

    total = frames.count()
    px = movie.pixels(frames)
    px = movie.resample(px, n, total) if n > 1 else px
    rows = px.groupBy("y", "x").agg(F.percentile("v", F.lit(0.5)).alias("v")).toPandas()  # one image
    out = np.zeros((rows["y"].max() + 1, rows["x"].max() + 1))
    out[rows["y"], rows["x"]] = rows["v"]
    return out


def motion(frames: DataFrame, image: np.ndarray, my: int, mx: int) -> DataFrame:
    """(frame_idx, x, y, metric, peak): shifts that move each frame onto the template image."""
    schema = "frame_idx long, x double, y double, metric double, peak double"
    shared = frames.sparkSession.sparkContext.broadcast(image)  # one image

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            got = [K.register(np.asarray(p, float).reshape(h, w), shared.value, my, mx) for p, h, w in zip(t["px"], t["h"], t["w"])]
            yield pd.DataFrame([(i, *g) for i, g in zip(t["frame_idx"], got)], columns=["frame_idx", "x", "y", "metric", "peak"])

    return frames.select("frame_idx", "h", "w", "px").mapInPandas(run, schema)


def motion_correct(frames: DataFrame, my: int, mx: int, iterations: int = 5, threshold: float = 1.0, resample: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(shifts, template): registration repeated on the moved frames until no shift reaches the threshold; shifts add up.

    The moved movie is never stored: each round moves the original frames by the sum so far.
    """
    total, here, image = None, frames, template(frames, resample)
    for _ in range(iterations):
        found = motion(here, image, my, mx).persist()
        most = found.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0]
        if total is None:
            total = found
        else:
            before = total.select("frame_idx", F.col("x").alias("px"), F.col("y").alias("py"))
            total = found.join(before, "frame_idx").select("frame_idx", (F.col("x") + F.col("px")).alias("x"), (F.col("y") + F.col("py")).alias("y"), "metric", "peak")
        if most is None or most < threshold:
            break
        here = apply_shifts(frames, total)
        image = template(here, resample)
    return total, image


def motion_by_chunk(frames: DataFrame, chunk: str, my: int, mx: int, iterations: int = 5, threshold: float = 1.0) -> DataFrame:
    """(frame_idx, chunk, x, y, metric, x_local, y_local): each chunk registered on its own template, then the chunks' templates
    (one image a chunk, on the driver) on each other. Templates are pixel medians by aggregation, frames are registered one
    by one beside their chunk's template: no task holds a chunk."""
    from fluxgrid.operators import movie

    kind = "frame_idx long, chunk int, x double, y double, metric double"
    base = frames.select("frame_idx", "h", "w", F.col("px").cast("array<double>").alias("px"), F.col(chunk).cast("int").alias("chunk"))

    def moved(total: DataFrame | None) -> DataFrame:
        return base if total is None else apply_shifts(base, total.select("frame_idx", "x", "y"))

    def templates(here: DataFrame) -> DataFrame:
        px = movie.pixels(here).join(here.select("frame_idx", "chunk"), "frame_idx")
        image = px.groupBy("chunk", "y", "x").agg(F.percentile("v", F.lit(0.5)).alias("v"))
        return image.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"]).alias("image"))

    def register(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            got = [K.register(np.asarray(p, float).reshape(h, w), np.asarray(i, float).reshape(h, w), my, mx) for p, i, h, w in zip(t["px"], t["image"], t["h"], t["w"])]
            yield pd.DataFrame([(i, c, *g[:3]) for i, c, g in zip(t["frame_idx"], t["chunk"], got)], columns=["frame_idx", "chunk", "x", "y", "metric"])

    total = None
    for _ in range(iterations):
        here = moved(total)
        found = written(here.join(templates(here), "chunk").select("frame_idx", "chunk", "h", "w", "px", "image").mapInPandas(register, kind))
        most = found.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0]
        if total is not None:
            old = total.select("frame_idx", F.col("x").alias("ox"), F.col("y").alias("oy"))
            found = written(found.join(old, "frame_idx").select("frame_idx", "chunk", (F.col("x") + F.col("ox")).alias("x"), (F.col("y") + F.col("oy")).alias("y"), "metric"))
        total = found
        if most is None or most < threshold:
            break
    size = base.select("h", "w").first()
    images = templates(moved(total)).orderBy("chunk").toPandas()  # one image a chunk
    stack = np.stack([np.asarray(i).reshape(size["h"], size["w"]) for i in images["image"]])
    sums = np.zeros((len(stack), 2))
    for _ in range(iterations):
        here = np.stack([K.shift(f, *s) for f, s in zip(stack, sums)])
        got = np.array([K.register(f, np.median(here, 0), my, mx) for f in here])
        sums += got[:, :2]
        if np.abs(got[:, :2]).max() < threshold:
            break
    g = frames.sparkSession.createDataFrame(pd.DataFrame({"chunk": images["chunk"].astype("int32"), "gx": sums[:, 0], "gy": sums[:, 1]}))
    local = total.select("frame_idx", "chunk", F.col("x").alias("x_local"), F.col("y").alias("y_local"), "metric")
    return local.join(g, "chunk").select("frame_idx", "chunk", (F.col("x_local") + F.col("gx")).alias("x"), (F.col("y_local") + F.col("gy")).alias("y"), "metric", "x_local", "y_local")


def pca(frames: DataFrame, k: int, samples: str = "frames") -> tuple[np.ndarray, np.ndarray]:
    """(components, mean): the k leading directions of the frames (k rows of pixels), by partial Gram matrices of the pixels.

    The matrix has pixels^2 cells, so resize frames first; tasks send one partial matrix each to a few tasks that add them up.
    samples "pixels" takes pixels as samples: each frame is centred by its own mean, and mean is 0.
    """
    schema = pa.schema([("n", pa.int64()), ("s", pa.list_(pa.float64())), ("g", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                m = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                m = m - m.mean(1, keepdims=True) if samples == "pixels" else m
                n, s, g = n + len(m), s + m.sum(0), g + m.T @ m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s], pa.list_(pa.float64())), pa.array([g.ravel()], pa.list_(pa.float64()))], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, 0.0, 0.0
        for r in (r for b in batches for r in b.to_pylist()):
            n, s, g = n + r["n"], s + np.array(r["s"]), g + np.array(r["g"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s], pa.list_(pa.float64())), pa.array([g], pa.list_(pa.float64()))], schema=schema)

    part = frames.select("px").mapInArrow(run, "n long, s array<double>, g array<double>")
    part = part.repartition(GROUPS).mapInArrow(add, part.schema)  # executors add up; at most GROUPS matrices reach the driver
    n, s, g = 0, 0.0, 0.0
    for r in part.toLocalIterator():
        n, s, g = n + r["n"], s + np.array(r["s"]), g + np.array(r["g"])
    if not n:
        raise ValueError("no frames")
    mean = s / n if samples == "frames" else np.zeros(len(s))
    cov = g.reshape(len(mean), -1) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    return vectors[:, ::-1][:, :k].T, mean


def pca_ica(frames: DataFrame, k: int, mu: float = 0.5, ica: bool = True, samples: str = "frames") -> np.ndarray:
    """Component images (k rows): principal ones, or independent ones of the joint space-time matrix weighted mu and 1 - mu."""
    comps, mean = pca(frames, k, samples)
    if not ica:
        return comps
    shared = frames.sparkSession.sparkContext.broadcast((comps, mean))  # k images

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, m = shared.value
        for t in batches:
            yield pd.DataFrame({"z": list((np.stack(t["px"]).astype(float) - m) @ c.T)})

    time = written(frames.select("frame_idx", "px").mapInPandas(reduce, "z array<double>"))
    space = comps.T - comps.T.mean(0)
    top = time.agg(*[F.max(F.abs(F.col("z")[i])).alias(f"m{i}") for i in range(len(comps))]).first()
    scale = lambda a, most: np.divide(a, most, out=np.zeros_like(a), where=most > 0)
    most = np.array(list(top), float)
    part = scale(np.full(len(comps), 1 - mu), most)
    return independent(mu * scale(space, np.broadcast_to(np.abs(space).max(0), space.shape)), time, part).T


def written(df: DataFrame) -> DataFrame:
    """df, written once under the checkpoint folder, so that rounds read it and lost executors cost no recomputation."""
    from fluxgrid.operators.graph import checkpoint_folder

    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def independent(own: np.ndarray, time: DataFrame, part: np.ndarray, rounds: int = 200, tol: float = 1e-3, seed: int = 0) -> np.ndarray:
    """Independent sources of the rows `own` (few) within the joint sample of own and time's z times part.

    The fixed point of the log-cosh contrast is iterated by aggregates: each round sums two k x k matrices over the
    executors, so the driver holds own and matrices of k columns, never the frames' scores.
    """
    k = own.shape[1]

    def sums(f) -> list[np.ndarray]:
        """Sums over all rows of the arrays that f makes of a block of rows."""
        shapes = [np.shape(x) for x in f(np.zeros((1, k)))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    got = f(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k) * part)
                    total = got if total is None else [x + y for x, y in zip(total, got)]
            if total is not None:
                flat = np.concatenate([np.ravel(x) for x in total])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["p", "x"])

        found = time.mapInArrow(run, "p long, x double").groupBy("p").agg(F.sum("x")).collect()  # as many numbers as f makes
        flat = np.concatenate([np.ravel(x) for x in f(own)])
        for p, x in found:
            flat[p] += x
        cuts = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        return [flat[i:j].reshape(s) for i, j, s in zip(cuts, cuts[1:], shapes)]

    n, mean = sums(lambda z: [np.array([float(len(z))]), z.sum(0)])
    n = max(1.0, float(n[0]))
    mean = mean / n
    (cov,) = sums(lambda z: [(z - mean).T @ (z - mean)])
    values, vectors = np.linalg.eigh(cov / n)
    keep = values > 1e-12 * max(values.max(), 1e-300)
    white = (vectors[:, keep] / np.sqrt(values[keep])).T
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(white), len(white))))[0]
    for _ in range(rounds):
        turn = w @ white

        def step(z: np.ndarray, turn: np.ndarray = turn) -> list[np.ndarray]:
            g = np.tanh((z - mean) @ turn.T)
            return [g.T @ ((z - mean) @ white.T), (1 - g**2).sum(0)]

        a, b = sums(step)
        u, _, v = np.linalg.svd(a / n - np.diag(b / n) @ w)
        new = u @ v
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < tol
        w = new
        if done:
            break
    return (own - mean) @ white.T @ w.T


def nmf(frames: DataFrame, k: int, rounds: int = 30, inner: int = 20, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """(images, weights): k non-negative images whose weighted sums (frame_idx, w) come near the frames, less their 1st percentile, cut at 0.

    A frame's weights follow from the images alone (multiplicative updates from equal weights), so no round stores any;
    images are updated by two sums over all frames, of weights times pixels and weights times weights.
    """
    low = frames.select(F.explode("px").alias("v")).agg(F.percentile_approx("v", F.lit(0.01), F.lit(100_000))).first()[0] or 0.0
    pixels = int(frames.select(F.size("px").alias("n")).first()["n"])
    images = np.random.default_rng(seed).random((k, pixels)) + 0.1

    def fit(px: np.ndarray, images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.maximum(px.astype(float) - low, 0)
        w, top, under = np.ones((len(y), len(images))), y @ images.T, images @ images.T
        for _ in range(inner):
            w *= top / (w @ under + 1e-12)
        return y, w

    for _ in range(rounds):
        now = images

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            a, b = np.zeros((k, pixels)), np.zeros((k, k))
            for batch in batches:
                if batch.num_rows:
                    y, w = fit(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), now)
                    a, b = a + w.T @ y, b + w.T @ w
            flat = np.concatenate([a.ravel(), b.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["p", "x"])

        found = frames.select("px").mapInArrow(sums, "p long, x double").groupBy("p").agg(F.sum("x")).collect()  # k images and a k x k matrix
        flat = np.zeros(k * pixels + k * k)
        for p, x in found:
            flat[p] = x
        a, b = flat[: k * pixels].reshape(k, pixels), flat[k * pixels :].reshape(k, k)
        for _ in range(inner):
            images = images * (a / (b @ images + 1e-12))
    last = images

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield pd.DataFrame({"frame_idx": t["frame_idx"], "w": list(fit(np.stack(t["px"]), last)[1])})

    return images, frames.select("frame_idx", "px").mapInPandas(weigh, "frame_idx long, w array<double>")


def segment(frames: DataFrame, k: int, chunk: int = 3000, n: int = 3, factor: float = 1.0, mu: float = 0.5, ica: bool = True, **limits) -> DataFrame:
    """(roi_set, roi_id, y, x): regions found in chunks of `chunk` frames (one set a chunk): n-frame means, resized, to components, to regions.

    factor 1 keeps the images' size; a smaller one bounds the pixel covariance, and regions are in the resized image's pixels.
    """
    from fluxgrid.operators import movie

    spark, out = frames.sparkSession, None
    small = written(movie.frames_of(movie.means(frames, chunk, n)))
    small = small if factor == 1.0 else written(resize(small, factor))
    h, w = small.select("h", "w").first()
    for c in [r[0] for r in small.select("chunk").distinct().orderBy("chunk").collect()]:  # one number a chunk
        images = pca_ica(small.where(F.col("chunk") == c), k, mu, ica)
        comps = spark.createDataFrame([(i, h, w, m.tolist()) for i, m in enumerate(images)], "comp int, h int, w int, px array<double>")
        found = component_regions(comps, **limits).withColumn("roi_set", F.lit(int(c)))
        out = found if out is None else out.unionByName(found)
    return out


def equalized(image: DataFrame, tiles: int = 8, clip: float = 2.0) -> DataFrame:
    """(y, x, v): one image (y, x, v), rescaled to 0..1, with its contrast equalised tile by tile (see the kernel)."""
    from fluxgrid.operators import movie

    def run(t: pd.DataFrame) -> pd.DataFrame:
        px = np.zeros((t["y"].max() + 1, t["x"].max() + 1))
        px[t["y"], t["x"]] = t["v"].fillna(0.0)
        return pd.DataFrame({"y": t["y"], "x": t["x"], "v": K.equalize(px, tiles, clip)[t["y"], t["x"]]})

    one = movie.min_max(image).withColumn("_one", F.lit(0))  # one image
    return one.groupBy("_one").applyInPandas(run, "y int, x int, v double")


def circularities(rois: DataFrame) -> DataFrame:
    """(roi_id, perimeter, circularity) of each region: 4 pi area / perimeter^2."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        y, x = t["y"] - t["y"].min(), t["x"] - t["x"].min()
        mask = np.zeros((y.max() + 1, x.max() + 1), bool)
        mask[y, x] = True
        return pd.DataFrame({"roi_id": t["roi_id"][:1], "perimeter": K.perimeter(mask), "circularity": K.circularity(mask)})

    return rois.select("roi_id", "y", "x").groupBy("roi_id").applyInPandas(run, "roi_id int, perimeter double, circularity double")


def contours(rois: DataFrame) -> DataFrame:
    """(roi_id, k, y, x): the border of each region in the order of a walk around it."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = t["y"].min(), t["x"].min()
        mask = np.zeros((t["y"].max() - y0 + 1, t["x"].max() - x0 + 1), bool)
        mask[t["y"] - y0, t["x"] - x0] = True
        walk = K.contour(mask)
        return pd.DataFrame({"roi_id": t["roi_id"].iloc[0], "k": np.arange(len(walk)), "y": walk[:, 0] + y0, "x": walk[:, 1] + x0}).astype("int32")

    return rois.select("roi_id", "y", "x").groupBy("roi_id").applyInPandas(run, "roi_id int, k int, y int, x int")


def component_regions(components: DataFrame, **limits) -> DataFrame:
    """(roi_set, roi_id, y, x) from component images (comp, h, w, px), ordered by the centroids' squared distance from the corner."""
    schema = "comp int, k int, y int, x int"

    def run(t: pd.DataFrame) -> pd.DataFrame:
        r = t.iloc[0]
        masks = K.component_regions(np.asarray(r["px"], float).reshape(r["h"], r["w"]), **limits)
        rows = [(r["comp"], k, y, x) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
        return pd.DataFrame(rows, columns=["comp", "k", "y", "x"]).astype("int32")

    px = components.groupBy("comp").applyInPandas(run, schema)
    order = px.groupBy("comp", "k").agg((F.pow(F.avg("y"), 2) + F.pow(F.avg("x"), 2)).alias("d"))
    order = order.withColumn("roi_id", (F.row_number().over(Window.orderBy("d", "comp", "k")) - 1).cast("int"))
    return px.join(order, ["comp", "k"]).select(F.lit(0).alias("roi_set"), "roi_id", "y", "x")


def refine_regions(corr: DataFrame, rois: DataFrame, h: int, w: int, keep_rejected: bool = False) -> DataFrame:
    """(roi_id, y, x) redrawn from correlation images (roi, y, x, r), after each pixel's median over regions is taken off."""
    med = corr.groupBy("y", "x").agg(F.percentile("r", F.lit(0.5)).alias("m"))
    c = corr.join(med, ["y", "x"]).select(F.col("roi").cast("int").alias("roi_id"), "y", "x", (F.col("r") - F.col("m")).alias("r"))
    j = c.join(rois.select("roi_id", "y", "x", F.lit(True).alias("inside")), ["roi_id", "y", "x"], "left")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        r, mask = np.zeros((h, w)), np.zeros((h, w), bool)
        r[t["y"], t["x"]] = t["r"].fillna(0.0)
        mask[t["y"], t["x"]] = t["inside"].notna()
        new = K.refine_region(r, mask) if mask.any() else None
        new = mask if new is None and keep_rejected else new
        y, x = np.nonzero(new) if new is not None else ([], [])
        return pd.DataFrame({"roi_id": np.full(len(y), t["roi_id"].iloc[0], "int32"), "y": np.asarray(y, "int32"), "x": np.asarray(x, "int32")})

    return j.groupBy("roi_id").applyInPandas(run, "roi_id int, y int, x int")


def resize(frames: DataFrame, factor: float, order: int = 1) -> DataFrame:
    """Frames with both sides scaled."""
    out = frames.withColumn("px", F.col("px").cast("array<double>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            new = [K.resize(np.asarray(p, float).reshape(h, w), factor, order) for p, h, w in zip(t["px"], t["h"], t["w"])]
            t["px"], t["h"], t["w"] = [n.ravel() for n in new], [n.shape[0] for n in new], [n.shape[1] for n in new]
            yield t.astype({"h": "int32", "w": "int32"})

    return frames.mapInPandas(run, out.schema)


def magic_wand(images: DataFrame, seeds: DataFrame, r_min: int, r_max: int, spread: int = 0, share: float = 0.5) -> DataFrame:
    """(seed, y, x): cells around seeds (seed, image, cy, cx) in images (image, h, w, px); with spread, pixels in more than
    `share` of the masks of nine seeds at distance spread; several images of one seed vote likewise."""
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-spread, 0, spread) for b in (-spread, 0, spread)]) if spread else F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    s = seeds.withColumn("m", F.explode(moves)).select("seed", "image", (F.col("cy") + F.col("m.a")).alias("cy"), (F.col("cx") + F.col("m.b")).alias("cx"))
    j = s.join(images, "image")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for r in t.itertuples():
                y, x = np.nonzero(K.magic_wand(np.asarray(r.px, float).reshape(r.h, r.w), r.cy, r.cx, r_min, r_max))
                out.append(pd.DataFrame({"seed": r.seed, "y": y, "x": x}))
            yield pd.concat(out).astype({"seed": "int32", "y": "int32", "x": "int32"})

    votes = s.groupBy("seed").agg(F.count("*").alias("all"))
    got = j.mapInPandas(run, "seed int, y int, x int").groupBy("seed", "y", "x").agg(F.count("*").alias("n"))
    return got.join(votes, "seed").where(F.col("n") > share * F.col("all")).select("seed", "y", "x")


def deconvolve(df: DataFrame, **options) -> DataFrame:
    """(roi, i, c, s, b, g, lam): spikes of each trace."""
    kind = dict(df.dtypes)["roi"]

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("i")
        r = deconvolution.deconvolve(t["v"].to_numpy(float), **options)
        return pd.DataFrame({"roi": t["roi"], "i": t["i"], "c": r.c, "s": r.s, "b": r.b, "g": [list(r.g)] * len(t), "lam": r.lam})

    return df.groupBy("roi").applyInPandas(run, f"roi {kind}, i long, c double, s double, b double, g array<double>, lam double")


def trace_noise(df: DataFrame) -> DataFrame:
    """(roi, sn): noise deviation of each trace."""
    return df.groupBy("roi").applyInPandas(lambda t: pd.DataFrame({"roi": t["roi"][:1], "sn": [K.noise(t.sort_values("i")["v"].to_numpy(float))]}), f"roi {dict(df.dtypes)['roi']}, sn double")
