"""Numeric kernels: hand cases, injected shifts, simulated spikes and cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrid.functions import deconvolution as D
from fluxgrid.functions import kernels as K
from fluxgrid.operators import kernels as O
from fluxgrid.operators import movie, roi


def frames_of(spark, stack):
    h, w = stack.shape[1:]
    return spark.createDataFrame([(i, 0, h, w, f.ravel().tolist()) for i, f in enumerate(stack)], "frame_idx long, file_idx int, h int, w int, px array<double>")


def textured(h=24, w=28, seed=0):
    return K.gaussian(np.random.default_rng(seed).random((h, w)) * 100, 1.0)


@pytest.mark.parametrize("x, plain, fixed", [([1, 2, 4], 1.5, 1.5), ([1, 3, 4], 3, 3.5), ([1, 2, 8, 8], 1.5, 8), ([5], 5, 5), ([1, 3], 2, 2)])
def test_half_sample_mode(x, plain, fixed):
    assert K.half_sample_mode(x) == plain and K.half_sample_mode(x, True) == fixed


def test_shift_and_back():
    a = textured()
    b = K.shift(K.shift(a, 2, -3), -2, 3)
    assert np.allclose(a[4:-4, 4:-4], b[4:-4, 4:-4])
    assert np.allclose(K.shift(a, 0.5, 0)[5, 5], (a[5, 5] + a[5, 4]) / 2)


def test_registration_recovers_shifts(spark):
    a, rng = textured(), np.random.default_rng(1)
    true = rng.integers(-3, 4, (12, 2))
    big = np.pad(a, 6, "reflect")
    stack = np.stack([big[6 - y : 6 - y + 24, 6 - x : 6 - x + 28] for x, y in true])
    got = O.motion(frames_of(spark, stack), a, 4, 4).orderBy("frame_idx").toPandas()
    assert np.allclose(got["x"], -true[:, 0], atol=0.5) and np.allclose(got["y"], -true[:, 1], atol=0.5)
    total, _ = O.motion_correct(frames_of(spark, stack), 5, 5, 3)
    left = total.orderBy("frame_idx").toPandas()
    assert np.ptp(left["x"] + true[:, 0]) < 1.5 and np.ptp(left["y"] + true[:, 1]) < 1.5


def test_registration_by_chunk(spark):
    a = textured()
    df = frames_of(spark, np.stack([a] * 6)).withColumn("chunk", (F.col("frame_idx") % 2).cast("int"))
    got = O.motion_by_chunk(df, "chunk", 2, 2)
    assert got.count() == 6 and got.agg(F.max(F.abs("x"))).first()[0] < 0.2


def test_ar1_is_feasible_and_no_worse_than_the_truth():
    y, c, s = D.simulate(traces=1, n=600)
    got, spikes = D.ar1(y[0], 0.95, 0.0)
    assert (spikes >= -1e-9).all() and np.square(got - y[0]).sum() <= np.square(c[0] - y[0]).sum() + 1e-9
    assert np.allclose(got[1:] - 0.95 * got[:-1], spikes[1:], atol=1e-9)


@pytest.mark.parametrize("penalty", [0, 1])
def test_deconvolution_meets_the_noise(penalty):
    y, c, s = D.simulate(traces=1, n=1500, b=2.0, firing=1.0)
    r = D.deconvolve(y[0], sn=0.3, g=(0.95,), penalty=penalty)
    rss = np.square(y[0] - r.b - r.c).sum() / (0.09 * len(y[0]))
    assert 0.8 < rss < 1.2 and (r.s >= -1e-9).all()
    assert np.corrcoef(r.c, c[0])[0, 1] > 0.85


def test_second_order():
    y, c, s = D.simulate(g=(1.7, -0.712), sn=0.5, n=800, traces=1, firing=1.0)
    r = D.deconvolve(y[0], g=(1.7, -0.712), sn=0.5, b=0.0)
    assert np.corrcoef(r.c, c[0])[0, 1] > 0.9


def test_estimates():
    y, _, _ = D.simulate(traces=1, n=6000, firing=2.0)
    assert abs(K.noise(y[0]) - 0.3) < 0.05
    assert 0.85 < K.ar_coefficients(y[0], 1, 0.3)[0] <= 1.0
    assert D.deconvolve(y[0][:600], optimize_g=True).g[0] < 1


def test_deconvolution_of_traces(spark):
    y, _, _ = D.simulate(traces=2, n=200)
    df = spark.createDataFrame([(k, i, float(v)) for k in range(2) for i, v in enumerate(y[k])], "roi int, i long, v double")
    out = O.deconvolve(df, g=(0.95,), sn=0.3)
    assert out.count() == 400 and out.where("s < -1e-9").isEmpty()
    assert O.trace_noise(df).count() == 2


def cells(n=60, size=40, seed=2):
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[:size, :size]
    masks = [np.hypot(yy - y, xx - x) <= 4 for y, x in ((9, 9), (29, 28))]
    signal = rng.random((2, n)) * 5 * (rng.random((2, n)) < 0.3)
    return np.stack([sum(m * s for m, s in zip(masks, signal[:, t])) + rng.normal(0, 0.05, (size, size)) for t in range(n)]), masks


def test_segmentation_finds_cells(spark):
    stack, masks = cells()
    comps = O.pca_ica(frames_of(spark, stack), 2)
    images = spark.createDataFrame([(k, 40, 40, c.tolist()) for k, c in enumerate(comps)], "comp int, h int, w int, px array<double>")
    px = O.component_regions(images, sigma=1.0).toPandas()
    for m in masks:
        best = max((m[g["y"], g["x"]].sum() / (m.sum() + len(g) - m[g["y"], g["x"]].sum()) for _, g in px.groupby("roi_id")), default=0)
        assert best > 0.5


def test_principal_components_match_svd(spark):
    stack, _ = cells()
    comps, mean = O.pca(frames_of(spark, stack), 2)
    x = stack.reshape(len(stack), -1)
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    assert np.allclose(np.abs((comps * want).sum(1)), 1, atol=1e-6) and np.allclose(mean, x.mean(0))


def test_non_negative_factors():
    stack, masks = cells()
    a, b = K.nmf(stack.reshape(len(stack), -1).T, 2)
    assert (a >= 0).all() and (b >= 0).all()
    assert max(np.corrcoef(a[:, k], masks[0].ravel())[0, 1] for k in range(2)) > 0.7


def test_regions_of_images():
    disk = np.hypot(*(np.mgrid[:30, :30] - 15)) <= 8
    assert 0.75 < K.circularity(disk) < 1.25
    assert K.label(np.eye(3, dtype=bool), K.FOUR)[1] == 3 and K.label(np.eye(3, dtype=bool), K.EIGHT)[1] == 1
    assert K.resize(textured(), 0.5).shape == (12, 14) and np.allclose(K.resize(textured(), 1.0, 2), textured())
    ring = np.exp(-((np.hypot(*(np.mgrid[:40, :40] - 20)) - 7) ** 2) / 2)
    wand = K.magic_wand(ring, 20, 20, 3, 12)
    assert wand[20, 20] and 0.7 < wand.sum() / (np.pi * 49) < 1.5


def test_refined_region(spark):
    disk = np.hypot(*(np.mgrid[:20, :20] - 10)) <= 5
    rng = np.random.default_rng(0)
    rows = [(k, y, x, float((disk if k == 0 else np.zeros_like(disk))[y, x] * 0.9 + rng.normal(0, 0.02))) for k in range(3) for y in range(20) for x in range(20)]
    corr = spark.createDataFrame(rows, "roi int, y int, x int, r double")
    old = spark.createDataFrame([(0, int(y), int(x)) for y, x in zip(*np.nonzero(disk))], "roi_id int, y int, x int")
    got = O.refine_regions(corr, old, 20, 20).toPandas()
    assert 0.5 * disk.sum() <= len(got) <= 3.5 * disk.sum() and disk[got["y"], got["x"]].mean() > 0.8


def test_resized_frames(spark):
    r = O.resize(frames_of(spark, np.stack([textured()])), 0.5).first()
    assert (r["h"], r["w"], len(r["px"])) == (12, 14, 168)


def test_polygon_and_versions(spark):
    p = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 4.0, 0.0), (0, 2, 4.0, 3.0), (0, 3, 0.0, 3.0)], "roi_id int, k int, x double, y double")
    px = roi.polygon(p)
    assert px.count() == 20
    r = px.withColumn("roi_set", F.lit(0))
    assert roi.border(r).count() == 14 and roi.next_version(r).first()[0] == 1
    more = roi.add(r, roi.subset(r, r.select("roi_id"), 0))
    assert more.agg(F.max("roi_id")).first()[0] == 1 and roi.latest(more).count() == 40
    assert roi.centroids(r).first()["cy"] == 1.5


def test_blocks_equal_long_form(spark):
    f = frames_of(spark, np.random.default_rng(0).random((7, 5, 6)))
    a = movie.project_blocks(f).orderBy("y", "x").toPandas()["v"]
    b = movie.project(movie.pixels(f), ["y", "x"], F.avg("v")).orderBy("y", "x").toPandas()["v"]
    assert np.allclose(a, b, atol=1e-12)
    assert movie.tiles(8, 8, 2, 0.25) == [(0, 0, 4, 0, 4), (1, 0, 4, 4, 8), (2, 4, 8, 0, 4), (3, 4, 8, 4, 8)]


def test_non_negative_factors_of_frames(spark):
    stack, masks = cells()
    images, weights = O.nmf(frames_of(spark, stack), 2, rounds=15)
    assert (images >= 0).all() and weights.where("array_min(w) < 0").isEmpty() and weights.count() == len(stack)
    assert max(np.corrcoef(images[k], masks[0].ravel())[0, 1] for k in range(2)) > 0.7


def test_segment_is_the_composition(spark):
    stack, masks = cells()
    px = O.segment(frames_of(spark, stack), 2, chunk=len(stack) // 2, n=2, sigma=1.0).toPandas()
    assert set(px["roi_set"]) == {0, 1}
    for m in masks:
        best = max((m[g["y"], g["x"]].sum() / (m.sum() + len(g) - m[g["y"], g["x"]].sum()) for _, g in px.groupby(["roi_set", "roi_id"])), default=0)
        assert best > 0.4


def test_independent_sources_are_found(spark):
    rng = np.random.default_rng(3)
    true = rng.laplace(size=(3000, 3))
    mixed = true @ rng.normal(size=(3, 3))
    time = spark.createDataFrame([(x.tolist(),) for x in mixed[200:]], "z array<double>").repartition(3)
    got = O.independent(mixed[:200], time, np.ones(3), tol=1e-7)
    match = np.abs(np.corrcoef(got.T, true[:200].T)[:3, 3:])
    assert (match.max(0) > 0.95).all() and (match.max(1) > 0.95).all()


def test_processed_regions_in_micrometres(spark):
    from fluxgrid.operators import roi

    rng = np.random.default_rng(1)
    base = rng.normal(size=200)
    rows = [(0, k, y, x) for k, (y0, x0, n) in enumerate([(2, 2, 6), (3, 3, 3), (2, 9, 5), (20, 20, 4), (0, 30, 2)]) for y in range(y0, y0 + n) for x in range(x0, x0 + n)]
    values = {0: base, 1: base + 0.01 * rng.normal(size=200), 2: base + 0.1 * rng.normal(size=200), 3: rng.normal(size=200), 4: base}
    t = spark.createDataFrame([(k, i, float(v)) for k, x in values.items() for i, v in enumerate(x)], "roi int, i long, v double")
    rois = spark.createDataFrame(rows, "roi_set int, roi_id int, y int, x int")
    got = roi.process_scaled(rois, t, 2.0, (1, 40, 1, 40), 1.5, distance=2.5).toPandas()
    sizes = sorted(len(g) for _, g in got.groupby("roi_id"))
    assert sizes == [16, 36 + 25]  # the inner copy and the region at the border are gone, two near similar ones are one


def test_contours_walk_around(spark):
    square = np.zeros((6, 7), bool)
    square[1:5, 2:6] = True
    walk = K.contour(square)
    assert len(walk) == 12 and {tuple(p) for p in walk} == {(y, x) for y in range(1, 5) for x in range(2, 6) if y in (1, 4) or x in (2, 5)}
    assert np.abs(np.diff(np.vstack([walk, walk[:1]]), axis=0)).max() == 1
    line = np.zeros((3, 5), bool)
    line[1, 1:4] = True
    assert [tuple(p) for p in K.contour(line)] == [(1, 1), (1, 2), (1, 3), (1, 2)]
    assert len(K.contour(np.zeros((2, 2), bool))) == 0 and len(K.contour(np.ones((1, 1), bool))) == 1
    yy, xx = np.mgrid[:20, :20]
    disk = (yy - 9) ** 2 + (xx - 10) ** 2 <= 49
    rows = [(0, 5, int(y), int(x)) for y, x in zip(*np.nonzero(disk))]
    got = O.contours(spark.createDataFrame(rows, "roi_set int, roi_id int, y int, x int")).orderBy("k").toPandas()
    steps = np.diff(got[["y", "x"]].to_numpy(), axis=0)
    assert np.abs(steps).max() == 1 and set(got["roi_id"]) == {5}
    angle = np.unwrap(np.arctan2(got["y"] - 9, got["x"] - 10))
    assert abs(abs(angle[-1] - angle[0]) - 2 * np.pi) < 0.4  # once around


def test_equalised_contrast(spark):
    rng = np.random.default_rng(0)
    image = 0.4 + 0.02 * rng.random((32, 32))
    out = K.equalize(image, 4, 40.0)
    assert out.min() >= 0 and out.max() <= 1 and out.std() > 5 * image.std()
    flat = K.equalize(image, 1, 1.0)  # a histogram cut at its mean is nearly even: the mapping is nearly the identity
    assert np.abs(flat - image).max() < 0.2
    df = spark.createDataFrame([(y, x, float(v)) for (y, x), v in np.ndenumerate(image)], "y int, x int, v double")
    assert O.equalized(df, 4, 40.0).count() == 1024


def test_pixels_as_samples(spark):
    stack, _ = cells()
    comps, mean = O.pca(frames_of(spark, stack), 2, samples="pixels")
    x = stack.reshape(len(stack), -1)
    x = x - x.mean(1, keepdims=True)
    g = x.T @ x / len(x)
    assert np.allclose(np.abs((comps * np.linalg.eigh(g - 0)[1][:, ::-1][:, :2].T).sum(1)), 1, atol=1e-6) and not mean.any()


def test_decimated_baseline():
    y, c, s = D.simulate(traces=1, n=1200, b=2.0)
    fine, coarse = D.constrained(y[0], (0.95,), 0.3), D.constrained(y[0], (0.95,), 0.3, decimate=4)
    assert abs(coarse.b - fine.b) < 0.15 and np.corrcoef(fine.c, coarse.c)[0, 1] > 0.98
