"""Numeric kernels in numpy for what SQL cannot express: images, registration, decomposition, deconvolution."""

from __future__ import annotations

import numpy as np

EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def half_sample_mode(x: np.ndarray, fixed: bool = False) -> float:
    """Mode by repeatedly keeping the densest half of the sorted values.

    The default keeps two traits of the usual definition here: the last window of an even sample is not tried, and of
    three values only a smaller left gap gives a mean. With fixed, all windows count and both gaps are compared.
    """
    x = np.sort(np.asarray(x, float)[~np.isnan(np.asarray(x, float))])
    while len(x) > 3:
        half = -(-len(x) // 2)
        last = len(x) - half + 1 if fixed else min(half, len(x) - half + 1)
        width = x[half - 1 : half - 1 + last] - x[:last]
        at = int(width.argmin())
        x = x[at : at + half]
    if len(x) == 3:
        left, right = x[1] - x[0], x[2] - x[1]
        if left < right:
            return float(x[:2].mean())
        return float(x[1:].mean()) if fixed and right < left else float(x[1])
    return float(x.mean()) if len(x) else float("nan")


def shift(image: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """The image moved by (dx, dy), bilinear, 0 outside."""
    h, w = image.shape
    y, x = np.arange(h) - dy, np.arange(w) - dx
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    padded = np.zeros((h + 2, w + 2))
    padded[1:-1, 1:-1] = image
    at = lambda a, n: np.clip(a + 1, 0, n + 1)
    r0, r1, c0, c1 = at(y0, h), at(y0 + 1, h), at(x0, w), at(x0 + 1, w)
    return (1 - fy) * ((1 - fx) * padded[np.ix_(r0, c0)] + fx * padded[np.ix_(r0, c1)]) + fy * ((1 - fx) * padded[np.ix_(r1, c0)] + fx * padded[np.ix_(r1, c1)])


def response(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation of a template at all places in an image."""
    windows = np.lib.stride_tricks.sliding_window_view(image.astype(float), template.shape)
    top = np.einsum("abij,ij->ab", windows, template)
    energy = np.einsum("abij,abij->ab", windows, windows) * np.square(template).sum()
    return np.divide(top, np.sqrt(energy), out=np.zeros_like(top), where=energy > 0)


def register(image: np.ndarray, template: np.ndarray, my: int, mx: int) -> tuple[float, float, float, float]:
    """(x, y, mean response, peak) that move an image onto a template (whole-size) within my, mx pixels."""
    h, w = template.shape
    r = response(image, template[my : h - my or None, mx : w - mx or None].astype(float))
    i, j = np.unravel_index(r.argmax(), r.shape)

    def fine(a: float, b: float, c: float) -> float:
        if min(a, b, c) <= 0:
            return 0.0
        a, b, c = np.log([a, b, c])
        under = 2 * a - 4 * b + 2 * c
        return (a - c) / under if under else 0.0

    inside = 0 < i < 2 * my - 1 and 0 < j < 2 * mx - 1
    dy, dx = i - my, j - mx
    if inside:
        dy, dx = dy + fine(r[i - 1, j], r[i, j], r[i + 1, j]), dx + fine(r[i, j - 1], r[i, j], r[i, j + 1])
    return -float(dx), -float(dy), float(r.mean()), float(r.max())


def gaussian(image: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Gaussian smoothing, edges mirrored with the edge repeated."""
    if sigma <= 0:
        return image.astype(float)
    n = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(image, [(n, n) if a == axis else (0, 0) for a in (0, 1)], "symmetric")
        image = np.apply_along_axis(np.convolve, axis, padded, k, "valid")
    return image


def _neighbours(image: np.ndarray) -> np.ndarray:
    p = np.pad(image, 1, "symmetric")
    return np.stack([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])


def erode(image: np.ndarray) -> np.ndarray:
    return _neighbours(image).min(0)


def dilate(image: np.ndarray) -> np.ndarray:
    return _neighbours(image).max(0)


def label(mask: np.ndarray, near: list[tuple[int, int]]) -> tuple[np.ndarray, int]:
    """Connected regions numbered from 1 in the order of their first pixel."""
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        out[start], stack = n, [start]
        while stack:
            y, x = stack.pop()
            for dy, dx in near:
                q = (y + dy, x + dx)
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not out[q]:
                    out[q] = n
                    stack.append(q)
    return out, n


def perimeter(mask: np.ndarray) -> float:
    """Length of a region's border: border pixels weighted by how their border neighbours lie (1, sqrt 2, and their mean)."""
    m = np.pad(mask.astype(bool), 1)
    edge = m & ~(m[:, :] & np.pad(erode(m.astype(int)).astype(bool)[1:-1, 1:-1], 1))
    e = edge.astype(int)
    p = np.pad(e, 1)
    side = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]
    corner = p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]
    code = np.where(edge, 1 + 2 * side + 10 * corner, 0)
    straight = np.isin(code, [5, 7, 15, 17, 25, 27])
    diagonal = np.isin(code, [21, 33])
    mixed = np.isin(code, [13, 23])
    return float(straight.sum() + np.sqrt(2) * diagonal.sum() + (1 + np.sqrt(2)) / 2 * mixed.sum())


def circularity(mask: np.ndarray) -> float:
    p = perimeter(mask)
    return float(4 * np.pi * mask.sum() / p**2) if p else float("nan")


def component_regions(c: np.ndarray, n_std: float = 3, sigma: float = 2, area: tuple[int, int] = (25, -1), circ: tuple[float, float] = (0, 1)) -> list[np.ndarray]:
    """Masks of a component image: smoothed, beyond n_std deviations from the mean, 8-connected, with area and circularity in limits."""
    s = gaussian(c, sigma)
    lab, n = label(np.abs(s - s.mean()) > n_std * s.std(), EIGHT)
    out = [lab == k for k in range(1, n + 1)]
    out = [m for m in out if m.sum() >= area[0] and (area[1] < 0 or m.sum() <= area[1])]
    return [m for m in out if circ[0] <= min(circularity(m), 1e9) <= circ[1] or circ == (0, 1)]


def refine_region(r: np.ndarray, mask: np.ndarray, n_std: float = 1.0) -> np.ndarray | None:
    """A region redrawn from its correlation image, or None where its area leaves 0.5 to 3.5 times the old one."""
    clean = lambda a: dilate(erode(gaussian(a, 0.2)))
    s = clean(r)
    inside = s[mask]
    lab, n = label(clean((s > inside.mean() - n_std * inside.std()).astype(float)) > 0.5, FOUR)
    if not n:
        return None
    best = max(range(1, n + 1), key=lambda k: ((lab == k) & mask).sum())
    new = lab == best
    return new if 0.5 * mask.sum() <= new.sum() <= 3.5 * mask.sum() else None


def resize(image: np.ndarray, factor: float, order: int = 1) -> np.ndarray:
    """An image sampled at round(size * factor) places from corner to corner; order 0 nearest, 1 linear, 2 smooth (Catmull-Rom)."""
    for axis in (0, 1):
        n = image.shape[axis]
        m = max(1, round(n * factor))
        at = np.linspace(0, n - 1, m)
        i, f = np.floor(at).astype(int), at - np.floor(at)
        g = lambda k: np.take(image, np.clip(k, 0, n - 1), axis)  # noqa: E731, B023
        f = f.reshape([-1, 1] if axis == 0 else [1, -1])
        if order == 0:
            image = g(np.rint(at).astype(int))
        elif order == 1:
            image = g(i) * (1 - f) + g(i + 1) * f
        elif order == 2:
            a, b, c, d = g(i - 1), g(i), g(i + 1), g(i + 2)
            image = b + 0.5 * f * (c - a + f * (2 * a - 5 * b + 4 * c - d + f * (3 * (b - c) + d - a)))
        else:
            raise ValueError("order must be 0, 1 or 2")
    return image


def magic_wand(image: np.ndarray, cy: int, cx: int, r_min: int, r_max: int, roughness: float = 1.0) -> np.ndarray:
    """Mask of the cell around a seed: the bright edge is followed in polar coordinates with one step of look-ahead."""
    n = int(2 * np.pi * r_max * roughness)
    radii, angles = np.arange(r_min, r_max), np.linspace(0, 2 * np.pi, n)
    ys, xs = np.rint(np.outer(radii, np.cos(angles)) + cy).astype(int), np.rint(np.outer(radii, np.sin(angles)) + cx).astype(int)
    ok = (ys >= 0) & (ys < image.shape[0]) & (xs >= 0) & (xs < image.shape[1])
    polar = np.where(ok, image[np.clip(ys, 0, image.shape[0] - 1), np.clip(xs, 0, image.shape[1] - 1)], 0.0)
    # the edge path: from the outermost of the brightest first steps, each angle goes to the brightest of the three radii within
    # one of the last (nothing is darker than beyond the range; of equals the outer one), kept within the range
    rim = np.pad(polar, ((1, 1), (0, 1)))
    near = np.lib.stride_tricks.sliding_window_view(rim, 3, axis=0)  # [radius, angle]: the radii within one
    first = polar[:, 0] + near[:, 1].max(1)
    edge = np.full(n, np.flatnonzero(first == first.max())[-1])
    for k in range(1, n):
        outward = near[edge[k - 1], k][::-1]
        edge[k] = min(max(edge[k - 1] + 1 - int(outward.argmax()), 0), len(radii) - 1)
    yy, xx = np.mgrid[: image.shape[0], : image.shape[1]]
    dist, angle = np.hypot(yy - cy, xx - cx), np.arctan2(xx - cx, yy - cy) % (2 * np.pi)
    return dist <= radii[edge[np.rint(angle / (2 * np.pi) * (n - 1)).astype(int)]]


def fast_ica(x: np.ndarray, iterations: int = 500, tol: float = 1e-3, seed: int = 0) -> np.ndarray:
    """Independent sources of the columns of x by symmetric fixed-point iteration with the log-cosh contrast."""
    x = x - x.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    keep = s > 1e-10 * s[0]
    z = (u[:, keep] * np.sqrt(len(x))).T
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(z), len(z))))[0]
    for _ in range(iterations):
        g = np.tanh(w @ z)
        new = g @ z.T / z.shape[1] - np.diag((1 - g**2).mean(1)) @ w
        a, _, b = np.linalg.svd(new)
        new = a @ b
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < tol
        w = new
        if done:
            break
    return (w @ z).T


def nmf(y: np.ndarray, k: int, iterations: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(space, time): non-negative factors of y less its 1st percentile, by multiplicative updates."""
    y = np.maximum(y - np.percentile(y, 1), 0)
    rng = np.random.default_rng(seed)
    a, b = rng.random((y.shape[0], k)) + 0.1, rng.random((k, y.shape[1])) + 0.1
    for _ in range(iterations):
        b *= (a.T @ y) / (a.T @ a @ b + 1e-12)
        a *= (y @ b.T) / (a @ (b @ b.T) + 1e-12)
    return a, b


def autocovariance(y: np.ndarray, lags: int) -> np.ndarray:
    """Biased autocovariance at lags 0..lags."""
    d = y - y.mean()
    return np.array([d[: len(d) - k] @ d[k:] for k in range(lags + 1)]) / len(d)


def noise(y: np.ndarray, band: tuple[float, float] = (0.25, 0.5), method: str = "mean") -> float:
    """Noise deviation from the power spectrum (averaged half-overlapping Hann segments) in a band of frequencies."""
    n = min(256, len(y))
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = n - n // 2
    seg = np.stack([y[s : s + n] for s in range(0, len(y) - n + 1, step)])
    power = np.abs(np.fft.rfft((seg - seg.mean(1, keepdims=True)) * win)) ** 2 / np.square(win).sum()
    power[:, 1 : -1 if n % 2 == 0 else None] *= 2
    f, p = np.fft.rfftfreq(n), power.mean(0)
    p = p[(f > band[0]) & (f < band[1])] / 2
    if method == "mean":
        return float(np.sqrt(p.mean()))
    if method == "median":
        return float(np.sqrt(np.median(p)))
    if method == "logmexp":
        return float(np.sqrt(np.exp(np.log(p + 1e-10).mean())))
    raise ValueError("method must be mean, median or logmexp")


def ar_coefficients(y: np.ndarray, p: int, sn: float, lags: int = 5, fudge: float = 1.0) -> np.ndarray:
    """Autoregressive coefficients from the autocovariance; roots are kept in 0..1."""
    n = lags + p
    a = autocovariance(y, n)
    rows = np.array([[a[abs(i - j)] for j in range(p)] for i in range(n)]) - sn**2 * np.eye(n, p)
    g = np.linalg.lstsq(rows, a[1 : n + 1], rcond=None)[0]
    roots = np.roots(np.concatenate([[1], -g])).real
    roots = np.where(roots > 1, 0.95, np.where(roots < 0, 0.15, roots)) * fudge
    return -np.poly(roots)[1:]


def contour(mask: np.ndarray) -> np.ndarray:
    """Border pixels (y, x) of the region that holds the mask's first pixel, in the order of a walk around it, clockwise, each step to a neighbour.

    The walk leaves a pixel for the first region pixel that a turn around it meets, beginning behind the way it came,
    until it would repeat its first step.
    """
    ring = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]  # clockwise from the left
    inside = np.pad(mask.astype(bool), 1)
    if not inside.any():
        return np.zeros((0, 2), int)
    start = tuple(int(v[0]) for v in np.nonzero(inside))
    out, here, came, first = [start], start, 0, None
    while True:
        turn = next((k % 8 for k in range(came, came + 8) if inside[here[0] + ring[k % 8][0], here[1] + ring[k % 8][1]]), None)
        if turn is None or (here, turn) == first:
            break
        first = first or (here, turn)
        here = (here[0] + ring[turn][0], here[1] + ring[turn][1])
        out.append(here)
        came = (turn + 6) % 8 if turn % 2 == 0 else (turn + 5) % 8
    walk = np.array(out) - 1
    return walk[:-1] if len(walk) > 1 and (walk[0] == walk[-1]).all() else walk


def equalize(image: np.ndarray, tiles: int = 8, clip: float = 2.0, bins: int = 256) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of an image in 0..1.

    Each tile's histogram is cut at clip times its mean and the excess spread evenly; a pixel takes the value that the
    mappings of the four nearest tiles give it, weighted by distance.
    """
    h, w = image.shape
    ys, xs = (np.linspace(0, n, min(tiles, n) + 1).astype(int) for n in (h, w))
    level = np.clip((image * bins).astype(int), 0, bins - 1)
    maps = np.zeros((len(ys) - 1, len(xs) - 1, bins))
    for i in range(len(ys) - 1):
        for j in range(len(xs) - 1):
            count = np.bincount(level[ys[i] : ys[i + 1], xs[j] : xs[j + 1]].ravel(), minlength=bins).astype(float)
            most = max(1.0, clip * count.sum() / bins)
            count = np.minimum(count, most) + np.maximum(count - most, 0).sum() / bins
            maps[i, j] = count.cumsum() / count.sum()

    def between(edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mid = (edges[1:] + edges[:-1] - 1) / 2
        at = np.interp(np.arange(n), mid, np.arange(len(mid)))
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, len(mid) - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = between(ys, h), between(xs, w)
    fy, fx = fy[:, None], fx[None, :]
    g = lambda a, b: maps[a[:, None], b[None, :], level]
    return (1 - fy) * ((1 - fx) * g(y0, x0) + fx * g(y0, x1)) + fy * ((1 - fx) * g(y1, x0) + fx * g(y1, x1))
