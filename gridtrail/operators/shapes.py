"""Shape features of components: outer contour, smoothing, ellipse axis ratio, Hu moments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dealt, ship

#: The eight neighbours clockwise from the right, as (dx, dy), y downwards.
COMPASS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def outer_contour(mask: np.ndarray) -> np.ndarray:
    """Border cells (x, y) of the component of a mask's first cell, followed once round, straight runs cut to their ends."""
    rows, cols = np.nonzero(mask)
    if not len(rows):
        return np.empty((0, 2), dtype=np.int32)
    solid = lambda x, y: 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x]
    start = (int(cols[0]), int(rows[0]))
    path, way = [start], 0
    here, first_step = start, None
    while True:
        # turn from the background side: two steps back from where we came, then clockwise
        for k in range(8):
            d = (way + 6 + k) % 8
            x, y = here[0] + COMPASS[d][0], here[1] + COMPASS[d][1]
            if solid(x, y):
                break
        else:
            return np.array(path, dtype=np.int32)  # a single cell
        if here == start:
            if first_step is None:
                first_step = d
            elif d == first_step:
                break
        here, way = (x, y), d
        path.append(here)
    path.pop()
    points = np.array(path, dtype=np.int32)
    if len(points) < 3:
        return points
    before, after = points - np.roll(points, 1, axis=0), np.roll(points, -1, axis=0) - points
    return points[np.any(before != after, axis=1)]


def components_of(mask: np.ndarray) -> list[np.ndarray]:
    from .labels import label_mask

    rows, cols, names = label_mask(mask)
    out = []
    for name in np.unique(names):
        one = np.zeros_like(mask, dtype=bool)
        one[rows[names == name], cols[names == name]] = True
        out.append(one)
    return out


def polygon_area(points: np.ndarray) -> float:
    """Shoelace area of a closed sequence of points."""
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def largest_contour(mask: np.ndarray) -> np.ndarray | None:
    """The outer contour of largest area; None for an empty mask."""
    found = [outer_contour(m) for m in components_of(mask)]
    return max(found, key=polygon_area) if found else None


def smooth_contour(points: np.ndarray | None, k: int = 5) -> np.ndarray | None:
    """Moving average with zeros beyond both ends, cut to integers; fewer than k points stay."""
    if points is None or len(points) < k:
        return points
    kernel = np.full(k, 1 / k)
    return np.stack([np.convolve(points[:, i], kernel, mode="same") for i in (0, 1)], axis=1).astype(np.int32)


def axis_ratio(points: np.ndarray | None) -> float:
    """Major to minor axis of the least-squares ellipse (Fitzgibbon et al. 1999); 1 for fewer than 5 points.

    Points that have no ellipse (all on a line) give the ratio of their spreads, minor axis 1e-5 at least.
    """
    if points is None or len(points) < 5:
        return 1.0
    p = points.astype(float)
    p = p - p.mean(axis=0)
    size = max(float(np.abs(p).max()), 1e-12)
    x, y = p[:, 0] / size, p[:, 1] / size
    quadratic = np.stack([x * x, x * y, y * y], axis=1)
    linear = np.stack([x, y, np.ones_like(x)], axis=1)
    s1, s2, s3 = quadratic.T @ quadratic, quadratic.T @ linear, linear.T @ linear
    try:
        t = -np.linalg.solve(s3, s2.T)
        m = s1 + s2 @ t
        m = np.array([m[2] / 2, -m[1], m[0] / 2])
        _, vectors = np.linalg.eig(m)
        vectors = np.real(vectors)
        kind = 4 * vectors[0] * vectors[2] - vectors[1] ** 2
        a, b, c = vectors[:, int(np.argmax(kind > 0))] if (kind > 0).any() else (0.0, 0.0, 0.0)
        low, high = np.linalg.eigvalsh(np.array([[a, b / 2], [b / 2, c]]) * np.sign(a + c))
        if low > 1e-12:
            return float(np.sqrt(high / low))
    except np.linalg.LinAlgError:
        pass
    spread = np.sqrt(np.maximum(np.linalg.eigvalsh(np.cov(p.T)), 0))
    return float(spread[1] / max(spread[0], 1e-5))


def hu_moments(points: np.ndarray | None) -> list[float | None] | None:
    """sign(h) * log10 |h| of the seven Hu moments of the polygon; None for those near 0, and without a contour."""
    if points is None or not len(points):
        return None
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    nx, ny = np.roll(x, -1), np.roll(y, -1)
    cross = x * ny - nx * y
    m = {}
    # integrals of x**p y**q over the polygon by Green's theorem, exact for three Gauss points an edge
    nodes, weights = np.polynomial.legendre.leggauss(3)
    for p in range(4):
        for q in range(4 - p):
            total = 0.0
            for node, weight in zip((nodes + 1) / 2, weights / 2, strict=True):
                px, py = x + node * (nx - x), y + node * (ny - y)
                total += weight * float(np.sum(px**p * py**q * cross))
            m[p, q] = total / (p + q + 2)
    if m[0, 0] < 0:
        m = {k: -v for k, v in m.items()}
    if m[0, 0] <= 1e-12:
        return [None] * 7
    cx, cy = m[1, 0] / m[0, 0], m[0, 1] / m[0, 0]
    mu20, mu02, mu11 = m[2, 0] - cx * m[1, 0], m[0, 2] - cy * m[0, 1], m[1, 1] - cx * m[0, 1]
    mu30 = m[3, 0] - 3 * cx * m[2, 0] + 2 * cx**2 * m[1, 0]
    mu03 = m[0, 3] - 3 * cy * m[0, 2] + 2 * cy**2 * m[0, 1]
    mu21 = m[2, 1] - 2 * cx * m[1, 1] - cy * m[2, 0] + 2 * cx**2 * m[0, 1]
    mu12 = m[1, 2] - 2 * cy * m[1, 1] - cx * m[0, 2] + 2 * cy**2 * m[1, 0]
    n2, n3 = m[0, 0] ** 2, m[0, 0] ** 2.5
    a20, a02, a11 = mu20 / n2, mu02 / n2, mu11 / n2
    a30, a03, a21, a12 = mu30 / n3, mu03 / n3, mu21 / n3, mu12 / n3
    s, t, u, v = a30 + a12, a21 + a03, a30 - 3 * a12, 3 * a21 - a03
    hu = (
        a20 + a02, (a20 - a02) ** 2 + 4 * a11**2, u * u + v * v, s * s + t * t,
        u * s * (s * s - 3 * t * t) + v * t * (3 * s * s - t * t),
        (a20 - a02) * (s * s - t * t) + 4 * a11 * s * t,
        v * s * (s * s - 3 * t * t) - u * t * (3 * s * s - t * t),
    )
    return [float(np.sign(h) * np.log10(abs(h))) if abs(h) > 1e-5 else None for h in hu]


def described(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """axis (ratio), contour, smooth_contour and hu of each component of a pixel relation (row, col, label)."""
    ship(pixels.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    point = "array<struct<x:int,y:int>>"
    names = [*keys, "label"]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["axis double", f"contour {point}", f"smooth_contour {point}", "hu array<double>"])
    cells = dealt(pixels, *names).groupBy(*names).agg(F.collect_list("row").alias("rows"), F.collect_list("col").alias("cols"))

    def run(batches):
        for batch in batches:
            made = []
            for rows, cols in zip(batch["rows"], batch["cols"], strict=True):
                mask = np.zeros((max(rows) - min(rows) + 1, max(cols) - min(cols) + 1), dtype=bool)
                mask[np.asarray(rows) - min(rows), np.asarray(cols) - min(cols)] = True
                contour = largest_contour(mask)
                smooth = smooth_contour(contour)
                as_rows = lambda p: [{"x": int(x), "y": int(y)} for x, y in p]
                made.append((axis_ratio(contour), as_rows(contour), as_rows(smooth), hu_moments(smooth)))
            columns = list(zip(*made, strict=True)) or [[]] * 4
            yield pd.DataFrame({**{c: batch[c] for c in names}, **dict(zip(("axis", "contour", "smooth_contour", "hu"), map(list, columns), strict=True))})

    return cells.mapInPandas(run, schema)
