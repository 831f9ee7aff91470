"""Every query with SQL equals it at sf0.01; those without have properties that hold."""

from __future__ import annotations

import pytest

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from gridtrail import fixtures, params
from gridtrail.operators import shapes
from gridtrail.plans import oracles, queries

from .compare import connect, rows_of_df, rows_of_sql
from .conftest import SF

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    names, rows = rows_of_df(queries.queries()[name](spark, SF))
    sql_names, sql_rows = rows_of_sql(connect(SF), SQL[name])
    assert names == sql_names
    assert rows == sql_rows
    assert rows


def test_tracks_properties(spark):
    seen = [r.asDict() for r in queries.tracks(spark, SF).collect()]
    regions = queries.region_stats(spark, SF).count()
    assert len({(r["orbit"], r["frame"], r["label"]) for r in seen}) == len(seen) <= regions
    assert len({(r["Track_ID"], r["frame"]) for r in seen}) == len(seen)
    births = sorted({(r["orbit"], r["birth_frame"], r["tile_row"], r["tile_col"], r["birth_label"], r["Track_ID"]) for r in seen})
    assert [b[-1] for b in births] == list(range(1, len(births) + 1))
    assert all((r["Total_Cost"] is None) == (r["frame"] == r["birth_frame"]) for r in seen)


def test_traced_areas_are_cell_counts(spark):
    areas = {(r["scene_id"], r["label"]): r["n"] for r in queries.connected_components(spark, SF).groupBy("scene_id", "label").count().withColumnRenamed("count", "n").collect()}
    for r in queries.traced_polygons(spark, SF).collect():
        whole = areas[r["scene_id"], r["label"]]
        assert r["geom_area"] < whole if r["multipolygon"] else r["geom_area"] == whole


def quartile(values, kind):
    """The 75th percentile by linear interpolation, with its floor; the default of an empty pool."""
    if not values:
        return params.NORMALISER_DEFAULTS[kind]
    values, at = sorted(values), 0.75 * (len(values) - 1)
    low = values[math.floor(at)]
    return max(low + (values[math.ceil(at)] - low) * (at - math.floor(at)), params.NORMALISER_FLOORS[kind])


def one_to_one(costs, n, m):
    """All pairings of rows with columns by dict (row, column) -> cost: most pairs first, then the least sum; the pairs and the sum."""
    best = (0, 0.0, ())
    for size in range(min(n, m), 0, -1):
        for rows in itertools.combinations(range(n), size):
            for cols in itertools.permutations(range(m), size):
                pairs = tuple(zip(rows, cols, strict=True))
                if all(x in costs for x in pairs):
                    total = sum(costs[x] for x in pairs)
                    if (-size, total) < (-best[0], best[1]):
                        best = (size, total, pairs)
        if best[0]:
            break
    return best[2]


def brute_tracks(regions, last_frame):
    """{(orbit, frame, label): (birth frame, birth label, total cost)} by the rules of tracking, region by region.

    regions: rows of orbit, tile, frame, label, cx, cy, area, box, cells (set of (row, col)), axis, hu.
    """
    out = {}
    filled = {o: {r["frame"] for r in regions if r["orbit"] == o} for o in last_frame}

    def gated(r, q):
        if abs(r["area"] - q["area"]) / max(q["area"], 1) > 0.5:
            return None
        (a0, b0, a1, b1), (c0, d0, c1, d1) = r["box"], q["box"]
        window = {(y, x) for y in range(max(b0, d0), min(b1, d1)) for x in range(max(a0, c0), min(a1, c1))}
        both, either = r["cells"] & q["cells"] & window, (r["cells"] | q["cells"]) & window
        cost = 1 - (len(both) / len(either) if either else 0.0)
        return None if cost > 0.99 else cost

    def contour(r, q):
        return None if r["hu"] is None or q["hu"] is None else sum(abs(x - y) for x, y in zip(r["hu"], q["hu"], strict=True) if x is not None and y is not None)

    for orbit, tile in sorted({(r["orbit"], r["tile"]) for r in regions}):
        tracks = []  # [birth frame, birth label, last region, frames missed]
        for t in range(1, last_frame[orbit] + 1):
            if t > 1 and (t not in filled[orbit] or t - 1 not in filled[orbit]):
                continue
            here = lambda at: sorted((r for r in regions if r["orbit"] == orbit and r["tile"] == tile and r["frame"] == at), key=lambda r: r["label"])  # noqa: E731, B023
            now, before = here(t), here(t - 1)
            if not now:
                continue
            active, hits = [x for x in tracks if x[3] <= 1], {}
            if active:
                pool = [(c, r, q) for r in now for q in before if (c := gated(r, q)) is not None]
                na, nx = quartile([c for c, _, _ in pool], "area"), quartile([abs(r["axis"] - q["axis"]) for _, r, q in pool], "axis")
                nc = quartile([d for _, r, q in pool if (d := contour(r, q)) is not None], "contour")
                costs = {}
                for i, r in enumerate(now):
                    for j, x in enumerate(active):
                        q = x[2]
                        far = math.dist((r["cx"], r["cy"]), (q["cx"], q["cy"]))
                        c = gated(r, q)
                        if far <= 10 and c is not None:
                            d = contour(r, q)
                            w = params.COST_WEIGHTS
                            costs[i, j] = sum(a * b for a, b in zip(w.values(), (far, c / na, abs(r["axis"] - q["axis"]) / nx, (10.0 if d is None else min(d, 100.0)) / nc), strict=True))
                for i, j in one_to_one(costs, len(now), len(active)):
                    hits[i] = j
                    active[j][2], active[j][3] = now[i], 0
                    out[orbit, t, now[i]["label"]] = (active[j][0], active[j][1], costs[i, j])
                for j, x in enumerate(active):
                    x[3] += j not in hits.values()
            for i, r in enumerate(now):
                if i not in hits:
                    tracks.append([t, r["label"], r, 0])
                    out[orbit, t, r["label"]] = (t, r["label"], None)
    return out


def test_tracks_equal_brute_force(spark):
    cells, features = {}, {}
    for r in fixtures.component_pixels(spark, SF).collect():
        cells.setdefault((r.orbit, r.frame, r.label, r.scene_id), set()).add((r.row, r.col))
    for r in shapes.described(fixtures.component_pixels(spark, SF).select("scene_id", "row", "col", "label"), ["scene_id"]).collect():
        features[r.scene_id, r.label] = (r.axis, r.hu)
    regions = []
    for (orbit, frame, label, scene), found in cells.items():
        if len(found) < 3:
            continue
        rows, cols = [y for y, _ in found], [x for _, x in found]
        cx, cy = sum(cols) / len(found), sum(rows) / len(found)
        axis, hu = features[scene, label]
        regions.append({"orbit": orbit, "frame": frame, "label": label, "tile": (min(int(cy // 4), 1), min(int(cx // 4), 1)), "cx": cx, "cy": cy, "area": len(found), "box": (min(cols), min(rows), max(cols) + 1, max(rows) + 1), "cells": found, "axis": axis, "hu": hu})
    last = {r.orbit: r.last for r in fixtures.scenes(spark, SF).groupBy("orbit").agg(F.max("frame").alias("last")).collect()}
    want = brute_tracks(regions, last)
    got = {(r.orbit, r.frame, r.label): (r.birth_frame, r.birth_label, r.Total_Cost) for r in queries.tracks(spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 500
    assert sum(v[2] is not None for v in want.values()) > 100
    for k, (frame, label, cost) in want.items():
        assert got[k][:2] == (frame, label), k
        assert (got[k][2] is None) == (cost is None) and (cost is None or abs(got[k][2] - cost) < 1e-5), k


def complex_moments(points):
    """The seven invariants of a polygon from its complex moments, integrated over triangles."""
    z = np.array([complex(x, y) for x, y in points])
    nodes, weights = np.polynomial.legendre.leggauss(6)
    u, w = (nodes + 1) / 2, weights / 2
    area, pieces = 0.0, []
    for a, b in zip(z, np.roll(z, -1), strict=True):
        double = (a.conjugate() * b).imag  # twice the signed area of (0, a, b)
        at = u[:, None] * (a + u[None, :] * (b - a))
        pieces.append((at.ravel(), (double * w[:, None] * w[None, :] * u[:, None]).ravel()))
        area += double / 2
    if abs(area) < 1e-12:
        return None
    at, weight = np.concatenate([p for p, _ in pieces]), np.concatenate([q for _, q in pieces]) * np.sign(area)
    centre = (at * weight).sum() / abs(area)
    c = lambda p, q: ((at - centre) ** p * np.conjugate(at - centre) ** q * weight).sum() / abs(area) ** (1 + (p + q) / 2)
    return [c(1, 1).real, abs(c(2, 0)) ** 2, abs(c(3, 0)) ** 2, abs(c(2, 1)) ** 2, (c(3, 0) * c(1, 2) ** 3).real, (c(2, 0) * c(1, 2) ** 2).real, (c(3, 0) * c(1, 2) ** 3).imag]


def ellipse_ratio(points):
    """Major to minor axis of the direct least-squares ellipse, from the full 6 x 6 eigenproblem; None where there is none."""
    p = np.array(points, dtype=float)
    p = (p - p.mean(axis=0)) / max(np.abs(p - p.mean(axis=0)).max(), 1e-12)
    x, y = p.T
    d = np.stack([x * x, x * y, y * y, x, y, np.ones_like(x)], axis=1)
    s, c = d.T @ d, np.zeros((6, 6))
    c[0, 2] = c[2, 0] = 2
    c[1, 1] = -1
    if np.linalg.cond(s) > 1e12:
        return None
    values, vectors = np.linalg.eig(np.linalg.solve(s, c))
    a, b, e = np.real(vectors[:, int(np.argmax(np.real(values)))])[:3]
    small, large = np.linalg.eigvalsh(np.array([[a, b / 2], [b / 2, e]]) * np.sign(a + e))
    return math.sqrt(large / small) if small > 1e-9 else None


def test_shapes_equal_brute_force(spark):
    cells = {}
    for r in fixtures.component_pixels(spark, SF).collect():
        cells.setdefault((r.scene_id, r.label), set()).add((r.col, r.row))
    checked = ratios = 0
    for r in shapes.described(fixtures.component_pixels(spark, SF).select("scene_id", "row", "col", "label"), ["scene_id"]).collect():
        own = cells[r.scene_id, r.label]
        x0, y0 = min(x for x, _ in own), min(y for _, y in own)
        inside = {(x - x0, y - y0) for x, y in own}
        contour = [(p.x, p.y) for p in r.contour]
        # the outside is what can be reached from beyond the box, by its four neighbours; border cells touch it
        wide, high = max(x for x, _ in inside) + 1, max(y for _, y in inside) + 1
        outside, todo = {(-1, -1)}, [(-1, -1)]
        while todo:
            x, y = todo.pop()
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if -1 <= n[0] <= wide and -1 <= n[1] <= high and n not in inside and n not in outside:
                    outside.add(n)
                    todo.append(n)
        border = {(x, y) for x, y in inside if {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & outside}
        walked = set()
        for (ax, ay), (bx, by) in zip(contour, [*contour[1:], *contour[:1]], strict=True):
            steps = max(abs(bx - ax), abs(by - ay), 1)
            walked |= {(ax + (bx - ax) * k // steps, ay + (by - ay) * k // steps) for k in range(steps + 1)}
        assert walked == border, (r.scene_id, r.label)
        smooth = [(p.x, p.y) for p in r.smooth_contour]
        if len(contour) < 5:
            assert smooth == contour
        else:
            for j, point in enumerate(smooth):
                for i, v in enumerate(point):
                    five = sum(contour[k][i] for k in range(max(0, j - 2), min(len(contour), j + 3)))
                    assert v == five // 5 or (five % 5 == 0 and v == five // 5 - 1)  # a mean of a whole number may fall short of it in floats
        want = complex_moments(smooth)
        if want is None:
            assert r.hu == [None] * 7
        else:
            for h, w in zip(r.hu, want, strict=True):
                if abs(abs(w) - 1e-5) > 1e-9:
                    assert (h is None) == (abs(w) <= 1e-5) and (h is None or abs(h - math.copysign(math.log10(abs(w)), math.copysign(1, w) * math.log10(abs(w)))) < 1e-6)
            checked += 1
        ratio = ellipse_ratio(contour) if len(contour) >= 5 else 1.0
        if ratio is not None and ratio < 50:
            assert abs(r.axis - ratio) < 1e-4 * ratio, (r.scene_id, r.label, r.axis, ratio)
            ratios += len(contour) >= 5
    assert checked > 50 and ratios > 50
