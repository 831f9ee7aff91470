"""Tracks: least-cost one-to-one assignment and the frame-by-frame tracker of one tile.

The tracker is sequential in time but independent between tiles, so it runs as one grouped map by
(orbit, tile); track numbers are given afterwards by birth, without a single task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..session import dealt, ship
from ..storage import Scratch
from .graph import numbered


#: Sets of used columns that are followed at once where pairings tie.
TIED = 4096


def _solved(cost: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """assigned(), and the prices of rows and columns: no pair costs less than its two, up to rounding."""
    flipped = cost.shape[0] > cost.shape[1]
    c = np.asarray(cost.T if flipped else cost, dtype=float)
    n, m = c.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        least, came = np.full(m, np.inf), np.full(m, -1)
        seen = np.zeros(m, dtype=bool)
        row, last, reached = start, -1, 0.0
        while True:
            slack = reached + c[row] - u[row] - v
            better = ~seen & (slack < least)
            least[better], came[better] = slack[better], last
            at = int(np.argmin(np.where(seen, np.inf, least)))
            reached = least[at]
            seen[at] = True
            last = at
            if row_of[at] < 0:
                break
            row = int(row_of[at])
        done = seen.copy()
        done[last] = False
        u[start] += reached
        for j in np.flatnonzero(done):
            u[row_of[j]] += reached - least[j]
            v[j] -= reached - least[j]
        while last >= 0:  # flip the path
            before = int(came[last])
            row_of[last] = row_of[before] if before >= 0 else start
            last = before
    pairs = [(int(row_of[j]), j) for j in range(m) if row_of[j] >= 0]
    return (sorted((b, a) for a, b in pairs), v, u) if flipped else (sorted(pairs), u, v)


def assigned(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, as many as the smaller side; shortest augmenting paths."""
    return _solved(cost)[0] if cost.size else []


def match(costs: np.ndarray) -> list[tuple[int, int]]:
    """assigned() without forbidden pairs: most pairs first, then least cost."""
    return [(i, j) for i, j in assigned(np.where(np.isfinite(costs), costs, params.FORBIDDEN)) if costs[i, j] < params.FORBIDDEN]


def settled(costs: np.ndarray) -> list[tuple[int, int]]:
    """match() with ties settled: most pairs, then the least sum in doubles, added in the order of rows, then the first pairs.

    Pairings whose sums differ by rounding only are made of pairs that cost their prices. They are followed
    row by row, one for each set of columns that later rows may still want; with more than TIED such sets
    the solver's own pairing is returned, whose sum is the least but for rounding.
    """
    if costs.size == 0:
        return []
    table = np.where(np.isfinite(costs), costs, params.FORBIDDEN)
    (n, m), (found, u, v) = table.shape, _solved(table)
    found = [(i, j) for i, j in found if table[i, j] < params.FORBIDDEN]
    room = 1e-14 * params.FORBIDDEN * (n + m)
    tight, real = table - u[:, None] - v[None, :] <= room, table < params.FORBIDDEN
    alone = (tight & ~real).any(axis=1) | ((n > m) & (u >= -room))
    options = [frozenset(np.flatnonzero(x).tolist()) for x in tight & real]
    if all(len(x) + a == 1 for x, a in zip(options, alone, strict=True)):
        return found
    later = [frozenset()]
    for x in options[:0:-1]:
        later.append(later[-1] | x)
    states = {(frozenset(), 0): [(0.0, ())]}
    for i, wanted in enumerate(reversed(later)):
        after: dict = {}
        for (used, without), paths in states.items():
            if alone[i] and without < n - len(found):
                after.setdefault((used & wanted, without + 1), []).extend(paths)
            for j in options[i] - used:
                after.setdefault(((used | {j}) & wanted, without), []).extend((total + float(table[i, j]), (*path, (i, j))) for total, path in paths)
        if not 0 < len(after) <= TIED:
            return found
        states = {}
        for key, paths in after.items():  # a larger sum may still come to the same by rounding, and win by its pairs
            kept = states[key] = []
            for total, path in sorted(paths):
                if not kept or path < kept[-1][1]:
                    kept.append((total, path))
    return list(min(x for paths in states.values() for x in paths)[1])


def matched_pairs(pairs: DataFrame, keys: list[str], cost: str = "cost") -> DataFrame:
    """One-to-one pairs of each group of candidate pairs (cur_label, prev_label, cost), ties settled by the labels."""
    ship(pairs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys, "cur_label", "prev_label", cost).schema.fields)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.unique(group["cur_label"]), np.unique(group["prev_label"])
        table = np.full((len(rows), len(cols)), params.FORBIDDEN)
        table[np.searchsorted(rows, group["cur_label"]), np.searchsorted(cols, group["prev_label"])] = group[cost]
        found = settled(table)
        out = pd.DataFrame({"cur_label": [rows[i] for i, _ in found], "prev_label": [cols[j] for _, j in found], cost: [table[i, j] for i, j in found]})
        for k in keys:
            out[k] = group[k].iloc[0]
        return out[[*keys, "cur_label", "prev_label", cost]]

    return dealt(pairs.select(*keys, "cur_label", "prev_label", cost), *keys).groupBy(*keys).applyInPandas(run, schema)


@dataclass
class Region:
    """What the tracker knows of a region: pixels as flat indices of the scene, box as (left, top, right, bottom)."""

    label: int
    cx: float
    cy: float
    area: float
    box: tuple[float, float, float, float]
    cells: frozenset = frozenset()
    axis: float = 1.0
    hu: tuple | None = None


@dataclass
class Track:
    birth_frame: int
    birth_label: int
    last: Region
    missing: int = 0


def window_iou(a: Region, b: Region, width: int) -> float:
    """Overlap of cells within the intersection of the boxes only."""
    x0, y0, x1, y1 = max(a.box[0], b.box[0]), max(a.box[1], b.box[1]), min(a.box[2], b.box[2]), min(a.box[3], b.box[3])
    if x0 >= x1 or y0 >= y1:
        return 0.0
    inside = lambda cells: {c for c in cells if x0 <= c % width < x1 and y0 <= c // width < y1}
    p, q = inside(a.cells), inside(b.cells)
    union = len(p | q)
    return len(p & q) / union if union else 0.0


def hu_distance(a: tuple | None, b: tuple | None) -> float | None:
    """Sum of differences of signed log moments; None if a contour is missing."""
    if a is None or b is None:
        return None
    return sum(abs(x - y) for x, y in zip(a, b, strict=True) if x is not None and y is not None)


def _percentile(values: list[float], kind: str) -> float:
    if not values:
        return params.NORMALISER_DEFAULTS[kind]
    return max(float(np.percentile(values, 75)), params.NORMALISER_FLOORS[kind])


class TileTracker:
    """The tracks of one tile, frame by frame; small enough to be kept as a stream's state."""

    def __init__(self, p: params.Identify, width: int):
        self.p, self.width, self.tracks = p, width, []
        self.known: dict[tuple[int, int], float | None] = {}

    def active(self) -> list[Track]:
        return [x for x in self.tracks if x.missing <= self.p.max_missing_frames]

    def age(self) -> None:
        """A frame in which none of the tracks is seen."""
        for x in self.active():
            x.missing += 1

    def gated(self, r: Region, q: Region) -> float | None:
        """1 - overlap of a pair that passes the gates on area and overlap."""
        if abs(r.area - q.area) / max(q.area, 1) > params.AREA_GATE:
            return None
        at = (id(r), id(q))
        if at not in self.known:  # asked for the normalisers and for the costs
            cost = 1 - window_iou(r, q, self.width)
            self.known[at] = None if cost > params.COST_GATE else cost
        return self.known[at]

    def factors(self, now: list[Region], before: list[Region]) -> tuple[float, float, float]:
        """Normalisers from the regions of the frame before, whether tracked or not, at any distance."""
        areas, axes, contours = [], [], []
        for r in now:
            for q in before:
                cost = self.gated(r, q)
                if cost is not None:
                    areas.append(cost)
                    axes.append(abs(r.axis - q.axis))
                    shape = hu_distance(r.hu, q.hu)
                    if shape is not None:
                        contours.append(shape)
        return _percentile(areas, "area"), _percentile(axes, "axis"), _percentile(contours, "contour")

    def step(self, t: int, now: list[Region], before: list[Region]) -> list[tuple[Track, int, Region, tuple]]:
        """Match the regions of frame t, age and begin tracks; returns the new observations."""
        active, out, hit = self.active(), [], set()
        self.known = {}
        if active:
            na, nx, nc = self.factors(now, before)
            table = np.full((len(now), len(active)), params.FORBIDDEN)
            parts = {}
            for i, r in enumerate(now):
                for j, x in enumerate(active):
                    q = x.last
                    dist = float(np.sqrt((r.cx - q.cx) ** 2 + (r.cy - q.cy) ** 2))
                    cost = self.gated(r, q) if r.area > 0 and q.area > 0 and dist <= self.p.max_distance else None
                    if cost is None:
                        continue
                    shape = hu_distance(r.hu, q.hu)
                    shape = params.CONTOUR_MISSING if shape is None else min(shape, params.CONTOUR_CAP)
                    terms = (dist, cost / na, abs(r.axis - q.axis) / nx, shape / nc)
                    total = sum(w * v for w, v in zip(params.COST_WEIGHTS.values(), terms, strict=True))
                    table[i, j] = total if np.isfinite(total) else params.FORBIDDEN
                    parts[i, j] = (*terms, total)
            found = match(table)
            for i, j in found:
                active[j].last, active[j].missing = now[i], 0
                out.append((active[j], t, now[i], parts[i, j]))
            hit = {i for i, _ in found}
            for j in set(range(len(active))) - {j for _, j in found}:
                active[j].missing += 1
        for i, r in enumerate(now):
            if i not in hit:
                self.tracks.append(Track(t, r.label, r))
                out.append((self.tracks[-1], t, r, (None,) * 5))
        return out


def track_tile(frames: dict[int, list[Region]], order: list[int], empty: set[int], p: params.Identify, width: int, age_empty_tiles: bool = False, keep_after_empty: bool = False) -> list[tuple[Track, int, Region, tuple]]:
    """The observations (track, frame, region, costs) of one tile. order: all frames; empty: those without regions in any tile.

    A frame that is empty, or follows an empty one, is skipped: its regions get no track and nothing
    ages (keep_after_empty: only empty frames are). Tracks don't age in frames without a region in this
    tile (age_empty_tiles: they do). A track is matched while it was missed at most max_missing_frames
    times in a row.
    """
    tracker, out = TileTracker(p, width), []
    for k, t in enumerate(order):
        if k and (t in empty or (order[k - 1] in empty and not keep_after_empty)):
            continue
        now = sorted(frames.get(t, []), key=lambda r: r.label)
        if now:
            out += tracker.step(t, now, frames.get(order[k - 1], []) if k else [])
        elif age_empty_tiles and k:
            tracker.age()
    return out


def region_of(r) -> Region:
    """A region from a row with label, cx, cy, area, left, top, width, height, cells, axis and hu."""
    hu = None if r.hu is None else tuple(None if x is None or np.isnan(x) else float(x) for x in r.hu)
    axis = 1.0 if r.axis is None or np.isnan(r.axis) else float(r.axis)
    box = (float(r.left), float(r.top), float(r.left + r.width), float(r.top + r.height))
    return Region(int(r.label), float(r.cx), float(r.cy), float(r.area), box, frozenset(map(int, r.cells)), axis, hu)


_COSTS = ("Centroid_Distance", "Area_Cost", "Axis_Cost", "Contour_Cost", "Total_Cost")


def tracks(regions: DataFrame, p: params.Identify, scene_width: int, age_empty_tiles: bool = False, keep_after_empty: bool = False) -> DataFrame:
    """Observations of numbered tracks.

    regions: orbit, frame, tile_row, tile_col, label, cx, cy, area, left, top, width, height, cells
    (array of flat indices) and, if known, axis, hu and last_frame (of the orbit). An orbit's list of
    frames goes once to each of its tiles. Tracks are numbered by birth frame, tile and label within all orbits.
    """
    spark = regions.sparkSession
    ship(spark)
    frames = regions.groupBy("orbit").agg(F.sort_array(F.collect_set("frame")).alias("filled"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    if "last_frame" in regions.columns:
        frames = regions.groupBy("orbit").agg(F.sort_array(F.collect_set("frame")).alias("filled"), F.lit(1).alias("first"), F.max("last_frame").alias("last"))
    have = set(regions.columns)
    extra = [F.col(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in (("axis", "double"), ("hu", "array<double>"))]
    fields = ["label", "frame", "cx", "cy", "area", "left", "top", "width", "height", "cells"]
    tile = ["orbit", "tile_row", "tile_col"]
    rows = regions.select(*tile, *fields, *extra)
    tiles = rows.select(*tile).distinct().join(frames, "orbit")
    tiles = tiles.toDF(*tiles.columns)  # columns of their own, for the cogroup
    schema = "orbit int, tile_row int, tile_col int, birth_frame int, birth_label bigint, frame int, label bigint, cx double, cy double, area double, " + ", ".join(f"{c} double" for c in _COSTS)

    def run(group: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        by: dict[int, list[Region]] = {}
        for r in group.itertuples(index=False):
            by.setdefault(int(r.frame), []).append(region_of(r))
        head = about.iloc[0]
        order = list(range(int(head["first"]), int(head["last"]) + 1))
        found = track_tile(by, order, set(order) - set(map(int, head["filled"])), p, scene_width, age_empty_tiles, keep_after_empty)
        place = (int(head["orbit"]), int(head["tile_row"]), int(head["tile_col"]))
        out = [(*place, x.birth_frame, x.birth_label, t, r.label, r.cx, r.cy, r.area, *costs) for x, t, r, costs in found]
        return pd.DataFrame(out, columns=[part.split()[0] for part in schema.split(", ")])

    seen = dealt(rows, *tile).groupBy(*tile).cogroup(dealt(tiles, *tile).groupBy(*tile)).applyInPandas(run, schema)
    scratch = Scratch(spark, "tracks")
    seen = scratch.keep(seen, "seen")
    birth = ["orbit", "birth_frame", "tile_row", "tile_col", "birth_label"]
    names = numbered(seen.select(*birth).distinct(), birth, "Track_ID", scratch)
    return seen.join(names, birth)
