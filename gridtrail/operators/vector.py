"""Geometry on cell sets and polygons: tracing, WKB, overlap joins, greedy removal of duplicates, topology classes.

A feature's cells (row, col on one grid) are its exact geometry: areas, intersections and containment
are counts. Polygons are traced for export. Across grids only convex clipping is offered.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..session import dealt, ship
from ..storage import Scratch
from .graph import components, numbered

Ring = list[tuple[float, float]]


def first_part(mask: np.ndarray) -> np.ndarray:
    """The 4-connected part of a mask's first cell in scan order."""
    out = np.zeros_like(mask, dtype=bool)
    rows, cols = np.nonzero(mask)
    todo = [(int(rows[0]), int(cols[0]))] if len(rows) else []
    for r, c in todo:
        out[r, c] = True
    while todo:
        r, c = todo.pop()
        for y, x in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                out[y, x] = True
                todo.append((y, x))
    return out


def rings(mask: np.ndarray) -> list[Ring]:
    """Border rings of a 4-connected mask in cell corners (x, y): the outer one first, holes after it."""
    wide = np.pad(mask.astype(bool), 1)
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in zip(*np.nonzero(wide), strict=True):
        x, y = int(c) - 1, int(r) - 1
        # each border edge runs with the cell on its right, y downwards
        for free, a, b in ((wide[r - 1, c], (x, y), (x + 1, y)), (wide[r, c + 1], (x + 1, y), (x + 1, y + 1)), (wide[r + 1, c], (x + 1, y + 1), (x, y + 1)), (wide[r, c - 1], (x, y + 1), (x, y))):
            if not free:
                edges.setdefault(a, []).append(b)
    found = []
    while edges:
        start = min(edges, key=lambda p: (p[1], p[0]))
        here, ring, way = start, [start], None
        while True:
            ways = edges[here]
            if way and len(ways) > 1:  # at a corner of two diagonal cells turn right, to stay with one cell
                right = (-way[1], way[0])
                ways.sort(key=lambda p: (p[0] - here[0], p[1] - here[1]) != right)
            there = ways.pop(0)
            if not ways:
                del edges[here]
            way, here = (there[0] - here[0], there[1] - here[1]), there
            if here == start:
                break
            ring.append(here)
        corners = [p for q, p, n in zip([ring[-1], *ring[:-1]], ring, [*ring[1:], ring[0]], strict=True) if (p[0] - q[0], p[1] - q[1]) != (n[0] - p[0], n[1] - p[1])]
        found.append(corners)
    return sorted(found, key=lambda r: -abs(signed_area(r)))


def signed_area(ring: Ring) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def polygon_area(polygon: list[Ring]) -> float:
    """Area of an outer ring less its holes."""
    return abs(signed_area(polygon[0])) - sum(abs(signed_area(r)) for r in polygon[1:]) if polygon else 0.0


def to_wkb(polygons: list[list[Ring]]) -> bytes:
    """Little-endian WKB of one polygon, or of a multipolygon."""

    def one(polygon: list[Ring]) -> bytes:
        out = struct.pack("<BII", 1, 3, len(polygon))
        for ring in polygon:
            closed = [*ring, ring[0]]
            out += struct.pack(f"<I{2 * len(closed)}d", len(closed), *(float(v) for p in closed for v in p))
        return out

    if len(polygons) == 1:
        return one(polygons[0])
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(one, polygons))


def from_wkb(data: bytes) -> list[list[Ring]]:
    """The polygons of a WKB polygon or multipolygon, with open rings; other kinds raise an error."""
    found, end = _from_wkb(data, 0)
    if end != len(data):
        raise ValueError("bytes after the geometry")
    return found


def _from_wkb(data: bytes, at: int) -> tuple[list[list[Ring]], int]:
    order = "<" if data[at] == 1 else ">"
    kind, n = struct.unpack_from(f"{order}II", data, at + 1)
    kind, dims = kind & 0xFF if kind < 1000 else kind % 1000, 2 + (kind // 1000 in (1, 2))
    at += 9
    if kind == 6:
        out = []
        for _ in range(n):
            part, at = _from_wkb(data, at)
            out += part
        return out, at
    if kind != 3:
        raise ValueError(f"geometry type {kind} is not supported")
    polygon = []
    for _ in range(n):
        (points,) = struct.unpack_from(f"{order}I", data, at)
        values = struct.unpack_from(f"{order}{dims * points}d", data, at + 4)
        at += 4 + 8 * dims * points
        polygon.append([(values[k], values[k + 1]) for k in range(0, len(values) - dims, dims)])
    return [polygon], at


def contains_point(polygon: list[Ring], x: float, y: float) -> bool:
    """Even-odd rule over all rings."""
    inside = False
    for ring in polygon:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def clipped(subject: Ring, convex: Ring) -> Ring:
    """The part of a ring inside a convex ring (Sutherland and Hodgman 1974)."""
    if signed_area(convex) < 0:
        convex = convex[::-1]
    out = list(subject)
    for (x1, y1), (x2, y2) in zip(convex, [*convex[1:], convex[0]], strict=True):
        side = lambda p, x1=x1, y1=y1, x2=x2, y2=y2: (x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)
        points, out = out, []
        for p, q in zip(points, [*points[1:], *points[:1]], strict=True):
            a, b = side(p), side(q)
            if a >= 0:
                out.append(p)
            if (a > 0 > b) or (a < 0 < b):
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def traced(pixels: DataFrame, keys: list[str], transform: tuple[float, ...] = (1, 0, 0, 0, 1, 0)) -> DataFrame:
    """geom_wkb of each component: its first 4-connected part in scan order; multipolygon tells whether there were more."""
    ship(pixels.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    names = [*keys, "label"]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["geom_wkb binary", "geom_area double", "multipolygon boolean"])
    cells = dealt(pixels, *names).groupBy(*names).agg(F.collect_list("row").alias("rows"), F.collect_list("col").alias("cols"))
    a, b, c, d, e, f = transform

    def run(batches):
        for batch in batches:
            made = []
            for rows, cols in zip(batch["rows"], batch["cols"], strict=True):
                r0, c0 = min(rows), min(cols)
                mask = np.zeros((max(rows) - r0 + 1, max(cols) - c0 + 1), dtype=bool)
                mask[np.asarray(rows) - r0, np.asarray(cols) - c0] = True
                part = first_part(mask)
                polygon = [[(a * (x + c0) + b * (y + r0) + c, d * (x + c0) + e * (y + r0) + f) for x, y in ring] for ring in rings(part)]
                made.append((to_wkb([polygon]), polygon_area(polygon), bool(part.sum() < mask.sum())))
            columns = list(zip(*made, strict=True)) or [[]] * 3
            yield pd.DataFrame({**{c: batch[c] for c in names}, **dict(zip(("geom_wkb", "geom_area", "multipolygon"), map(list, columns), strict=True))})

    return cells.mapInPandas(run, schema)


def geometry_status(points: DataFrame, pixels: DataFrame, height: int, width: int, transform: tuple[float, ...]) -> DataFrame:
    """label at each point (scene_id, Geo_X, Geo_Y) and status: the reasons for which a feature gets no polygon, or 'Success'."""
    a, _, c, _, e, f = transform
    at = points.withColumns({"row": F.floor((F.col("Geo_Y") - f) / e).cast("int"), "col": F.floor((F.col("Geo_X") - c) / a).cast("int")})
    known = pixels.select("scene_id").distinct().withColumn("_known", F.lit(True))
    out = at.join(known, "scene_id", "left").join(pixels.select("scene_id", "row", "col", "label"), ["scene_id", "row", "col"], "left")
    inside = (F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width)
    status = F.when(F.col("_known").isNull(), "File Not Found").when(~inside, "Coordinates Out of Bounds").when(F.col("label").isNull(), "Background Label Detected").otherwise("Success")
    return out.withColumn("status", status).drop("row", "col", "_known")


def box_pairs(boxes: DataFrame, keys: list[str], id_col: str, cell: int) -> DataFrame:
    """(keys, a, b), a < b: boxes (left, top, width, height) of a group that overlap or touch.

    Boxes are put in all grid cells that they meet; boxes meet in a cell, and a pair counts in the cell
    of its common corner only, so it appears once without a distinct.
    """
    span = lambda low, size: F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(low) + F.col(size)) / cell))
    placed = boxes.select(*keys, F.col(id_col).alias("id"), "left", "top", "width", "height")
    placed = placed.withColumn("gx", F.explode(span("left", "width"))).withColumn("gy", F.explode(span("top", "height")))
    a = placed.withColumnsRenamed({c: f"a_{c}" for c in ("left", "top", "width", "height")} | {"id": "a"})
    b = placed.withColumnsRenamed({c: f"b_{c}" for c in ("left", "top", "width", "height")} | {"id": "b"})
    met = a.join(b, [*keys, "gx", "gy"]).where("a < b")
    met = met.where("a_left <= b_left + b_width and b_left <= a_left + a_width and a_top <= b_top + b_height and b_top <= a_top + a_height")
    home = (F.col("gx") == F.floor(F.greatest("a_left", "b_left") / cell)) & (F.col("gy") == F.floor(F.greatest("a_top", "b_top") / cell))
    return met.where(home).select(*keys, "a", "b")


def cell_overlaps(pixels: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, i, j, shared): ordered pairs of features with common cells, by an equi-join on the cell."""
    one = pixels.select(*keys, "row", "col", F.col(id_col).alias("i"))
    two = pixels.select(*keys, "row", "col", F.col(id_col).alias("j"))
    return one.join(two, [*keys, "row", "col"]).where("i <> j").groupBy(*keys, "i", "j").agg(F.count("*").alias("shared"))


def _ranked(features: DataFrame, keys: list[str], id_col: str, rank_by: str, one_group: bool, scratch: Scratch) -> DataFrame:
    order = [F.desc(rank_by), F.col(id_col)]
    ranked = numbered(features, order, "rank", scratch) if one_group else features.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return scratch.keep(ranked.withColumn("_node", F.monotonically_increasing_id()), "ranked")


def deduplicated(features: DataFrame, shared: DataFrame, keys: list[str], id_col: str, rank_by: str, limit: float = params.Export.overlap_threshold, one_group: bool = False) -> DataFrame:
    """features with rank (by rank_by downwards, then id) and dropped.

    one_group: the keys tell nothing apart, so features are numbered over all partitions and not in one window.

    In the order of rank, a feature not yet dropped drops every other whose covered share (of the
    other's own area in cells) is over the limit, higher-ranked ones too. Decisions only depend on each
    other within a connected component of such pairs, so the loop runs per component.
    """
    ship(features.sparkSession)
    scratch = Scratch(features.sparkSession, "dedup")
    ranked = _ranked(features, keys, id_col, rank_by, one_group, scratch)
    side = lambda name: ranked.select(*keys, F.col(id_col).alias(name), F.col("rank").alias(f"{name}_rank"), F.col("area").alias(f"{name}_area"))
    edges = shared.join(side("i"), [*keys, "i"]).join(side("j"), [*keys, "j"]).where(F.col("j_area") > 0)
    edges = scratch.keep(edges.where(F.col("shared") / F.col("j_area") > limit).select(*keys, "i", "j", "i_rank", "j_rank"), "edges")
    node = lambda c: F.struct(*keys, F.col(c).alias("id"))
    comps = components(edges.select(node("i").alias("u"), node("j").alias("v")), scratch, "conflicts")
    grouped = edges.withColumn("node", node("i")).join(comps, "node")
    kinds = {f.name: f.dataType.simpleString() for f in features.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{id_col}` {kinds[id_col]}"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        gone: set = set()
        for i, rows in group.sort_values(["i_rank", "j_rank"]).groupby("i_rank", sort=True):
            del i
            if rows["i"].iloc[0] not in gone:
                gone.update(rows["j"])
        return pd.DataFrame({**{k: group[k].iloc[0] for k in keys}, id_col: sorted(gone)}, columns=[*keys, id_col])

    dropped = grouped.select("comp", *keys, "i", "j", "i_rank", "j_rank").groupBy("comp").applyInPandas(run, schema).distinct()
    return ranked.drop("_node").join(dropped.withColumn("dropped", F.lit(True)), [*keys, id_col], "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))


def _covered(limit: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """The features that the loop drops, of one component's cells."""
        _, first, of = np.unique(group["rank"], return_index=True, return_inverse=True)
        nodes, areas = group["_node"].to_numpy()[first], group["area"].to_numpy(dtype=float)[first]
        cell = group.groupby(["row", "col"]).ngroup().to_numpy()

        def lists(by: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
            turn = np.argsort(by, kind="stable")
            return np.split(values[turn], np.flatnonzero(np.diff(by[turn])) + 1)

        cells, left = lists(of, cell), lists(cell, of)
        gone = np.zeros(len(nodes), dtype=bool)
        for i, own in enumerate(cells):
            if gone[i]:
                continue
            for c in own:  # those dropped before can't change any more
                left[c] = left[c][~gone[left[c]]]
            others, shared = np.unique(np.concatenate([left[c] for c in own]), return_counts=True)
            others, shared = others[areas[others] > 0], shared[areas[others] > 0]
            gone[others[(shared / areas[others] > limit) & (others != i)]] = True
        return pd.DataFrame({"_node": nodes[gone]})

    return run


def deduplicated_cells(features: DataFrame, pixels: DataFrame, keys: list[str], id_col: str, rank_by: str, limit: float = params.Export.overlap_threshold, one_group: bool = False) -> DataFrame:
    """deduplicated() from the features' cells, each given once, in place of their overlaps.

    Overlapping pairs grow with the square of the features at a place, so none are made: a feature is
    tied to the first one of each of its cells, and in a component of such ties the loop counts the
    cells of a feature that stays against those of the others that are left there.
    """
    ship(features.sparkSession)
    scratch = Scratch(features.sparkSession, "dedup")
    ranked = _ranked(features, keys, id_col, rank_by, one_group, scratch)
    cells = pixels.select(*keys, id_col, "row", "col").join(ranked.select(*keys, id_col, "_node", "rank", "area"), [*keys, id_col])
    cells = scratch.keep(cells.select(*keys, "row", "col", "_node", "rank", "area"), "cells")
    ties = cells.join(cells.groupBy(*keys, "row", "col").agg(F.min("_node").alias("v")), [*keys, "row", "col"])
    comps = components(ties.select(F.col("_node").alias("u"), "v"), scratch, "ties").withColumnRenamed("node", "_node")
    dropped = cells.join(comps, "_node").select("comp", "_node", "rank", "area", "row", "col").groupBy("comp").applyInPandas(_covered(limit), "_node long")
    return ranked.join(dropped.withColumn("dropped", F.lit(True)), "_node", "left").withColumn("dropped", F.coalesce("dropped", F.lit(False))).drop("_node")


def status_of(meets: Column, covered: Column) -> Column:
    return F.when(covered, "Inside").when(meets, "Partial").otherwise("Outside")


def fast_ice_status(boxes: DataFrame, ice: DataFrame, id_cols: list[str], wanted: int = params.FAST_ICE_CLASS) -> DataFrame:
    """Fast_Ice_Overlap_Status of boxes against the union of the rectangles of one class.

    Touching counts as Partial; Inside means that the union covers every cell. Without a rectangle of
    the class all are Outside. The rectangles, a reference layer, are joined by grid cells of the boxes,
    grown by one to find those that only touch.
    """
    chosen = ice.where(F.col("class_id") == wanted)
    rect = lambda df, name: df.select(F.explode(F.expr("sequence(top, top + height - 1)")).alias("row"), "left", "width").select("row", F.explode(F.expr("sequence(left, left + width - 1)")).alias("col")).distinct().withColumn(name, F.lit(1))
    covered = rect(chosen, "_in")
    beside = rect(chosen.selectExpr("left - 1 as left", "top - 1 as top", "width + 2 as width", "height + 2 as height"), "_near")
    cells = boxes.select(*id_cols, F.explode(F.expr("sequence(top, top + height - 1)")).alias("row"), "left", "width")
    cells = cells.select(*id_cols, "row", F.explode(F.expr("sequence(left, left + width - 1)")).alias("col"))
    met = cells.join(covered, ["row", "col"], "left").join(beside, ["row", "col"], "left")
    sums = met.groupBy(*id_cols).agg((F.count("_near") > 0).alias("meets"), (F.count("_in") == F.count("*")).alias("covered"))
    return boxes.join(sums, id_cols, "left").withColumn("Fast_Ice_Overlap_Status", status_of(F.col("meets"), F.col("covered"))).drop("meets", "covered")


def status_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("Fast_Ice_Overlap_Status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "Fast_Ice_Overlap_Status")
