"""Candidate pairs between frames, windowed overlap, normalisers and costs.

Regions have ``orbit, frame, label, area, cx, cy, left, top, width, height`` and, if tiled,
``tile_row, tile_col``; pairs join a region with those of the frame before in the same orbit (and tile).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import scalar

_FIELDS = ("scene_id", "label", "area", "cx", "cy", "left", "top", "width", "height")


def tiled(regions: DataFrame, height: int, width: int, rows: int, cols: int) -> DataFrame:
    """Tile row and column of each region's centroid (tiles of floor(size / count), the last ones larger) and its place in the tile."""
    th, tw = height // rows, width // cols
    r = F.least(F.floor(F.col("cy") / th), F.lit(rows - 1)).cast("int")
    c = F.least(F.floor(F.col("cx") / tw), F.lit(cols - 1)).cast("int")
    out = regions.withColumns({"tile_row": r, "tile_col": c})
    return out.withColumns({"local_x": F.col("cx") - F.col("tile_col") * tw, "local_y": F.col("cy") - F.col("tile_row") * th})


def clipped_boxes(regions: DataFrame, height: int, width: int) -> DataFrame:
    """Boxes cut to the raster; is_empty where nothing is left (such regions have no features, and an axis ratio of 1)."""
    x0, y0 = F.greatest("left", F.lit(0)), F.greatest("top", F.lit(0))
    x1, y1 = F.least(F.col("left") + F.col("width"), F.lit(width)), F.least(F.col("top") + F.col("height"), F.lit(height))
    out = regions.withColumns({"_x": x0, "_y": y0, "_w": x1 - x0, "_h": y1 - y0})
    sizes = {"left": F.col("_x"), "top": F.col("_y"), "width": F.greatest("_w", F.lit(0)), "height": F.greatest("_h", F.lit(0))}
    return out.withColumns(sizes).withColumn("is_empty", (F.col("_w") <= 0) | (F.col("_h") <= 0)).drop("_x", "_y", "_w", "_h")


def frame_pairs(regions: DataFrame, max_distance: float | None, keys: tuple[str, ...] = ("orbit",), max_area_change: float = params.AREA_GATE) -> DataFrame:
    """Regions with those of the frame before, gated by centroid distance (None: no gate) and area change.

    An equi-join on keys and frame. Without tiles a distance gate also joins on cells of that size and
    their neighbours, so that the candidates of a frame don't grow with its square.
    """
    now = regions.select(*keys, "frame", *[F.col(c).alias(f"cur_{c}") for c in _FIELDS])
    then = regions.select(*keys, (F.col("frame") + 1).alias("frame"), *[F.col(c).alias(f"prev_{c}") for c in _FIELDS])
    on = [*keys, "frame"]
    if max_distance is not None:
        cell = lambda side, axis: F.floor(F.col(f"{side}_{axis}") / max_distance)
        now = now.withColumns({"_gx": cell("cur", "cx"), "_gy": cell("cur", "cy")})
        near = F.sequence(F.lit(-1), F.lit(1))
        then = then.withColumn("_gx", F.explode(F.transform(near, lambda d: cell("prev", "cx") + d))).withColumn("_gy", F.explode(F.transform(near, lambda d: cell("prev", "cy") + d)))
        on += ["_gx", "_gy"]
    pairs = now.join(then, on).withColumns(
        {
            "dist": scalar.distance(F.col("cur_cx"), F.col("cur_cy"), F.col("prev_cx"), F.col("prev_cy")),
            "area_change": scalar.area_change(F.col("cur_area"), F.col("prev_area")),
        }
    )
    pairs = pairs.where((F.col("area_change") <= max_area_change) & (F.col("cur_area") > 0) & (F.col("prev_area") > 0))
    if max_distance is not None:
        pairs = pairs.where(F.col("dist") <= max_distance).drop("_gx", "_gy")
    return pairs


def overlaps(pairs: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pairs with inter, window_union, window_iou and full_iou.

    The window is the intersection of the two bounding boxes; window_iou counts cells there only (as
    the pipeline does, which overstates it), full_iou all cells. Without a window both are 0.
    """
    right, low = F.expr("least(cur_left + cur_width, prev_left + prev_width)"), F.expr("least(cur_top + cur_height, prev_top + prev_height)")
    boxed = pairs.withColumns({"x0": F.expr("greatest(cur_left, prev_left)"), "y0": F.expr("greatest(cur_top, prev_top)"), "x1": right, "y1": low})
    key = ["cur_scene_id", "cur_label", "prev_scene_id", "prev_label"]
    window = boxed.where("x0 < x1 and y0 < y1").select(*key, "x0", "y0", "x1", "y1")

    def inside(side: str) -> DataFrame:
        cells = pixels.select(F.col("scene_id").alias(f"{side}_scene_id"), F.col("label").alias(f"{side}_label"), "row", "col")
        met = window.join(cells, [f"{side}_scene_id", f"{side}_label"])
        return met.where("col >= x0 and col < x1 and row >= y0 and row < y1").select(*key, "row", "col")

    both = inside("cur").union(inside("prev")).groupBy(*key, "row", "col").agg(F.count("*").alias("n"))
    counts = both.groupBy(*key).agg(F.count_if(F.col("n") > 1).alias("inter"), F.count("*").alias("window_union"))
    out = pairs.join(counts, key, "left").fillna(0, ["inter", "window_union"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    inter = F.col("inter")
    return out.withColumns({"window_iou": ratio(inter, F.col("window_union")), "full_iou": ratio(inter, F.col("cur_area") + F.col("prev_area") - inter)})


def with_costs(pairs: DataFrame) -> DataFrame:
    """area_cost and axis_diff of overlapped pairs; the axis ratio is the bounding box's where none is given."""
    ratio = lambda side: F.greatest(f"{side}_width", f"{side}_height") / F.least(f"{side}_width", f"{side}_height")
    axis = F.abs(F.col("cur_axis") - F.col("prev_axis")) if "cur_axis" in pairs.columns else F.abs(ratio("cur") - ratio("prev"))
    out = pairs.withColumns({"area_cost": 1 - F.col("window_iou"), "axis_diff": axis})
    return out.where(F.col("area_cost") <= params.COST_GATE)


def normalisers(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Exact 75th percentiles with floors, of the pool of each group."""
    floors = params.NORMALISER_FLOORS
    wanted = {"area": "area_cost", "axis": "axis_diff"} | ({"contour": "contour_diff"} if "contour_diff" in costs.columns else {})
    default = params.NORMALISER_DEFAULTS
    return costs.groupBy(*keys).agg(*[F.coalesce(F.greatest(F.percentile(c, 0.75), F.lit(floors[k])), F.lit(default[k])).alias(f"norm_{k}") for k, c in wanted.items()])


def pair_costs(gated: DataFrame, norms: DataFrame, keys: list[str]) -> DataFrame:
    """Total cost of each gated pair; non-finite ones are forbidden. Groups without a pool have the default factors."""
    d = params.NORMALISER_DEFAULTS
    out = gated.join(norms, keys, "left")
    area = F.col("area_cost") / F.coalesce("norm_area", F.lit(d["area"]))
    axis = F.col("axis_diff") / F.coalesce("norm_axis", F.lit(d["axis"]))
    if "contour_diff" in out.columns:
        contour = scalar.contour_cost(F.col("contour_diff")) / F.coalesce("norm_contour", F.lit(d["contour"]))
    else:
        contour = F.lit(0.0)
    out = out.withColumns({"area_term": area, "axis_term": axis, "contour_term": contour})
    cost = scalar.total_cost(F.col("dist"), F.col("area_term"), F.col("axis_term"), F.col("contour_term"))
    return out.withColumn("cost", scalar.finite_or_forbidden(cost))


def smoothed(points: DataFrame, keys: list[str], order: str, names: list[str], k: int = 5) -> DataFrame:
    """Moving average over k points, zeros beyond both ends, cut to integers; sequences of fewer than k points stay."""
    group = Window.partitionBy(*keys)
    w = group.orderBy(order).rowsBetween(-(k // 2), k // 2)
    n = F.count("*").over(group)
    return points.withColumns({f"smooth_{c}": F.when(n < k, F.col(c)).otherwise((F.sum(c).over(w) / k).cast("int")) for c in names})
