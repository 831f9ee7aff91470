"""Raster operators on tiles and pixels: patches, validity, resampling, thresholds, dilation, erasing.

A tile is a row ``scene_id, row0, col0, height, width, data`` (data in row order, NULL for invalid
cells); a pixel relation has ``scene_id, row, col, value``. Work on a tile's own cells is done with
array functions, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import projection, scalar
from ..session import ship


def pixels(tiles: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep columns, scene_id, row, col, value of every cell."""
    out = tiles.select(*(keep or []), "scene_id", "row0", "col0", "width", F.posexplode("data").alias("i", "value"))
    return out.select(*(keep or []), "scene_id", (F.col("row0") + F.expr("i div width")).cast("int").alias("row"), (F.col("col0") + F.expr("i % width")).cast("int").alias("col"), "value")


def grid_of(size: Column, patch: int) -> Column:
    """Patches along one side: size / patch, rounded up."""
    return F.ceil(size / patch)


def patches(tiles: DataFrame, rows: int | Column, cols: int | Column) -> DataFrame:
    """Whole scenes cut into rows x cols patches of floor(size / count); the last ones take the rest.

    rows and cols may be columns, for scenes of different sizes. Patch rows and columns, offsets and
    sizes (and the scene's) come with the patch's data; nothing is shuffled.
    """
    as_col = lambda n: (F.lit(n) if isinstance(n, int) else n).cast("int")
    cut = tiles.withColumns({"_rows": as_col(rows), "_cols": as_col(cols)})
    cut = cut.withColumns({"_h": F.expr("cast(height div _rows as int)"), "_w": F.expr("cast(width div _cols as int)")})
    cut = cut.withColumn("patch_row", F.explode(F.expr("sequence(0, _rows - 1)"))).withColumn("patch_col", F.explode(F.expr("sequence(0, _cols - 1)")))
    cut = cut.withColumns({"_r": F.expr("patch_row * _h"), "_c": F.expr("patch_col * _w")})
    cut = cut.withColumns({"_nh": F.expr("if(patch_row = _rows - 1, height - _r, _h)"), "_nw": F.expr("if(patch_col = _cols - 1, width - _c, _w)")})
    data = F.expr("flatten(transform(sequence(_r, _r + _nh - 1), r -> slice(data, r * width + _c + 1, _nw)))")
    rest = [c for c in tiles.columns if c not in ("row0", "col0", "height", "width", "data")]
    return cut.select(
        *rest, "patch_row", "patch_col", F.col("height").alias("scene_height"), F.col("width").alias("scene_width"),
        F.col("_r").alias("row0"), F.col("_c").alias("col0"), F.col("_nh").alias("height"), F.col("_nw").alias("width"), data.alias("data"),
    )


def stitched(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Whole scenes again from patches that carry scene_height and scene_width: one shuffle by scene."""
    cells = F.expr("transform(data, (v, i) -> struct(cast((row0 + i div width) * scene_width + col0 + i % width as int) as at, v as v))")
    whole = parts.groupBy(*keys).agg(F.flatten(F.collect_list(cells)).alias("cells"), F.first("scene_height").alias("height"), F.first("scene_width").alias("width"))
    data = F.transform(F.sort_array("cells"), lambda c: c["v"])
    return whole.select(*keys, F.lit(0).alias("row0"), F.lit(0).alias("col0"), "height", "width", data.alias("data"))


def threshold(score: Column) -> Column:
    """1 where the logistic of a score is over one half, else 0."""
    return F.when(scalar.sigmoid(score) > 0.5, 1).otherwise(0)


def byte_mask(flag: Column, is_valid: Column) -> Column:
    """0 or 255, 0 where invalid."""
    return F.when(is_valid, flag * 255).otherwise(0)


def positive(value: Column, is_byte: Column) -> Column:
    """A mask value as truth: over one half, bytes first divided by 255."""
    return F.coalesce(F.when(is_byte, value / 255 > 0.5).otherwise(value > 0.5), F.lit(False))


def non_empty(cells: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    """Cells of scenes with any positive cell; all-zero scenes vanish."""
    some = cells.where(F.col(flag)).select(*keys).distinct()
    return cells.join(some, keys, "left_semi")


def near_invalid(cells: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Distinct keys, row, col within reach (both ways, along both axes) of an invalid cell.

    Only invalid cells, which are few, are spread out; keys hold the patch where patches don't look
    into each other.
    """
    span = F.sequence(F.lit(-reach), F.lit(reach))
    around = cells.where("value is null").select(*keys, "row", "col", F.explode(span).alias("dr"))
    around = around.select(*keys, (F.col("row") + F.col("dr")).alias("row"), "col", F.explode(span).alias("dc"))
    return around.select(*keys, "row", (F.col("col") + F.col("dc")).alias("col")).distinct()


def invalid_edges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with is_edge (valid beside an invalid one) and is_cleared (within two cells of one, or invalid).

    The prediction is zeroed where is_cleared holds.
    """
    one = near_invalid(cells, keys, 1).withColumn("near_1", F.lit(True))
    two = near_invalid(cells, keys, 2).withColumn("near_2", F.lit(True))
    out = cells.join(one, [*keys, "row", "col"], "left").join(two, [*keys, "row", "col"], "left")
    edge = F.col("near_1").isNotNull() & F.col("value").isNotNull()
    return out.withColumns({"is_edge": edge, "is_cleared": F.col("near_2").isNotNull() | F.col("value").isNull()}).drop("near_1", "near_2")


def bilinear(tiles: DataFrame, height: int, width: int) -> DataFrame:
    """Tiles resampled by cell centres: data bilinear (invalid cells as 0), validity by nearest; two small matrix products a tile."""
    ship(tiles.sparkSession)
    at = {c: k for k, c in enumerate(tiles.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, heights, widths = (batch.column(at[c]) for c in ("data", "height", "width"))
            made = []
            for data, h, w in zip(values, heights.to_pylist(), widths.to_pylist(), strict=True):
                flat = data.values
                bad = flat.is_null().to_numpy(zero_copy_only=False).reshape(h, w)
                full = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(h, w)
                out = centre_weights(h, height) @ full @ centre_weights(w, width).T
                rows, cols = (((np.arange(n) + 0.5) * old / n).astype(int) for n, old in ((height, h), (width, w)))
                made.append(pa.array(out.ravel(), mask=bad[rows[:, None], cols[None, :]].ravel()))
            columns = list(batch.columns)
            columns[at["data"]] = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * (height * width), pa.int32()), pa.concat_arrays(made) if made else pa.array([], pa.float64()))
            for name, size in (("height", height), ("width", width)):
                columns[at[name]] = pa.array(np.full(len(made), size), pa.int32())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return tiles.mapInArrow(run, tiles.schema)


@lru_cache(maxsize=64)
def centre_weights(old: int, new: int) -> np.ndarray:
    """Weights of old cells for new ones by cell centres, one row for each new cell."""
    at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
    low = np.floor(at).astype(int)
    out = np.zeros((new, old))
    out[np.arange(new), low] += 1 - (at - low)
    out[np.arange(new), np.minimum(low + 1, old - 1)] += at - low
    return out


def nearest(tiles: DataFrame, height: int, width: int) -> DataFrame:
    """Tiles resampled to the cell under each new centre: floor((i + 0.5) * old / new)."""
    data = F.expr(f"flatten(transform(sequence(0, {height - 1}), r -> transform(sequence(0, {width - 1}), c -> get(data, cast(floor((r + 0.5D) * height / {height}) as int) * width + cast(floor((c + 0.5D) * width / {width}) as int)))))")
    return tiles.withColumn("data", data).withColumns({"height": F.lit(height), "width": F.lit(width)})


def dilated(cells: DataFrame, keys: list[str], radius: int, height: int, width: int) -> DataFrame:
    """Distinct keys, row, col within a Manhattan distance of the given cells, clipped to the scene; for small radii."""
    span = lambda n: F.sequence(-n, n)
    out = cells.select(*keys, "row", "col", F.explode(span(F.lit(radius))).alias("dr"))
    out = out.select(*keys, (F.col("row") + F.col("dr")).alias("row"), "col", F.explode(span(F.lit(radius) - F.abs("dr"))).alias("dc"))
    out = out.select(*keys, "row", (F.col("col") + F.col("dc")).alias("col"))
    return out.where(f"row >= 0 and row < {height} and col >= 0 and col < {width}").distinct()


def manhattan_dilation(mask: np.ndarray, radius: int) -> np.ndarray:
    """A 2-D mask grown by a diamond of this radius: a two-pass distance transform, for any radius."""
    far = mask.shape[0] + mask.shape[1] + radius + 1
    d = np.where(mask, 0, far).astype(np.int64)
    for axis in (0, 1):
        n = d.shape[axis]
        steps = np.arange(n).reshape((-1, 1) if axis == 0 else (1, -1))
        ahead = np.minimum.accumulate(d - steps, axis=axis) + steps
        back = np.flip(np.minimum.accumulate(np.flip(d + steps, axis), axis=axis), axis) - steps
        d = np.minimum(ahead, back)
    return d <= radius


def dilated_tiles(tiles: DataFrame, radius: int = params.DILATION_PIXELS) -> DataFrame:
    """Boolean tiles grown by a diamond; a tile must bring a margin of radius cells if its scene goes on beyond it."""
    ship(tiles.sparkSession)
    at = {c: k for k, c in enumerate(tiles.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(at[c]).to_pylist() for c in ("data", "height", "width")), strict=True)
            made = [None if d is None else manhattan_dilation(np.array([bool(x) for x in d]).reshape(h, w), radius).ravel() for d, h, w in rows]
            columns = list(batch.columns)
            columns[at["data"]] = pa.array(made, pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return tiles.mapInArrow(run, tiles.schema)


def rectangle_cells(rects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct cells of rectangles (left, top, width, height)."""
    keys = keys or []
    out = rects.select(*keys, "left", "width", F.explode(F.expr("sequence(top, top + height - 1)")).alias("row"))
    return out.select(*keys, "row", F.explode(F.expr("sequence(left, left + width - 1)")).alias("col")).distinct()


def masked_surfaces(polygons: DataFrame, classes: tuple[str, ...] = params.MASKED_SURFACES) -> DataFrame:
    """Polygons of the surfaces that are masked."""
    return polygons.where(F.col("surface").isin(*classes))


def erased(cells: DataFrame, mask: DataFrame, value: str = "value") -> DataFrame:
    """Cells with value 0 where the mask (row, col) covers them."""
    hit = mask.select("row", "col").distinct().withColumn("_hit", F.lit(True))
    out = cells.join(hit, ["row", "col"], "left")
    return out.withColumn(value, F.when(F.col("_hit"), F.lit(0).cast(cells.schema[value].dataType)).otherwise(F.col(value))).drop("_hit")


def _edges(rings: list[list[tuple[float, float]]]) -> tuple[np.ndarray, ...]:
    """x1, y1, x2, y2 of all edges of rings."""
    points = [np.asarray(r, dtype=float).reshape(-1, 2) for r in rings if len(r)]
    if not points:
        return (np.empty(0),) * 4
    one, two = np.concatenate(points), np.concatenate([np.roll(p, -1, axis=0) for p in points])
    return one[:, 0], one[:, 1], two[:, 0], two[:, 1]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): each index with the integers from first up to last."""
    n = np.maximum(last - first, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def touched_cells(rings: list[list[tuple[float, float]]], height: int, width: int) -> np.ndarray:
    """Cells of a grid (x to the right, y downwards, unit cells) that a polygon touches: inside by the
    even-odd rule at the centre, or crossed by an edge. By scan lines: work is edges' rows and cells."""
    return inside_cells(rings, height, width) | edge_cells(rings, height, width)


def inside_cells(rings: list[list[tuple[float, float]]], height: int, width: int) -> np.ndarray:
    """Cells whose centre is inside by the even-odd rule: crossings to the left of a centre are counted along its row."""
    x1, y1, x2, y2 = _edges(rings)
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    # rows with low <= centre < high
    first, last = np.ceil(low - 0.5), np.ceil(high - 0.5)
    which, rows = _spread(np.clip(first, 0, height).astype(np.int64), np.clip(last, 0, height).astype(np.int64))
    cut = (x2[which] - x1[which]) * (rows + 0.5 - y1[which]) / (y2[which] - y1[which]) + x1[which]
    # a crossing at x toggles all centres from there on
    cols = np.clip(np.ceil(cut - 0.5), 0, width).astype(np.int64)
    toggles = np.zeros((height, width + 1), dtype=np.int64)
    np.add.at(toggles, (rows, cols), 1)
    return np.cumsum(toggles, axis=1)[:, :width] % 2 == 1


def edge_cells(rings: list[list[tuple[float, float]]], height: int, width: int) -> np.ndarray:
    """Cells whose interior an edge meets; one along a grid line meets none. In each row an edge spans a range of columns."""
    x1, y1, x2, y2 = _edges(rings)
    flat = y1 == y2
    some = ~((flat & (y1 == np.floor(y1))) | ((x1 == x2) & (x1 == np.floor(x1))))
    x1, y1, x2, y2, flat = x1[some], y1[some], x2[some], y2[some], flat[some]
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    first, last = np.floor(low), np.maximum(np.ceil(high), np.floor(low) + 1)
    which, rows = _spread(np.clip(first, 0, height).astype(np.int64), np.clip(last, 0, height).astype(np.int64))
    tall = np.where(flat, 1.0, y2 - y1)[which]
    ends = [np.where(flat[which], end, np.clip((rows + end - y1[which]) / tall, 0.0, 1.0)) for end in (0, 1)]
    xs = [x1[which] + t * (x2 - x1)[which] for t in ends]
    a, b = np.minimum(*xs), np.maximum(*xs)
    begin, end = np.floor(a), np.maximum(np.ceil(b), np.floor(a) + 1)
    steps = np.zeros((height, width + 1), dtype=np.int64)
    np.add.at(steps, (rows, np.clip(begin, 0, width).astype(np.int64)), 1)
    np.add.at(steps, (rows, np.clip(end, 0, width).astype(np.int64)), -1)
    return np.cumsum(steps, axis=1)[:, :width] > 0


def polygon_cells(polygons: DataFrame, keys: list[str], height: int, width: int, transform: tuple[float, ...]) -> DataFrame:
    """keys, row, col, crossed: cells of a grid that the polygons (geom_wkb) touch; crossed if an edge meets the cell.

    transform is the grid's affine map without rotation.
    """
    ship(polygons.sparkSession)
    a, _, c, _, e, f = transform
    kinds = {x.name: x.dataType.simpleString() for x in polygons.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["row int", "col int", "crossed boolean"])

    def run(batches):
        import pandas as pd

        from .vector import from_wkb

        for batch in batches:
            for k, wkb in enumerate(batch["geom_wkb"]):
                inside, crossed = np.zeros((height, width), bool), np.zeros((height, width), bool)
                for polygon in from_wkb(bytes(wkb)) if wkb is not None else []:
                    local = [[((x - c) / a, (y - f) / e) for x, y in ring] for ring in polygon]
                    edges = edge_cells(local, height, width)
                    inside |= inside_cells(local, height, width) | edges
                    crossed |= edges
                rows, cols = np.nonzero(inside)
                made = {x: [batch[x].iloc[k]] * len(rows) for x in keys}
                yield pd.DataFrame({**made, "row": rows.astype(np.int32), "col": cols.astype(np.int32), "crossed": crossed[rows, cols]})

    return polygons.select(*keys, "geom_wkb").mapInPandas(run, schema)


def label_areas(pixels: DataFrame, keys: list[str], kind: str = "coded") -> DataFrame:
    """area_km2 and pixels of each label from cells with their scene's affine map (transform), corrected for latitude."""
    t = F.col("transform")
    x = scalar.pixel_x(t[0], t[1], t[2], F.col("row"), F.col("col"))
    y = scalar.pixel_x(t[3], t[4], t[5], F.col("row"), F.col("col"))
    km2 = projection.true_area_km2(F.abs(t[0]), projection.latitude(x, y), kind)
    return pixels.select(*keys, "label", km2.alias("km2")).groupBy(*keys, "label").agg(F.sum("km2").alias("area_km2"), F.count("*").cast("int").alias("pixels"))


def warped(grid: DataFrame, source: tuple[float, float, float, float], target: tuple[float, float, float], rows: int, cols: int, value: str = "depth", cells: DataFrame | None = None) -> DataFrame:
    """A grid in degrees resampled bilinearly to polar metres: (row, col, value) of rows x cols cells, or of the given ones only.

    source: longitude and latitude of the first cell's centre and their steps (latitude may run down);
    target: x and y of the top left corner and the cell size. A cell with any of its four source cells
    missing is NULL.
    """
    lon0, lat0, dlon, dlat = source
    x0, y0, step = target
    spark = grid.sparkSession
    if cells is None:
        cells = spark.range(rows * cols).select(F.expr(f"cast(id div {cols} as int)").alias("row"), F.expr(f"cast(id % {cols} as int)").alias("col"))
    x, y = F.lit(x0) + (F.col("col") + 0.5) * step, F.lit(y0) - (F.col("row") + 0.5) * step
    at = cells.withColumns({"_c": (projection.longitude(x, y) - lon0) / dlon, "_r": (projection.latitude(x, y) - lat0) / dlat})
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    at = at.withColumn("_k", F.explode(near)).withColumns({"_sr": F.floor("_r") + F.col("_k.i"), "_sc": F.floor("_c") + F.col("_k.j")})
    weight = (1 - F.abs(F.col("_r") - F.col("_sr"))) * (1 - F.abs(F.col("_c") - F.col("_sc")))
    from_ = grid.select(F.col("row").alias("_sr"), F.col("col").alias("_sc"), F.col(value).alias("_v"))
    met = at.withColumn("_w", weight).join(from_, ["_sr", "_sc"], "left")
    out = met.groupBy("row", "col").agg(F.sum(F.col("_w") * F.col("_v")).alias(value), F.count_if(F.col("_v").isNull() & (F.col("_w") > 0)).alias("_missing"))
    return out.select("row", "col", F.when(F.col("_missing") == 0, F.col(value)).alias(value))


def predicted(tiles: DataFrame, scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = params.Detect.batch_size) -> DataFrame:
    """Masks (0 or 255) of patches by a scorer of logits, batch by batch.

    scorer() is called once per task, where it loads its weights, and returns a function from arrays
    (n, height, width), with invalid cells as 0, to logits of that shape. Cells that are invalid or
    within two cells of an invalid one become 0.
    """
    ship(tiles.sparkSession)
    at = {c: k for k, c in enumerate(tiles.columns)}
    schema = ", ".join(f"`{f.name}` {'array<int>' if f.name == 'data' else f.dataType.simpleString()}" for f in tiles.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for rows in batches:
            heights, widths = rows.column(at["height"]).to_pylist(), rows.column(at["width"]).to_pylist()
            values = [np.array(v, dtype=float).reshape(h, w) for v, h, w in zip(rows.column(at["data"]).to_pylist(), heights, widths, strict=True)]
            made: list = [None] * len(values)
            for shape in sorted({v.shape for v in values}):
                same = [k for k, v in enumerate(values) if v.shape == shape]
                for a in range(0, len(same), batch):
                    part = same[a : a + batch]
                    stack = np.stack([values[k] for k in part])
                    fine = np.isfinite(stack)
                    mask = (1 / (1 + np.exp(-score(np.where(fine, stack, 0.0)))) > 0.5) & fine
                    for k, m, ok in zip(part, mask, fine, strict=True):
                        made[k] = np.where(grown(~ok, 2), 0, m * 255).ravel().astype(np.int32)
            columns = list(rows.columns)
            columns[at["data"]] = pa.array(made, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, rows.schema.names)

    return tiles.mapInArrow(run, schema)


def grown(mask: np.ndarray, reach: int) -> np.ndarray:
    """A mask grown by a square of 2 * reach + 1 cells."""
    out = mask.copy()
    for axis in (0, 1):
        base = out.copy()
        for k in range(1, reach + 1):
            ahead, back = [slice(None)] * 2, [slice(None)] * 2
            ahead[axis], back[axis] = slice(k, None), slice(None, -k)
            out[tuple(ahead)] |= base[tuple(back)]
            out[tuple(back)] |= base[tuple(ahead)]
    return out
