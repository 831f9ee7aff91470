"""Connected components of masks (8 neighbours), merging over block borders, and component records.

Tiles carry ``scene_id, row0, col0, height, width, data`` with data a boolean array in row order; a
component's label is the smallest flat index (row * scene width + col) of its cells in the scene, so it
doesn't depend on how the scene was cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..storage import Scratch
from .graph import components

#: Neighbours that look forward in row order: (rows, columns).
FORWARD = ((0, 1), (1, -1), (1, 0), (1, 1))


def label_mask(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, smallest flat index of its component) of a 2-D mask's positive cells."""
    rows, cols = np.nonzero(mask)
    n = len(rows)
    at = np.full(mask.shape, -1, dtype=np.int64)
    at[rows, cols] = np.arange(n)
    pairs = []
    for dr, dc in FORWARD:
        r, c = rows + dr, cols + dc
        inside = (r < mask.shape[0]) & (c >= 0) & (c < mask.shape[1])
        other = at[np.where(inside, r, 0), np.where(inside, c, 0)]
        met = inside & (other >= 0)
        pairs.append((np.flatnonzero(met), other[met]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    root = np.arange(n)
    while True:  # hook roots to smaller ones, then flatten
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while True:
            flat = root[root]
            if np.array_equal(flat, root):
                break
            root = flat
    return rows, cols, (rows * mask.shape[1] + cols)[root] if n else rows


def labelled(tiles: DataFrame, keep: list[str] | None = None, scene_width: int | str | None = None, rim: bool = False) -> DataFrame:
    """keep columns, scene_id, row, col (in the scene) and label of every positive cell; no shuffle.

    A tile is labelled by itself. scene_width: the scene's width, or the column that holds it, where tiles
    are parts of scenes; the tile's own width otherwise. rim adds a column that tells of cells at their
    tile's border. NULL cells are background; an all-zero tile gives no rows.
    """
    ship(tiles.sparkSession)
    keep = keep or []
    names = [*keep, "scene_id"]
    kinds = {f.name: f.dataType.simpleString() for f in tiles.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["row int", "col int", "label bigint"] + ["rim boolean"] * rim)
    by_row = scene_width if isinstance(scene_width, str) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            cells = column["data"].flatten().fill_null(False).to_numpy(zero_copy_only=False)
            lengths = [0 if n is None else n for n in column["data"].value_lengths().to_pylist()]
            shapes = [column[c].to_pylist() for c in ("row0", "col0", "height", "width")]
            wides = column[by_row].to_pylist() if by_row else [scene_width] * len(lengths)
            owners, rows, cols, labels, rims, at = [], [], [], [], [], 0
            for k, (n, r0, c0, h, w) in enumerate(zip(lengths, *shapes, strict=True)):
                if n:
                    r, c, lab = label_mask(cells[at : at + n].reshape(h, w))
                    wide = wides[k] or w
                    rims.append((r == 0) | (r == h - 1) | (c == 0) | (c == w - 1))
                    owners.append(np.full(len(r), k))
                    rows.append(r + r0)
                    cols.append(c + c0)
                    labels.append((lab // w + r0) * wide + lab % w + c0)
                at += n
            if owners:
                who = pa.array(np.concatenate(owners))
                made = [pa.array(np.concatenate(x).astype(t)) for x, t in ((rows, np.int32), (cols, np.int32), (labels, np.int64))]
                made += [pa.array(np.concatenate(rims))] * rim
                yield pa.RecordBatch.from_arrays([*(column[c].take(who) for c in names), *made], [*names, "row", "col", "label"] + ["rim"] * rim)

    return tiles.select(*names, "row0", "col0", "height", "width", *([by_row] if by_row else []), "data").mapInArrow(run, schema)


def blocks(tiles: DataFrame, block_rows: int, block_cols: int) -> DataFrame:
    """Whole-scene tiles cut into at most block_rows x block_cols blocks of ceil(size / blocks)."""
    high, wide = F.ceil(F.col("height") / block_rows).cast("int"), F.ceil(F.col("width") / block_cols).cast("int")
    cut = tiles.withColumns({"_h": high, "_w": wide})
    cut = cut.withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.col("_h"))))
    cut = cut.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.col("_w"))))
    h, w = F.least("_h", F.expr("height - _r")), F.least("_w", F.expr("width - _c"))
    data = F.expr("flatten(transform(sequence(_r, _r + least(_h, height - _r) - 1), r -> slice(data, r * width + _c + 1, least(_w, width - _c))))")
    rest = [c for c in tiles.columns if c not in ("row0", "col0", "height", "width", "data")]
    return cut.select(*rest, F.col("_r").alias("row0"), F.col("_c").alias("col0"), h.alias("height"), w.alias("width"), data.alias("data"))


def merged(pixels: DataFrame, keys: list[str], height: int = 0, width: int = 0, block_rows: int = 1, block_cols: int = 1) -> DataFrame:
    """Block-wise labels joined over block borders to labels of whole scenes.

    Borders are told by a column rim, as labelled makes it, or where there is none by the scenes' size and blocks.
    Only cells beside a border meet each other; their distinct label pairs are few and go through
    min-label components. The result is that of labelling whole scenes, whatever the blocks.
    """
    scratch = Scratch(pixels.sparkSession, "merge")
    h, w = -(-height // block_rows), -(-width // block_cols)
    pixels = scratch.keep(pixels, "pixels")
    border = "rim" if "rim" in pixels.columns else f"row % {h} in (0, {h - 1}) or col % {w} in (0, {w - 1})"
    rim = pixels.where(border).select(*keys, "row", "col", "label")
    near = rim.withColumn("step", F.explode(F.array(*[F.struct(F.lit(dr).alias("r"), F.lit(dc).alias("c")) for dr, dc in FORWARD])))
    near = near.select(*keys, (F.col("row") + F.col("step.r")).alias("row"), (F.col("col") + F.col("step.c")).alias("col"), F.col("label").alias("other"))
    pairs = rim.join(near, [*keys, "row", "col"]).where("label <> other").select(*keys, "label", "other").distinct()
    node = lambda label: F.struct(*keys, F.col(label).alias("label"))
    found = components(pairs.select(node("label").alias("u"), node("other").alias("v")), scratch, "labels")
    found = found.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.label").alias("label"), F.col("comp.label").alias("root"))
    return pixels.join(found, [*keys, "label"], "left").withColumn("label", F.coalesce("root", "label")).drop("root", "rim")


def region_stats(pixels: DataFrame, keys: list[str], least: float = 0) -> DataFrame:
    """Area, centroid and bounding box of each component of at least so many cells."""
    out = pixels.groupBy(*keys, "label").agg(
        F.count("*").alias("area"), F.avg("col").alias("cx"), F.avg("row").alias("cy"),
        F.min("col").alias("left"), F.min("row").alias("top"),
        (F.max("col") - F.min("col") + 1).alias("width"), (F.max("row") - F.min("row") + 1).alias("height"),
    )
    return out.where(F.col("area") >= least)


def relabelled(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels as 1, 2, ... in each scene, in the order of the old ones."""
    names = pixels.select(*keys, "label").distinct()
    names = names.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("label")))
    return pixels.join(names, [*keys, "label"])


def region_records(stats: DataFrame, stamp: str, transform: str = "transform") -> DataFrame:
    """Region records as they are written: centroids to 2 and 6 decimals, bbox, unique id. merged_from is never set."""
    from ..functions import scalar

    t = F.col(transform)
    x, y = scalar.pixel_x(t[0], t[1], t[2], F.col("cy"), F.col("cx")), scalar.pixel_x(t[3], t[4], t[5], F.col("cy"), F.col("cx"))
    return stats.select(
        stamp, F.col("area").cast("double").alias("area"), F.array(F.bround("cx", 2), F.bround("cy", 2)).alias("pixel_centroid"),
        F.array(F.bround(x, 6), F.bround(y, 6)).alias("geo_centroid"), "label",
        F.array(*[F.col(n).cast("double") for n in ("left", "top", "width", "height")]).alias("bbox"),
        scalar.unique_id(F.col(stamp), F.col("label")).alias("unique_id"), F.lit(None).cast("array<bigint>").alias("merged_from"),
    )
