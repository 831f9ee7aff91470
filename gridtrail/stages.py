"""The five stages from files to files: detect, extract, identify, physical, export.

Each is one lazy plan from its inputs to its writer; outputs that exist already are skipped where a stage
works scene by scene. Rasters are read by windows, so a row holds no more than a block of a scene, and
files are written by the executors. Folders are shared by all executors.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import params, schemas
from .functions import scalar
from .operators import labels, model, pairing, qc, raster, shapes, summary, tracking, vector
from .session import ship
from .sources import gpkg, tables, tiff
from .storage import Scratch, exists


def _url(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def _plain(path: str) -> str:
    return path.removeprefix("file://")


def detect(spark: SparkSession, input_dir: str, output_dir: str, scorer: Callable | None = None, p: params.Detect = params.Detect(), canvas: int = params.CANVAS) -> int:
    """Masks {timestamp}_mask.tif of all scenes below input_dir, in the same subfolders; returns how many were made.

    scorer is a scorer factory (operators.model); it sees patches brought to canvas x canvas cells.
    """
    scenes = tiff.read_scenes(spark, _url(input_dir)).withColumn("scene_id", F.col("path"))
    # bytes become 0 to 1, other kinds of numbers stay
    scenes = scenes.withColumn("data", F.when(F.col("dtype") == "uint8", F.transform("data", lambda v: v / 255)).otherwise(F.col("data")))
    inner = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + os.path.abspath(_plain(input_dir)).replace(".", r"\.") + "/?", "")
    folder = F.regexp_replace(inner, "[^/]*$", "")
    scenes = scenes.withColumn("name", F.concat(folder, "Timestamp", F.lit("_mask.tif")))
    scenes = scenes.join(tiff.names(spark, _url(output_dir), "*_mask.tif", True), "name", "left_anti").dropDuplicates(["name"])
    cut = raster.patches(scenes, raster.grid_of(F.col("height"), p.patch_size), raster.grid_of(F.col("width"), p.patch_size))
    masks = raster.predicted(cut, model.on_canvas(scorer or model.contrast_scorer(), canvas), p.batch_size)
    whole = Scratch(spark, "detect").keep(raster.stitched(masks, ["name", "transform"]), "masks")
    tiff.write_scenes(whole, _plain(output_dir))
    return whole.count()


#: Bytes of polygons that are sent along with the tasks; more of them are joined to the tiles that they meet.
POLYGON_BYTES = 64 << 20
#: Cells of a window's side where a raster is only read.
WINDOW = 512


def erased_tile(data: np.ndarray, row0: int, col0: int, transform: list[float], polygons: list[list], reach: int) -> np.ndarray:
    """A tile with the cells that the polygons touch, grown by a diamond of reach cells, set to 0; row0, col0: its place in the scene."""
    h, w = data.shape
    mask = np.zeros((h + 2 * reach, w + 2 * reach), dtype=bool)
    x0, y0 = transform[2] + transform[0] * (col0 - reach), transform[5] + transform[4] * (row0 - reach)
    for polygon in polygons:
        mask |= raster.touched_cells([[((x - x0) / transform[0], (y - y0) / transform[4]) for x, y in ring] for ring in polygon], *mask.shape)
    hit = raster.manhattan_dilation(mask, reach)[reach : reach + h, reach : reach + w] if mask.any() else mask[:h, :w]
    return np.where(hit, 0.0, data)


def _tile_box(reach: int) -> list:
    """Columns of the box in map coordinates that a tile, grown by reach cells, takes."""
    t = F.col("transform")
    xs = [t[2] + t[0] * (F.col("col0") - reach), t[2] + t[0] * (F.col("col0") + F.col("width") + reach)]
    ys = [t[5] + t[4] * (F.col("row0") - reach), t[5] + t[4] * (F.col("row0") + F.col("height") + reach)]
    return [F.least(*xs).alias("bx0"), F.least(*ys).alias("by0"), F.greatest(*xs).alias("bx1"), F.greatest(*ys).alias("by1")]


def erase_polygons(tiles: DataFrame, polygons: DataFrame, reach: int = params.DILATION_PIXELS, most_bytes: int = POLYGON_BYTES) -> DataFrame:
    """Tiles (row0, col0, height, width, transform, data) without the cells that polygons (geom_wkb, box) touch, or near them."""
    spark = tiles.sparkSession
    ship(spark)
    names, at = tiles.columns, {c: k for k, c in enumerate(tiles.columns)}
    few = polygons.agg(F.sum(F.octet_length("geom_wkb"))).first()[0] or 0
    shape = lambda wkb: vector.from_wkb(bytes(wkb))

    def cleaned(batch: pa.RecordBatch, found: list[list]) -> pa.RecordBatch:
        columns = list(batch.columns)
        get = lambda c: batch.column(at[c]).to_pylist()
        made = []
        for k, (r, c, h, w, t) in enumerate(zip(*map(get, ("row0", "col0", "height", "width", "transform")), strict=True)):
            data = batch.column(at["data"])[k].values
            held = erased_tile(data.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(h, w), r, c, t, found[k], reach).ravel()
            made.append(pa.array(held, mask=np.isnan(held)))
        columns[at["data"]] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.concat_arrays(made))
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    if few <= most_bytes:
        sent = [polygon for r in polygons.where("geom_wkb is not null").select("geom_wkb").collect() for polygon in shape(r["geom_wkb"])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield cleaned(batch, [sent] * batch.num_rows)

        return tiles.mapInArrow(run, tiles.schema)
    # tiles and polygons meet in cells of a grid as wide as a tile
    held = Scratch(spark, "erase").keep(tiles.withColumn("tile", F.monotonically_increasing_id()), "tiles")
    boxes = held.select("tile", *_tile_box(reach))
    side = boxes.agg(F.max(F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")))).first()[0] or 1.0
    over = lambda low, high: F.explode(F.sequence(F.floor(low / side), F.floor(high / side)))
    boxes = boxes.withColumn("gx", over(F.col("bx0"), F.col("bx1"))).withColumn("gy", over(F.col("by0"), F.col("by1")))
    areas = polygons.where("geom_wkb is not null").withColumn("gx", over(F.col("min_x"), F.col("max_x"))).withColumn("gy", over(F.col("min_y"), F.col("max_y")))
    met = boxes.join(areas, ["gx", "gy"]).where("min_x <= bx1 and bx0 <= max_x and min_y <= by1 and by0 <= max_y").select("tile", "geom_wkb").distinct()

    def erase(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [polygon for wkb in right.column("geom_wkb").to_pylist() for polygon in shape(wkb)]
        batches = left.select(names).combine_chunks().to_batches()
        return pa.Table.from_batches([cleaned(b, [found] * b.num_rows) for b in batches]) if batches else left.select(names)

    met = met.toDF("met_tile", "geom_wkb")
    return held.groupBy("tile").cogroup(met.groupBy("met_tile")).applyInArrow(erase, tiles.schema)


def extract(spark: SparkSession, mask_dir: str, output_dir: str, coastline: str | None = None, layer: str | None = None, p: params.Extract = params.Extract()) -> int:
    """Region files and label rasters of all masks; returns the number of frames.

    Masks are read, erased and labelled by p.block_rows x p.block_cols blocks, whose components are joined
    over their borders; the result doesn't depend on the blocks. With a coastline its masked surfaces are erased first, and outputs are named coastline_*, else raw_*.
    Labels run from 1 in the order of a component's first cell. Scenes without a positive cell make no
    files; those of which no component is large enough make an empty region file.
    """
    prefix = "coastline_" if coastline else "raw_"
    blocks = tiff.blocks_of(p.block_rows, p.block_cols)
    masks = tiff.read_scenes(spark, _url(mask_dir), "*_mask.tif", recursive=bool(coastline), windows=blocks)
    is_byte = F.col("dtype").isin("uint8", "int8")
    done = tiff.names(spark, _url(output_dir), f"{prefix}regions_*.json").select(F.regexp_extract("name", r"regions_(.*)\.json$", 1).alias("Timestamp"))
    wanted = tiff.listed(spark, _url(mask_dir), "*_mask.tif", bool(coastline)).where("Timestamp is not null").groupBy("Timestamp").agg(F.min("path").alias("path"))
    wanted = wanted.join(done, "Timestamp", "left_anti")
    masks = masks.join(wanted, ["Timestamp", "path"], "left_semi")
    if coastline:
        surfaces = ", ".join(f"'{s}'" for s in params.MASKED_SURFACES)
        polygons = gpkg.read_layer(spark, coastline, layer, polar=True).where(f"surface in ({surfaces})")
        if polygons.isEmpty():
            raise ValueError("no masked surface in the coastline")
        masks = erase_polygons(masks, polygons)
    flag = F.transform("data", lambda v: raster.positive(v, is_byte))
    scratch = Scratch(spark, "extract")
    place = ["Timestamp", "image_height", "image_width", "transform"]
    tiles = masks.select(*place, F.col("Timestamp").alias("scene_id"), "row0", "col0", "height", "width", flag.alias("data"))
    tiles = scratch.keep(tiles.where(F.exists("data", lambda v: v)), "tiles")
    scenes = scratch.keep(tiles.groupBy("Timestamp").agg(*[F.first(c).alias(c) for c in place[1:]]), "scenes")
    cells = labels.merged(labels.labelled(tiles, ["Timestamp"], "image_width", rim=True).drop("scene_id"), ["Timestamp"])
    cells = scratch.keep(cells, "cells")
    stats = labels.region_stats(cells, ["Timestamp"], p.min_area)
    order = F.row_number().over(Window.partitionBy("Timestamp").orderBy("old"))
    stats = stats.join(scenes.select("Timestamp", "transform"), "Timestamp").withColumnsRenamed({"label": "old"}).withColumn("label", order.cast("bigint"))
    stats = scratch.keep(stats, "stats")
    tables.write_regions(labels.region_records(stats, "Timestamp"), _plain(output_dir), prefix, scenes)
    numbers = cells.withColumnRenamed("label", "old").join(stats.select("Timestamp", "old", "label"), ["Timestamp", "old"])

    def filled(scene: pa.Table, found: pa.Table) -> pa.Table:
        """The label raster of one scene."""
        if not scene.num_rows:
            return pa.table({"name": pa.array([], pa.string()), "content": pa.array([], pa.binary())})
        stamp, h, w, t = (scene.column(c)[0].as_py() for c in place)
        label = found.column("label").to_numpy()
        data = np.zeros((h, w), dtype=np.uint16 if not len(label) or label.max() <= 65535 else np.uint32)
        data[found.column("row").to_numpy(), found.column("col").to_numpy()] = label
        content = tiff.encode(tiff.Raster(data, tuple(t), 3031, 0), True, 2)
        return pa.table({"name": pa.array([f"{prefix}labeled_mask_{stamp}.tif"]), "content": pa.array([content], pa.binary())})

    made = scenes.groupBy("Timestamp").cogroup(numbers.select("Timestamp", "row", "col", "label").groupBy("Timestamp")).applyInArrow(filled, "name string, content binary")
    tiff.write_files(made, _plain(output_dir))
    return scenes.count()


def label_cells(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """(Timestamp, scene_id, row, col, label, height, width, transform) of the label rasters' positive cells.

    A timestamp without a raster of this prefix has the one without any.
    """
    names = lambda files: files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "Timestamp")
    files = names(tiff.listed(spark, _url(folder), "*labeled_mask_*.tif", recursive=False)).where("Timestamp is not null")
    paths = tables.mask_paths(files.select("Timestamp").distinct(), files.select("name", "path"), prefix)
    tiles = tiff.read_scenes(spark, _url(folder), "*labeled_mask_*.tif", recursive=False, windows=tiff.windows_of(WINDOW))
    tiles = tiles.join(paths.select(F.col("tif_path").alias("path")).where("path is not null"), "path", "left_semi")
    cells = tiles.select("Timestamp", "row0", "col0", "width", "image_height", "image_width", "transform", F.posexplode("data").alias("i", "v")).where("v > 0")
    row, col = F.expr("cast(row0 + i div width as int)"), F.expr("cast(col0 + i % width as int)")
    return cells.select("Timestamp", F.col("Timestamp").alias("scene_id"), row.alias("row"), col.alias("col"), F.col("v").cast("bigint").alias("label"), F.col("image_height").alias("height"), F.col("image_width").alias("width"), "transform")


def _prefix(spark: SparkSession, folder: str) -> str:
    found = [m for m in ("coastline", "raw") if not tiff.names(spark, _url(folder), f"{m}_*").isEmpty()]
    if not found:
        raise ValueError(f"no coastline_ or raw_ files in {folder}")
    return f"{tables.mode_of([f'{m}_' for m in found])}_"


def identify(spark: SparkSession, folder: str, output_csv: str, p: params.Identify = params.Identify(), overwrite: bool = False) -> DataFrame:
    """Tracks of the regions in a folder, written as a folder with one CSV, unless that exists; returns them.

    Tiles follow the first label raster.
    """
    if exists(spark, _url(output_csv)) and not overwrite:
        return tables.read_table(spark, _url(output_csv))
    prefix = _prefix(spark, folder)
    scratch = Scratch(spark, "identify")
    stamps = tables.frames(spark, _url(folder), prefix)
    stamps = scratch.keep(stamps.withColumn("frame", F.row_number().over(Window.orderBy("Timestamp"))), "frames")  # one row a frame
    last = stamps.count()
    cells = scratch.keep(label_cells(spark, folder, prefix), "cells")
    first = cells.orderBy("Timestamp").select("height", "width").first()
    stats = labels.region_stats(cells, ["Timestamp"])
    lists = cells.groupBy("Timestamp", "label").agg(F.collect_list((F.col("row") * F.col("width") + F.col("col")).cast("int")).alias("cells"))
    shaped = shapes.described(cells.select("Timestamp", "row", "col", "label"), ["Timestamp"]).select("Timestamp", "label", "axis", "hu")
    regions = tables.read_regions(spark, _url(folder), prefix).select("Timestamp", "label", "geo_centroid", "pixel_centroid", "unique_id", F.col("area").alias("region_area"))
    rows = regions.join(stats, ["Timestamp", "label"]).join(lists, ["Timestamp", "label"]).join(shaped, ["Timestamp", "label"]).join(stamps, "Timestamp")
    rows = pairing.tiled(rows, first["height"], first["width"], p.rows, p.cols)
    rows = scratch.keep(rows.withColumns({"orbit": F.lit(0), "last_frame": F.lit(last)}), "regions")
    seen = tracking.tracks(rows, p, first["width"]).drop("cx", "cy", "area")
    about = rows.select("frame", "label", "Timestamp", "geo_centroid", "pixel_centroid", "unique_id", "region_area")
    out = seen.join(about, ["frame", "label"]).select(
        "Track_ID", "Timestamp", F.col("tile_col").alias("Tile_X"), F.col("tile_row").alias("Tile_Y"),
        F.col("pixel_centroid")[0].alias("Centroid_X"), F.col("pixel_centroid")[1].alias("Centroid_Y"), F.col("geo_centroid")[0].alias("Geo_X"), F.col("geo_centroid")[1].alias("Geo_Y"),
        F.col("region_area").alias("Area"), F.col("unique_id").alias("Unique_ID"), *schemas.names(schemas.TRACKS)[10:],
    )
    tables.write_table(out.orderBy("Track_ID", "Timestamp"), _url(output_csv), single=True)
    return tables.read_table(spark, _url(output_csv))


#: Side in metres, and corner, of the polar cells that a bathymetry in degrees is resampled to.
BED_STEP, BED_CORNER = 500.0, 4.0e6


def with_depth(spark: SparkSession, obs: DataFrame, path: str) -> DataFrame:
    """obs with Bed_Depth from a GeoTIFF in polar metres, or in degrees, resampled where there are observations; read by windows on the executors."""
    tiles = tiff.read_raster(spark, _url(path), tiff.windows_of(WINDOW))
    head = tiles.select("transform", "epsg").first()
    a, _, c, _, e, f = head["transform"]
    cells = tiles.select("row0", "col0", "width", F.posexplode("data").alias("i", "depth")).select(F.expr("row0 + i div width").cast("long").alias("row"), F.expr("col0 + i % width").cast("long").alias("col"), "depth")
    if head["epsg"] != 4326:
        return qc.grid_sample(obs, cells, c, f, a)
    places = obs.select(F.floor((F.lit(BED_CORNER) - F.col("Geo_Y")) / BED_STEP).cast("int").alias("row"), F.floor((F.col("Geo_X") + BED_CORNER) / BED_STEP).cast("int").alias("col")).distinct()
    grid = raster.warped(cells, (c + a / 2, f + e / 2, a, e), (-BED_CORNER, BED_CORNER, BED_STEP), 0, 0, cells=places)
    return qc.grid_sample(obs, grid, -BED_CORNER, BED_CORNER, BED_STEP)


def physical(spark: SparkSession, tracks_csv: str, folder: str, output_csv: str, bathymetry: str | None = None, sea_ice: str | None = None, sic_grid: tuple[float, float, float] = (-3950.0, -3950.0, 10.0), p: params.Physical = params.Physical(), overwrite: bool = False) -> DataFrame:
    """Quality-controlled observations, written as a folder with one CSV, unless that exists; returns them.

    bathymetry: a GeoTIFF in polar metres or in degrees. sea_ice: a folder of sources.tables.import_sea_ice,
    or of classic NetCDF files, with the first node and step of its grid in kilometres. What is missing counts as 0, as an unreadable source.
    """
    if exists(spark, _url(output_csv)) and not overwrite:
        return tables.read_table(spark, _url(output_csv), schemas.QC)
    obs = qc.min_epochs(tables.read_table(spark, _url(tracks_csv))).select("Track_ID", "Timestamp", "Geo_X", "Geo_Y", "Unique_ID")
    by_label = raster.label_areas(label_cells(spark, folder, _prefix(spark, folder)), ["Timestamp"])
    obs = qc.without_small(qc.with_position(qc.areas(obs, by_label)), p.min_pixels)
    obs = with_depth(spark, obs, bathymetry) if bathymetry else obs.withColumn("Bed_Depth", F.lit(0.0))
    if sea_ice:
        classic = not tiff.names(spark, _url(sea_ice), "*.nc").isEmpty()
        ice = tables.read_sea_ice(spark, _url(sea_ice)) if classic else spark.read.parquet(_url(sea_ice)).withColumn("date", F.col("date").cast("string"))
        obs = qc.sea_ice(obs, ice, *sic_grid)
    else:
        obs = obs.withColumn("SIC_Value", F.lit(0.0))
    out = qc.projected(qc.without_bad(qc.flagged(obs, p), p.min_bad_frames), schemas.names(schemas.QC))
    tables.write_table(out.orderBy("Track_ID", "Timestamp"), _url(output_csv), single=True)
    return tables.read_table(spark, _url(output_csv), schemas.QC)


def _orbit_features(spark: SparkSession, qc_csv: str, folder: str, orbit: str, origin: list, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of one orbit, their polygons and their cells on the grid that begins at origin's corner (that of the first orbit)."""
    obs = tables.read_table(spark, _url(qc_csv), schemas.QC).withColumn("Orbit", F.lit(orbit))
    obs = summary.completed(summary.canonical(obs)).withColumn("event_id", F.xxhash64("Unique_ID"))
    name = f"{len(origin)}-"
    cells = scratch.keep(label_cells(spark, folder, _prefix(spark, folder)), f"{name}cells")
    grid = cells.select("height", "width", "transform").first()
    shape = (grid["height"], grid["width"], tuple(grid["transform"]))
    t = shape[2]
    origin.append(t)
    first = origin[0]
    shift = ((t[5] - first[5]) / first[4], (t[2] - first[2]) / first[0])
    if (t[0], t[4]) != (first[0], first[4]) or any(abs(x - round(x)) > 1e-6 for x in shift):
        raise ValueError(f"the cells of orbit {orbit} don't lie on those of the first orbit")
    feats = summary.features(obs).join(qc.with_position(obs).select("Unique_ID", "Latitude", "Longitude"), "Unique_ID")
    placed = vector.geometry_status(feats.select("Unique_ID", F.col("Timestamp").alias("scene_id"), F.col("Easting_3031").alias("Geo_X"), F.col("Northing_3031").alias("Geo_Y")), cells, *shape)
    good = scratch.keep(placed.where("status = 'Success'").select("Unique_ID", "scene_id", "label"), f"{name}good")
    mine = scratch.keep(cells.join(good, ["scene_id", "label"]).select("Unique_ID", "row", "col", F.lit(1).alias("label")), f"{name}mine")
    traced = vector.traced(mine, ["Unique_ID"], t).select("Unique_ID", "geom_wkb")
    key = F.concat_ws("/", F.lit(orbit), "Unique_ID").alias("key")
    shared = mine.select(key, (F.col("row") + round(shift[0])).alias("row"), (F.col("col") + round(shift[1])).alias("col"))
    return summary.with_geometry(feats, traced).withColumn("key", F.concat_ws("/", "Orbit", "Unique_ID")), shared, cells


def export(spark: SparkSession, qc_csv: str | dict[str, str], folder: str | dict[str, str], output: str, fast_ice: str | None = None, orbit: str = "Unknown", p: params.Export = params.Export()) -> DataFrame:
    """Features of all tracks as a GeoPackage, one layer, and with fast ice one per status beside it; returns them.

    qc_csv and folder: one path each, or several by orbit; each orbit's features are written to a table
    partitioned by orbit before duplicates are removed over all of them.
    """
    tables_of = qc_csv if isinstance(qc_csv, dict) else {orbit: qc_csv}
    scratch, origin = Scratch(spark, "export"), []
    found = [_orbit_features(spark, path, folder[name] if isinstance(folder, dict) else folder, name, origin, scratch) for name, path in tables_of.items()]
    by_orbit = f"{scratch.folder}/by-orbit"
    for feats, _, _ in found:  # a few orbits
        feats.write.mode("append").partitionBy("Orbit").parquet(by_orbit)
    feats = spark.read.schema(summary.unioned([x for x, _, _ in found]).schema).parquet(by_orbit)
    mine = scratch.keep(summary.unioned([x for _, x, _ in found]).withColumn("grid", F.lit(1)), "mine")
    sizes = mine.groupBy("grid", "key").agg(F.count("*").alias("area")).join(feats.select("key", "Area_Mean_km2"), "key")
    ranked = vector.deduplicated(sizes, vector.cell_overlaps(mine, ["grid"], "key"), ["grid"], "key", "Area_Mean_km2", p.overlap_threshold, one_group=True)
    kept = feats.join(ranked.where("not dropped").select("key"), "key", "left_semi")
    if fast_ice:
        ice = gpkg.read_layer(spark, fast_ice, polar=True).where(F.col("class_id") == params.FAST_ICE_CLASS)
        # cells of the layer on a grid that holds all features
        ends = mine.agg(F.min("row"), F.min("col"), F.max("row"), F.max("col")).first()
        top, left, low, right = (x or 0 for x in ends)
        t = origin[0]
        moved = (t[0], t[1], t[2] + t[0] * left, t[3], t[4], t[5] + t[4] * top)
        covered = raster.polygon_cells(ice, [], low - top + 1, right - left + 1, moved).groupBy("row", "col").agg(F.min("crossed").alias("crossed"))
        covered = covered.select((F.col("row") + top).alias("row"), (F.col("col") + left).alias("col"), "crossed")
        met = mine.join(covered, ["row", "col"], "left").groupBy("key").agg((F.count("crossed") > 0).alias("meets"), (F.count_if(~F.col("crossed")) == F.count("*")).alias("covered"))
        kept = kept.join(met, "key").withColumn("Fast_Ice_Overlap_Status", vector.status_of(F.col("meets"), F.col("covered"))).drop("meets", "covered")
    wanted = [*schemas.names(schemas.FEATURES), "Fast_Ice_Overlap_Status"]
    final = scratch.keep(qc.projected(kept, wanted), "final")
    if fast_ice:
        layers = {r["s"]: final.where(F.col("Fast_Ice_Overlap_Status") == r["s"]) for r in final.select(F.col("Fast_Ice_Overlap_Status").alias("s")).distinct().orderBy("s").collect()}
        gpkg.write_layers(layers, _plain(output).removesuffix(".gpkg") + "_by_status.gpkg")
    gpkg.write_layers({"features": final}, _plain(output))
    return final
