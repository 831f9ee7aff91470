"""One query for each relational operator, on the recast driver tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures, params
from ..functions import scalar
from ..operators import labels, pairing, qc, raster, shapes, summary, tracking, vector

P = params.Physical(min_pixels=1, cond1_area=params.EW.cond1_area, cond2_area=params.EW.cond2_area)
AREA = 3
R6 = lambda c: F.round(c, 6)


def track_min_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.min_epochs(fixtures.observations(spark, sf_dir)).select("event_id", "Track_ID", "Timestamp", "n_epochs")


def track_pixel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.without_small(qc.min_epochs(fixtures.observations(spark, sf_dir)), 1).select("event_id", "Track_ID", "Area_Pixels")


def qc_bad_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.flagged(fixtures.observations(spark, sf_dir), P).select("event_id", "cond_1", "cond_2", "cond_3", "is_bad_frame")


def qc_track_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.quality_controlled(fixtures.observations(spark, sf_dir), P).select("event_id", "Track_ID", "Area_km2", "Bed_Depth", "SIC_Value")


def qc_step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.step_metrics(fixtures.observations(spark, sf_dir), P)


def uid_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.when(F.col("event_id") % 50 == 0, "no number").otherwise(F.col("Unique_ID"))
    obs = fixtures.observations(spark, sf_dir).withColumn("uid", uid)
    at = F.date_format(scalar.parsed_stamp(F.col("Timestamp")), "yyyy-MM-dd HH:mm:ss")
    return obs.select("event_id", scalar.label_of(F.col("uid")).alias("label"), scalar.date_token(F.col("Timestamp")).alias("date_token"), at.alias("observed_at"), scalar.mask_name(F.col("Timestamp"), "raw_").alias("mask_name"))


def orbit_track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.track_summary(fixtures.observations(spark, sf_dir))
    return out.withColumns({c: R6(c) for c in ("mean_km2", "min_km2", "max_km2", "mean_px", "mean_depth")})


def track_mid_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.middle_rows(fixtures.observations(spark, sf_dir)).select("Orbit", "Track_ID", "event_id", "Timestamp", "Unique_ID")


def range_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.range_texts(summary.track_summary(fixtures.observations(spark, sf_dir)))
    return out.select("Orbit", "Track_ID", "Date_Range", "Area_Range_px", "Area_Range_km2")


def union_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = fixtures.observations(spark, sf_dir)
    one = obs.where("Orbit = 'click'").select("event_id", "Orbit", "Area_km2")
    two = obs.where("Orbit = 'view'").select("event_id", "Orbit", "SIC_Value")
    rest = obs.where("coalesce(Orbit not in ('click', 'view'), true)").select("event_id", "Orbit", "Bed_Depth", "Area_km2")
    return summary.unioned([one, two, rest])


def manifest_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = fixtures.observations(spark, sf_dir)
    return summary.pending(obs, obs.where("event_id % 3 = 0"), ["Orbit", "Timestamp"]).select("event_id", "Orbit", "Timestamp")


def column_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = {"Track_ID": "ID", "Geo_X": "Centroid_X", "Geo_Y": "Northing_3031", "Area_Pixels": "Area_Pix_n"}
    bare = fixtures.observations(spark, sf_dir).drop("Orbit", "Swath_Mode", "Bed_Depth").withColumnsRenamed(other)
    full = summary.completed(summary.canonical(bare))
    return full.select("event_id", "Track_ID", "Area_Pixels", "Geo_X", "Geo_Y", "Orbit", "Swath_Mode", "Bed_Depth", scalar.layer_name(F.lit("a(b)")).alias("layer"))


def track_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.features(qc.quality_controlled(fixtures.observations(spark, sf_dir), P))
    keep = out.select("Global_UID", "Orbit", "Timestamp", "Unique_ID", "Date_Range", "Area_Mean_km2", "Area_Range_km2", "Area_Mean_px", "Area_Range_px", "Bed_Depth", "Swath_Mode", "Northing_3031", "Easting_3031")
    return keep.withColumns({c: R6(c) for c in ("Area_Mean_km2", "Area_Mean_px", "Bed_Depth", "Northing_3031", "Easting_3031")})


def patch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = raster.patches(fixtures.scenes(spark, sf_dir), 3, 3)
    total = F.aggregate("data", F.lit(0.0), lambda a, v: a + v)
    return cut.select("scene_id", "patch_row", "patch_col", "row0", "col0", "height", "width", F.size("data").alias("n"), R6(total).alias("total"))


def stitch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = raster.patches(fixtures.scenes(spark, sf_dir), 3, 3)
    return raster.pixels(raster.stitched(cut, ["scene_id"])).withColumn("value", R6("value"))


def threshold_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster.pixels(fixtures.scenes(spark, sf_dir, invalid=True))
    flag = raster.threshold(F.coalesce("value", F.lit(0.0)) * 10 - 1)
    out = cells.withColumn("mask", raster.byte_mask(flag, F.col("value").isNotNull()))
    return out.select("scene_id", "row", "col", "mask", raster.positive(F.col("mask"), F.lit(True)).alias("positive"))


def non_empty_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster.pixels(fixtures.scenes(spark, sf_dir)).withColumn("flag", F.col("value") > 0.35)
    return raster.non_empty(cells, "flag", ["scene_id"]).where("flag").select("scene_id", "row", "col")


def nan_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = raster.patches(fixtures.scenes(spark, sf_dir, invalid=True), 2, 2)
    cells = raster.pixels(cut, ["patch_row", "patch_col"])
    out = raster.invalid_edges(cells, ["scene_id", "patch_row", "patch_col"])
    return out.select("scene_id", "row", "col", "is_edge", "is_cleared")


def mask_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster.pixels(fixtures.scenes(spark, sf_dir)).where("value > 0.25")
    return raster.dilated(cells, ["scene_id"], 2, 8, 8).select("scene_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


def bilinear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pixels(raster.bilinear(fixtures.scenes(spark, sf_dir, invalid=True), 12, 12)).withColumn("value", R6("value"))


def nearest_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pixels(raster.nearest(fixtures.scenes(spark, sf_dir, invalid=True), 5, 3)).withColumn("value", R6("value"))


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.component_pixels(spark, sf_dir).select("scene_id", "row", "col", "label")


def block_merge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = labels.labelled(labels.blocks(fixtures.masks(spark, sf_dir), 3, 2), scene_width=8)
    return labels.merged(cells, ["scene_id"], 8, 8, 3, 2).select("scene_id", "row", "col", "label")


def relabel_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.relabelled(fixtures.component_pixels(spark, sf_dir), ["scene_id"]).select("scene_id", "label", F.col("number").cast("bigint").alias("number")).distinct()


def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fixtures.regions(spark, sf_dir, AREA)
    return out.select("scene_id", "label", "area", R6("cx").alias("cx"), R6("cy").alias("cy"), "left", "top", "width", "height")


def polygon_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster.pixels(fixtures.scenes(spark, sf_dir))
    rects = raster.rectangle_cells(raster.masked_surfaces(fixtures.coastline(spark)))
    mask = raster.dilated(rects, [], 1, 8, 8)
    return raster.erased(cells, mask).select("scene_id", "row", "col", R6("value").alias("value"))


def tile_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairing.tiled(fixtures.regions(spark, sf_dir, AREA), 8, 8, 3, 3)
    return out.select("scene_id", "label", "tile_row", "tile_col", R6("local_x").alias("local_x"), R6("local_y").alias("local_y"))


def true_area_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 1 km, scenes 20 km apart."""
    to = F.array(F.lit(1000.0), F.lit(0.0), F.lit(-1.5e6) + F.col("scene_id") * 20_000, F.lit(0.0), F.lit(-1000.0), F.lit(9.0e5))
    out = raster.label_areas(fixtures.component_pixels(spark, sf_dir).withColumn("transform", to), ["scene_id"])
    return out.select("scene_id", "label", R6("area_km2").alias("area_km2"), F.col("pixels").cast("bigint").alias("pixels"))


def grid_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal grid of half degrees of longitude 0 to 90 and latitude -60 to -80, warped to 50 km cells."""
    del sf_dir
    n = F.col("id")
    grid = spark.range(41 * 181).select(F.floor(n / 181).alias("row"), (n % 181).alias("col"), F.when(n % 97 != 0, ((n * 31) % 1000).cast("double")).alias("depth"))
    out = raster.warped(grid, (0.0, -60.0, 0.5, -0.5), (0.0, 3.0e6, 50_000.0), 60, 60)
    return out.withColumn("depth", R6("depth"))


def frame_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, matches and new regions of each frame of an orbit."""
    regions = fixtures.regions(spark, sf_dir, AREA)
    found = tracking.matched_pairs(pairing.frame_pairs(regions, 10.0).withColumn("cost", F.col("dist")), ["orbit", "frame"])
    hits = found.groupBy("orbit", "frame").agg(F.count("*").alias("matched"))
    counts = regions.groupBy("orbit", "frame").agg(F.count("*").alias("regions")).join(hits, ["orbit", "frame"], "left").fillna(0, ["matched"])
    return counts.withColumn("new", F.col("regions") - F.col("matched"))


def clipped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes moved by two cells and clipped to the scene; empty ones have no features."""
    moved = fixtures.regions(spark, sf_dir, AREA).withColumns({"left": F.col("left") + 2, "top": F.col("top") - 2})
    return pairing.clipped_boxes(moved, 8, 8).select("scene_id", "label", "left", "top", "width", "height", "is_empty")


def area_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = fixtures.observations(spark, sf_dir).drop("Area_km2", "Area_Pixels")
    known = obs.where("event_id % 7 <> 0").groupBy("Timestamp", scalar.label_of(F.col("Unique_ID")).alias("label"))
    by_label = known.agg((F.min("SIC_Value") / 4).alias("area_km2"), F.count("*").cast("int").alias("pixels")).where("label <= 80")
    readable = obs.groupBy("Timestamp").agg(F.min("event_id").alias("e")).where("e % 11 <> 0").select("Timestamp", (F.col("e") % 13 != 0).alias("ok"))
    return qc.areas(obs, by_label, readable).select("event_id", R6("Area_km2").alias("Area_km2"), "Area_Pixels")


def polar_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = qc.with_position(fixtures.observations(spark, sf_dir))
    return out.select("event_id", R6("Latitude").alias("Latitude"), R6("Longitude").alias("Longitude"))


def bathymetry_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = fixtures.observations(spark, sf_dir).drop("Bed_Depth")
    return qc.grid_sample(obs, fixtures.bathymetry(spark), -2.4e6, 2.0e6, fixtures.BATHY_STEP).select("event_id", "Bed_Depth")


def sic_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = fixtures.observations(spark, sf_dir).drop("SIC_Value")
    near = qc.sea_ice(obs, fixtures.sea_ice(spark), -2800.0, -400.0, fixtures.SIC_STEP_KM, 24.0)
    return near.select("event_id", "sic_status", "SIC_Value")


def _named(pairs: DataFrame) -> list:
    return [c for c in ("orbit", "frame", "cur_scene_id", "cur_label", "prev_scene_id", "prev_label") if c in pairs.columns]


def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairing.frame_pairs(fixtures.regions(spark, sf_dir, AREA), 2.0)
    return pairs.select(*_named(pairs), R6("dist").alias("dist"), R6("area_change").alias("area_change"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of consecutive frames without a distance gate, with overlaps and costs."""
    cells = fixtures.component_pixels(spark, sf_dir)
    stats = labels.region_stats(cells, ["orbit", "frame", "scene_id"], AREA)
    return pairing.with_costs(pairing.overlaps(pairing.frame_pairs(stats, None), cells.select("scene_id", "row", "col", "label")))


def window_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.component_pixels(spark, sf_dir)
    stats = labels.region_stats(cells, ["orbit", "frame", "scene_id"], AREA)
    pairs = pairing.overlaps(pairing.frame_pairs(stats, 10.0), cells.select("scene_id", "row", "col", "label"))
    return pairs.select(*_named(pairs), "inter", "window_union", R6("window_iou").alias("window_iou"), R6("full_iou").alias("full_iou"))


def cost_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.normalisers(_pool(spark, sf_dir), ["orbit", "frame"]).withColumns({c: R6(c) for c in ("norm_area", "norm_axis")})


def pair_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    out = pairing.pair_costs(pool.where("dist <= 10"), pairing.normalisers(pool, ["orbit", "frame"]), ["orbit", "frame"])
    return out.select(*_named(out), R6("cost").alias("cost"))


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairing.frame_pairs(fixtures.regions(spark, sf_dir, AREA), 10.0)
    out = tracking.matched_pairs(pairs.withColumn("cost", F.col("dist")), ["orbit", "frame"])
    return out.withColumn("cost", R6("cost"))


def unmatched_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = fixtures.regions(spark, sf_dir, AREA)
    found = tracking.matched_pairs(pairing.frame_pairs(regions, 10.0).withColumn("cost", F.col("dist")), ["orbit", "frame"])
    new = regions.join(found.select("orbit", "frame", F.col("cur_label").alias("label")), ["orbit", "frame", "label"], "left_anti")
    return new.groupBy("orbit").agg(F.count("*").alias("new_regions"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.component_pixels(spark, sf_dir)
    stats = labels.region_stats(cells, ["orbit", "frame", "scene_id"], AREA)
    lists = cells.groupBy("scene_id", "label").agg(F.collect_list((F.col("row") * 8 + F.col("col")).cast("int")).alias("cells"))
    shaped = shapes.described(cells.select("scene_id", "row", "col", "label"), ["scene_id"]).select("scene_id", "label", "axis", "hu")
    last = fixtures.scenes(spark, sf_dir).groupBy("orbit").agg(F.max("frame").alias("last_frame"))
    regions = pairing.tiled(stats, 8, 8, 2, 2).join(lists, ["scene_id", "label"]).join(shaped, ["scene_id", "label"]).join(last, "orbit")
    out = tracking.tracks(regions, params.Identify(rows=2, cols=2), 8)
    return out.select("Track_ID", "orbit", "tile_row", "tile_col", "birth_frame", "birth_label", "frame", "label", R6("Total_Cost").alias("Total_Cost"))


def contour_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each component in the order of the scan as a sequence, many shorter than the window."""
    cells = fixtures.component_pixels(spark, sf_dir).withColumns({"i": F.col("row") * 8 + F.col("col"), "x": F.col("col") * 13 + F.col("row") * 5})
    return pairing.smoothed(cells, ["scene_id", "label"], "i", ["x"]).select("scene_id", "label", "i", "x", "smooth_x")


def overlap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = fixtures.regions(spark, sf_dir, AREA).withColumn("rid", F.col("scene_id") * 64 + F.col("label"))
    return vector.box_pairs(regions, ["orbit"], "rid", 4).where("a < b")


def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.component_pixels(spark, sf_dir).withColumn("rid", F.col("scene_id") * 64 + F.col("label"))
    features = labels.region_stats(cells, ["orbit", "rid"], AREA).select("orbit", "rid", "area")
    out = vector.deduplicated_cells(features, cells, ["orbit"], "rid", "area")
    return out.select("orbit", "rid", "area", F.col("rank").cast("bigint").alias("rank"), "dropped")


def fast_ice_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fixtures.regions(spark, sf_dir, AREA).select("scene_id", "label", "left", "top", "width", "height")
    return vector.fast_ice_status(boxes, fixtures.fast_ice(spark), ["scene_id", "label"]).select("scene_id", "label", "Fast_Ice_Overlap_Status")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.status_counts(fast_ice_status(spark, sf_dir))


def geometry_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = fixtures.regions(spark, sf_dir, AREA)
    points = stats.select("scene_id", F.col("label").alias("rid"), (F.col("cx") * 1000 + F.when(F.col("label") % 7 == 0, 9000).otherwise(500)).alias("Geo_X"), (F.lit(8000.0) - F.col("cy") * 1000 - 500).alias("Geo_Y"))
    out = vector.geometry_status(points, fixtures.component_pixels(spark, sf_dir), 8, 8, (1000.0, 0.0, 0.0, 0.0, -1000.0, 8000.0))
    return out.select("scene_id", "rid", "label", "status")


def traced_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector.traced(fixtures.component_pixels(spark, sf_dir).select("scene_id", "row", "col", "label"), ["scene_id"])
    # a polygon's WKB holds a head of 9 bytes, and for each ring its count of 4 bytes and 16 bytes a point, the first of them twice
    rings = F.conv(F.expr("hex(reverse(substring(geom_wkb, 6, 4)))"), 16, 10).cast("long")
    corners = F.expr("(octet_length(geom_wkb) - 9) div 4")
    return out.select("scene_id", "label", "geom_area", "multipolygon", ((corners - rings * 5) / 4).cast("long").alias("corners"))


def shape_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shapes.described(fixtures.component_pixels(spark, sf_dir).select("scene_id", "row", "col", "label"), ["scene_id"])
    return out.select("scene_id", "label", R6("axis").alias("axis"), F.size("contour").alias("n_points"))


def predicted_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.model import contrast_scorer

    cut = raster.patches(fixtures.scenes(spark, sf_dir, invalid=True), 2, 2)
    return raster.pixels(raster.predicted(cut, contrast_scorer(), 35)).select("scene_id", "row", "col", F.col("value").alias("mask"))


def queries() -> dict:
    """All queries of this module by name."""
    skip = {"queries"}
    return {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k not in skip and k != "R6"}
