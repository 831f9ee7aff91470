"""Quality control of tracks: epochs, pixels, physical conditions, lookups on grids.

NULL never fulfils a condition (a NaN comparison is false in the original; NaN is NULL here).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import projection, scalar


def min_epochs(obs: DataFrame, least: int = 2) -> DataFrame:
    """Rows of tracks with at least so many rows; adds n_epochs."""
    return obs.withColumn("n_epochs", F.count(F.lit(1)).over(Window.partitionBy("Track_ID"))).where(F.col("n_epochs") >= least)


def without_small(obs: DataFrame, min_pixels: int) -> DataFrame:
    """Drop tracks of which any row has fewer pixels; NULL pixels don't count as fewer."""
    small = obs.where(F.col("Area_Pixels") < min_pixels).select("Track_ID").distinct()
    return obs.join(small, "Track_ID", "left_anti")


def conditions(p: params.Physical) -> dict[str, Column]:
    area, depth, sic = F.col("Area_km2"), F.col("Bed_Depth"), F.col("SIC_Value")
    no = F.lit(False)
    return {
        "cond_1": F.coalesce((area < p.cond1_area) & (depth < p.cond1_depth) & (sic > p.cond1_sic), no),
        "cond_2": F.coalesce((area < p.cond2_area) & (sic > p.cond2_sic), no),
        "cond_3": F.coalesce(depth < p.cond3_depth, no),
    }


def flagged(obs: DataFrame, p: params.Physical) -> DataFrame:
    """The three conditions and is_bad_frame."""
    return obs.withColumns(conditions(p)).withColumn("is_bad_frame", F.col("cond_1") | F.col("cond_2") | F.col("cond_3"))


def without_bad(flags: DataFrame, min_bad_frames: int) -> DataFrame:
    """Drop tracks with at least so many bad frames."""
    bad = flags.groupBy("Track_ID").agg(F.count_if("is_bad_frame").alias("n")).where(F.col("n") >= min_bad_frames)
    return flags.join(bad.select("Track_ID"), "Track_ID", "left_anti")


def quality_controlled(obs: DataFrame, p: params.Physical) -> DataFrame:
    """All three steps."""
    return without_bad(flagged(without_small(min_epochs(obs), p.min_pixels), p), p.min_bad_frames)


def step_metrics(obs: DataFrame, p: params.Physical) -> DataFrame:
    """(step, tracks, n_rows) of the input and after each step.

    A track's fate depends on its own rows alone, so one grouping by track tells all steps.
    """
    bad = F.expr("cond_1 or cond_2 or cond_3")
    per = obs.withColumns(conditions(p)).groupBy("Track_ID").agg(
        F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("Area_Pixels") < p.min_pixels), F.lit(False)).alias("small"), F.count_if(bad).alias("bad"),
    )
    many = F.col("n") >= 2
    large = many & ~F.col("small")
    steps = {"0_input": F.lit(True), "1_epochs": many, "2_pixels": large, "3_conditions": large & (F.col("bad") < p.min_bad_frames)}
    sums = per.agg(*[F.struct(F.lit(k).alias("step"), F.count_if(c).alias("tracks"), F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long")).alias("n_rows")).alias(k) for k, c in steps.items()])
    return sums.select(F.explode(F.array(*[F.col(f"`{k}`") for k in steps])).alias("s")).select("s.*")


def projected(df: DataFrame, names: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return df.select([c for c in names if c in have])


def with_position(obs: DataFrame) -> DataFrame:
    """Latitude and Longitude, where they aren't there yet."""
    x, y = F.col("Geo_X"), F.col("Geo_Y")
    add = {"Latitude": projection.latitude(x, y), "Longitude": projection.longitude(x, y)}
    return obs.withColumns({k: v for k, v in add.items() if k not in obs.columns})


def areas(obs: DataFrame, by_label: DataFrame, readable: DataFrame | None = None) -> DataFrame:
    """Area_km2 and Area_Pixels by (Timestamp, label), by_label having area_km2 and pixels.

    A label that isn't in its raster has 0 km2 and 0 pixels; a missing raster gives NULL km2 and 0
    pixels, one that can't be read (readable.ok false) NULL for both.
    """
    keyed = obs.withColumn("label", scalar.label_of(F.col("Unique_ID")))
    found = keyed.drop("Area_km2", "Area_Pixels").join(by_label.select("Timestamp", "label", F.col("area_km2").alias("_km2"), F.col("pixels").alias("_pixels")), ["Timestamp", "label"], "left")
    if readable is None:
        readable = by_label.select("Timestamp").distinct().withColumn("ok", F.lit(True))
    found = found.join(readable, "Timestamp", "left")
    km2 = F.when(F.col("ok"), F.coalesce("_km2", F.lit(0.0)))
    pixels = F.when(F.col("ok").isNull(), F.lit(0)).when(F.col("ok"), F.coalesce("_pixels", F.lit(0)))
    return found.withColumns({"Area_km2": km2, "Area_Pixels": pixels}).drop("label", "_km2", "_pixels", "ok")


def grid_sample(points: DataFrame, grid: DataFrame, x0: float, y0: float, step: float, name: str = "Bed_Depth", value: str = "depth") -> DataFrame:
    """The value of the grid cell (row downwards from y0, col from x0) that holds each point; NULL outside or without data."""
    cell = points.withColumns({"row": F.floor((F.lit(y0) - F.col("Geo_Y")) / step), "col": F.floor((F.col("Geo_X") - x0) / step)})
    return cell.join(grid.select("row", "col", F.col(value).alias(name)), ["row", "col"], "left").drop("row", "col")


def sea_ice(points: DataFrame, grid: DataFrame, x0: float, y0: float, step: float, tolerance: float = params.SIC_TOLERANCE_KM) -> DataFrame:
    """SIC_Value and sic_status of points by date from the nearest node of a regular grid in kilometres.

    A node without data is 0; a point further from its node than the tolerance on either axis, or off
    the grid, zeroes its whole timestamp ('out'); a missing date is 0 ('missing').
    """
    x, y = projection.sic_kilometres(F.col("Geo_X"), F.col("Geo_Y"))
    near = points.withColumns({"date": scalar.date_token(F.col("Timestamp")), "_x": (x - x0) / step, "_y": (y - y0) / step})
    near = near.withColumns({"xi": F.floor(F.col("_x") + 0.5), "yi": F.floor(F.col("_y") + 0.5)})
    far = F.greatest(F.abs(F.col("_x") - F.col("xi")), F.abs(F.col("_y") - F.col("yi"))) * step > tolerance
    dates = grid.select("date").distinct().withColumn("dated", F.lit(True))
    bounds = grid.agg(F.max("xi").alias("mx"), F.max("yi").alias("my"))
    met = near.join(dates, "date", "left").join(grid, ["date", "xi", "yi"], "left").crossJoin(F.broadcast(bounds))  # one row
    miss = far | (F.col("xi") < 0) | (F.col("yi") < 0) | (F.col("xi") > F.col("mx")) | (F.col("yi") > F.col("my"))
    met = met.withColumn("_void", F.max(miss.cast("int")).over(Window.partitionBy("Timestamp")) == 1)
    status = F.when(F.col("dated").isNull(), "missing").when(F.col("_void"), "out").otherwise("ok")
    value = F.when(status == "ok", F.coalesce("ice_conc", F.lit(0.0))).otherwise(0.0)
    return met.withColumns({"sic_status": status, "SIC_Value": value}).drop("date", "_x", "_y", "xi", "yi", "dated", "ice_conc", "mx", "my", "_void")
