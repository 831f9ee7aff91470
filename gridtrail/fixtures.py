"""Driver tables recast to the shapes of the pipeline's inputs (FIXTURES.md), and literal grids and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar
from .operators import labels

#: Cells of the literal grids.
BATHY_CELLS, BATHY_STEP = 100, 40_000.0
SIC_CELLS, SIC_STEP_KM = 120, 50.0
#: Rectangles in scene pixels: (surface, left, top, width, height) and (class_id, orbit, left, top, width, height).
COASTLINE = [("land", 0, 0, 2, 2), ("ice shelf", 6, 6, 2, 2), ("ice tongue", 0, 7, 3, 1), ("rumple", 7, 0, 1, 2), ("ocean", 3, 3, 2, 2)]
FAST_ICE = [(1, 0, 0, 4, 4), (1, 4, 0, 2, 4), (2, 4, 4, 4, 4)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track observations, one row per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    spare = lambda n, value: F.when(F.col("event_id") % n != 0, value)
    stamp = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("Track_ID"),
        stamp.alias("Timestamp"),
        scalar.unique_id(stamp, k + 1).alias("Unique_ID"),
        spare(97, F.col("value") * 8).alias("Area_km2"),
        spare(89, F.floor("value").cast("int")).alias("Area_Pixels"),
        spare(83, (-((F.col("event_id") * 7919) % 1201)).cast("double")).alias("Bed_Depth"),
        k.cast("double").alias("SIC_Value"),
        (F.lit(-2.0e6) + F.col("user_id") * 1000 + k * 40).alias("Geo_X"),
        (F.lit(1.0e6) + (F.col("event_id") % 997) * 500).alias("Geo_Y"),
        F.col("event_type").alias("Orbit"),
        F.when(F.col("user_id") % 2 == 0, "EW").otherwise("IW").alias("Swath_Mode"),
    )


def scenes(spark: SparkSession, sf_dir: str, invalid: bool = False) -> DataFrame:
    """Each embedding as a scene of 8 x 8 cells; with invalid, some cells are NULL."""
    data = F.transform("embedding", lambda v: v.cast("double"))
    if invalid:
        data = F.transform(data, lambda v, i: F.when((F.col("vec_id") * 31 + i) % 37 != 0, v))
    frame = F.dense_rank().over(Window.partitionBy("label").orderBy("vec_id"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("scene_id"), F.col("label").alias("orbit"), frame.alias("frame"),
        F.lit(0).alias("row0"), F.lit(0).alias("col0"), F.lit(8).alias("height"), F.lit(8).alias("width"), data.alias("data"),
    )


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes as masks: value > 0.1."""
    return scenes(spark, sf_dir).withColumn("data", F.transform("data", lambda v: v > 0.1))


def component_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orbit, frame, scene_id, row, col, label of the masks' positive cells."""
    return labels.labelled(masks(spark, sf_dir), ["orbit", "frame"])


def regions(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    """Components of at least so many cells."""
    return labels.region_stats(component_pixels(spark, sf_dir), ["orbit", "frame", "scene_id"], least)


def bathymetry(spark: SparkSession) -> DataFrame:
    """(row, col, depth): a literal grid from the top left corner at (-2.4e6, 2.0e6)."""
    n = F.col("id")
    depth = F.when(n % 53 != 0, (-((n * 37) % 1500)).cast("double"))
    return spark.range(BATHY_CELLS * BATHY_CELLS).select(F.floor(n / BATHY_CELLS).alias("row"), (n % BATHY_CELLS).alias("col"), depth.alias("depth"))


def sea_ice(spark: SparkSession) -> DataFrame:
    """(date, xi, yi, ice_conc): literal grids at xc = -2800 + 50 xi, yc = -400 + 50 yi kilometres; 2024-01-03 is missing."""
    n = F.col("id")
    cells = spark.range(SIC_CELLS * SIC_CELLS).select(F.floor(n / SIC_CELLS).alias("xi"), (n % SIC_CELLS).alias("yi"))
    conc = F.when((F.col("xi") + F.col("yi")) % 11 != 0, ((F.col("xi") * 7 + F.col("yi") * 13 + F.col("d") * 5) % 101).cast("double"))
    days = spark.range(1, 32).where("id <> 3").select(F.col("id").alias("d"))
    grid = cells.crossJoin(F.broadcast(days))  # 31 literal rows
    return grid.select(F.concat(F.lit("202401"), F.lpad(F.col("d").cast("string"), 2, "0")).alias("date"), "xi", "yi", conc.alias("ice_conc"))


def coastline(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COASTLINE, "surface string, left int, top int, width int, height int")


def fast_ice(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAST_ICE, "class_id int, left int, top int, width int, height int")
