"""Region JSON, track and QC tables, and discovery of what is in a folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import ship
from . import netcdf, tiff


def read_regions(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """Region records of all {prefix}regions_{timestamp}.json files in a folder, with their Timestamp."""
    rows = spark.read.option("multiLine", True).option("pathGlobFilter", f"{prefix}regions_*.json").schema(schemas.REGION).json(folder)
    token = F.element_at(F.split(F.element_at(F.split(F.input_file_name(), "/"), -1), "_"), -1)
    return rows.withColumn("Timestamp", F.replace(token, F.lit(".json"))).where(F.length("Timestamp") == 15)


def write_regions(regions: DataFrame, folder: str, prefix: str = "", frames: DataFrame | None = None) -> None:
    """One indented JSON array for each timestamp, sorted by label, written by the executors.

    frames (Timestamp): timestamps that get a file even without a region.
    """
    ship(regions.sparkSession)
    fields = schemas.names(schemas.REGION)
    frames = regions.select("Timestamp").distinct() if frames is None else frames.select("Timestamp").distinct()

    def run(stamps, rows):
        found = [{k: v if not hasattr(v, "tolist") else v.tolist() for k, v in r.items()} for r in rows.sort_values("label")[fields].to_dict("records")]
        found = [{k: v for k, v in r.items() if k != "merged_from" or v is not None} for r in found]
        name = f"{prefix}regions_{stamps['Timestamp'].iloc[0]}.json"
        return type(stamps)({"name": [name], "content": [json.dumps(found, indent=2).encode()]}) if len(stamps) else type(stamps)({"name": [], "content": []})

    made = frames.groupBy("Timestamp").cogroup(regions.select("Timestamp", *fields).groupBy("Timestamp")).applyInPandas(run, "name string, content binary")
    tiff.write_files(made, folder)


def frames(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """Sorted distinct timestamps of a folder's region files; names whose token isn't of 15 characters don't count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}regions_*.json").load(folder).select("path")
    token = F.replace(F.element_at(F.split(F.element_at(F.split("path", "/"), -1), "_"), -1), F.lit(".json"))
    return files.select(token.alias("Timestamp")).where(F.length("Timestamp") == 15).distinct().orderBy("Timestamp")


def read_table(spark: SparkSession, path: str, schema: str = schemas.TRACKS) -> DataFrame:
    """A CSV with a header; NaN and empty fields are NULL."""
    return spark.read.option("header", True).option("nanValue", "nan").option("nullValue", "").schema(schema).csv(path)


def write_table(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of CSV files with headers; single: one file in it."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def mode_of(names: list[str]) -> str | None:
    """'coastline' or 'raw' by the prefixes of file names, the former first; None if there is neither."""
    for mode in ("coastline", "raw"):
        if any(n.startswith(f"{mode}_") for n in names):
            return mode
    return None


def mask_paths(rows: DataFrame, files: DataFrame, prefix: str) -> DataFrame:
    """rows (Timestamp) with tif_path from files (name, path): the prefixed name, else the plain one, else NULL."""
    plain = F.concat(F.lit("labeled_mask_"), F.col("Timestamp"), F.lit(".tif"))
    first = files.select(F.col("name").alias("_n1"), F.col("path").alias("_p1"))
    other = files.select(F.col("name").alias("_n2"), F.col("path").alias("_p2"))
    out = rows.withColumns({"_a": F.concat(F.lit(prefix), plain), "_b": plain})
    out = out.join(first, F.col("_a") == F.col("_n1"), "left").join(other, F.col("_b") == F.col("_n2"), "left")
    return out.withColumn("tif_path", F.coalesce("_p1", "_p2")).drop("_a", "_b", "_n1", "_n2", "_p1", "_p2")


def read_sea_ice(spark: SparkSession, folder: str, variable: str = "ice_conc") -> DataFrame:
    """(date, xi, yi, ice_conc) of the classic NetCDF files of a folder, whose names hold the date; decoded on the executors."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nc").load(folder)
    files = files.select(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d{8})", 1).alias("date"), "content").where("date <> ''")

    def run(batches):
        for batch in batches:
            for date, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield netcdf.cells(content.as_buffer().to_pybytes(), variable, date)

    return files.mapInArrow(run, "date string, xi long, yi long, ice_conc double")


def import_sea_ice(grids: DataFrame, folder: str) -> None:
    """Store daily grids (date, xi, yi, ice_conc) partitioned by date, so that readers open only the days they need."""
    grids.write.mode("overwrite").partitionBy("date").parquet(folder)
