"""One feature for each track: group summary, middle observation, text ranges, column discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

#: Columns of each role: the first of the table, in its order, with one of these names; fixed values.
CANDIDATES = {
    "Track_ID": ("Track_ID", "Global_UID", "ID"),
    "Geo_X": ("Geo_X", "Centroid_X", "Easting_3031"),
    "Geo_Y": ("Geo_Y", "Centroid_Y", "Northing_3031"),
    "Swath_Mode": ("Swath Mode", "Swath_Mode"),
}
#: Columns of a role by how their names begin; fixed values.
BEGINNINGS = {"Area_Pixels": "Area_Pix"}
#: Literals for columns that are missing.
DEFAULTS = {"Orbit": "Unknown", "Swath_Mode": "EW"}


def discovered(df: DataFrame) -> dict[str, str]:
    """For each role that df has a column for, that column."""
    found = {role: next((c for c in df.columns if c in wanted), None) for role, wanted in CANDIDATES.items()}
    found |= {role: next((c for c in df.columns if c.startswith(start)), None) for role, start in BEGINNINGS.items()}
    return {role: c for role, c in found.items() if c is not None}


def canonical(df: DataFrame) -> DataFrame:
    """df with the columns found for the roles renamed to them; columns that stand in a role's place go."""
    found = discovered(df)
    spare = [role for role, c in found.items() if c != role and role in df.columns]
    return df.drop(*spare).withColumnsRenamed({c: role for role, c in found.items()})


def completed(df: DataFrame, defaults: dict[str, str] = DEFAULTS) -> DataFrame:
    """Missing columns as literals; a missing Bed_Depth is NULL; Timestamp and Orbit as text."""
    add = {k: F.lit(v) for k, v in defaults.items() if k not in df.columns}
    if "Bed_Depth" not in df.columns:
        add["Bed_Depth"] = F.lit(None).cast("double")
    out = df.withColumns(add) if add else df
    return out.withColumns({c: F.col(c).cast("string") for c in ("Timestamp", "Orbit") if c in out.columns})


def _by_time(value: str) -> Column:
    return F.struct("Timestamp", "event_id", F.col(value).alias("v"))


def track_summary(obs: DataFrame, keys: tuple[str, ...] = ("Orbit", "Track_ID")) -> DataFrame:
    """First, last and count of epochs, area ranges and means, first swath mode and mean depth of each group; one shuffle."""
    return obs.groupBy(*keys).agg(
        F.min("Timestamp").alias("first_ts"), F.max("Timestamp").alias("last_ts"), F.count("*").alias("n_epochs"),
        F.avg("Area_km2").alias("mean_km2"), F.min("Area_km2").alias("min_km2"), F.max("Area_km2").alias("max_km2"),
        F.avg("Area_Pixels").alias("mean_px"), F.min("Area_Pixels").alias("min_px"), F.max("Area_Pixels").alias("max_px"),
        F.min(_by_time("Swath_Mode"))["v"].alias("swath"), F.avg("Bed_Depth").alias("mean_depth"),
    )


def middle_rows(obs: DataFrame, keys: tuple[str, ...] = ("Orbit", "Track_ID")) -> DataFrame:
    """The row at place count // 2 (from 0) of each group in the order of time."""
    group = Window.partitionBy(*keys)
    placed = obs.withColumns({"_k": F.row_number().over(group.orderBy("Timestamp", "event_id")) - 1, "_n": F.count("*").over(group)})
    return placed.where(F.col("_k") == F.floor(F.col("_n") / 2)).drop("_k", "_n")


def range_texts(summary: DataFrame) -> DataFrame:
    """Date_Range, Area_Range_px and Area_Range_km2; groups without pixels have no feature."""
    return summary.where("min_px is not null").withColumns(
        {
            "Date_Range": scalar.range_text(F.col("first_ts"), F.col("last_ts")),
            "Area_Range_px": scalar.range_text(F.col("min_px"), F.col("max_px")),
            "Area_Range_km2": F.concat_ws(" - ", scalar.decimals(F.col("min_km2")), scalar.decimals(F.col("max_km2"))),
        }
    )


def features(obs: DataFrame, keys: tuple[str, ...] = ("Orbit", "Track_ID")) -> DataFrame:
    """Features without geometry: summary joined with the middle observation of each group."""
    table = range_texts(track_summary(obs, keys))
    middle = middle_rows(obs, keys).select(*keys, "Timestamp", "Unique_ID", "Geo_X", "Geo_Y")
    out = table.join(middle, list(keys))
    return out.select(
        F.col("Track_ID").cast("string").alias("Global_UID"), "Orbit", "Timestamp", "Unique_ID", "Date_Range",
        F.col("mean_km2").alias("Area_Mean_km2"), "Area_Range_km2", F.col("mean_px").alias("Area_Mean_px"), "Area_Range_px",
        F.col("mean_depth").alias("Bed_Depth"), F.col("swath").alias("Swath_Mode"), F.col("Geo_Y").alias("Northing_3031"), F.col("Geo_X").alias("Easting_3031"),
    )


def with_geometry(table: DataFrame, polygons: DataFrame) -> DataFrame:
    """Features that have a polygon (by Unique_ID)."""
    return table.join(polygons, "Unique_ID")


def unioned(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables whose columns may differ; missing ones are NULL."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def pending(rows: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose output isn't in the manifest yet."""
    return rows.join(manifest.select(*keys).distinct(), keys, "left_anti")
