"""Schemas of the tables that pass between stages, in the reference's column names."""

from __future__ import annotations

#: Fixed column lists and types of the exchanged files.
REGION = "area double, pixel_centroid array<double>, geo_centroid array<double>, label bigint, bbox array<double>, unique_id string, merged_from array<bigint>"
TRACKS = "Track_ID bigint, Timestamp string, Tile_X int, Tile_Y int, Centroid_X double, Centroid_Y double, Geo_X double, Geo_Y double, Area double, Unique_ID string, Centroid_Distance double, Area_Cost double, Axis_Cost double, Contour_Cost double, Total_Cost double"
QC = "Track_ID bigint, Timestamp string, Area_km2 double, Area_Pixels int, Latitude double, Longitude double, Geo_X double, Geo_Y double, Unique_ID string, Bed_Depth double, SIC_Value double"
FEATURES = "Global_UID string, Orbit string, Timestamp string, Date_Range string, Area_Mean_km2 double, Area_Range_km2 string, Area_Mean_px double, Area_Range_px string, Bed_Depth double, Swath_Mode string, Latitude double, Longitude double, Northing_3031 double, Easting_3031 double, geom_wkb binary"


def names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]
