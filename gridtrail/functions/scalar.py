"""Scalar column functions: keys, timestamps, affine maps, costs. NaN is turned to NULL where data enter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params

STAMP = r"(\d{8}T\d{6})"


def stamp_of(name: Column) -> Column:
    """The first timestamp in a file name, NULL if there is none."""
    found = F.regexp_extract(name, STAMP, 1)
    return F.when(found != "", found)


def label_of(uid: Column) -> Column:
    """The region label at the end of a unique id, -1 where there is no number."""
    return F.coalesce(F.element_at(F.split(uid, "_region_"), -1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def unique_id(stamp: Column, label: Column) -> Column:
    return F.concat(stamp, F.lit("_region_"), label.cast("string"))


def date_token(stamp: Column) -> Column:
    """What stands before the T, or the first eight characters where there is none."""
    return F.when(stamp.contains("T"), F.element_at(F.split(stamp, "T"), 1)).otherwise(F.substring(stamp, 1, 8))


def parsed_stamp(stamp: Column) -> Column:
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss"))


def mask_name(stamp: Column, prefix: str = "") -> Column:
    """The label raster's file name of a timestamp; NULL for one that can't be parsed."""
    return F.concat(F.lit(f"{prefix}labeled_mask_"), F.date_format(parsed_stamp(stamp), "yyyyMMdd'T'HHmmss"), F.lit(".tif"))


def layer_name(orbit: Column) -> Column:
    """An orbit's name without brackets, for files and layers."""
    return F.translate(F.replace(orbit, F.lit("("), F.lit("_")), ")", "")


def clean(value: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def valid(value: Column) -> Column:
    return clean(value).isNotNull()


def or_zero(value: Column) -> Column:
    return F.coalesce(clean(value), F.lit(0.0))


def sigmoid(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))


def pixel_x(a: Column, b: Column, c: Column, row: Column, col: Column) -> Column:
    """Map coordinate of a pixel's centre; the affine map is x = a col + b row + c."""
    return c + a * (col + 0.5) + b * (row + 0.5)


def pixel_index(origin: Column, step: Column, value: Column) -> Column:
    """Row or column that holds a coordinate; both may run downwards."""
    return F.floor((value - origin) / step)


def shifted(transform: Column, row0: Column, col0: Column) -> Column:
    """The affine map (a, b, c, d, e, f) of a window that begins at row0, col0."""
    t = [transform[i] for i in range(6)]
    return F.array(t[0], t[1], t[2] + t[0] * col0 + t[1] * row0, t[3], t[4], t[5] + t[3] * col0 + t[4] * row0)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def area_change(now: Column, before: Column) -> Column:
    return F.abs(now - before) / F.greatest(before, F.lit(1.0))


def contour_cost(value: Column) -> Column:
    return F.least(F.coalesce(value, F.lit(params.CONTOUR_MISSING)), F.lit(params.CONTOUR_CAP))


def total_cost(dist: Column, area: Column, axis: Column, contour: Column) -> Column:
    w = params.COST_WEIGHTS
    return w["distance"] * dist + w["area"] * area + w["axis"] * axis + w["contour"] * contour


def finite_or_forbidden(cost: Column) -> Column:
    return F.coalesce(clean(cost), F.lit(params.FORBIDDEN))


def label_type(labels: Column) -> Column:
    """The narrowest unsigned type that holds so many labels."""
    return F.when(labels <= 65535, "uint16").otherwise("uint32")


def range_text(low: Column, high: Column) -> Column:
    return F.concat_ws(" - ", low.cast("string"), high.cast("string"))


def decimals(value: Column, places: int = 3) -> Column:
    """Fixed decimals, rounded half to even."""
    return F.bround(value.cast("decimal(38, 12)"), places).cast(f"decimal(38, {places})").cast("string")
