"""GeoPackage layers by sqlite3: reference layers in, by ranges of rows on the executors; final features out, on the driver.

Files lie in a folder that all executors share.
"""

from __future__ import annotations

import sqlite3
import struct

from pyspark.sql import DataFrame, SparkSession

from ..functions import projection
from ..operators import vector
from ..session import ship

#: Bytes of an envelope by its code in the flags of a geometry header: fixed values.
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
_SQL = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB", "boolean": "INTEGER"}
_SPARK = {"INTEGER": "bigint", "INT": "bigint", "MEDIUMINT": "bigint", "SMALLINT": "bigint", "TINYINT": "bigint", "BOOLEAN": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double"}


def unpacked(blob: bytes) -> bytes:
    """The WKB of a GeoPackage geometry."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    return blob[8 + ENVELOPE[blob[3] >> 1 & 7] :]


def packed(wkb: bytes, srs: int) -> bytes:
    return b"GP" + struct.pack("<BBi", 0, 1, srs) + wkb


def layers(path: str) -> list[str]:
    with sqlite3.connect(path) as db:
        return [r[0] for r in db.execute("select table_name from gpkg_contents where data_type = 'features' order by rowid")]


def system_of(path: str, layer: str) -> int:
    """The EPSG code of a layer; 4326 where it is geographic without one, 0 where nothing is known."""
    with sqlite3.connect(path) as db:
        (srs,) = db.execute("select srs_id from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()
        known = db.execute("select organization, organization_coordsys_id from gpkg_spatial_ref_sys where srs_id = ?", (srs,)).fetchone()
    if known and known[0].upper() == "EPSG":
        return known[1]
    return 4326 if srs == 0 else 0


def read_layer(spark: SparkSession, path: str, layer: str | None = None, polar: bool = False, part_rows: int = 20_000) -> DataFrame:
    """A layer's attributes, geom_wkb and its box (min_x, min_y, max_x, max_y); the first layer by default.

    Rows are read by ranges of their numbers on the executors, so a layer may be of any size. polar:
    vertices in degrees (EPSG 4326) become EPSG 3031 metres; other systems than these raise an error.
    """
    ship(spark)
    layer = layer or layers(path)[0]
    system = system_of(path, layer)
    if polar and system not in (0, 3031, 4326):
        raise ValueError(f"layer {layer} is in EPSG:{system}, only 3031 and 4326 are supported")
    convert = polar and system == 4326
    with sqlite3.connect(path) as db:
        (geometry,) = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()
        info = db.execute(f'pragma table_info("{layer}")').fetchall()
        columns = [(r[1], _SPARK.get(r[2].upper().split("(")[0], "string")) for r in info if r[1] != geometry]
        low, high = db.execute(f'select min(rowid), max(rowid) from "{layer}"').fetchone()
    listed = ", ".join(f'"{c}"' for c, _ in [*columns, (geometry, "")])
    schema = ", ".join([f"`{c}` {t}" for c, t in columns] + ["geom_wkb binary", "min_x double", "min_y double", "max_x double", "max_y double"])

    def run(batches):
        import pandas as pd

        names = [c for c, _ in columns] + ["geom_wkb", "min_x", "min_y", "max_x", "max_y"]
        for batch in batches:
            for first in batch["first"]:
                rows = []
                with sqlite3.connect(path) as db:
                    for *values, blob in db.execute(f'select {listed} from "{layer}" where rowid >= ? and rowid < ? order by rowid', (int(first), int(first) + part_rows)):
                        wkb = unpacked(blob) if blob is not None else None
                        shape = vector.from_wkb(wkb) if wkb else []
                        if convert and shape:
                            shape = [[list(zip(*(v.tolist() for v in projection.forward_points(*zip(*ring, strict=True))), strict=True)) for ring in polygon] for polygon in shape]
                            wkb = vector.to_wkb(shape)
                        points = [p for polygon in shape for ring in polygon for p in ring]
                        box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)) if points else (None,) * 4
                        rows.append((*values, wkb, *box))
                yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    starts = [] if low is None else range(low, high + 1, part_rows)
    return spark.createDataFrame([(int(x),) for x in starts], "first long").repartition(max(1, len(starts))).mapInPandas(run, schema)


def write_layers(tables: dict[str, DataFrame], path: str, srs: int = 3031) -> None:
    """Write each DataFrame with geom_wkb as a layer of a new file; rows stream through the driver one partition at a time."""
    with sqlite3.connect(path) as db:
        db.executescript(
            """
            pragma application_id = 1196444487;
            pragma user_version = 10300;
            create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
            create table gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change datetime, min_x double, min_y double, max_x double, max_y double, srs_id integer);
            create table gpkg_geometry_columns (table_name text primary key, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null);
            """
        )
        db.executemany("insert into gpkg_spatial_ref_sys values (?, ?, ?, ?, 'undefined', null)", [("undefined cartesian", -1, "NONE", -1), ("undefined geographic", 0, "NONE", 0), (f"EPSG:{srs}", srs, "EPSG", srs)])
        for layer, df in tables.items():
            fields = [(f.name, _SQL.get(f.dataType.simpleString(), "TEXT")) for f in df.schema.fields if f.name != "geom_wkb"]
            made = ", ".join(f'"{c}" {t}' for c, t in fields)
            db.execute(f'create table "{layer}" (fid integer primary key autoincrement, {made}{", " if made else ""}geom blob)')
            db.execute("insert into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, 'features', ?, ?)", (layer, layer, srs))
            db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, srs))
            marks = ", ".join("?" * (len(fields) + 1))
            names = ", ".join([f'"{c}"' for c, _ in fields] + ["geom"])
            for row in df.select(*[c for c, _ in fields], "geom_wkb").toLocalIterator():
                *values, wkb = row
                db.execute(f'insert into "{layer}" ({names}) values ({marks})', (*values, packed(bytes(wkb), srs) if wkb is not None else None))
