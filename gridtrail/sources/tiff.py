"""GeoTIFF, classic or BigTIFF: strips or tiles, any band, uncompressed, LZW, deflate or PackBits, predictors 1 to 3,
with affine map, EPSG code and nodata. Windows are read from the blocks that they meet only.

Files are read as bytes by Spark, from any store, and decoded on the executors, whole or window by
window. The data source ``grid_file`` writes one file for each row to a folder that all executors share.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import scalar
from ..session import ship
from ..storage import exists

#: Tag numbers and codes of the format: fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, MATRIX, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, PACKBITS = 1, 5, (8, 32946), 32773
#: LZW codes of a fresh table and of the end.
CLEAR, END = 256, 257


@dataclass
class Raster:
    data: np.ndarray
    transform: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    epsg: int | None = None
    nodata: float | None = None


def lzw(data: bytes) -> bytes:
    """The bytes behind codes of 9 to 12 bits, highest bit first; widths grow one code early."""
    fresh = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, width, held, bits, last = list(fresh), [], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == END:
            break
        if code == CLEAR:
            table, width, last = list(fresh), 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None:
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = min(12, (len(table) + 1).bit_length())
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    """The bytes behind runs: a count of literal bytes, or of repeats of the next byte."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    magic = struct.unpack_from(f"{order}H", raw, 2)[0] if order else None
    if magic not in (42, 43):
        raise ValueError("not a TIFF")
    big = magic == 43
    at = struct.unpack_from(f"{order}Q" if big else f"{order}I", raw, 8 if big else 4)[0]
    count, entry, inline = ("Q", f"{order}HHQ", 8) if big else ("H", f"{order}HHI", 4)
    step, first = struct.calcsize(entry) + inline, at + struct.calcsize(f"{order}{count}")
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack_from(f"{order}{count}", raw, at)[0]):
        tag, kind, n = struct.unpack_from(entry, raw, first + step * k)
        code = TYPES.get(kind)
        if code is None:
            continue
        place = first + step * k + struct.calcsize(entry)
        if struct.calcsize(code) * n > inline:
            (place,) = struct.unpack_from(f"{order}Q" if big else f"{order}I", raw, place)
        tags[tag] = (raw[place : place + n].rstrip(b"\0"),) if code == "s" else struct.unpack_from(f"{order}{code * n}", raw, place)
    return order, tags


def _block(raw: bytes, compression: int, predictor: int, kind: np.dtype, rows: int, width: int, samples: int) -> np.ndarray:
    """One strip or tile as rows x width x samples."""
    if compression in DEFLATE:
        raw = zlib.decompress(raw)
    elif compression == LZW:
        raw = lzw(raw)
    elif compression == PACKBITS:
        raw = packbits(raw)
    elif compression != NONE:
        raise ValueError(f"compression {compression} isn't supported")
    if predictor == 3:  # bytes of a row differenced, the highest byte of all its values first
        planes = np.frombuffer(raw, dtype=np.uint8, count=rows * width * samples * kind.itemsize).reshape(rows, -1, samples)
        planes = np.add.accumulate(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, width, samples)
    block = np.frombuffer(raw, dtype=kind, count=rows * width * samples).reshape(rows, width, samples)
    return np.add.accumulate(block, axis=1, dtype=block.dtype) if predictor == 2 else block


def shape_of(raw: bytes) -> tuple[int, int]:
    """Height and width of a TIFF's first image."""
    tags = _tags(raw)[1]
    return tags[HEIGHT][0], tags[WIDTH][0]


def decode(raw: bytes, band: int = 1, window: tuple[int, int, int, int] | None = None) -> Raster:
    """A band of a TIFF's bytes, or its window (row, column, height, width); the affine map is the whole image's."""
    order, tags = _tags(raw)
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    compression, predictor, samples = (tags.get(t, (1,))[0] for t in (COMPRESSION, PREDICTOR, SAMPLES))
    if predictor not in (1, 2, 3) or not 1 <= band <= samples:
        raise ValueError(f"predictor {predictor} or band {band} of {samples} isn't supported")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(SAMPLE_FORMAT, (1,))[0]] }{tags[BITS][0] // 8}")
    apart = samples > 1 and tags.get(PLANAR, (1,))[0] == 2  # bands one after the other
    tiled = TILE_AT in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(STRIP_ROWS, (height,))[0]))
    across, down = -(-width // bw), -(-height // bh)
    top, left, high, wide = window or (0, 0, height, width)
    out = np.zeros((high, wide), dtype=kind.newbyteorder("="))
    places, sizes = (tags[TILE_AT], tags[TILE_SIZES]) if tiled else (tags[STRIP_AT], tags[STRIP_SIZES])
    for by in range(top // bh, min(down, -(-(top + high) // bh))):
        for bx in range(left // bw, min(across, -(-(left + wide) // bw))):
            k = by * across + bx + (band - 1) * across * down * apart
            y, x = by * bh, bx * bw
            rows = bh if tiled else min(bh, height - y)
            block = _block(raw[places[k] : places[k] + sizes[k]], compression, predictor, kind, rows, bw, 1 if apart else samples)
            block = block[: height - y, : width - x, 0 if apart else band - 1]
            r0, c0, r1, c1 = max(y, top), max(x, left), min(y + block.shape[0], top + high), min(x + block.shape[1], left + wide)
            out[r0 - top : r1 - top, c0 - left : c1 - left] = block[r0 - y : r1 - y, c0 - x : c1 - x]
    if MATRIX in tags:
        m = tags[MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in tags and TIEPOINT in tags:
        sx, sy, tie = tags[SCALE][0], tags[SCALE][1], tags[TIEPOINT]
        transform = (sx, 0.0, tie[3] - tie[0] * sx, 0.0, -sy, tie[4] + tie[1] * sy)
    else:
        transform = Raster.transform
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4) if keys[k + 1] == 0}
    nodata = float(tags[NODATA][0]) if NODATA in tags else None
    return Raster(out, tuple(map(float, transform)), codes.get(3072) or codes.get(2048), nodata)


def encode(raster: Raster, compress: bool = False, predictor: int = 1) -> bytes:
    """A TIFF of one strip in little-endian order."""
    data = np.ascontiguousarray(raster.data, dtype=raster.data.dtype.newbyteorder("<"))
    kind = {"u": 1, "i": 2, "f": 3, "b": 1}[data.dtype.kind]
    body = data
    if predictor == 2 and data.dtype.kind in "ui":
        body = data.copy()
        body[:, 1:] -= data[:, :-1]
    else:
        predictor = 1
    block = zlib.compress(body.tobytes()) if compress else body.tobytes()
    a, b, c, d, e, f = raster.transform
    tags: list[tuple[int, int, bytes, int]] = []

    def put(tag: int, kind_of: int, *values) -> None:
        packed = values[0] + b"\0" if kind_of == 2 else struct.pack(f"<{len(values)}{TYPES[kind_of]}", *values)
        tags.append((tag, kind_of, packed, len(packed) if kind_of == 2 else len(values)))

    put(WIDTH, 4, data.shape[1])
    put(HEIGHT, 4, data.shape[0])
    put(BITS, 3, data.dtype.itemsize * 8)
    put(COMPRESSION, 3, 8 if compress else 1)
    put(PHOTOMETRIC, 3, 1)
    put(STRIP_AT, 4, 8)
    put(SAMPLES, 3, 1)
    put(STRIP_ROWS, 4, data.shape[0])
    put(STRIP_SIZES, 4, len(block))
    put(PREDICTOR, 3, predictor)
    put(SAMPLE_FORMAT, 3, kind)
    put(MATRIX, 12, a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    if raster.epsg is not None:
        put(GEO_KEYS, 3, 1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, raster.epsg)
    if raster.nodata is not None:
        put(NODATA, 2, f"{raster.nodata:g}".encode())
    at = 8 + len(block) + len(block) % 2
    extra_at, extra, entries = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind_of, packed, n in sorted(tags):
        if len(packed) <= 4:
            entries += struct.pack("<HHI", tag, kind_of, n) + packed.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, kind_of, n, extra_at + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
    return struct.pack("<2sHI", b"II", 42, at) + block + b"\0" * (len(block) % 2) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra


SCENE = "path string, Timestamp string, row0 int, col0 int, height int, width int, transform array<double>, epsg int, nodata double, dtype string, image_height int, image_width int, data array<double>"

Window = tuple[int, int, int, int]


def whole(height: int, width: int) -> list[Window]:
    return [(0, 0, height, width)]


def windows_of(size: int) -> Callable[[int, int], list[Window]]:
    """Windows of at most size x size cells."""
    return lambda height, width: [(r, c, min(size, height - r), min(size, width - c)) for r in range(0, height, size) for c in range(0, width, size)]


def blocks_of(rows: int, cols: int) -> Callable[[int, int], list[Window]]:
    """At most rows x cols windows of ceil(size / number)."""

    def cut(height: int, width: int) -> list[Window]:
        h, w = -(-height // rows), -(-width // cols)
        return [(r, c, min(h, height - r), min(w, width - c)) for r in range(0, height, h) for c in range(0, width, w)]

    return cut


def listed(spark: SparkSession, folder: str, glob: str = "*.tif", recursive: bool = True) -> DataFrame:
    """path and Timestamp (NULL where the name has none) of the files below a folder; bytes aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive)).load(folder)
    return files.select("path", scalar.stamp_of(F.element_at(F.split("path", "/"), -1)).alias("Timestamp"))


def names(spark: SparkSession, folder: str, glob: str, recursive: bool = False) -> DataFrame:
    """The names of a folder's files, with their subfolders, listed by Spark; none where there is no folder."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "name string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive)).load(folder)
    plain = lambda c: F.regexp_replace(c, r"^\w+:/*", "/")
    at = len(re.sub(r"^\w+:/*", "/", folder).rstrip("/")) + 2
    return files.select(F.substr(plain(F.col("path")), F.lit(at)).alias("name"))


def read_scenes(spark: SparkSession, folder: str, glob: str = "*.tif", recursive: bool = True, windows: Callable[[int, int], list[Window]] = whole, band: int = 1) -> DataFrame:
    """Tiles of each file whose name has a timestamp, one for each of its windows; NaN, infinities and nodata are NULL."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive)).load(folder)
    files = files.select("path", scalar.stamp_of(F.element_at(F.split("path", "/"), -1)).alias("Timestamp"), "content").where("Timestamp is not null")
    return _tiles(files, windows, band)


def read_raster(spark: SparkSession, path: str, windows: Callable[[int, int], list[Window]] = windows_of(512), band: int = 1) -> DataFrame:
    """Tiles of one file of any name, as read_scenes has them."""
    files = spark.read.format("binaryFile").load(path)
    return _tiles(files.select("path", F.lit(None).cast("string").alias("Timestamp"), "content"), windows, band)


def _tiles(files: DataFrame, windows: Callable[[int, int], list[Window]], band: int) -> DataFrame:
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SCENE.split(", ")]
        for batch in batches:
            for path, stamp, content in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                raw = content.as_buffer().to_pybytes()
                size = shape_of(raw)
                for window in windows(*size):
                    r = decode(raw, band, window)
                    flat = r.data.ravel().astype(float)
                    bad = ~np.isfinite(flat) | (flat == r.nodata if r.nodata is not None else False)
                    data = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, mask=bad))
                    values = [path.as_py(), stamp.as_py(), *window, list(r.transform), r.epsg, r.nodata, str(r.data.dtype), *size]
                    kinds = [pa.string(), pa.string(), *[pa.int32()] * 4, pa.list_(pa.float64()), pa.int32(), pa.float64(), pa.string(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(values, kinds, strict=True)), data], names)

    return files.mapInArrow(run, SCENE)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Rows of name and content; a file appears under its name when it is whole."""
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                target = os.path.join(self.folder, name.as_py())
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.part{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(content.as_buffer())
                os.replace(part, target)
        return WriterCommitMessage()


class GridFile(DataSource):
    """df.write.format("grid_file").option("path", shared folder).mode("append").save()."""

    @classmethod
    def name(cls) -> str:
        return "grid_file"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def write_files(files: DataFrame, folder: str) -> None:
    """Write rows of name and content (binary) as files below a folder shared by the executors."""
    spark = files.sparkSession
    ship(spark)
    spark.dataSource.register(GridFile)
    files.select("name", "content").write.format("grid_file").mode("append").option("path", folder).save()


def write_scenes(scenes: DataFrame, folder: str, dtype: str = "uint8", compress: bool = False, predictor: int = 1, epsg: int | None = 3031) -> None:
    """Write rows of name, height, width, transform, data as TIFF files below a folder shared by the executors."""
    ship(scenes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, height, width, transform = (batch.column(c)[k].as_py() for c in ("name", "height", "width", "transform"))
                data = batch.column("data")[k].values.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype).reshape(height, width)
                content = encode(Raster(data, tuple(transform), epsg, 0 if compress else None), compress, predictor)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([content], pa.binary())], ["name", "content"])

    write_files(scenes.select("name", "height", "width", "transform", "data").mapInArrow(run, "name string, content binary"), folder)
