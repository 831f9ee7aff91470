"""Rasters in many forms, windows, classic NetCDF, layers in degrees and in parts, blocks of scenes."""

from __future__ import annotations

import collections
import io
import json
import pickle
import struct
import sys
import types
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrail import params, stages
from gridtrail.functions import projection
from gridtrail.operators import model, raster, vector
from gridtrail.sources import gpkg, netcdf, tables, tiff

CODES = {"B": 1, "H": 3, "I": 4, "Q": 16}


def lzw_packed(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, each width one code early."""
    out, bits, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    table, width = {bytes([k]): k for k in range(256)}, 9
    put(256, 9)
    now, free = b"", 258
    for k in range(len(data)):
        longer = now + data[k : k + 1]
        if longer in table:
            now = longer
            continue
        put(table[now], width)
        table[longer], free = free, free + 1
        now = data[k : k + 1]
        if free == (1 << width):
            width += 1
        if free == 4094:
            put(table[now], width)
            put(256, width)
            table, width, free, now = {bytes([k]): k for k in range(256)}, 9, 258, b""
    if now:
        put(table[now], width)
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def made(bands: np.ndarray, order="<", big=False, tile=None, strip=7, compression=1, predictor=1, planar=1) -> bytes:
    """A TIFF of bands (band, row, column) in the given form."""
    n, h, w = bands.shape
    kind = bands.dtype
    blocks = []
    if tile:
        th, tw = tile
        places = [(r, c, th, tw) for r in range(0, h, th) for c in range(0, w, tw)]
    else:
        places = [(r, 0, min(strip, h - r), w) for r in range(0, h, strip)]
    for chosen in ([[k] for k in range(n)] if planar == 2 else [list(range(n))]):
        for r, c, bh, bw in places:
            block = np.zeros((bh, bw, len(chosen)), dtype=kind)
            part = np.moveaxis(bands[chosen, r : r + bh, c : c + bw], 0, -1)
            block[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                block[:, 1:] = block[:, 1:] - block[:, :-1]
            raw = block.astype(kind.newbyteorder(order)).tobytes()
            if predictor == 3:
                planes = np.frombuffer(block.astype(kind.newbyteorder(">")).tobytes(), np.uint8).reshape(bh, bw * len(chosen), kind.itemsize).transpose(0, 2, 1).reshape(bh, -1, len(chosen))
                moved = planes.copy()
                moved[:, 1:] = planes[:, 1:] - planes[:, :-1]
                raw = moved.tobytes()
            blocks.append({1: lambda x: x, 5: lzw_packed, 8: zlib.compress, 32773: lambda x: b"".join(bytes([0]) + x[k : k + 1] for k in range(len(x)))}[compression](raw))
    head = 16 if big else 8
    at, offsets = head, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    place, count = ("Q", "Q") if big else ("I", "H")
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [kind.itemsize * 8] * n), (259, "H", [compression]), (277, "H", [n]), (284, "H", [planar]), (317, "H", [predictor]), (339, "H", [{"u": 1, "i": 2, "f": 3}[kind.kind]] * n)]
    sizes = [len(b) for b in blocks]
    tags += [(322, "I", [tile[1]]), (323, "I", [tile[0]]), (324, place, offsets), (325, "I", sizes)] if tile else [(273, place, offsets), (278, "I", [strip]), (279, "I", sizes)]
    inline, entries, extra = (8 if big else 4), b"", b""
    extra_at = at + struct.calcsize(f"{order}{count}") + len(tags) * (20 if big else 12) + inline
    for tag, code, values in sorted(tags):
        packed = struct.pack(f"{order}{len(values)}{code}", *values)
        if len(packed) <= inline:
            value = packed.ljust(inline, b"\0")
        else:
            value = struct.pack(f"{order}{place}", extra_at + len(extra))
            extra += packed
        entries += struct.pack(f"{order}HH{place}", tag, CODES[code], len(values)) + value
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, at) if big else struct.pack(f"{order}HI", 42, at))
    return start + b"".join(blocks) + struct.pack(f"{order}{count}", len(tags)) + entries + b"\0" * inline + extra


@pytest.mark.parametrize("form", [
    {}, {"order": ">"}, {"big": True}, {"big": True, "order": ">", "tile": (16, 32)}, {"tile": (16, 16), "compression": 8}, {"compression": 5}, {"compression": 5, "tile": (32, 16), "predictor": 2},
    {"compression": 32773}, {"compression": 8, "predictor": 3}, {"order": ">", "predictor": 3, "tile": (16, 16)}, {"planar": 2}, {"planar": 2, "tile": (16, 16), "compression": 8, "predictor": 2},
])
@pytest.mark.parametrize("kind", ["uint8", "uint16", "int32", "float32", "float64"])
def test_forms_of_rasters(form, kind):
    if (form.get("predictor") == 3) != kind.startswith("float") and form.get("predictor", 1) != 1:
        return
    rng = np.random.default_rng(3)
    bands = (rng.normal(size=(3, 37, 45)) * 50).astype(kind) if kind[0] != "u" else rng.integers(0, 255, (3, 37, 45)).astype(kind)
    for n in (1, 3):
        raw = made(bands[:n], **form)
        for band in range(1, n + 1):
            assert np.array_equal(tiff.decode(raw, band).data, bands[band - 1])
            for window in ((0, 0, 5, 5), (9, 13, 20, 30), (36, 44, 1, 1)):
                r, c, h, w = window
                assert np.array_equal(tiff.decode(raw, band, window).data, bands[band - 1, r : r + h, c : c + w])
        with pytest.raises(ValueError):
            tiff.decode(raw, n + 1)


def test_lzw_of_long_blocks():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"ab" * 9000, rng.integers(0, 4, 40_000).astype(np.uint8).tobytes(), rng.integers(0, 256, 30_000).astype(np.uint8).tobytes()):
        assert tiff.lzw(lzw_packed(data)) == data


def test_windows_of_scenes(spark, tmp_path):
    data = np.arange(50 * 70, dtype=np.float32).reshape(50, 70)
    (tmp_path / "S_20240101T000000.tif").write_bytes(tiff.encode(tiff.Raster(data, (2.0, 0.0, 5.0, 0.0, -2.0, 9.0), 3031, 7.0)))
    for windows, n in ((tiff.windows_of(32), 6), (tiff.blocks_of(4, 4), 16), (tiff.whole, 1)):
        rows = tiff.read_scenes(spark, f"file://{tmp_path}", windows=windows).collect()
        assert len(rows) == n and {(r.image_height, r.image_width) for r in rows} == {(50, 70)}
        out = np.full((50, 70), -1.0)
        for r in rows:
            out[r.row0 : r.row0 + r.height, r.col0 : r.col0 + r.width] = np.array([7.0 if v is None else v for v in r.data]).reshape(r.height, r.width)
        assert np.array_equal(out, data) and sum(v is None for r in rows for v in r.data) == 1


def slow_touched(rings, height, width):
    """Cell by cell: the even-odd rule at centres, and edges cut to a cell's open interior."""
    out = np.zeros((height, width), dtype=bool)
    edges = [(p, q) for ring in rings for p, q in zip(ring, [*ring[1:], ring[0]], strict=True)]
    for r in range(height):
        for c in range(width):
            x, y = c + 0.5, r + 0.5
            inside = sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in edges) % 2 == 1
            out[r, c] = inside or any(meets(p, q, c, r) for p, q in edges)
    return out


def meets(p, q, c, r):
    """Whether a segment has points inside the open unit cell at (c, r)."""
    low, high = 0.0, 1.0
    for a, d, cell in ((p[0], q[0] - p[0], c), (p[1], q[1] - p[1], r)):
        if d == 0:
            if not cell < a < cell + 1:
                return False
        else:
            t = sorted(((cell - a) / d, (cell + 1 - a) / d))
            low, high = max(low, t[0]), min(high, t[1])
    return low < high


def test_polygons_by_scan_lines():
    rng = np.random.default_rng(5)
    for _ in range(60):
        rings = [[tuple(p) for p in rng.uniform(-4, 16, (rng.integers(3, 9), 2)).tolist()] for _ in range(rng.integers(1, 3))]
        assert np.array_equal(raster.touched_cells(rings, 11, 13), slow_touched(rings, 11, 13))
    square = [[(2.0, 3.0), (6.0, 3.0), (6.0, 8.0), (2.0, 8.0)]]
    assert np.array_equal(raster.touched_cells(square, 11, 13), slow_touched(square, 11, 13)) and raster.touched_cells(square, 11, 13).sum() == 20
    angles = np.linspace(0, 2 * np.pi, 200_000, endpoint=False)
    circle = np.stack([1000 + 900 * np.cos(angles), 1000 + 900 * np.sin(angles)], axis=1)
    found = raster.touched_cells([circle], 2000, 2000)
    assert abs(found.sum() / (np.pi * 900**2) - 1) < 0.01


def scene_files(folder, n=2, high=230, wide=170, share=0.55, block=5):
    rng = np.random.default_rng(9)
    folder.mkdir(parents=True)
    out = {}
    for k in range(n):
        coarse = rng.random((-(-high // block), -(-wide // block))) < share
        mask = np.kron(coarse, np.ones((block, block), bool))[:high, :wide].astype(np.uint8) * 255
        stamp = f"2024020{k + 1}T000000"
        (folder / f"{stamp}_mask.tif").write_bytes(tiff.encode(tiff.Raster(mask, (100.0, 0.0, 0.0, 0.0, -100.0, 1.0e6), 3031)))
        out[stamp] = mask > 0
    return out


def results(folder, prefix):
    regions = {p.name: json.loads(p.read_text()) for p in folder.glob(f"{prefix}regions_*.json")}
    rasters = {p.name: tiff.decode(p.read_bytes()).data for p in folder.glob(f"{prefix}labeled_*.tif")}
    return regions, rasters


def test_extract_does_not_depend_on_blocks(spark, tmp_path):
    masks = scene_files(tmp_path / "m")
    land = [[(2000.0, 9.93e5), (9000.0, 9.95e5), (7000.0, 9.85e5)]]
    gpkg.write_layers({"coast": spark.createDataFrame([("land", bytearray(vector.to_wkb([land])))], "surface string, geom_wkb binary")}, str(tmp_path / "coast.gpkg"))
    for coast, prefix in ((None, "raw_"), (str(tmp_path / "coast.gpkg"), "coastline_")):
        got = []
        for k, (rows, cols) in enumerate(((1, 1), (4, 4), (7, 3))):
            folder = tmp_path / f"{prefix}{k}"
            assert stages.extract(spark, str(tmp_path / "m"), str(folder), coast, p=params.Extract(min_area=30, block_rows=rows, block_cols=cols)) == 2
            got.append(results(folder, prefix))
        for regions, rasters in got[1:]:
            assert regions == got[0][0] and all(np.array_equal(rasters[n], got[0][1][n]) for n in got[0][1])
        for stamp, mask in masks.items():
            data = got[0][1][f"{prefix}labeled_mask_{stamp}.tif"]
            areas = {r["label"]: r["area"] for r in got[0][0][f"{prefix}regions_{stamp}.json"]}
            assert {k: float((data == k).sum()) for k in areas} == areas and min(areas.values()) >= 30 and not (data[~mask]).any()
        # centroids to 2 and 6 decimals
        first = got[0][0][f"{prefix}regions_{next(iter(masks))}.json"][0]
        assert all(round(v, 2) == v for v in first["pixel_centroid"]) and all(round(v, 6) == v for v in first["geo_centroid"])


def test_polygons_meet_tiles_by_join_or_sent_along(spark, tmp_path):
    scene_files(tmp_path / "m", 1)
    tiles = tiff.read_scenes(spark, f"file://{tmp_path}/m", windows=tiff.windows_of(60)).select("row0", "col0", "height", "width", "transform", "data")
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(12):
        x, y = rng.uniform(0, 17_000), 1.0e6 - rng.uniform(0, 23_000)
        ring = [(x, y), (x + rng.uniform(100, 4000), y), (x, y - rng.uniform(100, 4000))]
        rows.append((bytearray(vector.to_wkb([[ring]])), *(f(p[k] for p in ring) for f in (min, max) for k in (0, 1))))
    polygons = spark.createDataFrame(rows, "geom_wkb binary, min_x double, min_y double, max_x double, max_y double")
    one, two = ({(r.row0, r.col0): r.data for r in stages.erase_polygons(tiles, polygons, 5, most).collect()} for most in (1 << 20, 0))
    assert one == two and one != {(r.row0, r.col0): r.data for r in tiles.collect()}


def test_layers_in_degrees_and_in_parts(spark, tmp_path):
    ring = [(10.0, -70.0), (12.0, -70.0), (12.0, -72.0)]
    rows = [(k, bytearray(vector.to_wkb([[[(x + k % 50, y) for x, y in ring]]]))) for k in range(1300)]
    gpkg.write_layers({"ice": spark.createDataFrame(rows, "class_id int, geom_wkb binary")}, str(tmp_path / "d.gpkg"), 4326)
    found = gpkg.read_layer(spark, str(tmp_path / "d.gpkg"), polar=True, part_rows=500).collect()
    assert sorted(r.class_id for r in found) == list(range(1300))
    shape = vector.from_wkb(bytes(next(r for r in found if r.class_id == 0).geom_wkb))[0][0]
    for (lon, lat), (x, y) in zip(ring, shape, strict=True):
        back = spark.range(1).select(projection.longitude(F.lit(x), F.lit(y)), projection.latitude(F.lit(x), F.lit(y))).first()
        assert abs(back[0] - lon) < 1e-6 and abs(back[1] - lat) < 1e-6
    gpkg.write_layers({"ice": spark.createDataFrame(rows[:1], "class_id int, geom_wkb binary")}, str(tmp_path / "u.gpkg"), 32733)
    with pytest.raises(ValueError):
        gpkg.read_layer(spark, str(tmp_path / "u.gpkg"), polar=True)


def classic(values: np.ndarray, version: int) -> bytes:
    """A classic NetCDF file with dimensions time, yc, xc and a packed variable ice_conc."""
    wide, place = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")
    number = lambda n: struct.pack(wide, n)
    text = lambda x: number(len(x)) + x.encode() + b"\0" * (-len(x) % 4)
    attribute = lambda name, kind, code, v: text(name) + struct.pack(">i", kind) + number(1) + struct.pack(code, v).ljust(-(-struct.calcsize(code) // 4) * 4, b"\0")
    _, h, w = values.shape
    head = b"CDF" + bytes([version]) + number(0)
    head += struct.pack(">i", 10) + number(3) + text("time") + number(1) + text("yc") + number(h) + text("xc") + number(w)
    head += struct.pack(">i", 12) + number(1) + attribute("version", 4, ">i", 3)
    attributes = struct.pack(">i", 12) + number(3) + attribute("_FillValue", 3, ">h", -999) + attribute("scale_factor", 5, ">f", 0.5) + attribute("add_offset", 6, ">d", 1.0)
    body = values.astype(">i2").tobytes()
    def variable(at):
        return text("ice_conc") + number(3) + number(0) + number(1) + number(2) + attributes + struct.pack(">i", 3) + number(len(body)) + struct.pack(place, at)
    head += struct.pack(">i", 11) + number(1)
    return head + variable(len(head) + len(variable(0))) + body


@pytest.mark.parametrize("version", [1, 2, 5])
def test_classic_netcdf(spark, tmp_path, version):
    values = np.arange(12).reshape(1, 3, 4)
    values[0, 1, 2] = -999
    raw = classic(values, version)
    (tmp_path / "ice_conc_20240105.nc").write_bytes(raw)
    rows = {(r.date, r.xi, r.yi): r.ice_conc for r in tables.read_sea_ice(spark, f"file://{tmp_path}").collect()}
    assert len(rows) == 12 and rows["20240105", 2, 1] is None and rows["20240105", 3, 2] == 11 * 0.5 + 1
    with pytest.raises(ValueError):
        netcdf.values(b"\x89HDF\r\n\x1a\n" + raw, "ice_conc")


def test_bathymetry_in_degrees(spark, tmp_path):
    lat = -60.0 - 0.5 * (np.arange(60) + 0.5)
    data = np.repeat(lat[:, None] * 10, 120, axis=1).astype(np.float32)
    (tmp_path / "bed.tif").write_bytes(tiff.encode(tiff.Raster(data, (0.5, 0.0, 0.0, 0.0, -0.5, -60.0), 4326)))
    obs = spark.createDataFrame([(k, 3.0e5 + 20_000.0 * k, 1.2e6) for k in range(10)], "id int, Geo_X double, Geo_Y double")
    got = stages.with_depth(spark, obs.withColumn("lat", projection.latitude(F.col("Geo_X"), F.col("Geo_Y"))), str(tmp_path / "bed.tif")).collect()
    assert len(got) == 10 and all(abs(r.Bed_Depth - 10 * r.lat) < 0.1 for r in got)


def test_export_of_several_orbits(spark, tmp_path):
    """Two orbits whose grids are shifted by whole cells: a feature that both have is kept once."""
    for name, shift in (("A", 0), ("B", 10)):
        for k in range(2):
            scene = np.zeros((40, 40), np.uint8)
            scene[12 - shift // 2 : 18 - shift // 2, 15 - shift : 22 - shift] = 255  # the same place on the ground
            if name == "A":
                scene[30:35, 30:36] = 255
            folder = tmp_path / name / "m"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"2024030{k + 1 + (name == 'B') * 4}T000000_mask.tif").write_bytes(tiff.encode(tiff.Raster(scene, (1000.0, 0.0, 1000.0 * shift, 0.0, -1000.0, 1.5e6 - 500.0 * shift), 3031)))
        stages.extract(spark, str(tmp_path / name / "m"), str(tmp_path / name / "r"), p=params.Extract(min_area=5))
        stages.identify(spark, str(tmp_path / name / "r"), str(tmp_path / name / "t"), params.Identify(rows=1, cols=1))
        stages.physical(spark, str(tmp_path / name / "t"), str(tmp_path / name / "r"), str(tmp_path / name / "q"), p=params.Physical(min_pixels=2, cond1_area=0, cond2_area=0))
    final = stages.export(spark, {n: str(tmp_path / n / "q") for n in "AB"}, {n: str(tmp_path / n / "r") for n in "AB"}, str(tmp_path / "out.gpkg")).collect()
    assert len(final) == 2 and {r.Orbit for r in final} <= {"A", "B"}
    with pytest.raises(ValueError):
        (tmp_path / "C" / "m").mkdir(parents=True)
        scene = np.zeros((20, 20), np.uint8)
        scene[5:9, 5:9] = 255
        for k in range(2):
            (tmp_path / "C" / "m" / f"2024040{k + 1}T000000_mask.tif").write_bytes(tiff.encode(tiff.Raster(scene, (900.0, 0.0, 0.0, 0.0, -900.0, 1.5e6), 3031)))
        stages.extract(spark, str(tmp_path / "C" / "m"), str(tmp_path / "C" / "r"), p=params.Extract(min_area=5))
        stages.export(spark, {"A": str(tmp_path / "A" / "q"), "C": str(tmp_path / "A" / "q")}, {"A": str(tmp_path / "A" / "r"), "C": str(tmp_path / "C" / "r")}, str(tmp_path / "out2.gpkg"))


def test_extract_of_a_large_scene(spark, tmp_path):
    """A scene of 4000 x 4000 cells by 4 x 4 blocks: no task holds more than a block's cells but to write the labels."""
    masks = scene_files(tmp_path / "m", 1, 4000, 4000, 0.08, 20)
    assert stages.extract(spark, str(tmp_path / "m"), str(tmp_path / "r"), p=params.Extract(min_area=10)) == 1
    regions, rasters = results(tmp_path / "r", "raw_")
    (data,), (mask,), (records,) = rasters.values(), masks.values(), regions.values()
    assert np.array_equal(data > 0, mask) and data.max() == len(records)
    counts = np.bincount(data.ravel())[1:]
    assert [r["area"] for r in records] == counts.tolist()


def test_tables_of_tensors(tmp_path, monkeypatch):
    """A zipped table of tensors is read by its parts, views of a common storage among them; other classes are refused."""
    fake, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")

    class FloatStorage:
        pass

    class LongStorage:
        pass

    def _rebuild_tensor_v2(*args):
        return args

    for owner, thing, name in ((fake, FloatStorage, "torch"), (fake, LongStorage, "torch"), (utils, _rebuild_tensor_v2, "torch._utils")):
        thing.__module__, thing.__qualname__ = name, thing.__name__
        setattr(owner, thing.__name__, thing)
    monkeypatch.setitem(sys.modules, "torch", fake)
    monkeypatch.setitem(sys.modules, "torch._utils", utils)
    values = {"0": np.arange(12, dtype="<f4"), "1": np.array([7], dtype="<i8")}

    class Storage:
        def __init__(self, key, kind):
            self.key, self.kind = key, kind

    class Tensor:
        def __init__(self, storage, offset, size, stride):
            self.parts = (storage, offset, size, stride, False, collections.OrderedDict())

        def __reduce__(self):
            return _rebuild_tensor_v2, self.parts

    class Out(pickle.Pickler):
        def persistent_id(self, x):
            return ("storage", x.kind, x.key, "cpu", len(values[x.key])) if isinstance(x, Storage) else None

    def saved(path, table):
        held = io.BytesIO()
        Out(held, 2).dump(table)
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("net/data.pkl", held.getvalue())
            for k, v in values.items():
                z.writestr(f"net/data/{k}", v.tobytes())

    float_ = Storage("0", FloatStorage)
    saved(tmp_path / "w.pth", collections.OrderedDict([("module.a", Tensor(float_, 0, (2, 3), (3, 1))), ("module.b", Tensor(float_, 6, (3, 2), (1, 3))), ("module.n", Tensor(Storage("1", LongStorage), 0, (), ()))]))
    got = model.state_of(str(tmp_path / "w.pth"))
    assert got["a"].tolist() == [[0, 1, 2], [3, 4, 5]] and got["b"].tolist() == [[6, 9], [7, 10], [8, 11]] and got["n"] == 7
    np.savez(tmp_path / "w.npz", a=got["a"])
    assert model.state_of(str(tmp_path / "w.npz"))["a"].tolist() == got["a"].tolist()
    saved(tmp_path / "bad.pth", {"x": zipfile.ZipInfo("x")})
    with pytest.raises(pickle.UnpicklingError):
        model.state_of(str(tmp_path / "bad.pth"))


def test_bytes_are_scaled_for_the_net(spark, tmp_path):
    seen = np.zeros((20, 20), np.uint8)
    seen[5:9, 5:9] = 200
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "S_20240101T000000.tif").write_bytes(tiff.encode(tiff.Raster(seen, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 3031)))
    assert stages.detect(spark, str(tmp_path / "in"), str(tmp_path / "out"), model.contrast_scorer(100, 0.9), params.Detect(patch_size=10), canvas=10) == 1
    assert not tiff.decode((tmp_path / "out" / "20240101T000000_mask.tif").read_bytes()).data.any()  # 200 / 255 is below 0.9
