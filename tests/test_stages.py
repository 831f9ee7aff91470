"""The five stages from scenes to features, on small files."""

from __future__ import annotations

import json

import numpy as np
import pytest

from gridtrail import params, stages
from gridtrail.operators import model, vector
from gridtrail.sources import gpkg, tables, tiff

STAMPS = [f"2024010{k}T000000" for k in range(1, 5)]
TRANSFORM = (1000.0, 0.0, -5.0e5, 0.0, -1000.0, 1.6e6)


def ring(left, top, right, low):
    """A rectangle of cells in map coordinates, as WKB."""
    x = lambda c: TRANSFORM[2] + 1000.0 * c
    y = lambda r: TRANSFORM[5] - 1000.0 * r
    return bytearray(vector.to_wkb([[[(x(left), y(top)), (x(right), y(top)), (x(right), y(low)), (x(left), y(low))]]]))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    (root / "in/a").mkdir(parents=True)
    for k, stamp in enumerate(STAMPS):
        scene = np.zeros((40, 50), dtype=np.float32)
        scene[10:16, 10 : 17] = 1  # stays
        scene[25:31, 30 + (k % 2) : 36 + (k % 2)] = 1  # stays, moves a little
        scene[5:8, 40:43] = k == 1  # seen once
        scene[0:4, 0:4] = 1  # on land
        scene[35, 5] = np.nan
        (root / "in/a" / f"S1_{stamp}_x.tif").write_bytes(tiff.encode(tiff.Raster(scene, TRANSFORM, 3031)))
    (root / "in/a/nameless.tif").write_bytes(b"never read")
    land = spark.createDataFrame([("land", ring(0, 0, 4, 4)), ("ocean", ring(8, 8, 20, 20))], "surface string, geom_wkb binary")
    gpkg.write_layers({"coast": land}, str(root / "coast.gpkg"))
    ice = spark.createDataFrame([(1, ring(5, 5, 25, 20)), (2, ring(25, 20, 45, 38))], "class_id int, geom_wkb binary")
    gpkg.write_layers({"ice": ice}, str(root / "ice.gpkg"))
    depth = np.full((60, 60), -100.0, dtype=np.float32)
    (root / "bed.tif").write_bytes(tiff.encode(tiff.Raster(depth, (1000.0, 0.0, -5.0e5, 0.0, -1000.0, 1.6e6), 3031, -9999.0)))
    p = params.Detect(patch_size=25, batch_size=4)
    n = stages.detect(spark, str(root / "in"), str(root / "masks"), model.contrast_scorer(10, 0.5), p, canvas=50)
    again = stages.detect(spark, str(root / "in"), str(root / "masks"), model.contrast_scorer(10, 0.5), p, canvas=50)
    frames = stages.extract(spark, str(root / "masks"), str(root / "regions"), str(root / "coast.gpkg"), p=params.Extract(min_area=5))
    tracks = stages.identify(spark, str(root / "regions"), str(root / "tracks"), params.Identify(rows=2, cols=2))
    # latitude-corrected cells of about 1 km2: both objects pass all conditions, with ice missing
    kept = stages.physical(spark, str(root / "tracks"), str(root / "regions"), str(root / "qc"), str(root / "bed.tif"), p=params.Physical(min_pixels=5))
    final = stages.export(spark, str(root / "qc"), str(root / "regions"), str(root / "out.gpkg"), str(root / "ice.gpkg"), "Orbit (7)")
    return {"root": root, "n": n, "again": again, "frames": frames, "tracks": tracks, "kept": kept, "final": final}


def test_detect(made):
    assert made["n"] == 4 and made["again"] == 0
    mask = tiff.decode((made["root"] / "masks/a" / f"{STAMPS[0]}_mask.tif").read_bytes())
    assert mask.data.shape == (40, 50) and set(np.unique(mask.data)) == {0, 255} and mask.transform == TRANSFORM
    assert mask.data[12, 12] == 255 and mask.data[20, 20] == 0


def test_extract(made):
    assert made["frames"] == 4
    with open(made["root"] / "regions" / f"coastline_regions_{STAMPS[1]}.json") as f:
        regions = json.load(f)
    assert [r["label"] for r in regions] == [1, 2, 3][: len(regions)] and all("merged_from" not in r for r in regions)
    raster = tiff.decode((made["root"] / "regions" / f"coastline_labeled_mask_{STAMPS[1]}.tif").read_bytes())
    assert raster.data.dtype == np.uint16 and [int((raster.data == r["label"]).sum()) for r in regions] == [int(r["area"]) for r in regions]
    assert not raster.data[:4, :4].any()  # erased, as are 40 cells around it


def test_tracks_and_features(made):
    rows = made["tracks"].collect()
    long = {r.Track_ID for r in rows if sum(x.Track_ID == r.Track_ID for x in rows) > 1}
    assert made["tracks"].columns == [p.split()[0] for p in __import__("gridtrail.schemas", fromlist=["x"]).TRACKS.split(", ")]
    kept = made["kept"].collect()
    assert {r.Track_ID for r in kept} <= long and all(r.Area_Pixels >= 5 and r.Area_km2 > 0 and -90 < r.Latitude < -70 for r in kept)
    final = made["final"].collect()
    assert len(final) == len({r.Track_ID for r in kept}) > 0
    assert all(r.Fast_Ice_Overlap_Status in ("Inside", "Partial", "Outside") and r.Orbit == "Orbit (7)" for r in final)
    assert gpkg.layers(str(made["root"] / "out.gpkg")) == ["features"]
    assert gpkg.read_layer(made["final"].sparkSession, str(made["root"] / "out.gpkg")).count() == len(final)


def test_existing_outputs_are_kept(spark, made):
    root = made["root"]
    assert stages.identify(spark, "nowhere", str(root / "tracks")).count() == made["tracks"].count()
    assert stages.physical(spark, "nowhere", "nowhere", str(root / "qc")).count() == made["kept"].count()


def test_without_coastline(spark, made, tmp_path):
    (tmp_path / "m").mkdir()
    blank, one = np.zeros((6, 6), np.uint8), np.zeros((6, 6), np.uint8)
    one[2, 2] = 255
    (tmp_path / "m" / "20240101T000000_mask.tif").write_bytes(tiff.encode(tiff.Raster(blank, TRANSFORM)))
    (tmp_path / "m" / "20240102T000000_mask.tif").write_bytes(tiff.encode(tiff.Raster(one, TRANSFORM)))
    assert stages.extract(spark, str(tmp_path / "m"), str(tmp_path / "r"), p=params.Extract(min_area=2)) == 1
    assert sorted(p.name for p in (tmp_path / "r").glob("*.json")) == ["raw_regions_20240102T000000.json"]
    assert [r.Timestamp for r in tables.frames(spark, f"file://{tmp_path}/r", "raw_").collect()] == ["20240102T000000"]
    assert stages.extract(spark, str(tmp_path / "m"), str(tmp_path / "r"), p=params.Extract(min_area=2)) == 0  # both are done or blank
