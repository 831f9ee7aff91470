"""Hand-built cases of single operators."""

from __future__ import annotations

import itertools
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridtrail import params
from gridtrail.functions import projection, scalar
from gridtrail.operators import graph, labels, model, pairing, qc, raster, shapes, summary, tracking, vector
from gridtrail.sources import gpkg, tables, tiff
from gridtrail.storage import Scratch
from gridtrail.streaming import tracker as stream_tracker


def test_diagonal_pair_is_one_component_of_eight_two_of_four():
    mask = np.zeros((5, 5), bool)
    mask[1, 1] = mask[2, 2] = True
    assert set(labels.label_mask(mask)[2]) == {6}
    assert vector.first_part(mask).sum() == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**30))
def test_labels_equal_flood_fill(h, w, seed):
    mask = np.random.default_rng(seed).random((h, w)) < 0.45
    rows, cols, names = labels.label_mask(mask)
    want, seen = {}, set()
    for r, c in zip(*np.nonzero(mask), strict=True):
        if (r, c) in seen:
            continue
        todo, group = [(r, c)], []
        seen.add((r, c))
        while todo:
            y, x = todo.pop()
            group.append((y, x))
            for dy, dx in itertools.product((-1, 0, 1), repeat=2):
                n = (y + dy, x + dx)
                if 0 <= n[0] < h and 0 <= n[1] < w and mask[n] and n not in seen:
                    seen.add(n)
                    todo.append(n)
        want |= {p: r * w + c for p in group}
    assert {(r, c): n for r, c, n in zip(rows, cols, names, strict=True)} == want


@pytest.mark.parametrize("blocks", [(1, 1), (2, 2), (3, 4)])
def test_labels_do_not_depend_on_blocks(spark, blocks):
    rng = np.random.default_rng(3)
    masks = [(k, rng.random((9, 10)) < 0.5) for k in range(4)]
    masks.append((9, np.pad(np.ones((1, 1), bool), ((4, 4), (5, 4)))))
    whole = spark.createDataFrame([(k, 0, 0, 9, 10, m.ravel().tolist()) for k, m in masks], "scene_id int, row0 int, col0 int, height int, width int, data array<boolean>")
    cells = labels.labelled(labels.blocks(whole, *blocks), scene_width=10)
    got = {tuple(r) for r in labels.merged(cells, ["scene_id"], 9, 10, *blocks).select("scene_id", "row", "col", "label").collect()}
    assert got == {(k, int(r), int(c), int(n)) for k, m in masks for r, c, n in zip(*labels.label_mask(m), strict=True)}


def test_patch_grid_takes_the_rest(spark):
    tile = spark.createDataFrame([(1, 0, 0, 11, 9, list(map(float, range(99))))], "scene_id int, row0 int, col0 int, height int, width int, data array<double>")
    cut = raster.patches(tile, 4, 2)
    assert {(r.patch_row, r.patch_col): (r.height, r.width) for r in cut.collect()} == {(i, j): (5 if i == 3 else 2, 5 if j else 4) for i in range(4) for j in range(2)}
    assert raster.stitched(cut, ["scene_id"]).first().data == list(map(float, range(99)))


def test_dilation_is_a_diamond(spark):
    cell = spark.createDataFrame([(1, 5, 5)], "scene_id int, row int, col int")
    assert raster.dilated(cell, ["scene_id"], 2, 11, 11).count() == 13
    mask = np.zeros((11, 11), bool)
    mask[5, 5] = True
    assert raster.manhattan_dilation(mask, 2).sum() == 13
    assert raster.manhattan_dilation(mask, 40).all()
    tile = spark.createDataFrame([(1, 0, 0, 11, 11, mask.ravel().tolist())], "scene_id int, row0 int, col0 int, height int, width int, data array<boolean>")
    assert sum(raster.dilated_tiles(tile, 3).first().data) == 25


def test_touched_cells():
    square = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    assert raster.touched_cells([square], 5, 5).sum() == 4
    sliver = [(0.1, 0.1), (3.9, 0.15), (3.9, 0.2)]
    assert raster.touched_cells([sliver], 5, 5)[0].tolist() == [True] * 4 + [False]
    hole = [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)]
    assert not raster.touched_cells([hole, [(1.9, 1.9), (3.1, 1.9), (3.1, 3.1), (1.9, 3.1)]], 5, 5)[2, 2]


def _region(label, cells, width=20, **more):
    rows, cols = [c // width for c in cells], [c % width for c in cells]
    box = (min(cols), min(rows), max(cols) + 1, max(rows) + 1)
    return tracking.Region(label, float(np.mean(cols)), float(np.mean(rows)), float(len(cells)), box, frozenset(cells), **more)


def test_window_iou_overstates():
    a = _region(1, [r * 20 + c for r in range(3) for c in range(3)])
    b = _region(2, [r * 20 + c for r in range(1, 4) for c in range(1, 4)])
    assert tracking.window_iou(a, b, 20) == 1.0


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 2**30), st.booleans())
def test_assignment_is_optimal(n, m, seed, sparse):
    rng = np.random.default_rng(seed)
    cost = rng.random((n, m))
    if sparse:
        cost = np.where(rng.random((n, m)) < 0.4, params.FORBIDDEN, cost)
    small, large, table = (n, m, cost) if n <= m else (m, n, cost.T)
    best = min(sum(table[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
    got = tracking.assigned(cost)
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) == small
    assert math.isclose(sum(cost[i, j] for i, j in got), best, rel_tol=1e-9)


def test_assignment_small_cases():
    assert tracking.match(np.array([[1.0, 2.0], [1.5, 9.0]])) == [(0, 1), (1, 0)]
    assert tracking.match(np.array([[1e6, 1e6], [1.0, 2.0]])) == [(1, 0)]
    assert len(tracking.match(np.array([[1.0], [0.5], [2.0]]))) == 1
    assert tracking.match(np.zeros((0, 3))) == []


def test_tied_assignments_are_settled(spark):
    """Most pairs, then the least sum in doubles in the order of rows (as the SQL adds them), then the first pairs."""
    rng, unlike = np.random.default_rng(3), 0
    for _ in range(400):
        n, m = rng.integers(1, 5, 2)
        costs = np.where(rng.random((n, m)) < 0.2, params.FORBIDDEN, rng.integers(1, 5, (n, m)) * 0.1)
        every = []
        for size in range(min(n, m) + 1):
            for rows in itertools.combinations(range(n), size):
                for cols in itertools.permutations(range(m), size):
                    pairs = list(zip(rows, cols, strict=True))
                    if all(costs[x] < params.FORBIDDEN for x in pairs):
                        total = 0.0
                        for x in pairs:
                            total += costs[x]
                        every.append((-size, total, pairs))
        assert tracking.settled(costs) == min(every)[2]
        unlike += tracking.match(costs) != min(every)[2]
    assert unlike > 0
    near = [(20, 17, 3.2190837205639746), (20, 30, 2.233582075700127), (44, 17, 4.103690750748377), (44, 30, 1.9002923751652305), (47, 17, 5.986675018553937), (47, 30, 1.90029237516523)]
    pairs = spark.createDataFrame([(1, *x) for x in near], "frame int, cur_label int, prev_label int, cost double")
    assert sorted((r.cur_label, r.prev_label) for r in tracking.matched_pairs(pairs, ["frame"]).collect()) == [(20, 17), (44, 30)]
    many = tracking.settled(np.ones((40, 40)))  # more ties than are followed: a whole pairing all the same
    assert len({i for i, _ in many}) == len({j for _, j in many}) == 40


def _runs(frames, last, **flags):
    filled = {t for t, r in frames.items() if r}
    out = tracking.track_tile(frames, list(range(1, last + 1)), set(range(1, last + 1)) - filled - flags.pop("also_filled", set()), params.Identify(), 20, **flags)
    found = {}
    for track, t, _, _ in out:
        found.setdefault((track.birth_frame, track.birth_label), []).append(t)
    return found


def test_track_gaps():
    square, other = [21, 22, 41, 42], [205, 206, 225, 226]
    far = lambda t: _region(100 + t, other)
    seen = lambda t: _region(t, square)
    one_gap = {1: [seen(1), far(1)], 2: [far(2)], 3: [seen(3), far(3)]}
    assert _runs(one_gap, 3)[1, 1] == [1, 3]
    two_gaps = {1: [seen(1), far(1)], 2: [far(2)], 3: [far(3)], 4: [seen(4), far(4)]}
    assert _runs(two_gaps, 4) == {(1, 1): [1], (1, 101): [1, 2, 3, 4], (4, 4): [4]}
    alone = {1: [seen(1)], 5: [seen(5)]}  # other tiles have regions: no ageing here
    assert _runs(alone, 5, also_filled={2, 3, 4}) == {(1, 1): [1, 5]}
    assert _runs(alone, 5, also_filled={2, 3, 4}, age_empty_tiles=True) == {(1, 1): [1], (5, 5): [5]}
    empty = {1: [seen(1)], 3: [seen(3)], 4: [seen(4)]}  # frame 2 is empty: frame 3 is lost
    assert _runs(empty, 4) == {(1, 1): [1, 4]}
    assert _runs(empty, 4, keep_after_empty=True) == {(1, 1): [1, 3, 4]}


def test_qc_nulls(spark):
    rows = [(1, 1, None, None, -1100.0, 10.0), (2, 1, 10.0, 5, None, 90.0), (3, 2, 700.0, 5, -700.0, 50.0), (4, 2, 700.0, None, -10.0, None), (5, 3, 1.0, 0, None, None), (6, 3, 1.0, 9, None, None), (7, 4, 1.0, 9, None, None)]
    obs = spark.createDataFrame(rows, "event_id int, Track_ID int, Area_km2 double, Area_Pixels int, Bed_Depth double, SIC_Value double")
    p = params.Physical(min_pixels=1, cond1_area=625, cond2_area=63)
    flags = {r.event_id: (r.cond_1, r.cond_2, r.cond_3) for r in qc.flagged(obs, p).collect()}
    assert flags[1] == (False, False, True) and flags[2] == (False, True, False) and flags[3] == (False,) * 3 and flags[4] == (False,) * 3
    assert sorted(r.event_id for r in qc.quality_controlled(obs, p).collect()) == [3, 4]


def test_mid_row(spark):
    rows = [(g, f"2024010{k}T000000", k) for g in (2, 3, 4) for k in range(g)]
    got = summary.middle_rows(spark.createDataFrame(rows, "g int, Timestamp string, event_id int"), ("g",)).collect()
    assert {r.g: r.event_id for r in got} == {2: 1, 3: 1, 4: 2}


def test_greedy_removal(spark):
    # A covers B; B covers C; without B, C stays
    feats = spark.createDataFrame([(1, 1, 9), (1, 2, 6), (1, 3, 4), (1, 4, 4)], "orbit int, rid int, area int")
    shared = spark.createDataFrame([(1, 1, 2, 5), (1, 2, 1, 5), (1, 2, 3, 3), (1, 3, 2, 3), (1, 3, 4, 1), (1, 4, 3, 1)], "orbit int, i int, j int, shared int")
    got = {r.rid: (r.rank, r.dropped) for r in vector.deduplicated(feats, shared, ["orbit"], "rid", "area").collect()}
    assert got == {1: (1, False), 2: (2, True), 3: (3, False), 4: (4, False)}
    # a higher-ranked one is dropped by a lower one whose share of it is over the limit
    feats = spark.createDataFrame([(1, 1, 4, 9.0), (1, 2, 9, 5.0)], "orbit int, rid int, area int, mean double")
    shared = spark.createDataFrame([(1, 1, 2, 4), (1, 2, 1, 4)], "orbit int, i int, j int, shared int")
    got = {r.rid: r.dropped for r in vector.deduplicated(feats, shared, ["orbit"], "rid", "mean").collect()}
    assert got == {1: True, 2: False}


def test_greedy_removal_by_cells(spark):
    """The same as by overlaps, without making pairs: they would be the square of the features of a place."""
    rng = np.random.default_rng(5)
    cells = [(o, rid, int(r), int(c)) for o in (1, 2) for rid in range(60) for r, c in {(rng.integers(9), rng.integers(9)) for _ in range(rng.integers(1, 12))}]
    cells = spark.createDataFrame(cells, "orbit int, rid int, row int, col int")
    feats = cells.groupBy("orbit", "rid").agg(F.count("*").alias("area"), (F.col("rid") * 7 % 11).alias("mean"))
    for by in ("area", "mean"):
        want = vector.deduplicated(feats, vector.cell_overlaps(cells, ["orbit"], "rid"), ["orbit"], "rid", by)
        got = vector.deduplicated_cells(feats, cells, ["orbit"], "rid", by)
        assert sorted(got.columns) == sorted(want.columns)
        rows = lambda df: sorted((r.orbit, r.rid, r.area, r.rank, r.dropped) for r in df.collect())
        assert rows(got) == rows(want) and len({r[-1] for r in rows(got)}) == 2
    stacked = spark.range(20_000).select(F.lit(1).alias("orbit"), F.col("id").alias("rid"))
    places = stacked.crossJoin(spark.range(4).select(F.lit(0).alias("row"), F.col("id").alias("col")))  # 4e8 pairs of features
    got = vector.deduplicated_cells(stacked.withColumn("area", F.lit(4)), places, ["orbit"], "rid", "area")
    assert got.where("not dropped").select("rid", "rank").collect() == [(0, 1)]


def test_ice_status(spark):
    boxes = spark.createDataFrame([(1, 10, 10, 2, 2), (2, 4, 0, 2, 2), (3, 3, 3, 2, 2), (4, 0, 0, 2, 2), (5, 3, 0, 3, 1)], "id int, left int, top int, width int, height int")
    ice = spark.createDataFrame([(1, 0, 0, 4, 4), (1, 4, 0, 2, 1), (2, 10, 10, 9, 9)], "class_id int, left int, top int, width int, height int")
    got = {r.id: r.Fast_Ice_Overlap_Status for r in vector.fast_ice_status(boxes, ice, ["id"]).collect()}
    assert got == {1: "Outside", 2: "Partial", 3: "Partial", 4: "Inside", 5: "Inside"}
    assert {r.Fast_Ice_Overlap_Status for r in vector.fast_ice_status(boxes, ice.where("class_id = 2"), ["id"]).collect()} == {"Outside"}


def test_smoothing(spark):
    assert shapes.smooth_contour(np.full((6, 2), 10))[:, 0].tolist() == [6, 8, 10, 10, 8, 6]
    rows = spark.createDataFrame([(1, k, 10) for k in range(6)], "s int, i int, x int")
    assert [r.smooth_x for r in pairing.smoothed(rows, ["s"], "i", ["x"]).orderBy("i").collect()] == [6, 8, 10, 10, 8, 6]


def test_projection(spark):
    x, y = projection.forward(F.col("lat"), F.col("lon"))
    pts = spark.createDataFrame([(-71.0, 0.0), (-71.0, 90.0), (-66.5, -135.0), (-80.0, 12.0)], "lat double, lon double").withColumns({"x": x, "y": y})
    back = pts.withColumns({"lat2": projection.latitude(F.col("x"), F.col("y")), "lon2": projection.longitude(F.col("x"), F.col("y"))}).collect()
    assert all(abs(r.lat - r.lat2) < 1e-9 and abs(r.lon - r.lon2) < 1e-9 for r in back)
    assert abs(back[0].x) < 1e-6 and back[0].y > 2.0e6 and abs(back[1].y) < 1e-6 and back[1].x > 2.0e6
    pole = spark.range(1).select(projection.latitude(F.lit(0.0), F.lit(0.0)).alias("lat")).first()
    assert abs(pole.lat + 90) < 1e-9
    k = spark.range(1).select(projection.scale_factor(F.lit(-60.0)).alias("a"), projection.scale_factor(F.lit(-60.0), "snyder").alias("b")).first()
    assert abs(k.a - 0.9591) < 1e-4 and abs(k.a * k.b - 1) < 1e-12


def test_scalars(spark):
    row = spark.createDataFrame([("a/20240102T030405_x.tif", "20240102T030405_region_x", "Orbit (1)", float("nan"))], "name string, uid string, orbit string, v double")
    got = row.select(scalar.stamp_of(F.col("name")).alias("s"), scalar.label_of(F.col("uid")).alias("l"), scalar.layer_name(F.col("orbit")).alias("o"), scalar.or_zero(F.col("v")).alias("z"), scalar.valid(F.col("v")).alias("ok"), scalar.contour_cost(F.lit(None).cast("double")).alias("c"), scalar.contour_cost(F.lit(500.0)).alias("d"), scalar.finite_or_forbidden(F.col("v")).alias("f"), scalar.decimals(F.lit(0.0625)).alias("t"), scalar.label_type(F.lit(70000)).alias("u")).first()
    assert tuple(got) == ("20240102T030405", -1, "Orbit _1", 0.0, False, 10.0, 100.0, 1e6, "0.062", "uint32")


def test_components_and_numbers(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    root = list(range(2000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    scratch = Scratch(spark, "test")
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "u long, v long"), scratch, "c").collect()}
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long"), scratch, "e").count() == 0
    named = graph.numbered(spark.createDataFrame([(x,) for x in rng.permutation(500).tolist()], "x long"), ["x"], "k", scratch).collect()
    assert all(r.k == r.x + 1 for r in named)


def test_kept_tables_start_no_process_of_the_driver(tmp_path):
    """A chmod of the driver's holds its memory as its own until it runs; tasks start one for their folder and one for their file."""
    (tmp_path / "bin").mkdir()
    fake = tmp_path / "bin" / "chmod"
    fake.write_text(f'#!/bin/sh\necho "$*" >> "{tmp_path}/started"\nexec {shutil.which("chmod")} "$@"\n')
    fake.chmod(0o755)
    code = f"""
from gridtrail.session import local_session
from gridtrail.storage import Scratch
spark = local_session(1, 1, **{{"spark.checkpoint.dir": "file://{tmp_path}/a b", "spark.driver.memory": "1g"}})
scratch = Scratch(spark, "test")
for n in (5, 7):
    kept = scratch.keep(spark.range(0, n, 1, 2), "x")
print("rows", kept.count())
"""
    env = os.environ | {"PATH": f"{fake.parent}:{os.environ['PATH']}", "PYTHONPATH": str(Path(__file__).parents[1])}
    env = {k: v for k, v in env.items() if not k.startswith(("PYSPARK_GATEWAY", "PYSPARK_DRIVER"))}
    ran = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert ran.stdout.split()[-2:] == ["rows", "7"], ran.stderr
    started = (tmp_path / "started").read_text().splitlines()
    mine = [x for x in started if "/test-" in x]
    assert len(mine) == 8 and all("/attempt_" in x for x in mine), mine


def test_shapes():
    square = np.ones((4, 4), bool)
    assert sorted(map(tuple, shapes.outer_contour(square).tolist())) == [(0, 0), (0, 3), (3, 0), (3, 3)]
    assert shapes.outer_contour(np.ones((1, 1), bool)).tolist() == [[0, 0]]
    assert sorted(map(tuple, shapes.outer_contour(np.ones((1, 5), bool)).tolist())) == [(0, 0), (4, 0)]
    t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    ellipse = np.stack([10 * np.cos(t) + 3, 4 * np.sin(t)], axis=1)
    assert abs(shapes.axis_ratio(ellipse) - 2.5) < 1e-6
    turn = np.array([[math.cos(0.7), -math.sin(0.7)], [math.sin(0.7), math.cos(0.7)]])
    assert abs(shapes.axis_ratio(ellipse @ turn.T) - 2.5) < 1e-6
    assert shapes.axis_ratio(None) == 1.0 and shapes.axis_ratio(ellipse[:4]) == 1.0
    shape = np.array([[0, 0], [9, 1], [7, 6], [3, 9], [1, 4]], float)
    a, b = shapes.hu_moments(shape), shapes.hu_moments(shape @ turn.T * 3 + 11)
    assert all((x is None and y is None) or abs(x - y) < 1e-6 for x, y in zip(a, b, strict=True))
    assert tracking.hu_distance(tuple(a), tuple(b)) < 1e-5
    assert shapes.largest_contour(np.zeros((2, 2), bool)) is None


def test_polygons():
    ring = np.ones((3, 3), bool)
    ring[1, 1] = False
    found = vector.rings(ring)
    assert len(found) == 2 and vector.polygon_area(found) == 8
    assert vector.from_wkb(vector.to_wkb([found])) == [[[tuple(map(float, p)) for p in r] for r in found]]
    two = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]], [[(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]]]
    assert vector.from_wkb(vector.to_wkb(two)) == two
    assert vector.contains_point(found, 0.5, 0.5) and not vector.contains_point(found, 1.5, 1.5)
    part = vector.clipped([(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 2), (6, 2), (6, 6), (2, 6)])
    assert abs(vector.signed_area(part)) == 4
    corner = np.array([[True, False], [False, True]])
    assert vector.polygon_area(vector.rings(vector.first_part(corner))) == 1


@pytest.mark.parametrize(("dtype", "compress", "predictor"), [("uint8", False, 1), ("uint16", True, 2), ("uint32", True, 2), ("float32", True, 1), ("float64", False, 1), ("int16", True, 2)])
def test_tiff_round_trip(dtype, compress, predictor):
    data = (np.random.default_rng(2).random((7, 13)) * 200).astype(dtype)
    back = tiff.decode(tiff.encode(tiff.Raster(data, (10.0, 0.0, 5.0, 0.0, -10.0, 7.0), 3031, 0.0), compress, predictor))
    assert np.array_equal(back.data, data) and back.data.dtype == data.dtype
    assert back.transform == (10.0, 0.0, 5.0, 0.0, -10.0, 7.0) and back.epsg == 3031 and back.nodata == 0.0


def test_scenes_through_files(spark, tmp_path):
    rows = [(f"sub/20240102T03040{k}_mask.tif", 2, 3, [1.0, 0.0, 0.0, 0.0, -1.0, 2.0], [0, 1, 2, 3, 4, k]) for k in range(3)]
    scenes = spark.createDataFrame([*rows, ("nameless.tif", 1, 1, [1.0, 0.0, 0.0, 0.0, -1.0, 2.0], [5])], "name string, height int, width int, transform array<double>, data array<int>")
    tiff.write_scenes(scenes, str(tmp_path), "uint16", True, 2)
    assert tiff.listed(spark, f"file://{tmp_path}").count() == 4
    got = {r.Timestamp: r for r in tiff.read_scenes(spark, f"file://{tmp_path}").collect()}
    assert sorted(got) == [f"20240102T03040{k}" for k in range(3)]
    assert got["20240102T030402"].data == [None, 1.0, 2.0, 3.0, 4.0, 2.0] and got["20240102T030402"].dtype == "uint16"


def test_layers_through_files(spark, tmp_path):
    path = str(tmp_path / "x.gpkg")
    wkb = bytearray(vector.to_wkb([[[(0.0, 0.0), (2.0, 0.0), (2.0, 1.0)]]]))
    one = spark.createDataFrame([("land", 1.5, wkb), ("rumple", None, wkb)], "surface string, size double, geom_wkb binary")
    gpkg.write_layers({"Inside": one, "Partial": one.where("surface = 'land'")}, path)
    assert gpkg.layers(path) == ["Inside", "Partial"]
    back = gpkg.read_layer(spark, path)
    assert [(r.surface, r.size, bytes(r.geom_wkb), r.max_x) for r in back.collect()] == [("land", 1.5, bytes(wkb), 2.0), ("rumple", None, bytes(wkb), 2.0)]
    assert gpkg.read_layer(spark, path, "Partial").count() == 1


def test_region_and_track_files(spark, tmp_path):
    stats = spark.createDataFrame([("20240102T030405", 7, 4, 1.5, 2.5, 1, 2, 2, 2), ("20240102T030405", 3, 5, 1.0, 2.0, 1, 2, 2, 2)], "Timestamp string, label long, area long, cx double, cy double, left int, top int, width int, height int")
    records = labels.region_records(stats.withColumn("transform", F.array(*map(F.lit, (10.0, 0.0, 0.0, 0.0, -10.0, 100.0)))), "Timestamp")
    tables.write_regions(records, str(tmp_path / "r"), "raw_")
    back = tables.read_regions(spark, f"file://{tmp_path}/r", "raw_").orderBy("label").collect()
    assert [(r.label, r.area, r.geo_centroid, r.unique_id, r.merged_from) for r in back] == [(3, 5.0, [15.0, 75.0], "20240102T030405_region_3", None), (7, 4.0, [20.0, 70.0], "20240102T030405_region_7", None)]
    assert [r.Timestamp for r in tables.frames(spark, f"file://{tmp_path}/r", "raw_").collect()] == ["20240102T030405"]
    table = spark.createDataFrame([(1, "20240102T030405", 2.5), (2, "20240102T030405", None)], "Track_ID long, Timestamp string, Area double")
    tables.write_table(table, f"file://{tmp_path}/t", single=True)
    got = tables.read_table(spark, f"file://{tmp_path}/t", "Track_ID bigint, Timestamp string, Area double").orderBy("Track_ID").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in table.collect()]
    assert tables.mode_of(["raw_a", "coastline_b"]) == "coastline" and tables.mode_of(["raw_a"]) == "raw" and tables.mode_of([]) is None
    files = spark.createDataFrame([("labeled_mask_A.tif", "p1"), ("raw_labeled_mask_B.tif", "p2")], "name string, path string")
    paths = tables.mask_paths(spark.createDataFrame([("A",), ("B",), ("C",)], "Timestamp string"), files, "raw_")
    assert {r.Timestamp: r.tif_path for r in paths.collect()} == {"A": "p1", "B": "p2", "C": None}


def test_scorer_network():
    """A small network of the architecture's form: shapes, and attention that weighs as defined."""
    rng = np.random.default_rng(4)
    w: dict = {}

    def norm(name, n):
        w.update({f"{name}.weight": np.ones(n), f"{name}.bias": np.zeros(n), f"{name}.running_mean": np.zeros(n), f"{name}.running_var": np.ones(n)})

    def weight(name, *shape):
        w[f"{name}.weight"] = rng.normal(size=shape) * 0.1

    weight("encoder.0", 4, 1, 7, 7)
    norm("encoder.1", 4)
    widths, last = (8, 8, 8, 8), 4
    for s, n in enumerate(widths):
        name = f"encoder.{4 + s}.0"
        for layer, shape in (("conv1", (4, last, 1, 1)), ("conv2", (4, 4, 3, 3)), ("conv3", (n, 4, 1, 1)), ("downsample.0", (n, last, 1, 1))):
            weight(f"{name}.{layer}", *shape)
        for layer, k in (("bn1", 4), ("bn2", 4), ("bn3", n), ("downsample.1", n)):
            norm(f"{name}.{layer}", k)
        last = n
    for name, n in zip(("cbam1", "cbam2", "cbam3", "cbam4", "cbam_center"), (4, *widths), strict=True):
        weight(f"{name}.channel_attention.fc1", 2, n, 1, 1)
        weight(f"{name}.channel_attention.fc2", n, 2, 1, 1)
        weight(f"{name}.spatial_attention.conv1", 1, 2, 7, 7)
    for depth, n_in in ((4, 16), (3, 14), (2, 14), (1, 10)):
        weight(f"decoder{depth}.0", 6, n_in, 3, 3)
        weight(f"decoder{depth}.2", 6, 6, 3, 3)
        w[f"decoder{depth}.0.bias"] = w[f"decoder{depth}.2.bias"] = np.zeros(6)
    weight("output", 1, 6, 1, 1)
    w["output.bias"] = np.zeros(1)
    out = model.unet(rng.normal(size=(2, 1, 33, 40)), w, (1, 1, 1, 1))
    assert out.shape == (2, 1, 33, 40) and np.isfinite(out).all()
    x = rng.normal(size=(1, 4, 5, 5))
    flat = {"a.fc1.weight": np.zeros((2, 4, 1, 1)), "a.fc2.weight": np.zeros((4, 2, 1, 1))}
    assert np.allclose(model.channel_attention(x, flat, "a"), x / 2)
    one = model.conv(x, np.ones((1, 4, 3, 3)), pad=1)
    assert math.isclose(one[0, 0, 2, 2], x[0, :, 1:4, 1:4].sum())


def test_stream_tracker_equals_batch(spark, tmp_path):
    square, other = [21, 22, 41, 42], [205, 206, 225, 226]
    fields = "orbit int, tile_row int, tile_col int, frame int, label long, cx double, cy double, area double, left double, top double, width double, height double, cells array<int>, axis double, hu array<double>"

    def row(t, label, cells):
        r = _region(label, cells)
        return (1, 0, 0, t, label, r.cx, r.cy, r.area, float(r.box[0]), float(r.box[1]), float(r.box[2] - r.box[0]), float(r.box[3] - r.box[1]), cells, 1.0, None)

    frames = {1: [row(1, 21, square), row(1, 205, other)], 2: [row(2, 205, other)], 3: [row(3, 21, square)]}
    for t, rows in frames.items():
        spark.createDataFrame(rows, fields).coalesce(1).write.parquet(str(tmp_path / "in" / str(t)))
    source = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    out = stream_tracker.tracked(source, params.Identify(), 20)
    query = out.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.birth_frame, r.birth_label, r.frame) for r in spark.table("seen").collect())
    assert got == [(1, 21, 1), (1, 21, 3), (1, 205, 1), (1, 205, 2)]


def test_late_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 2.0), ("2024-01-02 01:00:00", "a", 4.0), ("2024-01-05 00:00:00", "b", 1.0)], "ts string, Orbit string, Area_km2 double")
    rows.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, Orbit string, Area_km2 double").parquet(str(tmp_path / "in"))
    query = stream_tracker.counted(source).writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.n, r.area_km2) for r in spark.table("counted").collect()) == [(1, 4.0), (2, 3.0)]


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_lookups_deal_out_common_keys(spark, kind):
    """Rows of a common key, of none and of an unknown one get what a plain join gives them, over many partitions."""
    rows = spark.range(30_000).selectExpr("id as n", f"cast(cast(case when id % 3 = 0 then 5 when id % 7 = 0 then null when id % 5 = 0 then 11 else id % 400 end as string) as {kind}) as k")
    table = spark.range(0, 400, 2).selectExpr(f"cast(cast(id as string) as {kind}) as k", "id * 10 as v")
    some = table.union(spark.range(1).selectExpr(f"cast('5' as {kind})", "50L"))
    listed = lambda df: sorted(((r.n, r.v) for r in df.collect()), key=repr)
    found = graph.looked_up(rows, "k", some, "v")
    assert found.columns == ["n", "k", "v"] and listed(found) == listed(rows.join(some, "k", "left"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert listed(graph.looked_up(rows, "k", some, "v", 30_000, counts)) == listed(found)
