"""DuckDB SQL for the queries, over the driver's views."""

from __future__ import annotations

import math

OBS = """obs as (
  select event_id, user_id * 100 + day(ts) as Track_ID, strftime(ts, '%Y%m%dT%H%M%S') as Timestamp,
    strftime(ts, '%Y%m%dT%H%M%S') || '_region_' || (k + 1) as Unique_ID,
    case when event_id % 97 <> 0 then value * 8 end as Area_km2,
    case when event_id % 89 <> 0 then cast(floor(value) as integer) end as Area_Pixels,
    case when event_id % 83 <> 0 then cast(-((event_id * 7919) % 1201) as double) end as Bed_Depth,
    cast(k as double) as SIC_Value, -2.0e6 + user_id * 1000 + k * 40 as Geo_X, 1.0e6 + (event_id % 997) * 500 as Geo_Y,
    event_type as Orbit, case when user_id % 2 = 0 then 'EW' else 'IW' end as Swath_Mode, ts
  from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events))"""

MANY = OBS + """, many as (select *, count(*) over (partition by Track_ID) as n_epochs from obs qualify n_epochs >= 2)"""
LARGE = MANY + """, large as (select * from many where Track_ID not in (select Track_ID from many where Area_Pixels < 1))"""
FLAGS = """
    coalesce(Area_km2 < 625 and Bed_Depth < -600 and SIC_Value > 40, false) as cond_1,
    coalesce(Area_km2 < 63 and SIC_Value > 80, false) as cond_2, coalesce(Bed_Depth < -1000, false) as cond_3"""
GOOD = LARGE + f""", marked as (select *, {FLAGS} from large), good as (
  select * from marked where Track_ID not in (select Track_ID from marked group by 1 having count(*) filter (where cond_1 or cond_2 or cond_3) >= 1))"""

PIXELS = """scenes as (
  select vec_id as scene_id, label as orbit, dense_rank() over (partition by label order by vec_id) as frame, embedding from embeddings),
pixels as (
  select scene_id, orbit, cast(frame as integer) as frame, cast(i // 8 as integer) as row, cast(i % 8 as integer) as col, i, cast(embedding[i + 1] as double) as value,
    case when (scene_id * 31 + i) % 37 <> 0 then cast(embedding[i + 1] as double) end as spotted
  from scenes, (select unnest(range(64)) as i))"""

COMPONENTS = PIXELS + """, positive as (select * from pixels where value > 0.1),
reach as (
  select scene_id, i, i as label from positive
  union
  select p.scene_id, p.i, r.label from reach r join positive q on q.scene_id = r.scene_id and q.i = r.i
    join positive p on p.scene_id = r.scene_id and abs(p.row - q.row) <= 1 and abs(p.col - q.col) <= 1),
comps as (
  select p.scene_id, p.orbit, p.frame, p.row, p.col, l.label from positive p
  join (select scene_id, i, min(label) as label from reach group by all) l using (scene_id, i))"""

REGIONS = COMPONENTS + """, regions as (
  select orbit, frame, scene_id, label, count(*) as area, avg(col) as cx, avg(row) as cy, min(col) as "left", min(row) as top,
    max(col) - min(col) + 1 as width, max(row) - min(row) + 1 as height
  from comps group by all having count(*) >= 3)"""

PAIRS = REGIONS + """, pairs as (
  select c.orbit, c.frame, c.scene_id as cur_scene_id, c.label as cur_label, p.scene_id as prev_scene_id, p.label as prev_label,
    sqrt((c.cx - p.cx) * (c.cx - p.cx) + (c.cy - p.cy) * (c.cy - p.cy)) as dist, abs(c.area - p.area) / greatest(p.area, 1.0) as area_change,
    c.area as cur_area, p.area as prev_area, greatest(c."left", p."left") as x0, greatest(c.top, p.top) as y0,
    least(c."left" + c.width, p."left" + p.width) as x1, least(c.top + c.height, p.top + p.height) as y1,
    abs(greatest(c.width, c.height) / least(c.width, c.height) - greatest(p.width, p.height) / least(p.width, p.height)) as axis_diff
  from regions c join regions p on c.orbit = p.orbit and c.frame = p.frame + 1
  where abs(c.area - p.area) / greatest(p.area, 1.0) <= 0.5)"""

OVERLAPS = PAIRS + """, inside as (
  select cur_scene_id, cur_label, prev_scene_id, prev_label, k.row, k.col, 1 as side from pairs join comps k on k.scene_id = cur_scene_id and k.label = cur_label
    and k.col >= x0 and k.col < x1 and k.row >= y0 and k.row < y1
  union all
  select cur_scene_id, cur_label, prev_scene_id, prev_label, k.row, k.col, 2 from pairs join comps k on k.scene_id = prev_scene_id and k.label = prev_label
    and k.col >= x0 and k.col < x1 and k.row >= y0 and k.row < y1),
counted as (
  select cur_scene_id, cur_label, prev_scene_id, prev_label, count(*) filter (where n > 1) as inter, count(*) as window_union
  from (select cur_scene_id, cur_label, prev_scene_id, prev_label, row, col, count(*) as n from inside group by all) group by all),
covers as (
  select pairs.*, coalesce(inter, 0) as inter, coalesce(window_union, 0) as window_union,
    case when coalesce(window_union, 0) > 0 then inter / window_union else 0.0 end as window_iou,
    coalesce(inter, 0) / (cur_area + prev_area - coalesce(inter, 0)) as full_iou
  from pairs left join counted using (cur_scene_id, cur_label, prev_scene_id, prev_label)),
pool as (select *, 1 - window_iou as area_cost from covers where 1 - window_iou <= 0.99),
norms as (
  select orbit, frame, greatest(quantile_cont(area_cost, 0.75), 0.05) as norm_area, greatest(quantile_cont(cast(axis_diff as double), 0.75), 0.1) as norm_axis
  from pool group by all)"""

E2 = (2 - 1 / 298.257223563) / 298.257223563
H2 = 1 - (6356889.44891 / 6378273.0) ** 2


def _scale(a: float, e2: float, parallel: float) -> float:
    phi, e = math.radians(parallel), math.sqrt(e2)
    t = math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)
    return a * math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2) / t


def _latitude(x: str, y: str) -> str:
    chi = f"(pi() / 2 - 2 * atan(sqrt({x} * {x} + {y} * {y}) / {_scale(6378137.0, E2, 71.0)!r}))"
    terms = [
        (E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12 + 13 * E2**4 / 360, 2), (7 * E2**2 / 48 + 29 * E2**3 / 240 + 811 * E2**4 / 11520, 4),
        (7 * E2**3 / 120 + 81 * E2**4 / 1120, 6), (4279 * E2**4 / 161280, 8),
    ]
    return f"-degrees({chi} + " + " + ".join(f"{f!r} * sin({n} * {chi})" for f, n in terms) + ")"


_LAT = _latitude("Geo_X", "Geo_Y")
_SIC = f"""{OBS}, ll as (select *, {_LAT} as lat, atan2(Geo_X, Geo_Y) as lam from obs),
rho as (select *, {_scale(6378273.0, H2, 70.0)!r} * tan(pi() / 4 - radians(-lat) / 2) / pow((1 - {math.sqrt(H2)!r} * sin(radians(-lat))) / (1 + {math.sqrt(H2)!r} * sin(radians(-lat))), {math.sqrt(H2) / 2!r}) as rho from ll),
near as (select *, (rho * sin(lam) / 1000 + 2800.0) / 50 as gx, (rho * cos(lam) / 1000 + 400.0) / 50 as gy from rho),
cell as (select *, cast(floor(gx + 0.5) as bigint) as xi, cast(floor(gy + 0.5) as bigint) as yi, substr(Timestamp, 1, 8) as date from near),
grid as (
  select '202401' || lpad(cast(d as varchar), 2, '0') as date, xi, yi, case when (xi + yi) % 11 <> 0 then cast((xi * 7 + yi * 13 + d * 5) % 101 as double) end as ice_conc
  from (select unnest(range(120)) as xi), (select unnest(range(120)) as yi), (select unnest(range(1, 32)) as d) where d <> 3),
met as (
  select cell.*, ice_conc, cell.date in (select date from grid) as dated,
    max(case when greatest(abs(gx - cell.xi), abs(gy - cell.yi)) * 50 > 24 or cell.xi < 0 or cell.yi < 0 or cell.xi > 119 or cell.yi > 119 then 1 else 0 end) over (partition by Timestamp) = 1 as void
  from cell left join grid on grid.date = cell.date and grid.xi = cell.xi and grid.yi = cell.yi)"""


def _q(with_: str, select: str) -> str:
    return f"with recursive {with_}{select if select.startswith(',') else ' ' + select}"


_WINDOW_SMOOTH = COMPONENTS + """, seq as (
  select scene_id, label, row * 8 + col as i, col * 13 + row * 5 as x, count(*) over (partition by scene_id, label) as n,
    sum(col * 13 + row * 5) over (partition by scene_id, label order by row * 8 + col rows between 2 preceding and 2 following) as s
  from comps)"""

_WARP = f"""grid as (select n // 181 as r, n % 181 as c, case when n % 97 <> 0 then cast((n * 31) % 1000 as double) end as depth from (select unnest(range(41 * 181)) as n)),
cells as (select n // 60 as r, n % 60 as k, (n % 60 + 0.5) * 50000.0 as Geo_X, 3.0e6 - (n // 60 + 0.5) * 50000.0 as Geo_Y from (select unnest(range(3600)) as n)),
at4 as (select r, k, degrees(atan2(Geo_X, Geo_Y)) / 0.5 as fc, ({_LAT} + 60.0) / -0.5 as fr from cells)"""

_RANKED = COMPONENTS + """, feats as (select orbit, scene_id * 64 + label as rid, count(*) as area from comps group by all having count(*) >= 3),
ranked as (select *, row_number() over (partition by orbit order by area desc, rid) as rank from feats),
cells as (select c.orbit, c.scene_id * 64 + c.label as rid, row, col from comps c where c.scene_id * 64 + c.label in (select rid from feats)),
edges as (
  select a.orbit, a.rid as i, b.rid as j, count(*) as shared from cells a join cells b on a.orbit = b.orbit and a.row = b.row and a.col = b.col and a.rid <> b.rid group by all),
strong as (
  select e.orbit, ri.rank as i_rank, list(rj.rank) as js from edges e join ranked ri on ri.rid = e.i join ranked rj on rj.rid = e.j
  where e.shared / rj.area > 0.5 group by all),
walk as (
  select orbit, cast(0 as bigint) as step, cast([] as bigint[]) as gone from (select distinct orbit from ranked)
  union all
  select w.orbit, w.step + 1, case when s.js is null or list_contains(w.gone, w.step + 1) then w.gone else list_distinct(list_concat(w.gone, s.js)) end
  from walk w left join strong s on s.orbit = w.orbit and s.i_rank = w.step + 1
  where w.step < (select max(rank) from ranked r where r.orbit = w.orbit)),
last as (select orbit, gone from walk qualify row_number() over (partition by orbit order by step desc) = 1)"""

_ASSIGN = PAIRS + """, cand as (select orbit, frame, cur_label, prev_label, dist as cost, dense_rank() over (partition by orbit, frame order by cur_label) as k from pairs where dist <= 10),
sizes as (select orbit, frame, max(k) as n from cand group by all),
tree as (
  select orbit, frame, cast(0 as bigint) as k, cast([] as bigint[]) as curs, cast([] as bigint[]) as prevs, cast(0.0 as double) as cost, n from sizes
  union all
  select t.orbit, t.frame, t.k + 1, case when c.prev_label is null then t.curs else list_append(t.curs, c.cur_label) end,
    case when c.prev_label is null then t.prevs else list_append(t.prevs, c.prev_label) end, t.cost + coalesce(c.cost, 0.0), t.n
  from tree t join (select orbit, frame, k, cur_label, prev_label, cost from cand union all select distinct orbit, frame, k, null, null, null from cand) c
    on c.orbit = t.orbit and c.frame = t.frame and c.k = t.k + 1
  where c.prev_label is null or not list_contains(t.prevs, c.prev_label)),
best as (select * from tree where k = n qualify row_number() over (partition by orbit, frame order by len(curs) desc, cost) = 1),
chosen as (select orbit, frame, unnest(curs) as cur_label, unnest(prevs) as prev_label from best)"""

_SURFACES = """rects(x, y, w, h) as (values (0, 0, 2, 2), (6, 6, 2, 2), (0, 7, 3, 1), (7, 0, 1, 2)),
covered as (select distinct px, py from rects, (select unnest(range(8)) as px), (select unnest(range(8)) as py) where px >= x and px < x + w and py >= y and py < y + h),
mask as (select distinct a.x as px, a.y as py from (select unnest(range(8)) as x) ax(x), (select unnest(range(8)) as y) ay(y), lateral (select ax.x as x, ay.y as y) a, covered c where abs(a.x - c.px) + abs(a.y - c.py) <= 1)"""

_ICE = """ice(x, y, w, h) as (values (0, 0, 4, 4), (4, 0, 2, 4)),
judged as (
  select r.*, exists (select 1 from ice where x <= r."left" + r.width and r."left" <= x + w and y <= r.top + r.height and r.top <= y + h) as meets,
    r."left" >= 0 and r."left" + r.width <= 6 and r.top >= 0 and r.top + r.height <= 4 as covered
  from regions r),
classed as (select *, case when covered then 'Inside' when meets then 'Partial' else 'Outside' end as Fast_Ice_Overlap_Status from judged)"""

_BILINEAR = PIXELS + """, grid as (select r, c, greatest(0.0, least(7.0, (r + 0.5) * 8 / 12 - 0.5)) as y, greatest(0.0, least(7.0, (c + 0.5) * 8 / 12 - 0.5)) as x
  from (select unnest(range(12)) as r), (select unnest(range(12)) as c)),
places as (select *, cast(floor(y) as integer) as t, cast(floor(x) as integer) as l, least(7, cast(floor(y) as integer) + 1) as b, least(7, cast(floor(x) as integer) + 1) as e,
  cast(floor((r + 0.5) * 8 / 12) as integer) as nr, cast(floor((c + 0.5) * 8 / 12) as integer) as nc from grid),
arr as (select scene_id, list(spotted order by i) as a from pixels group by all)"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    area_res = f"""{COMPONENTS}, spot as (select *, -1.5e6 + scene_id * 20000 + 1000.0 * (col + 0.5) as Geo_X, 9.0e5 - 1000.0 * (row + 0.5) as Geo_Y from comps),
      lat as (select *, (1 + sin(radians(abs({_LAT})))) / {1 + math.sin(math.radians(71.0))!r} as k from spot)"""
    return {
        "track_min_epochs": _q(MANY, "select event_id, Track_ID, Timestamp, n_epochs from many"),
        "track_pixel_filter": _q(LARGE, "select event_id, Track_ID, Area_Pixels from large"),
        "qc_bad_frames": _q(OBS, f"select *, cond_1 or cond_2 or cond_3 as is_bad_frame from (select event_id, {FLAGS} from obs)"),
        "qc_track_removal": _q(GOOD, "select event_id, Track_ID, Area_km2, Bed_Depth, SIC_Value from good"),
        "qc_step_metrics": _q(GOOD, """
            select '0_input' as step, count(distinct Track_ID) as tracks, count(*) as n_rows from obs
            union all select '1_epochs', count(distinct Track_ID), count(*) from many
            union all select '2_pixels', count(distinct Track_ID), count(*) from large
            union all select '3_conditions', count(distinct Track_ID), count(*) from good"""),
        "uid_label_parse": _q(OBS, """
            select event_id, coalesce(try_cast(split_part(u, '_region_', 2) as bigint), -1) as label, substr(Timestamp, 1, 8) as date_token,
              strftime(ts, '%Y-%m-%d %H:%M:%S') as observed_at, 'raw_labeled_mask_' || Timestamp || '.tif' as mask_name
            from (select *, case when event_id % 50 = 0 then 'no number' else Unique_ID end as u from obs)"""),
        "orbit_track_summary": _q(OBS, """
            select Orbit, Track_ID, min(Timestamp) as first_ts, max(Timestamp) as last_ts, count(*) as n_epochs, round(avg(Area_km2), 6) as mean_km2,
              round(min(Area_km2), 6) as min_km2, round(max(Area_km2), 6) as max_km2, round(avg(Area_Pixels), 6) as mean_px, min(Area_Pixels) as min_px, max(Area_Pixels) as max_px,
              first(Swath_Mode order by Timestamp, event_id) as swath, round(avg(Bed_Depth), 6) as mean_depth
            from obs group by Orbit, Track_ID"""),
        "track_mid_observation": _q(OBS, """
            select Orbit, Track_ID, event_id, Timestamp, Unique_ID from (
              select *, row_number() over (partition by Orbit, Track_ID order by Timestamp, event_id) - 1 as k, count(*) over (partition by Orbit, Track_ID) as n from obs)
            where k = n // 2"""),
        "range_strings": _q(OBS, """
            select Orbit, Track_ID, min(Timestamp) || ' - ' || max(Timestamp) as Date_Range, min(Area_Pixels) || ' - ' || max(Area_Pixels) as Area_Range_px,
              concat_ws(' - ', printf('%.3f', min(Area_km2)), printf('%.3f', max(Area_km2))) as Area_Range_km2
            from obs group by Orbit, Track_ID having min(Area_Pixels) is not null"""),
        "union_orbits": _q(OBS, "select event_id, Orbit, Area_km2, cast(null as double) as SIC_Value, cast(null as double) as Bed_Depth from obs where Orbit = 'click' union all select event_id, Orbit, null, SIC_Value, null from obs where Orbit = 'view' union all select event_id, Orbit, Area_km2, null, Bed_Depth from obs where coalesce(Orbit not in ('click', 'view'), true)"),
        "manifest_resume": _q(OBS, "select event_id, Orbit, Timestamp from obs where (Orbit, Timestamp) not in (select (Orbit, Timestamp) from obs where event_id % 3 = 0)"),
        "column_defaults": _q(OBS, "select event_id, Track_ID, Area_Pixels, Geo_X, Geo_Y, 'Unknown' as Orbit, 'EW' as Swath_Mode, cast(null as double) as Bed_Depth, 'a_b' as layer from obs"),
        "track_features": _q(GOOD, """, placed as (
              select *, row_number() over (partition by Orbit, Track_ID order by Timestamp, event_id) - 1 as k, count(*) over (partition by Orbit, Track_ID) as n from good),
            sums as (
              select Orbit, Track_ID, min(Timestamp) || ' - ' || max(Timestamp) as Date_Range, round(avg(Area_km2), 6) as Area_Mean_km2, round(avg(Area_Pixels), 6) as Area_Mean_px,
                min(Area_Pixels) || ' - ' || max(Area_Pixels) as Area_Range_px,
                concat_ws(' - ', printf('%.3f', min(Area_km2)), printf('%.3f', max(Area_km2))) as Area_Range_km2, round(avg(Bed_Depth), 6) as Bed_Depth, first(Swath_Mode order by Timestamp, event_id) as Swath_Mode
              from good group by Orbit, Track_ID having min(Area_Pixels) is not null)
            select cast(s.Track_ID as varchar) as Global_UID, s.Orbit, p.Timestamp, p.Unique_ID, s.Date_Range, s.Area_Mean_km2, s.Area_Range_km2, s.Area_Mean_px, s.Area_Range_px, s.Bed_Depth, s.Swath_Mode,
              round(p.Geo_Y, 6) as Northing_3031, round(p.Geo_X, 6) as Easting_3031
            from sums s join placed p on p.Orbit = s.Orbit and p.Track_ID = s.Track_ID and p.k = p.n // 2"""),
        "patch_grid": _q(PIXELS, """, cut as (select *, least(row // 2, 2) as patch_row, least(col // 2, 2) as patch_col from pixels)
            select scene_id, cast(patch_row as integer) as patch_row, cast(patch_col as integer) as patch_col, min(row) as row0, min(col) as col0, max(row) - min(row) + 1 as height, max(col) - min(col) + 1 as width,
              cast(count(*) as integer) as n, round(sum(value), 6) as total from cut group by scene_id, patch_row, patch_col"""),
        "stitch_roundtrip": _q(PIXELS, "select scene_id, row, col, round(value, 6) as value from pixels"),
        "threshold_mask": _q(PIXELS, """
            select scene_id, row, col, cast(m as integer) as mask, m / 255.0 > 0.5 as positive from (
              select scene_id, row, col, case when spotted is not null and 1 / (1 + exp(-(spotted * 10 - 1))) > 0.5 then 255 else 0 end as m from pixels)"""),
        "non_empty_scenes": _q(PIXELS, "select scene_id, row, col from pixels where value > 0.35"),
        "nan_boundary": _q(PIXELS, """, p as (select *, row // 4 as pr, col // 4 as pc from pixels), bad as (select * from p where spotted is null)
            select scene_id, row, col,
              spotted is not null and exists (select 1 from bad b where b.scene_id = p.scene_id and b.pr = p.pr and b.pc = p.pc and abs(b.row - p.row) <= 1 and abs(b.col - p.col) <= 1) as is_edge,
              exists (select 1 from bad b where b.scene_id = p.scene_id and b.pr = p.pr and b.pc = p.pc and abs(b.row - p.row) <= 2 and abs(b.col - p.col) <= 2) as is_cleared
            from p"""),
        "mask_dilation": _q(PIXELS, "select distinct p.scene_id, p.row, p.col from pixels p join pixels c on c.scene_id = p.scene_id and abs(c.row - p.row) + abs(c.col - p.col) <= 2 where c.value > 0.25"),
        "bilinear_resample": _q(_BILINEAR, """
            select scene_id, cast(r as integer) as row, cast(c as integer) as col, case when a[nr * 8 + nc + 1] is not null then round(
              (1 - (y - t)) * ((1 - (x - l)) * coalesce(a[t * 8 + l + 1], 0.0) + (x - l) * coalesce(a[t * 8 + e + 1], 0.0))
              + (y - t) * ((1 - (x - l)) * coalesce(a[b * 8 + l + 1], 0.0) + (x - l) * coalesce(a[b * 8 + e + 1], 0.0)), 6) end as value from arr, places"""),
        "nearest_resample": _q(PIXELS, """
            select p.scene_id, cast(r as integer) as row, cast(c as integer) as col, round(spotted, 6) as value
            from pixels p join (select unnest(range(5)) as r) on p.row = floor((r + 0.5) * 8 / 5) join (select unnest(range(3)) as c) on p.col = floor((c + 0.5) * 8 / 3)"""),
        "connected_components": _q(COMPONENTS, "select scene_id, row, col, label from comps"),
        "block_merge_components": _q(COMPONENTS, "select scene_id, row, col, label from comps"),
        "relabel_sequence": _q(COMPONENTS, "select scene_id, label, dense_rank() over (partition by scene_id order by label) as number from (select distinct scene_id, label from comps)"),
        "region_stats": _q(REGIONS, 'select scene_id, label, area, round(cx, 6) as cx, round(cy, 6) as cy, "left", top, width, height from regions'),
        "polygon_erase": _q(PIXELS + ", " + _SURFACES, "select scene_id, row, col, case when (col, row) in (select (px, py) from mask) then 0.0 else round(value, 6) end as value from pixels"),
        "tile_assignment": _q(REGIONS, """
            select scene_id, label, tile_row, tile_col, round(cx - tile_col * 2, 6) as local_x, round(cy - tile_row * 2, 6) as local_y
            from (select *, cast(least(floor(cy / 2), 2) as integer) as tile_row, cast(least(floor(cx / 2), 2) as integer) as tile_col from regions)"""),
        "true_area_by_label": _q(area_res, "select scene_id, label, round(sum(1000.0 * 1000.0 / (k * k) / 1e6), 6) as area_km2, count(*) as pixels from lat group by all"),
        "area_lookup": _q(OBS, """, o as (select *, cast(split_part(Unique_ID, '_region_', 2) as bigint) as label from obs),
            known as (select Timestamp, label, min(SIC_Value) / 4 as found_km2, cast(count(*) as integer) as pixels from o where event_id % 7 <> 0 and label <= 80 group by all),
            readable as (select Timestamp, min(event_id) % 13 <> 0 as ok from o group by all having min(event_id) % 11 <> 0)
            select event_id, case when ok then round(coalesce(found_km2, 0.0), 6) end as Area_km2, case when ok is null then 0 when ok then coalesce(pixels, 0) end as Area_Pixels
            from o left join known using (Timestamp, label) left join readable using (Timestamp)"""),
        "polar_inverse": _q(OBS, f"select event_id, round({_LAT}, 6) as Latitude, round(degrees(atan2(Geo_X, Geo_Y)), 6) as Longitude from obs"),
        "bathymetry_sample": _q(OBS, """, spot as (select event_id, cast(floor((2.0e6 - Geo_Y) / 40000.0) as bigint) as r, cast(floor((Geo_X + 2.4e6) / 40000.0) as bigint) as c from obs)
            select event_id, case when r >= 0 and r < 100 and c >= 0 and c < 100 and (r * 100 + c) % 53 <> 0 then cast(-(((r * 100 + c) * 37) % 1500) as double) end as Bed_Depth from spot"""),
        "sic_nearest": _q(_SIC, "select event_id, case when not dated then 'missing' when void then 'out' else 'ok' end as sic_status, case when dated and not void then coalesce(ice_conc, 0.0) else 0.0 end as SIC_Value from met"),
        "frame_pairs": _q(PAIRS, "select orbit, frame, cur_scene_id, cur_label, prev_scene_id, prev_label, round(dist, 6) as dist, round(area_change, 6) as area_change from pairs where dist <= 2.0"),
        "window_iou": _q(OVERLAPS, "select orbit, frame, cur_scene_id, cur_label, prev_scene_id, prev_label, inter, window_union, round(window_iou, 6) as window_iou, round(full_iou, 6) as full_iou from covers where dist <= 10"),
        "cost_normalisers": _q(OVERLAPS, "select orbit, frame, round(norm_area, 6) as norm_area, round(norm_axis, 6) as norm_axis from norms"),
        "pair_costs": _q(OVERLAPS, """
            select orbit, frame, cur_scene_id, cur_label, prev_scene_id, prev_label, round(0.05 * dist + 0.30 * (area_cost / norm_area) + 0.60 * (axis_diff / norm_axis), 6) as cost
            from pool join norms using (orbit, frame) where dist <= 10"""),
        "assignment": _q(_ASSIGN, "select ch.orbit, ch.frame, ch.cur_label, ch.prev_label, round(c.cost, 6) as cost from chosen ch join cand c using (orbit, frame, cur_label, prev_label)"),
        "unmatched_regions": _q(_ASSIGN, "select r.orbit, count(*) as new_regions from regions r left join chosen c on c.orbit = r.orbit and c.frame = r.frame and c.cur_label = r.label where c.cur_label is null group by 1"),
        "frame_counters": _q(_ASSIGN, """, n as (select orbit, frame, count(*) as regions from regions group by all), m as (select orbit, frame, count(*) as matched from chosen group by all)
            select orbit, frame, regions, coalesce(matched, 0) as matched, regions - coalesce(matched, 0) as new from n left join m using (orbit, frame)"""),
        "clipped_boxes": _q(REGIONS, """, c as (
              select scene_id, label, greatest("left" + 2, 0) as x0, greatest(top - 2, 0) as y0, least("left" + 2 + width, 8) as x1, least(top - 2 + height, 8) as y1 from regions)
            select scene_id, label, x0 as "left", y0 as top, greatest(x1 - x0, 0) as width, greatest(y1 - y0, 0) as height, x1 <= x0 or y1 <= y0 as is_empty from c"""),
        "grid_warp": _q(_WARP, """, met as (
              select c.r, c.k, (1 - abs(c.fr - n.sr)) * (1 - abs(c.fc - n.sc)) as w, g.depth
              from at4 c, lateral (select floor(c.fr) + i as sr, floor(c.fc) + j as sc from (values (0, 0), (0, 1), (1, 0), (1, 1)) v(i, j)) n left join grid g on g.r = n.sr and g.c = n.sc)
            select cast(r as integer) as row, cast(k as integer) as col, case when count(*) filter (where depth is null and w > 0) = 0 then round(sum(w * depth), 6) end as depth from met group by r, k"""),
        "contour_smooth": _q(_WINDOW_SMOOTH, "select scene_id, label, cast(i as integer) as i, x, case when n < 5 then x else cast(trunc(s / 5.0) as integer) end as smooth_x from seq"),
        "overlap_candidates": _q(REGIONS, """, r as (select *, scene_id * 64 + label as rid from regions)
            select x.orbit, x.rid as a, y.rid as b from r x join r y on x.orbit = y.orbit and x.rid < y.rid and x."left" <= y."left" + y.width and y."left" <= x."left" + x.width
              and x.top <= y.top + y.height and y.top <= x.top + x.height"""),
        "dedup_greedy": _q(_RANKED, "select r.orbit, rid, area, rank, list_contains(gone, rank) as dropped from ranked r join last using (orbit)"),
        "fast_ice_status": _q(REGIONS + ", " + _ICE, "select scene_id, label, Fast_Ice_Overlap_Status from classed"),
        "status_counts": _q(REGIONS + ", " + _ICE, "select Fast_Ice_Overlap_Status, count(*) as n from classed group by 1"),
        "geometry_status": _q(REGIONS, """, pts as (select scene_id, label as rid, cx * 1000 + case when label % 7 = 0 then 9000 else 500 end as gx, 8000.0 - cy * 1000 - 500 as gy from regions),
            spot as (select *, cast(floor((gy - 8000.0) / -1000.0) as integer) as r, cast(floor(gx / 1000.0) as integer) as c from pts)
            select spot.scene_id, rid, k.label, case when not (r >= 0 and r < 8 and c >= 0 and c < 8) then 'Coordinates Out of Bounds' when k.label is null then 'Background Label Detected' else 'Success' end as status
            from spot left join comps k on k.scene_id = spot.scene_id and k.row = spot.r and k.col = spot.c"""),
        "traced_polygons": _q(COMPONENTS, """, part as (
              select scene_id, label, row, col from comps where row * 8 + col = label
              union
              select n.scene_id, n.label, n.row, n.col from part p join comps n on n.scene_id = p.scene_id and n.label = p.label and abs(n.row - p.row) + abs(n.col - p.col) = 1),
            corner as (
              select scene_id, label, y, x, count(*) as n, bool_or(dy = dx) as main, bool_or(dy <> dx) as other
              from (select scene_id, label, row + dy as y, col + dx as x, dy, dx from part, (values (0), (1)) a(dy), (values (0), (1)) b(dx)) group by all),
            corners as (select scene_id, label, sum(case when n in (1, 3) then 1 when n = 2 and main <> other then 2 else 0 end) as corners from corner group by all)
            select scene_id, label, cast(count(*) as double) as geom_area, count(*) < any_value(c.n) as multipolygon, cast(any_value(corners) as bigint) as corners
            from part join (select scene_id, label, count(*) as n from comps group by all) c using (scene_id, label) join corners using (scene_id, label) group by scene_id, label"""),
        "predicted_masks": _q(PIXELS, """, p as (select *, row // 4 as pr, col // 4 as pc from pixels), bad as (select * from p where spotted is null)
            select scene_id, row, col, case when spotted is not null and 1 / (1 + exp(-(10.0 * (spotted - 0.1)))) > 0.5
              and not exists (select 1 from bad b where b.scene_id = p.scene_id and b.pr = p.pr and b.pc = p.pc and abs(b.row - p.row) <= 2 and abs(b.col - p.col) <= 2) then 255 else 0 end as mask from p"""),
    }
