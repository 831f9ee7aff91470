"""The tracker as a stateful stream, and late-data counts by event time."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import params
from ..operators.tracking import TileTracker, region_of
from ..session import ship

OUT = "orbit int, tile_row int, tile_col int, birth_frame int, birth_label bigint, frame int, label bigint, cx double, cy double, area double, Total_Cost double"


def tracked(regions: DataFrame, p: params.Identify, scene_width: int) -> DataFrame:
    """Observations of tracks as frames arrive; a track is named by tile, birth frame and birth label.

    regions: orbit, tile_row, tile_col, frame, label, cx, cy, area, left, top, width, height, cells,
    axis, hu. A frame's regions of a tile must come in one micro-batch, frames in order; those of a
    frame not after the last one seen are late and dropped. The state of a tile is its active tracks and
    the regions of its last frame. Unlike in a batch, frames without any region aren't known, so only
    frames in which the tile has regions count.
    """
    ship(regions.sparkSession)

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, last, before = pickle.loads(state.get[0]) if state.exists else (TileTracker(p, scene_width), None, [])
        out = []
        rows = pd.concat(list(groups))
        for frame, group in rows.groupby("frame", sort=True):
            if last is not None and frame <= last:
                continue
            now = sorted(map(region_of, group.itertuples(index=False)), key=lambda r: r.label)
            seen = tracker.step(int(frame), now, before if last == frame - 1 else [])
            out += [(*key, t.birth_frame, t.birth_label, f, r.label, r.cx, r.cy, r.area, costs[4]) for t, f, r, costs in seen]
            last, before = int(frame), now
            tracker.tracks = tracker.active()
        state.update((pickle.dumps((tracker, last, before)),))
        yield pd.DataFrame(out, columns=[part.split()[0] for part in OUT.split(", ")])

    return regions.groupBy("orbit", "tile_row", "tile_col").applyInPandasWithState(run, OUT, "state binary", "append", GroupStateTimeout.NoTimeout)


def counted(observations: DataFrame, time: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Observations by orbit and window of event time; rows later than the watermark are dropped."""
    return observations.withWatermark(time, late).groupBy(F.window(time, window), "Orbit").agg(F.count("*").alias("n"), F.sum("Area_km2").alias("area_km2"))
