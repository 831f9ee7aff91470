"""Parameters of the stages with their defaults, and the fixed constants of the method."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed constants: values of the method, not to be tuned.
CANVAS = 1536
DILATION_PIXELS = 40
AREA_GATE = 0.5
COST_GATE = 0.99
FORBIDDEN = 1e6
CONTOUR_MISSING, CONTOUR_CAP = 10.0, 100.0
COST_WEIGHTS = {"distance": 0.05, "area": 0.30, "axis": 0.60, "contour": 0.05}
NORMALISER_FLOORS = {"area": 0.05, "axis": 0.1, "contour": 0.1}
NORMALISER_DEFAULTS = {"area": 0.2, "axis": 1.0, "contour": 1.0}
STANDARD_PARALLEL = 71.0
SIC_TOLERANCE_KM = 20.0
MASKED_SURFACES = ("land", "ice shelf", "ice tongue", "rumple")
FAST_ICE_CLASS = 1


@dataclass(frozen=True)
class Detect:
    model_path: str = "models/unet_model.pth"
    patch_size: int = 250
    batch_size: int = 35


@dataclass(frozen=True)
class Extract:
    coastline: str | None = None
    min_area: float = 10
    block_rows: int = 4
    block_cols: int = 4


@dataclass(frozen=True)
class Identify:
    rows: int = 30
    cols: int = 30
    max_distance: float = 10.0
    max_missing_frames: int = 1


@dataclass(frozen=True)
class Physical:
    """Defaults are those of the narrower swath mode; EW is the wider one's preset."""

    min_pixels: int = 40
    cond1_area: float = 2500
    cond1_depth: float = -600
    cond1_sic: float = 40
    cond2_area: float = 250
    cond2_sic: float = 80
    cond3_depth: float = -1000
    min_bad_frames: int = 1


EW = Physical(min_pixels=10, cond1_area=625, cond2_area=63)


@dataclass(frozen=True)
class Export:
    overlap_threshold: float = 0.5
