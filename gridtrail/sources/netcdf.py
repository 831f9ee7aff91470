"""Classic NetCDF files (formats 1, 2 and 5): header and variables, packed values unpacked.

Files of the HDF5-based format are told by their first bytes and refused; convert these to classic
ones, or store their grids by ``tables.import_sea_ice``.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Types of values by their number in the file: fixed values.
TYPES = {1: "i1", 2: "S1", 3: "i2", 4: "i4", 5: "f4", 6: "f8", 7: "u1", 8: "u2", 9: "u4", 10: "i8", 11: "u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12


@dataclass
class Variable:
    shape: tuple[int, ...]
    kind: str
    at: int
    names: tuple[str, ...]
    attributes: dict = field(default_factory=dict)


class _Reader:
    def __init__(self, raw: bytes):
        if raw[:4] == b"\x89HDF":
            raise ValueError("an HDF5-based NetCDF file; only classic ones are read")
        if raw[:3] != b"CDF" or raw[3] not in (1, 2, 5):
            raise ValueError("not a NetCDF file")
        self.raw, self.at = raw, 4
        self.count, self.place = (">q" if raw[3] == 5 else ">i"), (">i" if raw[3] == 1 else ">q")

    def number(self, code: str | None = None) -> int:
        code = code or self.count
        (value,) = struct.unpack_from(code, self.raw, self.at)
        self.at += struct.calcsize(code)
        return value

    def text(self) -> str:
        n = self.number()
        out = self.raw[self.at : self.at + n].decode("utf-8", "replace")
        self.at += n + -n % 4
        return out

    def entries(self, tag: int) -> int:
        """How many entries a list of this tag has; 0 if it is absent."""
        found, n = self.number(">i"), self.number()
        if found not in (0, tag):
            raise ValueError(f"list {found} where {tag} was expected")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.entries(ATTRIBUTES)):
            name, kind = self.text(), TYPES[self.number(">i")]
            n = self.number()
            values = np.frombuffer(self.raw, np.dtype(kind).newbyteorder(">"), n, self.at)
            self.at += values.nbytes + -values.nbytes % 4
            out[name] = values.tobytes().decode("utf-8", "replace") if kind == "S1" else values
        return out


def variables(raw: bytes) -> dict[str, Variable]:
    """The variables of a file; a record dimension has as many entries as there are records."""
    r = _Reader(raw)
    records = r.number()
    dims = []
    for _ in range(r.entries(DIMENSIONS)):
        name = r.text()
        dims.append((name, r.number()))
    r.attributes()
    out = {}
    for _ in range(r.entries(VARIABLES)):
        name = r.text()
        at = [r.number() for _ in range(r.number())]
        attributes, kind = r.attributes(), TYPES[r.number(">i")]
        r.number()  # bytes
        shape = tuple(dims[k][1] or records for k in at)
        out[name] = Variable(shape, kind, r.number(r.place), tuple(dims[k][0] for k in at), attributes)
    many = [v for v in out.values() if v.names and dict(dims)[v.names[0]] == 0]
    if records > 1 and len(many) > 1:
        raise ValueError("several variables with more than one record aren't supported")
    return out


def values(raw: bytes, name: str) -> np.ndarray:
    """A variable as doubles, by its scale and offset; fill values and what is outside its valid range are NaN."""
    v = variables(raw)[name]
    data = np.frombuffer(raw, np.dtype(v.kind).newbyteorder(">"), int(np.prod(v.shape, dtype=np.int64)), v.at).reshape(v.shape)
    out = data.astype(float)
    for key in ("_FillValue", "missing_value"):
        if key in v.attributes:
            out[data == v.attributes[key][0]] = np.nan
    if "valid_range" in v.attributes:
        low, high = v.attributes["valid_range"]
        out[(data < low) | (data > high)] = np.nan
    for key, bound in (("valid_min", np.less), ("valid_max", np.greater)):
        if key in v.attributes:
            out[bound(data, v.attributes[key][0])] = np.nan
    scale, offset = (float(v.attributes[k][0]) if k in v.attributes else d for k, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
    return out * scale + offset


def cells(raw: bytes, variable: str, date: str) -> pa.RecordBatch:
    """date, xi, yi and the value of each cell of a grid (yc, xc), with dimensions of one entry before it; missing ones are null."""
    data = values(raw, variable)
    data = data.reshape(data.shape[-2:])
    yi, xi = (x.ravel() for x in np.indices(data.shape))
    flat = data.ravel()
    return pa.RecordBatch.from_arrays([pa.array([date] * len(flat)), pa.array(xi), pa.array(yi), pa.array(flat, mask=np.isnan(flat))], ["date", "xi", "yi", "ice_conc"])
