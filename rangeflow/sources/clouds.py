"""Point-cloud messages in the CDR encoding: header-only and full decode, and an encoder.

Decoding is permissive: a message that breaks the format becomes a row with ``error`` set and no
points, never a lost row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Field type codes of the wire format, as NumPy type strings.
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
MAX_FIELDS = 1024
#: Fields that are one number a point.
SCALARS = ("x", "y", "z", "intensity", "ring")
POINT = "array<struct<slot:long,x:float,y:float,z:float,intensity:float,ring:int>>"


class CloudError(ValueError):
    """A message that breaks the format."""


class Reader:
    """Sequential reads of a CDR body; alignment counts from byte 4."""

    def __init__(self, raw: bytes) -> None:
        if len(raw) < 4:
            raise CloudError("no header")
        if raw[0] or raw[1] > 1:
            raise CloudError(f"encapsulation {raw[:2].hex()}")
        self.raw, self.at = raw, 4
        self.order = "<" if raw[1] else ">"

    def number(self, kind: str) -> int:
        size = struct.calcsize(kind)
        self.at += -(self.at - 4) % size
        if self.at + size > len(self.raw):
            raise CloudError("message ends early")
        (value,) = struct.unpack_from(self.order + kind, self.raw, self.at)
        self.at += size
        return value

    def block(self) -> bytes:
        n = self.number("I")
        if self.at + n > len(self.raw):
            raise CloudError("message ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def text(self) -> str:
        return self.block().rstrip(b"\0").decode("utf-8", "replace")


def read_header(raw: bytes) -> tuple[int, str]:
    """Stamp in nanoseconds and frame id, without touching the points."""
    r = Reader(raw)
    sec, nano = r.number("i"), r.number("I")
    return sec * 1_000_000_000 + nano, r.text()


def read_cloud(raw: bytes) -> dict:
    """The whole message; points as a structured array."""
    r = Reader(raw)
    sec, nano = r.number("i"), r.number("I")
    out = {"stamp_ns": sec * 1_000_000_000 + nano, "frame_id": r.text(), "height": r.number("I"), "width": r.number("I")}
    n = r.number("I")
    if n > MAX_FIELDS:
        raise CloudError(f"{n} fields")
    fields = [(r.text(), r.number("I"), r.number("B"), r.number("I")) for _ in range(n)]
    big, step, row = bool(r.number("B")), r.number("I"), r.number("I")
    data = r.block()
    names = [f[0] for f in fields]
    if len(set(names)) < len(names):
        raise CloudError("a field name twice")
    if missing := {"x", "y", "z"} - set(names):
        raise CloudError(f"fields missing: {sorted(missing)}")
    formats = []
    for name, offset, kind, count in fields:
        if kind not in KINDS:
            raise CloudError(f"type {kind} of field {name}")
        one = np.dtype((">" if big else "<") + KINDS[kind])
        if offset + one.itemsize * max(1, count) > step:
            raise CloudError(f"field {name} beyond the point")
        if name in SCALARS and count > 1:
            raise CloudError(f"field {name} is an array")
        formats.append(one if count <= 1 else (one, (count,)))
    if not step:
        raise CloudError("points of no size")
    kind = np.dtype({"names": names, "formats": formats, "offsets": [f[1] for f in fields], "itemsize": step})
    height, width = out["height"], out["width"]
    line = row if height > 1 and row != width * step else width * step
    if len(data) < (height - 1) * line + width * step:
        raise CloudError("data too short")
    raw_rows = [data[k * line : k * line + width * step] for k in range(height)] if line != width * step else [data[: height * width * step]]
    return out | {"points": np.frombuffer(b"".join(raw_rows), kind)}


def write_cloud(stamp_ns: int, frame_id: str, points: np.ndarray, big: bool = False) -> bytes:
    """Encode a structured array as one unorganised message."""
    order = ">" if big else "<"
    out = bytearray(b"\0\1\0\0" if not big else b"\0\0\0\0")

    def number(kind: str, value: int) -> None:
        out.extend(b"\0" * (-(len(out) - 4) % struct.calcsize(kind)))
        out.extend(struct.pack(order + kind, value))

    def block(data: bytes) -> None:
        number("I", len(data))
        out.extend(data)

    codes = {v: k for k, v in KINDS.items()}
    kind = points.dtype
    number("i", stamp_ns // 1_000_000_000)
    number("I", stamp_ns % 1_000_000_000)
    block(frame_id.encode() + b"\0")
    number("I", 1)
    number("I", len(points))
    number("I", len(kind.names))
    for name in kind.names:
        sub, offset = kind.fields[name][:2]
        block(name.encode() + b"\0")
        number("I", offset)
        number("B", codes[sub.str[1:]])
        number("I", 1)
    number("B", int(big))
    number("I", kind.itemsize)
    number("I", kind.itemsize * len(points))
    block(points.tobytes())
    number("B", 1)
    return bytes(out)


def decode_headers(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """All columns but ``raw``, and ``stamp_ns, frame_id, error``."""
    rest = [c for c in messages.columns if c != raw]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stamps, ids, errors = [], [], []
            for m in b.column(raw).to_pylist():
                try:
                    stamp, name = read_header(m or b"")
                    error = None
                except ValueError as e:
                    stamp, name, error = None, None, str(e)
                stamps.append(stamp)
                ids.append(name)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(stamps, pa.int64()), pa.array(ids, pa.string()), pa.array(errors, pa.string())], [*rest, "stamp_ns", "frame_id", "error"])

    fields = ", ".join(f"`{c}` {t}" for c, t in messages.dtypes if c != raw)
    return messages.mapInArrow(run, f"{fields}, stamp_ns long, frame_id string, error string")


def decode_points(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """One row a message with its ``points``; missing optional fields are null, NaN becomes null.

    A ring that is no whole number of 32 bits is null.
    """
    rest = [c for c in messages.columns if c != raw]

    def column(p: np.ndarray, name: str, kind: pa.DataType) -> pa.Array:
        if name not in (p.dtype.names or ()):
            return pa.nulls(len(p), kind)
        values = np.ascontiguousarray(p[name].astype(p[name].dtype.newbyteorder("=")))
        if kind == pa.int32():
            fits = (values >= -(2**31)) & (values < 2**31) & (values == np.floor(values))
            return pa.array(np.where(fits, values, 0).astype(np.int32), mask=~fits)
        return pa.array(values.astype(np.float32), from_pandas=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in enumerate(b.column(raw).to_pylist()):
                try:
                    c, error = read_cloud(m or b""), None
                except ValueError as e:
                    c, error = {"stamp_ns": None, "frame_id": None, "points": np.empty(0, [("x", "f4")])}, str(e)
                p = c["points"]
                names = [("slot", pa.int64()), *((n, pa.float32()) for n in ("x", "y", "z", "intensity")), ("ring", pa.int32())]
                cols = [pa.array(np.arange(len(p)))] + [column(p, n, t) for n, t in names[1:]]
                values = pa.StructArray.from_arrays(cols, names=[n for n, _ in names])
                points = pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(x).slice(k, 1) for x in rest), pa.array([c["stamp_ns"]], pa.int64()), pa.array([c["frame_id"]], pa.string()), pa.array([error], pa.string()), points],
                    [*rest, "stamp_ns", "frame_id", "error", "points"],
                )

    fields = ", ".join(f"`{c}` {t}" for c, t in messages.dtypes if c != raw)
    return messages.mapInArrow(run, f"{fields}, stamp_ns long, frame_id string, error string, points {POINT}")


def explode_points(clouds: DataFrame) -> DataFrame:
    rest = [c for c in clouds.columns if c not in ("points", "error")]
    return clouds.select(*rest, F.inline("points"))
