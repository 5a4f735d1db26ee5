"""Binary volumes, series, meshes and maps, read by a table of fields.

A layout lists the fields of a file in order: name, number type or ``text``
(ended by a zero byte), and where they are needed a shape and a condition, both
functions of the fields before.  One small reader and writer serve all kinds;
files are little-endian, and an array's first axis runs fastest.  Every file is
one row of a ``binaryFile`` scan and comes out as rows of its values in pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    shape: Callable[[dict], tuple] | None = None
    when: Callable[[dict], bool] = lambda h: True


@dataclass(frozen=True)
class Repeat:
    """Fields that come so many times; they are read as a list of dicts."""

    name: str
    count: Callable[[dict], int]
    fields: tuple


def _extent(h: dict) -> tuple:
    return tuple(int((h[f"{a}End"] - h[f"{a}Start"]) / h["Resolution"]) for a in "XYZ")


def _later(version: int) -> Callable[[dict], bool]:
    return lambda h: h["FileVersion"] > version


def _earlier(version: int) -> Callable[[dict], bool]:
    return lambda h: h["FileVersion"] < version


_BOX = tuple(Field(f"{a}{e}", "u2") for a in "XYZ" for e in ("Start", "End"))
_COUNT = "NrOfVertices"

# fixed values: the fields of each kind of file, in order
LAYOUTS: dict[str, tuple] = {
    "msk": (Field("Resolution", "u2"), *_BOX, Field("values", "u1", _extent)),
    "vtc": (
        Field("FileVersion", "u2"),
        Field("NameOfSourceFMR", "text"),
        Field("NrOfLinkedPRTs", "u2", when=_later(2)),
        Field("NameOfLinkedPRT", "text", lambda h: (h.get("NrOfLinkedPRTs", 1),), lambda h: h.get("NrOfLinkedPRTs", 1) > 0),
        Field("NrOfCurrentPRT", "u2", when=_later(2)),
        Field("DataType", "u2", when=_later(2)),
        Field("NrOfVolumes", "u2"),
        Field("Resolution", "u2"),
        *_BOX,
        Field("Convention", "u1", when=_later(2)),
        Field("ReferenceSpace", "u1", when=_later(2)),
        Field("HemodynamicDelay", "i2", when=_earlier(3)),
        Field("TR", "f4"),
        Field("HrfDelta", "f4", when=_earlier(3)),
        Field("HrfTau", "f4", when=_earlier(3)),
        Field("SegmentSize", "u2", when=_earlier(3)),
        Field("SegmentOffset", "i2", when=_earlier(3)),
        Field("values", "u2", lambda h: (h["NrOfVolumes"], *_extent(h)), lambda h: h.get("DataType", 1) == 1),
        Field("values", "f4", lambda h: (h["NrOfVolumes"], *_extent(h)), lambda h: h.get("DataType", 1) == 2),
    ),
    "mtc": (
        Field("FileVersion", "u4"),
        Field(_COUNT, "u4"),
        Field("NrOfTimePoints", "u4"),
        Field("SourceVTCFile", "text"),
        Field("LinkedPRTFile", "text"),
        Field("HemodynamicDelay", "u4"),
        Field("TR", "f4"),
        Field("HRFDelta", "f4"),
        Field("HRFTau", "f4"),
        Field("ProtocolSegmentSize", "u4"),
        Field("ProtocolSegmentOffset", "u4"),
        Field("MTCDataType", "u1"),
        Field("values", "f4", lambda h: (h["NrOfTimePoints"], h[_COUNT]), lambda h: h["MTCDataType"] == 1),
    ),
    "ssm": (Field("FileVersion", "u2"), Field("NrOfTargetVertices", "u4"), Field("NrOfSourceVertices", "u4", when=_later(1)), Field("values", "u4", lambda h: (h["NrOfTargetVertices"],))),
    "tsm": (
        Field("FileVersion", "u2"),
        Field("NrOfTargetVertices", "u4"),
        Field("NrOfSourceVertices", "u4"),
        Field("NrOfSourceTriangles", "u4"),
        Field("values", "u4", lambda h: (h["NrOfTargetVertices"],)),
        Field("TriangleEdgeLengths", "f4", lambda h: (2, h["NrOfTargetVertices"])),
    ),
    "srf": (
        Field("FileVersion", "f4"),
        Field("ExtendedNeighbors", "i4"),
        Field(_COUNT, "u4"),
        Field("NrOfTriangles", "u4"),
        Field("MeshCenter", "f4", lambda h: (3,)),
        Field("values", "f4", lambda h: (h[_COUNT], 3)),
        Field("VertexNormal", "f4", lambda h: (h[_COUNT], 3)),
        Field("ConvexRGBA", "f4", lambda h: (4,)),
        Field("ConcaveRGBA", "f4", lambda h: (4,)),
        Field("VertexColor", "u4", lambda h: (h[_COUNT],)),
        Repeat("Neighbors", lambda h: h[_COUNT], (Field("n", "u4"), Field("list", "u4", lambda h: (h["n"],)))),
        Field("TriangleVertex", "u4", lambda h: (3, h["NrOfTriangles"])),
    ),
    "smp": (
        Field("FileVersion", "u2"),
        Field(_COUNT, "u4"),
        Field("NrOfMaps", "u2"),
        Field("NameOfOriginalSRF", "text"),
        Repeat(
            "Map",
            lambda h: h["NrOfMaps"],
            (
                Field("Type", "u4"),
                *(Field(n, k, when=lambda h: h["Type"] == 3) for n, k in (("NrOfLags", "u4"), ("MinLag", "u4"), ("MaxLag", "u4"), ("CCOverlay", "i4"))),
                Field("ClusterSize", "u4"),
                Field("EnableClusterCheck", "u1"),
                Field("LowerThreshold", "f4"),
                Field("UpperThreshold", "f4"),
                Field("UseValuesAboveThresh", "u4", when=_later(3)),
                Field("DF1", "u4"),
                Field("DF2", "u4"),
                Field("ShowPositiveNegativeFlag", "u4", when=_later(4)),
                Field("BonferroniValue", "u4"),
                Field("RGBLowerThreshPos", "u1", lambda h: (3,)),
                Field("RGBUpperThreshPos", "u1", lambda h: (3,)),
                Field("RGBLowerThreshNeg", "u1", lambda h: (3,), _later(3)),
                Field("RGBUpperThreshNeg", "u1", lambda h: (3,), _later(3)),
                Field("UseRGBColor", "u1"),
                Field("LUTName", "text", when=_later(4)),
                Field("TransColorFactor", "f4"),
                Field("Name", "text"),
                Field("values", "f4", lambda h: (h[_COUNT],)),
            ),
        ),
    ),
    "vmp": (
        Field("mark", "u1", lambda h: (4,)),
        Field("version", "u2"),
        Field("document", "u2"),
        *(Field(n, "u4") for n in ("maps", "times", "parameters", "shown_from", "shown_to", "print_from", "print_to")),
        *(Field(f"{a}_{e}", "u4") for a in "xyz" for e in ("from", "to")),
        *(Field(n, "u4") for n in ("step", "anatomy_x", "anatomy_y", "anatomy_z")),
        *(Field(n, "text") for n in ("series_file", "protocol_file", "region_file")),
        Repeat(
            "map",
            lambda h: h["maps"],
            (
                Field("kind", "u4"),
                Field("low", "f4"),
                Field("high", "f4"),
                Field("name", "text"),
                *(Field(n, "u1", lambda h: (3,)) for n in ("low_colour", "high_colour", "negative_low_colour", "negative_high_colour")),
                Field("coloured", "u1"),
                Field("palette", "text", when=lambda h: h["version"] > 5),
                Field("opacity", "f4"),
                *(Field(n, k, when=lambda h: h["kind"] == 3) for n, k in (("lags", "u4"), ("first_lag", "u4"), ("last_lag", "u4"), ("overlay", "i4"))),
                Field("cluster", "u4"),
                Field("clustered", "u1"),
                *(Field(n, "u4") for n in ("above", "df1", "df2")),
                Field("signs", "u1"),
                Field("tests", "u4"),
                Field("levels", "u4"),
                Field("level_values", "f4", lambda h: (3, h["levels"]), lambda h: h["levels"] > 0),
                Field("unknown", "i4"),
            ),
        ),
        Field("time_values", "f4", lambda h: (h["times"], h["maps"]), lambda h: h["times"] > 0),
        Repeat("parameter", lambda h: h["parameters"], (Field("name", "text"),)),
        Field("parameter_values", "f4", lambda h: (h["parameters"], h["maps"]), lambda h: h["parameters"] > 0),
        Field("values", "f4", lambda h: (*[(h[f"{a}_to"] - h[f"{a}_from"]) // h["step"] for a in "xyz"], h["maps"])),
    ),
}

#: The axes of ``values``, the one that runs fastest first.
AXES = {"msk": ("x", "y", "z"), "vtc": ("t", "x", "y", "z"), "mtc": ("t", "vertex"), "ssm": ("vertex",), "tsm": ("vertex",), "srf": ("vertex", "axis"), "smp": ("vertex",), "vmp": ("x", "y", "z", "map")}
PIECE = 1 << 18


def _read(raw: bytes, at: int, fields: tuple, known: dict) -> tuple[dict, int]:
    out: dict = {}
    for f in fields:
        seen = known | out
        if isinstance(f, Repeat):
            items = []
            for _ in range(int(f.count(seen))):
                item, at = _read(raw, at, f.fields, seen)
                items.append(item)
            out[f.name] = items
        elif f.when(seen):
            shape = f.shape(seen) if f.shape else None
            if f.kind == "text":
                texts = []
                for _ in range(int(shape[0]) if shape else 1):
                    end = raw.index(b"\0", at)
                    texts.append(raw[at:end].decode("latin-1"))
                    at = end + 1
                out[f.name] = texts if shape else texts[0]
            else:
                kind = np.dtype("<" + f.kind)
                n = int(np.prod(shape)) if shape else 1
                a = np.frombuffer(raw, kind, n, at)
                at += n * kind.itemsize
                out[f.name] = a.reshape([int(s) for s in shape], order="F") if shape else a[0].item()
    return out, at


def parse(raw: bytes, kind: str) -> dict:
    """The fields of a file's bytes; what follows them is left out."""
    return _read(raw, 0, LAYOUTS[kind], {})[0]


def _write(fields: tuple, values: dict, known: dict) -> Iterator[bytes]:
    seen = known | values
    for f in fields:
        if isinstance(f, Repeat):
            for item in values[f.name]:
                yield from _write(f.fields, item, seen)
        elif f.when(seen):
            v = values[f.name]
            if f.kind == "text":
                yield b"".join(t.encode("latin-1") + b"\0" for t in ([v] if isinstance(v, str) else v))
            else:
                yield np.asarray(v, "<" + f.kind).tobytes(order="F")


def build(values: dict, kind: str) -> bytes:
    """The bytes of a file with these fields."""
    return b"".join(_write(LAYOUTS[kind], values, {}))


def _rows(path: str, a: np.ndarray, axes: tuple, **more) -> Iterator[pd.DataFrame]:
    flat = a.ravel(order="F")
    for i in range(0, flat.size, PIECE):
        at = np.unravel_index(np.arange(i, min(i + PIECE, flat.size)), a.shape, order="F")
        yield pd.DataFrame({"path": path, **more, **{n: x.astype(np.int32) for n, x in zip(axes, at, strict=True)}, "value": flat[i : i + PIECE].astype(float)})


def read_grid(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path, the axes of the kind (from 0) and value for every cell of the files' main array; maps (smp) also have map and name."""
    maps = kind == "smp"
    axes = AXES[kind]

    def run(it):
        for pdf in it:
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                found = parse(raw, kind)
                if maps:
                    for i, m in enumerate(found["Map"], 1):
                        yield from _rows(file, m["values"], axes, map=np.int32(i), name=m["Name"])
                else:
                    yield from _rows(file, found["values"], axes)

    schema = "path string, " + ("map int, name string, " if maps else "") + ", ".join(f"{a} int" for a in axes) + ", value double"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_triangles(spark: SparkSession, path: str) -> DataFrame:
    """path, triangle, a, b, c (vertices from 0) of mesh files."""

    def run(it):
        for pdf in it:
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                v = parse(raw, "srf")["TriangleVertex"]
                for i in range(0, v.shape[1], PIECE):
                    p = v[:, i : i + PIECE].astype(np.int32)
                    yield pd.DataFrame({"path": file, "triangle": np.arange(i, i + p.shape[1], dtype=np.int32), "a": p[0], "b": p[1], "c": p[2]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, triangle int, a int, b int, c int")


def read_headers(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path, field and value (as text) of every single-valued field of the files."""

    def run(it):
        for pdf in it:
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                found = {k: v for k, v in parse(raw, kind).items() if isinstance(v, (str, int, float))}
                yield pd.DataFrame({"path": file, "field": list(found), "value": [str(v) for v in found.values()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, field string, value string")
