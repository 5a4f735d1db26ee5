"""Binary volumes as DataFrames: the public NIfTI-1 format, and fixed-size records."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: NIfTI-1 data types
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def parse_nifti(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The scaled data (x, y, z, t) and the 4 x 4 frame of a NIfTI-1 file, gzipped or not."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", raw[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(order + "8h", raw[40:56])
    kind = struct.unpack(order + "h", raw[70:72])[0]
    start, slope, inter = struct.unpack(order + "3f", raw[108:120])
    shape = [max(1, d) for d in dim[1:5]]
    data = np.frombuffer(raw, np.dtype(order + DTYPES[kind]), int(np.prod(shape)), int(start)).reshape(shape, order="F").astype(float)
    if slope:
        data = data * slope + inter
    frame = np.eye(4)
    frame[:3] = np.array(struct.unpack(order + "12f", raw[280:328])).reshape(3, 4)
    return data, frame


def build_nifti(data: np.ndarray, frame: np.ndarray | None = None) -> bytes:
    """A little-endian float32 NIfTI-1 file."""
    data = np.atleast_3d(np.asarray(data, np.float32))
    shape = (*data.shape, *[1] * (4 - data.ndim))
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 4, *shape, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1, 1, 1, 1, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *(np.eye(4) if frame is None else frame)[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + data.tobytes(order="F")


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """path, t, x, y, z (0-based), value of every cell; a volume's slices come out one after another."""

    def run(it):
        for pdf in it:
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                data, _ = parse_nifti(raw)
                x, y = np.meshgrid(np.arange(data.shape[0]), np.arange(data.shape[1]), indexing="ij")
                for t in range(data.shape[3]):
                    for z in range(data.shape[2]):
                        yield pd.DataFrame({"path": file, "t": np.int32(t), "x": x.ravel().astype(np.int32), "y": y.ravel().astype(np.int32), "z": np.int32(z), "value": data[:, :, z, t].ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, t int, x int, y int, z int, value double")


def read_records(spark: SparkSession, path: str, fields: list[tuple[str, str]], skip: int = 0, swap: bool = False) -> DataFrame:
    """path, row and the fields (name, numpy type such as 'i4' or 'f8') of fixed-size records after a header of ``skip`` bytes."""
    kind = np.dtype([(n, (">" if swap else "<") + k) for n, k in fields])
    sql = {"i": "long", "u": "long", "f": "double"}
    schema = "path string, row long, " + ", ".join(f"{n} {sql[k[0]]}" for n, k in fields)

    def run(it):
        for pdf in it:
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                a = np.frombuffer(raw, kind, (len(raw) - skip) // kind.itemsize, skip)
                for i in range(0, a.size, 100_000):
                    b = a[i : i + 100_000]
                    yield pd.DataFrame({"path": file, "row": np.arange(i, i + b.size), **{n: b[n].astype("f8" if k[0] == "f" else "i8") for n, k in fields}})

    return spark.read.format("binaryFile").load(path).select(F.col("path"), "content").mapInPandas(run, schema)
