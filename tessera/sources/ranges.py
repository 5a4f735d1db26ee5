"""Parts of large binary files: a data source whose tasks read byte ranges.

A file's header tells where its main array lies; a box (a range of indices for
each axis) tells which cells are wanted.  A file has a partition for every
``part_bytes`` of its length, and each reads its share of the box's cells with
one read for a run of neighbours, so a file of any size is read by many tasks
and what lies outside of the box is not read at all (but for gaps of up to GAP
bytes, which cost less than a read of their own).  The driver only lists names and sizes.

With ``spark.sql.python.filterPushdown.enabled`` comparisons of axes with
constants in a ``where`` become the box; without it, ``read_cells`` takes one.
Files are opened by pyarrow's file systems, local or remote by URI.
"""

from __future__ import annotations

import fnmatch
import itertools
import posixpath
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from . import volumes
from .binary import DTYPES

#: Bytes of a file for each partition, of a read, and between runs that are read together; bytes of the first look at a header.
PART_BYTES, READ_BYTES, GAP, HEAD = 16 << 20, 4 << 20, 16 << 10, 1 << 16

#: The axes of the kinds that this module adds; ``raw`` arrays have i0, i1, ... .
AXES = {k: v for k, v in volumes.AXES.items() if k not in ("smp", "srf")} | {"nii": ("x", "y", "z", "t"), "stc": ("x", "y", "t")}


@dataclass(frozen=True)
class Slab:
    """Where a file's main array lies: number type, extents (the first runs fastest), first byte, and how stored numbers become values."""

    kind: np.dtype
    shape: tuple[int, ...]
    offset: int
    slope: float = 1.0
    intercept: float = 0.0


def _nifti(head: bytes) -> Slab:
    order = "<" if struct.unpack("<i", head[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", head[:4])[0] != 348:
        raise ValueError("not an uncompressed NIfTI-1 file")
    dim = struct.unpack(order + "8h", head[40:56])
    start, slope, intercept = struct.unpack(order + "3f", head[108:120])
    return Slab(np.dtype(order + DTYPES[struct.unpack(order + "h", head[70:72])[0]]), tuple(max(1, d) for d in dim[1:5]), int(start), slope or 1.0, intercept if slope else 0.0)


def locate(head: bytes, kind: str, size: int, options: dict | None = None) -> Slab:
    """The slab of a file of ``size`` bytes that begins with ``head``; IndexError or ValueError if the header goes on beyond it."""
    if kind == "nii":
        return _nifti(head)
    if kind == "raw":
        o = options or {}
        number = np.dtype(("<" if o.get("endian", "little") == "little" else ">") + o["type"])
        offset = int(o.get("offset", 0))
        shape = tuple(int(n) for n in o["shape"].split(",")) if "shape" in o else ((size - offset) // number.itemsize,)
        return Slab(number, shape, offset)
    if kind == "stc":
        rows, columns = struct.unpack("<2H", head[:4])
        return Slab(np.dtype("<u2"), (columns, rows, (size - 4) // (2 * rows * columns)), 4)
    fields = volumes.LAYOUTS[kind]
    before = tuple(itertools.takewhile(lambda f: f.name != "values", fields))
    known, at = volumes._read(head, 0, before, {})
    f = next(f for f in fields if f.name == "values" and f.when(known))
    return Slab(np.dtype("<" + f.kind), tuple(int(n) for n in f.shape(known)), at)


def _opened(path: str):
    fs, name = pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)
    return fs, name


def slab_of(file, kind: str, size: int, options: dict) -> Slab:
    look = HEAD
    while True:
        head = file.read_at(min(look, size), 0)
        try:
            return locate(head, kind, size, options)
        except (IndexError, ValueError, struct.error):
            if look >= size:
                raise
            look *= 8


def listed(path: str) -> list[tuple[str, int]]:
    """Files (as URIs or local names) and sizes: of one file, of a folder, or of a pattern in the last part of the path."""
    fs, name = _opened(path)
    folder, last = posixpath.split(name)
    prefix = path[: len(path) - len(name)]
    if any(c in last for c in "*?["):
        found = [f for f in fs.get_file_info(pafs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, last)]
    else:
        info = fs.get_file_info(name)
        found = fs.get_file_info(pafs.FileSelector(name)) if info.type == pafs.FileType.Directory else [info]
    return sorted((prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def runs(slab: Slab, low: tuple, size: tuple, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Cells begin:end of a box (in its own order) as runs of neighbours in the file: first cell in the box, its place in the file's array, and length."""
    whole = 0
    while whole < len(size) - 1 and size[whole] == slab.shape[whole]:
        whole += 1
    length = int(np.prod(size[: whole + 1], dtype=np.int64))
    strides = [int(np.prod(slab.shape[:i], dtype=np.int64)) for i in range(len(size))]
    while begin < end:
        r, inside = divmod(begin, length)
        place = inside + low[whole] * strides[whole]
        for axis in range(whole + 1, len(size)):
            r, i = divmod(r, size[axis])
            place += (low[axis] + i) * strides[axis]
        n = min(length - inside, end - begin)
        yield begin, place, n
        begin += n


def _reads(slab: Slab, found: Iterator[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Runs that are read together: neighbours with small gaps, READ_BYTES at most."""
    most, width, held = READ_BYTES // slab.kind.itemsize, slab.kind.itemsize, []
    for first, place, n in found:
        while n:
            cut = min(n, most)
            if held and (place < held[-1][1] or (place - held[-1][1] - held[-1][2]) * width > GAP or place + cut - held[0][1] > most):
                yield held
                held = []
            held.append((first, place, cut))
            first, place, n = first + cut, place + cut, n - cut
    if held:
        yield held


@dataclass
class _Part(ds.InputPartition):
    path: str
    size: int
    number: int
    of: int


class CellReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.kind = options, options["kind"]
        self.axes = axes_of(options)
        self.box = {a: (int(options.get(f"{a}.from", 0)), int(options[f"{a}.to"]) if f"{a}.to" in options else None) for a in self.axes}

    def partitions(self) -> list[_Part]:
        part = int(self.options.get("part_bytes", PART_BYTES))
        return [_Part(path, size, i, n) for path, size in listed(self.options["path"]) for n in [max(1, -(-size // part))] for i in range(n)]

    def _share(self, part: _Part, file) -> tuple[Slab, tuple, tuple, int, int]:
        slab = slab_of(file, self.kind, part.size, self.options)
        ends = [(max(0, self.box[a][0]), n if self.box[a][1] is None else min(n, self.box[a][1])) for a, n in zip(self.axes, slab.shape, strict=True)]
        low, size = tuple(e[0] for e in ends), tuple(max(0, e[1] - e[0]) for e in ends)
        cells = int(np.prod(size, dtype=np.int64))
        return slab, low, size, cells * part.number // part.of, cells * (part.number + 1) // part.of

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        fs, name = _opened(part.path)
        with fs.open_input_file(name) as file:
            slab, low, size, begin, end = self._share(part, file)
            width, bytes_read, reads = slab.kind.itemsize, 0, 0
            for group in _reads(slab, runs(slab, low, size, begin, end)):
                start, stop = group[0][1], group[-1][1] + group[-1][2]
                raw = file.read_at((stop - start) * width, slab.offset + start * width)
                if len(raw) < (stop - start) * width:
                    raise ValueError(f"{part.path} ends before its array")
                bytes_read, reads = bytes_read + len(raw), reads + 1
                if self.options.get("what") != "cells":
                    continue
                a = np.frombuffer(raw, slab.kind)
                value = np.concatenate([a[p - start : p - start + n] for _, p, n in group]).astype(float) * slab.slope + slab.intercept
                cell = np.concatenate([np.arange(f, f + n) for f, _, n in group])
                at = np.unravel_index(cell, size, order="F")
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(cell)), *(pa.array((x + lo).astype(np.int32)) for x, lo in zip(at, low, strict=True)), pa.array(value)], ["path", *self.axes, "value"])
        if self.options.get("what") != "cells":
            yield pa.RecordBatch.from_pydict({"path": [part.path], "part": pa.array([part.number], pa.int32()), "cells": [end - begin], "reads": [reads], "bytes": [bytes_read]})


class PushingReader(CellReader):
    """Takes comparisons of axes with whole numbers as bounds of the box."""

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for f in filters:
            axis = getattr(f, "attribute", ("",))
            value = getattr(f, "value", None)
            if isinstance(f, ds.IsNotNull) and len(axis) == 1 and axis[0] in self.box:
                continue  # axes are never null
            if len(axis) != 1 or axis[0] not in self.box or not isinstance(value, int) or isinstance(value, bool):
                yield f
                continue
            low, high = self.box[axis[0]]
            if isinstance(f, (ds.EqualTo, ds.GreaterThanOrEqual, ds.GreaterThan)):
                low = max(low, value + isinstance(f, ds.GreaterThan))
            if isinstance(f, (ds.EqualTo, ds.LessThanOrEqual, ds.LessThan)):
                to = value + (not isinstance(f, ds.LessThan))
                high = to if high is None else min(high, to)
            if not isinstance(f, (ds.EqualTo, ds.GreaterThanOrEqual, ds.GreaterThan, ds.LessThanOrEqual, ds.LessThan)):
                yield f
            self.box[axis[0]] = low, high


def axes_of(options: dict) -> tuple[str, ...]:
    return tuple(f"i{i}" for i in range(len(options["shape"].split(",")) if "shape" in options else 1)) if options["kind"] == "raw" else AXES[options["kind"]]


class CellSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_cells"

    def schema(self) -> str:
        if self.options.get("what") != "cells":
            return "path string, part int, cells long, reads long, bytes long"
        return "path string, " + ", ".join(f"{a} int" for a in axes_of(self.options)) + ", value double"

    def reader(self, schema) -> ds.DataSourceReader:
        return (PushingReader if self.options.get("push") == "true" else CellReader)(dict(self.options))


def _load(spark: SparkSession, path: str, kind: str, box: dict | None, what: str, **options) -> DataFrame:
    spark.dataSource.register(CellSource)
    push = what == "cells" and spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    bounds = {f"{a}.{e}": str(v) for a, ends in (box or {}).items() for e, v in zip(("from", "to"), ends, strict=True) if v is not None}
    unknown = set(box or {}) - set(axes_of({"kind": kind} | options))
    if unknown:
        raise ValueError(f"{kind} files have no axis {', '.join(sorted(unknown))}")
    return spark.read.format("tessera_cells").options(path=path, kind=kind, what=what, push=str(push).lower(), **bounds, **{k: str(v) for k, v in options.items()}).load()


def read_cells(spark: SparkSession, path: str, kind: str, box: dict[str, tuple[int | None, int | None]] | None = None, **options) -> DataFrame:
    """path, the axes (from 0) and value of the cells in ``box`` (axis -> from, to; the end is exclusive, None is open) of files of a kind.

    Kinds: msk, vtc, mtc, ssm, tsm, stc, vmp, nii, and ``raw`` arrays, whose
    options are ``type`` (a numpy name such as f4), ``shape`` (extents with
    commas, the first runs fastest), ``offset`` and ``endian`` (little or big).
    """
    return _load(spark, path, kind, box, "cells", **options)


def read_plan(spark: SparkSession, path: str, kind: str, box: dict[str, tuple[int | None, int | None]] | None = None, **options) -> DataFrame:
    """path, part, cells, reads and bytes of what ``read_cells`` reads in each task, headers aside; the bytes are read."""
    return _load(spark, path, kind, box, "plan", **options)


def write_cells(df: DataFrame, by: list[str], kind: str, header: Callable[[tuple, tuple], dict], shape: tuple[int, ...], folder: str) -> list[str]:
    """Writes a file of a kind for each group: the axes of the kind and ``value`` are columns, missing cells are 0, ``header(key, shape)`` gives the other fields.  Returns the paths; a file's array is built in one task."""
    axes = list(AXES[kind])

    def write(key, pdf):
        a = np.zeros(shape)
        a[tuple(pdf[c].to_numpy() for c in axes)] = pdf["value"]
        path = f"{folder}/{'-'.join(map(str, key))}.{kind}"
        fs, name = _opened(path)
        fs.create_dir(posixpath.dirname(name))
        with fs.open_output_stream(name) as out:
            out.write(volumes.build(header(key, shape) | {"values": a}, kind))
        return pd.DataFrame({"path": [path]})

    return [r.path for r in df.select(*by, *axes, "value").groupBy(*by).applyInPandas(write, "path string").collect()]
