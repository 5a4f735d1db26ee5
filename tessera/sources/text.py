"""Text formats of protocols, designs, regions and point tables as DataFrames, and their writers.

A file is read whole by Spark's text reader, so any store that Spark reaches
will do; a file's rows are parsed in the task that holds it.  Every reader
keeps the file's path.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTED = re.compile(r'"([^"]*)"|(\S+)')


def _lines(text: str) -> list[str]:
    return [line.strip() for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if line.strip()]


def _header(line: str) -> tuple[str, str]:
    name, _, value = line.partition(":")
    return name.strip(), value.strip()


def _read(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it):
        for pdf in it:
            for file, text in zip(pdf["path"], pdf["value"], strict=True):
                rows = parse(text)
                yield pd.DataFrame([(file, *r) for r in rows], columns=["path", *names])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(run, f"path string, {schema}")


def parse_protocol(text: str) -> list[tuple]:
    """(condition, number, onset, offset, weights) of every interval of a protocol file."""
    lines, i, head = _lines(text), 0, {}
    while i < len(lines) and "NrOfConditions" not in head:
        k, v = _header(lines[i])
        head[k] = v
        i += 1
    out = []
    for _ in range(int(float(head.get("NrOfConditions", 0)))):
        if i + 1 >= len(lines):
            break
        name, n = lines[i], int(float(lines[i + 1]))
        i += 2
        for j in range(n):
            v = [float(x) for x in lines[i + j].split()]
            out.append((name, j + 1, v[0], v[1], v[2:]))
        i += n
        if i < len(lines) and lines[i].startswith("Color"):
            i += 1
    return out


def read_protocols(spark: SparkSession, path: str) -> DataFrame:
    """path, condition, number, onset, offset, weights."""
    return _read(spark, path, parse_protocol, "condition string, number int, onset double, offset double, weights array<double>")


def parse_design(text: str) -> list[tuple]:
    """(t, predictor, value) of every cell of a design-matrix file."""
    lines = _lines(text)
    first = next(i for i, line in enumerate(lines) if line.startswith('"'))
    names = [a or b for a, b in _QUOTED.findall(lines[first])]
    return [(t, n, float(v)) for t, line in enumerate(lines[first + 1 :], 1) for n, v in zip(names, line.split(), strict=False)]


def read_designs(spark: SparkSession, path: str) -> DataFrame:
    """path, t, predictor, value."""
    return _read(spark, path, parse_design, "t int, predictor string, value double")


def parse_regions(text: str) -> list[tuple]:
    """(region, x, y, z) of every voxel of a region file."""
    lines, out, i, name = _lines(text), [], 0, None
    while i < len(lines):
        k, v = _header(lines[i])
        i += 1
        if k == "NameOfVOI":
            name = v
        elif k == "NrOfVoxels":
            for line in lines[i : i + int(v)]:
                out.append((name, *(int(float(x)) for x in line.split()[:3])))
            i += int(v)
    return out


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """path, region, x, y, z."""
    return _read(spark, path, parse_regions, "region string, x int, y int, z int")


def parse_points(text: str) -> list[tuple]:
    """(point, column, value, label) of every cell of a point table; a Label, Study, Software or Correction cell is decoded by the file's label list."""
    lines, head, i = _lines(text), {}, 0
    while i < len(lines) and not lines[i].startswith('"'):
        k, v = _header(lines[i])
        head[k] = int(float(v)) if v.replace(".", "").isdigit() else v
        i += 1
    names = [a or b for a, b in _QUOTED.findall(lines[i])]
    i += 1
    n = int(head.get("NrOfPlottingPoints", 0))
    points = [[float(x) for x in line.split()] for line in lines[i : i + n]]
    i += n + int(head.get("NrOfColors", 0))
    i += bool(head.get("NrOfGroupIDs", 0))
    labels = [a or b for a, b in _QUOTED.findall(lines[i])] if head.get("NrOfLabels", 0) and i < len(lines) else []
    out = []
    for p, row in enumerate(points, 1):
        for c, v in zip(names, row, strict=False):
            k = int(v) if c in ("Label", "Study", "Software", "Correction", "Group") and v == int(v) else 0
            out.append((p, c, v, labels[k - 1] if 0 < k <= len(labels) else None))
    return out


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """path, point, column, value, label."""
    return _read(spark, path, parse_points, "point int, column string, value double, label string")


def wide_points(cells: DataFrame, columns: list[str]) -> DataFrame:
    """A row a point: the named columns, decoded where a label exists."""
    texts = {"Label", "Study", "Software", "Correction", "Group"} & set(columns)
    cell = lambda c: F.first(F.when(F.col("column") == c, F.coalesce("label", F.col("value").cast("string")) if c in texts else F.col("value")), ignorenulls=True).alias(c)
    return cells.groupBy("path", "point").agg(*[cell(c) for c in columns])


def parse_study_list(text: str) -> list[tuple]:
    """(study, series, design) of a study list: two quoted files a line."""
    out = []
    for line in _lines(text):
        f = re.findall(r'"([^"]+)"', line)
        if len(f) >= 2:
            out.append((len(out) + 1, f[-2], f[-1]))
    return out


def read_study_lists(spark: SparkSession, path: str) -> DataFrame:
    """path, study, series, design."""
    return _read(spark, path, parse_study_list, "study int, series string, design string")


def parse_sparse(text: str) -> list[tuple]:
    """(row, label, features) of ``label index:value ...`` lines."""
    out = []
    for i, line in enumerate(_lines(text), 1):
        label, *cells = line.split()
        out.append((i, float(label), {int(k): float(v) for k, v in (c.split(":") for c in cells)}))
    return out


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """path, row, label, features (map)."""
    return _read(spark, path, parse_sparse, "row int, label double, features map<int,double>")


def _join(parts, sep="\n"):
    return F.array_join(parts, sep)


def protocol_text(events: DataFrame, by: list[str], condition: str = "condition", onset: str = "onset", offset: str = "offset") -> DataFrame:
    """by and ``value``: the protocol file of every group of events."""
    line = F.concat(F.lpad(F.format_string("%.0f", F.col(onset)), 7, " "), F.lit(" "), F.lpad(F.format_string("%.0f", F.col(offset)), 7, " "))
    c = events.groupBy(*by, condition).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(onset).alias("a"), F.col(offset).alias("b"), line.alias("l")))).alias("s"))
    c = c.withColumn("block", F.concat(F.col(condition), F.lit("\n"), F.col("n").cast("string"), F.lit("\n"), _join(F.col("s.l")), F.lit("\nColor: 255 255 255\n")))
    p = c.groupBy(*by).agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct(F.col(condition).alias("c"), "block"))).alias("s"))
    head = F.lit("\nFileVersion:        2\n\nResolutionOfTime:   msec\n\nExperiment:         Unknown\n\nNrOfConditions:  ")
    return p.select(*by, F.concat(head, F.col("k").cast("string"), F.lit("\n\n"), _join(F.col("s.block"))).alias("value"))


def design_text(design: DataFrame, by: list[str]) -> DataFrame:
    """by and ``value``: the design-matrix file of every group of (t, predictor, value) cells."""
    rows = design.groupBy(*by, "t").agg(F.array_sort(F.collect_list(F.struct("predictor", "value"))).alias("s"))
    rows = rows.withColumn("line", _join(F.transform("s", lambda x: F.format_string("%.6f", x["value"])), " ")).withColumn("names", _join(F.transform("s", lambda x: F.concat(F.lit('"'), x["predictor"], F.lit('"'))), " "))
    p = rows.groupBy(*by).agg(F.first("names").alias("names"), F.max(F.size("s")).alias("k"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("t", "line"))).alias("s"))
    head = F.format_string("FileVersion:            1\n\nNrOfPredictors:         %d\nNrOfDataPoints:         %d\nIncludesConstant:       0\nFirstConfoundPredictor: %d\n\n", "k", "n", "k")
    return p.select(*by, F.concat(head, "names", F.lit("\n"), _join(F.col("s.line")), F.lit("\n")).alias("value"))


def region_text(members: DataFrame, by: list[str]) -> DataFrame:
    """by and ``value``: the region file of every group of (region, x, y, z) voxels."""
    r = members.groupBy(*by, "region").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("x", "y", "z"))).alias("s"))
    voxels = _join(F.transform("s", lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string"), v["z"].cast("string"))))
    r = r.withColumn("block", F.concat(F.lit("\nNameOfVOI:  "), "region", F.lit("\nColorOfVOI: 255 0 0\n\nNrOfVoxels: "), F.col("n").cast("string"), F.lit("\n"), voxels, F.lit("\n")))
    p = r.groupBy(*by).agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct("region", "block"))).alias("s"))
    return p.select(*by, F.concat(F.lit("\nFileVersion:  2\n\nCoordsType:  TAL\n\nNrOfVOIs:  "), F.col("k").cast("string"), F.lit("\n"), _join(F.col("s.block"), ""), F.lit("\n\nNrOfVOIVTCs:  0\n")).alias("value"))
