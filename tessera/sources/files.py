"""Files of other kinds: listings, marked text tables, key-value logs, tar archives and packet captures."""

from __future__ import annotations

import io
import struct
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def find_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, length, modified of the files under a path; only the listing is read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return d.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def read_table(spark: SparkSession, path: str, sep: str = ",", start: str | None = None, stop: str | None = None, replace: dict[str, str] | None = None) -> DataFrame:
    """path, row, cells: the split lines of text files, from the line after one that holds ``start`` to the one before ``stop``, after literal replacements."""

    def run(it):
        for pdf in it:
            for file, text in zip(pdf["path"], pdf["value"], strict=True):
                lines = text.replace("\r\n", "\n").split("\n")
                a = next((i + 1 for i, x in enumerate(lines) if start in x), len(lines)) if start else 0
                b = next((i for i, x in enumerate(lines[a:], a) if stop in x), len(lines)) if stop else len(lines)
                rows = []
                for line in lines[a:b]:
                    for old, new in (replace or {}).items():
                        line = line.replace(old, new)
                    if line.strip():
                        rows.append((file, len(rows) + 1, [c.strip() for c in line.split(sep)]))
                yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, "path string, row int, cells array<string>")


def read_log_frames(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, level, values (map): the ``Key: value`` frames between start and end marker lines of a text log."""

    def run(it):
        for pdf in it:
            for file, text in zip(pdf["path"], pdf["value"], strict=True):
                rows, own, level, n = [], None, 1, 0
                for line in text.replace("\r\n", "\n").split("\n"):
                    s = line.strip()
                    if s.startswith("***") and "Start" in s:
                        own = {}
                    elif s.startswith("***") and "End" in s:
                        if own is not None:
                            n += 1
                            rows.append((file, n, level, own))
                        own = None
                    elif ":" in s:
                        k, _, v = s.partition(":")
                        if k == "Level" and v.strip().isdigit():
                            level = int(v)
                        elif own is not None:
                            own[k.strip()] = v.strip()
                yield pd.DataFrame(rows, columns=["path", "frame", "level", "values"])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, "path string, frame int, level int, values map<string,string>")


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """path, member, content of the files in tar archives (compressed or not)."""

    def run(it):
        for pdf in it:
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                    for m in tar:
                        if m.isfile():
                            yield pd.DataFrame({"path": [file], "member": [m.name], "content": [tar.extractfile(m).read()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, content binary")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """path, number, ts, length, data of the packets of capture files (the public libpcap format)."""

    def run(it):
        for pdf in it:
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                order = "<" if raw[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
                unit = 1e9 if raw[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1e6
                rows, at = [], 24
                while at + 16 <= len(raw):
                    sec, part, kept, length = struct.unpack(order + "4I", raw[at : at + 16])
                    rows.append((file, len(rows) + 1, sec + part / unit, length, raw[at + 16 : at + 16 + kept]))
                    at += 16 + kept
                yield pd.DataFrame(rows, columns=["path", "number", "ts", "length", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, number int, ts double, length long, data binary")


def swap_bytes(spark: SparkSession, path: str, word: int, skip: int = 0) -> DataFrame:
    """path, content: files with the bytes of every word of that size turned round after ``skip`` bytes."""

    def run(it):
        for pdf in it:
            out = []
            for raw in pdf["content"]:
                body = raw[skip:]
                whole = len(body) // word * word
                parts = bytearray(body)
                for k in range(word):
                    parts[k:whole:word] = body[word - 1 - k : whole : word]
                out.append(raw[:skip] + bytes(parts))
            yield pd.DataFrame({"path": pdf["path"], "content": out})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, content binary")


def write_files(df: DataFrame, folder: str, name: str = "name", value: str = "value") -> int:
    """Writes the text of every row below a partition folder of its ``name``, in the task that holds the row and to any store that Spark reaches; gives the number of rows."""
    d = df.select(F.col(name).alias("_name"), F.col(value).cast("string").alias("value"))
    d.write.mode("append").partitionBy("_name").text(folder)
    return df.count()
