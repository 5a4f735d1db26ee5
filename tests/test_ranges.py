"""Byte ranges of large files equal the plain reader, cell by cell, and read no more than they need."""

import re

import numpy as np
import pytest
from test_sources import _volume_files

from tessera.sources import binary as B
from tessera.sources import ranges as R
from tessera.sources import volumes as V


def cells(df, axes):
    return {(*(r[a] for a in axes),): r.value for r in df.collect()}


def in_box(a, axes, box):
    return {i: float(v) for i, v in np.ndenumerate(a) if all(lo <= i[axes.index(x)] < (hi or 10**9) for x, (lo, hi) in box.items())}


def vmp(rng):
    one = {"kind": 1, "low": 1.5, "high": 3.0, "low_colour": [1, 2, 3], "high_colour": [4, 5, 6], "negative_low_colour": [7, 8, 9], "negative_high_colour": [1, 1, 1], "coloured": 0, "palette": "<default>", "opacity": 1.0, "cluster": 4, "clustered": 1, "above": 1, "df1": 20, "df2": 1, "signs": 3, "tests": 5, "unknown": 0}
    maps = [{**one, "name": "first " + "x" * 90_000, "levels": 0}, {**one, "kind": 3, "lags": 2, "first_lag": 0, "last_lag": 1, "overlay": -1, "name": "second", "levels": 2, "level_values": rng.random((3, 2))}]
    box = {"x_from": 57, "x_to": 72, "y_from": 52, "y_to": 64, "z_from": 59, "z_to": 68, "step": 3, "anatomy_x": 256, "anatomy_y": 256, "anatomy_z": 256}
    head = {"mark": [212, 195, 178, 161], "version": 6, "document": 1, "maps": 2, "times": 3, "parameters": 1, "shown_from": 0, "shown_to": 0, "print_from": 0, "print_to": 0, **box, "series_file": "a.vtc", "protocol_file": "", "region_file": ""}
    return {**head, "map": maps, "time_values": rng.random((3, 2)), "parameter": [{"name": "p"}], "parameter_values": [[1.0, 2.0]], "values": rng.random((5, 4, 3, 2)).astype("f4")}


def test_kinds_and_boxes_equal_the_plain_reader(spark, tmp_path):
    rng = np.random.default_rng(9)
    files = {k: v for k, v in _volume_files().items() if k[:3] in R.AXES} | {"vmp": vmp(rng)}
    for name, fields in files.items():
        kind, axes = name[:3], list(R.AXES[name[:3]])
        (tmp_path / name).mkdir()
        raw = V.build(fields, kind) + b"more"
        (tmp_path / name / f"a.{kind}").write_bytes(raw)
        plain = cells(V.read_grid(spark, str(tmp_path / name), kind), axes)
        a = np.asarray(fields["values"])
        for box in ({axes[0]: (1, 2)}, {axes[-1]: (1, None)}, {x: (0, max(1, n - 1)) for x, n in zip(axes, a.shape, strict=True)}):
            got = cells(R.read_cells(spark, str(tmp_path / name), kind, box, part_bytes=len(raw) // 3), axes)
            assert got == {k: v for k, v in plain.items() if k in in_box(a, axes, box)}, (name, box)
    data = rng.random((3, 4, 5)).astype("f4")
    (tmp_path / "n.nii").write_bytes(B.build_nifti(data))
    assert cells(R.read_cells(spark, str(tmp_path / "n.nii"), "nii", {"y": (1, 3)}), "xyz") == {(x, y, z): float(data[x, y, z]) for x in range(3) for y in (1, 2) for z in range(5)}
    stc = rng.integers(0, 999, (4, 3, 6)).astype("<u2")
    (tmp_path / "s.stc").write_bytes(np.array([3, 4], "<u2").tobytes() + stc.tobytes(order="F"))
    assert cells(R.read_cells(spark, f"file://{tmp_path}/s.stc", "stc", {"t": (2, 4)}), "xyt") == in_box(stc, ["x", "y", "t"], {"t": (2, 4)})


def test_raw_arrays_of_many_files(spark, tmp_path):
    a = np.arange(7 * 5 * 4, dtype=">i4").reshape(7, 5, 4)
    for i in range(3):
        (tmp_path / f"part-{i}.bin").write_bytes(b"headhead" + (a + i).astype(">i4").tobytes(order="F"))
    (tmp_path / "other.txt").write_text("x")
    d = R.read_cells(spark, f"{tmp_path}/part-*.bin", "raw", {"i1": (1, 4), "i2": (2, 3)}, type="i4", shape="7,5,4", offset=8, endian="big", part_bytes=100)
    got = {(r.path[-5], r.i0, r.i1, r.i2): r.value for r in d.collect()}
    assert got == {(str(i), x, y, 2): float(a[x, y, 2] + i) for i in range(3) for x in range(7) for y in (1, 2, 3)}
    assert R.read_cells(spark, f"{tmp_path}/part-0.bin", "raw", type="u1").count() == 568
    with pytest.raises(ValueError, match="no axis"):
        R.read_cells(spark, str(tmp_path), "vtc", {"w": (0, 1)})


def big(tmp_path):
    a = np.arange(200 * 50 * 40 * 10, dtype="<f4")  # 16 MB
    (tmp_path / "big.bin").write_bytes(a.tobytes())
    return str(tmp_path / "big.bin"), {"type": "f4", "shape": "200,50,40,10"}


def test_one_file_is_read_by_many_tasks_and_only_in_part(spark, tmp_path):
    path, options = big(tmp_path)
    d = R.read_cells(spark, path, "raw", **options, part_bytes=1 << 20)
    assert d.rdd.getNumPartitions() == 16
    plan = R.read_plan(spark, path, "raw", **options, part_bytes=1 << 20).collect()
    assert sum(r.bytes for r in plan) == 16_000_000 and max(r.bytes for r in plan) <= 1_000_000
    box = {"i2": (3, 5), "i3": (2, 3)}  # neighbours in the file
    assert [r.bytes for r in R.read_plan(spark, path, "raw", box, **options).collect()] == [2 * 200 * 50 * 4]
    series = {"i0": (0, 200), "i1": (7, 8), "i2": (0, 1), "i3": (0, 10)}  # ten runs far apart
    plan = R.read_plan(spark, path, "raw", series, **options).collect()
    assert (sum(r.bytes for r in plan), sum(r.reads for r in plan)) == (10 * 200 * 4, 10)


def test_filters_become_the_box(spark, tmp_path):
    path, options = big(tmp_path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        d = R.read_cells(spark, path, "raw", **options).where("i3 = 4 and i2 >= 10 and i2 < 12 and i1 > 48 and value > 0")
        assert sorted(r.value for r in d.collect()) == [float(x + 200 * (49 + 50 * (z + 40 * 4))) for z in (10, 11) for x in range(200)]
        assert not re.search(r"Filter .*i[0-3]#", d._jdf.queryExecution().executedPlan().toString())  # only the value is left to Spark
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert R.read_cells(spark, path, "raw", **options).where("i3 = 4 and i0 = 1").count() == 50 * 40


def test_a_file_that_ends_early_is_an_error(spark, tmp_path):
    (tmp_path / "short.bin").write_bytes(b"x" * 10)
    with pytest.raises(Exception, match="ends before"):
        R.read_cells(spark, str(tmp_path / "short.bin"), "raw", type="u1", shape="20").collect()
