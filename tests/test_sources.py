"""Text and binary formats: exact round trips."""

import numpy as np
from pyspark.sql import functions as F

from tessera.sources import binary as B
from tessera.sources import text as T


def put(folder, df, name):
    for i, r in enumerate(df.collect()):
        (folder / f"{i}-{name}").write_text(r["value"])
    return str(folder)


def test_protocol(spark, tmp_path):
    d = spark.createDataFrame([(1, "go", 100.0, 200.0), (1, "go", 300.0, 400.0), (1, "stop", 50.0, 60.0)], "run int, condition string, onset double, offset double")
    got = T.read_protocols(spark, put(tmp_path, T.protocol_text(d, ["run"]), "a.prt")).orderBy("condition", "number").collect()
    assert [(r.condition, r.number, r.onset, r.offset) for r in got] == [("go", 1, 100, 200), ("go", 2, 300, 400), ("stop", 1, 50, 60)]


def test_weighted_protocol():
    text = "\nFileVersion: 3\nResolutionOfTime: msec\nExperiment: x\nParametricWeights: 1\nNrOfConditions: 1\n\ncue\n2\n 10 20 0.5\n 30 40 1.5\nColor: 1 2 3\n"
    assert T.parse_protocol(text) == [("cue", 1, 10, 20, [0.5]), ("cue", 2, 30, 40, [1.5])]


def test_design(spark, tmp_path):
    d = spark.createDataFrame([(1, t, p, float(t * len(p))) for t in (1, 2, 3) for p in ("a b", "c")], "run int, t int, predictor string, value double")
    got = T.read_designs(spark, put(tmp_path, T.design_text(d, ["run"]), "a.sdm")).orderBy("t", "predictor").collect()
    assert [(r.t, r.predictor, r.value) for r in got] == [(t, p, float(t * len(p))) for t in (1, 2, 3) for p in ("a b", "c")]


def test_regions(spark, tmp_path):
    rows = [("left", 1, 2, 3), ("left", -1, 0, 5), ("right", 7, 8, 9)]
    d = spark.createDataFrame(rows, "region string, x int, y int, z int").withColumn("g", F.lit(1))
    got = T.read_regions(spark, put(tmp_path, T.region_text(d, ["g"]), "a.voi")).collect()
    assert sorted((r.region, r.x, r.y, r.z) for r in got) == sorted(rows)


def test_points(spark, tmp_path):
    (tmp_path / "a.plp").write_text('\nFileVersion: 1\n\nNrOfPlottingPoints: 2\nNrOfPlottingGroups: 1\nNrOfColumns: 3\nNrOfColors: 1\nNrOfGroupIDs: 0\nNrOfLabels: 2\nNrOfSymbols: 0\n\n"X" "Value" "Label"\n\n 1 2.5 2\n -4 0 1\n\n255 0 0\n\n"one" "two words"\n')
    d = T.wide_points(T.read_points(spark, str(tmp_path)), ["X", "Value", "Label"])
    assert [(r.X, r.Value, r.Label) for r in d.orderBy("point").collect()] == [(1, 2.5, "two words"), (-4, 0, "one")]


def test_study_list_and_sparse(spark, tmp_path):
    assert T.parse_study_list('NrOfStudies: 1\n"a/run1.vtc" "a/run1.sdm"\n') == [(1, "a/run1.vtc", "a/run1.sdm")]
    (tmp_path / "s").write_text("+1 1:0.5 3:2\n-1 2:1\n")
    got = T.read_sparse(spark, str(tmp_path / "s")).orderBy("row").collect()
    assert [(r.label, r.features) for r in got] == [(1.0, {1: 0.5, 3: 2.0}), (-1.0, {2: 1.0})]


def test_volume(spark, tmp_path):
    data = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    (tmp_path / "a.nii").write_bytes(B.build_nifti(data))
    got = B.read_volumes(spark, str(tmp_path)).collect()
    assert len(got) == 24 and all(r.value == data[r.x, r.y, r.z] for r in got)


def test_records(spark, tmp_path):
    kind = np.dtype([("a", ">i4"), ("b", ">f8")])
    (tmp_path / "r.bin").write_bytes(b"head" + np.array([(1, 0.5), (2, 1.5)], kind).tobytes())
    got = B.read_records(spark, str(tmp_path), [("a", "i4"), ("b", "f8")], 4, True).orderBy("row").collect()
    assert [(r.a, r.b) for r in got] == [(1, 0.5), (2, 1.5)]


def test_other_files(spark, tmp_path):
    import io
    import struct
    import tarfile

    from tessera.sources import files as S

    (tmp_path / "a.txt").write_text("skip\nBEGIN\n1, x\n\n2; y\nEND\n3, z\n")
    assert [(r.row, r.cells) for r in S.read_table(spark, str(tmp_path / "a.txt"), ",", "BEGIN", "END", {";": ","}).collect()] == [(1, ["1", "x"]), (2, ["2", "y"])]
    (tmp_path / "b.log").write_text("*** Header Start ***\nSubject: 7\n*** Header End ***\nLevel: 3\n\t*** LogFrame Start ***\n\tRT: 512\n\tKey: a:b\n\t*** LogFrame End ***\n")
    got = S.read_log_frames(spark, str(tmp_path / "b.log")).orderBy("frame").collect()
    assert [(r.level, r["values"]) for r in got] == [(1, {"Subject": "7"}), (3, {"RT": "512", "Key": "a:b"})]
    with tarfile.open(tmp_path / "c.tar", "w") as tar:
        info = tarfile.TarInfo("in/side.bin")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
    assert [(r.member, bytes(r.content)) for r in S.read_tar(spark, str(tmp_path / "c.tar")).collect()] == [("in/side.bin", b"abc")]
    (tmp_path / "d.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack("<4I", 10, 500_000, 2, 9) + b"hi")
    assert [(r.ts, r.length, bytes(r.data)) for r in S.read_captures(spark, str(tmp_path / "d.pcap")).collect()] == [(10.5, 9, b"hi")]
    (tmp_path / "e.bin").write_bytes(b"HD\x01\x02\x03\x04\x05")
    assert bytes(S.swap_bytes(spark, str(tmp_path / "e.bin"), 2, 2).first().content) == b"HD\x02\x01\x04\x03\x05"
    assert {r.name for r in S.find_files(spark, str(tmp_path), "*.txt").collect()} == {"a.txt"}
    S.write_files(spark.createDataFrame([("one", "text 1"), ("two", "text 2")], "name string, value string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("_name = 'two'").first().value == "text 2"


def _volume_files():
    rng = np.random.default_rng(5)
    box = {"Resolution": 3, "XStart": 57, "XEnd": 69, "YStart": 52, "YEnd": 61, "ZStart": 59, "ZEnd": 65}
    edges = [{"n": k % 3, "list": np.arange(k % 3, dtype="u4")} for k in range(5)]
    one = {"ClusterSize": 4, "EnableClusterCheck": 1, "LowerThreshold": 1.5, "UpperThreshold": 3.0, "UseValuesAboveThresh": 1, "DF1": 20, "DF2": 1, "ShowPositiveNegativeFlag": 3, "BonferroniValue": 5, "RGBLowerThreshPos": [1, 2, 3], "RGBUpperThreshPos": [4, 5, 6], "RGBLowerThreshNeg": [7, 8, 9], "RGBUpperThreshNeg": [1, 1, 1], "UseRGBColor": 0, "LUTName": "<default>", "TransColorFactor": 1.0}
    maps = [{"Type": 1, **one, "Name": "first", "values": rng.random(5)}, {"Type": 3, "NrOfLags": 2, "MinLag": 0, "MaxLag": 1, "CCOverlay": -1, **one, "Name": "lagged", "values": rng.random(5)}]
    vtc = {"NameOfSourceFMR": "run.fmr", "NameOfLinkedPRT": ["a.prt"], "NrOfVolumes": 6, **box, "TR": 2000.0}
    return {
        "msk": {**box, "values": rng.integers(0, 2, (4, 3, 2))},
        "vtc": {"FileVersion": 3, "NrOfLinkedPRTs": 1, "NrOfCurrentPRT": 0, "DataType": 2, **vtc, "Convention": 1, "ReferenceSpace": 3, "values": rng.random((6, 4, 3, 2))},
        "vtc2": {"FileVersion": 2, **vtc, "HemodynamicDelay": 1, "HrfDelta": 2.5, "HrfTau": 1.25, "SegmentSize": 10, "SegmentOffset": 0, "values": rng.integers(0, 9000, (6, 4, 3, 2))},
        "mtc": {"FileVersion": 1, "NrOfVertices": 7, "NrOfTimePoints": 4, "SourceVTCFile": "", "LinkedPRTFile": "x.prt", "HemodynamicDelay": 1, "TR": 2000.0, "HRFDelta": 2.5, "HRFTau": 1.25, "ProtocolSegmentSize": 10, "ProtocolSegmentOffset": 0, "MTCDataType": 1, "values": rng.random((4, 7))},
        "ssm": {"FileVersion": 2, "NrOfTargetVertices": 5, "NrOfSourceVertices": 9, "values": rng.integers(1, 9, 5)},
        "tsm": {"FileVersion": 1, "NrOfTargetVertices": 5, "NrOfSourceVertices": 9, "NrOfSourceTriangles": 12, "values": rng.integers(1, 12, 5), "TriangleEdgeLengths": rng.random((2, 5))},
        "srf": {"FileVersion": 4.0, "ExtendedNeighbors": 0, "NrOfVertices": 5, "NrOfTriangles": 2, "MeshCenter": [128, 128, 128], "values": rng.random((5, 3)), "VertexNormal": rng.random((5, 3)), "ConvexRGBA": [0, 0, 0, 1], "ConcaveRGBA": [1, 1, 1, 1], "VertexColor": np.zeros(5), "Neighbors": edges, "TriangleVertex": [[0, 1], [1, 2], [2, 4]]},
        "smp": {"FileVersion": 5, "NrOfVertices": 5, "NrOfMaps": 2, "NameOfOriginalSRF": "s.srf", "Map": maps},
    }


def test_volume_layouts_round_trip(spark, tmp_path):
    """Every kind of file: the bytes of its fields give the fields, the bytes and the table back."""
    from tessera.sources import volumes as V

    for name, fields in _volume_files().items():
        kind = name[:3]
        raw = V.build(fields, kind)
        found = V.parse(raw + b"more", kind)
        assert V.build(found, kind) == raw
        (tmp_path / name).mkdir()
        (tmp_path / name / f"a.{kind}").write_bytes(raw)
        rows = V.read_grid(spark, str(tmp_path / name), kind).collect()
        arrays = [m["values"] for m in fields["Map"]] if kind == "smp" else [fields["values"]]
        assert len(rows) == sum(np.size(a) for a in arrays)
        for r in rows:
            want = arrays[r.map - 1 if kind == "smp" else 0][tuple(r[a] for a in V.AXES[kind])]
            assert abs(r.value - want) < 1e-6
    assert sorted((r.a, r.b, r.c) for r in V.read_triangles(spark, str(tmp_path / "srf")).collect()) == [(0, 1, 2), (1, 2, 4)]
    head = {r.field: r.value for r in V.read_headers(spark, str(tmp_path / "vtc"), "vtc").collect()}
    assert head["NrOfVolumes"] == "6" and head["NameOfSourceFMR"] == "run.fmr" and head["TR"] == "2000.0"
