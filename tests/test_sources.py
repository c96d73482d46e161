"""Vendor files, lists and sinks: files made here, read back."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwave.sources import blocks, logs, segy, sinks


def traces_of(df):
    return {(r["channel"], r["trace"]): r["amp"] for r in df.collect()}


def dzt(block: np.ndarray, bits: int, channels: int, at: int) -> bytes:
    head = bytearray(at)
    for place, value in ((2, 1024), (4, block.shape[1]), (6, bits), (52, channels)):
        head[place : place + 2] = value.to_bytes(2, "little")
    head[26:30] = np.float32(8).tobytes()
    return bytes(head) + block.astype("<u2" if bits == 16 else "<i4").tobytes()


@pytest.mark.parametrize("bits,channels", [(16, 1), (16, 2), (32, 1)])
def test_dzt(spark, tmp_path, bits, channels):
    block = np.arange(40).reshape(10, 4) + (32768 if bits == 16 else -20)
    block[4, 2] = 32768 if bits == 16 else 0
    (tmp_path / "a.DZT").write_bytes(dzt(block, bits, channels, 2048 if channels == 2 else 1024 + 64 * 4))
    df = blocks.read_dzt(spark, str(tmp_path), dead_sample=3, quiet=1)
    want, n = {}, {}
    for i, row in enumerate(block - (32768 if bits == 16 else 0)):
        if row[2] != 0:
            c = i % channels + 1
            n[c] = n.get(c, 0) + 1
            want[c, n[c]] = [0.0, *map(float, row[1:])]
    assert traces_of(df) == want and {r["dt"] for r in df.collect()} == {2.0}


def test_dt1_and_empty_file(spark, tmp_path):
    block = np.arange(12, dtype=np.int16).reshape(3, 4) - 5
    rows = b""
    for i, row in enumerate(block):
        head = bytearray(128)
        head[0:4], head[8:12], head[24:28] = np.float32(i + 1).tobytes(), np.float32(4).tobytes(), np.float32(20).tobytes()
        rows += bytes(head) + row.astype("<i2").tobytes()
    (tmp_path / "l.DT1").write_bytes(rows + b"part")
    (tmp_path / "e.dt1").write_bytes(b"")
    df = blocks.read_dt1(spark, str(tmp_path))
    assert traces_of(df) == {(1, i + 1): block[i].tolist() for i in range(3)} and df.first()["dt"] == 5.0


def test_channel_files(spark, tmp_path):
    block = np.arange(12).reshape(3, 4) - 70000
    for c in (1, 2):
        (tmp_path / f"p_001_A{c}.rad").write_text("SAMPLES:4\nTIMEWINDOW:10\n")
        (tmp_path / f"p_001_A{c}.rd7").write_bytes((block * c).astype("<i4").tobytes())
        (tmp_path / f"p_001_A0{c}.iprh").write_text("SAMPLES: 4\r\nTIMEWINDOW: 10\r\n")
        (tmp_path / f"p_001_A0{c}.iprb").write_bytes((block + 70000 + c).astype("<i2").tobytes())
    assert traces_of(blocks.read_rd7(spark, str(tmp_path))) == {(c, i + 1): (block[i] * c).astype(np.float32).tolist() for c in (1, 2) for i in range(3)}
    assert traces_of(blocks.read_iprb(spark, str(tmp_path))) == {(c, i + 1): (block[i] + 70000 + c).tolist() for c in (1, 2) for i in range(3)}


def test_segy16(spark, tmp_path):
    head = bytearray(3600)
    head[3216:3218], head[3220:3222] = (250).to_bytes(2, "little"), (3).to_bytes(2, "little")
    block = np.array([[1, -2, 3], [4, 5, -6]], "<i2")
    (tmp_path / "r.sgy").write_bytes(bytes(head) + b"".join(bytes(240) + r.tobytes() for r in block))
    df = blocks.read_segy16(spark, str(tmp_path))
    assert traces_of(df) == {(1, 1): [1, -2, 3], (1, 2): [4, 5, -6]} and df.first()["dt"] == 0.25


def test_lists_and_logs(spark, tmp_path):
    (tmp_path / "a.pos").write_text("trace x y z\n1 2.5 3 4\n2\t3.5\t4\t5\n3 1\n")
    assert [tuple(r)[1:] for r in logs.read_list(spark, str(tmp_path / "a.pos"), "pos").collect()] == [(1, 2.5, 3, 4), (2, 3.5, 4, 5)]
    (tmp_path / "a.gps").write_text("Trace #1 at position 0.5\n$GPGGA,1,4830.0,N,00915.0,W,4,8,1,300.5,M,1,M,,\nTrace #2 at position 1\nTrace #3 at position 1.5\n$GPGGA,1,4831.0,S,00915.0,E,4,8,1,301,M,1,M,,\n")
    got = [tuple(r)[1:] for r in logs.read_cart(spark, str(tmp_path / "a.gps")).orderBy("trace").collect()]
    assert got == [(1, 0.5, 48.5, -9.25, 300.5), (3, 1.5, pytest.approx(-48.516666667), 9.25, 301.0)]
    (tmp_path / "a.cor").write_text("head\n7\t2024-01-01\t10:00:00\t54.5\tN\t10.25\tW\t33.5\tM\t4\n")
    assert [tuple(r)[1:] for r in logs.read_cor(spark, str(tmp_path / "a.cor")).collect()] == [(7, 54.5, -10.25, 33.5, 4)]


def test_segy_sinks_round_trip(spark, tmp_path):
    rows = [(p, i, i + p / 4, 2.5, [float(i), -0.5, p + 0.25]) for p in (1, 2) for i in range(4)]
    df = spark.createDataFrame(rows, "profile int, trace int, x double, y double, amp array<double>")
    out = sinks.write_segy(df, f"file://{tmp_path}/lines", ["profile"], "trace", 0.5).collect()
    assert sorted(r["name"] for r in out) == ["1.sgy", "2.sgy"] and {r["bytes"] for r in out} == {3600 + 4 * 252}
    back = segy.read(spark, f"{tmp_path}/lines").where(F.col("path").endswith("2.sgy")).orderBy("trace").collect()
    assert [(r["x"], r["amp"]) for r in back] == [(i + 0.5, [float(i), -0.5, 2.25]) for i in range(4)]
    cells = spark.createDataFrame([(ix, iy, float(ix), float(iy), None if ix == iy == 1 else [1.0, float(ix)]) for ix in range(3) for iy in range(5)], "ix int, iy int, x double, y double, amp array<double>")
    out = sinks.write_segy_block(cells, str(tmp_path / "block"), 0.5, lines=2).collect()
    assert sorted(r["name"] for r in out) == [f"block_0000{i}.sgy" for i in range(3)]
    back = {(r["inline"], r["crossline"]): r["amp"] for r in segy.read(spark, str(tmp_path / "block")).collect()}
    assert back == {(iy + 1, ix + 1): [0.0, 0.0] if ix == iy == 1 else [1.0, float(ix)] for ix in range(3) for iy in range(5)}


def test_geojson_and_world_file(spark):
    df = spark.createDataFrame([(1, 2, 3.0, 4.0), (1, 1, 1.0, 2.0), (1, 3, None, 1.0)], "profile int, trace int, x double, y double")
    feature = json.loads(sinks.lines_geojson(df, "profile", "trace", 25832).first()["feature"])
    assert feature["geometry"] == {"type": "LineString", "coordinates": [[1, 2], [3, 4]]} and feature["ids"] == 1 and feature["crs"]["properties"]["name"] == "EPSG:25832"
    text = spark.range(1).select(sinks.world_file(F.lit(10.0), F.lit(20.0), 0.5, (0.0, 1.0, 100.0, 200.0))).first()[0]
    assert list(map(float, text.split("\n"))) == [0, 0.5, 0.5, 0, 80, 210]


def test_images_with_world_files(spark, tmp_path):
    rows = [(1, ix, iy, float(ix + iy)) for ix in range(-2, 6) for iy in range(5) if (ix, iy) != (0, 0)] + [(2, 0, 0, None), (2, 1, 0, 99.0)]
    out = sinks.write_images(spark.createDataFrame(rows, "slice int, ix int, iy int, v double"), str(tmp_path), 0.0, 10.0, 0.5, (100.0, 200.0), tile=4)
    assert {r["name"] for r in out.collect()} == {f"slice_{s}.{k}" for s in ("00001_-1_0", "00001_-1_1", "00001_0_0", "00001_0_1", "00001_1_0", "00001_1_1", "00002_0_0") for k in ("png", "pgw")}
    raw = (tmp_path / "slice_00001_0_0.png").read_bytes()
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">2I", raw[16:24]) == (4, 4)
    size = struct.unpack(">I", raw[33:37])[0]
    image = np.frombuffer(zlib.decompress(raw[41 : 41 + size]), np.uint8).reshape(4, 9)
    assert image[:, 0].max() == 0 and image[3].tolist() == [0, 0, 0, 26, 255, 51, 255, 76, 255]
    assert list(map(float, (tmp_path / "slice_00001_1_0.pgw").read_text().split("\n"))) == [0.5, 0, 0, -0.5, 102.0, 201.5]


def test_profiles_with_positions_and_offsets(spark, tmp_path):
    from groundwave.sources import mala

    for name, n in (("a_001", 20), ("a_002", 9)):
        (tmp_path / f"{name}.rad").write_text("SAMPLES:3\nTIMEWINDOW:6\nNUMBER_OF_CH:2\nCH_X_OFFSETS: -0.5 0.5 \nCH_Y_OFFSETS: 0.25 0 \n")
        (tmp_path / f"{name}.rd3").write_bytes(np.arange(n * 2 * 3, dtype="<i2").tobytes())
    # north and east change places; the way leads east; the log begins at trace 3
    (tmp_path / "a_001_G01.pos").write_text("trace north east height\n3 100 10 5\n20 100 27 22\n")
    (tmp_path / "a_002_G01.pos").write_text("trace north east height\n1 0 0 0\n9 0 8 0\n")
    rows = mala.read_placed(spark, str(tmp_path)).orderBy("channel", "trace").collect()
    assert {r["profile"] for r in rows} == {"a_001"} and [(r["channel"], r["trace"]) for r in rows] == [(c, t) for c in (1, 2) for t in range(3, 21)]
    for r in rows:
        across, along = ((-0.5, 0.25), (0.5, 0.0))[r["channel"] - 1]
        assert (r["x"], r["y"], r["z"]) == pytest.approx((r["trace"] + 7 + along, 100 - across, r["trace"] + 2.0))
        assert r["amp"][0] == ((r["trace"] - 1) * 2 + r["channel"] - 1) * 3


def test_midpoints_and_places_beyond_the_fixes(spark):
    from groundwave.operators import placing

    poles = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.5)], "no int, across double, along double")
    pairs = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "channel int, sender int, receiver int")
    assert sorted(map(tuple, placing.midpoints(pairs, poles, poles).collect())) == [(1, 0.0, 0.0), (2, 0.5, 0.25)]
    traces = spark.createDataFrame([(1, 1, t) for t in range(1, 7)], "profile int, channel int, trace int")
    fixes = spark.createDataFrame([(1, 2, 10.0, 0.0, 1.0), (1, 4, 14.0, 2.0, 1.0)], "profile int, trace int, x double, y double, z double")
    assert [r["x"] for r in placing.place(traces, fixes).orderBy("trace").collect()] == [10, 12, 14]
    assert [r["x"] for r in placing.place(traces, fixes, beyond=True).orderBy("trace").collect()] == [8, 10, 12, 14, 16, 18]


def test_text_sinks_are_read_back(spark, tmp_path):
    from groundwave.sources import gps

    rows = spark.createDataFrame([(7, 2, 1.5, 2.25, None), (7, 1, 0.5, 1.0, 3.0), (8, 1, 9.0, 9.0, 9.0)], "profile int, trace int, x double, y double, z double")
    assert {r["name"] for r in sinks.write_lists(rows, str(tmp_path / "pos"), "profile", "trace", ["trace", "x", "y", "z"], "trace\tx\ty\tz").collect()} == {"7.pos", "8.pos"}
    assert (tmp_path / "pos" / "7.pos").read_text() == "trace\tx\ty\tz\n1\t0.5000\t1.0000\t3.0000\n2\t1.5000\t2.2500\tNaN\n"
    fixes = spark.createDataFrame([(1, 5, 48.5, -9.25, 300.5, 4), (1, 2, -0.125, 179.999, 1.25, 1)], "profile int, trace int, lat double, lon double, z double, quality int")
    sinks.write_dzg(fixes, str(tmp_path / "dzg")).collect()
    back = [tuple(r)[1:] for r in gps.read_dzg(spark, str(tmp_path / "dzg")).orderBy("trace").collect()]
    assert back == [(2, pytest.approx(-0.125), pytest.approx(179.999), 1.25, 1), (5, pytest.approx(48.5), pytest.approx(-9.25), 300.5, 4)]


def test_geojson_lines_are_read(spark, tmp_path):
    line = {"type": "Feature", "properties": {"id": 4}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3.5, 4]]}}
    area = {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 0]], [[5, 5, 1]]]}}
    point = {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [line, point, area]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(line))
    got = sorted((r["path"][-6:], r["feature"], r["part"], r["k"], r["x"], r["y"]) for r in logs.read_geojson(spark, str(tmp_path)).collect())
    assert got == [("a.json", 0, 0, 0, 1, 2), ("a.json", 0, 0, 1, 3.5, 4), ("a.json", 2, 0, 0, 0, 0), ("a.json", 2, 0, 1, 1, 0), ("a.json", 2, 0, 2, 0, 0), ("a.json", 2, 1, 0, 5, 5), ("b.json", 0, 0, 0, 1, 2), ("b.json", 0, 0, 1, 3.5, 4)]
