"""Files in byte ranges, in parts and in sets."""

import os
import subprocess
import sys
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwave.operators import shared
from groundwave.sources import blocks, filesets, mala, ranged, segy, sinks


def rows_of(df, key="path"):
    return sorted((r[key].rsplit("/", 1)[-1].split(".")[0], r["channel"], int(r["trace"]), round(r["dt"], 9), r["ns"], tuple(r["amp"])) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    whole = lambda n, ns, kind="<i2": rng.integers(-3000, 3000, (n, ns)).astype(kind)
    for name, n, channels in (("a", 60, 3), ("b", 7, 1)):
        (tmp_path / f"{name}.rad").write_text(f"SAMPLES:40\nTIMEWINDOW:20.0\nNUMBER_OF_CH:{channels}\n")
        (tmp_path / f"{name}.rd3").write_bytes(whole(n, 40).tobytes() + b"\1\2\3")
    for c in (1, 2):
        (tmp_path / f"c_A{c}.rad").write_text("SAMPLES:16\nTIMEWINDOW:8\n")
        (tmp_path / f"c_A{c}.rd7").write_bytes(whole(33, 16, "<i4").tobytes())
        (tmp_path / f"d_A0{c}.iprh").write_text("SAMPLES: 10\nTIMEWINDOW: 5\n")
        (tmp_path / f"d_A0{c}.iprb").write_bytes(whole(21, 10).tobytes())
    line = np.zeros(25, np.dtype({"names": ["number", "ns", "window", "amp"], "formats": ["<f4", "<f4", "<f4", ("<i2", (12,))], "offsets": [0, 8, 24, 128], "itemsize": 152}))
    line["number"], line["ns"], line["window"], line["amp"] = np.arange(1, 26) * 2, 12, 6.0, whole(25, 12)
    (tmp_path / "e.DT1").write_bytes(line.tobytes())
    (tmp_path / "none.dt1").write_bytes(b"")
    for name, bits, channels in (("f", 16, 2), ("g", 32, 1)):
        head = bytearray(2048)
        head[2:4], head[4:6], head[6:8], head[52:54], head[26:30] = (1024).to_bytes(2, "little"), (16).to_bytes(2, "little"), bits.to_bytes(2, "little"), channels.to_bytes(2, "little"), np.float32(30).tobytes()
        data = (whole(41, 16).astype(int) + 32768).astype("<u2") if bits == 16 else whole(41, 16, "<i4")
        data[3, 4] = data[4, 4] = 32768 if bits == 16 else 0
        (tmp_path / f"{name}.dzt").write_bytes(bytes(head[: 2048]) + data.tobytes())
    (tmp_path / "h.sgy").write_bytes(segy.encode(rng.normal(size=(30, 20)), np.arange(30.0), np.arange(30.0), 0.25))
    return tmp_path


@pytest.mark.parametrize("kind", ["rd3", "rd7", "iprb", "dt1", "dzt", "segy"])
def test_ranges_give_the_rows_of_whole_files(spark, folder, kind):
    path = str(folder)
    want = {
        "rd3": lambda: rows_of(mala.read(spark, path), "profile"), "rd7": lambda: rows_of(blocks.read_rd7(spark, path)), "iprb": lambda: rows_of(blocks.read_iprb(spark, path)),
        "dt1": lambda: rows_of(blocks.read_dt1(spark, path)), "dzt": lambda: rows_of(blocks.read_dzt(spark, path, start=2048, dead_sample=None)),
        "segy": lambda: rows_of(segy.read(spark, path).withColumns({"channel": F.lit(1), "ns": F.size("amp")})),
    }[kind]()
    for step in (200, 1 << 20):
        df = ranged.read(spark, path, kind, step, 2048 if kind == "dzt" else None)
        assert rows_of(df) == want
        assert df.rdd.getNumPartitions() > 4 if step == 200 else df.rdd.getNumPartitions() <= 3
    used = {r["p"] for r in ranged.read(spark, path, kind, 500, 2048 if kind == "dzt" else None).groupBy(F.spark_partition_id().alias("p")).count().collect()}
    assert len(used) > 1
    if kind == "dzt":
        got = rows_of(ranged.live(ranged.read(spark, path, kind, 700, 2048), dead_sample=5, quiet=2, scale=2.0))
        assert got == rows_of(blocks.read_dzt(spark, path, start=2048, dead_sample=5, quiet=2, scale=2.0))


def test_a_uri_an_empty_folder_and_a_file_without_its_header(spark, folder, tmp_path_factory):
    assert ranged.read(spark, f"file://{folder}", "rd3", 700).count() == 67
    assert ranged.read(spark, str(tmp_path_factory.mktemp("none")), "dzt").count() == 0
    (folder / "x.rd3").write_bytes(b"1" * 100)
    with pytest.raises(Exception, match="has no header"):
        ranged.read(spark, str(folder), "rd3").count()


@pytest.mark.parametrize("offset", [False, True])
def test_segy_in_parts_is_the_whole_file(spark, tmp_path, offset):
    rng = np.random.default_rng(2)
    rows = [(p, t, 4_400_123.45 + t * 0.02, 5_700_900.5 + p, rng.normal(size=25).tolist() if t % 9 else None) for p in (1, 2) for t in range(70 + p)]
    df = spark.createDataFrame(rows, "profile int, trace int, x double, y double, amp array<double>").repartition(5)
    written = {r["name"]: r["bytes"] for r in sinks.write_segy_parts(df, str(tmp_path), ["profile"], "trace", 0.1, part_bytes=3_400, offset=offset).collect()}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["1.sgy", "1.txt", "2.sgy", "2.txt"]
    assert {n: (tmp_path / n).stat().st_size for n in written} == written
    got = segy.read(spark, str(tmp_path)).orderBy("path", "trace").collect()
    assert [r["trace"] for r in got] == [*range(1, 72), *range(1, 73)]
    for r, (_, _, x, y, amp) in zip(got, rows, strict=True):
        assert np.allclose(r["amp"], 0 if amp is None else amp, atol=1e-6)
        assert np.isclose(r["x"] + r["inline"], x, atol=0.006) and np.isclose(r["y"] + r["crossline"], y, atol=0.006)
        assert (r["inline"], r["crossline"]) == ((4_400_000, 5_701_000) if offset else (0, 0))
    text = (tmp_path / "1.txt").read_text()
    assert "ntraces 71\n" in text and "x_start 4400123.45 m" in text and "mean_trace_spacing 0.0200 m" in text and "length_of_profile 1.40 m" in text
    if not offset:
        block = np.array([[0.0] * 25 if r[4] is None else r[4] for r in rows[:71]])
        assert (tmp_path / "1.sgy").read_bytes() == segy.encode(block, [r[2] for r in rows[:71]], [r[3] for r in rows[:71]], 0.1)


def test_files_of_a_measurement_meet(spark, tmp_path):
    for name in ("LINE07.DT1", "LINE7.HD", "LINE08.dt1", "line9.hd", "line9.HD2", ".LINE5.DT1", "LINE07.GPS", "LINE007.GPS"):
        (tmp_path / name).write_text("x")
    got = {r["name"]: r.asDict() for r in filesets.pairs(spark, str(tmp_path), "noggin").collect()}
    base = lambda p: p and p.rsplit("/", 1)[-1]
    assert got.keys() == {"7", "8", "9"}
    assert (base(got["7"]["data"]), base(got["7"]["header"]), got["7"]["missing"]) == ("LINE07.DT1", "LINE7.HD", []) and [base(p) for p in got["7"]["extra"]] == ["LINE07.GPS"]
    assert got["8"]["missing"] == ["header"] and got["9"]["missing"] == ["data"]


def test_low_and_high_frequencies_and_their_sidecar(spark, tmp_path):
    for name in ("s_x_100_a_b_LF.sgy", "s_x_100_a_b_HF.sgy", "s_x_101_a_b_HF.sgy"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "s_x_100_a_b.csv").write_text("File Name   s_x\r\nRepetition Rate [scans/cm]\t2.5\r\nSCAN DISTANCE [m]  START X  START Y\r\n12.5 1.25 -3\r\n")
    (tmp_path / "s_x_102_a_b.csv").write_text("nothing")
    got = {r["name"]: r for r in filesets.pairs(spark, str(tmp_path), "proceq").collect()}
    assert got["s_x_100_a_b"]["missing"] == [] and got["s_x_101_a_b"]["missing"] == ["sidecar"] and got["s_x_102_a_b"]["missing"] == ["low", "high"]
    assert got["s_x_100_a_b"]["low"].endswith("_LF.sgy") and got["s_x_100_a_b"]["high"].endswith("_HF.sgy")
    rows = {r["path"].rsplit("/", 1)[-1]: tuple(r)[1:] for r in filesets.read_sidecar(spark, str(tmp_path)).collect()}
    assert rows == {"s_x_100_a_b.csv": ("s_x", 2.5, 1.25, -3.0), "s_x_102_a_b.csv": (None, None, None, None)}


def test_headers_and_geometry_by_name(spark, tmp_path):
    lines = ["x"] * 20
    lines[6], lines[12], lines[14], lines[16], lines[18] = "NUMBER OF TRACES   = 120", "TOTAL TIME WINDOW  = 60.5", "STARTING POSITION  = -1", "FINAL POSITION = 11", "STEP SIZE USED = 0.1"
    (tmp_path / "L1.HD").write_text("\r\n".join(lines))
    assert tuple(filesets.read_hd(spark, str(tmp_path)).first())[1:] == (120, 60.5, -1.0, 11.0, 0.1)
    (tmp_path / "geo.txt").write_text("1 y L1.DT1 10 0 3 3\n2 x L2.DT1 5 9 2 2\nbad line\n")
    geometry = filesets.read_geometry(spark, str(tmp_path / "geo.txt"))
    traces = spark.createDataFrame([("L1.DT1", 0.5), ("L2.DT1", 0.5), ("L3.DT1", 0.5)], "name string, position double")
    got = {r["name"]: (r["x"], r["y"]) for r in filesets.by_geometry(traces, geometry).collect()}
    assert got == {"L1.DT1": (3.0, 9.5), "L2.DT1": (5.5, 2.0), "L3.DT1": (None, None)}


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}", "viewfs://mounted/in"])
def test_the_shared_folder_opens_without_spark(spark, tmp_path, form):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.mounted.link./in", f"file://{tmp_path}")
    given = SimpleNamespace(conf={"spark.checkpoint.dir": form.format(tmp_path / "new")} if "viewfs" not in form else {"spark.checkpoint.dir": form}, sparkContext=spark.sparkContext)
    path = shared.folder(given, "out")
    assert path.startswith(f"file://{tmp_path}")
    rows = spark.createDataFrame([("a.dt1", bytes(8) + np.float32(2).tobytes() + bytes(116) + b"\1\0\2\0")], "name string, content binary")
    assert [tuple(r) for r in sinks.write_files(rows, path).collect()] == [("a.dt1", 132)]
    assert [r["amp"] for r in ranged.read(spark, path, "dt1").collect()] == [r["amp"] for r in blocks.read_dt1(spark, path).collect()] == [[1.0, 2.0]]


#: A cluster of two executors whose shared folder is a path without a scheme: rows of each query through files.
_CLUSTER = """
import sys
from pyspark.sql import SparkSession
from groundwave.plans import files, catalogue
conf = {"spark.master": "local-cluster[2,2,1024]", "spark.executor.memory": "600m", "spark.driver.memory": "1g", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": sys.argv[1]}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for name in sys.argv[2:]:
    print(name, catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_queries_through_files_on_a_cluster_with_a_plain_shared_path(tmp_path):
    traces = ["read_dt1", "read_dzt", "read_dzt_ranges", "read_iprb_ranges", "read_rd3", "read_rd3_ranges", "read_rd7", "read_segy16", "segy_in_parts"]
    events = ["geojson_lines", "position_lists", "position_logs", "receiver_logs"]
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", _CLUSTER, str(tmp_path / "shared"), *traces, *events], env=os.environ | {"PYTHONPATH": here}, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert dict(line.split() for line in done.stdout.splitlines()) == {**dict.fromkeys(traces, "500"), **dict.fromkeys(events, "1000"), "receiver_logs": "999"}, done.stderr[-2000:]
