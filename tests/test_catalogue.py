"""Every survey query with SQL against DuckDB, and the kernels against analytic cases."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwave.functions import geo
from groundwave.operators import grid, kernels, spectral, trace
from groundwave.plans import catalogue, recipe
from groundwave.sources import gps, mala, segy

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def canonical(rows):
    return sorted(repr([None if v is None else v if isinstance(v, (str, bool)) else float(v) for v in row]) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    assert canonical(df.select(*columns).collect()) == canonical(want.select(", ".join(columns)).fetchall())


def test_every_query_has_its_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"c3_velocity"}


def test_entry(spark):
    assert catalogue.entry(spark, SMALL).count() > 0


def test_bandpass_keeps_phase_and_band():
    t = np.arange(256) * 0.5
    inside, outside = np.sin(2 * np.pi * 0.3 * t), np.sin(2 * np.pi * 0.01 * t)
    out = spectral.bandpass(0.5, 200, 400)(np.array([inside + outside, np.eye(256)[128]]))
    assert np.abs(out[0, 60:200] - inside[60:200]).max() < 0.05 and out[1].argmax() == 128
    assert np.allclose(out[1, 129:180], out[1, 127:76:-1])


def test_envelope_and_spectrum_of_a_wave():
    wave = 3 * np.cos(2 * np.pi * 8 * np.arange(64) / 64)[None]
    assert np.allclose(spectral.envelope(wave), 3)
    assert spectral.amplitude_spectrum(wave)[0].argmax() == 8 and np.isclose(spectral.amplitude_spectrum(wave)[0, 8], 3)


def test_alignment_and_k_highpass():
    ref = np.exp(-((np.arange(64) - 20.0) ** 2) / 8)
    assert spectral.align_to(ref)(np.roll(ref, 6)[None])[0].argmax() == 20
    flat = np.ones((100, 4))
    flat[3, 1] = np.nan
    out = spectral.k_highpass(0.02, 2.0)(flat)
    assert np.isnan(out[3, 1]) and np.abs(out[40:60, 2]).max() < 0.1


def test_distance_map_equals_two_raster_passes(spark):
    mask = np.random.default_rng(3).random((9, 12)) < 0.04
    mask[4, 4] = True
    d = np.where(mask, 0.0, np.inf)
    for image in (d, d[::-1, ::-1]):
        for i, j in np.ndindex(*image.shape):
            for di, dj, w in ((-1, -1, 1), (-1, 0, 0.75), (-1, 1, 1), (0, -1, 0.75)):
                if 0 <= i + di and 0 <= j + dj < image.shape[1]:
                    image[i, j] = min(image[i, j], image[i + di, j + dj] + w)
    cells = spark.createDataFrame([(0, int(x), int(y)) for y, x in zip(*np.nonzero(mask))], "slice long, ix long, iy long")
    got = {(r["iy"], r["ix"]): r["d"] for r in kernels.distance_map(cells, 3.0).collect()}
    assert {k: v for k, v in got.items() if 0 <= k[0] < 9 and 0 <= k[1] < 12} == {(i, j): d[i, j] for i, j in np.ndindex(*d.shape) if d[i, j] <= 3}


def test_migration_of_one_trace_is_a_circle(spark):
    amp = [1.0 if k == 20 else 0.0 for k in range(64)]
    rows = [(i, j, amp if (i, j) == (5, 5) else [0.0] * 64) for i in range(11) for j in range(11)]
    out = kernels.migrate(spark.createDataFrame(rows, "ix int, iy int, amp array<double>"), 0.1, 0.5, 0.1, 90.0, 0.05, 12).collect()
    for r in out:
        for k, v in enumerate(r["amp"]):
            if v:
                radius = np.hypot(0.1 * np.hypot(r["ix"] - 5, r["iy"] - 5), k * 0.05)
                assert round(2 * radius / 0.1 / 0.5) == 20
    assert any(v for r in out for v in r["amp"])


def test_slice_table_rules():
    assert [a for a, _ in grid.slice_table(4, 1, 31.5)][:3] == [0, 3, 6] and grid.slice_table(4, 3, 9) == grid.slice_table(4, 2, 9)
    assert grid.slice_table(50, 0, 10) == [(0.0, 50.0)] and grid.slice_table(2, 0, 5) == [(0, 2), (2, 4)]


def test_order_statistic_gain_and_bins(spark):
    row = spark.range(1).select(
        trace.order_statistic(F.array(*map(F.lit, [4.0, 1.0, 3.0, 2.0])), 0.5), trace.gain(F.array(F.lit(2.0), F.lit(3.0)), trace.gain_curve([20, 20], 2)),
        grid.bin_of(F.lit(50.0), 0, 5, 10), grid.bin_of(F.lit(50.1), 0, 5, 10), trace.t0_shift(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0])), 0.5, 1.5),
    ).first()
    assert row[0] == 3.0 and row[1] == [20.0, 30.0] and row[2] == 9 and row[3] is None and row[4] == [3.0, 4.0, 0.0, 0.0]


def test_utm_meridian_and_similarity(spark):
    east, north, zone = geo.utm(F.lit(48.0), F.lit(9.0))
    row = spark.range(1).select(east, north, zone).first()
    assert row[0] == pytest.approx(500000) and row[1] == pytest.approx(5316300, abs=300) and row[2] == 32
    a, b, tx, ty = geo.similarity([(0, 0, 10, 20), (1, 0, 10, 22), (0, 1, 8, 20)])
    assert (a, b, tx, ty) == pytest.approx((0, 2, 10, 20))


def test_recipe_order_is_checked(spark):
    assert recipe.parse("do_cutTWT 2\ndo_medfilt 1\ntmax 5\ndo_t0shift 0") == (["do_medfilt", "do_cutTWT"], {"": {}, "do_cutTWT": {}, "do_medfilt": {"tmax": 5.0}, "do_t0shift": {}})
    for bad in ("do_cutTWT 1\ndo_medfilt 3", "do_cutTWT 1\ndo_medfilt 1", "do_nothing 1"):
        with pytest.raises(ValueError):
            recipe.parse(bad)
    df = spark.createDataFrame([("p", 1, i, [float(i + k) for k in range(8)]) for i in range(4)], "profile string, channel int, trace int, amp array<double>")
    out = recipe.run(df, "do_amplitudeOffset 1\ntstart 0\ntend 10\ndo_removeMeanMedianTrace 2\ndo_cutTWT 3\ntmax 2", 1.0, 8).collect()
    assert all(np.allclose(r["amp"], 0) and len(r["amp"]) == 3 for r in out)


def test_readers_round_trip(spark, tmp_path):
    block = np.arange(60, dtype=np.int16).reshape(12, 5)
    (tmp_path / "a.rad").write_text("SAMPLES:5\nTIMEWINDOW:10.0\nNUMBER_OF_CH:3\n")
    (tmp_path / "a.rd3").write_bytes(block.astype("<i2").tobytes() + b"\0")
    got = {(r["channel"], r["trace"]): r["amp"] for r in mala.read(spark, str(tmp_path)).collect()}
    assert got == {(i % 3 + 1, i // 3 + 1): block[i].tolist() for i in range(12)}
    df = spark.createDataFrame([(1, i, i * 1.5, 2.25, [float(i), -0.5, 7.0]) for i in range(5)], "profile int, trace int, x double, y double, amp array<double>")
    content = segy.files(df, ["profile"], "trace", 0.5).first()["content"]
    assert len(content) == 3600 + 5 * (240 + 12)
    (tmp_path / "p.sgy").write_bytes(content)
    back = [(r["trace"], r["x"], r["y"], r["dt"], r["amp"]) for r in segy.read(spark, str(tmp_path)).orderBy("trace").collect()]
    assert back == [(i + 1, i * 1.5, 2.25, 0.5, [float(i), -0.5, 7.0]) for i in range(5)]
    (tmp_path / "x.dzg").write_text("$GSSIS,7,1\n$GPGGA,1,4830.0,N,00915.0,W,4,8,1,300.5,M,1,M,,\n$GSSIS,8\n$GPGGA,1\n")
    fix = gps.read_dzg(spark, str(tmp_path / "x.dzg")).collect()
    assert [(r["trace"], r["lat"], r["lon"], r["z"], r["quality"]) for r in fix] == [(7, 48.5, -9.25, 300.5, 4)]


def test_streaming_windows_equal_batch(spark, tmp_path):
    from groundwave.streaming import slices

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = slices.sliding(stream, "4 hours", "2 hours", "1 hour").writeStream.format("memory").queryName("sliding").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert canonical_ts(spark.table("sliding")) == canonical_ts(slices.sliding(events, "4 hours", "2 hours", "1 hour"))


def canonical_ts(df):
    return sorted(map(str, df.collect()))


def test_recipe_aligns_channels_and_filters_profiles(spark):
    pulse = np.exp(-((np.arange(32) - 12.0) ** 2) / 6)
    rows = [(p, c, i, 0.1 * i, float(i), 1.0, np.roll(pulse, 2 * (c - 1) + 3 * (p - 1)).tolist()) for p in (1, 2) for c in (1, 2) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "profile int, channel int, trace int, inline double, x double, y double, amp array<double>")
    out = recipe.run(df, "do_channelshift 1\nmaxshift 4\nrefprofile 1\ndo_crossprofileshift 2\nmaxshift_cps 5", 0.5, 32).collect()
    assert len(out) == len(rows) and all(np.argmax(r["amp"]) == 12 for r in out)
    out = recipe.run(df, "do_t0CorrectionReferencetrace 1\nprofile 1\nchannel 1\ntrace 1\nt0 1\ndo_exchange_x_y 2\ndo_turnProfiles 3", 0.5, 32).collect()
    assert all(np.argmax(r["amp"]) == 11 and r["x"] == 1.0 for r in out) and {(r["trace"], r["y"]) for r in out} == {(i, float(i)) for i in range(1, 9)}
    out = recipe.run(df, "do_constTraceDist 1\ndx 0.2\ndo_medfilt_x 2\nnumsamp_x 3\ndo_spectralWhitening 3\nfmin 50\nfmax 400\nalpha 0.8\ndo_khighpass 4\nkcutoff 0.1", 0.5, 32)
    assert sorted({(r["profile"], r["channel"], r["trace"]) for r in out.collect()}) == [(p, c, t) for p in (1, 2) for c in (1, 2) for t in range(1, 5)]
    out = recipe.run(df, "do_helmertTransformation 1\na 0\nb 1\ntx 5\nty 6\ndo_Envelope 2\ndo_makeAmpSpec 3", 0.5, 32).collect()
    assert all(r["x"] == 4.0 and r["y"] == 6 + r["trace"] and len(r["amp"]) == 17 for r in out)
