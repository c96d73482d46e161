"""Settings as users have them, filters by their definition, and the finished operators on cases with known results."""

import numpy as np
import pytest

from groundwave.operators import channel, grid, kernels, spectral, trace, track, velocity, wavenumber
from groundwave.plans import recipe
from groundwave.sources import segy

#: A profile pipeline's usual text: six steps on, units in brackets, texts for files, an empty list at the end.
SETTINGS = """do_amplitudeOffset 1
tstart[ns] 0
tend[ns] 100

do_badTraceRemoval 0
minfactor 3
maxfactor 3

do_constTraceDist 2
dx[m] 0.02

do_traceInterpolation 3
gap 10

do_medfilt_x 0
numsamp_x 3
tstart_x 0

do_spectralWhitening 0
fmin_sw[MHz] 100
fmax_sw[MHz] 600
alpha 0.01

do_bandpass 6
fstart[MHz] 100
fend[MHz] 600

do_migration2d_vz 0
v-file[m/ns] vgrid.mat
tv-file[ns] vt.mat
aperture_m[degree] 30

do_topomig2d 0
v[m/ns] 0.1

do_t0CorrectionReferencetrace 0
profilenumber 0
channelnumber 1
tracenumber 1
t0[ns] 0.1

do_crossprofileshift 5
maxshift_cps 30

do_channelshift 4
OneOrAll 2
maxshift 30
refprofile 0
shiftsamples
"""


def survey(spark):
    pulse = np.exp(-((np.arange(64) - 25.0) ** 2) / 8)
    rows = []
    for p in (1, 2):
        for c in (1, 2, 3):
            for i in range(1, 31):
                if i not in (11, 12):  # a hole that the interpolation fills
                    rows.append((p, c, i, 0.02 * i, 0.5 * c, (5 + np.roll(pulse, 2 * (c - 1) * p + 4 * (p - 1))).tolist()))
    return spark.createDataFrame(rows, "profile int, channel int, trace int, x double, y double, amp array<double>")


def test_usual_settings_run(spark):
    out = recipe.run(survey(spark), SETTINGS, 0.5, 64).collect()
    # 29 steps of 0.02 from the first trace on, and the edge
    assert {(r["profile"], r["channel"]): 0 for r in out}.keys() == {(p, c) for p in (1, 2) for c in (1, 2, 3)}
    assert {r["trace"] for r in out} == set(range(1, 31)) and len(out) == 6 * 30
    assert {int(np.argmax(r["amp"])) for r in out} == {25}
    for r in out:
        assert abs(np.mean(r["amp"])) < 0.05 and r["y"] == pytest.approx(0.5 * r["channel"]) and r["x"] == pytest.approx(0.02 * r["trace"], abs=0.021)


def test_settings_keep_each_step_its_parameters():
    steps, p = recipe.parse("do_cutTWT 2\ncutT 80\n\ndo_applyGain 1\ng -20 0 10 15 20\ndo_migration 0\nvfile_mig vgrid.mat\naperture_mig 30\ndo_topomigration 0\naperture_topomig 1\n")
    assert steps == ["do_applygain", "do_cutTWT"] and p["do_cutTWT"] == {"tmax": 80.0} and p["do_applygain"] == {f"g{i + 1}": v for i, v in enumerate((-20.0, 0.0, 10.0, 15.0, 20.0))}
    assert p["do_migration2d_vz"] == {"v": "vgrid.mat", "aperture": 30.0}
    assert recipe.parse("do_channelshift 1\nshiftsamples 0 2 -1")[1]["do_channelshift"] == {"shiftsamples": [0.0, 2.0, -1.0]}
    for bad in ("do_topomig2d 1", "do_cutTWT 2"):
        with pytest.raises(ValueError):
            recipe.parse(bad)


def test_shifts_can_be_given(spark):
    out = recipe.run(survey(spark).where("profile = 1"), "do_channelshift 1\nOneOrAll 1\nmaxshift 5\nrefprofile 0\nshiftsamples 0 -2 -4", 0.5, 64)
    assert {int(np.argmax(r["amp"])) for r in out.collect()} == {25}
    with pytest.raises(ValueError):
        recipe.run(survey(spark), "do_channelshift 1\nOneOrAll 1\nmaxshift 5\nrefprofile 0", 0.5, 64)


def fir_by_definition(n, corners):
    """The magnitudes of n taps, sum by sum."""
    grid_n = 512
    wish = [float(np.interp(i / grid_n, corners, (0, 1, 1, 0))) for i in range(grid_n + 1)]
    taps = []
    for t in range(n):
        total = wish[0] + wish[-1] * np.cos(np.pi * (t - n // 2))
        total += 2 * sum(wish[i] * np.cos(np.pi * i * (t - n // 2) / grid_n) for i in range(1, grid_n))
        taps.append(total / (2 * grid_n) * (0.54 - 0.46 * np.cos(2 * np.pi * t / (n - 1))))
    return [abs(sum(b * np.exp(-2j * np.pi * j * t / n) for t, b in enumerate(taps))) for j in range(n // 2 + 1)]


def test_filters_are_those_of_the_definition():
    corners = (0.0375, 0.1, 0.6, 0.725)
    assert spectral.fir_magnitude(128, corners) == pytest.approx(fir_by_definition(128, corners), abs=1e-12)
    # the lower corner lies an eighth of the band below: 37.5 MHz for 100 to 600 MHz
    block = np.random.default_rng(2).normal(size=(3, 64))
    want = np.fft.irfft(np.fft.rfft(block, 128) * np.array(fir_by_definition(128, corners)), 128)[:, :64]
    assert spectral.bandpass(0.5, 100, 600)(block) == pytest.approx(want, abs=1e-12)
    with pytest.raises(ValueError):
        spectral.k_highpass(1.0, 0.4)(np.ones((8, 2)))


def test_autocorrelation_spectrum_by_lags():
    block = np.random.default_rng(4).normal(size=(4, 50))
    block[3] = 0
    for a, got in zip(block, spectral.autocorrelation_spectrum(block), strict=True):
        full = np.correlate(a, a, "full") / max((a * a).sum(), 1e-300)
        assert got == pytest.approx(np.abs(np.fft.fft(full[:64]))[:33] / 50)


def test_missing_traces_and_samples_stay_missing(spark):
    rows = [(1, i, None if i == 4 else [float(i + k) for k in range(6)]) for i in range(10)]
    df = spark.createDataFrame(rows, "channel int, trace int, amp array<double>")
    out = {r["trace"]: r["amp"] for r in wavenumber.along_traces(df, "channel", "trace", spectral.k_highpass(0.02, 0.1)).collect()}
    assert len(out) == 10 and out[4] is None and all(x is not None for t, a in out.items() if t != 4 for x in a)
    df = spark.createDataFrame([(1, [1.0, float("nan"), 4.0]), (1, [3.0, 2.0, None])], "channel int, amp array<double>")
    assert channel.sample_stats(df, ["channel"]).first()["mean"] == [2.0, 2.0, 4.0]
    assert [r[0] for r in df.select(trace.normalize(df["amp"], 1.0)).collect()] == [[0.25, 0.0, 1.0], [1.0, pytest.approx(2 / 3), 0.0]]


def test_lines_go_on_beyond_the_ends(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, 2.0, 4.0, None, 8.0, 11.0, None])] + [(2, 0, None), (2, 1, 5.0), (2, 2, None)], "g int, at int, v double")
    got = {(r["g"], r["at"]): r["v"] for r in track.interpolate(df, "g", "at", "v", edges="line").collect()}
    assert [got[1, i] for i in range(8)] == [-2.0, 0.0, 2.0, 4.0, 6.0, 8.0, 11.0, 14.0] and [got[2, i] for i in range(3)] == [5.0, 5.0, 5.0]


def test_replaced_outliers_by_brute_force(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for g in range(4):
        x = np.cumsum(rng.normal(1, 0.1, 40)) + 50
        x[[7, 20, 21, 39] if g else [0, 1, 30]] += 300
        y = np.linspace(10, 20, 40)
        rows += [(g, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
        off = 0
        for v in (x, y):
            wide = np.concatenate(([0, 0], v, [0, 0]))
            med = np.array([np.median(wide[i : i + 5]) for i in range(40)])
            med[0] = v[0]
            off = off + (v - med) ** 2
        off = np.sqrt(off)
        good = off < 3 * off.mean()
        spot = np.cumsum(good - np.diff(np.concatenate(([1], good.astype(int)))) / 2)
        for name, v in (("x", x), ("y", y)):
            known, n = v[good], good.sum()
            base = np.clip(np.floor(spot).astype(int), 1, n - 1)
            want[g, name] = known[base - 1] + (known[base] - known[base - 1]) * (spot - base)
    df = spark.createDataFrame(rows, "g int, i int, x double, y double")
    out = track.replaced_outliers(df, "g", "i", ("x", "y"), 5).orderBy("g", "i").collect()
    for (g, name), values in want.items():
        assert [r[name] for r in out if r["g"] == g] == pytest.approx(values), (g, name)
    assert sum(r["outlier"] for r in out) > 5


def test_migration_follows_the_relief(spark):
    amp = [1.0 if k == 20 else 0.0 for k in range(64)]
    height = lambda i, j: 10 - 0.1 * i
    rows = [(i, j, height(i, j), amp if (i, j) == (5, 5) else [0.0] * 64) for i in range(11) for j in range(11)]
    df = spark.createDataFrame(rows, "ix int, iy int, h double, amp array<double>")
    out = kernels.migrate(df, 0.1, 0.5, 0.1, 90.0, 0.05, 34, height="h", ns=64).collect()
    lit = [(r["ix"], r["iy"], k) for r in out for k, v in enumerate(r["amp"]) if v]
    assert lit
    for i, j, k in lit:
        way = np.sqrt((0.1 * (i - 5)) ** 2 + (0.1 * (j - 5)) ** 2 + (k * 0.05 - 0.5) ** 2)
        assert round(2 * way / 0.1 / 0.5) == 20 and k >= round((10 - height(i, j)) / 0.05)
    flat = df.selectExpr("ix", "iy", "7.5D as h", "amp")
    same = {(r["ix"], r["iy"]): r["amp"] for r in kernels.migrate(flat, 0.1, 0.5, 0.1, 80.0, 0.05, 12, height="h", ns=64).collect()}
    for r in kernels.migrate(df, 0.1, 0.5, 0.1, 80.0, 0.05, 12).collect():
        assert same[r["ix"], r["iy"]] == pytest.approx(r["amp"])


def test_coherence_of_equal_and_opposite_traces(spark):
    wave = np.sin(np.arange(40) * 0.7)
    cells = [(0, 0, wave.tolist()), (1, 0, (2 * wave + 1).tolist()), (5, 5, wave.tolist()), (5, 6, (-wave).tolist()), (9, 9, wave.tolist())]
    out = {(r["ix"], r["iy"]): r["amp"] for r in grid.coherence_cube(spark.createDataFrame(cells, "ix int, iy int, amp array<double>"), 0.5).collect()}
    assert out.keys() == {(0, 0), (1, 0), (5, 5), (5, 6)}
    assert [v is not None for v in out[0, 0]] == [False] * 3 + [True] * 35 + [False] * 2
    assert np.allclose([v for v in out[1, 0] if v is not None], 0) and np.allclose([v for v in out[5, 6] if v is not None], 2)


def test_headers_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        segy.encode(np.zeros((1, 40_000)), np.zeros(1), np.zeros(1), 0.5)
    many = segy.encode(np.zeros((40_000, 2)), np.zeros(40_000), np.zeros(40_000), 0.5)
    assert many[3212:3214] == b"\0\0" and many[3220:3222] == b"\0\2"


def test_moving_backgrounds_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, block = [], {}
    for c in (1, 2):
        block[c] = rng.normal(size=(50, 4))
        block[c][7, 2] = np.nan
        for i in range(50):
            rows.append((c, i, None if i in (20, 21) else [None if np.isnan(v) else float(v) for v in block[c][i]]))
        block[c][20:22] = np.nan
    df = spark.createDataFrame(rows, "channel int, trace int, amp array<double>")
    for kernel, middle in ((channel.moving_mean_kernel(3), np.nanmean), (channel.moving_median_kernel(3), np.nanmedian)):
        out = {(r["channel"], r["trace"]): r["amp"] for r in channel.apply_blocks(df, "channel", "trace", 3, kernel, rows=8).collect()}
        assert len(out) == 100
        for (c, i), got in out.items():
            want = block[c][i] - middle(block[c][max(0, i - 3) : i + 4], axis=0)
            assert got is None if i in (20, 21) else [np.nan if v is None else v for v in got] == pytest.approx(list(want), nan_ok=True), (c, i)


def test_columns_make_clusters():
    box = np.zeros((12, 6))
    box[2:6, 0] = box[3:7, 1] = box[3:8, 2] = 1.0  # one cluster of three columns
    box[8:11, 1] = 0.9  # a run of its own
    box[6:9, 3] = 1.0  # meets the third column in two samples only
    box[0:4, 5] = -1.0  # far off
    found = sorted((sorted(set(c[:, 0].tolist())), len(c)) for c in velocity.column_clusters(box, 3))
    assert found == [([0, 1, 2], 13), ([1], 3), ([3], 3), ([5], 4)]


def test_velocity_of_a_hyperbola(spark):
    rows, picks = [], []
    for g, (x0, t0, v) in enumerate([(1.0, 10.0, 0.1), (1.2, 14.0, 0.08)]):
        for i in range(100):
            t = 2 * np.sqrt((t0 / 2) ** 2 + ((i * 0.02 - x0) / v) ** 2)
            rows.append((g, i * 0.02, np.exp(-((np.arange(600) * 0.1 - t) ** 2) / 0.1).tolist()))
        picks.append((g, g, x0 + 0.05, t0 + 0.3))
    df = spark.createDataFrame(rows, "channel int, x double, amp array<double>")
    points = velocity.cluster_points(spark.createDataFrame(picks, "pick int, channel int, x double, t double"), df, "channel", 0.1, 0.4, 1.0, 11.0)
    got = {r["pick"]: (r["x0"], r["t0"], r["v"]) for r in velocity.picked_velocities(points).collect()}
    assert got[0] == (pytest.approx(1.0, abs=0.03), pytest.approx(10, abs=0.1), pytest.approx(0.1, abs=0.004))
    assert got[1] == (pytest.approx(1.2, abs=0.03), pytest.approx(14, abs=0.1), pytest.approx(0.08, abs=0.004))
