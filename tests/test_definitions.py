"""Operators against their definitions, worked out here in numpy and not shared with any query or its SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwave.operators import channel, spectral, trace, track

NS, DT = 24, 0.1


@pytest.fixture(scope="module")
def block():
    rng = np.random.default_rng(11)
    out = rng.normal(size=(40, NS))
    out[3] = 0.0
    out[5, -1] = 9.0
    out[6, :-1] = 0.1
    return out


def run(spark, block, expression):
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(block)], "i int, amp array<double>")
    return [r["a"] for r in df.select("i", expression(F.col("amp")).alias("a")).orderBy("i").collect()]


def test_offset_over_a_time_window(spark, block):
    t = np.arange(NS) * DT
    inside = (t >= 0.3 - 1e-12) & (t <= 0.7 + 1e-12)
    assert inside.sum() == 5
    assert np.allclose(run(spark, block, lambda a: trace.dc_removal(a, DT, 0.3, 0.7, NS)), block - block[:, inside].mean(1, keepdims=True))
    assert np.allclose(run(spark, block, lambda a: trace.dc_removal(a, DT, 0.0, 99.0, NS)), block - block.mean(1, keepdims=True))


def test_gain_of_decibels(spark, block):
    points = [-20.0, 0.0, 15.0]
    db = np.interp(np.linspace(0, 2, NS), [0, 1, 2], points)
    assert np.allclose(run(spark, block, lambda a: trace.gain(a, trace.gain_curve(points, NS))), block * 10 ** (db / 20))


def test_scale_is_an_order_statistic(spark, block):
    out = np.array(run(spark, block, lambda a: trace.normalize(a, 0.9)))
    for a, b in zip(block, out, strict=True):
        scale = np.sort(np.abs(a))[int(NS * 0.9)]  # the (floor(n p) + 1)-th of n
        assert np.allclose(b, a / scale if scale else 0)


def test_losses_and_spreading(spark, block):
    sigma, eps = 0.004, 9.0
    speed = 1 / np.sqrt(8.854e-12 * eps * 4e-7 * np.pi)
    depth = np.arange(NS) * DT * 1e-9 / 2 * speed
    rate = sigma / 2 * np.sqrt(4e-7 * np.pi / (eps * 8.854e-12))
    assert np.allclose(run(spark, block, lambda a: trace.attenuation(a, DT, sigma, eps)), block * np.exp(rate * depth), rtol=1e-4)
    assert np.allclose(run(spark, block, lambda a: trace.spherical_divergence(a, DT)), block * np.arange(NS) * DT)


@pytest.mark.parametrize("threshold", [0.8, -0.8])
def test_time_zero_at_a_threshold(spark, block, threshold):
    for a, b in zip(block, run(spark, block, lambda c: trace.t0_threshold(c, threshold)), strict=True):
        over = a >= threshold if threshold > 0 else a <= threshold
        k = int(over.argmax()) if over[:-1].any() else 0  # a crossing at the last sample is none
        assert np.allclose(b, np.concatenate([a[k:], np.zeros(k)]))


def test_time_zero_shift(spark, block):
    assert np.allclose(run(spark, block, lambda a: trace.t0_shift(a, DT, 0.55)), np.concatenate([block[:, 5:], np.zeros((40, 5))], axis=1))  # sample 6 (1-based) comes first


def test_alignment_climbs_to_both_sides_and_late_traces_win(block):
    rng = np.random.default_rng(12)
    ref = rng.normal(size=NS)
    both = 0
    for a in rng.normal(size=(200, NS)):
        r = {m: sum(ref[n + m] * a[n] for n in range(NS) if 0 <= n + m < NS) for m in range(-NS + 1, NS)}  # m > 0: the reference is later
        moved = 0
        up = 0
        while up + 1 < NS and r[up] <= r[up + 1]:
            up += 1
            moved = up
        down = 0
        while down - 1 > -NS and r[down] <= r[down - 1]:
            down -= 1
            moved = down  # the second climb decides
        both += up > 0 > down
        want = np.zeros(NS)
        for n in range(NS):
            if 0 <= n + moved < NS:
                want[n + moved] = a[n]
        assert np.allclose(spectral.align_to(ref)(a[None])[0], want)
    assert both > 10


def test_shift_by_correlation_of_padded_means(spark):
    rng = np.random.default_rng(13)
    means = {c: rng.normal(size=20) for c in (1, 2, 3)}
    df = spark.createDataFrame([(c, a.tolist()) for c, a in means.items()], "channel int, mean array<double>")
    got = {r["channel"]: r["shift"] for r in channel.best_shift(df, "channel", 1, 4).collect()}
    for c, a in means.items():
        ref = np.concatenate([np.zeros(4), means[1], np.zeros(4)])
        r = [round(np.corrcoef(ref, np.concatenate([np.zeros(4 + s), a, np.zeros(4 - s)]))[0, 1], 9) for s in range(-4, 5)]
        assert got[c] == int(np.argmax(r)) - 4


def test_bad_traces_by_their_neighbours(spark):
    rng = np.random.default_rng(14)
    block = rng.normal(size=(20, 6))
    for i, f in ((0, 6), (7, 0.01), (11, 6), (12, 6), (19, 0.01)):
        block[i] *= f
    level = np.abs(block).mean(1)
    bad = (level >= 2 * level.mean()) | (level <= level.mean() / 4)
    good = np.flatnonzero(~bad)
    want = np.stack([np.interp(np.arange(20), good, block[good, k]) for k in range(6)], axis=1)
    df = spark.createDataFrame([(1, i, a.tolist()) for i, a in enumerate(block)], "channel int, trace int, amp array<double>")
    got = channel.replace_bad(df, "channel", "trace", 4, 2).orderBy("trace").collect()
    assert 4 < bad.sum() < 10 and np.allclose([r["amp"] for r in got], want)


def test_gaps_are_filled_near_known_traces(spark):
    values = [None, None, 2.0, None, None, None, None, None, None, 9.0, 10.0, None, None, None]
    known = [i for i, v in enumerate(values) if v is not None]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "p int, i int, v double")
    got = [r["v"] for r in track.interpolate(df, "p", "i", "v", gap=5, edges="line").orderBy("i").collect()]
    for i, v in enumerate(got):
        if min(abs(i - k) for k in known) >= 2.5:
            assert v is None
        elif i > 10:
            assert np.isclose(v, 10 + (i - 10))
        elif i < 2:
            assert np.isclose(v, 2 - (2 - i))
        else:
            assert np.isclose(v, np.interp(i, known, [values[k] for k in known]))


def test_spectrum_and_envelope(block):
    n = 32
    assert np.allclose(spectral.amplitude_spectrum(block), 2 * np.abs(np.fft.fft(block, n, axis=1))[:, : n // 2 + 1] / NS)
    f = np.fft.fft(block, axis=1)
    hilbert = np.real(np.fft.ifft(f * (-1j * np.sign(np.fft.fftfreq(NS))), axis=1))
    assert np.allclose(spectral.envelope(block), np.sqrt(block**2 + hilbert**2), atol=1e-9) or np.abs(spectral.envelope(block) - np.sqrt(block**2 + hilbert**2)).max() < np.abs(f[:, NS // 2]).max() / NS * 2
