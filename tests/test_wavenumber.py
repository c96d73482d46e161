"""Filters over wavenumbers against whole transforms, and migration by tiles against the plain sum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwave.operators import kernels, spectral, wavenumber


def filtered(image, angle, opening):
    """The rule as it is written: transform of the padded image, wedge of atan(kx / ky), cosine of the angle from its first edge."""
    ny, nx = (max(2, 1 << (n - 1).bit_length()) for n in image.shape)
    f = np.fft.fftshift(np.fft.fft2(image, (ny, nx)))
    kx, ky = np.meshgrid(np.arange(-nx // 2, nx // 2) / nx, np.arange(-ny // 2, ny // 2) / ny)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.degrees(np.arctan(kx / ky))
        wedge = (a >= angle - opening / 2) & (a <= angle + opening / 2)
        f = np.where(wedge, f * (0.5 + 0.5 * np.cos(np.radians(360 / opening * (a - angle + opening / 2)))), f)
    return np.real(np.fft.ifft2(np.fft.ifftshift(f)))[: image.shape[0], : image.shape[1]]


def frame(spark, image, slices=2):
    return spark.createDataFrame([(s, x + 3, y - 2, float(image[y, x]) * (s + 1)) for s in range(slices) for y in range(image.shape[0]) for x in range(image.shape[1])], "slice long, ix long, iy long, v double")


@pytest.mark.parametrize(("shape", "angle", "opening"), [((9, 12), 30, 20), ((16, 16), -45, 40), ((5, 33), 0, 10), ((1, 7), 10, 30)])
def test_pie_slice_equals_the_rule(spark, monkeypatch, shape, angle, opening):
    image = np.random.default_rng(1).normal(size=shape)
    want = filtered(image, angle, opening)
    for r in wavenumber.pie_slices(frame(spark, image), opening, angle).collect():
        assert np.isclose(r["v"], want[r["iy"] + 2, r["ix"] - 3] * (r["slice"] + 1), atol=1e-9)


def test_a_wedge_about_90_degrees_has_two_sides():
    kx, ky = np.array([0.0, 0.1, 0.2]), np.array([0.0, 0.01, -0.01, 0.3])
    mask = wavenumber.pie_mask(kx, ky, 90, 20)
    assert mask[0, 0] == 1 and np.allclose(mask[0, 1:], 0) and np.allclose(mask[1], mask[2]) and mask[1, 1] < 0.7 and (mask[3] == 1).all()


def test_parts_have_their_own_angles(spark, monkeypatch):
    image = np.random.default_rng(2).normal(size=(10, 20))
    left, right = np.zeros((10, 20)), np.zeros((10, 20))
    left[:, :8], right[:, 6:15] = image[:, :8], image[:, 6:15]
    a, b = filtered(left, 20, 30), filtered(right, -60, 30)
    want = image.copy()
    want[:, :8], want[:, 6:15] = a[:, :8], b[:, 6:15]
    box = lambda x0, x1: [(x0, -9.0), (x1, -9.0), (x1, 99.0), (x0, 99.0)]
    df = frame(spark, image, 1).withColumn("v", F.when((F.col("ix") == 5) & (F.col("iy") == 0), None).otherwise(F.col("v")))
    got = {(r["iy"] + 2, r["ix"] - 3): r["v"] for r in wavenumber.pie_slices(df, 30, polygons=[(box(2.5, 10.5), 20), (box(8.5, 17.5), -60)]).collect()}
    assert len(got) == 200 and got[(2, 2)] is None
    gap = np.zeros((10, 20))
    gap[2, 2] = image[2, 2]
    want[:, :6] = filtered(left - gap, 20, 30)[:, :6]
    assert all(v is None or np.isclose(v, want[k], atol=1e-9) for k, v in got.items())


def test_blocks_of_columns_of_any_width():
    image = np.random.default_rng(3).normal(size=(8, 16))
    old = wavenumber.BLOCK
    wavenumber.BLOCK = 16
    try:
        import pyarrow as pa

        lines = pa.RecordBatch.from_pylist([{"part": 0, "slice": 0, "iy": y, "nx": 16, "ny": 8, "line": [{"x": x, "v": image[y, x]} for x in range(16)]} for y in range(8)])
        blocks = pa.Table.from_batches(wavenumber._rows_to_blocks([lines]))
        assert len(set(blocks["block"].to_pylist())) == 5
        run = wavenumber._filter_columns([30.0], 40.0)
        done = pa.concat_tables([run(blocks.filter(pa.compute.equal(blocks["block"], b))) for b in range(5)])
        rows = [{"part": 0, "slice": 0, "iy": y, "nx": 16, "blocks": [r for r in done.to_pylist() if r["iy"] == y]} for y in range(8)]
        out = pa.Table.from_batches(wavenumber._blocks_to_rows([pa.RecordBatch.from_pylist(rows)]))
        assert np.allclose(np.array(out["row"].to_pylist()), filtered(image, 30, 40))
    finally:
        wavenumber.BLOCK = old


def test_filters_along_traces_keep_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(c, t, None if t == 4 else rng.normal(size=37).tolist(), f"{c}-{t}", None if c == 1 else c) for c in (0, 1, 2) for t in range(11)]
    df = spark.createDataFrame(rows, "channel int, trace int, amp array<double>, note string, also int")
    kernel = spectral.k_highpass(0.02, 3.0)
    got = {r["note"]: r for r in wavenumber.along_traces(df, ["also", "channel"], "trace", kernel, width=5).collect()}
    assert len(got) == 33 and df.columns == wavenumber.along_traces(df, "channel", "trace", kernel).columns
    for c in (0, 1, 2):
        block = np.array([np.full(37, np.nan) if r[2] is None else r[2] for r in rows if r[0] == c])
        want = kernel(block)
        for t in range(11):
            r = got[f"{c}-{t}"]
            assert (r["channel"], r["trace"]) == (c, t) and (r["amp"] is None if t == 4 else np.allclose(r["amp"], want[t]))


@pytest.mark.parametrize("tile", [2, 5, None])
@pytest.mark.parametrize("relief", [False, True])
def test_migration_by_tiles_is_the_plain_sum(spark, tile, relief):
    rng = np.random.default_rng(6)
    dx, dt, v, aperture, dz, nz, ns = 0.2, 0.5, 0.1, 80.0, 0.05, 12, 24
    rows = [(x, y, rng.normal(size=ns - x % 3).tolist(), None if (x, y) == (2, 2) else float(rng.integers(0, 5)) * 0.05) for x in range(-4, 5) for y in range(3, 10) if rng.random() < 0.8] + [(0, 5, rng.normal(size=ns).tolist(), 0.1)]
    df = spark.createDataFrame(rows, "ix int, iy int, amp array<double>, h double")
    got = {(r["ix"], r["iy"]): r["amp"] for r in kernels.migrate(df, dx, dt, v, aperture, dz, nz, height="h" if relief else None, ns=ns if relief else None, tile=tile).collect()}
    top, half = max(r[3] for r in rows if r[3] is not None), np.radians(aperture / 2)
    depth = lambda r: 0.0 if not relief or r[3] is None else top - r[3]
    cells = {}
    for r in rows:
        cells.setdefault(r[:2], r)
    checked = 0
    for (x, y), cell in cells.items():
        if (x, y) == (0, 5) and relief:
            continue  # two heights of one cell: either may be its surface
        for k in range(nz):
            s = n = 0
            for r in rows:
                d, z = dx * np.hypot(r[0] - x, r[1] - y), k * dz - depth(r)
                way = np.hypot(d, z)
                far = ns * dt * v / 2 if relief else nz * dz * np.tan(half)
                if d > far + 1e-12 or k < int(depth(cell) / dz + 0.5):
                    continue
                if relief:
                    rise = depth(cell) - depth(r)
                    angle = 0.0 if d == 0 else np.pi / 2 - np.arccos(np.clip((d * d + z * rise) / (way * np.hypot(d, rise)), -1, 1))
                else:
                    angle = np.arctan2(d, z)
                at = int(2 * way / v / dt + 0.5)
                if angle < half and at < len(r[2]):
                    s, n = s + r[2][at] * (0.5 - 0.5 * np.cos(angle / half * np.pi)), n + 1
            assert np.isclose(got[(x, y)][k], s / n if n else 0), (x, y, k)
            checked += n > 0
    assert checked > 200
