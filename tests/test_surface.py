"""Surfaces, splines, clusters and position records against analytic cases and brute force."""

import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwave.operators import spectral, surface, velocity
from groundwave.plans import recipe
from groundwave.sources import logs


def plane(x, y):
    return 3.0 + 0.5 * x - 0.25 * y


def test_triangles_are_the_lowest_that_hold_the_cell():
    rng = np.random.default_rng(7)
    places = np.array([(i, j) for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9], float)
    present = rng.random((60, len(places))) < 0.35
    lift = (places**2).sum(1) + 1e-5 * rng.random(present.shape)
    basis, w = surface.triangles(present, lift, places, 3.0)
    for i in range(len(present)):
        best = None
        at = np.flatnonzero(present[i])
        for three in itertools.combinations(at, 3):
            m = np.vstack([places[list(three)].T, np.ones(3)])
            if abs(np.linalg.det(m)) > 1e-9:
                b = np.linalg.solve(m, [0, 0, 1])
                if (b >= -1e-9).all():
                    best = min(best or (np.inf,), (float(b @ lift[i, list(three)]),))
        if any((places[a] == 0).all() for a in at):
            assert [places[b].tolist() for b, x in zip(basis[i], w[i]) if x > 1e-9] == [[0, 0]]
        elif best:
            assert (basis[i][np.abs(w[i]) > 1e-9] < len(places)).all() and np.isclose(w[i] @ np.where(basis[i] < len(places), lift[i, np.minimum(basis[i], len(places) - 1)], 0), best[0])
        else:
            assert ((basis[i] >= len(places)) & (w[i] > 1e-9)).any() or len(at) == 2


@pytest.fixture(scope="module")
def holes(spark):
    """A plane over 150 x 9 cells, across tiles and negative places, with holes."""
    rows = [(ix, iy, plane(ix, iy)) for ix in range(-75, 75) for iy in range(-4, 5) if (ix * ix + 3 * iy) % 4]
    return spark.createDataFrame(rows, "ix long, iy long, v double")


def test_linear_filling_keeps_a_plane_across_tiles(spark, holes):
    missing = surface.gaps(holes, 2.0)
    got = {(r.ix, r.iy): r.v for r in surface.linear(missing, holes, 2.5).collect()}
    assert got and all(np.isclose(v, plane(*at)) for at, v in got.items())
    inner = {(r.ix, r.iy) for r in missing.where("ix between -72 and 71 and iy between -2 and 2").collect()}
    assert inner and inner <= set(got)
    assert surface.linear(missing, holes.limit(0), 2.5).count() == 0


def test_traces_are_filled_like_values(spark, holes):
    cells = holes.where("ix between -5 and 5").select("ix", "iy", F.array("v", F.col("v") * 2).alias("amp"))
    for step, extra in (("do_linearInterpolation", ""), ("do_IDW_Interpolation", "power 2")):
        out = recipe.run(cells, f"{step} 1\nradius 2.5\n{extra}", 0.5, 2).collect()
        assert len({(r.ix, r.iy) for r in out}) == len(out) > cells.count()
        assert all(np.isclose(r.amp[1], 2 * r.amp[0]) for r in out)


def test_smooth_topography_of_a_plane(spark):
    rows = [(i % 7, i, x / 2.0, y / 2.0, plane(x / 2.0, y / 2.0)) for i, (x, y) in enumerate(itertools.product(range(24), range(24)))]
    points = spark.createDataFrame(rows, "profile long, nr long, x double, y double, z double")
    out = surface.smooth_topography(points, "profile", "nr", 1.0, 2.0).join(points.withColumnRenamed("z", "want").withColumnRenamed("nr", "k"), ["profile", "k"])
    inner = out.where("x between 3 and 8 and y between 3 and 8").collect()
    # a cell's mean is that of its four points, a quarter of a step beside its centre
    assert inner and all(abs(r.z - r.want - (plane(-0.25, -0.25) - plane(0, 0))) < 1e-9 for r in inner)


def test_spline_keeps_cubics_and_samples(spark):
    f = lambda t: 2 + t - 0.3 * t**2 + 0.01 * t**3
    for ns in (3, 4, 20):
        block = f(np.arange(ns))[None] if ns > 3 else np.arange(ns)[None] ** 2.0
        out = spectral.spline(ns, 0.25)(block)[0]
        t = np.arange(len(out)) * 0.25
        assert len(out) == 4 * (ns - 1) + 1 and np.allclose(out, f(t) if ns > 3 else t**2)
    traces = spark.createDataFrame([(1, 1, 1, [float(f(t)) for t in range(12)])], "profile int, channel int, trace int, amp array<double>")
    out = recipe.run(traces, "do_reduceNumberOfSamples 1\nn 0.5\ndo_cutTWT 2\ntmax 1", 1.0, 12).first()
    assert np.allclose(out.amp, [f(0), f(0.5), f(1)])


def test_density_clusters_match_their_definition():
    points = np.array([[0, 0], [1, 0], [2, 0], [3.5, 0], [10, 0], [11, 0], [12, 0], [30, 0]])
    assert velocity.density_clusters(points, 1.5, 3).tolist() == [0, 0, 0, 0, 1, 1, 1, -1]
    assert velocity.density_clusters(points[:1], 1.5, 1).tolist() == [0]


def test_migration_gathers_a_hyperbola(spark):
    dx, dt, v, k0, ns = 0.05, 0.5, 0.1, 20, 64
    rows = []
    for i in range(-15, 16):
        amp = [0.0] * ns
        amp[round(np.hypot(k0, 2 * i * dx / (v * dt)))] = 1.0
        rows.append((1, 1, i + 16, amp))
    traces = spark.createDataFrame(rows, "profile int, channel int, trace int, amp array<double>")
    out = {r.trace: r.amp for r in recipe.run(traces, f"do_migration2d_vz 1\ndx {dx}\nv {v}\naperture 90\nreach 15", dt, ns).collect()}
    assert np.isclose(out[16][k0], 1.0) and max(max(a) for t, a in out.items() if abs(t - 16) > 3) < 0.5


def test_position_and_wheel_records(spark, tmp_path):
    head = struct.pack("<8h", 1, 2024, 5, 6, 7, 8, 9, 0)
    records = b"".join(struct.pack("<i3d8H", n, 1.0, 2.0, 3.0, 10, 20, 30, ms, 10, 20, 31, 4) for n, ms in ((0, 5), (1, 0), (2, 250)))
    (tmp_path / "a_1_001.cpss").write_bytes(head + records + b"part")
    wheel = b"".join(struct.pack(">h2xh10xh3x", n, 7 * n, 512 * n) + struct.pack("<2iB2x", 10, 20, 30) for n in (0, 1, 2))
    (tmp_path / "a_1.cpdt").write_bytes(head + wheel)
    got = [(r.trace, r.pos_ms, r.pc_ms, r.ms, r.status) for r in logs.read_cpss(spark, str(tmp_path)).orderBy("trace").collect()]
    t = (10 * 3600 + 20 * 60) * 1000
    assert got == [(1, t + 30_000, t + 31_000, 0, 4), (2, t + 30_250, t + 31_000, 250, 4)]
    got = [(r.trace, r.cu_ms, r.pc_ms, r.wheel) for r in logs.read_cpdt(spark, str(tmp_path)).orderBy("trace").collect()]
    assert got == [(1, 500, t + 30_000, 7), (2, 1000, t + 30_000, 14)]
