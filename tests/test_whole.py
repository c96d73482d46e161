"""Operators do the whole job."""

import numpy as np

from groundwave.plans import catalogue, recipe


def test_profile_migration_takes_the_whole_aperture(spark):
    rng = np.random.default_rng(2)
    amp = rng.normal(size=(30, 40))
    df = spark.createDataFrame([(1, 1, i, a.tolist()) for i, a in enumerate(amp)], "profile int, channel int, trace int, amp array<double>")
    out = recipe.run(df, "do_migration2d_vz 1\ndx 0.02\nv 0.1\naperture 60", 0.5, 40).collect()
    for r in out:
        for k in range(40):
            s = w = 0.0
            for t in range(30):
                p = np.hypot(k, (t - r["trace"]) * 0.8)
                lean = 1 if p == 0 else k / p
                if lean >= np.cos(np.radians(30)) and int(p + 0.5) < 40:
                    s, w = s + lean * amp[t, int(p + 0.5)], w + lean
            assert np.isclose(r["amp"][k], s / w if w else 0)


def test_section_query_cuts_every_suppliers_line(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["line"] for r in catalogue.QUERIES["section_cut"](spark, folder).select("line").distinct().collect()}
    assert got == {r["s_suppkey"] for r in spark.read.parquet(f"{folder}/supplier.parquet").collect()}


def test_background_is_the_median_if_asked_for(spark):
    amp = np.random.default_rng(4).normal(size=(12, 6)) ** 3
    df = spark.createDataFrame([(1, 1, i, a.tolist()) for i, a in enumerate(amp)], "profile int, channel int, trace int, amp array<double>")
    step = "do_removeMeanMedianTrace 1\nmeanmedian 2\nnumtraces "
    for n in (0, 5):
        for r in recipe.run(df, f"{step}{n}", 0.5, 6).collect():
            i = r["trace"]
            assert np.allclose(r["amp"], amp[i] - np.median(amp[max(0, i - 2) : i + 3] if n else amp, axis=0))


def test_median_background_leaves_nan_out(spark):
    from groundwave.operators import channel

    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, float("nan")]), (1, [8.0, 4.0])], "channel int, amp array<double>")
    got = sorted((r["amp"] for r in channel.remove_median_background(df, ["channel"]).collect()), key=lambda a: a[0])
    assert got[0] == [-2.0, -1.0] and got[2] == [5.0, 1.0] and np.isnan(got[1][1])
