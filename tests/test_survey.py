"""Planning without jobs, tiles that are built again, nearest cells and areas of rectangles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwave.operators import surface, survey
from groundwave.plans import recipe
from groundwave.sources import logs, sinks, tiles

RECIPE = """do_badTraceRemoval 1
minfactor 3
maxfactor 3
do_amplitudeOffset 2
tstart 0
tend 4
do_traceInterpolation 3
gap 9
do_bandpass 4
fstart 100
fend 400
do_Envelope 5
do_crossprofileshift 6
maxshift_cps 2
do_t0CorrectionReferencetrace 7
profile 1
channel 1
trace 2
t0 1
"""


def traces(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(p, c, t, rng.normal(size=32).tolist()) for p in (1, 2) for c in (1, 2) for t in range(1, 7)], "profile int, channel int, trace int, amp array<double>")


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_planning_starts_no_job(spark):
    df = traces(spark)
    out, jobs = jobs_of(spark, "planning", lambda: recipe.run(df, RECIPE, 0.5, 32))
    assert jobs == 0
    assert out.count() == 24
    cells = spark.createDataFrame([(x, y, 0.1 * x, [0.5] * 16) for x in range(4) for y in range(4)], "ix int, iy int, z double, amp array<double>")
    out, jobs = jobs_of(spark, "relief", lambda: recipe.run(cells, "do_TopoMigration3D 1\ndx 0.2\nv 0.1\naperture 60\ndz 0.1", 0.5, 16))
    assert jobs == 0 and {len(r["amp"]) for r in out.collect()} == {4 + 3}


def test_neighbours_share_passes_and_exchanges(spark):
    df = traces(spark)
    text = lambda d: d._jdf.queryExecution().executedPlan().toString()
    windows = "\n".join(RECIPE.splitlines()[:8])
    assert text(recipe.run(df, windows, 0.5, 32)).count("Exchange hashpartitioning") == 1
    passes = "do_bandpass 1\nfstart 100\nfend 400\ndo_Envelope 2\ndo_makeAmpSpec 3"
    plan = text(recipe.run(df, passes, 0.5, 32))
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert recipe.plan(RECIPE)[:3] == [("channel", ["do_badTraceRemoval"]), ("trace", ["do_amplitudeOffset"]), ("channel", ["do_traceInterpolation"])]
    assert recipe.plan(RECIPE)[3] == ("trace", ["do_bandpass", "do_Envelope"])


def test_parameters_come_from_named_steps_only(spark):
    df = traces(spark)
    with pytest.raises(ValueError, match="do_migration2d_vz needs v"):
        recipe.run(df, "do_migration2d_vz 1\naperture 30\ndx 0.1\ndo_TopoMigration3D 0\nv 0.1", 0.5, 32)
    with pytest.raises(ValueError, match="do_khighpass needs dx"):
        recipe.run(df, "do_khighpass 1\nkcutoff 0.1\ndo_TopoMigration3D 0\ndx 0.1", 0.5, 32)
    assert recipe.run(df, "do_khighpass 1\nkcutoff 0.1\ndo_constTraceDist 0\ndist[m] 0.02", 0.5, 32).count() == 24


class Stopped(Exception):
    pass


def test_a_stopped_build_goes_on(spark, tmp_path):
    size, folder = 4, f"file://{tmp_path}/cube"
    source = spark.range(30 * 22).select((F.col("id") % 30 - 7).alias("ix"), F.floor(F.col("id") / 30).alias("iy"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("amp")).where("ix < 9 or iy > 3")
    places = source.select("ix", "iy").unionByName(spark.createDataFrame([(None, 3), (100, 100)], "ix long, iy long"))
    made, stop = [], [3]

    def make(todo):
        if len(made) == stop[0]:
            raise Stopped
        made.append({(r["tx"], r["ty"]) for r in todo.collect()})
        return tiles.with_tiles(source, size).join(todo, ["tx", "ty"], "left_semi").drop("tx", "ty")

    with pytest.raises(Stopped):
        tiles.build(places, make, folder, size, batches=6)
    first = set().union(*made)
    seen = {(r["ix"] // size, r["iy"] // size) for r in tiles.read(spark, folder, size).collect()}
    assert seen and seen <= first and len(made) == 3
    # a tile that was written but not entered is not seen, and is replaced
    late = spark.createDataFrame([(1, 5, [9.0], 0, 1)], "ix long, iy long, amp array<double>, tx long, ty long")
    if (0, 1) not in first:
        late.write.mode("append").partitionBy("tx", "ty").parquet(f"{folder}/data")
    stop[0] = 99
    assert tiles.build(places, make, folder, size, batches=6) > 0 and not set().union(*made[3:]) & first
    key = lambda df: sorted((r["ix"], r["iy"], tuple(r["amp"])) for r in df.collect())
    assert key(tiles.read(spark, folder, size)) == key(source)
    assert tiles.build(places, make, folder, size) == 0
    part = tiles.read(spark, folder, size, (1, 2, 6, 7))
    assert key(part) == key(source.where("ix between 1 and 6 and iy between 2 and 7"))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tx" in plan and "tx#" in plan.split("PartitionFilters")[1].split("]")[0]


def test_an_empty_store(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert tiles.read(spark, folder).count() == 0 and tiles.finished(spark, folder).count() == 0
    assert tiles.build(spark.createDataFrame([], "ix long, iy long"), lambda t: t, folder) == 0


@pytest.mark.parametrize(("seed", "tile"), [(1, 2), (2, 3), (3, 16)])
def test_nearest_equals_brute_force(spark, seed, tile):
    rng = random.Random(seed)
    valid = {(rng.randint(-20, 20), rng.randint(0, 12)): rng.random() for _ in range(60)} | {(x, y): float(x + y) for x in range(30, 36) for y in range(30, 36)}
    missing = [(rng.randint(-60, 60), rng.randint(-40, 70)) for _ in range(150)]
    rows = [(x, y, v) for (x, y), v in valid.items()] + [(500, 500, None)]
    got = {(r["ix"], r["iy"]): (r["v"], r["d"]) for r in surface.nearest(spark.createDataFrame(missing, "ix int, iy int"), spark.createDataFrame(rows, "ix int, iy int, v double"), tile=tile).collect()}
    assert len(got) == len(set(missing))
    for x, y in missing:
        d, ny, nx = min(((x - a) ** 2 + (y - b) ** 2, b, a) for a, b in valid)
        assert got[(x, y)] == (valid[(nx, ny)], math.sqrt(d))
    assert surface.nearest(spark.createDataFrame(missing, "ix int, iy int"), spark.createDataFrame([], "ix int, iy int, v double")).count() == 0


def test_positions_of_pulses_are_written_and_read_back(spark, tmp_path):
    clock = spark.createDataFrame([(f, t, t * 100 + 7, t % 10 == 4) for f in (1, 2) for t in range(1, 200)], "profile int, trace int, cu_ms int, pulse boolean")
    fixes = spark.createDataFrame([(f, t, t * 100, float(t), 2.0 * t, 5.0) for f in (1, 3) for t in range(1, 200) if t % 7], "profile int, trace int, pos_ms int, x double, y double, z double")
    out = survey.pps_positions(clock, fixes, 11)
    rows = out.collect()
    # a pulse on trace 4 belongs to the row of 0 ms on trace 10, or to that of 98 to 102 ms on 11 where 10 has no fix: 600 ms
    assert {r["profile"] for r in rows} == {1} and len(rows) == 171
    assert all(math.isclose(r["x"], r["trace"] + 6) and math.isclose(r["y"], 2 * r["trace"] + 12) and r["z"] == 5 for r in rows)
    sinks.write_lists(out, f"file://{tmp_path}", "profile", "trace", ["trace", "x", "y", "z"]).collect()
    back = logs.read_list(spark, f"{tmp_path}/*.pos", "pos").collect()
    assert sorted((r["trace"], r["x"], r["y"], r["z"]) for r in back) == sorted((float(r["trace"]), round(r["x"], 4), round(r["y"], 4), r["z"]) for r in rows)


def test_coherence_by_tiles(spark):
    from groundwave.operators import grid

    rng = np.random.default_rng(4)
    have = {(x, y): rng.normal(size=30) for x in range(-5, 9) for y in range(7) if rng.random() < 0.7} | {(50, 50): rng.normal(size=30), (60, 60): np.ones(30), (61, 60): rng.normal(size=30)}
    df = spark.createDataFrame([(x, y, a.tolist()) for (x, y), a in have.items()], "ix int, iy int, amp array<double>")
    got = {(r["ix"], r["iy"]): r["amp"] for r in grid.coherence_cube(df, 0.5, tile=3).collect()}
    beside = lambda x, y: [have[c] for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if c in have]
    assert got.keys() == {c for c in have if beside(*c)}
    for (x, y), out in got.items():
        for k in range(30):
            a = k - 3  # five steps, six samples; the later of the two in the middle
            r = [1 - np.corrcoef(have[(x, y)][a : a + 6], b[a : a + 6])[0, 1] for b in beside(x, y) if a >= 0 and a + 6 <= 30 and have[(x, y)].std() and b.std()]
            assert out[k] is None if not r else np.isclose(out[k], np.mean(r)), (x, y, k)


def test_heights_of_an_area_and_of_lines(spark):
    points = spark.createDataFrame([(0.5, 0.5, 1.0), (4.5, 0.5, 5.0), (0.5, 4.5, 9.0), (0.7, 0.6, 3.0), (2.0, None, 8.0), (1.0, 1.0, None)], "x double, y double, z double")
    asked = spark.createDataFrame([(1, 0.1, 0.2, 7.0), (2, 1.5, 1.5, 7.0), (3, 90.0, 0.5, 7.0), (4, -3.0, 6.0, 7.0), (5, None, 1.0, 7.0)], "k int, x double, y double, z double")
    got = {r["k"]: r["z"] for r in surface.area_topography(points, asked, 1.0, 6.0).collect()}
    assert got[1] == 2.0 and math.isclose(got[2], 2 + 0.75 + 1.75) and got[3] == 5.0 and got[4] == 9.0 and got[5] is None
    lines = spark.createDataFrame([(1, 0.0, 1.0), (1, 10.0, 2.0), (1, 10.0, 4.0), (2, 0.0, 0.0), (None, 1.0, 6.0)], "p int, s double, z double")
    places = spark.createDataFrame([(1, 1, 5.0), (2, 1, 10.0), (3, 1, 11.0), (4, 2, 0.0), (5, 3, 1.0), (6, 1, None)], "k int, p int, s double")
    assert {r["k"]: r["z"] for r in surface.line_topography(lines, places, "p", "s").collect()} == {1: 2.0, 2: 3.0, 3: None, 4: 0.0, 5: None, 6: None}


def test_shifts_of_profiles_are_stored_and_used(spark, tmp_path):
    base = np.exp(-((np.arange(40) - 15.0) ** 2) / 6)
    df = spark.createDataFrame([(p, 1, t, np.roll(base, 2 * p).tolist()) for p in (1, 2, 3) for t in (1, 2)], "profile int, channel int, trace int, amp array<double>")
    text = "do_crossprofileshift 1\nmaxshift_cps 6"
    sinks.write_lists(recipe.found_shifts(df, 6).withColumn("all", F.lit("shifts")), f"file://{tmp_path}", "all", "profile", ["profile", "shift"], suffix=".txt").collect()
    assert (tmp_path / "shifts.txt").read_text() == "1\t0\n2\t-2\n3\t-4\n"
    key = lambda out: sorted((r["profile"], r["trace"], tuple(r["amp"])) for r in out.collect())
    again = recipe.run(df, f"{text}\nshiftfile {tmp_path}/shifts.txt", 0.5, 40)
    assert key(again) == key(recipe.run(df, text, 0.5, 40)) and {int(np.argmax(a)) for _, _, a in key(again)} == {17}


def test_pulses_of_a_control_units_log(spark, tmp_path):
    rows = np.zeros(6, logs._CPDT)
    rows["trace"], rows["cu"] = [1, 2, 0, 3, 4, -1], [100, 1024, 5, 2048, 3072, 9]
    (tmp_path / "a.cpdt").write_bytes(b"\0" * 16 + rows.tobytes())
    (tmp_path / "b.cpdt").write_bytes(b"\0" * 10)
    got = [tuple(r)[1:] for r in logs.read_clock(spark, str(tmp_path)).collect()]
    assert got == [(1, 0, False), (2, 20, False), (3, 1020, True), (4, 2020, False)]
