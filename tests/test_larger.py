"""Queries on rows that only larger or odd tables hold, against their SQL in DuckDB."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwave.operators import position
from groundwave.plans import catalogue
from tests.test_catalogue import canonical

LARGE = "/root/testdata/sf0.1"


@pytest.fixture
def differ(spark, tmp_path):
    """The rows of a query over the given tables (name: SQL of its rows) and those of its SQL, as lists that should be equal."""

    def rows(name, **tables):
        con = duckdb.connect()
        for t, sql in tables.items():
            con.execute(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        return canonical(df.select(*columns).collect()), canonical(con.sql(catalogue.ORACLES[name]).select(", ".join(columns)).fetchall())

    return rows


def test_elbows_at_the_edges_of_bins(differ):
    """Tracks with a distance that lies on the edge of a bin but for the last bit of a mean."""
    got, want = differ("hist_elbow", events=f"select * from '{LARGE}/events.parquet' where user_id in (236, 347, 389, 1495) order by event_id")
    assert len(want) > 200 and got == want


def test_points_on_the_edges_of_the_grid(differ):
    """Both last edges, the one of x in the last bin and the one of y in none, and points beside and beyond them."""
    points = [(x, y, round(0.01 * i, 2)) for i, (x, y) in enumerate((x, y) for x in (0, 5, 49.5, 50, 50.5, 55) for y in (-0.01, 0, 5000, 49999.99, 50000, 50000.01, 55000))]
    values = ", ".join(f"({x}::double, {y}::double, {v}::double)" for x, y, v in [*points, ("null", 1.0, 0.5), (1.0, "null", 0.5)])
    got, want = differ("bin_mean_2d", lineitem=f"select * from (values {values}) t(l_quantity, l_extendedprice, l_discount)")
    assert len(want) == 9 and got == want


def test_nearest_markers_on_both_sides_and_without_any(differ):
    """Ties between sides and places, an area without a marker, keys without a place or an area, keys that come twice."""
    rows = "select i::bigint as c_custkey, case when i % 8 = 7 then 3 when i % 11 < 8 then i // 10 % 2 end::int as c_nationkey from range(700) t(i) where i % 8 <> 7 or i % 10 <> 0"
    got, want = differ("nearest_marker", customer=f"{rows} union all select null, 1 union all select 33, 0 union all select 33, 1")
    assert len(want) > 300 and got == want


def test_nearest_marker_compares_no_pairs(spark):
    """20,000 points and 20,000 markers of one group: 4e8 pairs."""
    ids = spark.range(20_000)
    points = ids.select("id", F.lit(1).alias("g"), (F.col("id") * 7919 % 20_011 / 10.0).alias("x"))
    markers = ids.select(F.col("id").alias("marker"), F.lit(1).alias("g"), (F.col("id") * 104_729 % 20_011 / 10.0 + 0.05).alias("x"))
    out = position.nearest_marker(points, markers, "g", "x", "id")
    x, m = (np.array([r[0] for r in t.orderBy(k).select("x").collect()]) for t, k in ((points, "id"), (markers, "marker")))
    got = {r["id"]: (r["marker"], r["dx"]) for r in out.collect()}
    assert len(got) == 20_000
    for i in range(0, 20_000, 97):
        d = np.round(np.abs(x[i] - m), 6)
        assert got[i] == (int(np.flatnonzero(d == d.min())[0]), d.min())


def test_sections_do_not_broadcast_their_points(spark):
    """Lines look small to the planner, the points along them need not be."""
    cells = spark.range(40_000).select((F.col("id") % 200).alias("ix"), F.floor(F.col("id") / 200).alias("iy"), F.array(F.col("id").cast("double")).alias("amp"))
    lines = spark.range(4).select("id", F.lit(0.0).alias("x0"), F.col("id").cast("double").alias("y0"), F.lit(199.0).alias("x1"), F.lit(150.5).alias("y1"))
    for grid in (cells, cells.where("ix < 20").withColumn("amp", F.array_repeat(F.lit(1.0), 600))):  # broadcast, and more than HELD samples
        out = position.section(position.stations(lines, "id", 0.001), "id", grid, smooth=1)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and ("SortMergeJoin" in plan) == (grid is not cells)
    got = position.section(position.stations(lines, "id", 0.001), "id", cells)
    assert got.where("id = 2").select(F.max("k")).first()[0] == int(np.hypot(199, 148.5) / 0.001)


@pytest.mark.parametrize("held", [0, 1 << 21])
def test_sections_with_missing_samples(spark, monkeypatch, held):
    """Against the definition: missing samples do not count, points that miss a cell are left out, short traces end a point's trace."""
    monkeypatch.setattr(position, "HELD", held)
    rng = np.random.default_rng(5)
    grid = {(x, y): [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=6 if y < 6 else 4)] for x in range(8) for y in range(8) if (x, y) not in ((3, 3), (6, 1))}
    points = [(line, k, float(x), float(y)) for line in (1, 2) for k, (x, y) in enumerate(zip(rng.uniform(0, 7.5, 40).round(1), (rng.uniform(0, 5, 40) if line == 1 else np.full(40, 7.0)).round(1), strict=True))]
    want, cut = {}, {}
    for line, k, x, y in points:
        i, j, u, v = int(x), int(y), x - int(x), y - int(y)
        corners = [(c, w) for c, w in (((i, j), (1 - u) * (1 - v)), ((i + 1, j), u * (1 - v)), ((i, j + 1), (1 - u) * v), ((i + 1, j + 1), u * v)) if w > 0]
        if all(c in grid for c, _ in corners):
            found = [[w * grid[c][s] for c, w in corners if grid[c][s] is not None] for s in range(min(len(grid[c]) for c, _ in corners))]
            cut[line, k] = [sum(f) if f else None for f in found]
    for line in (1, 2):
        ks = sorted(k for n, k in cut if n == line)
        for i, k in enumerate(ks):
            near = [cut[line, m] for m in ks[max(0, i - 2) : i + 3]]
            means = [[t[s] for t in near if t[s] is not None] for s in range(len(cut[line, k]))]
            want[line, k] = [sum(m) / len(m) if m else None for m in means]
    cells = spark.createDataFrame([(x, y, a) for (x, y), a in grid.items()] + [(3, 3, None), (6, 1, [])], "ix long, iy long, amp array<double>")
    out = position.section(spark.createDataFrame(points, "line int, k int, x double, y double"), "line", cells, smooth=2)
    got = {(r["line"], r["k"]): r["amp"] for r in out.collect()}
    assert got.keys() == want.keys() and len(got) > 40
    for at, amp in want.items():
        assert len(amp) == len(got[at]) and all((a is None) == (b is None) and (a is None or np.isclose(a, b)) for a, b in zip(amp, got[at], strict=True))
