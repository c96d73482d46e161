"""Queries on recipes, cleaned positions, masks and parts of blocks, each with its SQL; tables as in the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import channel, grid, kernels, placing, position, track, velocity
from . import recipe
from .catalogue import _MEDIAN, _PART, _STATIONS, CELLS, DT, NS, SUMS, E, T, _grid, cells, query, stations, sums, table, traces, tracks

RECIPE = """do_amplitudeOffset 1
tstart[ns] 5
tend[ns] 20

do_removeMeanMedianTrace 2
meanmedian 1
numtraces 0

do_normalization 4
qclip 0.98

do_cutTWT 3
tmax[ns] 20

do_migration2d_vz 0
v-file[m/ns] vgrid.mat
"""


@query(T + f""", o AS (SELECT vec_id, channel, k, amp[k] - list_avg(amp[11:41]) AS v FROM traces, range(1, 65) r(k)),
b AS (SELECT vec_id, k, v - avg(v) OVER (PARTITION BY channel, k) AS v FROM o), c AS (SELECT vec_id, list(v ORDER BY k) AS amp FROM b WHERE k <= 41 GROUP BY vec_id),
x AS (SELECT vec_id, list_transform(amp, lambda x: coalesce(x / nullif(list_sort(list_transform(amp, lambda y: abs(y)))[41], 0), 0)) AS a FROM c) SELECT vec_id, {SUMS} FROM x""")
def recipe_run(spark, d):
    return recipe.run(traces(spark, d).withColumn("profile", F.lit(1)), RECIPE, DT, NS).select("vec_id", *sums())


_PADDED = ", ".join(["coalesce(lag({c}, 2) OVER w, 0)", "coalesce(lag({c}, 1) OVER w, 0)", "{c}", "coalesce(lead({c}, 1) OVER w, 0)", "coalesce(lead({c}, 2) OVER w, 0)"])


@query(E + f""", m AS (SELECT user_id, nr, x, y, CASE WHEN lag(x) OVER w IS NULL THEN x ELSE list_sort([{_PADDED.format(c="x")}])[3] END AS mx, CASE WHEN lag(y) OVER w IS NULL THEN y ELSE list_sort([{_PADDED.format(c="y")}])[3] END AS my
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY nr)),
r AS (SELECT *, sqrt((x - mx) ** 2 + (y - my) ** 2) AS r FROM m), b AS (SELECT *, r >= 3 * avg(r) OVER (PARTITION BY user_id) AS bad FROM r),
g AS (SELECT user_id, nr, x, y, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lead(x) OVER w AS hx, lead(y) OVER w AS hy FROM b WHERE NOT bad WINDOW w AS (PARTITION BY user_id ORDER BY nr)),
p AS (SELECT b.user_id, b.nr, b.bad, b.x, b.y, p.x AS px, p.y AS py, p.lx, p.ly, q.x AS qx, q.y AS qy, q.hx, q.hy FROM b ASOF LEFT JOIN g p ON b.user_id = p.user_id AND b.nr > p.nr ASOF LEFT JOIN g q ON b.user_id = q.user_id AND b.nr < q.nr)
SELECT user_id, nr, bad AS outlier, round(CASE WHEN NOT bad THEN x WHEN px IS NULL THEN qx - coalesce(hx - qx, 0) / 2 WHEN qx IS NULL THEN px + coalesce(px - lx, 0) / 2 ELSE (px + qx) / 2 END + 1e-8, 6) AS x,
  round(CASE WHEN NOT bad THEN y WHEN py IS NULL THEN qy - coalesce(hy - qy, 0) / 2 WHEN qy IS NULL THEN py + coalesce(py - ly, 0) / 2 ELSE (py + qy) / 2 END + 1e-8, 6) AS y FROM p""")
def outlier_replaced(spark, d):
    out = track.replaced_outliers(tracks(spark, d), "user_id", "nr", ("x", "y"), 5)
    return out.select("user_id", "nr", "outlier", *[F.round(F.col(c) + 1e-8, 6).alias(c) for c in ("x", "y")])


@query(E + _MEDIAN + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY nr) AS n, CASE WHEN abs(x - med) <= 40 THEN med END AS v FROM m),
k AS (SELECT user_id, n, v FROM r WHERE v IS NOT NULL),
p AS (SELECT r.user_id, r.nr, r.n, r.v, a.n AS n0, a.v AS v0, b.n AS n1, b.v AS v1 FROM r ASOF LEFT JOIN k a ON r.user_id = a.user_id AND r.n >= a.n ASOF LEFT JOIN k b ON r.user_id = b.user_id AND r.n <= b.n)
SELECT user_id, nr, v IS NULL AS outlier, round(coalesce(v, v0 + (v1 - v0) * ((n - n0) / (n1 - n0)::DOUBLE)) + 1e-8, 6) AS x FROM p""")
def outlier_limit(spark, d):
    out = track.outliers(tracks(spark, d), "user_id", "nr", "x", 2, limit=40.0, replace=True)
    return out.select("user_id", "nr", "outlier", F.round(F.col("x") + 1e-8, 6).alias("x"))


_TEN = ", ".join([f"coalesce(lag(x, {k}) OVER w, first_value(x) OVER f)" for k in range(5, 0, -1)] + ["x"] + [f"coalesce(lead(x, {k}) OVER w, last_value(x) OVER f)" for k in range(1, 6)])


@query(E + _MEDIAN + f""", g AS (SELECT user_id, nr, med AS x FROM m), s AS (SELECT user_id, nr, list_sort([{_TEN}])[6] AS x FROM g
  WINDOW w AS (PARTITION BY user_id ORDER BY nr), f AS (PARTITION BY user_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT user_id, nr, round(x, 6) AS x FROM s""")
def movmedian_twice(spark, d):
    return track.twice_smoothed(tracks(spark, d), "user_id", "nr", "x", 5).select("user_id", "nr", F.round("x", 6).alias("x"))


@query(E + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY nr) AS n FROM e), f AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY nr) AS g FROM n WHERE x > 50),
r AS (SELECT user_id, min(n) AS first, max(n) AS last, count(*) AS n FROM f GROUP BY user_id, g)
SELECT user_id, first, last, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM r) WHERE k = 1""")
def longest_run(spark, d):
    out = track.longest(track.islands(tracks(spark, d), "user_id", "nr", F.col("x") > 50), "user_id")
    return out.select("user_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n")


@query("SELECT o_custkey, c_nationkey::BIGINT AS area, o.k AS k, o.v AS v FROM customer JOIN (SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS k, min_by(o_totalprice, o_orderkey) AS v FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
def match_first(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("area"))
    right = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return track.first_matches(left, right, ["o_custkey"], "k")


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM events GROUP BY user_id ORDER BY min(ts), user_id")
def files_by_start(spark, d):
    starts = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("start")).orderBy("start", "user_id")
    return starts.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


_HOLES = "WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey * 37 % 1000) / 10.0 END AS x, CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 91 % 777) / 10.0 END AS y FROM customer)"


@query(_HOLES + " SELECT c_custkey, x::DOUBLE AS x, y::DOUBLE AS y FROM p WHERE x IS NOT NULL AND y IS NOT NULL")
def known_places(spark, d):
    p = stations(spark, d)
    x = F.when(F.col("c_custkey") % 7 != 0, F.col("x").cast("double"))
    y = F.when(F.col("c_custkey") % 11 != 0, F.col("y").cast("double")).otherwise(F.lit(float("nan")))
    return grid.without_places(p.select("c_custkey", x.alias("x"), y.alias("y")), "x", "y")


@query(_PART + " SELECT ix, iy, round(CASE WHEN (ix + iy) % 3 <> 0 THEN v END, 6) AS v FROM g")
def mask_apply(spark, d):
    rows = grid.masked(_grid(spark, d).withColumn("mask", ((F.col("ix") + F.col("iy")) % 3 != 0).cast("int")), "mask", "v")
    return rows.select("ix", "iy", F.round("v", 6).alias("v"))


@query(_PART + """, f AS (SELECT ix, iy FROM g WHERE (ix * 7 + iy * 3) % 11 = 0), c AS (SELECT f.ix + i AS ix, f.iy + j AS iy, (4 * least(abs(i), abs(j)) + 3 * abs(abs(i) - abs(j))) / 4.0 AS d FROM f, range(-4, 5) a(i), range(-4, 5) b(j))
SELECT 0::BIGINT AS slice, ix, iy FROM c WHERE d <= 2 GROUP BY ix, iy""")
def interpolation_mask(spark, d):
    rows = _grid(spark, d).select(F.lit(0).cast("long").alias("slice"), "ix", "iy").where("(ix * 7 + iy * 3) % 11 = 0")
    return kernels.interpolation_mask(rows, 2.0)


@query(CELLS + " SELECT ix, iy, k - 1 AS slice, round(v, 6) + 0.0::DOUBLE AS v FROM cells WHERE k BETWEEN 1 AND 63")
def slice_value(spark, d):
    out = grid.slices(cells(spark, d), ["ix", "iy"], DT, grid.slice_table(DT, 0, 31.5), "value")
    return out.select("ix", "iy", F.col("slice").cast("long").alias("slice"), (F.round("v", 6) + 0.0).alias("v"))


@query(CELLS + " SELECT ix, iy, k - 1 AS slice, round(abs(v), 6) AS v FROM cells WHERE k BETWEEN 1 AND 63")
def slice_absolute(spark, d):
    out = grid.slices(cells(spark, d), ["ix", "iy"], DT, grid.slice_table(DT, 0, 31.5), "absolute")
    return out.select("ix", "iy", F.col("slice").cast("long").alias("slice"), F.round("v", 6).alias("v"))


@query(_STATIONS + """, l AS (SELECT c_custkey AS k, x AS x1, y AS y1, x + 3 + c_custkey % 4 AS x2, y + c_custkey % 5 - 2 AS y2 FROM p),
c AS (SELECT *, (x2 - x1) * (4.0 - 10.0) - (y2 - y1) * (90.0 - 5.0) AS c, (5.0 - x1) * (4.0 - 10.0) - (10.0 - y1) * (90.0 - 5.0) AS t FROM l)
SELECT k, round((x1 + t / nullif(c, 0)::DOUBLE * (x2 - x1))::DOUBLE + 1e-8, 6) AS x, round((y1 + t / nullif(c, 0)::DOUBLE * (y2 - y1))::DOUBLE + 1e-8, 6) AS y FROM c""")
def line_crossing(spark, d):
    p, n = stations(spark, d), F.col("c_custkey")
    one = (F.col("x").cast("double"), F.col("y").cast("double"), F.col("x") + 3.0 + n % 4, F.col("y") + n % 5 - 2.0)
    x, y = grid.line_crossing(one, (F.lit(5.0), F.lit(10.0), F.lit(90.0), F.lit(4.0)))
    return p.select(n.alias("k"), F.round(x + 1e-8, 6).alias("x"), F.round(y + 1e-8, 6).alias("y"))


@query(_STATIONS + """, u AS (SELECT x * cos(radians(30)) - y * sin(radians(30)) AS u, x * sin(radians(30)) + y * cos(radians(30)) AS v, c_custkey FROM p),
b AS (SELECT CASE WHEN u = 52.5 THEN 11 ELSE floor((u + 7.5) / 5) END::BIGINT AS ix, CASE WHEN v = 72.5 THEN 13 ELSE floor((v - 2.5) / 5) END::BIGINT AS iy, c_custkey FROM u WHERE u BETWEEN -7.5 AND 52.5 AND v BETWEEN 2.5 AND 72.5)
SELECT ix, iy, count(*) AS n, round(avg(c_custkey), 6) AS v FROM b GROUP BY ALL""")
def sub_block(spark, d):
    """Stations of a rectangle in a turned system, in its bins of 5 m, whose middles begin at the corner (-5, 5)."""
    u, v = geo.rotate(F.col("x"), F.col("y"), 30)
    rows = grid.binned(stations(spark, d), u, v, (-7.5, 5, 12), (2.5, 5, 14))
    return rows.groupBy(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy")).agg(F.count("*").alias("n"), F.round(F.avg("c_custkey"), 6).alias("v"))


@query(E + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY nr) - 1 AS n, count(*) OVER (PARTITION BY user_id) - 1 AS c FROM e)
SELECT user_id, nr, round(x + CASE WHEN user_id % 2 = 1 THEN 3 * coalesce(n / nullif(c, 0)::DOUBLE, 0) ELSE 0 END + 1e-8, 6) AS x, round(y - CASE WHEN user_id % 2 = 1 THEN 0.5 * coalesce(n / nullif(c, 0)::DOUBLE, 0) ELSE 0 END + 1e-8, 6) AS y FROM n""")
def moved_profiles(spark, d):
    out = position.moved_profiles(tracks(spark, d), "user_id", "nr", 3.0, -0.5, "odd", rising=True)
    return out.select("user_id", "nr", *[F.round(F.col(c) + 1e-8, 6).alias(c) for c in ("x", "y")])


@query(E + """, n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY nr) AS place, CASE WHEN nr % 4 = 1 THEN x END AS v FROM e), k AS (SELECT *, lag(v) OVER w AS lv, lag(place) OVER w AS la, lead(v) OVER w AS hv, lead(place) OVER w AS ha FROM n WHERE v IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY place)),
p AS (SELECT n.user_id, n.place, n.v, a.v AS v0, a.place AS x0, a.lv, a.la, b.v AS v1, b.place AS x1, b.hv, b.ha FROM n ASOF LEFT JOIN k a ON n.user_id = a.user_id AND n.place >= a.place ASOF LEFT JOIN k b ON n.user_id = b.user_id AND n.place <= b.place)
SELECT user_id, place, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 + coalesce((hv - v1) * ((place - x1) / (ha - x1)::DOUBLE), 0) WHEN v1 IS NULL THEN v0 + coalesce((v0 - lv) * ((place - x0) / (x0 - la)::DOUBLE), 0) ELSE v0 + (v1 - v0) * ((place - x0) / (x1 - x0)::DOUBLE) END + 1e-8, 5) AS v FROM p""")
def line_beyond_ends(spark, d):
    from pyspark.sql import Window as W

    rows = tracks(spark, d).select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("nr")).cast("long").alias("place"), F.when(F.col("nr") % 4 == 1, F.col("x")).alias("v"))
    return track.interpolate(rows, "user_id", "place", "v", edges="line").withColumn("v", F.round(F.col("v") + 1e-8, 5))


_FIXES = T + """, f AS (SELECT event_id % 3 AS profile, event_id % 30 * 2 + event_id % 3 AS trace, avg(value) AS x, avg(event_id * 13 % 101 / 10.0) AS y, avg(event_id % 7) AS z FROM events GROUP BY ALL),
c AS (SELECT channel % 3 AS profile, channel, trace, vec_id FROM traces), k AS (SELECT *, lag(trace) OVER w AS lt, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lag(z) OVER w AS lz, lead(trace) OVER w AS ht, lead(x) OVER w AS hx, lead(y) OVER w AS hy, lead(z) OVER w AS hz FROM f WINDOW w AS (PARTITION BY profile ORDER BY trace)),
p AS (SELECT c.*, a.trace AS t0, a.x AS x0, a.y AS y0, a.z AS z0, b.trace AS t1, b.x AS x1, b.y AS y1, b.z AS z1 FROM c ASOF LEFT JOIN f a ON c.profile = a.profile AND c.trace >= a.trace ASOF LEFT JOIN f b ON c.profile = b.profile AND c.trace <= b.trace),
q AS (SELECT vec_id, profile, channel, trace, x0 + (x1 - x0) * coalesce((trace - t0) / nullif(t1 - t0, 0)::DOUBLE, 0) AS x, y0 + (y1 - y0) * coalesce((trace - t0) / nullif(t1 - t0, 0)::DOUBLE, 0) AS y, z0 + (z1 - z0) * coalesce((trace - t0) / nullif(t1 - t0, 0)::DOUBLE, 0) AS z
  FROM p WHERE t0 IS NOT NULL AND t1 IS NOT NULL)"""


def _placed(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    fixes = e.select((n % 3).alias("profile"), (n % 30 * 2 + n % 3).alias("trace"), F.col("value").alias("x"), (n * 13 % 101 / 10.0).alias("y"), (n % 7).cast("double").alias("z"))
    return placing.place(traces(spark, d).withColumn("profile", F.col("channel") % 3), fixes)


@query(_FIXES + " SELECT vec_id, profile, round(x + 1e-8, 5) AS x, round(y + 1e-8, 5) AS y, round(z + 1e-8, 5) AS z FROM q")
def place_traces(spark, d):
    return _placed(spark, d).select("vec_id", "profile", *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in ("x", "y", "z")])


@query(_FIXES + """, d AS (SELECT *, coalesce(lead(x, 15) OVER w, last_value(x) OVER f) - x AS dx, coalesce(lead(y, 15) OVER w, last_value(y) OVER f) - y AS dy, lead(x) OVER w IS NULL AS last, channel * 0.1 - 0.4 AS a, channel * 0.05 AS l FROM q
  WINDOW w AS (PARTITION BY channel ORDER BY trace), f AS (PARTITION BY channel ORDER BY trace ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
o AS (SELECT *, coalesce(dx / nullif(sqrt(dx * dx + dy * dy), 0), 0) AS u, coalesce(dy / nullif(sqrt(dx * dx + dy * dy), 0), 0) AS v FROM d), m AS (SELECT *, x + l * u + a * v AS nx, y + l * v - a * u AS ny FROM o)
SELECT vec_id, round(CASE WHEN last THEN coalesce(2 * lag(nx) OVER w - lag(nx, 2) OVER w, nx) ELSE nx END + 1e-8, 5) AS x, round(CASE WHEN last THEN coalesce(2 * lag(ny) OVER w - lag(ny, 2) OVER w, ny) ELSE ny END + 1e-8, 5) AS y FROM m WINDOW w AS (PARTITION BY channel ORDER BY trace)""")
def offset_channels(spark, d):
    c = F.col("channel")
    offsets = traces(spark, d).select("channel").distinct().select("channel", (c * 0.1 - 0.4).alias("across"), (c * 0.05).alias("along"))
    return placing.channel_offsets(_placed(spark, d), offsets).select("vec_id", *[F.round(F.col(k) + 1e-8, 5).alias(k) for k in ("x", "y")])


@query(T + " SELECT vec_id FROM (SELECT vec_id, trace, min(n) OVER (PARTITION BY channel % 3) AS n FROM (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM traces)) WHERE trace <= n")
def common_length(spark, d):
    return placing.common_length(traces(spark, d).withColumn("profile", F.col("channel") % 3)).select("vec_id")


@query(T + f""", m AS (SELECT channel, sum(list_sum(amp)) / sum(len(amp)) AS m FROM traces GROUP BY channel), x AS (SELECT vec_id, list_transform(amp, lambda v: v - m) AS a FROM traces JOIN m USING (channel)) SELECT vec_id, {SUMS} FROM x""")
def overall_mean(spark, d):
    return placing.minus_overall_mean(traces(spark, d), "channel").select("vec_id", *sums())


@query("""WITH o AS (SELECT o_orderkey AS k, (o_orderkey * 2654435761) % 4294967296 AS b FROM orders), p AS (SELECT k, (b >> 25) & 127 AS y, (b >> 21) & 15 AS mo, (b >> 16) & 31 AS d, (b >> 11) & 31 AS h, (b >> 5) & 63 AS mi, (b & 31) * 2 AS s FROM o)
SELECT k, CASE WHEN mo BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND h < 24 AND mi < 60 AND s < 60 THEN epoch(try_strptime(printf('%04d-%02d-%02d %02d:%02d:%02d', y + 1980, mo, d, h, mi, s), '%Y-%m-%d %H:%M:%S'))::BIGINT END AS t FROM p""")
def packed_dates(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("k"), geo.packed_time(k * 2654435761 % 4294967296).alias("t")).select("k", F.unix_timestamp(F.date_format("t", "yyyy-MM-dd HH:mm:ss")).alias("t"))


@query("""WITH t AS (SELECT c_custkey AS k, c_custkey * 7919 % 260000 + 0.25::DOUBLE AS v FROM customer), p AS (SELECT k, floor(v / 10000) AS h, floor(v / 100) % 100 AS m, v - floor(v / 10000) * 10000 - floor(v / 100) % 100 * 100 AS s FROM t)
SELECT k, CASE WHEN h < 24 AND m < 60 AND s < 61 THEN h * 3600 + m * 60 + s END::DOUBLE AS s FROM p""")
def gga_times(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), geo.gga_seconds((k * 7919 % 260000 + 0.25).cast("string")).alias("s"))


@query(T + """, m AS (SELECT channel, k, median(amp[k]) AS m FROM traces, range(1, 65) r(k) GROUP BY ALL)
SELECT vec_id, count(*) AS n, round(sum(amp[k] - m), 6) AS s, round(sum((amp[k] - m) * k), 6) AS w FROM traces JOIN m USING (channel) GROUP BY vec_id""")
def background_median_all(spark, d):
    return channel.remove_median_background(traces(spark, d), ["channel"]).select("vec_id", *sums())


@query(T + """, m AS (SELECT vec_id, k, amp[k] - median(amp[k]) OVER (PARTITION BY channel, k ORDER BY trace ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM traces, range(1, 65) r(k))
SELECT vec_id, count(*) AS n, round(sum(v), 6) AS s, round(sum(v * k), 6) AS w FROM m GROUP BY vec_id""")
def background_median_moving(spark, d):
    return channel.remove_moving_median(traces(spark, d), "channel", "trace", 5).select("vec_id", *sums())


@query()
def c3_velocity(spark, d):
    """A pick on every tenth trace of a channel, at its largest sample between 5 and 25 ns; traces lie 0.02 m apart. Clustering is not SQL: a test holds it."""
    rows = traces(spark, d).withColumn("x", F.col("trace") * 0.02)
    inside = F.slice(F.transform("amp", F.abs), 11, 40)
    at = F.array_position(inside, F.array_max(inside)) + 9
    picks = rows.where("trace % 10 = 5").select(F.col("vec_id").alias("pick"), "channel", "x", (at * DT).cast("double").alias("t"))
    points = velocity.cluster_points(picks, rows, "channel", DT, 0.2, 1.0, 10.0, least=2)
    return velocity.picked_velocities(points).select("pick", *[F.round(c, 6).alias(c) for c in ("x0", "t0", "v")], "n")
