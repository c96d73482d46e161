"""Queries on velocities, positions, sections and images, each with its SQL; tables as in the catalogue."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import channel, kernels, position, surface, trace, velocity
from .catalogue import _PART, _STATIONS, CELLS, DT, NS, SUMS, E, T, _grid, cells, query, stations, sums, table, traces, tracks


@query(T + """, g AS (SELECT channel, amp, (trace % 12) * 0.02 AS x, v FROM traces, (VALUES (8.0), (10.0), (12.0)) s(v)),
p AS (SELECT channel, v, amp, k, 2 * sqrt((k * 0.5 / 2) * (k * 0.5 / 2) + 4 * x * x / ((v / 100) * (v / 100))::DOUBLE) / 0.5 AS p FROM g, range(0, 64) r(k)),
a AS (SELECT channel, v, k, CASE WHEN p = floor(p) THEN amp[floor(p)::INT + 1] ELSE amp[floor(p)::INT + 1] + (amp[floor(p)::INT + 2] - amp[floor(p)::INT + 1]) * (p - floor(p)) END AS a FROM p),
s AS (SELECT channel, v, k, coalesce(sum(a), 0) AS a, coalesce(sum(a * a), 0) AS b, count(*) AS m FROM a GROUP BY ALL)
SELECT channel, v::DOUBLE AS v, k, round(sum(a * a) OVER w / nullif(m * sum(b) OVER w, 0), 6) AS s FROM s WINDOW w AS (PARTITION BY channel, v ORDER BY k ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""")
def nmo_semblance(spark, d):
    rows = traces(spark, d).withColumn("x", F.col("trace") % 12 * 0.02)
    out = velocity.semblance(rows, "channel", "x", DT, NS, [0.08, 0.1, 0.12])
    return out.select("channel", F.round(F.col("v") * 100, 1).alias("v"), F.col("k").cast("long").alias("k"), F.round("s", 6).alias("s"))


_PANEL = "WITH p AS (SELECT user_id AS g, event_id % 40 AS k, (event_id * 7 % 23)::DOUBLE AS v, max(round(value, 4)) AS s FROM events GROUP BY ALL)"


@query(_PANEL + """, t AS (SELECT g, k, v, CASE WHEN s >= 20 THEN s ELSE 0 END AS s FROM p), n AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b FROM t WINDOW w AS (PARTITION BY g, k ORDER BY v))
SELECT g, k, v, s FROM (SELECT *, row_number() OVER (PARTITION BY g, k ORDER BY s DESC, v) AS r FROM n WHERE s > 0 AND s >= a AND s >= b) WHERE r = 1""")
def velocity_picks(spark, d):
    e = table(spark, d, "events")
    panel = e.groupBy(F.col("user_id").alias("g"), (F.col("event_id") % 40).alias("k"), (F.col("event_id") * 7 % 23).cast("double").alias("v")).agg(F.max(F.round("value", 4)).alias("s"))
    return velocity.picks(panel, "g", 20.0)


@query("""WITH p AS (SELECT user_id, (event_id * 7 % 23)::DOUBLE AS x, value AS y FROM events),
s AS (SELECT user_id, count(*) AS n, count(DISTINCT x) AS c, sum(x) AS s1, sum(x ** 2) AS s2, sum(x ** 3) AS s3, sum(x ** 4) AS s4, sum(y) AS r0, sum(y * x) AS r1, sum(y * x ** 2) AS r2 FROM p GROUP BY user_id),
d AS (SELECT *, CASE WHEN c >= 3 THEN n * (s2 * s4 - s3 * s3) + s1 * (s2 * s3 - s1 * s4) + s2 * (s1 * s3 - s2 * s2) END AS det FROM s)
SELECT user_id, n, round(((s2 * s4 - s3 * s3) * r0 + (s2 * s3 - s1 * s4) * r1 + (s1 * s3 - s2 * s2) * r2) / nullif(det, 0), 5) AS a,
  round(((s2 * s3 - s1 * s4) * r0 + (n * s4 - s2 * s2) * r1 + (s1 * s2 - n * s3) * r2) / nullif(det, 0), 5) AS b,
  round(((s1 * s3 - s2 * s2) * r0 + (s1 * s2 - n * s3) * r1 + (n * s2 - s1 * s1) * r2) / nullif(det, 0), 5) AS c FROM d""")
def velocity_polynomial(spark, d):
    p = table(spark, d, "events").select("user_id", (F.col("event_id") * 7 % 23).cast("double").alias("x"), F.col("value").alias("y"))
    return velocity.parabola(p, "user_id", "x", "y").select("user_id", "n", *[F.round(c, 5).alias(c) for c in ("a", "b", "c")])


@query("""WITH p AS (SELECT user_id, (event_id * 13 % 101) / 10.0 AS x, value AS t FROM events), c AS (SELECT user_id, a::DOUBLE AS x0, (x - a) * (x - a) AS q, t * t AS y FROM p, range(0, 11) r(a)),
f AS (SELECT user_id, x0, regr_slope(y, q) AS m, regr_intercept(y, q) AS c, round(regr_r2(y, q), 9) AS r2 FROM c GROUP BY ALL)
SELECT user_id, x0, round(sqrt(c), 5) AS t0, round(2 / sqrt(m), 5) AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r2 DESC, x0) AS n FROM f WHERE m > 0 AND c > 0) WHERE n = 1""")
def hyperbola_fit(spark, d):
    fit = velocity.hyperbola(tracks(spark, d).select("user_id", F.col("y").alias("x"), F.col("x").alias("t")), "user_id", "x", "t", [float(a) for a in range(11)])
    return fit.select("user_id", "x0", F.round("t0", 5).alias("t0"), F.round("v", 5).alias("v"))


@query(E + """, f AS (SELECT *, coalesce(lead(x, 2) OVER w - lag(x, 2) OVER w, 0) AS a, coalesce(lead(y, 2) OVER w - lag(y, 2) OVER w, 0) AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY nr)),
s AS (SELECT *, abs(a - avg(a) OVER w) <= 1.5 * coalesce(stddev_samp(a) OVER w, 0) AND abs(b - avg(b) OVER w) <= 1.5 * coalesce(stddev_samp(b) OVER w, 0) AS k FROM f WINDOW w AS (PARTITION BY user_id)) SELECT user_id, nr FROM s WHERE k""")
def steady_fixes(spark, d):
    return position.steady(tracks(spark, d), "user_id", "nr", ["x", "y"], 5, 1.5).select("user_id", "nr")


@query(E + """, r AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS r FROM e WINDOW w AS (PARTITION BY user_id ORDER BY nr)),
s AS (SELECT *, coalesce(r < avg(r) OVER (PARTITION BY user_id) / 2, false) AS s FROM r), f AS (SELECT *, sum(s::INT) OVER w < count(*) OVER w / 2.0 AS few FROM s WINDOW w AS (PARTITION BY user_id)) SELECT user_id, nr FROM f WHERE NOT (s AND few)""")
def stationary_fixes(spark, d):
    return position.moving(tracks(spark, d), "user_id", "nr").select("user_id", "nr")


@query(E + """, m AS (SELECT user_id, nr, CASE WHEN nr % 10 = 0 THEN (sum((nr % 10 = 0)::INT) OVER (PARTITION BY user_id ORDER BY nr))::DOUBLE END AS m FROM e),
n AS (SELECT *, max(m) OVER (PARTITION BY user_id) AS l, last_value(m IGNORE NULLS) OVER p AS m0, last_value(CASE WHEN m IS NOT NULL THEN nr END IGNORE NULLS) OVER p AS n0, first_value(m IGNORE NULLS) OVER q AS m1, first_value(CASE WHEN m IS NOT NULL THEN nr END IGNORE NULLS) OVER q AS n1 FROM m
  WINDOW p AS (PARTITION BY user_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY user_id ORDER BY nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT user_id, nr, coalesce((coalesce(m, m0 + (m1 - m0) * ((nr - n0) / (n1 - n0)::DOUBLE)) - 1) / nullif(l - 1, 0), 0) AS s FROM n WHERE m0 IS NOT NULL AND m1 IS NOT NULL)
SELECT user_id, nr, round(user_id + (100 - user_id) * s + 1e-8, 6) AS x, round(50 * s + 1e-8, 6) AS y FROM i""")
def marker_coordinates(spark, d):
    out = position.from_markers(tracks(spark, d), "user_id", "nr", F.col("nr") % 10 == 0, (F.col("user_id").cast("double"), F.lit(0.0)), (F.lit(100.0), F.lit(50.0)))
    return out.select("user_id", "nr", F.round(F.col("x") + 1e-8, 6).alias("x"), F.round(F.col("y") + 1e-8, 6).alias("y"))


@query(_STATIONS + """, n AS (SELECT *, (c_custkey - 1) / (max(c_custkey) OVER () - 1)::DOUBLE AS s FROM p)
SELECT c_custkey, round(x + CASE WHEN c_custkey % 2 = 1 THEN 0.5 + (1.5 - 0.5) * s ELSE -0.5 + (2.5 - -0.5) * s END + 1e-8, 6) AS x FROM n""")
def profile_drift(spark, d):
    return position.drift(stations(spark, d), "c_custkey", "x", (0.5, -0.5), (1.5, 2.5)).select("c_custkey", F.round(F.col("x") + 1e-8, 6).alias("x"))


@query(E + """, h AS (SELECT user_id, i, t, first(x) AS x, first(y) AS y FROM (SELECT user_id, i, t, x, y, row_number() OVER (PARTITION BY user_id, i, t ORDER BY (nr * (7919 * (2 * i + t) + 104729)) % 10007, nr) AS n FROM e, range(0, 8) a(i), range(1, 3) b(t)) WHERE n = 1 GROUP BY ALL),
l AS (SELECT p.user_id, p.i, p.x AS px, p.y AS py, q.x - p.x AS dx, q.y - p.y AS dy FROM h p JOIN h q ON p.user_id = q.user_id AND p.i = q.i AND p.t = 1 AND q.t = 2),
a AS (SELECT e.*, l.i, px, py, dx, dy, coalesce(abs((x - px) * dy - (y - py) * dx) / nullif(sqrt(dx * dx + dy * dy), 0) <= 2, false) AS ok FROM e JOIN l USING (user_id)),
b AS (SELECT user_id, i FROM (SELECT user_id, i, row_number() OVER (PARTITION BY user_id ORDER BY sum(ok::INT) DESC, i) AS n FROM a GROUP BY user_id, i) WHERE n = 1)
SELECT user_id, nr, round(px + ((x - px) * dx + (y - py) * dy) / (dx * dx + dy * dy) * dx + 1e-8, 5) AS u, round(py + ((x - px) * dx + (y - py) * dy) / (dx * dx + dy * dy) * dy + 1e-8, 5) AS v FROM a JOIN b USING (user_id, i) WHERE ok""")
def robust_track(spark, d):
    out = position.robust_line(tracks(spark, d), "user_id", "nr", 2.0, trials=8)
    return out.select("user_id", "nr", F.round(F.col("u") + 1e-8, 5).alias("u"), F.round(F.col("v") + 1e-8, 5).alias("v"))


_LINES = """, s AS (SELECT s_suppkey AS line, (s_suppkey % 5)::DOUBLE AS x0, (s_suppkey % 3)::DOUBLE AS y0, 5.0 + s_suppkey % 4 AS x1, 4.0 + s_suppkey % 5 AS y1 FROM supplier),
q AS (SELECT line, k, x0 + (x1 - x0) * (k * 0.7 / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) AS x, y0 + (y1 - y0) * (k * 0.7 / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) AS y FROM (SELECT *, unnest(range(0, floor(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / 0.7)::BIGINT + 1)) AS k FROM s)),
c AS (SELECT line, q.k, floor(x)::BIGINT + i AS ix, floor(y)::BIGINT + j AS iy, CASE WHEN i = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE WHEN j = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END AS w FROM q, range(0, 2) a(i), range(0, 2) b(j)),
n AS (SELECT *, count(*) OVER (PARTITION BY line, k) AS n FROM c WHERE w > 0),
v AS (SELECT line, n.k, cells.k AS i, sum(w * v) AS v FROM n JOIN cells USING (ix, iy) GROUP BY line, n.k, cells.k, n HAVING count(*) = n),
m AS (SELECT line, k, i, avg(v) OVER (PARTITION BY line, i ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM v)"""


@query(CELLS + _LINES + " SELECT line, k, count(*) AS n, round(sum(v), 6) AS s, round(sum(v * i), 6) AS w FROM m GROUP BY line, k")
def section_cut(spark, d):
    s = F.col("s_suppkey")
    lines = table(spark, d, "supplier").select(s.alias("line"), (s % 5).cast("double").alias("x0"), (s % 3).cast("double").alias("y0"), (s % 4 + 5.0).alias("x1"), (s % 5 + 4.0).alias("y1"))
    out = position.section(position.stations(lines, "line", 0.7), "line", cells(spark, d), smooth=2)
    return out.select("line", F.col("k").cast("long").alias("k"), *sums())


@query(CELLS + f""", t AS (SELECT ix, iy, list(v ORDER BY k) AS amp, floor((2.0 - (ix * 3 + iy) % 7 * 0.1) / 0.05::DOUBLE + 0.5)::INT AS down FROM cells GROUP BY ix, iy),
x AS (SELECT ix, iy, list_transform(range(10, 18), lambda k: amp[least(k + down, 63) + 1]) AS a FROM t) SELECT ix, iy, {SUMS} FROM x""")
def topography_slice(spark, d):
    z = (F.col("ix") * 3 + F.col("iy")) % 7 * 0.1
    return cells(spark, d).select("ix", "iy", position.follow_topography(F.col("amp"), z, 2.0, 0.05, 10, 8).alias("a")).select("ix", "iy", *sums("a"))


_SCALED = CELLS + """, a AS (SELECT ix, iy, k - 20 AS i, coalesce(abs(v) / nullif(max(abs(v)) OVER (PARTITION BY k), 0), 0) AS r FROM cells WHERE k BETWEEN 21 AND 28),
s AS (SELECT ix, iy, i, CASE WHEN r < 0.3 THEN 0 ELSE r END AS a FROM a)"""


@query(_SCALED + " SELECT ix, iy, count(*) AS n, round(sum(a), 6) AS s, round(sum(a * i), 6) AS w FROM s GROUP BY ix, iy")
def thick_slice(spark, d):
    return position.scaled_samples(cells(spark, d), 21, 8, 0.3).select("ix", "iy", *sums())


@query(_SCALED + """, f AS (SELECT *, coalesce(product(1 - a) OVER (PARTITION BY ix, iy ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS f FROM s)
SELECT ix, iy, round(sum(f * a * CASE WHEN i <= 4 THEN 1 - (i - 1) / 3.0::DOUBLE ELSE 0 END) + product(1 - a), 6) AS red, round(sum(f * a * CASE WHEN i <= 4 THEN 1 ELSE 1 - (i - 5) / 3.0::DOUBLE END) + product(1 - a), 6) AS green,
  round(sum(f * a * CASE WHEN i <= 4 THEN 0 ELSE (i - 5) / 3.0::DOUBLE END) + product(1 - a), 6) AS blue FROM f GROUP BY ix, iy""")
def colour_composite(spark, d):
    bands = position.composite(F.col("amp"), 8)
    return position.scaled_samples(cells(spark, d), 21, 8, 0.3).select("ix", "iy", *[F.round(b, 6).alias(n) for b, n in zip(bands, ("red", "green", "blue"), strict=True)])


@query(_PART + """, b AS (SELECT min(ix) AS a, max(ix) AS b, min(iy) AS c, max(iy) AS d FROM g), o AS (SELECT ix, iy, ix + i AS jx, iy + j AS jy FROM g, range(-1, 2) p(i), range(-1, 2) q(j)),
v AS (SELECT o.ix, o.iy, CASE WHEN jx < a OR jx > b OR jy < c OR jy > d THEN 0 ELSE g.v END AS v FROM o CROSS JOIN b LEFT JOIN g ON g.ix = jx AND g.iy = jy) SELECT ix, iy, round(median(v), 6) AS v FROM v GROUP BY ix, iy""")
def image_median(spark, d):
    return position.median_3x3(_grid(spark, d)).withColumn("v", F.round("v", 6))


@query(T + """, m AS (SELECT vec_id, k, CASE WHEN k <= 10 THEN amp[k] ELSE list_sort([coalesce(lag(amp[k], 1) OVER w, amp[k]), amp[k], coalesce(lead(amp[k], 1) OVER w, amp[k])])[2] END AS v FROM traces, range(1, 65) r(k) WINDOW w AS (PARTITION BY channel, k ORDER BY trace))
SELECT vec_id, count(*) AS n, round(sum(v), 6) AS s, round(sum(v * k), 6) AS w FROM m GROUP BY vec_id""")
def trace_median(spark, d):
    return position.median_of_traces(traces(spark, d), "channel", "trace", 3, 10).select("vec_id", *sums())


@query(T + f""", x AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN list_concat(amp, list_transform(range(0, 6), lambda i: 0.0::DOUBLE))
  ELSE list_concat(list_transform(range(0, 63), lambda i: CASE WHEN i % 2 = 0 THEN amp[i // 2 + 1] ELSE (amp[i // 2 + 1] + amp[i // 2 + 2]) / 2 END), list_transform(range(0, 7), lambda i: 0.0::DOUBLE)) END AS a FROM traces) SELECT vec_id, {SUMS} FROM x""")
def joined_axes(spark, d):
    rows = traces(spark, d).select("vec_id", "amp")
    fine = rows.where("vec_id % 2 = 1").withColumn("amp", trace.resample(F.col("amp"), 1.0, 0.5, 63))
    return rows.where("vec_id % 2 = 0").unionByName(fine).withColumn("amp", trace.padded(F.col("amp"), 70)).select("vec_id", *sums())


@query(T + f""", c AS (SELECT unnest(range(min(channel), max(channel))) AS bin FROM traces), l AS (SELECT trace, list(channel ORDER BY channel) AS c, list(amp ORDER BY channel) AS d FROM traces GROUP BY trace HAVING count(*) > 1),
p AS (SELECT trace, bin, c.c, c.d, greatest(1, least(len(list_filter(c.c, lambda x: x <= bin + 0.5)), len(c.c) - 1)) AS i FROM l c, c b),
v AS (SELECT bin, trace, false AS real, list_transform(range(1, 65), lambda k: d[i][k] + (d[i + 1][k] - d[i][k]) * (bin + 0.5::DOUBLE - c[i]) / (c[i + 1] - c[i])) AS amp FROM p),
u AS (SELECT * FROM v UNION ALL SELECT channel, trace, true, amp FROM traces WHERE trace % 3 > 0), x AS (SELECT bin, trace, real, amp AS a FROM (SELECT *, row_number() OVER (PARTITION BY bin, trace ORDER BY real DESC) AS n FROM u) WHERE n = 1) SELECT bin, trace, real, {SUMS} FROM x""")
def real_over_virtual(spark, d):
    t = traces(spark, d)
    made = channel.virtual_channels(t, "channel", "trace").select(F.floor("channel").alias("bin"), "trace", F.lit(False).alias("real"), "amp")
    both = made.unionByName(t.where("trace % 3 > 0").select(F.col("channel").alias("bin"), "trace", F.lit(True).alias("real"), "amp"))
    return both.groupBy("bin", "trace").agg(F.max("real").alias("real"), F.max_by("amp", "real").alias("amp")).select("bin", "trace", "real", *sums())


@query(E + " SELECT user_id, count(*) AS n, round(corr(x, y), 6) AS r FROM e GROUP BY user_id HAVING count(*) > 2")
def track_correlation(spark, d):
    return tracks(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("r")).where("n > 2")


@query(CELLS + " SELECT iy AS profile, dense_rank() OVER (PARTITION BY iy ORDER BY ix) AS trace, round((ix - min(ix) OVER (PARTITION BY iy)) * 0.08, 6) AS inline, count(*) AS n, round(sum(v), 6) AS s FROM cells GROUP BY ix, iy")
def grid_profiles(spark, d):
    w = W.partitionBy("iy")
    rows = cells(spark, d).withColumns({"trace": F.row_number().over(w.orderBy("ix")).cast("long"), "inline": F.round((F.col("ix") - F.min("ix").over(w)) * 0.08, 6)})
    return rows.select(F.col("iy").alias("profile"), "trace", "inline", F.size("amp").cast("long").alias("n"), F.round(trace.total(F.col("amp")), 6).alias("s"))


@query(T + f", x AS (SELECT vec_id, list_transform(amp, lambda v: coalesce(v / nullif(list_max(amp), 0), 0)) AS a FROM traces) SELECT vec_id, {SUMS} FROM x")
def wiggle_scale(spark, d):
    return traces(spark, d).select("vec_id", trace.wiggle(F.col("amp")).alias("a")).select("vec_id", *sums("a"))


_TRIANGLES = """WITH g AS (SELECT l_quantity::BIGINT AS ix, round(l_discount * 100)::BIGINT AS iy, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
ok AS (SELECT * FROM g WHERE (ix * ix + iy * 7) % 5 > 1), no AS (SELECT * FROM g WHERE (ix * ix + iy * 7) % 5 <= 1), h AS (SELECT *, (((ix * 7919 + iy * 104729) % 1009)::BIGINT ** 3)::BIGINT % 1009 / 1009.0::DOUBLE * 0.00001 AS t FROM ok),
c AS (SELECT no.ix, no.iy, h.ix - no.ix AS a, h.iy - no.iy AS b, (h.ix - no.ix) ** 2 + (h.iy - no.iy) ** 2 + h.t AS h, h.v FROM no JOIN h ON (h.ix - no.ix) ** 2 + (h.iy - no.iy) ** 2 <= 9),
t AS (SELECT p.ix, p.iy, q.a * r.b - r.a * q.b AS wp, r.a * p.b - p.a * r.b AS wq, p.a * q.b - q.a * p.b AS wr, p.h AS hp, q.h AS hq, r.h AS hr, p.v AS vp, q.v AS vq, r.v AS vr
  FROM c p JOIN c q ON p.ix = q.ix AND p.iy = q.iy AND (p.a, p.b) < (q.a, q.b) JOIN c r ON p.ix = r.ix AND p.iy = r.iy AND (q.a, q.b) < (r.a, r.b)),
s AS (SELECT ix, iy, (wp * hp + wq * hq + wr * hr) / (wp + wq + wr) AS h, (wp * vp + wq * vq + wr * vr) / (wp + wq + wr) AS v FROM t WHERE wp + wq + wr <> 0 AND ((wp >= 0 AND wq >= 0 AND wr >= 0) OR (wp <= 0 AND wq <= 0 AND wr <= 0))
  UNION ALL SELECT p.ix, p.iy, (n * p.h + m * q.h) / (m + n), (n * p.v + m * q.v) / (m + n) FROM (SELECT *, sqrt(a * a + b * b) AS m FROM c) p JOIN (SELECT *, sqrt(a * a + b * b) AS n FROM c) q ON p.ix = q.ix AND p.iy = q.iy AND p.a * q.b = q.a * p.b AND p.a * q.a + p.b * q.b < 0)"""


@query(_TRIANGLES + " SELECT ix, iy, round(arg_min(v, h), 6) AS v FROM s GROUP BY ix, iy")
def linear_fill(spark, d):
    l = table(spark, d, "lineitem")
    cells = l.groupBy(F.col("l_quantity").cast("long").alias("ix"), F.round(F.col("l_discount") * 100).cast("long").alias("iy")).agg(F.avg("l_extendedprice").alias("v"))
    empty = (F.col("ix") * F.col("ix") + F.col("iy") * 7) % 5 <= 1
    return surface.linear(cells.where(empty), cells.where(~empty), 3.0).select("ix", "iy", F.round("v", 6).alias("v"))


@query(CELLS + f""", v AS (SELECT ix, iy, list(v ORDER BY k) AS amp FROM cells WHERE (ix + iy) % 3 > 0 GROUP BY ix, iy), o AS (SELECT DISTINCT ix + i AS ix, iy + j AS iy FROM v, range(-2, 3) a(i), range(-2, 3) b(j) WHERE i * i + j * j <= 4),
n AS (SELECT * FROM o ANTI JOIN v USING (ix, iy)), p AS (SELECT n.ix, n.iy, k, sum(amp[k] / ((n.ix - v.ix) ** 2 + (n.iy - v.iy) ** 2)) / sum(1 / ((n.ix - v.ix) ** 2 + (n.iy - v.iy) ** 2)) AS a FROM n JOIN v ON (n.ix - v.ix) ** 2 + (n.iy - v.iy) ** 2 <= 4, range(1, 65) r(k) GROUP BY ALL)
SELECT ix, iy, count(*) AS n, round(sum(a), 6) AS s, round(sum(a * k), 6) AS w FROM p GROUP BY ix, iy""")
def idw_cube(spark, d):
    valid = cells(spark, d).where((F.col("ix") + F.col("iy")) % 3 > 0)
    return surface.idw_traces(surface.gaps(valid, 2.0), valid, 2.0, 2.0).select("ix", "iy", *sums())


@query(E + """, b AS (SELECT e.user_id, b, x, y FROM (SELECT user_id, y AS x, x AS y FROM e) e, (VALUES (-0.5), (-0.2), (-0.1), (0.1)) r(b)),
f AS (SELECT user_id, b::DOUBLE AS b, regr_slope(y, exp(b::DOUBLE * x)) AS a, regr_intercept(y, exp(b::DOUBLE * x)) AS c, round(regr_r2(y, exp(b::DOUBLE * x)), 9) AS r2 FROM b GROUP BY ALL)
SELECT user_id, round(a, 5) AS a, b, round(c, 5) AS c FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r2 DESC, b) AS n FROM f WHERE r2 IS NOT NULL) WHERE n = 1""")
def velocity_exponential(spark, d):
    rows = tracks(spark, d).select("user_id", F.col("y").alias("x"), F.col("x").alias("y"))
    return velocity.exponential(rows, "user_id", "x", "y", [-0.5, -0.2, -0.1, 0.1]).select("user_id", F.round("a", 5).alias("a"), "b", F.round("c", 5).alias("c"))


@query("""WITH RECURSIVE p AS (SELECT event_id // 500 AS g, event_id % 40 AS k, (event_id * 7 % 23)::DOUBLE AS v, max(round(value, 4)) AS s FROM events GROUP BY ALL),
t AS (SELECT g, k, v, CASE WHEN s >= 20 THEN s ELSE 0 END AS s FROM p), n AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b FROM t WINDOW w AS (PARTITION BY g, k ORDER BY v)),
q AS (SELECT g, k, v FROM (SELECT *, row_number() OVER (PARTITION BY g, k ORDER BY s DESC, v) AS r FROM n WHERE s > 0 AND s >= a AND s >= b) WHERE r = 1),
d AS (SELECT a.g, a.k, any_value(a.v) AS v FROM q a JOIN q b ON a.g = b.g AND (a.k - b.k) ** 2 + (a.v - b.v) ** 2 <= 16 GROUP BY a.g, a.k HAVING count(*) >= 3),
r AS (SELECT g, k, k AS f FROM d UNION SELECT b.g, b.k, r.f FROM r JOIN d a ON a.g = r.g AND a.k = r.k JOIN d b ON b.g = r.g AND (a.k - b.k) ** 2 + (a.v - b.v) ** 2 <= 16),
l AS (SELECT g, k, min(f) AS f FROM r GROUP BY g, k), m AS (SELECT q.g, q.k, q.v, min(l.f) AS f FROM q JOIN d ON q.g = d.g AND (q.k - d.k) ** 2 + (q.v - d.v) ** 2 <= 16 JOIN l ON l.g = d.g AND l.k = d.k GROUP BY ALL),
x AS (SELECT g, f, dense_rank() OVER (PARTITION BY g ORDER BY f) - 1 AS cluster, count(*) AS n, min(k) AS k0, max(k) AS k1, min(v) AS v0, max(v) AS v1 FROM m GROUP BY g, f)
SELECT g, cluster, n, k, v, s FROM (SELECT x.g, cluster, n, p.k, p.v, p.s, row_number() OVER (PARTITION BY x.g, cluster ORDER BY p.s DESC, p.k, p.v) AS i FROM x JOIN p ON p.g = x.g AND p.k BETWEEN k0 AND k1 AND p.v BETWEEN v0 AND v1) WHERE i = 1""")
def velocity_clusters(spark, d):
    e = table(spark, d, "events")
    panel = e.groupBy(F.floor(F.col("event_id") / 500).alias("g"), (F.col("event_id") % 40).alias("k"), (F.col("event_id") * 7 % 23).cast("double").alias("v")).agg(F.max(F.round("value", 4)).alias("s"))
    return velocity.cluster_picks(velocity.picks(panel, "g", 20.0), panel, "g", 4.0, 3)


@query(T + """, c AS (SELECT a.vec_id, k, sqrt(k * k + ((a.trace - b.trace) * 8 / 10.0::DOUBLE) ** 2) AS p, b.amp FROM traces a JOIN traces b ON a.channel = b.channel, range(0, 64) r(k)),
l AS (SELECT vec_id, k, CASE WHEN p = 0 THEN 1 ELSE k / p END AS l, CASE WHEN p < 63.5 THEN amp[round(p)::INT + 1] END AS a FROM c)
SELECT vec_id, count(*) AS n, round(sum(v), 6) AS s, round(sum(v * (k + 1)), 6) AS w FROM (SELECT vec_id, k, coalesce(sum(l * a) FILTER (l >= cos(radians(30)) AND a IS NOT NULL) / nullif(sum(l) FILTER (l >= cos(radians(30)) AND a IS NOT NULL), 0), 0) AS v FROM l GROUP BY ALL) GROUP BY vec_id""")
def migrate2d(spark, d):
    return kernels.migrate_profile(traces(spark, d), "channel", "trace", 0.02, DT, 0.1, 60.0, NS).select("vec_id", *sums())


@query(E + """, n AS (SELECT *, (nr * 3 % 17) / 10.0::DOUBLE AS z FROM e), w AS (SELECT *, lead(x, 3) OVER o - x AS dx, lead(y, 3) OVER o - y AS dy, list({'x': x, 'y': y, 'z': z}) OVER (PARTITION BY user_id ORDER BY nr ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS p FROM n WINDOW o AS (PARTITION BY user_id ORDER BY nr)),
f AS (SELECT user_id, nr, regr_slope(q.z, sqrt((q.x - x) ** 2 + (q.y - y) ** 2)) AS m FROM (SELECT user_id, nr, x, y, unnest(p) AS q FROM w) GROUP BY ALL),
k AS (SELECT w.*, CASE WHEN sqrt(dx * dx + dy * dy) > 0 THEN {'u': dx / sqrt(dx * dx + dy * dy), 'v': dy / sqrt(dx * dx + dy * dy), 'a': atan(m)} END AS d FROM w JOIN f USING (user_id, nr)),
l AS (SELECT user_id, nr, x, y, z, last_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY nr ROWS UNBOUNDED PRECEDING) AS d FROM k)
SELECT user_id, nr, round(coalesce(x + (2 * sin(d.a) + 0.3) * d.u + 0.5 * d.v, x) + 1e-8, 5) AS x, round(coalesce(y + (2 * sin(d.a) + 0.3) * d.v - 0.5 * d.u, y) + 1e-8, 5) AS y, round(coalesce(z - 2 / cos(d.a) + 2 * tan(d.a) * sin(d.a), z) + 1e-8, 5) AS z FROM l""")
def antenna_offset(spark, d):
    rows = tracks(spark, d).withColumn("z", F.col("nr") * 3 % 17 / 10.0)
    out = position.antenna_offset(rows, "user_id", "nr", 3, 0.5, 0.3, 2.0)
    return out.select("user_id", "nr", *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in ("x", "y", "z")])
