"""Queries over whole surveys: several clocks, all samples, areas of rectangles, the outside of the hull; tables as in the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import surface, survey, trace
from .catalogue import _PART, DT, SUMS, T, _grid, query, raw, sums, table, traces

_CLOCKS = """WITH e AS (SELECT event_id % 3 AS profile, event_id // 3 + 1 AS trace, value AS x, event_id * 13 % 101 / 10.0::DOUBLE AS y, (event_id % 7)::DOUBLE AS z FROM events),
c AS (SELECT *, trace * 100 + trace * 7 % 5 AS cu, trace % 10 = 3 + profile AS pulse, CASE WHEN trace % 41 = 0 THEN trace - 1 ELSE trace END * 100 + profile * 1000 AS pos FROM e),
p AS (SELECT *, lag(trace) OVER (PARTITION BY profile ORDER BY trace) AS before FROM c WHERE pulse),
h AS (SELECT profile, trace, cu FROM c WHERE pos % 1000 = 0 OR pos % 1000 BETWEEN 98 AND 102),
m AS (SELECT p.profile, p.trace, p.cu, min_by(h.trace, h.trace) AS tt, min_by(h.cu, h.trace) AS hcu FROM p JOIN h ON p.profile = h.profile AND h.trace >= p.trace WHERE p.cu > 5000 AND p.trace - p.before > 1 GROUP BY ALL),
o AS (SELECT profile, median(cu - hcu) FILTER (tt - trace < 11) AS o FROM m GROUP BY profile),
k AS (SELECT profile, pos::DOUBLE AS tt, min_by(x, trace) AS x, min_by(y, trace) AS y, min_by(z, trace) AS z FROM c GROUP BY ALL),
w AS (SELECT *, lead(tt) OVER v AS tt1, lead(x) OVER v AS x1, lead(y) OVER v AS y1, lead(z) OVER v AS z1, lag(tt) OVER v AS ttb, lag(x) OVER v AS xb, lag(y) OVER v AS yb, lag(z) OVER v AS zb FROM k WINDOW v AS (PARTITION BY profile ORDER BY tt)),
q AS (SELECT c.profile, c.trace, c.pos - o.o AS tt FROM c JOIN o USING (profile)),
a AS (SELECT q.profile, q.trace, q.tt AS t, w.* EXCLUDE (profile), f.tt AS ftt, f.x AS fx, f.y AS fy, f.z AS fz, f.tt1 AS ftt1, f.x1 AS fx1, f.y1 AS fy1, f.z1 AS fz1 FROM q ASOF LEFT JOIN w ON q.profile = w.profile AND q.tt >= w.tt
  JOIN (SELECT * FROM w WHERE ttb IS NULL) f ON f.profile = q.profile)
"""


def _line(c: str) -> str:
    inner, ahead, back = f"{c} + ({c}1 - {c}) * (t - tt) / (tt1 - tt)", f"f{c} + (f{c}1 - f{c}) * (t - ftt) / (ftt1 - ftt)", f"{c}b + ({c} - {c}b) * (t - ttb) / (tt - ttb)"
    return f"round(CASE WHEN tt IS NULL THEN {ahead} WHEN tt1 IS NULL THEN {back} ELSE {inner} END + 1e-8, 5) AS {c}"


@query(_CLOCKS + f"SELECT profile, trace, {_line('x')}, {_line('y')}, {_line('z')} FROM a")
def pps_positions(spark, d):
    """Logs of three clocks from all events: a trace for each event of a profile, a pulse every tenth trace."""
    n = F.col("event_id")
    rows = table(spark, d, "events").select((n % 3).alias("profile"), (F.floor(n / 3) + 1).alias("trace"), F.col("value").alias("x"), (n * 13 % 101 / 10.0).alias("y"), (n % 7).cast("double").alias("z"))
    t, p = F.col("trace"), F.col("profile")
    clock = rows.select("profile", "trace", (t * 100 + t * 7 % 5).alias("cu_ms"), (t % 10 == 3 + p).alias("pulse"))
    fixes = rows.withColumn("pos_ms", F.when(t % 41 == 0, t - 1).otherwise(t) * 100 + p * 1000)
    out = survey.pps_positions(clock, fixes, 11)
    return out.select("profile", "trace", *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in ("x", "y", "z")])


@query(T + """, t AS (SELECT channel::DOUBLE AS channel, trace % 3 AS profile, trace, trace * 0.7::DOUBLE + channel * 0.1::DOUBLE AS x, channel * 1.3::DOUBLE + trace % 3 * 0.2::DOUBLE AS y, amp FROM traces),
a AS (SELECT t.* EXCLUDE (amp), k, 100 * coalesce((amp[k] - avg(amp[k]) OVER w) / nullif(stddev_samp(amp[k]) OVER w, 0), 0) AS v FROM t, range(1, 9) r(k) WINDOW w AS (PARTITION BY profile, channel, k)),
e AS (SELECT min(channel) AS lo, max(channel) AS hi FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY profile, trace, k ORDER BY channel) AS i, count(*) OVER (PARTITION BY profile, trace, k) AS m FROM a),
s AS (SELECT lo + i + 0.5::DOUBLE AS c FROM e, range(0, 100) r(i) WHERE lo + i + 1 <= hi UNION ALL SELECT lo - 0.5::DOUBLE FROM e UNION ALL SELECT hi + 0.5::DOUBLE FROM e),
g AS (SELECT profile, trace, k, c, greatest(1, least(count(*) FILTER (channel <= c), any_value(m) - 1)) AS i FROM n, s WHERE m > 1 GROUP BY ALL),
u AS (SELECT g.profile, g.c AS channel, g.trace, p.x + (q.x - p.x) * (c - p.channel) / (q.channel - p.channel) AS x, p.y + (q.y - p.y) * (c - p.channel) / (q.channel - p.channel) AS y, g.k, p.v + (q.v - p.v) * (c - p.channel) / (q.channel - p.channel) AS v
  FROM g JOIN n p ON p.profile = g.profile AND p.trace = g.trace AND p.k = g.k AND p.i = g.i JOIN n q ON q.profile = g.profile AND q.trace = g.trace AND q.k = g.k AND q.i = g.i + 1),
b AS (SELECT *, floor((x - 0.03::DOUBLE) / 2)::BIGINT AS ix, floor((y + 2.01::DOUBLE) / 0.9::DOUBLE)::BIGINT AS iy FROM (SELECT profile, channel, trace, x, y, k, v, 1 AS real FROM a UNION ALL SELECT profile, channel, trace, x, y, k, v, 0 FROM u)),
f AS (SELECT profile, channel, real, ix, iy, k, min_by(v, trace) AS v FROM b WHERE ix BETWEEN 0 AND 39 AND iy BETWEEN 0 AND 19 GROUP BY ALL),
l AS (SELECT *, 100 * coalesce((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 0) AS z FROM f WINDOW w AS (PARTITION BY profile, channel, k)),
o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY ix, iy, k ORDER BY profile DESC, real DESC, channel DESC) = 1)
SELECT ix, iy, any_value(channel) AS channel, any_value(profile) AS profile, count(*) AS n, round(sum(z) + 1e-6, 3) AS s, round(sum(z * k) + 1e-6, 3) AS w FROM o GROUP BY ix, iy""")
def sample_slices(spark, d):
    c, t = F.col("channel"), F.col("trace")
    placed = traces(spark, d).withColumns({"profile": t % 3, "x": t * 0.7 + c * 0.1, "y": c * 1.3 + t % 3 * 0.2})
    out = survey.sample_slices(placed, DT, 3.5, (0.03, 2.0, 40), (-2.01, 0.9, 20), more=1)
    weighted = trace.total(F.transform("amp", lambda x, i: x * (i + 1)))
    return out.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), "channel", "profile", F.size("amp").cast("long").alias("n"), F.round(trace.total(F.col("amp")) + 1e-6, 3).alias("s"), F.round(weighted + 1e-6, 3).alias("w"))


@query(T + f""", t AS (SELECT vec_id % 4 AS rectangle, vec_id % 23 * 0.3::DOUBLE AS x, vec_id % 37 * 0.2::DOUBLE AS y, amp FROM traces), u AS (SELECT *, 0.8::DOUBLE * x - 0.6::DOUBLE * y + 1.013::DOUBLE AS u, 0.6::DOUBLE * x + 0.8::DOUBLE * y - 2.027::DOUBLE AS v FROM t),
b AS (SELECT rectangle, floor((u - 0.25::DOUBLE) / 0.5::DOUBLE)::BIGINT AS ix, floor((v - 0.75::DOUBLE) / 0.5::DOUBLE)::BIGINT AS iy, amp FROM u WHERE u BETWEEN 0.25 AND 4.25 AND v BETWEEN 0.75 AND 5.75),
e AS (SELECT rectangle, ix, iy, k, avg(amp[k]) AS v FROM b, range(1, 65) r(k) GROUP BY ALL), m AS (SELECT ix, iy, k, avg(v) AS v, count(*) AS rectangles FROM e GROUP BY ALL),
x AS (SELECT ix, iy, any_value(rectangles) AS rectangles, list(v ORDER BY k) AS a FROM m GROUP BY ix, iy)
SELECT ix, iy, rectangles, round(0.8::DOUBLE * (0.5 + ix * 0.5 - 1.013::DOUBLE) + 0.6::DOUBLE * (1 + iy * 0.5 + 2.027::DOUBLE), 6) AS x, round(0.8::DOUBLE * (1 + iy * 0.5 + 2.027::DOUBLE) - 0.6::DOUBLE * (0.5 + ix * 0.5 - 1.013::DOUBLE), 6) AS y, {SUMS} FROM x""")
def block_traces(spark, d):
    n = F.col("vec_id")
    rows = raw(spark, d).withColumns({"rectangle": n % 4, "x": n % 23 * 0.3, "y": n % 37 * 0.2})
    out = survey.block_traces(rows, (0.5, 1.0), 0.5, (8, 10), (0.8, 0.6, 1.013, -2.027))
    return out.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col("n").alias("rectangles"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), *sums())


@query(_PART + """, k AS (SELECT * FROM g WHERE ix BETWEEN 12 AND 20), m AS (SELECT ix, iy FROM g WHERE ix NOT BETWEEN 12 AND 20)
SELECT m.ix, m.iy, round(min_by(k.v, {'d': (m.ix - k.ix) ** 2 + (m.iy - k.iy) ** 2, 'y': k.iy, 'x': k.ix}), 6) AS v, round(sqrt(min((m.ix - k.ix) ** 2 + (m.iy - k.iy) ** 2)), 6) AS d FROM m, k GROUP BY m.ix, m.iy""")
def nearest_outside(spark, d):
    """Cells left and right of a strip take the value of its nearest cell."""
    rows, strip = _grid(spark, d), F.col("ix").between(12, 20)
    out = surface.nearest(rows.where(~strip), rows.where(strip), tile=4)
    return out.select("ix", "iy", F.round("v", 6).alias("v"), F.round("d", 6).alias("d"))


@query("""WITH h AS (SELECT event_id % 20 AS p, (event_id * 7 % 1999)::DOUBLE AS h, avg(value) AS z FROM events GROUP BY ALL), a AS (SELECT event_id AS nr, event_id % 20 AS p, (event_id * 11 % 2003)::DOUBLE AS s FROM events)
SELECT a.nr, round(CASE WHEN b.h = a.s THEN b.z ELSE b.z + (c.z - b.z) * (a.s - b.h) / (c.h - b.h) END + 1e-8, 5) AS z FROM a ASOF LEFT JOIN h b ON a.p = b.p AND a.s >= b.h ASOF LEFT JOIN h c ON a.p = c.p AND a.s <= c.h""")
def line_topography(spark, d):
    """Heights at places along each profile, for other places along it; both from all events."""
    n, rows = F.col("event_id"), table(spark, d, "events")
    heights = rows.select((n % 20).alias("p"), (n * 7 % 1999).alias("s"), F.col("value").alias("z"))
    asked = rows.select(n.alias("nr"), (n % 20).alias("p"), (n * 11 % 2003).alias("s"))
    return surface.line_topography(heights, asked, "p", "s").select("nr", F.round(F.col("z") + 1e-8, 5).alias("z"))
