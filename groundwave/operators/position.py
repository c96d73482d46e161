"""Coordinates of tracks: gates, markers, drift, robust lines; sections and images of the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import track
from .shared import cut

#: Samples of a grid that are broadcast at most: 16 MB.
HELD = 1 << 21


def steady(df: DataFrame, by: str, order: str, values: list[str], m: int, limit: float) -> DataFrame:
    """Rows whose difference over m rows (m odd), in each of values, is within limit standard deviations of the track's mean; the ends count as 0."""
    h, w, whole = (m - 1) // 2, track.along(by, order), W.partitionBy(by)
    names = [f"_d{i}" for i in range(len(values))]
    df = df.withColumns({n: F.coalesce(F.lead(v, h).over(w) - F.lag(v, h).over(w), F.lit(0.0)) for n, v in zip(names, values, strict=True)})
    df = df.withColumns({f"{n}k": F.abs(F.col(n) - F.avg(n).over(whole)) <= limit * F.coalesce(F.stddev_samp(n).over(whole), F.lit(0.0)) for n in names})
    keep = F.lit(True)
    for n in names:
        keep = keep & F.col(f"{n}k")
    return df.where(keep).drop(*names, *[f"{n}k" for n in names])


def moving(df: DataFrame, by: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """Without rows that come less than half the mean step from the row before, if those are fewer than half of the track."""
    w, whole = track.along(by, order), W.partitionBy(by)
    df = df.withColumn("_r", F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)))
    df = df.withColumn("_s", F.coalesce(F.col("_r") < F.avg("_r").over(whole) / 2, F.lit(False)))
    few = F.sum(F.col("_s").cast("int")).over(whole) < F.count("*").over(whole) / 2
    return df.withColumn("_few", few).where(~(F.col("_s") & F.col("_few"))).drop("_r", "_s", "_few")


def from_markers(df: DataFrame, by: str, order: str, marker: Column, start: tuple[Column, Column], end: tuple[Column, Column]) -> DataFrame:
    """Rows between the first and the last marker with x and y: markers lie evenly from start to end, rows evenly by `order` between markers. A track with one marker keeps that row at its start."""
    whole = W.partitionBy(by)
    df = df.withColumn("_m", F.when(marker, F.sum(marker.cast("int")).over(track.along(by, order).rowsBetween(W.unboundedPreceding, 0)).cast("double")))
    df = df.withColumn("_last", F.max("_m").over(whole))
    df = track.interpolate(df, by, order, "_m").where("_m is not null")
    share = F.coalesce(F.try_divide(F.col("_m") - 1, F.col("_last") - 1), F.lit(0.0))
    return df.withColumns({c: a + (b - a) * share for c, a, b in zip(("x", "y"), start, end, strict=True)}).drop("_m", "_last")


def nearest_marker(points: DataFrame, markers: DataFrame, by: str, at: str, key: str, decimals: int = 6) -> DataFrame:
    """(key, marker, dx): the nearest of the markers (by, at, marker) of a point's group and its distance, rounded; of equally near ones
    the least, also where a point has no place. Points of groups without markers are left out, a key's rows give one.

    A place of a group is one row, with its least marker, so that only the markers beside a place are compared and not all pairs
    of a group. A group's places must fit one task; places of markers lie further apart than distances are rounded.
    """
    known = markers.where(F.col("marker").isNotNull()).groupBy(by, at).agg(F.min("marker").alias("_m"))
    places = points.select(by, at).withColumn("_m", F.lit(None).cast(known.schema["_m"].dataType)).unionByName(known)
    places = places.groupBy(by, at).agg(F.min("_m").alias("_m")).where(F.col(by).isNotNull())
    w = W.partitionBy(by)
    place = F.when(F.col(at).isNotNull() & F.col("_m").isNotNull(), F.struct(F.col(at).alias("at"), F.col("_m").alias("m")))
    places = places.withColumn("_p", place).withColumn("_least", F.min("_m").over(w)).where("_least is not null")
    before, _, behind, _ = track.neighbours(by, "_p", at)
    away = lambda p: F.when(p.isNotNull(), F.struct(F.round(F.abs(F.col(at) - p["at"]), decimals).alias("dx"), p["m"].alias("marker")))
    places = places.withColumns({"_b": before, "_a": behind})
    near = F.when(F.col(at).isNull(), F.struct(F.lit(None).cast("double").alias("dx"), F.col("_least").alias("marker"))).otherwise(F.least(away(F.col("_b")), away(F.col("_a"))))
    places = places.select(F.col(by).alias("_by"), F.col(at).alias("_at"), near.alias("_near"))
    rows = points.join(places, (F.col(by) == F.col("_by")) & F.col(at).eqNullSafe(F.col("_at")))
    return rows.groupBy(key).agg(F.min_by("_near.marker", "_near").alias("marker"), F.min("_near.dx").alias("dx"))


def drift(df: DataFrame, number: str, value: str, start: tuple[float, float], end: tuple[float, float]) -> DataFrame:
    """value plus an offset that runs linearly from start at profile 1 to end at the last one; each is a pair for odd and even profiles."""
    last = F.broadcast(df.agg(F.max(number).alias("_n")))
    odd = F.col(number) % 2 == 1
    a, b = F.when(odd, start[0]).otherwise(start[1]), F.when(odd, end[0]).otherwise(end[1])
    share = F.coalesce(F.try_divide(F.col(number) - 1, F.col("_n") - 1), F.lit(0.0))
    return df.crossJoin(last).withColumn(value, F.col(value) + a + (b - a) * share).drop("_n")


def robust_line(df: DataFrame, by: str, order: str, tolerance: float, trials: int = 16, x: str = "x", y: str = "y") -> DataFrame:
    """(rows, u, v): the inliers of the best of `trials` lines through two points of a track, projected to the line.

    The points of a trial are those with the two smallest values of a fixed congruence of `order` (whole
    numbers), so reruns agree; the line with most points within tolerance wins, the first of equals.
    """
    point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lines = []
    for i in range(trials):
        at = [F.struct(F.pmod(F.col(order) * (7919 * (2 * i + j) + 104729), F.lit(10007)), F.col(order)) for j in (1, 2)]
        lines.append(F.struct(F.lit(i).alias("i"), F.min_by(point, at[0]).alias("p"), F.min_by(point, at[1]).alias("q")))
    rows = df.join(df.groupBy(by).agg(F.array(*lines).alias("_l")), by)
    dx, dy = (lambda l: l["q"]["x"] - l["p"]["x"]), (lambda l: l["q"]["y"] - l["p"]["y"])
    away = lambda l: F.try_divide(F.abs((F.col(x) - l["p"]["x"]) * dy(l) - (F.col(y) - l["p"]["y"]) * dx(l)), F.hypot(dx(l), dy(l)))
    rows = rows.withColumn("_in", F.transform("_l", lambda l: F.coalesce(away(l) <= tolerance, F.lit(False))))
    counts = rows.groupBy(by).agg(F.array_max(F.array(*[F.struct(F.sum(F.get("_in", F.lit(i)).cast("int")).alias("n"), F.lit(-i).alias("i")) for i in range(trials)])).alias("_b"))
    rows = rows.join(counts, by).where(F.get("_in", -F.col("_b.i"))).withColumn("_g", F.get("_l", -F.col("_b.i")))
    g = F.col("_g")
    along = ((F.col(x) - g["p"]["x"]) * dx(g) + (F.col(y) - g["p"]["y"]) * dy(g)) / (dx(g) * dx(g) + dy(g) * dy(g))
    return rows.withColumns({"u": g["p"]["x"] + along * dx(g), "v": g["p"]["y"] + along * dy(g)}).drop("_l", "_in", "_b", "_g")


def stations(lines: DataFrame, key: str, step: float) -> DataFrame:
    """(key, k, x, y): points every step along the line from (x0, y0) to (x1, y1)."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    rows = lines.withColumn("_l", length).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("_l") / step).cast("int"))))
    share = F.coalesce(F.try_divide(F.col("k") * step, F.col("_l")), F.lit(0.0))
    return rows.select(key, "k", (F.col("x0") + (F.col("x1") - F.col("x0")) * share).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * share).alias("y"))


def _total(traces: Column) -> Column:
    """The sums of several traces' samples; missing samples do not count."""
    plus = lambda a, b: F.coalesce(a + b, a, b)
    return F.aggregate(F.slice(traces, F.lit(2), F.size(traces)), F.get(traces, F.lit(0)), lambda t, a: F.zip_with(t, a, plus))


def section(points: DataFrame, key: str, cells: DataFrame, smooth: int = 0, amp: str = "amp") -> DataFrame:
    """(key, k, amp): the grid's traces at points, bilinear between cells (cell centres at whole coordinates), then the mean of `smooth` points to each side. Points that miss a cell are left out.

    Cells are counted and, up to HELD samples, broadcast to the points, which are shuffled once, by key, before they are joined with traces;
    beyond that both sides are shuffled. Points are never broadcast: how many there are is not known from the tables that they come from.
    """
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    corner = lambda i, j, w: F.struct((F.floor("x") + i).alias("ix"), (F.floor("y") + j).alias("iy"), w.alias("w"))
    corners = F.filter(F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy)), lambda c: c["w"] > 0)
    grid = cut(cells.select("ix", "iy", F.col(amp).alias("_a")).where(F.size("_a") > 0))
    held = (grid.agg(F.sum(F.size("_a"))).first()[0] or 0) <= HELD
    if held:
        points = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *([key] if smooth else [key, "k"]))
    asked = points.withColumn("_c", corners).select(key, "k", F.size("_c").alias("_n"), F.explode("_c").alias("c")).select(key, "k", "_n", "c.ix", "c.iy", "c.w")
    rows = asked.join(F.broadcast(grid) if held else grid.hint("merge"), ["ix", "iy"]).select(key, "k", "_n", F.transform("_a", lambda a: a * F.col("w")).alias("_a"))
    rows = rows.groupBy(key, "k").agg(F.collect_list("_a").alias("_s"), F.max("_n").alias("_n")).where(F.size("_s") == F.col("_n"))
    rows = rows.select(key, "k", F.slice(_total(F.col("_s")), F.lit(1), F.array_min(F.transform("_s", F.size))).alias(amp))
    if smooth:
        rows = rows.withColumn("_w", F.collect_list(amp).over(W.partitionBy(key).orderBy("k").rowsBetween(-smooth, smooth)))
        known = F.transform("_w", lambda t: F.transform(t, lambda a: F.when(a.isNotNull(), 1.0)))
        rows = rows.withColumn(amp, F.slice(F.zip_with(_total(F.col("_w")), _total(known), lambda a, n: a / n), F.lit(1), F.size(amp)))
    return rows.select(key, "k", amp)


def follow_topography(amp: Column, z: Column, top: float, step: float, first: int, n: int) -> Column:
    """n samples from `first` (0-based) below the surface z of a cell, the cube's first sample lying at height top; beyond the trace its end samples."""
    down = F.floor((F.lit(top) - z) / step + 0.5).cast("int")
    return F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda k: F.get(amp, F.least(F.greatest(k + down, F.lit(0)), F.size(amp) - 1)))


def scaled_samples(cells: DataFrame, first: int, n: int, threshold: float, amp: str = "amp") -> DataFrame:
    """(ix, iy, amp): absolute samples over the image's largest, those under the threshold 0. The peaks are one row of n numbers."""
    rows = cells.select("ix", "iy", F.transform(F.slice(amp, first, n), F.abs).alias(amp))
    peaks = rows.agg(*[F.max(F.get(amp, F.lit(i))).alias(f"p{i}") for i in range(n)]).select(F.array(*[f"p{i}" for i in range(n)]).alias("_p"))
    share = F.zip_with(amp, "_p", lambda a, p: F.coalesce(F.try_divide(a, p), F.lit(0.0)))
    return rows.crossJoin(F.broadcast(peaks)).select("ix", "iy", F.transform(share, lambda a: F.when(a < threshold, 0.0).otherwise(a)).alias(amp))


def colours(n: int) -> list[tuple[float, float, float]]:
    """n colours (n even) from yellow over green to blue."""
    h = n // 2
    ramp = [i / max(1, h - 1) for i in range(h)]
    return [(1 - r, 1.0, 0.0) for r in ramp] + [(0.0, 1 - r, r) for r in ramp]


def composite(amp: Column, n: int) -> list[Column]:
    """Red, green and blue of n layers over white, the last one at the back, each as opaque as its sample."""
    return [
        F.aggregate(F.zip_with(F.reverse(amp), F.array(*[F.lit(c[band]) for c in reversed(colours(n))]), lambda a, c: F.struct(a.alias("a"), c.alias("c"))), F.lit(1.0), lambda im, l: (1 - l["a"]) * im + l["a"] * l["c"])
        for band in range(3)
    ]


def median_3x3(cells: DataFrame, v: str = "v") -> DataFrame:
    """(ix, iy, v): the median of a cell and its neighbours; cells outside the grid's rectangle count as 0, empty ones inside it not at all."""
    from .grid import near_cells

    box = cells.agg(F.min("ix").alias("_a"), F.max("ix").alias("_b"), F.min("iy").alias("_c"), F.max("iy").alias("_d"))
    moves = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    spread = near_cells(cells.select("ix", "iy", v), moves).select("ix", "iy", v)
    rows = cells.select("ix", "iy").join(spread, ["ix", "iy"]).groupBy("ix", "iy").agg(F.collect_list(v).alias("_v")).crossJoin(F.broadcast(box))
    edge = lambda c, a, b: 3 - (F.col(c) == F.col(a)).cast("int") - (F.col(c) == F.col(b)).cast("int")
    s = F.array_sort(F.concat("_v", F.array_repeat(F.lit(0.0), 9 - edge("ix", "_a", "_b") * edge("iy", "_c", "_d"))))
    n = F.size(s)
    return rows.select("ix", "iy", ((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2).alias(v))


def median_of_traces(traces: DataFrame, by: str | list[str], order: str, m: int, first: int, amp: str = "amp") -> DataFrame:
    """Samples from `first` (0-based) on become the centred median of m traces (m odd), the end traces repeated."""
    h, w = m // 2, track.along(by, order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    around = [F.coalesce(F.lag(amp, -k).over(w), (F.first(amp) if k < 0 else F.last(amp)).over(whole)) for k in range(-h, h + 1)]
    mid = F.transform(amp, lambda a, i: F.when(i < first, a).otherwise(F.get(F.array_sort(F.transform("_w", lambda t: F.get(t, i))), F.lit(h))))
    return traces.withColumn("_w", F.array(*around)).withColumn(amp, mid).drop("_w")


def antenna_offset(df: DataFrame, by: str, order: str, n: int, across: float, ahead: float, height: float = 0.0, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """x, y, z of the antenna, `across` to the right of the receiver and `ahead` of it, the receiver `height` above the ground.

    The direction is that to the row n ahead, the slope that of a line through the heights of those rows.
    On a slope the receiver leans: its foot lies height tan(slope) cos(slope) up the track and the ground
    height / cos(slope) - height tan(slope) sin(slope) below it. The last n rows keep the last known direction and slope.
    """
    w = track.along(by, order)
    rows = df.withColumns({"_x": F.lead(x, n).over(w) - F.col(x), "_y": F.lead(y, n).over(w) - F.col(y)})
    rows = rows.withColumn("_r", F.hypot("_x", "_y")).withColumns({"_p": F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"))).over(w.rowsBetween(0, n))})
    far = F.transform("_p", lambda q: F.struct(F.hypot(q["x"] - F.col(x), q["y"] - F.col(y)).alias("r"), q["z"].alias("z")))
    mean = lambda f: F.aggregate(far, F.lit(0.0), lambda s, q: s + f(q)) / F.size("_p")
    cov = mean(lambda q: q["r"] * q["z"]) - mean(lambda q: q["r"]) * mean(lambda q: q["z"])
    var = mean(lambda q: q["r"] * q["r"]) - mean(lambda q: q["r"]) * mean(lambda q: q["r"])
    known = F.when(F.col("_r") > 0, F.struct((F.col("_x") / F.col("_r")).alias("u"), (F.col("_y") / F.col("_r")).alias("v"), F.atan(F.coalesce(F.try_divide(cov, var), F.lit(0.0))).alias("a")))
    rows = rows.withColumn("_d", known).withColumn("_d", F.last("_d", True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    u, v, a = F.col("_d.u"), F.col("_d.v"), F.col("_d.a")
    lean = height * F.tan(a) * F.cos(a)
    moved = {x: F.col(x) + (lean + ahead) * u + across * v, y: F.col(y) + (lean + ahead) * v - across * u, z: F.col(z) - height / F.cos(a) + height * F.tan(a) * F.sin(a)}
    return rows.withColumns({c: F.coalesce(e, F.col(c)) for c, e in moved.items()}).drop("_x", "_y", "_r", "_p", "_d")


def moved_profiles(df: DataFrame, by: str, order: str, dx: float, dy: float, which: str = "all", x: str = "x", y: str = "y", rising: bool = False) -> DataFrame:
    """x and y moved by dx and dy: of all profiles, or of those with odd or even numbers; rising: from nothing at a profile's first row to
    the whole at its last, in equal steps."""
    move = {"all": F.lit(True), "odd": F.col(by) % 2 == 1, "even": F.col(by) % 2 == 0}[which]
    share = F.lit(1.0)
    if rising:
        share = F.coalesce(F.try_divide(F.row_number().over(W.partitionBy(by).orderBy(order)) - 1.0, F.count("*").over(W.partitionBy(by)) - 1.0), F.lit(0.0))
    share = F.when(move, share).otherwise(0.0)
    return df.withColumn("_share", share).withColumns({x: F.col(x) + dx * F.col("_share"), y: F.col(y) + dy * F.col("_share")}).drop("_share")
