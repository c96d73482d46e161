"""Operators along a profile: windows over rows ordered within a profile. A profile must fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import trace


def along(by: str | list[str], *order: str):
    return W.partitionBy(by).orderBy(*order)


def inline_distance(df: DataFrame, by: str, order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    w = along(by, *order)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    return df.withColumn("_step", step).withColumn("inline", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_step")


def neighbours(by: str | list[str], value: str, at: str, apart: int = 0) -> tuple[Column, Column, Column, Column]:
    """(previous value, its place, next value, its place) that are not null, at least `apart` rows away. What comes next is looked
    for in falling order: a frame to the end of the partition would be read anew for every row."""
    back, ahead = (W.partitionBy(by).orderBy(o).rowsBetween(W.unboundedPreceding, -apart) for o in (F.asc(at), F.desc(at)))
    place = F.when(F.col(value).isNotNull(), F.col(at))
    return F.last(value, True).over(back), F.last(place, True).over(back), F.last(value, True).over(ahead), F.last(place, True).over(ahead)


def interpolate(df: DataFrame, by: str, at: str, value: str, gap: float | None = None, arrays: bool = False, edges: bool | str = False) -> DataFrame:
    """Null values are interpolated linearly on `at`; with a gap only where the nearest known row is closer than gap/2.
    Before the first and behind the last known row values stay null, are copied (edges=True), or follow the line through
    the two nearest known rows (edges="line"; a single known row is copied)."""
    if edges == "line":
        v0, x0, v1, x1 = neighbours(by, value, at, 1)
        known = F.col(value).isNotNull()
        df = df.withColumn("_b", F.when(known, F.struct(v0.alias("v"), x0.alias("x")))).withColumn("_a", F.when(known, F.struct(v1.alias("v"), x1.alias("x"))))
        df = df.withColumns({"_b": neighbours(by, "_b", at)[0], "_a": neighbours(by, "_a", at)[2]})
    v0, x0, v1, x1 = neighbours(by, value, at)
    df = df.withColumns({"_v0": v0, "_x0": x0, "_v1": v1, "_x1": x1})

    def line(v0, x0, v1, x1):
        share = F.coalesce(F.try_divide(F.col(at) - x0, x1 - x0), F.lit(0.0)).cast("double")
        return trace.blend(v0, v1, share) if arrays else v0 + (v1 - v0) * share

    first, last = (F.col("_v1") if edges else None), (F.col("_v0") if edges else None)
    if edges == "line":
        first = F.when(F.col("_a.x").isNull(), first).otherwise(line(F.col("_v1"), F.col("_x1"), F.col("_a.v"), F.col("_a.x")))
        last = F.when(F.col("_b.x").isNull(), last).otherwise(line(F.col("_b.v"), F.col("_b.x"), F.col("_v0"), F.col("_x0")))
    inside = line(F.col("_v0"), F.col("_x0"), F.col("_v1"), F.col("_x1"))
    filled = F.when(F.col("_v0").isNull(), first).when(F.col("_v1").isNull(), last).otherwise(inside)
    if gap is not None:
        near = F.least(F.col(at) - F.col("_x0"), F.col("_x1") - F.col(at))
        filled = F.when(near < gap / 2, filled)
    return df.withColumn(value, F.coalesce(F.col(value), filled)).drop("_v0", "_x0", "_v1", "_x1", "_a", "_b")


def nearest(df: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """The value of the nearest row that has one; the earlier of two as near."""
    v0, x0, v1, x1 = neighbours(by, value, at)
    df = df.withColumns({"_v0": v0, "_x0": x0, "_v1": v1, "_x1": x1})
    take0 = F.col("_x1").isNull() | (F.col(at) - F.col("_x0") <= F.col("_x1") - F.col(at))
    return df.withColumn(value, F.when(F.col("_x0").isNotNull() & take0, F.col("_v0")).otherwise(F.col("_v1"))).drop("_v0", "_x0", "_v1", "_x1")


def constant_spacing(df: DataFrame, by: str, x: str, value: str, dx: float) -> DataFrame:
    """The mean of value in steps of dx along x. The last step of the longest profile is not filled, as edges count from 0."""
    edge = df.groupBy(by).agg(F.floor(F.max(x) / dx).alias("_bins"))
    rows = df.join(edge, by).withColumn("bin", F.floor(F.col(x) / dx)).where("bin < _bins")
    return rows.groupBy(by, "bin").agg(F.avg(value).alias(value), F.count("*").alias("n"))


def standstill(df: DataFrame, by: str, order: str, moved: Column, share: float = 1 / 6) -> DataFrame:
    """Without the rows at both ends of a profile where nothing moves, if they are less than `share` of it."""
    w = W.partitionBy(by)
    df = df.withColumn("_n", F.row_number().over(along(by, order))).withColumn("_m", moved)
    df = df.withColumns({"_a": F.min(F.when(F.col("_m"), F.col("_n"))).over(w), "_b": F.max(F.when(F.col("_m"), F.col("_n"))).over(w), "_all": F.count("*").over(w)})
    inside = F.col("_n").between(F.col("_a"), F.col("_b"))
    lost = F.col("_all") - (F.col("_b") - F.col("_a") + 1)
    return df.where(F.col("_a").isNull() | inside | (lost >= F.col("_all") * share)).drop("_n", "_m", "_a", "_b", "_all")


def heading(df: DataFrame, by: str, order: str, n: int, x: str = "x", y: str = "y") -> DataFrame:
    """Degrees of the direction to the row n ahead; the last n rows keep the last known one."""
    w = along(by, order)
    ahead = F.degrees(F.atan2(F.lead(y, n).over(w) - F.col(y), F.lead(x, n).over(w) - F.col(x)))
    return df.withColumn("_h", ahead).withColumn("heading", F.last("_h", True).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_h")


def turn(df: DataFrame, by: str, order: str, x: str = "x", inline: str | None = None) -> DataFrame:
    """Rows of profiles that end west of where they began are numbered from the other end; distances in column inline, if it is named,
    then count from there."""
    w = along(by, order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n = F.row_number().over(along(by, order))
    back = F.last(x).over(w) < F.first(x).over(w)
    df = df.withColumn("turned", back).withColumn("_n", F.when(back, F.count("*").over(w) - n + 1).otherwise(n))
    if inline:
        df = df.withColumn(inline, F.when(F.col("turned"), F.last(inline).over(w) - F.col(inline)).otherwise(F.col(inline)))
    return df.withColumn("trace", F.col("_n")).drop("_n")


def moving_median(df: DataFrame, by: str, order: str, value: str, half: int, to: str) -> DataFrame:
    """Centred median of 2 half + 1 rows, edges repeated."""
    w = along(by, order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    taken = [F.coalesce(F.lag(value, -k).over(w), first if k < 0 else last) for k in range(-half, half + 1)]
    return df.withColumn("_w", F.array(*taken)).withColumn(to, F.element_at(F.array_sort("_w"), half + 1)).drop("_w")


def twice_smoothed(df: DataFrame, by: str, order: str, value: str, n: int) -> DataFrame:
    """value after two moving medians, edges repeated: of n rows (n odd), and then of 2 n + 1."""
    return moving_median(moving_median(df, by, order, value, n // 2, value), by, order, value, n, value)


def longest(runs: DataFrame, by: str) -> DataFrame:
    """Of the runs (by, first, last, n) the longest of each group; the first of equals."""
    return runs.groupBy(by).agg(F.max_by(F.struct("first", "last", "n"), F.struct("n", -F.col("first"))).alias("r")).select(by, "r.*")


def first_matches(left: DataFrame, right: DataFrame, on: list[str], order: str) -> DataFrame:
    """left's rows that right has a match for, each with the first of them by order."""
    others = [c for c in right.columns if c not in on]
    return left.join(right.groupBy(*on).agg(F.min_by(F.struct(*others), order).alias("_r")).select(*on, "_r.*"), on)


def moving_mean(df: DataFrame, by: str, order: str, value: str, half: int, to: str) -> DataFrame:
    """Centred mean that shrinks evenly at the ends. It is summed from the last row back, which settles its last bit: distances from it
    that lie on the edge of a bin (`within_elbow`) follow that."""
    w = along(by, order)
    n, size = F.row_number().over(w), F.count("*").over(W.partitionBy(by))
    df = df.withColumn("_h", F.least(n - 1, size - n, F.lit(half)))
    values = F.collect_list(value).over(w.rowsBetween(-half, half))
    start = F.least(n - 1, F.lit(half)) - F.col("_h") + 1
    return df.withColumn("_v", F.slice(values, start, 2 * F.col("_h") + 1)).withColumn(to, trace.mean(F.reverse("_v"))).drop("_h", "_v")


def outliers(df: DataFrame, by: str, order: str, value: str, half: int, limit: float | None = None, replace: bool = False) -> DataFrame:
    """value far from its moving median becomes null: farther than limit, or at least 3 mean residuals; the others become their medians.
    With replace, nulls are then interpolated over the rows' numbers, and stay null at the ends."""
    df = moving_median(df, by, order, value, half, "_med").withColumn("_res", F.abs(F.col(value) - F.col("_med")))
    bad = F.col("_res") > limit if limit is not None else (F.col("_res") >= 3 * F.avg("_res").over(W.partitionBy(by))) & (F.col("_res") > 0)
    df = df.withColumn("outlier", bad).withColumn(value, F.when(~F.col("outlier"), F.col("_med"))).drop("_med", "_res")
    if not replace:
        return df
    return interpolate(df.withColumn("_n", F.row_number().over(along(by, order))), by, "_n", value).drop("_n")


def replaced_outliers(df: DataFrame, by: str, order: str, columns: tuple[str, ...], n: int) -> DataFrame:
    """columns with outliers replaced: a row is one if its distance over all columns from their n-row medians (n odd, zeros beyond the
    ends, the first row as it is) is at least 3 times the mean distance. A run of outliers takes the middle of the rows
    beside it; at an end, half a step on along the line of the two nearest rows."""
    w = along(by, order)
    half = n // 2
    for c in columns:
        around = F.array_sort(F.array(*[F.coalesce(F.lag(c, -k).over(w), F.lit(0.0)) for k in range(-half, half + 1)]))
        df = df.withColumn(f"_m{c}", F.when(F.lag(c).over(w).isNull(), F.col(c)).otherwise(F.element_at(around, half + 1)))
    off = F.sqrt(sum(((F.col(c) - F.col(f"_m{c}")) * (F.col(c) - F.col(f"_m{c}")) for c in columns), F.lit(0.0)))
    df = df.withColumn("_off", off).withColumn("outlier", F.col("_off") >= 3 * F.avg("_off").over(W.partitionBy(by)))
    df = df.withColumn("_good", F.when(~F.col("outlier"), F.struct(*columns)))
    v0, _, v1, _ = neighbours(by, "_good", order, 1)
    df = df.withColumns({"_v0": v0, "_v1": v1})
    # of the known rows beside, those before and behind them
    df = df.withColumns({"_w0": F.when(~F.col("outlier"), F.struct("_v0")), "_w1": F.when(~F.col("outlier"), F.struct("_v1"))})
    df = df.withColumns({"_w0": neighbours(by, "_w0", order, 1)[0], "_w1": neighbours(by, "_w1", order, 1)[2]})
    for c in columns:
        p, q, pp, qq = F.col(f"_v0.{c}"), F.col(f"_v1.{c}"), F.col(f"_w0._v0.{c}"), F.col(f"_w1._v1.{c}")
        new = F.when(p.isNull(), q - F.coalesce(qq - q, F.lit(0.0)) / 2).when(q.isNull(), p + F.coalesce(p - pp, F.lit(0.0)) / 2).otherwise((p + q) / 2)
        df = df.withColumn(c, F.when(F.col("outlier"), new).otherwise(F.col(c)))
    return df.drop("_off", "_good", "_v0", "_v1", "_w0", "_w1", *[f"_m{c}" for c in columns])


def within_elbow(df: DataFrame, by: str, order: str, columns: tuple[str, ...], half: int = 2, bins: int = 10) -> DataFrame:
    """Rows near their moving means: distances from the mean of 2 half + 1 rows are counted in bins of each column; the limit is the middle
    of the first bin but one that is empty in any column (the last bin if none is), and farther rows go."""
    for c in columns:
        df = moving_mean(df, by, order, c, half, "_mean").withColumn(f"_d{c}", F.abs(F.col(c) - F.col("_mean"))).drop("_mean")
    limits = df.groupBy(by).agg(*[x for c in columns for x in (F.min(f"_d{c}").alias(f"_a{c}"), F.max(f"_d{c}").alias(f"_b{c}"))])
    df = df.join(limits, by)
    place = lambda c: F.coalesce(F.least(F.floor(F.try_divide((F.col(f"_d{c}") - F.col(f"_a{c}")) * bins, F.col(f"_b{c}") - F.col(f"_a{c}"))), F.lit(bins - 1)), F.lit(0)).cast("int")
    full = df.groupBy(by).agg(*[F.collect_set(place(c)).alias(f"_s{c}") for c in columns])
    empty = F.filter(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.exists(F.array(*[F.array_contains(f"_s{c}", i) for c in columns]), lambda x: ~x))
    stop = full.select(by, F.coalesce(F.get(empty, F.lit(0)), F.lit(bins - 1)).alias("_stop"))
    far = F.lit(False)
    for c in columns:
        far = far | (F.col(f"_d{c}") > F.col(f"_a{c}") + (F.col("_stop") + 0.5) * (F.col(f"_b{c}") - F.col(f"_a{c}")) / bins)
    return df.join(stop, by).where(~far).drop("_stop", *[f"_{k}{c}" for k in "dab" for c in columns])


def cut_at_jump(df: DataFrame, by: str, order: str, value: str, factor: float = 5.0) -> DataFrame:
    """Rows before the first step of at least `factor` median steps."""
    w = along(by, order)
    df = df.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w)))
    df = df.withColumn("_m", F.median("_d").over(W.partitionBy(by)))
    df = df.withColumn("_cut", F.max(F.coalesce((F.col("_d") >= factor * F.col("_m")).cast("int"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return df.where("_cut = 0").drop("_d", "_m", "_cut")


def islands(df: DataFrame, by: str, order: str, flag: Column) -> DataFrame:
    """(by, first, last, n) of the runs of flagged rows."""
    n = F.row_number().over(along(by, order))
    rows = df.withColumn("_n", n).where(flag)
    rows = rows.withColumn("_g", F.col("_n") - F.row_number().over(along(by, order)))
    return rows.groupBy(by, "_g").agg(F.min("_n").alias("first"), F.max("_n").alias("last"), F.count("*").alias("n")).drop("_g")


def sessions(df: DataFrame, by: str, at: str, factor: float = 1.5) -> DataFrame:
    """Rows with session, which grows where the gap to the row before is at least `factor` mean gaps."""
    w = along(by, at)
    df = df.withColumn("_gap", F.col(at) - F.lag(at).over(w)).withColumn("_mean", F.avg("_gap").over(W.partitionBy(by)))
    return df.withColumn("session", F.sum(F.when(F.col("_gap") >= factor * F.col("_mean"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_gap", "_mean")


def next_match(df: DataFrame, by: str, at: str, probe: Column, target: Column) -> DataFrame:
    """For rows that probe holds for, the place of the first later row that target holds for."""
    ahead = W.partitionBy(by).orderBy(F.desc(at)).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_p", probe).withColumn("match", F.last(F.when(target, F.col(at)), True).over(ahead)).where("_p").drop("_p")


def pps_sync(rows: DataFrame, by: str, at: str, pulse: str, position_ms: str, clock: str, limit: float) -> DataFrame:
    """(by, at, match, trace_offset, time_offset, median_offset) for every row with a pulse: the first row from it on whose position
    time is 0 ms, or 98 to 102 ms if that comes first; offsets of traces and of clocks. The median is over the offsets
    of less than limit traces; pulses that nothing follows are left out."""
    hit = (F.col(position_ms) == 0) | F.col(position_ms).between(98, 102)
    ahead = W.partitionBy(by).orderBy(F.desc(at)).rowsBetween(W.unboundedPreceding, 0)
    found = F.last(F.when(hit, F.struct(F.col(at).alias("at"), F.col(clock).alias("clock"))), True).over(ahead)
    out = rows.withColumn("_m", found).where(F.col(pulse) & F.col("_m").isNotNull())
    out = out.select(by, at, F.col("_m.at").alias("match"), (F.col("_m.at") - F.col(at)).alias("trace_offset"), (F.col(clock) - F.col("_m.clock")).alias("time_offset"))
    return out.withColumn("median_offset", F.median(F.when(F.col("trace_offset") < limit, F.col("time_offset"))).over(W.partitionBy(by)))
