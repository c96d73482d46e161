"""Operators over a whole survey that join several clocks, channels and rectangles in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from . import channel, grid, trace, track

PLACES = ("x", "y", "z")


def pps_positions(clock: DataFrame, fixes: DataFrame, limit: float, by: str = "profile", warm_up: float = 5000.0) -> DataFrame:
    """fixes (by, trace, pos_ms, x, y, z), each at the place that its trace had: three clocks are joined one after the other.

    clock (by, trace, cu_ms, pulse) is the control unit's log. A pulse counts from warm_up ms on, and where its trace is over one
    behind the last pulse's; the first one has nothing before it and doesn't count. From a pulse's trace the first row with a
    positioning time of 0 ms, or 98 to 102 ms, gives the offset of the control unit's clock (`track.pps_sync`); the median of a file's offsets
    of less than `limit` traces moves all its positioning times, and coordinates are interpolated at the moved times, on the line
    of the two nearest beyond the ends. Of fixes of one time the first trace's counts; those without a coordinate are places to find only. Files
    without an offset go.
    """
    w = W.partitionBy(by).orderBy("trace")
    rows = clock.select(by, "trace", "cu_ms", "pulse").join(fixes.select(by, "trace", "pos_ms"), [by, "trace"], "full")
    rows = rows.withColumns({"cu_ms": F.last("cu_ms", True).over(w), "ms": F.col("pos_ms") % 1000, "pulse": F.coalesce("pulse", F.lit(False))})
    before = F.last(F.when(F.col("pulse"), F.col("trace")), True).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("pulse", F.coalesce(F.col("pulse") & (F.col("cu_ms") > warm_up) & (F.col("trace") - before > 1), F.lit(False)))
    offset = track.pps_sync(rows, by, "trace", "pulse", "ms", "cu_ms", limit).groupBy(by).agg(F.first("median_offset").alias("_offset"))
    asked = fixes.join(offset, by).withColumn("_at", (F.col("pos_ms") - F.col("_offset")).cast("double")).where("_at is not null")
    whole = fixes.where(" AND ".join(f"{c} IS NOT NULL" for c in PLACES))
    known = whole.groupBy(by, F.col("pos_ms").cast("double").alias("_at")).agg(F.min_by(F.array(*[F.col(c).cast("double") for c in PLACES]), "trace").alias("_p"))
    times = known.select(by, "_at").union(asked.select(by, "_at")).distinct().join(known, [by, "_at"], "left")
    times = track.interpolate(times, by, "_at", "_p", edges="line", arrays=True)
    out = asked.drop(*PLACES).join(times, [by, "_at"])
    return out.withColumns({c: F.get("_p", F.lit(i)) for i, c in enumerate(PLACES)}).drop("_at", "_offset", "_p")


def sample_slices(traces: DataFrame, dt: float, tmax: float, xs: tuple[float, float, int], ys: tuple[float, float, int], more: int = 0) -> DataFrame:
    """(ix, iy, amp, channel, profile): the value of every sample up to tmax in each bin, from traces (profile, channel, trace, x, y, amp).

    One plan, nothing is written between: samples are balanced in each profile's channel; virtual channels with their coordinates lie half
    way between all channels, and `more` beyond either end; a bin takes the first trace of each channel; what is in bins is balanced again;
    of the traces in a bin the last profile's counts, in it a real channel's before a virtual one's, then the highest channel's.
    """
    real = channel.balance(traces.withColumn("amp", trace.cut_time(F.col("amp"), dt, tmax)), ["profile", "channel"]).withColumn("_key", F.struct("profile", "trace"))
    virtual = channel.virtual_channels(real, "channel", "_key", more=more, also=("x", "y"))
    columns = [F.col("_key.profile").alias("profile"), F.col("channel").cast("double").alias("channel"), F.col("_key.trace").alias("trace"), "x", "y", "amp"]
    both = real.select(*columns, F.lit(1).alias("real")).unionByName(virtual.select(*columns, F.lit(0).alias("real")))
    first = grid.first_of_cells(grid.binned(both, F.col("x"), F.col("y"), xs, ys), ["profile", "channel", "real", "ix", "iy"], F.col("trace"))
    level = channel.balance(first, ["profile", "channel"])
    won = level.groupBy("ix", "iy").agg(F.max_by(F.struct("amp", "channel", "profile"), F.struct("profile", "real", "channel")).alias("w"))
    return won.select("ix", "iy", "w.*")


def block_traces(rectangles: DataFrame, corner: tuple[float, float], dx: float, shape: tuple[int, int], to_block: tuple[float, float, float, float] = (1.0, 0.0, 0.0, 0.0), amp: str = "amp") -> DataFrame:
    """(ix, iy, x, y, n, amp): whole traces of an area, from rectangles (rectangle, x, y, amp) of a survey.

    to_block (a, b, tx, ty) brings the rectangles' coordinates to those of the area, whose first bin's middle is corner, with shape bins of
    dx. A bin takes the mean trace of each rectangle and the mean of these, n being their number; x and y are its
    middle in the rectangles' coordinates, by the inverse of to_block.
    """
    u, v = geo.transformed(F.col("x"), F.col("y"), to_block)
    rows = grid.binned(rectangles, u, v, (corner[0] - dx / 2, dx, shape[0]), (corner[1] - dx / 2, dx, shape[1]))
    each = grid.mean_trace_of_cells(rows, ["rectangle", "ix", "iy"], amp)
    out = grid.mean_trace_of_cells(each, ["ix", "iy"], amp).join(each.groupBy("ix", "iy").agg(F.count("*").alias("n")), ["ix", "iy"])
    a, b, tx, ty = to_block
    size = a * a + b * b
    mu, mv = corner[0] + F.col("ix") * dx - tx, corner[1] + F.col("iy") * dx - ty
    return out.select("ix", "iy", ((a * mu + b * mv) / size).alias("x"), ((a * mv - b * mu) / size).alias("y"), "n", amp)
