"""Positions to traces: fixes along a profile, offsets of the channels, traces that every channel has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import track

PLACES = ("x", "y", "z")


def place(traces: DataFrame, fixes: DataFrame, by: str = "profile", beyond: bool = False, least: int = 0) -> DataFrame:
    """Traces (by, channel, trace) with the x, y and z of fixes (by, trace, x, y, z), interpolated on the trace number.

    Traces before the first and behind the last fix go, or lie on the line through the two nearest (beyond). Profiles
    whose largest trace number is under `least` go. Several fixes of a trace count as their mean. Fixes may stand at
    numbers that no trace has: numbers are placed once, for all channels.
    """
    mean = fixes.groupBy(by, "trace").agg(*[F.avg(c).alias(c) for c in PLACES])
    numbers = traces.select(by, "trace").union(mean.select(by, "trace")).distinct()
    placed = numbers.join(mean, [by, "trace"], "left")
    for c in PLACES:
        placed = track.interpolate(placed, by, "trace", c, edges="line" if beyond else False)
    placed = placed.where("x is not null and y is not null")
    if least:
        traces = traces.join(traces.groupBy(by).agg(F.max("trace").alias("_last")).where(F.col("_last") >= least).select(by), by, "left_semi")
    return traces.drop(*PLACES).join(placed, [by, "trace"])


def channel_offsets(placed: DataFrame, offsets: DataFrame, by: str = "profile", ahead: int = 15) -> DataFrame:
    """x and y of each channel's middle: `along` m in the direction to the trace `ahead` further on (the last one near the end),
    `across` m to the right of it, by offsets (channel, across, along). The last trace goes on along the line of the two before it; a profile
    of one trace, and traces that don't move, stay. Channels without offsets stay too."""
    w = W.partitionBy(by, "channel").orderBy("trace")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = placed.join(F.broadcast(offsets), "channel", "left") if offsets.count() <= 10_000 else placed.join(offsets, "channel", "left")
    rows = rows.withColumns({"_dx": F.coalesce(F.lead("x", ahead).over(w), F.last("x").over(whole)) - F.col("x"), "_dy": F.coalesce(F.lead("y", ahead).over(w), F.last("y").over(whole)) - F.col("y")})
    far = F.hypot("_dx", "_dy")
    u, v = F.coalesce(F.try_divide(F.col("_dx"), far), F.lit(0.0)), F.coalesce(F.try_divide(F.col("_dy"), far), F.lit(0.0))
    across, along = F.coalesce("across", F.lit(0.0)), F.coalesce("along", F.lit(0.0))
    rows = rows.withColumns({"_x": F.col("x") + along * u + across * v, "_y": F.col("y") + along * v - across * u, "_end": F.lead("x").over(w).isNull()})
    on = lambda c: 2 * F.lag(c, 1).over(w) - F.lag(c, 2).over(w)
    rows = rows.withColumns({c: F.when(F.col("_end"), F.coalesce(on(f"_{c}"), F.col(f"_{c}"))).otherwise(F.col(f"_{c}")) for c in ("x", "y")})
    return rows.drop("_dx", "_dy", "_x", "_y", "_end", "across", "along")


def midpoints(pairs: DataFrame, senders: DataFrame, receivers: DataFrame) -> DataFrame:
    """(channel, across, along): the middle of a channel's sender and receiver; pairs (channel, sender, receiver), both others (no, across, along)."""
    rows = pairs.join(senders.select(F.col("no").alias("sender"), F.col("across").alias("_a"), F.col("along").alias("_b")), "sender")
    rows = rows.join(receivers.select(F.col("no").alias("receiver"), F.col("across").alias("_c"), F.col("along").alias("_d")), "receiver")
    return rows.select("channel", ((F.col("_a") + F.col("_c")) / 2).alias("across"), ((F.col("_b") + F.col("_d")) / 2).alias("along"))


def common_length(traces: DataFrame, by: str = "profile") -> DataFrame:
    """Traces up to the number that every channel of the profile reaches."""
    last = traces.groupBy(by, "channel").agg(F.max("trace").alias("_n")).groupBy(by).agg(F.min("_n").alias("_n"))
    return traces.join(last, by).where("trace <= _n").drop("_n")


def minus_overall_mean(traces: DataFrame, by: str, amp: str = "amp") -> DataFrame:
    """Samples minus the mean of all samples of the group (a file)."""
    sums = traces.groupBy(by).agg((F.sum(F.aggregate(amp, F.lit(0.0), lambda a, x: a + x)) / F.sum(F.size(amp))).alias("_mean"))
    return traces.join(sums, by).withColumn(amp, F.transform(amp, lambda x: x - F.col("_mean"))).drop("_mean")
