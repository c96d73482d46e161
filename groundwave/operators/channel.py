"""Operators over the traces of a channel."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import spectral, trace, track


def sample_stats(traces: DataFrame, by: list[str], amp: str = "amp") -> DataFrame:
    """by, mean and std arrays, a number for each sample; missing samples (null or NaN) do not count. Partial sums keep the shuffle at a row for each sample, key and task."""
    rows = traces.select(*by, F.posexplode(amp).alias("k", "v")).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).groupBy(*by, "k").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    rows = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "m", "s"))).alias("x"))
    return rows.select(*by, F.transform("x", lambda r: r["m"]).alias("mean"), F.transform("x", lambda r: r["s"]).alias("std"))


def remove_background(traces: DataFrame, by: list[str], amp: str = "amp") -> DataFrame:
    """Minus the mean trace of the channel."""
    stats = sample_stats(traces, by, amp).select(*by, F.col("mean").alias("_mean"))
    return traces.join(stats, by).withColumn(amp, F.zip_with(amp, "_mean", lambda a, m: a - m)).drop("_mean")


def remove_median_background(traces: DataFrame, by: list[str], amp: str = "amp") -> DataFrame:
    """Minus the median trace of the channel; missing samples (null or NaN) do not count. The exact median holds the distinct values of one
    sample of a channel in one task."""
    rows = traces.select(*by, F.posexplode(amp).alias("k", "v")).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).groupBy(*by, "k").agg(F.percentile("v", 0.5).alias("m")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("x"))
    stats = rows.select(*by, F.transform("x", lambda r: r["m"]).alias("_median"))
    return traces.join(stats, by).withColumn(amp, F.zip_with(amp, "_median", lambda a, m: a - m)).drop("_median")


def _around(block: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """First row of the rows within half of each row, and the row behind the last."""
    i = np.arange(len(block))
    return np.maximum(i - half, 0), np.minimum(i + half + 1, len(block))


def moving_mean_kernel(half: int):
    """Minus the mean of the rows within half, of those that are there: running sums, so the time does not depend on half."""

    def kernel(block: np.ndarray) -> np.ndarray:
        first, last = _around(block, half)
        known = ~np.isnan(block)
        zero = np.zeros((1, block.shape[1]))
        total = np.concatenate((zero, np.where(known, block, 0).cumsum(0)))
        count = np.concatenate((zero, known.cumsum(0)))
        n = count[last] - count[first]
        return block - np.divide(total[last] - total[first], n, out=np.full(block.shape, np.nan), where=n > 0)

    return kernel


def moving_median_kernel(half: int):
    """Minus the median of the rows within half, of those that are there."""

    def kernel(block: np.ndarray) -> np.ndarray:
        out = np.empty_like(block)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # rows of missing samples only
            for i, (a, b) in enumerate(zip(*_around(block, half), strict=True)):
                out[i] = block[i] - np.nanmedian(block[a:b], axis=0)
        return out

    return kernel


def apply_blocks(traces: DataFrame, by: str | list[str], order: str, half: int, kernel, amp: str = "amp", rows: int = 1024) -> DataFrame:
    """kernel on blocks of a channel's traces in order, each with `half` more on both sides, so that no task holds a channel. Missing
    traces are NaN for the kernel and stay missing."""
    keys = [by] if isinstance(by, str) else by
    n = F.row_number().over(track.along(by, order)) - 1
    placed = traces.withColumn(amp, F.col(amp).cast("array<double>")).withColumn("_n", n)
    first, last = F.floor(F.greatest(F.col("_n") - half, F.lit(0)) / rows), F.floor((F.col("_n") + half) / rows)
    placed = placed.withColumn("_block", F.explode(F.sequence(first, last)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n").combine_chunks()
        own = pc.equal(pc.floor(pc.divide(pc.cast(table["_n"], pa.float64()), float(rows))), pc.cast(table["_block"], pa.float64()))
        out = spectral.filled(table, amp, kernel)
        return out.filter(own).drop_columns(["_n", "_block"])

    return placed.groupBy(*keys, "_block").applyInArrow(run, placed.drop("_n", "_block").schema)


def remove_moving_median(traces: DataFrame, by: str | list[str], order: str, n: int, amp: str = "amp") -> DataFrame:
    """Minus the median of the n traces around (n odd), fewer at the ends."""
    return apply_blocks(traces, by, order, n // 2, moving_median_kernel(n // 2), amp)


def remove_moving_background(traces: DataFrame, by: str | list[str], order: str, n: int, amp: str = "amp") -> DataFrame:
    """Minus the mean of the n traces around (n odd), fewer at the ends."""
    return apply_blocks(traces, by, order, n // 2, moving_mean_kernel(n // 2), amp)


def replace_bad(traces: DataFrame, by: str, order: str, low: float, high: float, amp: str = "amp") -> DataFrame:
    """Traces whose mean absolute sample is at least high times, or at most 1/low of, the channel's mean are interpolated from the good ones beside them; edges are copied."""
    level = trace.mean(F.transform(amp, F.abs))
    rows = traces.withColumn("_l", level).withColumn("_m", F.avg("_l").over(W.partitionBy(by)))
    bad = (F.col("_l") >= high * F.col("_m")) | (F.col("_l") <= F.col("_m") / low)
    rows = rows.withColumn("bad", bad).withColumn(amp, F.when(~F.col("bad"), F.col(amp))).drop("_l", "_m")
    return track.interpolate(rows, by, order, amp, arrays=True, edges=True)


def balance(traces: DataFrame, by: list[str], amp: str = "amp") -> DataFrame:
    """100 (v - mean) / std of each sample of the channel; 0 where it does not vary."""
    rows = traces.join(sample_stats(traces, by, amp), by)
    zipped = F.zip_with(F.arrays_zip(F.col(amp).alias("a"), F.col("mean").alias("m")), "std", lambda x, s: 100 * F.coalesce(F.try_divide(x["a"] - x["m"], s), F.lit(0.0)))
    return rows.withColumn(amp, zipped).drop("mean", "std")


def virtual_channels(traces: DataFrame, channel: str, order: str, amp: str = "amp", more: int = 0, also: tuple[str, ...] = ()) -> DataFrame:
    """(channel, order, amp, also): channels half way between all neighbours, and `more` beyond either end in steps of a half.

    Ends are those of all channels. A trace number takes the line through the two channels that it has beside, across gaps and
    beyond its ends; it needs two. Columns in `also` (coordinates) follow the same line. A trace number's channels make one row.
    """
    ends = traces.agg(F.min(channel).cast("double").alias("_a"), F.max(channel).cast("double").alias("_b"))
    rows = traces.groupBy(order).agg(F.array_sort(F.collect_list(F.struct(F.col(channel).cast("double").alias("c"), F.col(amp).alias("v"), *also))).alias("_l"))
    half = lambda n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: i * 0.5)
    outer = half(F.lit(more)) if more else F.array().cast("array<double>")
    inner = F.when(F.col("_b") > F.col("_a"), F.transform(F.sequence(F.lit(0), (F.col("_b") - F.col("_a") - 1).cast("int")), lambda i: F.col("_a") + i + 0.5)).otherwise(F.array().cast("array<double>"))
    places = F.concat(F.transform(outer, lambda x: F.col("_a") - x), inner, F.transform(outer, lambda x: F.col("_b") + x))
    rows = rows.where(F.size("_l") > 1).crossJoin(F.broadcast(ends)).withColumn("_v", F.explode(places))
    at = F.greatest(F.lit(1), F.least(F.size(F.filter("_l", lambda x: x["c"] <= F.col("_v"))), F.size("_l") - 1))
    rows = rows.withColumns({"_p": F.element_at("_l", at), "_q": F.element_at("_l", at + 1)}).drop("_l")
    share = (F.col("_v") - F.col("_p.c")) / (F.col("_q.c") - F.col("_p.c"))
    lines = [(F.col(f"_p.{c}") + (F.col(f"_q.{c}") - F.col(f"_p.{c}")) * share).alias(c) for c in also]
    return rows.select(F.col("_v").alias(channel), order, trace.blend(F.col("_p.v"), F.col("_q.v"), share).alias(amp), *lines)


def best_shift(means: DataFrame, channel: str, reference: int | None, max_shift: int, amp: str = "mean", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, channel, shift, r): the shift of the mean trace that correlates best with the reference channel's; the first of equals.
    Both lie among max_shift zeros on either side, so no sample is lost at any shift. With by, every group has its own reference; without a
    reference the least channel is it."""
    known = means if reference is None else means.where(F.col(channel) == reference)
    ref = known.groupBy(*by).agg(F.min_by(amp, channel).alias("_ref")).where("_ref is not null")
    rows = means.join(ref, list(by)) if by else means.crossJoin(F.broadcast(ref))  # one row
    zeros = F.array_repeat(F.lit(0.0), max_shift)
    rows = rows.select(*by, channel, F.explode(F.sequence(F.lit(-max_shift), F.lit(max_shift))).alias("shift"), amp, F.concat(zeros, "_ref", zeros).alias("_ref"))
    rows = rows.select(*by, channel, "shift", amp, F.posexplode("_ref").alias("k", "b"))
    at = F.col("k") - max_shift - F.col("shift")
    a = F.coalesce(F.when(at >= 0, F.get(amp, at)), F.lit(0.0))
    r = rows.groupBy(*by, channel, "shift").agg(F.round(F.corr(a, "b"), 9).alias("r"))
    return r.groupBy(*by, channel).agg(F.max_by("shift", F.struct("r", -F.col("shift"))).alias("shift"), F.max("r").alias("r"))


def valid_everywhere(traces: DataFrame, channel: str, order: str) -> DataFrame:
    """The trace numbers that every channel has."""
    n = traces.select(channel).distinct().agg(F.count("*").alias("_n"))
    return traces.groupBy(order).agg(F.count_distinct(channel).alias("_c")).join(F.broadcast(n), F.col("_c") == F.col("_n")).select(order)


def shifted(traces: DataFrame, shifts: DataFrame, channel: str | list[str], amp: str = "amp") -> DataFrame:
    """Traces moved by their channel's shift in samples, zeros shifted in; channels without one stay."""
    keys = [channel] if isinstance(channel, str) else channel
    rows = traces.join(shifts.select(*keys, F.col("shift").alias("_s")), keys, "left").withColumn("_s", F.coalesce("_s", F.lit(0)))
    move = F.transform(F.sequence(F.lit(0), F.size(amp) - 1), lambda i: F.coalesce(F.when(i >= F.col("_s"), F.get(amp, i - F.col("_s"))), F.lit(0.0)))
    return rows.withColumn(amp, F.when(F.size(amp) > 0, move).otherwise(F.col(amp))).drop("_s")
