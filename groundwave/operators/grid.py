"""Bins, tiles, slices and neighbourhoods. Cells are found by arithmetic, so joins are on equal keys."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bin_of(value: Column, start: float, width: float, n: int) -> Column:
    """0-based bin; the last right edge belongs to the last bin; null outside."""
    i = F.floor((value - start) / width).cast("int")
    return F.when(value == start + n * width, n - 1).when(i.between(0, n - 1), i)


def binned(df: DataFrame, x: Column, y: Column, xs: tuple[float, float, int], ys: tuple[float, float, int]) -> DataFrame:
    return df.withColumns({"ix": bin_of(x, *xs), "iy": bin_of(y, *ys)}).where("ix is not null and iy is not null")


def mean_trace_of_cells(traces: DataFrame, cell: list[str], amp: str = "amp") -> DataFrame:
    """One mean trace for each cell."""
    from .channel import sample_stats

    return sample_stats(traces, cell, amp).select(*cell, F.col("mean").alias(amp))


def first_of_cells(traces: DataFrame, cell: list[str], order: Column, amp: str = "amp") -> DataFrame:
    return traces.groupBy(*cell).agg(F.min_by(amp, order).alias(amp), F.min(order).alias("trace"))


def tiles(df: DataFrame, x: Column, width: float, border: float, start: float = 0.0) -> DataFrame:
    """A row for each tile [start + i width - border, start + (i+1) width + border] that holds x."""
    low = F.ceil((x - start - border) / width - 1).cast("int")
    high = F.floor((x - start + border) / width).cast("int")
    return df.withColumn("tile", F.explode(F.sequence(low, high))).where((F.col("tile") >= 0))


def slice_table(thick: float, overlap: float, tmax: float) -> list[tuple[float, float]]:
    """Half-open [start, end) of the slices; overlap is at most half the thickness; a part slice at the end is dropped unless it is the first."""
    overlap = min(overlap, thick / 2)
    out, start = [], 0.0
    while start + thick <= tmax or not out:
        out.append((start, start + thick))
        start += thick - overlap
    return out


def slices(cells: DataFrame, keys: list[str], dt: float, table: list[tuple[float, float]], kind: str, amp: str = "amp") -> DataFrame:
    """keys, slice, v. The samples of each slice are cut from the array: no explosion to samples and no interval join.
    kind: sumabs, rms, sqrt (of the sum of absolute samples), value or absolute (of the slice's first sample, for slices of one)."""

    def of(values: Column) -> Column:
        absolute = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x))
        if kind == "sumabs":
            return absolute
        if kind in ("value", "absolute"):
            return F.get(values, 0) if kind == "value" else F.abs(F.get(values, 0))
        if kind == "rms":
            return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x) / F.size(values))
        return F.sqrt(absolute)

    parts = []
    for i, (a, b) in enumerate(table):
        first, last = math.ceil(a / dt - 1e-9), math.ceil(b / dt - 1e-9)
        parts.append(F.struct(F.lit(i).alias("slice"), F.slice(F.col(amp), first + 1, last - first).alias("s")))
    rows = cells.select(*keys, F.explode(F.array(*parts)).alias("p")).select(*keys, "p.slice", "p.s").where(F.size("s") > 0)
    return rows.select(*keys, "slice", of(F.col("s")).alias("v"))


def minmax_normalized(df: DataFrame, by: str, v: str = "v") -> DataFrame:
    limits = df.groupBy(by).agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    return df.join(limits, by).withColumn(v, F.coalesce(F.try_divide(F.col(v) - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0))).drop("_a", "_b")


def offsets(radius: float) -> list[tuple[int, int]]:
    r = math.floor(radius)
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if 0 < i * i + j * j <= radius * radius]


def near_cells(df: DataFrame, moves: list[tuple[int, int]]) -> DataFrame:
    """Every row once for each offset, at the cell it reaches, with its distance."""
    table = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"), F.lit(math.hypot(i, j)).alias("d")) for i, j in moves])
    return df.withColumn("_o", F.explode(table)).withColumns({"ix": F.col("ix") + F.col("_o.di"), "iy": F.col("iy") + F.col("_o.dj"), "d": F.col("_o.d")}).drop("_o")


def idw(missing: DataFrame, valid: DataFrame, radius: float, power: float, v: str = "v") -> DataFrame:
    """Missing cells (ix, iy) with the mean of valid cells within radius, weighted by distance^-power. The valid side spreads to the cells around, an equi-join and a sum follow."""
    spread = near_cells(valid, offsets(radius)).withColumn("_w", F.pow("d", F.lit(-power)))
    return missing.join(spread, ["ix", "iy"]).groupBy("ix", "iy").agg((F.sum(F.col(v) * F.col("_w")) / F.sum("_w")).alias(v), F.count("*").alias("n"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of two arrays; null if one does not vary."""
    from .trace import mean, total

    ma, mb = mean(a), mean(b)
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    cov = total(F.transform(pairs, lambda p: (p["a"] - ma) * (p["b"] - mb)))
    return F.try_divide(cov, F.sqrt(total(F.transform(a, lambda x: (x - ma) * (x - ma))) * total(F.transform(b, lambda x: (x - mb) * (x - mb)))))


def coherence(cells: DataFrame, first: int, n: int, amp: str = "amp") -> DataFrame:
    """(ix, iy, v): mean of 1 - r with the up to four neighbours over n samples from first (1-based)."""
    rows = cells.select("ix", "iy", F.slice(amp, first, n).alias("a"))
    shifted = near_cells(rows.withColumnRenamed("a", "b"), [(1, 0), (-1, 0), (0, 1), (0, -1)]).select("ix", "iy", "b")
    return rows.join(shifted, ["ix", "iy"]).groupBy("ix", "iy").agg(F.avg(1 - correlation(F.col("a"), F.col("b"))).alias("v"), F.count("*").alias("n"))


def coherence_cube(cells: DataFrame, dt: float, wavelengths: float = 1.0, length: float = 0.25, speed: float = 0.1, amp: str = "amp", tile: int = 32) -> DataFrame:
    """(ix, iy, amp): at every sample the mean of 1 - r with the up to four neighbours that have a trace, over the samples
    of a window that slides along the trace: round(wavelengths length / speed / dt) steps long, its middle (the later of two) is the
    sample. Null where no window lies, and where nothing varies. Cells have one trace each; one without a neighbour is left out.

    Cells are dealt to tiles with a border of one cell, so a trace is shuffled about once, and a task holds one tile.
    """
    from .spectral import _block, _lists

    steps = math.floor(wavelengths * length / speed / dt + 0.5)
    # a window from sample t (1-based) belongs to sample t + steps / 2, rounded up
    first = math.floor(1 + steps / 2 + 0.5) - 1

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = (np.lib.stride_tricks.sliding_window_view(x, steps + 1, axis=1) for x in (a, b))
        a, b = a - a.mean(2, keepdims=True), b - b.mean(2, keepdims=True)
        scale = np.sqrt((a * a).sum(2) * (b * b).sum(2))
        return 1 - np.divide((a * b).sum(2), scale, out=np.full(scale.shape, np.nan), where=scale > 1e-300)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tx, ty = (int(k.as_py()) for k in key)
        x, y, block = table["ix"].to_numpy() - tx * tile + 1, table["iy"].to_numpy() - ty * tile + 1, _block(table["a"].combine_chunks())
        place = np.full((tile + 2, tile + 2), -1)
        place[x, y] = np.arange(len(x))
        own = np.flatnonzero((x >= 1) & (x <= tile) & (y >= 1) & (y <= tile) & (place[x, y] == np.arange(len(x))))
        sums, counts, met = np.zeros((len(own), block.shape[1])), np.zeros((len(own), block.shape[1])), np.zeros(len(own), bool)
        if block.shape[1] > steps:
            for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                beside = place[x[own] + i, y[own] + j]
                hit = np.flatnonzero(beside >= 0)
                met[hit] = True
                for at in range(0, len(hit), 256):
                    some = hit[at : at + 256]
                    r = apart(block[own[some]], block[beside[some]])
                    span = slice(first, first + r.shape[1])
                    sums[some, span] += np.nan_to_num(r)
                    counts[some, span] += ~np.isnan(r)
        else:
            for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                met |= place[x[own] + i, y[own] + j] >= 0
        out = np.divide(sums, counts, out=np.full(sums.shape, np.nan), where=counts > 0)[met]
        own = own[met]
        return pa.table({"ix": table["ix"].to_numpy()[own], "iy": table["iy"].to_numpy()[own], amp: _lists(out)})

    rows = cells.where(F.col(amp).isNotNull()).select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col(amp).cast("array<double>").alias("a"))
    tiles_of = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / tile), F.floor((F.col(c) + 1) / tile)))
    found = rows.withColumn("tx", tiles_of("ix")).withColumn("ty", tiles_of("iy")).groupBy("tx", "ty").applyInArrow(run, f"ix long, iy long, {amp} array<double>")
    kinds = cells.schema
    return found.select(F.col("ix").cast(kinds["ix"].dataType).alias("ix"), F.col("iy").cast(kinds["iy"].dataType).alias("iy"), amp)


def without_places(df: DataFrame, *columns: str) -> DataFrame:
    """Without the rows where a coordinate is missing (null or NaN)."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
    return df


def masked(cells: DataFrame, mask: str, *values: str) -> DataFrame:
    """Values are null where the mask does not hold (false, 0 or null); the cells stay."""
    return cells.withColumns({v: F.when(F.col(mask).cast("boolean"), F.col(v)) for v in values})


def line_crossing(one: tuple[Column, ...], two: tuple[Column, ...]) -> tuple[Column, Column]:
    """(x, y) where the lines through (x1, y1, x2, y2) cross, beyond their ends too; null if they are parallel. Lines may be upright."""
    (x1, y1, x2, y2), (x3, y3, x4, y4) = one, two
    cross = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
    t = F.try_divide((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3), cross)
    return x1 + t * (x2 - x1), y1 + t * (y2 - y1)


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule; edges are half-open in y."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            at = x1 + (y - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when((y >= min(y1, y2)) & (y < max(y1, y2)) & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def last_wins(df: DataFrame, keys: list[str], order: Column, v: str) -> DataFrame:
    """The value of the latest row, even if it is null."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(v), order).alias("_v")).select(*keys, F.col(f"_v.{v}").alias(v))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new, keys, "left_anti").unionByName(new)


def rotation(points: DataFrame, x: str = "x", y: str = "y", step: int = 5, limit: int = 45) -> DataFrame:
    """(angle, area): of the angles -limit to limit, that whose bounding rectangle is smallest; the smallest angle of equals. One pass for all angles."""
    aggregates = []
    for a in range(-limit, limit + 1, step):
        c, s = math.cos(math.radians(a)), math.sin(math.radians(a))
        u, v = F.col(x) * c - F.col(y) * s, F.col(x) * s + F.col(y) * c
        aggregates.append(F.struct(F.round((F.max(u) - F.min(u)) * (F.max(v) - F.min(v)), 6).alias("area"), F.lit(a).alias("angle")))
    best = F.array_min(F.array(*aggregates))
    return points.agg(best.alias("b")).select("b.angle", "b.area")


def level_to(df: DataFrame, by: str, reference: str, v: str) -> DataFrame:
    """Every group's values moved so that its median is the reference group's."""
    mid = df.groupBy(by).agg(F.median(v).alias("_m"))
    ref = mid.where(F.col(by) == reference).select(F.col("_m").alias("_r"))
    return df.join(mid, by).crossJoin(F.broadcast(ref.limit(1))).withColumn(v, F.col(v) - F.col("_m") + F.col("_r")).drop("_m", "_r")


def clip_limits(df: DataFrame, by: str, v: str, percent: float) -> DataFrame:
    """(by, low, high): distinct sorted values at round(n p) and its mirror."""
    rows = df.select(by, v).distinct()
    w = W.partitionBy(by)
    rows = rows.withColumns({"_i": F.row_number().over(w.orderBy(v)), "_n": F.count("*").over(w)})
    cut = F.greatest(F.round(F.col("_n") * percent / 100), F.lit(1))
    return rows.groupBy(by).agg(F.max(F.when(F.col("_i") == cut, F.col(v))).alias("low"), F.max(F.when(F.col("_i") == F.col("_n") - cut + 1, F.col(v))).alias("high"))
