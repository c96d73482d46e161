"""Distance maps and 3-D migration."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import track
from .spectral import _lists


def distance_map(cells: DataFrame, radius: float) -> DataFrame:
    """(slice, ix, iy, d): every cell within radius of a set cell and its distance to the nearest one, steps of 3/4 along the axes and of 1 across.

    Set cells spread to the cells around and the least distance is kept, so no task holds an image;
    a row for each cell of the neighbourhood is the cost, combined before the shuffle.
    """
    reach = math.floor(radius / 0.75)
    near = [(i, j, (4 * min(abs(i), abs(j)) + 3 * abs(abs(i) - abs(j))) / 4) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(d).alias("d")) for i, j, d in near if d <= radius])
    rows = cells.select("slice", "ix", "iy", F.explode(table).alias("o"))
    return rows.groupBy("slice", (F.col("ix") + F.col("o.i")).alias("ix"), (F.col("iy") + F.col("o.j")).alias("iy")).agg(F.min("o.d").alias("d"))


def interpolation_mask(cells: DataFrame, radius: float) -> DataFrame:
    """(slice, ix, iy): the cells that are to be filled, at most radius from a cell with data."""
    return distance_map(cells, radius).select("slice", "ix", "iy")


def migrate(
    cells: DataFrame, dx: float, dt: float, speed: float, aperture: float, dz: float, nz: int, amp: str = "amp", height: str | None = None, image: DataFrame | None = None, ns: int | None = None, tile: int | None = None, under_relief: bool = False
) -> DataFrame:
    """(ix, iy, amp): semicircle migration onto nz depths, from 0 on in steps of dz.

    A trace gives to an image cell its sample at round(2 r / v / dt), r being the way to it, if the angle from the vertical
    is under aperture/2; the weight is 0 in the middle of the beam and 1 at its edge, and sums are divided by the number of
    contributions. The image has the cells with traces, or those of `image` (ix, iy and the height).

    With a column of heights, depths count from the highest cell; a cell's first depth is at its surface; the angle
    is a right angle less that between the way and the line to the surface above the image point, 0 straight below; ns, the
    samples of a trace, then bounds how far a trace reaches. A null height is the highest. under_relief adds to nz the depths that
    the relief of the traces has.

    The image is dealt to tiles of `tile` x `tile` cells, each with the traces up to the reach around it: a trace is shuffled once for each
    tile that it reaches, 9 times at most where a tile is as wide as the reach or wider, and a task holds the traces of one tile.
    """
    half = math.radians(aperture / 2)
    far = nz * dz * math.tan(half)
    if height:
        if ns is None:
            raise ValueError("heights need ns, the number of samples")
        far = ns * dt * speed / 2
    reach = math.floor(far / dx)
    tile = tile or max(16, reach)
    moves = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if dx * math.hypot(i, j) <= far]
    places = cells if image is None else image
    below = lambda df: (F.col(height).cast("double") if height else F.lit(0.0)).alias("h")
    sources = cells.where(F.col(amp).isNotNull()).select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), below(cells), F.col(amp).cast("array<double>").alias("a"))
    targets = places.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), below(places), F.lit(None).cast("array<double>").alias("a")).dropDuplicates(["ix", "iy"])
    at = lambda c, d: F.floor((F.col(c) + d) / tile)
    around = lambda c: F.explode(F.sequence(at(c, -reach), at(c, reach)))
    rows = sources.withColumn("tx", around("ix")).withColumn("ty", around("iy")).unionByName(targets.withColumns({"tx": at("ix", 0), "ty": at("iy", 0)}))
    if height:  # depths count from the highest of all: one row
        relief = cells.agg(F.max(height).alias("a"), (F.max(height) - F.min(height)).alias("relief")).crossJoin(places.agg(F.max(height).alias("b")))
        more = F.floor(F.coalesce("relief", F.lit(0.0)) / dz + 0.5) if under_relief else F.lit(0)
        rows = rows.crossJoin(F.broadcast(relief.select(F.greatest("a", "b").cast("double").alias("top"), (more + nz).cast("long").alias("nz"))))
        rows = rows.withColumn("h", F.coalesce(F.col("top") - F.col("h"), F.lit(0.0))).drop("top")
    else:
        rows = rows.withColumn("nz", F.lit(nz).cast("long"))
    kernel = _tile_kernel(amp, moves, dx, dt, speed, half, dz, tile, reach, bool(height))
    out = rows.groupBy("tx", "ty").applyInArrow(kernel, f"ix long, iy long, {amp} array<double>")
    x, y = places.schema["ix"].dataType, places.schema["iy"].dataType
    return out.select(F.col("ix").cast(x).alias("ix"), F.col("iy").cast(y).alias("iy"), amp)


def _tile_kernel(amp, moves, dx, dt, speed, half, dz, tile, reach, relief):
    """The image of one tile: for every move, all cells of the tile at once take the samples of the traces that lie so far away."""
    rounded = lambda x: np.floor(x + 0.5).astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        nz = table["nz"][0].as_py()
        z_axis = np.arange(nz) * dz
        ix, iy, h = (table[c].to_numpy() for c in ("ix", "iy", "h"))
        column = table["a"].combine_chunks()
        source = column.is_valid().to_numpy(zero_copy_only=False)
        here = ~source
        if not here.any() or not source.any():
            return pa.table({"ix": pa.array([], pa.int64()), "iy": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64()))}).rename_columns(["ix", "iy", amp])
        x0, y0 = int(np.floor(ix[here][0] / tile)) * tile, int(np.floor(iy[here][0] / tile)) * tile
        lists = column.filter(pa.array(source))
        lengths = pc.list_value_length(lists).to_numpy()
        n = int(lengths.max())
        samples = np.full((len(lists), n), np.nan)
        samples[np.arange(n) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        sx, sy, sh = ix[source] - x0 + reach, iy[source] - y0 + reach, h[source]
        # traces of one cell come in layers, so that a layer has one at most
        order = np.lexsort((sy, sx))
        same = np.concatenate([[False], (sx[order][1:] == sx[order][:-1]) & (sy[order][1:] == sy[order][:-1])])
        starts = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        layer = np.empty(len(same), np.int64)
        layer[order] = np.arange(len(same)) - starts
        cx, cy, ch = ix[here] - x0, iy[here] - y0, h[here]
        sums, counts = np.zeros((len(cx), nz)), np.zeros((len(cx), nz))
        first = rounded(ch / dz)[:, None] <= np.arange(nz)
        for i in range(int(layer.max()) + 1):
            where = np.full((tile + 2 * reach, tile + 2 * reach), -1, np.int64)
            where[sx[layer == i], sy[layer == i]] = np.flatnonzero(layer == i)
            for di, dj in moves:
                trace = where[cx - di + reach, cy - dj + reach]
                hit = np.flatnonzero(trace >= 0)
                if not len(hit):
                    continue
                trace, d = trace[hit], dx * math.hypot(di, dj)
                z = z_axis[None, :] - sh[trace][:, None] if relief else z_axis[None, :]
                way = np.hypot(d, z)
                if relief and d:
                    rise = (ch[hit] - sh[trace])[:, None]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        angle = np.pi / 2 - np.arccos(np.clip((d * d + z * rise) / (way * np.hypot(d, rise)), -1, 1))
                elif relief:
                    angle = np.zeros(way.shape)
                else:
                    angle = np.arctan2(d, z)
                at = rounded(2 * way / speed / dt)
                with np.errstate(invalid="ignore"):
                    ok = (angle < half) & (at < n) & first[hit]
                got = samples[trace[:, None], np.broadcast_to(np.minimum(at, n - 1), (len(hit), nz))]
                ok = ok & ~np.isnan(got)
                weight = 0.5 - 0.5 * np.cos(angle / half * np.pi)
                sums[hit] += np.where(ok, got * weight, 0)
                counts[hit] += ok
        some = counts.any(1)
        image = np.divide(sums, counts, out=np.zeros_like(sums), where=counts > 0)[some]
        return pa.table({"ix": ix[here][some], "iy": iy[here][some], "v": _lists(image)}).rename_columns(["ix", "iy", amp])

    return run


def migrate_profile(traces: DataFrame, by: str | list[str], order: str, dx: float, dt: float, speed: float, aperture: float, ns: int, reach: int | None = None, amp: str = "amp") -> DataFrame:
    """Time migration along a profile, traces dx apart: our own sum along diffraction hyperbolas.

    The image at sample k takes from a trace d away its sample at round(sqrt(k^2 + (2 d / (v dt))^2)),
    weighted by the cosine of the angle from the vertical, if the angle is at most aperture/2; the sum is
    divided by the weights. The traces to each side are those that the aperture meets within ns samples, or
    `reach` if it is given: a window, so every trace is shuffled once.
    """
    if reach is None:
        reach = math.floor((ns - 0.5) * math.sin(math.radians(min(aperture, 180) / 2)) * speed * dt / (2 * dx) + 1e-9)
    around = F.collect_list(F.struct(F.col(order).alias("o"), F.col(amp).alias("a"))).over(track.along(by, order).rangeBetween(-reach, reach))
    half = math.cos(math.radians(aperture / 2))

    def at(k):
        def add(acc, t):
            p = F.hypot(k.cast("double"), (t["o"] - F.col(order)) * (2 * dx / (speed * dt)))
            lean = F.when(p == 0, 1.0).otherwise(k / p)
            sample = F.get(t["a"], F.round(p).cast("int"))
            return F.when((lean >= half) & sample.isNotNull(), F.struct((acc["s"] + lean * sample).alias("s"), (acc["w"] + lean).alias("w"))).otherwise(acc)

        return F.aggregate("_w", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), add, lambda acc: F.coalesce(F.try_divide(acc["s"], acc["w"]), F.lit(0.0)))

    return traces.withColumn("_w", around).withColumn(amp, F.transform(F.sequence(F.lit(0), F.size(amp) - 1), at)).drop("_w")
