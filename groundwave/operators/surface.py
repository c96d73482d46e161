"""Filling of grids: linear interpolation on triangles, inverse distances for whole traces, smooth topography.

A missing cell lies in one triangle of the Delaunay triangulation of the cells within a radius. Seen from
the cell, the triangle is the one whose corners, lifted to the paraboloid, lie lowest above the cell: a
linear programme of three unknowns. It is solved for all missing cells of a tile at once, in numpy; a
tile gets the cells up to the radius around it, so a task holds (tile + 2 radius)^2 cells at most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grid, position
from .shared import cut

#: Cells on one circle allow several triangulations; a fixed number of each cell, far below other differences, decides.
_TIE = 1e-5


def tie(ix, iy):
    """A number in [0, 1) of a cell; cubes tell apart the pairs of corners that face each other in squares."""
    return ((ix * 7919 + iy * 104729) % 1009) ** 3 % 1009 / 1009


def gaps(valid: DataFrame, radius: float) -> DataFrame:
    """(ix, iy): cells within radius of a valid cell that are not valid themselves."""
    near = grid.near_cells(valid.select("ix", "iy"), grid.offsets(radius)).select("ix", "iy").distinct()
    return near.join(valid.select("ix", "iy"), ["ix", "iy"], "left_anti")


def _barycentric(corners: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (n, 3) of points in triangles (n, 3, 2)."""
    (ax, ay), (bx, by), (cx, cy) = (corners[:, i].T for i in range(3))
    det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    u = ((by - cy) * (x - cx) + (cx - bx) * (y - cy)) / det
    v = ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / det
    return np.stack([u, v, 1 - u - v], axis=1)


def triangles(present: np.ndarray, lift: np.ndarray, places: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of n cells at (0, 0): the corners, as indices of places (k, 2), and their weights (n, 3).

    present, lift: (n, k), which places hold a value and how high they are lifted. Indices of k and more
    stand for no place: the cell is outside its neighbours' hull unless their weight is 0.
    """
    far = 8.0 * max(1.0, radius)
    spots = np.vstack([places, [[-far, -far], [far, -far], [0.0, far]]])
    n, k = present.shape
    height = np.hstack([np.where(present, lift, np.inf), np.full((n, 3), 40.0 * max(2.0, radius) ** 4)])
    basis = np.tile(np.arange(k, k + 3), (n, 1))
    live = np.arange(n)
    shift = (1e-4, 2.371373e-5)  # a point beside the cell that no line through two cells meets
    while len(live):
        corners = spots[basis[live]]
        h = np.take_along_axis(height[live], basis[live], 1)
        # the plane through the corners, at every place
        weights = np.stack([_barycentric(corners, x, y) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))], 1)
        a, bx, by = ((w * h).sum(1) for w in weights.transpose(1, 0, 2))
        below = height[live] - (a[:, None] + (bx - a)[:, None] * spots[:, 0] + (by - a)[:, None] * spots[:, 1])
        np.put_along_axis(below, basis[live], np.inf, 1)
        enter = below.argmin(1)
        go = below[np.arange(len(live)), enter] < -1e-9
        live, enter, corners = live[go], enter[go], corners[go]
        if not len(live):
            break
        inside = _barycentric(corners, *shift)
        step = _barycentric(corners, spots[enter, 0], spots[enter, 1])
        ratio = np.where(step > 1e-12, inside / np.where(step > 1e-12, step, 1.0), np.inf)
        basis[live, ratio.argmin(1)] = enter
    return basis, _barycentric(spots[basis], 0.0, 0.0)


def linear_weights(missing: DataFrame, valid: DataFrame, radius: float, tile: int = 64) -> DataFrame:
    """(ix, iy, jx, jy, w): the cells (jx, jy) a missing cell is interpolated from; none if it lies outside the hull of the valid cells within radius."""
    r = math.floor(radius)
    places = np.array([(i, j) for i, j in [(0, 0), *grid.offsets(radius)]], float)
    at = lambda c, d: F.floor((F.col(c) + d) / tile)
    around = valid.select("ix", "iy").withColumn("tx", F.explode(F.sequence(at("ix", -r), at("ix", r)))).withColumn("ty", F.explode(F.sequence(at("iy", -r), at("iy", r))))
    asked = missing.select("ix", "iy", at("ix", 0).alias("tx"), at("iy", 0).alias("ty"), F.lit(True).alias("ask"))
    rows = around.withColumn("ask", F.lit(False)).unionByName(asked).select(*[F.col(c).cast("long").alias(c) for c in ("ix", "iy", "tx", "ty")], "ask")

    def fill(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        x0, y0, size = int(key[0]) * tile - r, int(key[1]) * tile - r, tile + 2 * r
        known = np.zeros((size, size), bool)
        ask = cells["ask"].to_numpy()
        x, y = cells["ix"].to_numpy() - x0, cells["iy"].to_numpy() - y0
        known[x[~ask], y[~ask]] = True
        wanted = np.unique(np.stack([x[ask], y[ask]], 1), axis=0)
        out = []
        for part in np.array_split(wanted, max(1, len(wanted) // 2048)):
            px, py = (part[:, None, i] + places[None, :, i].astype(int) for i in (0, 1))
            lift = (places**2).sum(1)[None] + _TIE * tie(px + x0, py + y0)
            basis, w = triangles(known[px, py], lift, places, radius)
            real = basis < len(places)
            # corners that carry weight must all be cells
            whole = (real | (np.abs(w) < 1e-9)).all(1)
            row, col = np.nonzero(whole[:, None] & real & (w > 1e-9))
            corner = places[basis[row, col]].astype(int)
            out.append(pd.DataFrame({"ix": part[row, 0] + x0, "iy": part[row, 1] + y0, "jx": part[row, 0] + x0 + corner[:, 0], "jy": part[row, 1] + y0 + corner[:, 1], "w": w[row, col]}))
        return pd.concat(out)

    return rows.groupBy("tx", "ty").applyInPandas(fill, "ix long, iy long, jx long, jy long, w double")


def linear(missing: DataFrame, valid: DataFrame, radius: float, v: str = "v") -> DataFrame:
    """(ix, iy, v) of the missing cells that lie in a triangle of valid cells."""
    corners = valid.select(F.col("ix").alias("jx"), F.col("iy").alias("jy"), F.col(v).alias("_v"))
    return linear_weights(missing, valid, radius).join(corners, ["jx", "jy"]).groupBy("ix", "iy").agg(F.sum(F.col("w") * F.col("_v")).alias(v))


def weighted_trace(rows: Column) -> Column:
    """The weighted mean trace of array<struct<w, a>>, a few traces of one length."""
    total = F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["w"])
    n = F.size(F.element_at(rows, 1)["a"])
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["w"] * F.get(r["a"], k)) / total)


def linear_traces(missing: DataFrame, valid: DataFrame, radius: float, amp: str = "amp") -> DataFrame:
    """(ix, iy, amp): whole traces of missing cells, one triangle for all samples."""
    corners = valid.select(F.col("ix").alias("jx"), F.col("iy").alias("jy"), F.col(amp).alias("a"))
    rows = linear_weights(missing, valid, radius).join(corners, ["jx", "jy"])
    return rows.groupBy("ix", "iy").agg(F.sort_array(F.collect_list(F.struct("jx", "jy", "w", "a"))).alias("_r")).select("ix", "iy", weighted_trace(F.col("_r")).alias(amp))


def idw_traces(missing: DataFrame, valid: DataFrame, radius: float, power: float, amp: str = "amp") -> DataFrame:
    """(ix, iy, amp): whole traces of missing cells, the cells within radius weighted by distance^-power."""
    spread = grid.near_cells(valid.select("ix", "iy", F.col(amp).alias("a")), grid.offsets(radius)).withColumn("w", F.pow("d", F.lit(-power)))
    rows = missing.select("ix", "iy").join(spread, ["ix", "iy"])
    return rows.groupBy("ix", "iy").agg(F.collect_list(F.struct("w", "a")).alias("_r")).select("ix", "iy", weighted_trace(F.col("_r")).alias(amp))


def smooth_topography(points: DataFrame, by: str, order: str, dx: float, radius: float, half: int = 0, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """(by, k, z): heights of a track's rows from the smooth surface of all points.

    Heights are averaged in cells of dx, gaps within radius filled on triangles, the surface smoothed by a
    median of 3 x 3 cells, read back between cell centres and averaged over `half` rows to each side; k is
    the row's `order`. Rows between cells that have no height are left out.
    """
    cell = lambda c: F.floor(F.col(c) / dx).cast("long")
    mean = points.where(F.col(z).isNotNull()).groupBy(cell(x).alias("ix"), cell(y).alias("iy")).agg(F.avg(z).alias("v"))
    filled = mean.unionByName(linear(gaps(mean, radius), mean, radius))
    surface = position.median_3x3(filled).select("ix", "iy", F.array("v").alias("amp"))
    asked = points.select(by, F.col(order).alias("k"), (F.col(x) / dx - 0.5).alias("x"), (F.col(y) / dx - 0.5).alias("y"))
    return position.section(asked, by, surface, half).select(by, "k", F.get("amp", F.lit(0)).alias(z))


def rim(valid: DataFrame) -> DataFrame:
    """The valid cells that have a cell without a value beside them: the nearest valid cell of any other place is one of these, as
    a step from it towards that place would be nearer."""
    beside = F.array(*[F.struct((F.col("ix") + i).alias("ix"), (F.col("iy") + j).alias("iy")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    reached = valid.select(F.explode(beside).alias("c")).groupBy("c.ix", "c.iy").agg(F.count("*").alias("_n")).where("_n = 4").select("ix", "iy")
    return valid.join(reached, ["ix", "iy"], "left_anti")


def nearest(missing: DataFrame, valid: DataFrame, v: str = "v", tile: int = 16) -> DataFrame:
    """(ix, iy, v, d): every missing cell with the value of the nearest valid one and its distance; of equally near ones that of the least iy, then ix.

    Rings grow: a cell is compared with the rim cells of its own tile and the eight around it, and is done if one of them is no further away
    than a tile is wide, as nothing beyond can be nearer. Those left go on with tiles twice as wide, until all have their nearest: a
    round for each doubling of the greatest distance. valid has one row for each cell; nulls don't count; without valid cells nothing is returned.
    """
    valid = valid.where(F.col(v).isNotNull()).select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col(v).alias("_v"))
    edge = cut(rim(valid))
    left = missing.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy")).distinct()
    done = None
    size = tile
    empty = edge.isEmpty()
    while not empty:
        at = lambda c, size=size: F.floor(F.col(c) / size)
        near = lambda c: F.explode(F.array(c - 1, c, c + 1))
        asked = left.withColumn("tx", near(at("ix"))).withColumn("ty", near(at("iy")))
        known = edge.select(at("ix").alias("tx"), at("iy").alias("ty"), F.col("ix").alias("_x"), F.col("iy").alias("_y"), "_v")
        d = (F.col("ix") - F.col("_x")) * (F.col("ix") - F.col("_x")) + (F.col("iy") - F.col("_y")) * (F.col("iy") - F.col("_y"))
        best = asked.join(known, ["tx", "ty"]).groupBy("ix", "iy").agg(F.min(F.struct(d.alias("d"), F.col("_y").alias("y"), F.col("_x").alias("x"), "_v")).alias("b"))
        met = cut(left.join(best, ["ix", "iy"], "left").withColumn("_done", F.coalesce(F.col("b.d") <= size * size, F.lit(False))))
        found = met.where("_done").select("ix", "iy", F.col("b._v").alias(v), F.sqrt("b.d").alias("d"))
        done = found if done is None else done.unionByName(found)
        left = met.where(~F.col("_done")).select("ix", "iy")
        empty, size = left.isEmpty(), size * 2
    if done is None:
        return left.limit(0).select("ix", "iy", F.lit(None).cast(valid.schema["_v"].dataType).alias(v), F.lit(None).cast("double").alias("d"))
    return done


def linear_or_nearest(missing: DataFrame, valid: DataFrame, radius: float, v: str = "v") -> DataFrame:
    """(ix, iy, v) of all missing cells: on a triangle of valid cells within radius its plane, elsewhere the value of the nearest one."""
    inside = cut(linear(missing, valid, radius, v).select("ix", "iy", v))
    outside = nearest(missing.join(inside, ["ix", "iy"], "left_anti"), valid, v)
    return inside.unionByName(outside.select("ix", "iy", v))


def area_topography(points: DataFrame, asked: DataFrame, dx: float, radius: float, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """asked (x, y and other columns) with z from heights of an area: means in cells of dx; a place takes the height of its cell, which is interpolated
    on triangles within radius where the cell has none, and beyond them the nearest one's. Places without coordinates have a null."""
    cell = lambda c: F.floor(F.col(c) / dx).cast("long")
    known = cut(points.where(F.col(z).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cell(x).alias("ix"), cell(y).alias("iy")).agg(F.avg(z).cast("double").alias("v")))
    rows = asked.drop(z).withColumns({"ix": cell(x), "iy": cell(y)})
    wanted = rows.where("ix is not null and iy is not null").select("ix", "iy").distinct()
    heights = known.unionByName(linear_or_nearest(wanted.join(known, ["ix", "iy"], "left_anti"), known, radius))
    return rows.join(heights.withColumnRenamed("v", z), ["ix", "iy"], "left").drop("ix", "iy")


def line_topography(heights: DataFrame, asked: DataFrame, by: str, at: str, z: str = "z") -> DataFrame:
    """asked (by, at and other columns) with z on the lines between the heights (by, at, z) of its own profile; null before the first and behind
    the last one. Several heights of one place count as their mean."""
    from . import track

    mean = heights.where(F.col(at).isNotNull() & F.col(z).isNotNull()).groupBy(by, F.col(at).cast("double").alias("_at")).agg(F.avg(z).alias("_z"))
    rows = asked.drop(z).withColumn("_at", F.col(at).cast("double"))
    places = rows.where("_at is not null").select(by, "_at").union(mean.select(by, "_at")).distinct().join(mean, [by, "_at"], "left")
    filled = track.interpolate(places, by, "_at", "_z").select(by, "_at", F.col("_z").alias(z))
    return rows.join(filled, [by, "_at"], "left").drop("_at")
