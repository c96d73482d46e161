"""Velocity analysis: moveout, semblance, picks and fits. Gathers and velocities are keys, so all sums are grouped."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def moveout(amp: Column, x: Column, v: Column, dt: float, ns: int) -> Column:
    """The samples along the hyperbolas 2 sqrt((t0/2)^2 + 4 x^2 / v^2) of every t0, linear between samples, null beyond the trace."""

    def at(k: Column) -> Column:
        p = 2 * F.sqrt((k * dt / 2) * (k * dt / 2) + 4 * x * x / (v * v)) / dt
        i = F.floor(p).cast("int")
        a, b = F.get(amp, i), F.get(amp, i + 1)
        return F.when(p == i, a).otherwise(a + (b - a) * (p - i))

    return F.transform(F.sequence(F.lit(0), F.lit(ns - 1)), at)


def semblance(traces: DataFrame, gather: str, x: str, dt: float, ns: int, speeds: list[float], half: int = 7, amp: str = "amp") -> DataFrame:
    """(gather, v, k, s): power of the stack over power of the traces after moveout, summed over 2 half + 1 samples. A row a sample and speed leaves a task."""
    v = F.array(*map(F.lit, speeds))
    rows = traces.select(gather, F.col(amp).alias("_a"), F.col(x).alias("_x"), F.explode(v).alias("v"))
    rows = rows.select(gather, "v", F.posexplode(moveout(F.col("_a"), F.col("_x"), F.col("v"), dt, ns)).alias("k", "a"))
    sums = rows.groupBy(gather, "v", "k").agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.col("a") * F.col("a")), F.lit(0.0)).alias("b"), F.count("*").alias("m"))
    w = W.partitionBy(gather, "v").orderBy("k").rowsBetween(-half, half)
    return sums.select(gather, "v", "k", F.try_divide(F.sum(F.col("a") * F.col("a")).over(w), F.col("m") * F.sum("b").over(w)).alias("s"))


def picks(panel: DataFrame, gather: str, threshold: float) -> DataFrame:
    """(gather, k, v, s): the largest inner maximum along the speeds of each time, the slowest of equals; values below the threshold count as 0 and give no pick."""
    w = W.partitionBy(gather, "k").orderBy("v")
    rows = panel.withColumn("s", F.when(F.col("s") >= threshold, F.col("s")).otherwise(0.0))
    rows = rows.withColumns({"_p": F.lag("s").over(w), "_n": F.lead("s").over(w)}).where("s > 0 and s >= _p and s >= _n")
    return rows.groupBy(gather, "k").agg(F.max_by("v", F.struct("s", -F.col("v"))).alias("v"), F.max("s").alias("s"))


def parabola(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, n, a, b, c) of the least-squares y = a + b x + c x^2 from one pass of sums; null where x has fewer than three values."""
    t = F.col(x).cast("double")
    sums = {f"s{p}": F.sum(F.pow(t, F.lit(p))) for p in range(1, 5)} | {f"r{p}": F.sum(F.col(y) * F.pow(t, F.lit(p))) for p in range(3)}
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(x).alias("_d"), *[c.alias(k) for k, c in sums.items()])
    n, s1, s2, s3, s4, r0, r1, r2 = map(F.col, ("n", "s1", "s2", "s3", "s4", "r0", "r1", "r2"))
    a, b, c = s2 * s4 - s3 * s3, s2 * s3 - s1 * s4, s1 * s3 - s2 * s2
    d, e, g = n * s4 - s2 * s2, s1 * s2 - n * s3, n * s2 - s1 * s1
    det = F.when(F.col("_d") >= 3, n * a + s1 * b + s2 * c)
    line = lambda p, q, r: F.try_divide(p * r0 + q * r1 + r * r2, det)
    return rows.select(by, "n", line(a, b, c).alias("a"), line(b, d, e).alias("b"), line(c, e, g).alias("c"))


def hyperbola(df: DataFrame, by: str, x: str, t: str, apexes: list[float]) -> DataFrame:
    """(by, x0, t0, v, r2): of the apexes, that whose line t^2 = t0^2 + 4 (x - x0)^2 / v^2 fits best; the first of equals, only lines with a positive slope and intercept."""
    rows = df.select(by, F.col(x).alias("_x"), (F.col(t) * F.col(t)).alias("_y"), F.explode(F.array(*map(F.lit, apexes))).alias("x0"))
    q = (F.col("_x") - F.col("x0")) * (F.col("_x") - F.col("x0"))
    fit = rows.groupBy(by, "x0").agg(F.regr_slope("_y", q).alias("m"), F.regr_intercept("_y", q).alias("c"), F.round(F.regr_r2("_y", q), 9).alias("r2")).where("m > 0 and c > 0")
    best = fit.groupBy(by).agg(F.max_by(F.struct("x0", "m", "c", "r2"), F.struct("r2", -F.col("x0"))).alias("f"))
    return best.select(by, "f.x0", F.sqrt("f.c").alias("t0"), (2 / F.sqrt("f.m")).alias("v"), "f.r2")


def exponential(df: DataFrame, by: str, x: str, y: str, rates: list[float]) -> DataFrame:
    """(by, a, b, c, r2) of y = a e^(b x) + c: for every b of rates a line is fitted, and the best one wins; the first of equals."""
    rows = df.select(by, F.col(x).alias("_x"), F.col(y).alias("_y"), F.explode(F.array(*map(F.lit, rates))).alias("b"))
    e = F.exp(F.col("b") * F.col("_x"))
    fit = rows.groupBy(by, "b").agg(F.regr_slope("_y", e).alias("a"), F.regr_intercept("_y", e).alias("c"), F.round(F.regr_r2("_y", e), 9).alias("r2")).where("r2 is not null")
    return fit.groupBy(by).agg(F.max_by(F.struct("a", "b", "c", "r2"), F.struct("r2", -F.col("b"))).alias("f")).select(by, "f.*")


def density_clusters(points: np.ndarray, eps: float, least: int) -> np.ndarray:
    """DBSCAN: the cluster of each point from 0, or -1. Clusters are numbered by their first dense point; a point at the rim belongs to the first cluster that reaches it."""
    near = ((points[:, None] - points[None]) ** 2).sum(2) <= eps * eps
    dense, label, found = near.sum(1) >= least, np.full(len(points), -1), 0
    for i in np.flatnonzero(dense):
        if label[i] >= 0:
            continue
        member, front = np.zeros(len(points), bool), np.zeros(len(points), bool)
        front[i] = True
        while front.any():
            member |= front
            front = near[front & dense].any(0) & ~member
        label[member & (label < 0)] = found
        found += 1
    return label


def cluster_picks(picked: DataFrame, panel: DataFrame, gather: str, eps: float, least: int, dt: float = 1.0) -> DataFrame:
    """(gather, cluster, n, k, v, s): picks (see picks()) are clustered by distance in (v, k dt), and each cluster's box gives its largest sample of the panel, the earliest and slowest of equals.

    A gather has at most one pick for each sample of a trace, which bounds a task.
    """

    def boxes(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k", ignore_index=True)
        rows["cluster"] = density_clusters(rows[["v", "t"]].to_numpy(float), eps, least)
        rows = rows[rows["cluster"] >= 0]
        return rows.groupby(["_g", "cluster"], as_index=False).agg(n=("v", "size"), v0=("v", "min"), v1=("v", "max"), k0=("k", "min"), k1=("k", "max"))

    slim = picked.select(F.col(gather).alias("_g"), F.col("k").cast("long").alias("k"), F.col("v").cast("double").alias("v"), (F.col("k") * dt).cast("double").alias("t"))
    kind = slim.schema["_g"].dataType.simpleString()
    box = slim.groupBy("_g").applyInPandas(boxes, f"_g {kind}, cluster long, n long, v0 double, v1 double, k0 long, k1 long")
    inside = panel.select(F.col(gather).alias("_g"), "k", "v", "s").join(box, "_g").where("k between k0 and k1 and v between v0 and v1")
    best = inside.groupBy("_g", "cluster", "n").agg(F.max_by(F.struct("k", "v", "s"), F.struct("s", -F.col("k"), -F.col("v"))).alias("p"))
    return best.select(F.col("_g").alias(gather), "cluster", "n", "p.k", "p.v", "p.s")


def column_clusters(box: np.ndarray, least: int) -> list[np.ndarray]:
    """Clusters (column, sample) of a box (samples x columns): samples of at least half the box's largest value, in runs of `least` or more along a
    column. A run goes on with the clusters of the column before that it shares `least` samples with and that no earlier run of its
    column has taken."""
    high = np.abs(box) >= 0.5 * box.max()
    done, last = [], []
    for i in range(box.shape[1]):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], high[:, i].astype(int), [0]))))
        now = []
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= least:
                parts = [np.column_stack((np.full(b - a, i), np.arange(a, b)))]
                for old in last:
                    if old["points"] is not None and min(b, old["to"]) - max(a, old["from"]) >= least:
                        parts.insert(0, old["points"])
                        old["points"] = None
                now.append({"from": a, "to": b, "points": np.concatenate(parts)})
        done += [old["points"] for old in last if old["points"] is not None]
        last = now
    return done + [old["points"] for old in last if old["points"] is not None]


def cluster_points(picks: DataFrame, traces: DataFrame, by: str, dt: float, half: float, before: float, behind: float, least: int = 3, amp: str = "amp") -> DataFrame:
    """(pick, x, t) of the longest cluster (see column_clusters; the first of equals) around every pick (pick, by, x, t): a point for each of its columns,
    at the mean of the column's samples. A box is the traces (by, x) within half of the pick and the samples from before to behind it, and one task's."""
    first, count = F.ceil((F.col("_t") - before) / dt - 1e-9).cast("int"), int((before + behind) / dt + 1e-9) + 1
    boxed = traces.select(by, "x", amp).join(picks.select("pick", by, F.col("x").alias("_x"), F.col("t").alias("_t")), by).where(F.abs(F.col("x") - F.col("_x")) <= half)
    start = F.greatest(first, F.lit(0))
    boxed = boxed.select("pick", "x", start.alias("start"), F.slice(F.col(amp).cast("array<double>"), start + 1, first - start + count).alias("a"))

    def points(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x", ignore_index=True)
        box = np.array(rows["a"].tolist(), float).T
        found = column_clusters(box, least) if box.size else []
        best = max(found, key=lambda c: len(np.unique(c[:, 0])), default=np.zeros((0, 2), int))
        columns = np.unique(best[:, 0])
        middle = [np.floor(best[best[:, 0] == c, 1].mean() + 0.5) for c in columns]
        return pd.DataFrame({"pick": rows["pick"].iloc[:1].repeat(len(columns)).to_numpy(), "x": rows["x"].to_numpy()[columns], "t": (rows["start"].iloc[0] + np.array(middle)) * dt})

    kind = boxed.schema["pick"].dataType.simpleString()
    return boxed.groupBy("pick").applyInPandas(points, f"pick {kind}, x double, t double")


def picked_velocities(points: DataFrame) -> DataFrame:
    """(pick, x0, t0, v, n): with each of its points (pick, x, t) as apex x0 a line (t/2)^2 = (t0/2)^2 + (x - x0)^2 / v^2 is fitted, and the one that is nearest to the points
    wins, the smallest x0 of equals; only lines with a positive slope and intercept."""
    rows = points.join(points.select("pick", F.col("x").alias("x0")), "pick")
    q, y = (F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0")), F.col("t") * F.col("t") / 4
    fit = rows.groupBy("pick", "x0").agg(F.regr_slope(y, q).alias("m"), F.regr_intercept(y, q).alias("c"), F.round(F.regr_r2(y, q), 9).alias("r2"), F.count("*").alias("n")).where("m > 0 and c > 0")
    best = fit.groupBy("pick").agg(F.max_by(F.struct("x0", "m", "c", "n"), F.struct("r2", -F.col("x0"))).alias("f"))
    return best.select("pick", "f.x0", (2 * F.sqrt("f.c")).alias("t0"), (1 / F.sqrt("f.m")).alias("v"), "f.n")
