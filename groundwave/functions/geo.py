"""Geodesy and travel times as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 axis and flattening, UTM scale and false easting.
AXIS, FLAT, SCALE, EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def utm(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """(east, north, zone) of the transverse Mercator series on the northern grid, in metres."""
    e2 = FLAT * (2 - FLAT)
    ep2 = e2 / (1 - e2)
    zone = (F.floor((lon + 180) / 6) + 1).cast("int")
    phi, centre = F.radians(lat), F.radians(zone * 6 - 183)
    n = AXIS / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, a = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), F.cos(phi) * (F.radians(lon) - centre)
    arc = AXIS * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = SCALE * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120) + EAST
    north = SCALE * (arc + n * F.tan(phi) * (F.pow(a, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720))
    return east, north, zone


def rotate(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return x * c - y * s, x * s + y * c


def similarity(pairs: list[tuple[float, float, float, float]]) -> tuple[float, float, float, float]:
    """(a, b, tx, ty) of X = a x - b y + tx, Y = b x + a y + ty, fitted by least squares to control points (x, y, X, Y)."""
    n = len(pairs)
    mx, my, mX, mY = (sum(p[i] for p in pairs) / n for i in range(4))
    d = sum((x - mx) ** 2 + (y - my) ** 2 for x, y, *_ in pairs)
    a = sum((x - mx) * (X - mX) + (y - my) * (Y - mY) for x, y, X, Y in pairs) / d
    b = sum((x - mx) * (Y - mY) - (y - my) * (X - mX) for x, y, X, Y in pairs) / d
    return a, b, mX - a * mx + b * my, mY - b * mx - a * my


def transformed(x: Column, y: Column, fit: tuple[float, float, float, float]) -> tuple[Column, Column]:
    a, b, tx, ty = fit
    return x * a - y * b + tx, x * b + y * a + ty


def hyperbola(t0: Column, x: Column, x0: Column, v: Column) -> Column:
    """Two-way time 2 sqrt((t0/2)^2 + ((x-x0)/v)^2)."""
    return 2 * F.sqrt(F.pow(t0 / 2, 2) + F.pow((x - x0) / v, 2))


def ddmm(value: Column) -> Column:
    """Degrees of ddmm.mmmm."""
    d = F.floor(value / 100)
    return d + (value - 100 * d) / 60


def packed_time(bits: Column) -> Column:
    """The time of a packed number of 32 bits: from the low end seconds/2 (5), minutes (6), hours (5), day (5), month (4), years since 1980 (7); null if it is no date."""
    part = lambda shift, width: F.shiftrightunsigned(bits.cast("long"), shift).bitwiseAND(F.lit((1 << width) - 1))
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", part(25, 7) + 1980, part(21, 4), part(16, 5), part(11, 5), part(5, 6), part(0, 5) * 2)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def gga_seconds(text: Column) -> Column:
    """Seconds of the day of hhmmss.ss; null if it is no time."""
    number = text.try_cast("double")
    h, m = F.floor(number / 10000), F.floor(number / 100) % 100
    s = number - h * 10000 - m * 100
    return F.when((h < 24) & (m < 60) & (s < 61), h * 3600 + m * 60 + s)
