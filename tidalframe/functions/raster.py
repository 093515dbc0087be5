"""Raster arithmetic: geotransforms, missing values, depth conventions, map projection."""

from __future__ import annotations

import math


def pixel_to_world(m, px, py, gt):
    return gt[0] + px * gt[1] + py * gt[2], gt[3] + px * gt[4] + py * gt[5]


def world_to_pixel(m, x, y, gt):
    """Fractional pixel; a singular transform gives 0, 0."""
    det = gt[1] * gt[5] - gt[2] * gt[4]
    if abs(det) < 1e-15:
        return m.lit(0.0), m.lit(0.0)
    dx, dy = x - gt[0], y - gt[3]
    return (gt[5] * dx - gt[2] * dy) / det, (gt[1] * dy - gt[4] * dx) / det


def missing(m, value, nodata: float):
    return (m.abs(value - nodata) < 1e-6) | (value > 1e30)


def depth(m, value, nodata: float, positive: bool):
    """Depth, positive downward; 0 on land and where the value is missing."""
    down = value if positive else -value
    return m.when(missing(m, value, nodata), 0.0, m.when(down > 0.0, down, 0.0))


def land(m, value, nodata: float, positive: bool):
    return missing(m, value, nodata) | ((value <= 0.0) if positive else (value >= 0.0))


def bilinear(m, fx, fy, e00, e10, e01, e11):
    return (1.0 - fx) * (1.0 - fy) * e00 + fx * (1.0 - fy) * e10 + (1.0 - fx) * fy * e01 + fx * fy * e11


# The European conformal conic projection (GRS 80 ellipsoid, parallels 35 and 65 N, origin 52 N 10 E).
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
PARALLELS, ORIGIN, OFFSET = (35.0, 65.0), (52.0, 10.0), (4_000_000.0, 2_800_000.0)


def _cone():
    """Cone constant, scale and radius at the origin, from the ellipsoid and the parallels."""
    e = math.sqrt(FLATTENING * (2 - FLATTENING))

    def t(lat):
        s = e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    a, b, o = (math.radians(x) for x in (*PARALLELS, ORIGIN[0]))
    width = [math.cos(x) / math.sqrt(1 - (e * math.sin(x)) ** 2) for x in (a, b)]
    n = (math.log(width[0]) - math.log(width[1])) / (math.log(t(a)) - math.log(t(b)))
    scale = width[0] / (n * t(a) ** n)
    return e, n, scale, AXIS * scale * t(o) ** n


def conic_to_lonlat(m, x, y, rounds: int = 6):
    """Longitude and latitude in degrees of a position in the conic projection."""
    e, n, scale, r0 = _cone()
    dx, dy = x - OFFSET[0], r0 - (y - OFFSET[1])
    t = m.power(m.sqrt(dx * dx + dy * dy) / (AXIS * scale), m.lit(1.0 / n))
    lon = m.atan2(dx, dy) / n * (180.0 / math.pi) + ORIGIN[1]
    lat = math.pi / 2 - 2.0 * m.atan(t)
    for _ in range(rounds):
        s = e * m.sin(lat)
        lat = math.pi / 2 - 2.0 * m.atan(t * m.power((1.0 - s) / (1.0 + s), m.lit(e / 2)))
    return lon, lat * (180.0 / math.pi)
