"""Analytic depth functions and initial states, as expressions (see ``functions.dual``)."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 100.0


def _band(m, gap, half: float, sharp: float):
    """1 inside a band of the given half width, 0 outside, with walls as steep as ``sharp``."""
    return 0.5 - 0.5 * m.tanh(sharp * (m.abs(gap) - half))


def _peak(m, dx, dy, radius: float, power: float):
    """1 at the top of a round mountain, 0 from ``radius`` on."""
    r = m.sqrt(dx * dx + dy * dy) / radius
    return m.when(r < 1.0, m.pow(m.greatest(1.0 - r, m.lit(0.0)), m.lit(power)), 0.0)


# Fixed values of the six depths: heights in metres, places as shares of the square.
def slope(m, x, y):
    return 50.0 + 100.0 * (x / SIZE) + 50.0 * (y / SIZE)


def canyon(m, x, y):
    """A slope cut by a winding canyon along y."""
    return slope(m, x, y) + 150.0 * _band(m, x / SIZE - 0.3 - 0.05 * m.sin(4.0 * pi * (y / SIZE)), 0.05, 50.0)


def seamount(m, x, y):
    """A mountain on a plain."""
    return 200.0 - 150.0 * _peak(m, x / SIZE - 0.7, y / SIZE - 0.6, 0.15, 0.7)


def ridge(m, x, y):
    """Three parallel ridges across a plain, the outer ones lower."""
    depth = m.lit(150.0)
    for offset, height in ((-0.25, 64.0), (0.0, 80.0), (0.25, 64.0)):
        gap = m.abs(x / SIZE - 0.5 * (y / SIZE) - offset)
        wave = m.cos(pi / 0.16 * gap)
        depth = depth - m.when(gap < 0.08, height * (wave * wave), 0.0)
    return depth


def canyon_seamount(m, x, y):
    """A straight canyon and a mountain on a gentle slope."""
    return 100.0 + 50.0 * (x / SIZE) + 120.0 * _band(m, x / SIZE - 0.25, 0.04, 60.0) - 100.0 * _peak(m, x / SIZE - 0.75, y / SIZE - 0.5, 0.12, 0.8)


def shelf(m, x, y):
    """A shelf that breaks off at 0.4 of the width."""
    return 175.0 + 125.0 * m.tanh((x / SIZE - 0.4) / 0.02)


def bump(m, x, y, length: float = 1000.0):
    """exp of a product of sines over a square of the given length."""
    return m.exp(m.sin(2.0 * pi / length * x) * m.sin(2.0 * pi / length * y))


DEPTHS = {"slope": slope, "canyon": canyon, "seamount": seamount, "ridge": ridge, "canyon_seamount": canyon_seamount, "shelf": shelf}


def grid(spark: SparkSession, n: int = 200, size: float = SIZE) -> DataFrame:
    """A regular n x n grid of (ix, iy, x, y) over the square, in closed form from a range."""
    at = spark.range(n * n)
    step = size / (n - 1)
    ix, iy = F.col("id") % n, F.floor(F.col("id") / n).cast("long")
    return at.select(ix.alias("ix"), iy.alias("iy"), (ix * step).alias("x"), (iy * step).alias("y"))


def quiescent(m, x, y, h):
    return {"eta": m.lit(0.0), "u": m.lit(0.0), "v": m.lit(0.0), "t": m.lit(10.0), "s": m.lit(35.0)}


def kelvin_wave(m, x, y, h, amplitude: float, k: float, f: float, gravity: float = 9.81):
    """A coastally trapped wave: it decays over the Rossby radius and moves along x."""
    c = m.sqrt(gravity * h)
    eta = amplitude * m.exp(-(y * f / c)) * m.cos(k * x)
    return {"eta": eta, "u": eta * (gravity / c), "v": m.lit(0.0), "t": m.lit(10.0), "s": m.lit(35.0)}


def lock_exchange(m, x, y, h, middle: float, cold: float = 5.0, warm: float = 15.0):
    return {"eta": m.lit(0.0), "u": m.lit(0.0), "v": m.lit(0.0), "t": m.when(x < middle, cold, warm), "s": m.lit(35.0)}
