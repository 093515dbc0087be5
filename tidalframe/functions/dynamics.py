"""Pointwise laws of motion and step control."""

from __future__ import annotations

GRAVITY = 9.81
DRY = 1e-10


def coriolis(m, y, f0: float, beta: float, y0: float):
    return f0 + beta * (y - y0)


def friction(m, kind: str, u, v, depth, cd: float):
    """Bottom stress (x, y); in Manning's law ``cd`` is the roughness."""
    speed = m.sqrt(u * u + v * v)
    factor = {
        "linear": lambda: m.lit(cd), "quadratic": lambda: cd * speed,
        "manning": lambda: m.when(depth > 1e-6, cd * cd * GRAVITY / m.power(m.greatest(depth, m.lit(1e-6)), m.lit(1.0 / 3.0)) * speed, 0.0),
    }[kind]()
    return -(factor * u), -(factor * v)


def wind_forcing(m, stress, depth, rho0: float = 1025.0):
    return m.when(depth > DRY, stress / (rho0 * depth), 0.0)


def velocity(m, transport, depth):
    return m.when(depth > DRY, transport / depth, 0.0)


def vertical_velocity(m, omega, sigma, depth, u, v, deta_dt, zx, zy):
    """Physical vertical velocity from the one through sigma surfaces and their slopes."""
    return depth * omega + u * zx + v * zy + deta_dt * (1.0 + sigma)


def wave_speed(m, u, depth):
    return m.abs(u) + m.sqrt(GRAVITY * m.greatest(depth, m.lit(0.0)))


def cfl_step(m, speed, size, cfl: float, least: float, most: float):
    """Largest stable step, within bounds; the longest one where nothing moves."""
    return m.when(speed < 1e-14, most, m.least(m.lit(most), m.greatest(m.lit(least), cfl * size / m.greatest(speed, m.lit(1e-14)))))


def error_step(m, dt, error, tolerance: float, least: float, most: float, safety: float = 0.9):
    """Step after a local error, for a method of fourth order."""
    grown = m.least(dt * 2.0, m.lit(most))
    scaled = safety * dt * m.power(tolerance / m.greatest(error, m.lit(1e-14)), m.lit(0.25))
    return m.when(error < 1e-14, grown, m.least(m.lit(most), m.greatest(m.lit(least), scaled)))


def relaxation(m, x, y, box, width: float, least: float, edges=(True, True, True, True)):
    """Smoothstep of the distance to the enabled edges (left, right, bottom, top), scaled to [least, 1]."""
    if width <= 0 or not any(edges):
        return m.lit(1.0)
    x0, x1, y0, y1 = box
    gaps = [g for g, on in zip((x - x0, x1 - x, y - y0, y1 - y), edges, strict=True) if on]
    near = gaps[0] if len(gaps) == 1 else m.least(*gaps)
    t = m.least(m.lit(1.0), m.greatest(m.lit(0.0), near / width))
    return m.when(near >= width, 1.0, least + (1.0 - least) * (t * t * (3.0 - 2.0 * t)))


def unit_parameter(m, x, low, size):
    """Position within a cell, clamped to [0, 1]."""
    return m.greatest(m.lit(0.0), m.least(m.lit(1.0), (x - low) / size))
