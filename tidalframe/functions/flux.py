"""Numerical fluxes through an interface with normal (nx, ny), from (depth, momentum, momentum) on either side."""

from __future__ import annotations

GRAVITY = 9.81
THIN = 1e-10


def primitives(m, h, hu, hv, nx, ny):
    """Depth kept off zero, velocities, normal velocity and wave speed of one side."""
    h = m.greatest(h, m.lit(THIN))
    u, v = hu / h, hv / h
    return {"h": h, "u": u, "v": v, "un": u * nx + v * ny, "c": m.sqrt(GRAVITY * h)}


def side(x, hu, hv, nx, ny):
    """``primitives`` with the conserved state and the physical flux."""
    press = 0.5 * GRAVITY * x["h"] * x["h"]
    return x | {"q": (x["h"], hu, hv), "f": (x["h"] * x["un"], x["h"] * x["u"] * x["un"] + press * nx, x["h"] * x["v"] * x["un"] + press * ny)}


def _side(m, h, hu, hv, nx, ny):
    return side(primitives(m, h, hu, hv, nx, ny), hu, hv, nx, ny)


def _sides(m, left, right, nx, ny):
    return _side(m, *left, nx, ny), _side(m, *right, nx, ny)


def central(m, left, right, nx, ny):
    a, b = _sides(m, left, right, nx, ny)
    return tuple(0.5 * (x + y) for x, y in zip(a["f"], b["f"], strict=True))


def lax_friedrichs(m, left, right, nx, ny):
    """Central flux less half the jump times the fastest wave of either side."""
    a, b = _sides(m, left, right, nx, ny)
    fast = m.greatest(m.abs(a["un"]) + a["c"], m.abs(b["un"]) + b["c"])
    return tuple(0.5 * (x + y) - 0.5 * fast * (r - s) for x, y, r, s in zip(a["f"], b["f"], b["q"], a["q"], strict=True))


def upwind(m, left, right, vx, vy, nx, ny):
    """Advective flux of a scalar."""
    vn = vx * nx + vy * ny
    return vn * m.when(vn >= 0.0, left, right)


def hllc_speeds(m, a, b):
    """Einfeldt's outer speeds and the contact speed in between, guarded where it is undefined."""
    low = m.least(a["un"] - a["c"], b["un"] - b["c"])
    high = m.greatest(a["un"] + a["c"], b["un"] + b["c"])
    below = a["h"] * (low - a["un"]) - b["h"] * (high - b["un"])
    above = a["h"] * a["un"] * (low - a["un"]) - b["h"] * b["un"] * (high - b["un"]) + 0.5 * GRAVITY * (b["h"] * b["h"] - a["h"] * a["h"])
    defined = m.abs(below) > THIN
    return low, high, m.when(defined, above / m.when(defined, below, 1.0), 0.5 * (a["un"] + b["un"]))


def hllc_flux(m, a, b, low, high, mid, nx, ny):
    """The three-wave flux from the sides and the wave speeds."""

    def star(x, speed):
        gap = speed - mid
        h = x["h"] * (speed - x["un"]) / m.when(gap * gap > 0.0, gap, 1.0)
        state = (h, h * (x["u"] + (mid - x["un"]) * nx), h * (x["v"] + (mid - x["un"]) * ny))
        return tuple(f + speed * (s - q) for f, s, q in zip(x["f"], state, x["q"], strict=True))

    inner = [m.when(mid >= 0.0, x, y) for x, y in zip(star(a, low), star(b, high), strict=True)]
    return tuple(m.when(low >= 0.0, x, m.when(high <= 0.0, y, z)) for x, y, z in zip(a["f"], b["f"], inner, strict=True))


def roe(m, left, right, nx, ny, fix: float = 0.1):
    """Linearised flux with Harten's entropy fix; the mean depth is arithmetic."""
    a, b = _sides(m, left, right, nx, ny)
    ra, rb = m.sqrt(a["h"]), m.sqrt(b["h"])
    h = 0.5 * (a["h"] + b["h"])
    u, v = (ra * a["u"] + rb * b["u"]) / (ra + rb), (ra * a["v"] + rb * b["v"]) / (ra + rb)
    un, c = u * nx + v * ny, m.sqrt(GRAVITY * h)
    width = fix * c

    def speed(x):
        return m.when(m.abs(x) < width, (x * x + width * width) / (2.0 * width), m.abs(x))

    jump_h, jump_n = b["h"] - a["h"], b["un"] - a["un"]
    jump_t = (b["v"] * nx - b["u"] * ny) - (a["v"] * nx - a["u"] * ny)
    slow, shear, fast = 0.5 * (jump_h - h / c * jump_n), h * jump_t, 0.5 * (jump_h + h / c * jump_n)
    waves = (
        speed(un - c) * slow + speed(un + c) * fast,
        speed(un - c) * slow * (u - c * nx) - m.abs(un) * shear * ny + speed(un + c) * fast * (u + c * nx),
        speed(un - c) * slow * (v - c * ny) + m.abs(un) * shear * nx + speed(un + c) * fast * (v + c * ny),
    )
    return tuple(0.5 * (x + y) - 0.5 * w for x, y, w in zip(a["f"], b["f"], waves, strict=True))
