"""Terrain-following vertical coordinate: transforms, metric terms and stretching."""

from __future__ import annotations

DRY = 1e-10


def to_sigma(m, z, eta, h):
    depth = eta + h
    return m.when(depth < DRY, -0.5, (z - eta) / depth)


def to_z(m, sigma, eta, h):
    return eta + sigma * (eta + h)


def dsigma_dz(m, eta, h):
    depth = eta + h
    return m.when(depth > DRY, 1.0 / depth, 0.0)


def slope(m, sigma, eta, h, deta, dh):
    """Horizontal derivative of sigma at fixed z, from those of eta and h along the same axis."""
    depth = eta + h
    return m.when(depth < DRY, 0.0, -(deta + sigma * (deta + dh)) / depth)


def tendency(m, sigma, eta, h, deta_dt):
    """Time derivative of sigma at fixed position."""
    depth = eta + h
    return m.when(depth < DRY, 0.0, -(deta_dt * (1.0 + sigma)) / depth)


def z_slope(m, sigma, deta, dh):
    return deta + sigma * (deta + dh)


def z_tendency(m, sigma, deta_dt):
    return deta_dt * (1.0 + sigma)


def surface_stretch(m, s, theta: float):
    """sinh stretching; a vanishing parameter leaves s as it is."""
    return s if theta < 1e-6 else m.sinh(theta * s) / m.sinh(m.lit(float(theta)))


def bottom_stretch(m, s, theta: float):
    return s if theta < 1e-6 else (m.exp(theta * (s + 1.0)) - 1.0) / (m.exp(m.lit(float(theta))) - 1.0) - 1.0


def blended_stretch(m, s, theta_s: float, theta_b: float):
    """Surface and bottom stretching, blended as Song and Haidvogel (1994) do."""
    top = surface_stretch(m, s, theta_s)
    if theta_b < 1e-6:
        return top
    cosh = m.cosh(m.lit(float(theta_s)))
    share = theta_b * (cosh - 1.0) / (cosh + 1.0)
    return (1.0 - share) * top + share * bottom_stretch(m, s, theta_b)


def roms_stretch(m, s, theta_s: float, theta_b: float):
    """Shchepetkin and McWilliams (2005): a cosh law above, an exponential one below."""
    top = (1.0 - m.cosh(theta_s * s)) / (m.cosh(m.lit(float(theta_s))) - 1.0) if theta_s > 0 else -(s * s)
    low = (m.exp(theta_b * (s + 1.0)) - 1.0) / (m.exp(m.lit(float(theta_b))) - 1.0) - 1.0 if theta_b > 0 else s
    return (s + 1.0) * top + (1.0 - (s + 1.0)) * low


def stretch(m, kind: str, s, theta_s: float = 5.0, theta_b: float = 0.4):
    laws = {
        "uniform": lambda: s, "surface": lambda: surface_stretch(m, s, theta_s), "bottom": lambda: bottom_stretch(m, s, theta_b),
        "surface_bottom": lambda: blended_stretch(m, s, theta_s, theta_b), "roms": lambda: roms_stretch(m, s, theta_s, theta_b),
    }
    if kind not in laws:
        raise ValueError(f"unknown stretching {kind!r}")
    return laws[kind]()


def stretch_derivative(m, kind: str, s, theta_s: float = 5.0, theta_b: float = 0.4, step: float = 1e-6):
    """Central difference, one-sided at the ends of [-1, 0]."""
    up, down = m.least(s + step, m.lit(0.0)), m.greatest(s - step, m.lit(-1.0))
    return (stretch(m, kind, up, theta_s, theta_b) - stretch(m, kind, down, theta_s, theta_b)) / (up - down)
