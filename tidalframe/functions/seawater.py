"""Density of seawater and what derives from it (temperature °C, salinity PSU, pressure dbar)."""

from __future__ import annotations

# The published polynomial coefficients of the international equation of state (1980),
# each list by rising power of temperature; pressures in bar.
PURE_WATER = (999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9)
PURE_WATER_JM = (999.842594, 6.793952e-2, -9.09529e-3, 1.001685e-4, -1.120083e-6, 6.536336e-9)
SALT = (8.24493e-1, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9)
SALT_15 = (-5.72466e-3, 1.0227e-4, -1.6546e-6)
SALT_2 = 4.8314e-4
BULK = (19652.21, 148.4206, -2.327105, 1.360477e-2, -5.155288e-5)
BULK_SALT = (54.6746, -0.603459, 1.09987e-2, -6.1670e-5)
BULK_SALT_15 = (7.944e-2, 1.6483e-2, -5.3009e-4)
BULK_P = (3.239908, 1.43713e-3, 1.16092e-4, -5.77905e-7)
BULK_P_SALT = (2.2838e-3, -1.0981e-5, -1.6078e-6)
BULK_P_SALT_15 = 1.91075e-4
BULK_P2 = (8.50935e-5, -6.12293e-6, 5.2787e-8)
BULK_P2_SALT = (-9.9348e-7, 2.0816e-8, 9.1697e-10)
# The reference state of the linear law.
LINEAR = {"t0": 10.0, "s0": 35.0, "rho0": 1025.0, "alpha": 2.0e-4, "beta": 7.6e-4}
GRAVITY = 9.81


def polynomial(x, coefficients):
    """Horner's rule, by rising power."""
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = c + x * out
    return out


def linear(m, t, s, p):
    """Density of the linear law; pressure has no part in it."""
    return LINEAR["rho0"] * (1.0 - LINEAR["alpha"] * (t - LINEAR["t0"]) + LINEAR["beta"] * (s - LINEAR["s0"]))


def _surface(m, t, s, pure):
    return polynomial(t, pure) + polynomial(t, SALT) * s + polynomial(t, SALT_15) * m.sqrt(s * s * s) + SALT_2 * s * s


def unesco(m, t, s, p):
    """In-situ density by the 1980 international equation of state; TEOS-10 falls back to it."""
    bar, s15 = p * 0.1, m.sqrt(s * s * s)
    rho = _surface(m, t, s, PURE_WATER)
    bulk = polynomial(t, BULK) + polynomial(t, BULK_SALT) * s + polynomial(t, BULK_SALT_15) * s15
    first = polynomial(t, BULK_P) + polynomial(t, BULK_P_SALT) * s + BULK_P_SALT_15 * s15
    second = polynomial(t, BULK_P2) + polynomial(t, BULK_P2_SALT) * s
    return m.when(bar <= 0.0, rho, rho / (1.0 - bar / (bulk + first * bar + second * bar * bar)))


def jackett(m, t, s, p):
    """In-situ density with the simplified bulk modulus of the 1995 fit."""
    bar = p * 0.1
    rho = _surface(m, t, s, PURE_WATER_JM)
    bulk = polynomial(t, BULK[:4]) + polynomial(t, BULK_SALT[:3]) * s + polynomial(t, BULK_P[:3]) * bar + BULK_P2[0] * bar * bar
    return m.when(bar <= 0.0, rho, rho / (1.0 - bar / bulk))


LAWS = {"linear": linear, "unesco": unesco, "jackett": jackett, "teos10": unesco}


def anomaly(m, law, t, s, p):
    return LAWS[law](m, t, s, p) - 1000.0


def potential_density(m, law, t, s):
    return LAWS[law](m, t, s, m.lit(0.0))


def thermal_expansion(m, law, t, s, p, step: float = 0.01):
    rho = LAWS[law]
    return (rho(m, t - step, s, p) - rho(m, t + step, s, p)) / (2.0 * step * rho(m, t, s, p))


def haline_contraction(m, law, t, s, p, step: float = 0.01):
    rho = LAWS[law]
    return (rho(m, t, s + step, p) - rho(m, t, s - step, p)) / (2.0 * step * rho(m, t, s, p))


def compressibility(m, law, t, s, p, step: float = 1.0):
    """The lower pressure stops at the surface, the divisor does not."""
    rho = LAWS[law]
    return (rho(m, t, s, p + step) - rho(m, t, s, m.greatest(m.lit(0.0), p - step))) / (2.0 * step * rho(m, t, s, p))


def sound_speed(m, t, s, p):
    return polynomial(t, (1449.2, 4.6, -0.055, 0.00029)) + (1.34 - 0.01 * t) * (s - 35.0) + 0.016 * p
