"""Polynomial bases on the unit interval and square: Bernstein, Lagrange, Gauss points.

Small tables are computed on the driver with numpy and meet the data as joins or literals.
"""

from __future__ import annotations

from math import comb

import numpy as np


def bernstein(m, degree: int, i: int, u):
    """The i-th Bernstein polynomial of a degree."""
    out = m.lit(float(comb(degree, i)))
    for _ in range(i):
        out = out * u
    for _ in range(degree - i):
        out = out * (1.0 - u)
    return out


def bernstein_slope(m, degree: int, i: int, u):
    low = bernstein(m, degree - 1, i - 1, u) if i > 0 else m.lit(0.0)
    high = bernstein(m, degree - 1, i, u) if i < degree else m.lit(0.0)
    return degree * (low - high)


def tensor(m, degree: int, k: int, u, v):
    """The k-th product basis on the square, u fastest."""
    return bernstein(m, degree, k % (degree + 1), u) * bernstein(m, degree, k // (degree + 1), v)


def bernstein_table(degree: int, points) -> np.ndarray:
    """Values of all Bernstein polynomials (columns) at the points (rows)."""
    x = np.asarray(points, dtype=float)
    return np.stack([comb(degree, i) * x**i * (1 - x) ** (degree - i) for i in range(degree + 1)], axis=1)


def bernstein_slopes(degree: int, points) -> np.ndarray:
    low = bernstein_table(degree - 1, points)
    zero = np.zeros((len(low), 1))
    return degree * (np.hstack([zero, low]) - np.hstack([low, zero]))


def gauss(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on [0, 1], for 1 to 6 points."""
    if not 1 <= n <= 6:
        raise ValueError(f"{n} Gauss points; 1 to 6 are supported")
    x, w = np.polynomial.legendre.leggauss(n)
    return (x + 1) / 2, w / 2


def lobatto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Lobatto-Legendre nodes and weights on [-1, 1]."""
    if n < 2:
        raise ValueError("Lobatto rules have 2 points or more")
    p = np.polynomial.legendre.Legendre.basis(n - 1)
    inner = np.sort(p.deriv().roots().real) if n > 2 else np.zeros(0)
    x = np.concatenate([[-1.0], inner, [1.0]])
    return x, 2 / (n * (n - 1) * p(x) ** 2)


def lagrange_table(nodes, points) -> np.ndarray:
    """Values of the Lagrange polynomials on ``nodes`` (columns) at the points (rows)."""
    nodes, points = np.asarray(nodes, float), np.asarray(points, float)
    out = np.ones((len(points), len(nodes)))
    for i in range(len(nodes)):
        for j in range(len(nodes)):
            if i != j:
                out[:, i] *= (points - nodes[j]) / (nodes[i] - nodes[j])
    return out


def derivative_matrix(nodes) -> np.ndarray:
    """Derivatives of the Lagrange polynomials (columns) at their nodes (rows), by barycentric weights."""
    x = np.asarray(nodes, float)
    gap = x[:, None] - x[None, :] + np.eye(len(x))
    w = 1 / gap.prod(axis=1)
    out = (w[None, :] / w[:, None]) / gap
    np.fill_diagonal(out, 0)
    np.fill_diagonal(out, -out.sum(axis=1))
    return out


def bernstein_to_nodes(degree: int, nodes=None) -> np.ndarray:
    """Matrix from Bernstein coefficients to values at nodes; its inverse leads back."""
    return bernstein_table(degree, np.linspace(0, 1, degree + 1) if nodes is None else nodes)


def extraction(degree: int, half: int) -> np.ndarray:
    """Bernstein coefficients on one half of the interval (0: lower) from those on the whole."""
    out = np.zeros((degree + 1, degree + 1))
    for i in range(degree + 1):
        for j in range(i + 1):
            out[i, j] = comb(i, j) / 2**i
    return out if half == 0 else out[::-1, ::-1]
