"""Quadratic forms and conditions of tensor-product patches: slopes, curvatures, edge rows, interior penalties.

The forms are small constant matrices in Bernstein coefficients, scaled by each patch's size, so a patch's energy is
one projection and an edge's is one join.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mass(degree: int) -> np.ndarray:
    """Integrals of products of two Bernstein polynomials over the unit interval."""
    n = degree
    return np.array([[comb(n, i) * comb(n, j) / comb(2 * n, i + j) / (2 * n + 1) for j in range(n + 1)] for i in range(n + 1)])


def steps(degree: int, order: int) -> np.ndarray:
    """From coefficients to those of the derivative: scaled differences."""
    out = np.eye(degree + 1)
    for k in range(order):
        out = (degree - k) * np.diff(out, axis=0)
    return out


def form(degree: int, order: int) -> np.ndarray:
    """Integrals of products of two derivatives of an order, in coefficients."""
    d = steps(degree, order)
    return d.T @ mass(degree - order) @ d


def quadratic(matrix: np.ndarray, values: str) -> Column:
    """x' M x of an array column; zero entries are left out."""
    parts = []
    for i, row in enumerate(matrix):
        terms = [float(m) * F.element_at(values, j + 1) for j, m in enumerate(row) if abs(m) > 1e-15]
        if terms:
            parts.append(F.element_at(values, i + 1) * sum(terms[1:], terms[0]))
    return sum(parts[1:], parts[0])


def energy(patches: DataFrame, degree: int, values: str = "coefficients", key: str = "leaf") -> DataFrame:
    """(key, dirichlet, thin_plate): integrals of squared slopes, and of squared curvatures with the mixed one twice."""
    m, a, b = form(degree, 0), form(degree, 1), form(degree, 2)
    dx, dy = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    pieces = {"xx": np.kron(m, a), "yy": np.kron(a, m), "xxxx": np.kron(m, b), "yyyy": np.kron(b, m), "xxyy": np.kron(a, a)}
    rows = patches.select(key, dx.alias("dx"), dy.alias("dy"), values)
    for name, matrix in pieces.items():
        rows = rows.withColumn(name, quadratic(matrix, values))
    dirichlet = F.col("xx") * F.col("dy") / F.col("dx") + F.col("yy") * F.col("dx") / F.col("dy")
    plate = F.col("xxxx") * F.col("dy") / F.pow("dx", F.lit(3.0)) + F.col("yyyy") * F.col("dx") / F.pow("dy", F.lit(3.0)) + 2.0 * F.col("xxyy") / (F.col("dx") * F.col("dy"))
    return rows.select(key, dirichlet.alias("dirichlet"), plate.alias("thin_plate"))


def edge_weights(degree: int, edge: str, at: int, order: int) -> list[tuple[int, float]]:
    """(coefficient, weight) of the derivative of an order across an edge, at its control point ``at``, on the unit square."""
    d = steps(degree, order)
    row = d[0] if edge in ("left", "bottom") else d[-1]
    n = degree + 1
    return [(int(k + n * at) if edge in ("left", "right") else int(at + n * k), float(w)) for k, w in enumerate(row) if w]


def edge_row(patches: DataFrame, degree: int, edge: str, at: int, order: int, values: str = "coefficients", key: str = "leaf") -> DataFrame:
    """(key, value): the derivative of an order across an edge; 1 is what a slope condition sets, 2 what a curvature condition does."""
    size = F.col("xmax") - F.col("xmin") if edge in ("left", "right") else F.col("ymax") - F.col("ymin")
    terms = [w * F.element_at(values, k + 1) for k, w in edge_weights(degree, edge, at, order)]
    return patches.select(key, (sum(terms[1:], terms[0]) / F.pow(size, F.lit(float(order)))).alias("value"))


def penalty(patches: DataFrame, degree: int, strength: float, values: str = "coefficients", key: str = "leaf") -> DataFrame:
    """(key, penalty) of conforming vertical edges, named by the cell on the left: strength / size times the integral of the
    squared jump of slopes along the edge."""
    n = degree + 1
    slopes = lambda edge: F.array(*[sum(w * F.element_at(values, k + 1) for k, w in edge_weights(degree, edge, r, 1)) / (F.col("xmax") - F.col("xmin")) for r in range(n)])
    left = patches.select(key, F.col("xmax").alias("at"), F.col("ymin").alias("y0"), F.col("ymax").alias("y1"), (F.col("xmax") - F.col("xmin")).alias("dx"), slopes("right").alias("inner"))
    right = patches.select(F.col("xmin").alias("at"), F.col("ymin").alias("y0"), F.col("ymax").alias("y1"), slopes("left").alias("outer"))
    met = left.join(right, ["at", "y0", "y1"]).withColumn("jump", F.zip_with("inner", "outer", lambda a, b: b - a))
    return met.select(key, (strength / F.col("dx") * (F.col("y1") - F.col("y0")) * quadratic(mass(degree), "jump")).alias("penalty"))

