"""Vectors and angles as column expressions over arrays of doubles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def translate(a, origin) -> Column:
    return F.zip_with(_c(a), _c(origin) if not isinstance(origin, (list, tuple)) else vector(origin), lambda x, o: x - o)


def unit_vector(a) -> Column:
    n = norm(a)
    return F.transform(_c(a), lambda x: x / n)


def angle_between(a, b, degrees: bool = False) -> Column:
    cos = dot(a, b) / (norm(a) * norm(b))
    out = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    return F.degrees(out) if degrees else out


def vector_angle(a, degrees: bool = False) -> Column:
    """Angle of the first two components in [0, 2 pi)."""
    out = F.pmod(F.atan2(_c(a)[1], _c(a)[0]), F.lit(TAU))
    return F.degrees(out) if degrees else out


def radial_distance(a, origin=None) -> Column:
    return norm(translate(a, origin)) if origin is not None else norm(a)


def distance(a, b) -> Column:
    return norm(F.zip_with(_c(a), _c(b), lambda x, y: x - y))


def matrix_apply(matrix, a) -> Column:
    """matrix @ a for a fixed matrix."""
    return F.array(*[sum((F.lit(float(m)) * _c(a)[k] for k, m in enumerate(row) if k), F.lit(float(row[0])) * _c(a)[0]) for row in np.asarray(matrix)])


def rotation_between(current, new) -> np.ndarray:
    """The rotation that takes one axis to another by the shortest way, of 2 or 3 dimensions."""
    a, b = np.asarray(current, float), np.asarray(new, float)
    n = len(a)
    a, b = np.pad(a, (0, 3 - n)), np.pad(b, (0, 3 - n))
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    v, c = np.cross(a, b), float(a @ b)
    if np.isclose(c, -1):
        if n == 2:
            return -np.eye(2)
        axis = np.cross(a, np.eye(3)[np.argmin(np.abs(a))])
        axis /= np.linalg.norm(axis)
        return 2 * np.outer(axis, axis) - np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return (np.eye(3) + k + k @ k / (1 + c))[:n, :n]


def rotate(a, new_axis, current_axis) -> Column:
    return matrix_apply(rotation_between(current_axis, new_axis), a)


def euler_xyz(x_deg: float, y_deg: float, z_deg: float) -> np.ndarray:
    """Rotation about the fixed axes x, then y, then z."""
    x, y, z = np.radians([x_deg, y_deg, z_deg])
    rx = np.array([[1, 0, 0], [0, np.cos(x), -np.sin(x)], [0, np.sin(x), np.cos(x)]])
    ry = np.array([[np.cos(y), 0, np.sin(y)], [0, 1, 0], [-np.sin(y), 0, np.cos(y)]])
    rz = np.array([[np.cos(z), -np.sin(z), 0], [np.sin(z), np.cos(z), 0], [0, 0, 1]])
    return rz @ ry @ rx


def world_to_screen(x_deg=0.0, y_deg=0.0, z_deg=0.0, gain=1.0, mapping=None, baseline=None) -> np.ndarray:
    """Screen mapping: gain x baseline x mapping x Euler rotation, then (x, z, y) to (x, y, z)."""
    eye = np.eye(3)
    m = gain * (eye if baseline is None else np.asarray(baseline)) @ (eye if mapping is None else np.asarray(mapping)) @ euler_xyz(x_deg, y_deg, z_deg)
    swap = np.array([[1, 0, 0], [0, 0, 1], [0, 1, 0]])
    return swap @ m @ swap


def direction(target, origin=(0.0, 0.0), zero_axis=(0.0, 1.0), clockwise: bool = True) -> Column:
    """Angle from the zero axis in [0, 2 pi), null at the origin."""
    x, y = _c(target)[0] - float(origin[0]), _c(target)[1] - float(origin[1])
    zero = math.atan2(zero_axis[0], zero_axis[1])
    turn = F.atan2(x, y) - F.lit(zero)
    return F.when((x == 0) & (y == 0), F.lit(None)).otherwise(F.pmod(turn if clockwise else -turn, F.lit(TAU)))


def digitize_by_angle(a, start: float = math.pi / 4, clockwise: bool = True, bins: int = 4) -> Column:
    """Angle bin 1..bins of the first two components, counted from ``start``."""
    turn = F.lit(start) - F.atan2(_c(a)[1], _c(a)[0]) if clockwise else F.atan2(_c(a)[1], _c(a)[0]) - F.lit(start)
    return F.least(F.floor(F.pmod(turn, F.lit(TAU)) / F.lit(TAU / bins)) + 1, F.lit(bins)).cast("int")


def calibrate(a, coefficients) -> Column:
    """slope x + intercept for each component; ``coefficients`` are (slope, intercept) pairs."""
    return F.array(*[F.lit(float(s)) * _c(a)[k] + F.lit(float(o)) for k, (s, o) in enumerate(coefficients)])


def lerp(origin, target: str, n: int) -> Column:
    """``n`` points on the line from a fixed origin to a target array, both included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.zip_with(vector(origin), F.col(target), lambda o, t: o + (t - o) * k / F.lit(max(1, n - 1))))


def nextpow2(x) -> Column:
    return F.when(_c(x) == 0, F.lit(1)).otherwise(F.ceil(F.log2(_c(x))).cast("int"))


def parabola_vertex(before, peak, after, at) -> Column:
    """Place of the vertex of the parabola through three neighbours around ``at``."""
    b, p, a = _c(before), _c(peak), _c(after)
    bend = b - 2 * p + a
    return _c(at) + F.when(bend == 0, F.lit(0.0)).otherwise((b - a) / (2 * bend))


def logistic_scale(value, p, k: float = 100, p0: float = 0.08) -> Column:
    return _c(value) / (1 + F.exp(-F.lit(float(k)) * (F.lit(float(p0)) - _c(p))))


def port_name(port, kind: str = "ap") -> Column:
    return F.concat(F.lit("Probe"), F.char(F.lit(64) + _c(port)), F.lit(f"-{kind.upper()}"))
