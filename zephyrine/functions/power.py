"""Turbine power: a cubic spline through a power curve, solved once on the driver; a row looks its segment's polynomial up by a closed-form index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wind speeds (m/s) and power (kW) of the standard curve.
SPEEDS = (3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 7.5, 8, 8.5, 9, 9.5, 10, 10.5, 11, 11.5, 12, 12.5, 13, 13.5, 14, 14.5, 15, 15.5, 16, 16.5, 17, 17.5, 18, 18.5, 19, 19.5, 20, 20.5, 21, 21.5, 22, 22.5, 50)
POWERS = (78, 172, 287, 426, 601, 814, 1068, 1367, 1717, 2110, 2546, 3002, 3428, 3773, 4012, 4131, 4186, 4198, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200, 4200)


def spline(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (highest first, in the distance from a segment's left knot) of the cubic spline whose third derivative goes on through the second and the last but one knot."""
    n = len(x)
    if n < 4:
        return np.stack([_shifted(np.polyfit(x, y, n - 1), a) for a in x[:-1]])
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    return np.stack([(m[1:] - m[:-1]) / (6 * h), m[:-1] / 2, slope - h * (2 * m[:-1] + m[1:]) / 6, y[:-1]], 1)


def _shifted(c: np.ndarray, at: float) -> np.ndarray:
    moved = np.atleast_1d(np.poly1d(c)(np.poly1d([1, at])).coeffs)
    return np.concatenate((np.zeros(4 - len(moved)), moved))


def pieces(x: np.ndarray, y: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """(left ends of the polynomials' ranges, their coefficients, whether a range holds its left end and not its right one, but for the last)."""
    z = np.zeros(len(x) - 1)
    middle = (x[1:] + x[:-1]) / 2
    if kind == "cubic":
        return x[:-1], spline(x, y), True
    if kind in ("linear", "slinear"):
        return x[:-1], np.stack([z, z, np.diff(y) / np.diff(x), y[:-1]], 1), True
    if kind in ("previous", "zero"):
        # the last knot has its own value
        return x, np.stack([*[np.append(z, 0)] * 3, y], 1), True
    if kind == "next":
        return np.append(x[0] - 1, x[:-1]), np.stack([*[np.append(z, 0)] * 3, y], 1), False
    if kind in ("nearest", "nearest-up"):
        return np.append(x[0] - 1, middle), np.stack([*[np.append(z, 0)] * 3, y], 1), kind == "nearest-up"
    if kind == "quadratic":
        if len(x) < 3:
            raise ValueError("a quadratic curve needs three speeds")
        # once differentiable, with joints halfway between speeds, but for the first and the last
        joints, scale = middle[1:-1], x[-1] - x[0]
        u = (x - x[0]) / scale
        basis = np.stack([u**0, u, u**2, *(np.maximum(u - (j - x[0]) / scale, 0) ** 2 for j in joints)], 1)
        c = np.linalg.solve(basis, y)
        left = np.append(x[0], joints)
        at = (left - x[0]) / scale
        second = np.cumsum(np.append(c[2], c[3:]))
        value, slope = [], []
        for i, t in enumerate(at):
            own = c[3 : 3 + i]
            gone = t - at[1 : 1 + i]
            value.append(c[0] + c[1] * t + c[2] * t * t + float((own * gone**2).sum()))
            slope.append(c[1] + 2 * c[2] * t + 2 * float((own * gone).sum()))
        return left, np.stack([np.zeros(len(left)), second / scale**2, np.array(slope) / scale, np.array(value)], 1), True
    raise ValueError(f"kind {kind}")


def power(wind: Column, speeds=None, powers=None, *, kind: str = "cubic", fill: float | None = 0.0, bounds_error: bool = False) -> Column:
    """Power of a wind speed by the standard curve or one of your own. kind: cubic, quadratic, linear (slinear), previous (zero), next, nearest (halfway goes down) or nearest-up. Outside the curve `fill`, or an error when a row gets there; null without wind. speeds must rise."""
    if (speeds is None) != (powers is None):
        raise ValueError("give both speeds and powers, or neither")
    x = np.asarray(SPEEDS if speeds is None else speeds, float)
    y = np.asarray(POWERS if powers is None else powers, float)
    if len(x) != len(y):
        raise ValueError(f"{len(x)} speeds and {len(y)} powers")
    if len(x) < 2 or (np.diff(x) <= 0).any():
        raise ValueError("speeds must rise")
    lefts, rows, closed = pieces(x, y, kind)
    table = F.array(*(F.struct(*(F.lit(float(v)).alias(k) for k, v in zip("xabcd", (left, *row), strict=True))) for left, row in zip(lefts, rows, strict=True)))
    index, regular = F.lit(0), 0
    if closed and len(lefts) > 2:
        # ranges of one width come first: the index is arithmetic; the rest are compared one by one
        steps = np.diff(lefts)
        odd = np.flatnonzero(~np.isclose(steps, steps[0], rtol=1e-12))
        regular = int(odd[0]) if len(odd) else len(steps)
        index = F.least(F.greatest(F.floor((wind - float(lefts[0])) / float(steps[0])).cast("int"), F.lit(0)), F.lit(regular))
    for i in range(regular + 1, len(lefts)):
        index = F.when(wind >= float(lefts[i]) if closed else wind > float(lefts[i]), F.lit(i)).otherwise(index)
    s = F.get(table, index)
    t = wind - s["x"]
    value = ((s["a"] * t + s["b"]) * t + s["c"]) * t + s["d"]
    outside = (wind < float(x[0])) | (wind > float(x[-1]))
    if bounds_error:
        return F.when(outside, F.raise_error(F.lit("a wind speed outside the curve")).cast("double")).otherwise(value)
    return F.when(outside, F.lit(fill).cast("double")).otherwise(value)
