"""Derived wind variables and circular arithmetic, as Column expressions.

Missing values are null: NaN is made null where data come in, and divisions that have no value give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums over time, and directions.
CUMULATIVE = ("energy",)
CIRCULAR = ("Dir", "Dir_rep")


def zonal(speed: Column, direction: Column) -> Column:
    """Eastward component of a wind that blows from `direction` degrees."""
    return -speed * F.sin(F.radians(direction))


def meridional(speed: Column, direction: Column) -> Column:
    return -speed * F.cos(F.radians(direction))


def speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def direction(u: Column, v: Column) -> Column:
    """Degrees from which the wind blows, above 0 up to 360."""
    return F.degrees(F.atan2(u, v)) + 180.0


def wrap180(x: Column) -> Column:
    """A difference of directions in [-180, 180)."""
    up = F.when(x < -180, x + 360).otherwise(x)
    return F.when(up >= 180, up - 360).otherwise(up)


def wrap180_closed(x: Column) -> Column:
    """A difference of directions in [-180, 180]; both ends stay."""
    return F.when(x > 180, x - 360).when(x < -180, x + 360).otherwise(x)


def circular_mean(x: Column) -> Column:
    """Aggregate: mean direction in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(x))), F.avg(F.cos(F.radians(x))))), F.lit(360.0))


def circular_std(x: Column) -> Column:
    """Aggregate: circular standard deviation in degrees."""
    s, c = F.avg(F.sin(F.radians(x))), F.avg(F.cos(F.radians(x)))
    r = F.least(F.sqrt(s * s + c * c), F.lit(1.0))
    return F.degrees(F.sqrt(F.greatest(-2 * F.log(F.when(r > 0, r)), F.lit(0.0))))


def sector(direction_: Column, n: int = 16) -> Column:
    """Number of the sector, 0 centred on north, closed on the left. No direction counts as north (Q6 of the survey)."""
    w = 360.0 / n
    k = F.least(F.greatest(F.floor((direction_ + w / 2) / w), F.lit(0)), F.lit(n))
    return F.coalesce(F.pmod(k, F.lit(n)), F.lit(0)).cast("int")


def speed_bin(x: Column, slack: float = 0.0) -> Column:
    """Nearest whole speed, halves up; null without a value. What lies at most slack below a half counts as one: sums of doubles that should end there may fall short of it."""
    x = x + slack
    low = F.floor(x)
    return (low + F.when(x - low >= 0.5, 1).otherwise(0)).cast("double")


def bin_value(x: Column, width: float = 1.0, most: Column | float | None = None, *, centred: bool = False) -> Column:
    """Centre of the bin of x. Bins begin at 0, or half a bin before it if centred; values below the first bin are in it, and with `most`, the largest value, those beyond the last are in the last."""
    index = F.greatest(F.floor(x / width + (0.5 if centred else 0.0)), F.lit(0))
    if most is not None:
        most = F.lit(most) if not isinstance(most, Column) else most
        index = F.least(index, F.floor(most / width) + 1)
    return F.when(x.isNotNull(), index * width + (0.0 if centred else width / 2))


def bin_edges(most: Column | float, width: float = 1.0, *, centred: bool = False) -> Column:
    """Edges from 0 (half a bin before it if centred) up to past `most`."""
    most = F.lit(float(most)) if not isinstance(most, Column) else most
    last = F.floor(most / width + (0.5 if centred else 0.0)).cast("int") + 1
    return F.transform(F.sequence(F.lit(0), last), lambda j: j * F.lit(float(width)) - (width / 2 if centred else 0.0))


def truncated_speed(x: Column) -> Column:
    return x.cast("bigint")


_DERIVED = {
    "U": (("M", "Dir"), zonal),
    "V": (("M", "Dir"), meridional),
    "M": (("U", "V"), speed),
    "Dir": (("U", "V"), direction),
}


def derive(df: DataFrame, name: str, *, freq_min: float | None = None) -> Column:
    """The column `name`, or the expression that derives it. A stored column always comes first; ValueError where neither is possible."""
    from .power import power

    if name in df.columns:
        return F.col(name)
    if name in _DERIVED:
        needs, build = _DERIVED[name]
        if all(x in df.columns for x in needs):
            return build(*(F.col(x) for x in needs))
    elif name == "power":
        return power(derive(df, "M"))
    elif name == "energy":
        if freq_min is None:
            raise ValueError("energy needs the step in minutes")
        return derive(df, "power") * (freq_min / 60.0)
    elif name == "Mbin":
        return speed_bin(derive(df, "M"))
    elif name == "sector":
        return sector(derive(df, "Dir"))
    raise ValueError(f"{name} is not stored and cannot be derived from {', '.join(df.columns)}")


def no_nan(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def no_infinity(x: Column) -> Column:
    """Infinities as null."""
    return F.when(F.abs(x) != math.inf, x)
