"""Calendar parts and Fourier terms."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Part name to expression of a timestamp; Monday is weekday 0, weeks are ISO weeks.
PARTS = {
    "weekday": F.weekday,
    "week": F.weekofyear,
    "day": F.day,
    "hour": F.hour,
    "date": F.to_date,
    "month": F.month,
    "year": F.year,
    "dayofyear": F.dayofyear,
}


def date_parts(df: DataFrame, time: str = "time", parts: list[str] | None = None) -> DataFrame:
    unknown = set(parts or ()) - set(PARTS)
    if unknown:
        raise ValueError(f"no such parts: {', '.join(sorted(unknown))}")
    return df.withColumns({p: PARTS[p](time) for p in parts or PARTS})


def date_names(df: DataFrame, time: str = "time") -> DataFrame:
    """weekday_name and month_name; weekday (Monday 0) and month order them."""
    return df.withColumns({"weekday_name": F.date_format(time, "EEEE"), "month_name": F.date_format(time, "MMMM"), "weekday": F.weekday(time), "month": F.month(time)})


def fourier_columns(x: Column, name: str, most: float, terms: int = 1, *, single: bool = False) -> dict[str, Column]:
    out = {}
    for i in range(1, terms + 1):
        angle = 2 * math.pi * i * x / most
        for kind, f in (("sin", F.sin), ("cos", F.cos)):
            out[f"{name}_{kind}_{i}"] = f(angle).cast("float") if single else f(angle)
    return out


def fourier(df: DataFrame, name: str, most: float | None = None, terms: int = 1, *, single: bool = False) -> DataFrame:
    """Add name_sin_i and name_cos_i for i from 1 to terms. Without `most` the column's largest value is looked up, with a warning."""
    if most is None:
        most = df.agg(F.max(name)).first()[0]
        warnings.warn(f"the period of {name} is taken from the data: {most}", stacklevel=2)
    return df.withColumns(fourier_columns(F.col(name), name, float(most), terms, single=single))


def bulk_fourier(df: DataFrame, names: list[str], most: list[float], terms: int | list[int] = 1, *, single: bool = False) -> DataFrame:
    terms = [terms] * len(names) if isinstance(terms, int) else terms
    if not len(names) == len(most) == len(terms):
        raise ValueError("names, most and terms must have one length")
    columns: dict[str, Column] = {}
    for name, m, n in zip(names, most, terms, strict=True):
        columns |= fourier_columns(F.col(name), name, float(m), n, single=single)
    return df.withColumns(columns)


#: The periods of the calendar features.
PERIODS = {"month": 12, "hour": 24, "dayofyear": 365}


def date_vars(df: DataFrame, time: str = "time") -> DataFrame:
    """One sine and cosine each of month, hour and day of the year; the parts themselves are left out."""
    columns: dict[str, Column] = {}
    for part, most in PERIODS.items():
        columns |= fourier_columns(PARTS[part](time), part, float(most))
    return df.withColumns(columns)
