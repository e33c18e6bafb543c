"""Wide and long forms of variables at heights, and column-wise helpers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NAME = re.compile(r"^([A-Za-z]+)_(\d+(?:\.\d+)?)$")


def _column(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col(f"`{name}`")


def levels(df: DataFrame, names: list[str] | None = None) -> dict[str, dict[float, str]]:
    """Variable to height to column, from columns named VAR_height, by rising height."""
    found: dict[str, dict[float, str]] = {}
    for c in df.columns:
        m = _NAME.match(c)
        if m and (names is None or m[1] in names):
            found.setdefault(m[1], {})[float(m[2])] = c
    return {v: dict(sorted(x.items())) for v, x in found.items()}


def select_uv(df: DataFrame, keys: tuple[str, ...] = ("time",)) -> DataFrame:
    return df.select([f"`{c}`" for c in df.columns if c in keys or c.startswith(("U_", "V_"))])


def drop_targets(df: DataFrame) -> DataFrame:
    return df.drop("M", "Dir")


def wide_to_long(df: DataFrame, keys: tuple[str, ...] = ("time",), names: list[str] | None = None) -> DataFrame:
    """(keys, other columns, lev, a column for each variable): one row for each height of any variable; a variable that lacks a height is null there."""
    found = levels(df, names)
    if not found:
        raise ValueError("no columns named VAR_height")
    every = sorted({h for x in found.values() for h in x})
    taken = {c for x in found.values() for c in x.values()}
    rest = [c for c in df.columns if c not in taken]
    rows = F.array(*(F.struct(F.lit(h).alias("lev"), *((F.col(f"`{x[h]}`").cast("double") if h in x else F.lit(None).cast("double")).alias(v) for v, x in found.items())) for h in every))
    return df.select(*(f"`{c}`" for c in rest), F.inline(rows))


def long_to_wide(df: DataFrame, heights: list[float], names: list[str], keys: tuple[str, ...] = ("time",)) -> DataFrame:
    """Columns VAR_height, heights written as Python writes floats. One aggregate; heights are given, not looked up."""
    cells = [F.max(F.when(F.col("lev") == h, F.col(v))).alias(f"{v}_{float(h)}") for v in names for h in heights]
    return df.groupBy(*keys).agg(*cells)


def add_level(df: DataFrame, height: float = 70.0) -> DataFrame:
    return df.withColumn("lev", F.lit(float(height)))


def rename_vars(df: DataFrame, keys: tuple[str, ...] = ("source", "time"), prefix: str = "", suffix: str = "") -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}{suffix}" for c in df.columns if c not in keys})


def level_column(found: dict[float, str], height: float) -> Column:
    """A variable at a height: its own column, else, where that is missing, between the heights around it; null beyond them. The neighbours are those with a value, so the expression looks from height to height."""
    value: Column | None = F.col(f"`{found[height]}`") if height in found else None
    below = [h for h in found if h < height][::-1]
    above = [h for h in found if h > height]

    def first(heights: list[float]) -> Column:
        parts = [F.when(F.col(f"`{found[h]}`").isNotNull(), F.struct(F.lit(h).alias("h"), F.col(f"`{found[h]}`").cast("double").alias("x"))) for h in heights]
        return F.coalesce(*parts)

    if below and above:
        lo, hi = first(below), first(above)
        between = lo["x"] + (hi["x"] - lo["x"]) * (F.lit(height) - lo["h"]) / (hi["h"] - lo["h"])
        value = between if value is None else F.coalesce(value, between)
    return F.lit(None).cast("double") if value is None else value


def level_interp(df: DataFrame, height: float = 70.0, names: list[str] | None = None) -> DataFrame:
    """df with VAR_height for every variable with heights. Only plain expressions: the heights are known from the names."""
    found = levels(df, names)
    return df.withColumns({f"{v}_{float(height)}": level_column(x, float(height)) for v, x in found.items()})


def mask_where(df: DataFrame, column: str, condition: Column, other=None) -> DataFrame:
    """Values of column where the condition holds, `other` elsewhere."""
    return df.withColumn(column, F.when(condition, F.col(column)).otherwise(F.lit(other) if not isinstance(other, Column) else other))


def replace_inf(df: DataFrame) -> DataFrame:
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.when(F.abs(_column(n)) != float("inf"), _column(n)) for n in floats})


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.when(~F.isnan(_column(n)), _column(n)) for n in floats})


def downcast32(df: DataFrame) -> DataFrame:
    """Doubles to floats, longs to ints."""
    return df.withColumns({n: _column(n).cast("float" if t == "double" else "int") for n, t in df.dtypes if t in ("double", "bigint")})


def low_std_columns(df: DataFrame, most: float = 1.0) -> DataFrame:
    """(column, std) of numeric columns whose sample deviation is at most `most`; columns without one are not listed. One pass."""
    numeric = [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    one = df.agg(*(F.stddev_samp(_column(n)).alias(n) for n in numeric))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("column"), _column(n).alias("std")) for n in numeric)))).where(F.col("std") <= most)


def fillna_scalar_or_mean(df: DataFrame, column: str, fill: float | str, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    if fill != "mean":
        return df.withColumn(column, F.coalesce(column, F.lit(float(fill))))
    means = df.groupBy(*keys).agg(F.avg(column).alias("__mean"))
    return df.join(means, list(keys)).withColumn(column, F.coalesce(column, "__mean")).drop("__mean")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def lag_and_lead(df: DataFrame, names: list[str], keys: tuple[str, ...] = ("source",), time: str = "time") -> DataFrame:
    """{var}_lag1 is the value of the next row, {var}_lead1 that of the row before: the names are the wrong way round, as users of them expect (Q15). Rows are ordered within days, and days by their ends, so no task holds a series; rows without a time come first."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    day, row = F.to_date(time), F.struct(*(_column(n) for n in names))
    marked = df.withColumn("__day", day)
    own = Window.partitionBy(*keys, "__day").orderBy(time)
    inside = marked.withColumns({"__next": F.lead(row).over(own), "__last": F.lag(row).over(own), "__at": F.row_number().over(own), "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys, "__day"))})
    # the first and last rows of a day take from the days beside it
    ends = inside.where("__at = 1 or __at = __n").groupBy(*keys, "__day").agg(F.min_by(row, "__at").alias("__first"), F.max_by(row, "__at").alias("__end"))
    across = Window.partitionBy(*keys).orderBy("__day")
    ends = ends.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__day").alias("__of"), F.lead("__first").over(across).alias("__after"), F.lag("__end").over(across).alias("__before"))
    on = reduce(lambda x, y: x & y, (inside[k].eqNullSafe(ends[f"__{k}"]) for k in keys), inside["__day"].eqNullSafe(ends["__of"]))
    joined = inside.join(ends, on)
    after, before = F.when(F.col("__at") == F.col("__n"), F.col("__after")).otherwise(F.col("__next")), F.when(F.col("__at") == 1, F.col("__before")).otherwise(F.col("__last"))
    return joined.select(*(_column(c) for c in df.columns), *(x for n in names for x in (after.getField(n).alias(f"{n}_lag1"), before.getField(n).alias(f"{n}_lead1"))))


def join_features(features: DataFrame, targets: DataFrame, how: str = "left", on: str = "time") -> DataFrame:
    return features.join(targets, on, how)


def apply_general(df: DataFrame, function, names: list[str], *, pandas: bool = False) -> DataFrame:
    """A function of a Column over columns. With pandas=True the function takes and gives a pandas Series and runs in Arrow batches: only for what no Column function can do."""
    if not pandas:
        return df.withColumns({n: function(F.col(n)) for n in names})
    udf = F.pandas_udf(function, "double")
    return df.withColumns({n: udf(F.col(n).cast("double")) for n in names})


def with_metadata(df: DataFrame, described: dict[str, dict[str, str]]) -> DataFrame:
    """Long names, units and descriptions as column metadata."""
    return df.select(*(F.col(f"`{c}`").alias(c, metadata=described[c]) if c in described else F.col(f"`{c}`") for c in df.columns))
