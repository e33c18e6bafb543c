"""Weibull fits: by moments, by the likelihood of values, or by that of a histogram. The shape is the root of a rising function, found by bisection inside an expression where it is a histogram's, and by Newton steps that are aggregates each where it is that of values, however many."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrine.functions.wind import derive, sector
from zephyrine.session import cut

from .stats import as_pairs, as_rows, compare_stats, emd, pearson

#: The Lanczos approximation of the gamma function with g = 7 and nine terms.
_G = 7
_LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)
#: Halvings of the interval in which the shape lies.
STEPS, LOW, HIGH = 50, 0.02, 60.0
LEAST = 10


def gamma(x: Column) -> Column:
    """Gamma function of x >= 0.5."""
    y = x - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + i)
    t = y + (_G + 0.5)
    return math.sqrt(2 * math.pi) * F.pow(t, y + 0.5) * F.exp(-t) * total


def _bisect(data: Column, slope) -> Column:
    """Where slope(data, k), which rises with k, is zero."""
    zero = F.struct(F.lit(LOW).alias("a"), F.lit(HIGH).alias("b"))

    def half(acc: Column, _: Column) -> Column:
        k = (acc["a"] + acc["b"]) / 2
        up = slope(data, k) > 0
        return F.struct(F.when(up, acc["a"]).otherwise(k).alias("a"), F.when(up, k).otherwise(acc["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, half, lambda acc: (acc["a"] + acc["b"]) / 2)


def _likelihood_slope(bins: Column, k: Column) -> Column:
    """Zero at the likelihood's top: sum(n b^k ln b) / sum(n b^k) - 1 / k - sum(n ln b) / sum(n)."""
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"), F.lit(0.0).alias("r"), F.lit(0.0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        power = F.exp(k * (F.log(x["b"]) - x["top"])) * x["n"]  # against the largest bin, so that nothing overflows
        return F.struct((acc["p"] + power * F.log(x["b"])).alias("p"), (acc["q"] + power).alias("q"), (acc["r"] + x["n"] * F.log(x["b"])).alias("r"), (acc["n"] + x["n"]).alias("n"))

    return F.aggregate(bins, zero, add, lambda acc: acc["p"] / acc["q"] - 1 / k - acc["r"] / acc["n"])


def _scale(bins: Column, k: Column) -> Column:
    total = F.aggregate(bins, F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("n")), lambda acc, x: F.struct((acc["q"] + F.exp(k * (F.log(x["b"]) - x["top"])) * x["n"]).alias("q"), (acc["n"] + x["n"]).alias("n")), lambda acc: acc["q"] / acc["n"])
    return F.pow(total, 1 / k) * F.exp(bins[0]["top"])


def weibull_params(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, variance, k, A, count) from a histogram (keys, b, n): b is a bin's middle, above 0. The fit is at the top of the histogram's likelihood."""
    bins = hist.where("n > 0 and b > 0").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("b", F.col("n").cast("double").alias("n")))).alias("raw"))
    bins = bins.withColumn("top", F.log(F.element_at("raw", -1)["b"]))
    bins = bins.withColumn("bins", F.transform("raw", lambda x: F.struct(x["b"].alias("b"), x["n"].alias("n"), F.col("top").alias("top"))))
    count = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x["n"])
    mean = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x["n"] * x["b"]) / F.col("count")
    fits = bins.withColumn("count", count).withColumn("mean", mean)
    fits = fits.withColumn("variance", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x["n"] * (x["b"] - F.col("mean")) * (x["b"] - F.col("mean"))) / F.col("count"))
    # one bin alone has no shape
    fits = fits.withColumn("k", F.when(F.size("raw") > 1, _bisect(F.col("bins"), _likelihood_slope)))
    return fits.withColumn("A", _scale(F.col("bins"), F.col("k"))).select(*keys, "mean", "variance", "k", "A", F.col("count").cast("bigint").alias("count"))


def weibull_values(values: DataFrame, keys: list[str], steps: int = 10) -> DataFrame:
    """(keys, k, A) from counted values (keys, b, n), b above 0, at the top of their likelihood. Each step is one aggregate over the values, which are written once; no array holds them. One value alone has no shape."""
    values = cut(values, "values")
    ln, n = F.log("b"), F.col("n")
    state = values.groupBy(*keys).agg(F.sum("n").alias("all"), (F.sum(n * ln) / F.sum("n")).alias("r"), F.max(ln).alias("top"), (F.sum(n * F.col("b")) / F.sum("n")).alias("m"), (F.sum(n * F.col("b") * F.col("b")) / F.sum("n")).alias("q"), F.count(F.lit(1)).alias("different"))
    spread = F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(1e-12)))
    start = F.least(F.greatest(F.pow(spread / F.col("m"), -1.086), F.lit(LOW)), F.lit(HIGH))
    state = state.where("different > 1").select(*keys, "all", "r", "top", start.alias("k"))
    rest = [F.first(c).alias(c) for c in ("all", "r", "top", "k")]
    power = F.exp(F.col("k") * (ln - F.col("top"))) * n  # against the largest value, so that nothing overflows
    for _ in range(steps):
        sums = values.join(state, keys).groupBy(*keys).agg(F.sum(power).alias("s0"), F.sum(power * ln).alias("s1"), F.sum(power * ln * ln).alias("s2"), *rest)
        mean = F.col("s1") / F.col("s0")
        slope, bend = mean - 1 / F.col("k") - F.col("r"), F.col("s2") / F.col("s0") - mean * mean + 1 / (F.col("k") * F.col("k"))
        new = F.col("k") - slope / bend
        state = sums.select(*keys, "all", "r", "top", F.least(F.greatest(new, F.col("k") / 3, F.lit(LOW)), F.col("k") * 3, F.lit(HIGH)).alias("k"))
    last = values.join(state, keys).groupBy(*keys).agg(F.sum(power).alias("s0"), *rest)
    return last.select(*keys, "k", (F.pow(F.col("s0") / F.col("all"), 1 / F.col("k")) * F.exp("top")).alias("A"))


def weibull_fit(values: DataFrame, keys: list[str], *, method: str = "histogram", column: str = "M") -> DataFrame:
    """(keys, mean, variance, k, A, count) of a column. Fewer than 10 values give nulls but for the count.

    `params`: from mean and deviation. `values`: likelihood of the values as they are; equal values are counted first. `histogram`: likelihood of the histogram with bins of 1 m/s, whose mean and variance are returned too. Values of 0 or less have no likelihood and are left out of the fit.
    """
    some = values.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("x"))
    plain = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))
    enough = F.col("count") >= LEAST
    if method == "params":
        k = F.pow(F.try_divide(F.sqrt("variance"), F.col("mean")), -1.086)
        fits = plain.withColumn("k", F.when(F.col("variance") > 0, k)).withColumn("A", F.col("mean") / gamma(1 + 1 / F.col("k")))
    elif method in ("values", "histogram"):
        b = F.col("x") if method == "values" else F.floor("x") + 0.5
        counted = some.groupBy(*keys, b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
        own = weibull_values(counted.where("b > 0"), keys) if method == "values" else weibull_params(counted, keys).drop("count")
        fits = plain.drop("mean", "variance").join(own, keys, "left") if method == "histogram" else plain.join(own, keys, "left")
    else:
        raise ValueError(f"method {method}")
    return fits.select(*keys, *(F.when(enough, F.col(c)).alias(c) for c in ("mean", "variance", "k", "A")), "count")


def weibull_ds(series: DataFrame, *, sectors: int | None = None, method: str = "histogram") -> DataFrame:
    """(source, sector, mean, variance, k, A, count): the fit over all (sector null), and by sector (its middle in degrees)."""
    rows = series.select("source", derive(series, "M").alias("M"), *([] if sectors is None else [sector(derive(series, "Dir"), sectors).alias("s")]))
    out = weibull_fit(rows, ["source"], method=method).withColumn("sector", F.lit(None).cast("double"))
    if sectors:
        out = out.unionByName(weibull_fit(rows, ["source", "s"], method=method).withColumn("sector", F.col("s") * (360.0 / sectors)).drop("s"))
    return out.select("source", "sector", "mean", "variance", "k", "A", "count")


def density(x: Column, k: Column, a: Column) -> Column:
    r = x / a
    return k / a * F.pow(r, k - 1) * F.exp(-F.pow(r, k))


def weibull_quality(values: DataFrame, fits: DataFrame, keys: list[str], *, column: str = "M", width: float = 0.2) -> DataFrame:
    """(keys, fit_mbias, fit_rmse, fit_MAE, fit_emd, fit_r2): the fitted density against a histogram's. fit_MAE is the root of the mean error; fit_emd takes the densities of the bins as two samples."""
    some = values.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("x"))
    counts = some.groupBy(*keys, F.floor(F.col("x") / width).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    whole = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.avg("x").alias("xbar"), F.floor(F.max("x") / width).alias("last"))
    grid = whole.join(fits.select(*keys, "k", "A"), keys).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))))
    bins = grid.join(counts, [*keys, "j"], "left").withColumn("b", (F.col("j") + 0.5) * width)
    bins = bins.withColumns({"ref": F.coalesce("n", F.lit(0)) / (F.col("total") * width), "new": density(F.col("b"), F.col("k"), F.col("A"))})
    e = F.col("new") - F.col("ref")
    one = bins.groupBy(*keys).agg((F.sum(F.col("b") * F.col("new")) / F.sum("new") - F.first("xbar")).alias("fit_mbias"), F.sqrt(F.avg(e * e)).alias("fit_rmse"), F.sqrt(F.avg(F.abs(e))).alias("fit_MAE"), F.pow(pearson(F.col("ref"), F.col("new")), 2).alias("fit_r2"))
    return one.join(emd(bins.select(*keys, "ref", "new"), keys).withColumnRenamed("emd", "fit_emd"), keys).select(*keys, "fit_mbias", "fit_rmse", "fit_MAE", "fit_emd", "fit_r2")


def weibull_rows(series: DataFrame, ref: str, *, sectors: int | None = None, method: str = "histogram") -> tuple[DataFrame, DataFrame]:
    """(mean, bias and factor of A and k as metrics, pairs of A_sector and k_sector weighted by the new source's counts)."""
    fits = weibull_ds(series, sectors=sectors, method=method)
    left = fits.where(F.col("source") == ref).select("sector", F.col("A").alias("rA"), F.col("k").alias("rk"))
    right = fits.where(F.col("source") != ref)
    both = right.alias("n").join(left.alias("r"), F.col("n.sector").eqNullSafe(F.col("r.sector"))).select("source", F.col("n.sector").alias("sector"), "A", "k", "rA", "rk", "count")
    rows = both.select("source", "sector", "count", F.inline(F.array(*(F.struct(F.lit(v).alias("var"), F.col("r" + v).alias("ref"), F.col(v).alias("new")) for v in ("A", "k")))))
    whole = as_rows(rows.where("sector is null"), ("source", "var"), [("mean", F.col("new")), ("bias", F.col("new") - F.col("ref")), ("factor", F.try_divide(F.col("ref"), F.col("new")))])
    by = rows.where("sector is not null").select("source", F.concat("var", F.lit("_sector")).alias("var"), "ref", "new", F.col("count").cast("double").alias("weight"))
    return whole, as_pairs(by)


def compare_weibulls(series: DataFrame, ref: str, *, sectors: int | None = None, method: str = "histogram", **options) -> DataFrame:
    whole, by = weibull_rows(series, ref, sectors=sectors, method=method)
    return whole.unionByName(compare_stats(by, base=F.col("base"), **options)) if sectors else whole


def apply_by_sectors(df: DataFrame, aggs: dict[str, Column] | Callable, *, sectors: int = 16, keys: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """Aggregates by sector of Dir, with the sector's middle in degrees; or a function from a pandas frame (a sector's rows, with the middle as `sector`) to one of schema, for what no aggregate can do: it needs a sector's rows in one task."""
    keys = ["source"] if keys is None else keys
    with_sector = df.withColumn("sector", sector(derive(df, "Dir"), sectors) * (360.0 / sectors))
    if callable(aggs):
        return apply_groups(with_sector, aggs, schema, [*keys, "sector"])
    return with_sector.groupBy(*keys, "sector").agg(*(v.alias(k) for k, v in aggs.items()))


def apply_groups(df: DataFrame, function: Callable, schema: str, keys: list[str]) -> DataFrame:
    """A function from each group's pandas frame to one of schema, which should repeat the keys: a reducer of one's own. A group must fit into a task; whatever aggregates can say belongs into groupBy."""
    if not schema:
        raise ValueError("a function needs the schema of what it returns")
    return df.groupBy(*keys).applyInPandas(function, schema)
