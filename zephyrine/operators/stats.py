"""Comparison of a new series with a reference: metrics as rows (source, var, metric, value).

Pairs are rows (source, var, key, ref, new[, weight]). Moments and errors are one aggregate over them; distribution distances and exact quantiles share a second way, over counted values by buckets, so that no task holds a group's distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrine.functions.wind import CIRCULAR, CUMULATIVE, circular_mean, circular_std, wrap180, wrap180_closed

#: Quantiles that are compared, and variables whose zero means nothing.
QUANTILES = (0.02, 0.25, 0.5, 0.75, 0.98)
NO_FACTOR = ("Dir", "Dir_rep", "U", "V")
GROUP = ("source", "var")


def _is(var: Column, names) -> Column:
    return var.isin(*names)


def error() -> Column:
    """new - ref, the short way round for directions."""
    e = F.col("new") - F.col("ref")
    return F.when(_is(F.col("base"), CIRCULAR), wrap180(e)).otherwise(e)


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: correlation of the rows that have both; null where either does not vary, which the built-in function takes for an error."""
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def slope(y: Column, x: Column) -> Column:
    """Aggregate: slope of y over x, null where x does not vary."""
    return F.try_divide(F.covar_pop(y, x), F.var_pop(F.when(y.isNotNull(), x)))


def compare_stats(pairs: DataFrame, *, group=GROUP, base: Column | None = None, quantiles: bool = True, quantile_errors: bool = True, linear_fit: bool = True, distance: bool = True, distribution_only: bool = False, accuracy: int | None = None, least: int | Column = 2) -> DataFrame:
    """Metrics of each group. base names the variable whose rules apply (var itself unless given). With fewer than `least` rows (a number, or a Column of var) a group has none.

    length counts rows with nulls; means and quantiles take each side by itself, errors take pairs. Quantities without a value are left out. accuracy: quantiles by percentile_approx in the one aggregate instead of exactly. weighted_MAE is the root of the weighted mean error.
    """
    rows = pairs.withColumn("base", F.col("var") if base is None else base)
    rows = rows.withColumn("e", error())
    ref, new, e = F.col("ref"), F.col("new"), F.col("e")
    turned = F.when(_is(F.col("base"), CIRCULAR), ref + e).otherwise(new)  # what correlates
    aggs: dict[str, Column] = {"n_rows": F.count(F.lit(1)), "n_ref": F.count("ref"), "n_new": F.count("new")}
    for side in ("ref", "new"):
        x = F.col(side)
        aggs |= {f"mean_{side}": F.avg(x), f"cmean_{side}": circular_mean(x), f"std_{side}": F.stddev_pop(x), f"cstd_{side}": circular_std(x), f"sum_{side}": F.sum(x), f"max_{side}": F.max(x)}
        if quantiles and accuracy:
            aggs[f"q_{side}"] = F.percentile_approx(x, list(QUANTILES), accuracy)
    if not distribution_only:
        aggs |= {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "sae": F.sum(F.abs(e)), "corr": pearson(turned, ref)}
        if linear_fit:
            aggs |= {"slope": slope(turned, ref), "intercept": F.avg(F.when(ref.isNotNull(), turned)) - slope(turned, ref) * F.avg(F.when(turned.isNotNull(), ref))}
        if quantile_errors and accuracy:
            aggs |= {"q_e": F.percentile_approx(e, list(QUANTILES), accuracy), "q_ae": F.percentile_approx(F.abs(e), list(QUANTILES), accuracy)}
        if "weight" in pairs.columns:
            w = F.when(e.isNotNull(), F.col("weight"))
            aggs |= {"wrmse": F.sqrt(F.try_divide(F.sum(w * e * e), F.sum(w))), "wmae": F.sqrt(F.try_divide(F.sum(w * F.abs(e)), F.sum(w)))}
    one = rows.groupBy(*group, "base").agg(*(v.alias(k) for k, v in aggs.items())).where(F.col("n_rows") >= least)
    circular, cumulative = _is(F.col("base"), CIRCULAR), _is(F.col("base"), CUMULATIVE)

    def turn(x: Column) -> Column:
        return F.when(circular, wrap180_closed(x)).otherwise(x)

    def by(side: str, kind: str) -> Column:
        return F.when(circular, F.col(f"c{kind}_{side}")).otherwise(F.col(f"{kind}_{side}"))

    out: list[tuple[str, Column]] = [
        ("length", F.col("n_rows").cast("double")),
        ("mean", by("new", "mean")),
        ("bias", turn(by("new", "mean") - by("ref", "mean"))),
        ("std", by("new", "std")),
        ("std_bias", turn(by("new", "std") - by("ref", "std"))),
        ("factor", F.when(~_is(F.col("base"), NO_FACTOR), F.try_divide(F.col("mean_ref"), F.col("mean_new")))),
        ("sum", F.when(cumulative, F.col("sum_new"))),
        ("bias_sum", F.when(cumulative, F.col("sum_new") - F.col("sum_ref"))),
        ("max", F.col("max_new")),
        ("bias_max", turn(F.col("max_new") - F.col("max_ref"))),
    ]
    if distribution_only:
        out.append(("bias_length", (F.col("n_new") - F.col("n_ref")).cast("double")))
    if not distribution_only:
        out += [("MAE", F.col("mae")), ("rmse", F.col("rmse")), ("r2", F.col("corr") * F.col("corr")), ("SAE", F.when(cumulative, F.col("sae")))]
        if linear_fit:
            out += [("lfit_slope", F.col("slope")), ("lfit_intercept", F.col("intercept"))]
        if "weight" in pairs.columns:
            out += [("weighted_rmse", F.col("wrmse")), ("weighted_MAE", F.col("wmae"))]
    sides = [("bias_q", lambda i: turn(F.col("q_new")[i] - F.col("q_ref")[i])), ("q", lambda i: F.col("q_new")[i])] if quantiles else []
    errors = [("td_bias_q", lambda i: F.col("q_e")[i]), ("td_error_q", lambda i: F.col("q_ae")[i])] if quantile_errors and not distribution_only else []

    def at(named: list) -> list[tuple[str, Column]]:
        return [(f"{name}{q}", value(i)) for i, q in enumerate(QUANTILES) for name, value in named]

    if accuracy:
        out += at(sides) + at(errors)
    stats = as_rows(one, group, out)
    if not distance and (accuracy or not (sides or errors)):
        return stats
    # two streams of values for each pair: its sides, and its error with and without sign
    kinds = [F.struct(F.lit(0).alias("kind"), ref.alias("ref"), new.alias("new"))]
    if errors and not accuracy:
        kinds.append(F.struct(F.lit(1).alias("kind"), e.alias("ref"), F.abs(e).alias("new")))
    streams = rows.select(*group, "base", F.inline(F.array(*kinds)))
    found = distributions(streams, [*group, "base", "kind"], () if accuracy else QUANTILES)
    found = found.join(one.select(*group, "base"), [*group, "base"], "left_semi")
    first = F.col("kind") == 0
    cells = [("EMD", F.when(first, F.col("emd")))] if distance else []
    if not accuracy:
        found = found.withColumns({"q_e": F.col("q_ref"), "q_ae": F.col("q_new")})
        cells += [(k, F.when(first, v)) for k, v in at(sides)] + [(k, F.when(~first, v)) for k, v in at(errors)]
    return stats.unionByName(as_rows(found, group, cells))


def as_rows(one: DataFrame, group, metrics: list[tuple[str, Column]]) -> DataFrame:
    """A row for each metric that has a value."""
    cells = F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics))
    return one.select(*group, F.inline(cells)).where("value is not null and not isnan(value)")


def emd(pairs: DataFrame, group=GROUP, buckets: int = 1024) -> DataFrame:
    """(group, emd): area between the two distribution functions, whose samples need not be equally many; groups that lack a side have none."""
    return distributions(pairs, list(group), (), buckets).where("emd is not null").select(*group, "emd")


def distributions(pairs: DataFrame, group: list[str], quantiles=QUANTILES, buckets: int = 1024) -> DataFrame:
    """(group, emd, q_ref, q_new): the area between the distribution functions of ref and new (null without either), and exact quantiles of both, between the two values next to a rank as a line.

    Values are counted first; running sums go by buckets of the value range and are joined by the buckets' own running sums, so no task holds more than a bucket of a group.
    """
    sides = F.array(F.struct(F.col("ref").alias("v"), F.lit(1).alias("r"), F.lit(0).alias("n")), F.struct(F.col("new").alias("v"), F.lit(0).alias("r"), F.lit(1).alias("n")))
    values = pairs.select(*group, F.inline(sides)).where("v is not null").groupBy(*group, "v").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
    bounds = values.groupBy(*group).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("r").alias("all_r"), F.sum("n").alias("all_n"))
    points = values.join(bounds, group)
    bucket = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")) * buckets), F.lit(buckets - 1)), F.lit(0))
    points = points.select(*group, "v", "r", "n", "all_r", "all_n", bucket.alias("bucket"))
    own = Window.partitionBy(*group, "bucket").orderBy("v")
    up_to = own.rowsBetween(Window.unboundedPreceding, 0)
    inside = points.withColumns({"run_r": F.sum("r").over(up_to), "run_n": F.sum("n").over(up_to), "after": F.lead("v").over(own)})
    across = Window.partitionBy(*group).orderBy("bucket")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    ends = points.groupBy(*group, "bucket").agg(F.sum("r").alias("r"), F.sum("n").alias("n"), F.min("v").alias("first"))
    ends = ends.select(*group, "bucket", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"before_{x}") for x in "rn"), F.lead("first").over(across).alias("next"))
    whole = inside.join(ends, [*group, "bucket"]).withColumns({f"upto_{x}": F.col(f"before_{x}") + F.col(f"run_{x}") for x in "rn"})
    area = F.abs(F.try_divide("upto_r", "all_r") - F.try_divide("upto_n", "all_n")) * (F.coalesce("after", "next") - F.col("v"))
    both = (F.max("all_r") > 0) & (F.max("all_n") > 0)
    aggs = {"emd": F.when(both, F.coalesce(F.sum(area), F.lit(0.0)))}
    for side, x in (("ref", "r"), ("new", "n")):
        for i, q in enumerate(quantiles):
            rank = F.lit(float(q)) * (F.col(f"all_{x}") - 1)
            aggs |= {f"{side}_{i}_{end}": F.min(F.when(F.col(f"upto_{x}") > whole_rank, F.col("v"))) for end, whole_rank in (("low", F.floor(rank)), ("high", F.ceil(rank)))}
            aggs[f"{side}_{i}_part"] = F.max(rank - F.floor(rank))
    one = whole.groupBy(*group).agg(*(v.alias(k) for k, v in aggs.items()))

    def line(side: str, i: int) -> Column:
        low, high, part = (F.col(f"{side}_{i}_{x}") for x in ("low", "high", "part"))
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    return one.select(*group, "emd", *(F.array(*(line(s, i) for i in range(len(quantiles)))).alias(f"q_{s}") for s in (("ref", "new") if quantiles else ())))


#: Columns of pairs that go through one comparison together.
PAIRS = ("source", "var", "base", "ref", "new", "weight")


def as_pairs(rows: DataFrame) -> DataFrame:
    """rows with all of PAIRS: var is its own base, and there are no weights, unless rows say so."""
    extra = {"base": F.col("var"), "weight": F.lit(None).cast("double")}
    return rows.withColumns({k: v for k, v in extra.items() if k not in rows.columns}).select(*PAIRS)
