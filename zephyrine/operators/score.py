"""The validation as a whole: statistics of every variable and extra comparison, quantities derived from them, and one weighted quality index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrine.functions.wind import derive
from zephyrine.session import cut

from .align import KEYS, pairs, time_match_sources, variables
from .cycles import cycle_pairs
from .histogram import least_cells, tabfile_pairs
from .ramps import change_pairs, least_steps, noise, ramps
from .resample import UNITS, per_hour, resampled_rows, stats_of_resampled
from .stats import as_pairs, compare_stats
from .weibull import weibull_rows

#: Variable, metric, the value that scores 10, the value that scores 0, weight.
RULES = (
    ("M", "absolute bias (%)", 0, 2, 3),
    ("M", "EMD", 0, 0.3, 3),
    ("M", "absolute bias_q0.25 (%)", 0, 2, 1),
    ("M", "absolute bias_q0.5 (%)", 0, 2, 1),
    ("M", "absolute bias_q0.75 (%)", 0, 3, 1),
    ("M", "absolute bias_q0.98 (%)", 0, 5, 1),
    ("M", "rmse", 0, 1.5, 1),
    ("M", "rmse_hourly", 0, 1.3, 1),
    ("M", "rmse_daily", 0, 1, 1),
    ("M", "rmse_monthly", 0, 0.2, 1),
    ("M", "rmse (%)", 0, 25, 1),
    ("M", "rmse_hourly (%)", 0, 20, 1),
    ("M", "rmse_daily (%)", 0, 12, 1),
    ("M", "rmse_monthly (%)", 0, 3, 1),
    ("M", "r2", 1, 0.75, 2),
    ("M", "r2_hourly", 1, 0.8, 2),
    ("M", "r2_daily", 1, 0.9, 1),
    ("M", "r2_monthly", 1, 0.95, 5),
    ("power", "r2", 1, 0.7, 1),
    ("power", "r2_hourly", 1, 0.75, 1),
    ("power", "r2_daily", 1, 0.8, 1),
    ("power", "r2_monthly", 1, 0.9, 1),
    ("power", "rmse", 0, 1000, 1),
    ("power", "rmse_hourly", 0, 800, 1),
    ("power", "rmse_daily", 0, 200, 1),
    ("power", "rmse_monthly", 0, 100, 1),
    ("power", "rmse_daily (%)", 0, 20, 1),
    ("power", "rmse_monthly (%)", 0, 5, 1),
    ("U", "EMD", 0, 0.3, 1),
    ("U", "absolute bias_q0.25", 0, 0.2, 1),
    ("U", "absolute bias_q0.5", 0, 0.2, 1),
    ("U", "absolute bias_q0.75", 0, 0.2, 1),
    ("U", "r2", 1, 0.75, 1),
    ("U", "r2_hourly", 1, 0.8, 1),
    ("U", "r2_daily", 1, 0.9, 1),
    ("U", "r2_monthly", 1, 0.95, 1),
    ("V", "EMD", 0, 0.3, 1),
    ("V", "absolute bias_q0.25", 0, 0.2, 1),
    ("V", "absolute bias_q0.5", 0, 0.2, 1),
    ("V", "absolute bias_q0.75", 0, 0.2, 1),
    ("V", "r2", 1, 0.75, 1),
    ("V", "r2_hourly", 1, 0.8, 1),
    ("V", "r2_daily", 1, 0.9, 1),
    ("V", "r2_monthly", 1, 0.95, 1),
    ("Dir", "absolute bias", 0, 3, 5),
    ("Dir", "rmse", 0, 25, 5),
    ("Dir", "r2", 1, 0.9, 1),
    ("Dir", "r2_hourly", 1, 0.92, 1),
    ("Dir", "r2_daily", 1, 0.96, 1),
    ("Dir", "r2_monthly", 1, 0.98, 1),
    ("TAB_pop", "rmse", 0, 0.1, 3),
    ("A_sector", "r2", 1, 0.9, 3),
    ("A_sector", "rmse", 0, 0.4, 1),
    ("A_sector", "weighted_rmse", 0, 0.3, 3),
    ("A_sector", "weighted_MAE", 0, 0.4, 1),
    ("k", "absolute bias", 0, 0.05, 1),
    ("k", "absolute bias (%)", 0, 2, 1),
    ("k_sector", "r2", 1, 0.7, 1),
    ("k_sector", "rmse", 0, 0.2, 1),
    ("k_sector", "weighted_rmse", 0, 0.2, 1),
    ("k_sector", "weighted_MAE", 0, 0.3, 1),
    ("M_mth", "r2", 1, 0.95, 2),
    ("M_mth", "rmse", 0, 0.1, 2),
    ("M_hr", "r2", 1, 0.95, 2),
    ("M_hr", "rmse", 0, 0.1, 2),
    ("M_mthhr", "r2", 1, 0.9, 2),
    ("M_mthhr", "rmse", 0, 0.15, 2),
    ("M_norm_mth", "rmse", 0, 1, 1),
    ("M_norm_hr", "rmse", 0, 1, 1),
    ("M_norm_mthhr", "rmse", 0, 2, 1),
    ("M-noise", "absolute bias", 0, 0.1, 3),
    ("M-noise", "rmse", 0, 0.2, 1),
    ("M-noise", "EMD", 0, 0.1, 1),
    ("M-ramp", "EMD", 0, 0.25, 1),
)
#: Metrics that are also given in percent of the reference's mean, of the sum, and without their sign.
OF_MEAN = ("bias", "rmse", "rmse_hourly", "rmse_daily", "rmse_monthly", "weighted_rmse", "weighted_MAE", "MAE", "MAE_hourly", "MAE_daily", "MAE_monthly", "bias_at_15", "bias_q0.02", "bias_q0.25", "bias_q0.5", "bias_q0.75", "bias_q0.98")
OF_SUM = ("bias_sum", "SAE", "SAE_hourly", "SAE_daily", "SAE_monthly")
UNSIGNED = ("bias", "bias (%)", "bias_max", "bias_at_15 (%)", "std_bias", "cv_bias", "bias_sum", "bias_sum (%)", "bias_iqr", "bias_range", "bias_q0.02", "bias_q0.25", "bias_q0.5", "bias_q0.75", "bias_q0.98", "bias_q0.02 (%)", "bias_q0.25 (%)", "bias_q0.5 (%)", "bias_q0.75 (%)", "bias_q0.98 (%)")
VARIABLES = ("M", "Dir", "power", "U", "V")


def rules(spark: SparkSession, given=RULES) -> DataFrame:
    return spark.createDataFrame([(v, m, float(p), float(g), float(w)) for v, m, p, g, w in given], "var string, metric string, perfect double, good double, weight double")


def quality_index(x: Column, perfect: Column, good: Column) -> Column:
    """10 at perfect, 0 at good, on the line through both."""
    return F.try_divide(F.lit(10.0), perfect - good) * (x - good)


def deduced_stats(stats: DataFrame, group=("source", "var")) -> DataFrame:
    """stats and what follows from them: percentages, cv, iqr, range, rmse over mean, range and iqr, and values without sign. A quantity whose parts are missing is missing. One group is a map of a few dozen metrics."""
    group = list(group)
    maps = stats.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))

    def get(name: str) -> Column:
        return F.col("m")[name]

    mean = get("mean") - get("bias")
    new: dict[str, Column] = {f"{v} (%)": 100 * F.try_divide(get(v), mean) for v in OF_MEAN}
    new |= {f"{v} (%)": 100 * F.try_divide(get(v), get("sum")) for v in OF_SUM}
    cv, cv_ref = F.try_divide(get("std"), mean), F.try_divide(get("std") - get("std_bias"), mean)
    iqr, range_ = get("q0.75") - get("q0.25"), get("q0.98") - get("q0.02")
    new |= {
        "cv": cv,
        "cv_bias": cv - cv_ref,
        "iqr": iqr,
        "bias_iqr": get("bias_q0.75") - get("bias_q0.25"),
        "range": range_,
        "bias_range": get("bias_q0.98") - get("bias_q0.02"),
        "rmse_norm_mean": F.try_divide(get("rmse"), mean),
        "rmse_norm_range": F.try_divide(get("rmse"), range_),
        "rmse_norm_iqr": F.try_divide(get("rmse"), iqr),
    }
    new |= {f"absolute {v}": F.abs(new[v] if v in new else get(v)) for v in UNSIGNED}
    cells = F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in new.items()))
    every = maps.select(*group, F.explode(F.concat(F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].alias("metric"), e["value"].alias("value"))), cells)).alias("x"))
    return every.select(*group, "x.*").where("value is not null and abs(value) < double('infinity')")


def compute_quality(stats: DataFrame, rule_table: DataFrame | None = None) -> DataFrame:
    """(source, var, metric, perfect, good, weight, value, quality_index, quality_weighted) for every rule and source; value is null where the metric is missing."""
    rule_table = rules(stats.sparkSession) if rule_table is None else rule_table
    wanted = stats.select("source").distinct().crossJoin(rule_table)
    out = wanted.join(stats, ["source", "var", "metric"], "left").withColumn("quality_index", quality_index(F.col("value"), F.col("perfect"), F.col("good")))
    return out.select("source", "var", "metric", "perfect", "good", "weight", "value", "quality_index", (F.col("quality_index") * F.col("weight")).alias("quality_weighted"))


def total_quality(quality: DataFrame) -> DataFrame:
    """(source, quality, rules_used, rules_missing): the weighted mean of the indices that could be computed."""
    used = F.col("quality_index").isNotNull()
    return quality.groupBy("source").agg(F.try_divide(F.sum("quality_weighted"), F.sum(F.when(used, F.col("weight")))).alias("quality"), F.count_if(used).alias("rules_used"), F.count_if(~used).alias("rules_missing"))


def with_variables(series: DataFrame, names=VARIABLES, *, strict: bool = False) -> DataFrame:
    """source, time and the named variables, derived where they are not stored. What cannot be had raises ValueError if strict, else is left out."""
    columns = []
    for name in names:
        try:
            columns.append(derive(series, name).alias(name))
        except ValueError:
            if strict:
                raise
    return series.select(*KEYS, *columns)


#: Extra validations by name: (metrics or None, pairs) of each. windprofile needs several heights and is passed over, unknown names too.
EXTRAS = {
    "tabfile": lambda series, ref, **k: (None, tabfile_pairs(series, ref, **k)),
    "weibull": lambda series, ref, **k: weibull_rows(series, ref, **k),
    "season_day": lambda series, ref, **k: (None, cycle_pairs(series, ref, ["M"], **k)),
    "ramps": lambda series, ref, **k: (None, change_pairs(cut(ramps(series, ["M"], **k), "ramps"), ref)),
    "noise": lambda series, ref, **k: (None, change_pairs(cut(noise(series, ["M"], **k), "noise"), ref)),
}


def all_sources_stats(series: DataFrame, ref: str, names=None, *, extras: dict[str, dict] | None = None, periods=tuple(UNITS), info: dict[str, str] | None = None, **options) -> DataFrame:
    """Metrics of each variable of each source at the times that all sources have, of its resampled periods, and of the named extras. info: constant columns. The pairs of all of them go through one comparison."""
    # written once: five comparisons read the matched rows, and derived expressions would be copied into every aggregate
    matched = cut(time_match_sources(series), "matched")
    rows = cut(pairs(with_variables(matched, names or variables(matched)), ref), "pairs")
    every, more = as_pairs(rows), []
    for name, keywords in (extras or {}).items():
        if name in EXTRAS:
            ready, new = EXTRAS[name](matched, ref, **keywords)
            # small tables of their own: one plan of everything would be planned anew after each of its many stages
            every, more = every.unionByName(cut(new, name)), more + ([cut(ready, name)] if ready is not None else [])
    least = F.greatest(least_cells(), least_steps())
    out = compare_stats(every if extras else every.drop("weight"), base=F.col("base"), least=least, **options)
    for ready in more:
        out = out.unionByName(ready)
    rate = per_hour(matched, ref) if periods else 0
    resampled = [p for p in periods if p != "hourly" or rate != 1]
    if len(resampled) < len(periods):  # an hourly series is its own hourly mean
        same = out.where(F.col("metric").isin("length", "r2", "rmse", "MAE", "SAE", "EMD")).join(rows.select("var").distinct(), "var", "left_semi")
        out = out.unionByName(same.withColumn("metric", F.concat("metric", F.lit("_hourly"))))
    if resampled:
        out = out.unionByName(stats_of_resampled(cut(resampled_rows(rows, resampled, rate), "resampled")))
    for k, v in (info or {}).items():
        out = out.withColumn(k, F.lit(v))
    return out


#: The extras of the full score.
SCORE_EXTRAS = {"tabfile": {}, "weibull": {"sectors": 16}, "season_day": {"normalized": "all", "stat": "mean", "min_days": 20}, "ramps": {}, "noise": {}}


def score(solution: DataFrame, submission: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quality by rule, total) of a submission against a solution, both (time, M, Dir)."""
    both = solution.select(F.lit("ref").alias("source"), "time", "M", "Dir").unionByName(submission.select(F.lit("new").alias("source"), "time", "M", "Dir"))
    stats = all_sources_stats(both, "ref", VARIABLES, extras=SCORE_EXTRAS, periods=("hourly", "daily", "monthly", "yearly"))
    quality = compute_quality(deduced_stats(cut(stats, "stats")))
    return quality, total_quality(quality)
