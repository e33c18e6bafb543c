"""Training by fold with pyspark.ml: boosted trees with early stopping, and a comparison of regressors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blend import METRICS, regression_metrics
from .splits import holdout_split, kfold_folds, timeseries_folds

#: Targets and split strategies of a full run.
TARGETS, STRATEGIES, SPLITS = ("U_70.0", "V_70.0", "M"), ("timeseries", "kfold"), 8


def folds(df: DataFrame, strategy: str, splits: int) -> DataFrame:
    """Rows with fold and part, for either strategy."""
    if strategy == "timeseries":
        return timeseries_folds(df, splits)
    if strategy == "kfold":
        tested = kfold_folds(df, splits).withColumnRenamed("fold", "own")
        rows = tested.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        return rows.withColumn("part", F.when(F.col("own") == F.col("fold"), "test").otherwise("train")).drop("own")
    raise ValueError(f"strategy {strategy}")


def _exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fit_or_load(df: DataFrame, estimator, features: list[str], path: str | None) -> PipelineModel:
    """A model, from path if it is there: a run that broke off goes on where it stopped."""
    if path and _exists(df, path):
        return PipelineModel.load(path)
    columns = [f"f{i}" for i in range(len(features))]  # names with dots mean fields to the assembler
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip"), estimator]).fit(_plain(df, features))
    if path:
        model.write().overwrite().save(path)
    return model


def _plain(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f"f{i}": F.col(f"`{f}`").cast("double") for i, f in enumerate(features)})


def predict(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(_plain(df, features)).drop("features", *(f"f{i}" for i in range(len(features))))


def train_boosted(df: DataFrame, features: list[str], target: str, *, strategy: str = "timeseries", splits: int = SPLITS, iterations: int = 50, step: float = 0.1, depth: int = 6, seed: int = 44, folder: str | None = None, holdout: float = 0.3) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(final model, RMSE of each fold and their means, held-out rows with predictions).

    The last share of the rows is held out; folds lie in the rest. A fold's test rows stop its boosting; the last fold's number of trees trains the final model, and is found again from the saved fold if that was loaded (Q19).
    """
    rows = holdout_split(df.withColumn("label", F.col(f"`{target}`").cast("double")).where("label is not null")).withColumnRenamed("part", "held")
    within = folds(rows.where("held = 'train'").drop("row", "held"), strategy, splits)
    scores, trees = [], iterations
    for i in range(splits):
        own = within.where(F.col("fold") == i).withColumn("check", F.col("part") == "test")
        gbt = GBTRegressor(labelCol="label", maxIter=iterations, stepSize=step, maxDepth=depth, seed=seed, validationIndicatorCol="check", maxBins=254)
        model = fit_or_load(own, gbt, features, f"{folder}/{target}-{strategy}-{i}" if folder else None)
        trees = max(1, model.stages[-1].getNumTrees)
        error = F.col("prediction") - F.col("label")
        got = {r["part"]: r["rmse"] for r in predict(model, own, features).groupBy("part").agg(F.sqrt(F.avg(error * error)).alias("rmse")).collect()}
        scores.append((i, got.get("train"), got.get("test")))
    final = fit_or_load(rows.where("held = 'train'"), GBTRegressor(labelCol="label", maxIter=trees, stepSize=step, maxDepth=depth, seed=seed, maxBins=254), features, f"{folder}/{target}-{strategy}" if folder else None)
    table = df.sparkSession.createDataFrame(scores, "fold int, train_rmse double, test_rmse double")
    table = table.unionByName(table.agg(F.lit(-1).alias("fold"), F.avg("train_rmse").alias("train_rmse"), F.avg("test_rmse").alias("test_rmse")))
    return final, table, predict(final, rows.where("held = 'test'"), features).drop("row", "held")


#: Regressors that are compared, by name.
REGRESSORS: dict[str, Callable] = {
    "lr": lambda: LinearRegression(labelCol="label"),
    "ridge": lambda: LinearRegression(labelCol="label", regParam=0.1),
    "lasso": lambda: LinearRegression(labelCol="label", regParam=0.1, elasticNetParam=1.0),
    "glm": lambda: GeneralizedLinearRegression(labelCol="label"),
    "dt": lambda: DecisionTreeRegressor(labelCol="label", seed=44),
    "rf": lambda: RandomForestRegressor(labelCol="label", seed=44, numTrees=20),
    "gbt": lambda: GBTRegressor(labelCol="label", seed=44, maxIter=20),
}


def automl_compare(df: DataFrame, features: list[str], target: str, *, exclude: tuple[str, ...] = (), splits: int = 5, strategy: str = "timeseries") -> DataFrame:
    """A leaderboard: each regressor's metrics, averaged over folds."""
    rows = df.withColumn("label", F.col(f"`{target}`").cast("double")).where("label is not null")
    within = folds(rows, strategy, splits).persist()
    out = []
    for name, make in REGRESSORS.items():
        if name in exclude:
            continue
        got = []
        for i in range(splits):
            own = within.where(F.col("fold") == i)
            model = fit_or_load(own.where("part = 'train'"), make(), features, None)
            got.append(predict(model, own.where("part = 'test'"), features).agg(*(v.alias(k) for k, v in regression_metrics(F.col("label"), F.col("prediction")).items())).first())
        out.append((name, *(_mean([g[m] for g in got]) for m in METRICS)))
    within.unpersist()
    return df.sparkSession.createDataFrame(out, "Model string, " + ", ".join(f"{m} double" for m in METRICS))


def _mean(values: list) -> float | None:
    some = [v for v in values if v is not None]
    return sum(some) / len(some) if some else None


def train_model_for_target(df: DataFrame, features: list[str], target: str, *, strategies=STRATEGIES, folder: str | None = None, **options) -> dict[str, tuple]:
    """train_boosted by each strategy. ValueError for a target that is not there or is a feature too."""
    if target not in df.columns or target in features:
        raise ValueError(f"target {target}")
    return {s: train_boosted(df, features, target, strategy=s, folder=folder, **options) for s in strategies}
