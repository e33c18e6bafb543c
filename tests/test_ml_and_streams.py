"""Splits, blends, trainers, streams, and the contract of the entry file."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from zephyrine.ml import blend, splits, train
from zephyrine.streaming.resample import run_available, stream_resample

T0 = dt.datetime(2021, 5, 1)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(100).select(F.expr("timestampadd(HOUR, cast((id * 37) % 100 as int), timestamp_ntz'2021-05-01 00:00:00')").alias("time"), (F.col("id") % 10).cast("double").alias("x"), ((F.col("id") % 10) * 2.0 + F.sin("id")).alias("y"))


def test_splits(rows):
    held = splits.holdout_split(rows)
    assert held.where("part = 'test'").count() == 30 and held.where("part = 'test'").agg(F.min("row")).first()[0] == 70
    assert [r.row for r in held.orderBy("time").collect()] == list(range(100))
    folds = splits.timeseries_folds(rows, 8)
    sizes = {(r.fold, r.part): r["count"] for r in folds.groupBy("fold", "part").count().collect()}
    assert all(sizes[i, "test"] == 11 and sizes[i, "train"] == 12 + 11 * i for i in range(8))
    assert sorted(r["count"] for r in splits.kfold_folds(rows, 8).groupBy("fold").count().collect()) == [12] * 4 + [13] * 4
    for f in (splits.timeseries_folds, splits.kfold_folds):
        with pytest.raises(ValueError):
            f(rows.limit(3), 8)


def test_weights(spark, rows):
    df = rows.withColumns({"a": F.col("y") + 1, "b": F.col("y") - 1, "c": F.lit(50.0)})
    model = blend.WeightOptimizer(seed=3)
    with pytest.raises(RuntimeError):
        model.predict(df)
    got = blend.rmse(model.fit_predict(df, "y", ["a", "b", "c"]), "y", "blend").first()[0]
    equal = blend.rmse(df.withColumn("blend", blend.weighted_prediction(["a", "b", "c"], [1, 1, 1])), "y", "blend").first()[0]
    assert got < 0.05 < equal and all(1e-15 <= w <= 1 for w in model.get_weights())
    own = blend.WeightOptimizer(lambda p, y: -F.avg(F.abs(p - y)), direction="maximize", trials=25).fit(df, "y", ["a", "c"])
    assert own.get_weights()[0] > own.get_weights()[1]
    for bad in ([], ["nothing"]):
        with pytest.raises(ValueError):
            blend.WeightOptimizer().fit(df, "y", bad)
    with pytest.raises(ValueError):
        blend.weighted_prediction(["a"], [1, 2])


def test_votes(spark, rows):
    df = rows.withColumns({"good": F.col("y") + 0.1, "bad": F.col("y") * 0})
    assert {r.Model for r in blend.best_by_metric(blend.leaderboard(df, "y", ["bad", "good"])).collect()} == {"good"}
    out = blend.vote_blend(df, "y", ["bad", "good"])
    assert blend.rmse(out, "y", "blend").first()[0] == pytest.approx(0.1)
    models = spark.createDataFrame([("lr", "Linear Regression")], "id string, name string")
    assert blend.model_id(models, "linear regression") == "lr"
    with pytest.raises(ValueError):
        blend.model_id(models, "x")


def test_density_sums_to_one(rows):
    grid = blend.kde_grid(rows.withColumn("source", F.lit("s")), "x", low=-20.0, high=30.0, points=501)
    assert math.isclose(grid.agg(F.sum("density")).first()[0] * 0.1, 1, rel_tol=1e-3)


def test_trials_are_trials(rows):
    import numpy as np

    for n, trials in ((2, 60), (5, 300)):
        seen = []
        target = np.linspace(0.2, 0.9, n)

        def loss(w, seen=seen, target=target):
            seen.append(w)
            return float(((w - target) ** 2).sum())

        best = blend.WeightOptimizer(trials=trials)._search(loss, n)
        assert len(seen) <= trials and np.abs(best - target).max() < 0.05
        assert all((w >= 1e-15).all() and (w <= 1).all() for w in seen)


def test_training_resumes(spark, rows, tmp_path):
    options = {"splits": 2, "iterations": 4, "depth": 2, "folder": str(tmp_path)}
    first = train.train_boosted(rows, ["x"], "y", **options)
    again = train.train_boosted(rows, ["x"], "y", **options)
    assert [tuple(r) for r in first[1].orderBy("fold").collect()] == [tuple(r) for r in again[1].orderBy("fold").collect()]
    assert first[2].count() == 30 and (tmp_path / "y-timeseries").exists()
    assert set(train.train_model_for_target(rows, ["x"], "y", splits=2, iterations=2, depth=2)) == {"timeseries", "kfold"}
    board = train.automl_compare(rows, ["x"], "y", splits=2, exclude=("rf", "gbt", "dt", "glm"))
    assert {r.Model for r in board.collect()} == {"lr", "ridge", "lasso"}
    for target, features in (("zzz", ["x"]), ("x", ["x"])):
        with pytest.raises(ValueError):
            train.train_model_for_target(rows, features, target)


def test_stream_equals_batch(spark, tmp_path):
    data = [("a", T0 + dt.timedelta(minutes=7 * i), float(i)) for i in range(200)]
    df = spark.createDataFrame(data, "source string, time timestamp_ntz, M double")
    df.where("M < 100").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {(r.source, r.time): (r.m, r.n) for r in df.groupBy("source", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("time")).agg(F.avg("M").alias("m"), F.count(F.lit(1)).alias("n")).collect()}

    def run(mode):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        run_available(stream_resample(stream, ["M"]), str(tmp_path / mode), str(tmp_path / f"{mode}-state"), mode=mode)
        return {(r.source, r.time): (r.M, r.n) for r in spark.read.parquet(str(tmp_path / mode)).collect()}

    run("append")
    df.where("M >= 100").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    closed = run("append")
    assert closed and all(want[k] == v for k, v in closed.items()) and len(closed) < len(want)
    assert run("complete") == want


def test_contract(spark):
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 80
    assert entry.entry(spark).columns == ["source", "var", "metric", "value"]
