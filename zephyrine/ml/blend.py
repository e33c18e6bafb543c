"""Leaderboards, votes and weighted blends of predictions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics of a leaderboard and whether the largest is best.
METRICS = {"MAE": False, "MSE": False, "RMSE": False, "R2": True, "RMSLE": False, "MAPE": False}


def regression_metrics(y: Column, p: Column) -> dict[str, Column]:
    """Aggregates. RMSLE over rows where both are above -1, MAPE over rows with a value other than 0."""
    e = p - y
    logs = F.when((y > -1) & (p > -1), F.log1p(p) - F.log1p(y))
    mean_of_squares = F.avg(e * e)
    return {
        "MAE": F.avg(F.abs(e)),
        "MSE": mean_of_squares,
        "RMSE": F.sqrt(mean_of_squares),
        "R2": 1 - F.try_divide(mean_of_squares, F.var_pop(F.when(p.isNotNull(), y))),
        "RMSLE": F.sqrt(F.avg(logs * logs)),
        "MAPE": F.avg(F.abs(F.try_divide(e, y))),
    }


def rmse(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(p) - F.col(y)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"))


def leaderboard(df: DataFrame, y: str, predictions: list[str]) -> DataFrame:
    """(Model, metrics) of prediction columns: one pass, then a row for each."""
    one = df.agg(*(v.alias(f"{p}|{k}") for p in predictions for k, v in regression_metrics(F.col(y), F.col(p)).items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(p).alias("Model"), *(F.col(f"`{p}|{k}`").alias(k) for k in METRICS)) for p in predictions))))


def best_by_metric(board: DataFrame) -> DataFrame:
    """(metric, Model): the winner of each metric; of equals the first by name. NaN never wins."""
    parts = []
    for m, largest in METRICS.items():
        value = F.when(~F.isnan(m), -F.col(m) if largest else F.col(m))
        parts.append(F.struct(F.lit(m).alias("metric"), F.min_by("Model", F.when(value.isNotNull(), F.struct(value, "Model"))).alias("Model")))
    return board.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def vote_weights(board: DataFrame) -> DataFrame:
    """(Model, votes): how many metrics each winner has won."""
    return best_by_metric(board).where("Model is not null").groupBy("Model").agg(F.count(F.lit(1)).alias("votes"))


def model_id(models: DataFrame, name: str) -> str:
    """The id in (id, name) whose name is equal without case; ValueError without one."""
    row = models.where(F.lower("name") == name.lower()).orderBy("id").first()
    if row is None:
        raise ValueError(f"no model named {name}")
    return row["id"]


def weighted_prediction(predictions: list[str], weights: list[float]) -> Column:
    if len(predictions) != len(weights):
        raise ValueError("predictions and weights must have one length")
    return sum((F.col(p) * float(w) for p, w in zip(predictions, weights, strict=True)), F.lit(0.0)) / float(sum(weights))


def vote_blend(df: DataFrame, y: str, predictions: list[str]) -> DataFrame:
    """df with `blend`: the mean of the winners' predictions, weighted by votes."""
    votes = {r["Model"]: r["votes"] for r in vote_weights(leaderboard(df, y, predictions)).collect()}
    if not votes:
        raise ValueError("no model has a value for any metric")
    names = sorted(votes)
    return df.withColumn("blend", weighted_prediction(names, [votes[n] for n in names]))


class WeightOptimizer:
    """Weights in [1e-15, 1] for a blend of predictions.

    The mean squared error of a blend is a quadratic form of its weights, so one pass over the data gives a small matrix and the search needs no more. A metric of one's own (a function from the blend's Column and y's to an aggregate) costs a pass for each trial. trials counts evaluations in either case.
    """

    LOW, HIGH = 1e-15, 1.0

    def __init__(self, metric: Callable[[Column, Column], Column] | None = None, *, direction: str = "minimize", trials: int = 100, seed: int = 0):
        if direction not in ("minimize", "maximize"):
            raise ValueError(f"direction {direction}")
        self.metric, self.sign, self.trials, self.seed = metric, 1 if direction == "minimize" else -1, trials, seed
        self.weights: list[float] | None = None
        self.predictions: list[str] = []

    def fit(self, df: DataFrame, y: str, predictions: list[str]) -> WeightOptimizer:
        if not predictions:
            raise ValueError("no predictions")
        missing = [c for c in (y, *predictions) if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        n = len(predictions)
        if self.metric is None:
            names = [y, *predictions]
            cells = [F.avg(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[: i + 1]]
            row = df.na.drop("any", subset=names).agg(*(c.alias(f"c{i}") for i, c in enumerate(cells))).first()
            g = np.zeros((n + 1, n + 1))
            g[np.tril_indices(n + 1)] = [math.nan if v is None else v for v in row]
            g = g + np.tril(g, -1).T

            def loss(w: np.ndarray) -> float:
                u = np.concatenate(([-1.0], w / w.sum()))
                return self.sign * math.sqrt(max(float(u @ g @ u), 0.0))
        else:

            def loss(w: np.ndarray) -> float:
                value = df.agg(self.metric(weighted_prediction(predictions, list(w)), F.col(y)).alias("v")).first()[0]
                return self.sign * (math.inf * self.sign if value is None else float(value))

        self.weights, self.predictions = list(self._search(loss, n)), list(predictions)
        return self

    def _search(self, loss, n: int) -> np.ndarray:
        """Evolution with an adapted covariance (CMA-ES): so many trials, from the middle of the range; points outside are taken at its border, and lose by their distance."""
        r = np.random.default_rng(self.seed)
        many = 4 + int(3 * math.log(n))
        half = many // 2
        share = math.log(half + 0.5) - np.log(np.arange(1, half + 1))
        share /= share.sum()
        mass = 1 / (share**2).sum()
        c_path, c_step = (4 + mass / n) / (n + 4 + 2 * mass / n), (mass + 2) / (n + mass + 5)
        c_one = 2 / ((n + 1.3) ** 2 + mass)
        c_many = min(1 - c_one, 2 * (mass - 2 + 1 / mass) / ((n + 2) ** 2 + mass))
        damp = 1 + 2 * max(0.0, math.sqrt((mass - 1) / (n + 1)) - 1) + c_step
        length = math.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))
        mean, step, cov, path, path_step = np.full(n, 0.5), 0.3, np.eye(n), np.zeros(n), np.zeros(n)
        best, value, tried = mean.copy(), loss(mean), 1
        while tried < self.trials:
            size, axes = np.linalg.eigh((cov + cov.T) / 2)
            size = np.sqrt(np.maximum(size, 1e-20))
            moves, scores = [], []
            for _ in range(min(many, self.trials - tried)):
                move = axes @ (size * r.standard_normal(n))
                inside = np.clip(mean + step * move, self.LOW, self.HIGH)
                score = loss(inside)
                tried += 1
                if score < value:
                    best, value = inside, score
                moves.append(move)
                scores.append(score + float(((mean + step * move - inside) ** 2).sum()))
            if len(moves) < many:
                break
            chosen = np.array(moves)[np.argsort(scores, kind="stable")[:half]]
            move = share @ chosen
            mean = mean + step * move
            path_step = (1 - c_step) * path_step + math.sqrt(c_step * (2 - c_step) * mass) * (axes @ ((axes.T @ move) / size))
            steady = np.linalg.norm(path_step) / math.sqrt(1 - (1 - c_step) ** (2 * tried / many)) < (1.4 + 2 / (n + 1)) * length
            path = (1 - c_path) * path + steady * math.sqrt(c_path * (2 - c_path) * mass) * move
            cov = (1 - c_one - c_many) * cov + c_one * np.outer(path, path) + c_many * (chosen.T * share) @ chosen
            step = min(step * math.exp((c_step / damp) * (np.linalg.norm(path_step) / length - 1)), 1.0)
        return best

    def predict(self, df: DataFrame, name: str = "blend") -> DataFrame:
        return df.withColumn(name, weighted_prediction(self.predictions, self.get_weights()))

    def fit_predict(self, df: DataFrame, y: str, predictions: list[str], name: str = "blend") -> DataFrame:
        return self.fit(df, y, predictions).predict(df, name)

    def get_weights(self) -> list[float]:
        if self.weights is None:
            raise RuntimeError("fit first")
        return self.weights


def kde_grid(df: DataFrame, column: str, *, low: float, high: float, points: int = 200, width: float | None = None, keys: tuple[str, ...] = ("source",), bins: int = 4096) -> DataFrame:
    """(keys, x, density): Gaussian kernel density over a fixed grid. Values are counted in fine bins first, so the kernels go over at most `bins` of them for each key and not over all rows. width: the kernel's; by default Scott's rule."""
    some = df.where(F.col(column).isNotNull())
    shape = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(column).alias("s"))
    shape = shape.withColumn("h", F.lit(width) if width else F.col("s") * F.pow("n", -0.2)).where("h > 0")
    step = (high - low) / bins
    counts = some.groupBy(*keys, F.floor((F.col(column) - low) / step).alias("j")).agg(F.count(F.lit(1)).alias("c"), F.avg(column).alias("v"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * ((high - low) / (points - 1)))
    rows = counts.join(shape, list(keys)).withColumn("x", F.explode(grid))
    z = (F.col("x") - F.col("v")) / F.col("h")
    return rows.groupBy(*keys, "x").agg((F.sum(F.col("c") * F.exp(-z * z / 2)) / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))).alias("density"))
