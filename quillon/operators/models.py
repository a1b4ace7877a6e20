"""Model scoring, quality of predictions, and when to retrain."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) for the pairs that occur."""
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, from the confusion counts."""
    cells = confusion(df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()), truth, predicted)
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    ends = cells.select(
        F.explode(
            F.array(
                F.struct(F.col(truth).alias("class"), hit.cast("long").alias("tp"), F.col("n").alias("support"), zero.alias("called")),
                F.struct(F.col(predicted).alias("class"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("called")),
            )
        ).alias("e")
    ).select("e.*")
    classes = ends.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    precision = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("called")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("called")), F.lit(0.0))
    weighted = lambda value: F.sum(value * F.col("support")) / F.sum("support")
    return classes.agg(
        F.sum("support").alias("samples"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
        weighted(f1).alias("f1"),
    )


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """MSE, MAE and R squared in one pass."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    rows = df.filter(y.isNotNull() & p.isNotNull())
    n, error = F.count(F.lit(1)), F.sum((y - p) ** 2)
    return rows.agg(
        n.alias("samples"),
        F.try_divide(error, n).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - F.try_divide(error, F.var_pop(y) * n)).alias("r2"),
    )


def degradation(metrics: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Change of current_value against baseline_value, severity and direction.

    A change in either direction flags; `direction` tells which one it was.
    """
    change = F.try_divide(F.col("current_value") - F.col("baseline_value"), F.col("baseline_value")) * 100
    size = F.abs("change_percentage")
    return (
        metrics.withColumn("change_percentage", change)
        .withColumn("performance_degraded", size > threshold * 100)
        .withColumn(
            "severity",
            F.when(size < 5, "low").when(size < 15, "medium").when(size < 30, "high").otherwise("critical"),
        )
        .withColumn("direction", F.when(F.col("change_percentage") < 0, "down").when(F.col("change_percentage") > 0, "up").otherwise("same"))
    )


def retraining_due(
    triggers: DataFrame, stats: DataFrame, now: dt.datetime | str, cooldown_hours: int = 24,
    degradation_limit: float = 0.05, drift_limit: float = 0.2, max_age_days: int = 30, min_new_rows: int = 10000,
) -> DataFrame:
    """Triggers joined with the model statistics, plus `fires`.

    triggers: model, trigger_type, schedule, threshold, last_triggered. stats, one row per model:
    current_performance, baseline_performance, drifted_features, checked_features, recent_rows,
    model_created_at, new_rows.
    """
    moment = F.lit(now).cast("timestamp")
    last = F.col("last_triggered").cast("timestamp")
    elapsed = F.unix_micros(moment) - F.unix_micros(last)
    days = F.floor(elapsed / F.lit(86_400_000_000))
    age = F.floor((F.unix_micros(moment) - F.unix_micros(F.col("model_created_at").cast("timestamp"))) / F.lit(86_400_000_000))
    limit = lambda default: F.coalesce(F.col("threshold"), F.lit(float(default)))
    scheduled = (
        F.when(F.col("schedule") == "daily", last.isNull() | (F.to_date(moment) > F.to_date(last)))
        .when(F.col("schedule") == "weekly", last.isNull() | (days >= 7))
        .when(F.col("schedule") == "monthly", last.isNull() | (days >= 30))
    )
    loss = F.try_divide(F.col("baseline_performance") - F.col("current_performance"), F.col("baseline_performance"))
    drifted = F.coalesce(F.try_divide(F.col("drifted_features"), F.col("checked_features")), F.lit(0.0))
    kind = F.col("trigger_type")
    due = (
        F.when(kind == "scheduled", scheduled)
        .when(kind == "performance_degradation", loss > limit(degradation_limit))
        .when(kind == "data_drift", (F.col("recent_rows") >= 100) & (drifted > limit(drift_limit)))
        .when(kind == "model_staleness", age > limit(max_age_days))
        .when(kind == "data_volume", F.col("new_rows") >= limit(min_new_rows))
    )
    resting = F.coalesce(elapsed < F.lit(cooldown_hours * 3_600_000_000), F.lit(False))
    return triggers.join(stats, "model", "left").withColumn("fires", ~resting & F.coalesce(due, F.lit(False)))


def scored_rows(model, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Predictions and confidences (not a number where the model has none), one of each a row, or an error."""
    matrix = np.array(vectors.tolist(), dtype="float64")
    if matrix.ndim != 2:  # missing vectors make a row of their own, which a model as wide would take
        raise ValueError("no vector")
    prediction = np.asarray(model.predict(matrix), dtype="float64")
    confidence = np.max(model.predict_proba(matrix), axis=1) if hasattr(model, "predict_proba") else np.full(len(vectors), np.nan)
    if np.shape(prediction)[:1] != (len(vectors),) or np.shape(confidence)[:1] != (len(vectors),):
        raise ValueError("not one prediction a vector")
    return prediction, confidence


def scored_row(model, vector) -> tuple[float, float, str]:
    try:
        prediction, confidence = scored_rows(model, pd.Series([vector]))
        return float(prediction[0]), float(confidence[0]), "success"
    except Exception as error:
        return np.nan, np.nan, f"error: {error}"


def score(df: DataFrame, identity: str, features: str, model_column: str, models: dict[str, object]) -> DataFrame:
    """Batch scoring with any mix of models per row, in Arrow batches and without a shuffle.

    `features` is an array<double> column. A model has `predict`, and may have `predict_proba`,
    over a 2-d array. An unknown model or a failing one is reported in `status`, row by row and with
    the error's text, so one bad vector spoils no other.
    The models travel once per executor as a broadcast; pass only ones that fit in memory.
    """
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(models))
    kind = df.schema[identity].dataType.simpleString()
    schema = f"`{identity}` {kind}, model string, prediction double, confidence double, status string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = cloudpickle.loads(shared.value)
        for batch in batches:
            for name, rows in batch.groupby(model_column, sort=False, dropna=False):
                label = pd.Series([None if pd.isna(name) else name] * len(rows), index=rows.index, dtype=object)
                out = pd.DataFrame({identity: rows[identity], "model": label, "prediction": np.nan, "confidence": np.nan})
                model = known.get(name)
                if model is None:
                    yield out.assign(status="model_not_found")
                    continue
                # Vectors of one length are scored together; if that fails, each on its own.
                for _, same in rows.groupby(rows[features].map(lambda v: -1 if v is None else len(v)), sort=False):
                    try:
                        prediction, confidence = scored_rows(model, same[features])
                        status = ["success"] * len(same)
                    except Exception:
                        single = [scored_row(model, vector) for vector in same[features]]
                        prediction, confidence, status = map(list, zip(*single))
                    yield out.loc[same.index].assign(prediction=prediction, confidence=confidence, status=status)

    scored = df.select(identity, model_column, features).mapInPandas(run, schema)
    number = lambda name: F.when(~F.isnan(name), F.col(name)).alias(name)
    return scored.select(identity, "model", number("prediction"), number("confidence"), "status")


class LinearModel:
    """Weights and a bias; with two classes, the logistic of the score is the probability."""

    def __init__(self, weights: list[float], bias: float = 0.0):
        self.weights = np.asarray(weights, dtype="float64")
        self.bias = bias

    def predict(self, matrix: np.ndarray) -> np.ndarray:
        return matrix @ self.weights + self.bias


class LogisticModel(LinearModel):
    def predict_proba(self, matrix: np.ndarray) -> np.ndarray:
        chance = 1.0 / (1.0 + np.exp(-super().predict(matrix)))
        return np.column_stack([1.0 - chance, chance])

    def predict(self, matrix: np.ndarray) -> np.ndarray:
        return (super().predict(matrix) > 0).astype("float64")
