"""Decomposition and seasonal-naive forecasts with a hold-out evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatt.functions.metrics import forecast_metrics
from tidewatt.functions.values import quoted
from tidewatt.operators.ordered import fill_backward_forward, holdout_last, long_form, with_length
from tidewatt.operators.seasonal import seasonal_decompose
from tidewatt.plans.sizing import same_keys
from tidewatt.session import freeze
from tidewatt.spec import SeriesSpec


def forecast(df: DataFrame, spec: SeriesSpec, horizon: int = 96, period: int = 96) -> DataFrame:
    """Trend line plus seasonal part of every signal for ``horizon`` steps.

    The line is fitted to the last period of centred means and drawn on; the seasonal part is the
    mean detrended value per phase. All of it is aggregates: no series is walked. Input is a
    regularly spaced table; series shorter than two periods give no rows.
    """
    keys = [*spec.keys, "signal"]
    # Lengths, line and season are all read from the decomposition, so it is written once.
    parts = freeze(seasonal_decompose(df, spec, period, extrapolate=False).select(*keys, "idx", "trend", "seasonal"))
    half = period // 2
    sizes = parts.groupBy(*keys).agg((F.max("idx") + 1).alias("n_rows"))
    placed = same_keys(parts, sizes, keys)
    # Positions are counted back from the end, which keeps the sums small.
    back = (F.col("idx") - F.col("n_rows")).cast("double")
    late = F.col("trend").isNotNull() & (F.col("idx") >= F.col("n_rows") - half - period)
    line = placed.groupBy(*keys, "n_rows").agg(
        F.regr_slope(F.when(late, F.col("trend")), back).alias("_k"), F.regr_intercept(F.when(late, F.col("trend")), back).alias("_b")
    )
    season = placed.filter(F.col("idx") >= F.col("n_rows") - period).select(*keys, (F.col("idx") % period).alias("_phase"), "seasonal")
    ahead = line.withColumn("step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(horizon).cast("bigint"))))
    ahead = ahead.withColumn("idx", F.col("n_rows") + F.col("step") - 1).withColumn("_phase", F.col("idx") % period)
    value = F.col("_k") * (F.col("step") - 1).cast("double") + F.col("_b") + F.col("seasonal")
    return same_keys(ahead, season, [*keys, "_phase"]).select(*keys, "step", "idx", value.alias("forecast"))


def seasonal_naive(df: DataFrame, spec: SeriesSpec, horizon: int = 96, period: int = 96) -> DataFrame:
    """Repeat the last observed period."""
    rows, long = long_form(df, spec)
    keys = list(long.keys)
    placed = with_length(rows.filter("value IS NOT NULL"), long)
    last = placed.filter(F.col("idx") >= F.col("n_rows") - period)
    ahead = F.col("idx") - (F.col("n_rows") - period)
    turns = -(-horizon // period)
    repeated = last.filter(F.col("n_rows") >= period).withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    step = (ahead + 1 + F.col("_turn") * period).cast("bigint")
    out = repeated.select(*keys, step.alias("step"), "n_rows", F.col("value").alias("forecast"))
    return out.filter(F.col("step") <= horizon).select(*keys, "step", (F.col("n_rows") + F.col("step") - 1).alias("idx"), "forecast")


def backtest(df: DataFrame, spec: SeriesSpec, horizon: int = 96, period: int = 96, model=forecast) -> DataFrame:
    """Forecast the held-out last ``horizon`` rows; returns actual and predicted side by side."""
    filled = fill_backward_forward(df, spec)
    labelled = holdout_last(filled, spec, horizon)
    train = labelled.filter("split = 'train'").drop("idx", "split")
    test, long = long_form(labelled.filter("split = 'test'"), spec, ["idx"])
    predicted = model(train, spec, horizon, period).select(*long.keys, "idx", "forecast")
    return same_keys(test, predicted, [*long.keys, "idx"]).withColumnRenamed("forecast", "predicted")


def score(pairs: DataFrame, keys, actual: str = "value", predicted: str = "predicted") -> DataFrame:
    """RMSE, MAE, sMAPE and MAPE per key over the rows that have both values."""
    both = pairs.filter(quoted(actual).isNotNull() & quoted(predicted).isNotNull())
    return both.groupBy(*keys).agg(*forecast_metrics(actual, predicted))
