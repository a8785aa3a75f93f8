"""Forecast error metrics as aggregate columns; rows with a null on either side are left out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: denominators are not allowed below this.
FLOOR = 1e-6


def rmse(actual, predicted) -> Column:
    gap = F.col(actual) - F.col(predicted)
    return F.sqrt(F.avg(gap * gap))


def mae(actual, predicted) -> Column:
    return F.avg(F.abs(F.col(actual) - F.col(predicted)))


def smape(actual, predicted) -> Column:
    a, p = F.col(actual), F.col(predicted)
    size = (F.abs(a) + F.abs(p)) / 2
    return F.avg(F.abs(a - p) / F.when(size < FLOOR, FLOOR).otherwise(size)) * 100


def mape(actual, predicted, absolute: bool = False) -> Column:
    """The floor applies to the signed actual value unless ``absolute``."""
    a, p = F.col(actual), F.col(predicted)
    size = F.abs(a) if absolute else a
    return F.avg(F.abs((a - p) / F.when(size < FLOOR, FLOOR).otherwise(size))) * 100


def forecast_metrics(actual, predicted) -> list[Column]:
    parts = {"rmse": rmse, "mae": mae, "smape": smape, "mape": mape}
    return [f(actual, predicted).alias(name) for name, f in parts.items()]
