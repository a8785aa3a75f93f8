"""Calendar parts of a timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def iso_weekday(ts) -> Column:
    """Monday = 1 to Sunday = 7."""
    return F.weekday(ts) + 1


def is_weekend(ts, weekend_from: int = 6) -> Column:
    """Saturday and Sunday; ``weekend_from=5`` counts Friday too."""
    return iso_weekday(ts) >= weekend_from


def season(ts) -> Column:
    """'summer' for June to August, 'winter' for December to February, else null."""
    month = F.month(ts)
    return F.when(month.isin(6, 7, 8), "summer").when(month.isin(12, 1, 2), "winter")


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value that repeats with ``period``."""
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
