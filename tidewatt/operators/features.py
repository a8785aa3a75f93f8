"""Calendar, cyclic, product, lag and rolling features and the two feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatt.functions.calendar import cycle, is_weekend, iso_weekday
from tidewatt.functions.values import clip_negative, quoted
from tidewatt.operators.buckets import bucket_mean
from tidewatt.operators.ordered import add_rolling_full, add_rolling_partial, lag_columns
from tidewatt.operators.rolling import drop_moments
from tidewatt.plans.order import chunked
from tidewatt.spec import SeriesSpec


def calendar_features(df: DataFrame, ts: str, weekend_from: int = 6) -> DataFrame:
    """hour, day, weekday (Monday = 1), dayofweek (Monday = 0), date, month, quarter, is_weekend."""
    parts = {
        "hour": F.hour(ts), "day": F.dayofmonth(ts), "weekday": iso_weekday(ts), "dayofweek": F.weekday(ts),
        "date": F.to_date(ts), "month": F.month(ts), "quarter": F.quarter(ts),
        "is_weekend": is_weekend(ts, weekend_from).cast("tinyint"),
    }
    return df.select("*", *[e.alias(n) for n, e in parts.items()])


def cyclic_features(df: DataFrame, ts: str) -> DataFrame:
    """Sine and cosine of the hour of day and of the ISO weekday."""
    hour_sin, hour_cos = cycle(F.hour(ts), 24)
    dow_sin, dow_cos = cycle(iso_weekday(ts), 7)
    return df.select(
        "*", hour_sin.alias("hour_sin"), hour_cos.alias("hour_cos"), dow_sin.alias("dow_sin"), dow_cos.alias("dow_cos")
    )


# Product columns and their two factors.
PRODUCTS = {
    "wind_power_profile": ("wind_speed", "wind_power_output"),
    "solar_power_profile": ("solar_irradiance", "solar_pv_output"),
}


def product_features(df: DataFrame, products=None) -> DataFrame:
    products = PRODUCTS if products is None else products
    return df.select("*", *[(quoted(a) * quoted(b)).alias(name) for name, (a, b) in products.items()])


def forecast_feature_table(
    df: DataFrame, spec: SeriesSpec, names: dict[str, str], every: str = "15 minutes", lags=(1, 2, 96), windows=(4, 8, 96),
    weekend_from: int = 6, rows_per_chunk: int | None = None,
) -> DataFrame:
    """Bucket means with calendar, cyclic, lag and rolling features.

    ``names`` maps output to input columns. Negative values are clipped last, so lags and
    rolling statistics see the raw means. Lags and rolling windows share one shuffle.
    """
    renamed = df.select(*spec.keys, spec.ts, *[quoted(src).alias(out) for out, src in names.items()])
    spec = SeriesSpec(spec.ts, spec.keys, tuple(names))
    rows = cyclic_features(calendar_features(bucket_mean(renamed, spec, every), spec.ts, weekend_from), spec.ts)
    parts = chunked(rows, spec, before=max(*lags, *windows), rows_per_chunk=rows_per_chunk)
    frame, rolling = add_rolling_full(parts, spec.signals, windows)
    table = parts.trim(frame.select("*", *lag_columns(parts, spec.signals, lags), *rolling))
    return clip_negative(drop_moments(table), spec.signals)


# Columns of the state-of-charge feature table.
SOC_LAGGED = (
    "battery_charging_rate", "battery_discharging_rate", "net_power", "solar_pv_output", "grid_load_demand", "temperature",
)
SOC_ROLLED = ("net_power", "solar_pv_output", "grid_load_demand", "temperature")


def soc_feature_table(
    df: DataFrame, spec: SeriesSpec, lagged=SOC_LAGGED, rolled=SOC_ROLLED, lags=(1, 3, 6, 24), windows=(3, 6, 24),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Lags and trailing means of the battery signals plus hour and weekday (Monday = 0)."""
    if "net_power" not in df.columns:
        from tidewatt.operators.energy import net_power

        df = net_power(df, name="net_power")
    parts = chunked(df, spec, before=max(*lags, *windows), rows_per_chunk=rows_per_chunk)
    frame, rolling = add_rolling_partial(parts, rolled, windows)
    lag_cols = lag_columns(parts, lagged, lags, lambda s, k: f"{s}_lag{k}")
    table = drop_moments(parts.trim(frame.select("*", *lag_cols, *rolling)))
    return table.select("*", F.hour(spec.ts).alias("hour"), F.weekday(spec.ts).alias("dayofweek"))
