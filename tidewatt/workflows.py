"""The operators chained into the four end-to-end jobs: ingest, lag analysis, battery, dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatt.functions import values
from tidewatt.functions.metrics import mae, rmse
from tidewatt.functions.timestamps import parse_timestamp
from tidewatt.operators import buckets, clean, energy, features, lagstats, learn, ordered, quality, seasonal, spectra, stationarity
from tidewatt.plans.sizing import attach, same_keys
from tidewatt.session import freeze
from tidewatt.sources import merge_files, sink_json, sink_parquet
from tidewatt.spec import SeriesSpec

# Periods handled in one pass when seasonal strength is measured.


def ingest(spark: SparkSession, paths, out: str, schema=None) -> dict[str, DataFrame]:
    """CSV files to a typed, date-partitioned table; reports on files, timestamps and nulls."""
    merged, files = merge_files(spark, paths, schema)
    merged = values.lowercase_columns(merged)
    ts = values.detect_timestamp_column(merged, required=True)
    issues = quality.column_issues(merged, ts)
    typed = merged
    if dict(merged.dtypes)[ts] == "string":
        typed = quality.drop_invalid_timestamps(merged, ts)
    sink_parquet(typed.filter(F.col(ts).isNotNull()), out, ts)
    return {"files": files, "issues": issues, "table": spark.read.parquet(out).drop("date")}


def clean_dataset(df: DataFrame, spec: SeriesSpec, out: str, strategies=None, report: str | None = None) -> DataFrame:
    """Parse, lower-case and clean a telemetry table and write it; optionally a JSON report."""
    rows = values.lowercase_columns(df)
    if dict(rows.dtypes)[spec.ts] == "string":
        rows = values.replace_columns(rows, {spec.ts: parse_timestamp(spec.ts)})
    strategies = clean.DEFAULT_STRATEGIES if strategies is None else strategies
    sink_parquet(clean.clean_table(rows, spec, strategies), out, spec.ts)
    if report:
        present = [c for c in strategies if c in rows.columns]
        sink_json(clean.cleaning_report(rows, spec.with_signals(*present), strategies), report)
    return df.sparkSession.read.parquet(out).drop("date")


def lag_analysis(
    df: DataFrame, spec: SeriesSpec, pairs, factor: int = 1000, max_lag: int = 100, window: int = 4320, center: bool = True
) -> dict[str, DataFrame]:
    """Thin out to bucket means, then ACF, PACF, cross-correlation and rolling correlation."""
    rows = values.nan_to_null(df, spec.signals)
    thin = buckets.thin_out(rows, spec, factor)
    spec = SeriesSpec(spec.ts, spec.keys, spec.signals)
    acf = lagstats.acf(thin, spec, max_lag)
    return {
        "bucketed": thin,
        "acf": acf,
        "pacf": lagstats.pacf(acf, [*spec.keys, "signal"]),
        "ccf": lagstats.correlate_pairs(thin, spec, pairs, lagstats.ccf, max_lag=max_lag, center=center),
        "rolling_corr": lagstats.correlate_pairs(thin, spec, pairs, ordered.rolling_corr, window=window),
    }


def forecast_metadata(df: DataFrame, spec: SeriesSpec, step_seconds: float | None = None, max_lag: int = 48) -> DataFrame:
    """Stationarity, periods, seasonal strength, significant lags, transform and model hints.

    One row per key and signal of a regularly spaced table.
    """
    keys = [*spec.keys, "signal"]
    if step_seconds is None:
        step_seconds = buckets.infer_step_median(df, spec)
    order = stationarity.suggest_difference(df, spec)
    periods = freeze(spectra.dominant_periods(df, spec, step_seconds))
    strength = seasonal.seasonal_amplitude_of(df, spec, periods.withColumnRenamed("period_steps", "period"))
    acf = freeze(lagstats.acf(df, spec, max_lag, half_less_one=True))
    pacf = lagstats.pacf(acf, keys, adjusted=True)

    def listed(rows, name, *columns):
        cell = F.struct(*columns)
        return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias(name))

    # Short series have no test result; every key and signal has a row all the same.
    cells = F.explode(F.array(*[F.lit(s) for s in spec.signals])).alias("signal")
    every = df.select(*spec.keys).distinct().select(*spec.keys, cells) if spec.keys else df.sparkSession.range(1).select(cells)
    order = same_keys(every, order, keys)
    out = order.withColumn("stationary", F.coalesce(F.col("suggested_d") == 0, F.lit(False)))
    out = same_keys(out, listed(periods, "dominant_periods", "rank", "period_seconds", "period_hours", "period_steps"), keys)
    out = same_keys(out, listed(strength, "seasonal_strength", "period", "seasonal_amplitude"), keys)
    out = same_keys(out, listed(lagstats.significant_lags(acf, keys), "acf_significant_lags", "lag", "value"), keys)
    out = same_keys(out, listed(lagstats.significant_lags(pacf, keys), "pacf_significant_lags", "lag", "value"), keys)
    out = same_keys(out, stationarity.boxcox_hint(df, spec), keys)
    out = same_keys(out, ordered.rolling_variance_stability(df, spec), keys)
    out = out.withColumn("seasonal", F.coalesce(F.size("seasonal_strength") > 0, F.lit(False)))
    out = stationarity.recommend_models(out)
    overall = out.groupBy(*spec.keys).agg(
        F.bool_and("stationary").alias("overall_stationary"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("dominant_periods.period_steps")))).alias("common_seasonal_periods"),
    )
    return attach(out, overall, spec.keys)


def physics(df: DataFrame, spec: SeriesSpec, hours: float, parameters: DataFrame) -> DataFrame:
    """Simulated state of charge with each key's calibrated capacity and efficiencies."""
    rows = attach(df, parameters.select(*spec.keys, "capacity_kwh", "eta_ch", "eta_dis"), spec.keys)
    up = F.greatest(F.lit(0.0), energy.zero(energy.CHARGE)) * F.col("eta_ch")
    down = F.greatest(F.lit(0.0), energy.zero(energy.DISCHARGE)) * F.col("eta_dis")
    rows = rows.withColumn("_delta", (up - down) * hours / F.col("capacity_kwh") * 100.0).drop("capacity_kwh", "eta_ch", "eta_dis")
    out = energy.clamped_running_balance(rows, spec, "_delta", start=energy.SOC, name="soc_physics")
    return out.drop("_delta").withColumn("residual", F.col(energy.SOC) - F.col("soc_physics"))


def residual_features(spec: SeriesSpec, table: DataFrame) -> list[str]:
    skip = {energy.SOC, "soc_physics", "soc_hybrid", "residual", spec.ts, *spec.keys, *spec.tie}
    numeric, _ = values.split_columns_by_type(table)
    return [c for c in numeric if c not in skip]


def fit_residual(df: DataFrame, spec: SeriesSpec, hours: float, capacity: float, eta: float = 0.95, trees: int = 500):
    """Physics at given parameters, then boosted trees on what it leaves; (model, scored rows)."""
    given = df.sparkSession.range(1).select(
        F.lit(float(capacity)).alias("capacity_kwh"), F.lit(eta).alias("eta_ch"), F.lit(eta).alias("eta_dis")
    )
    table = features.soc_feature_table(physics(df, spec, hours, given), spec)
    return learn.residual_model(table, spec, residual_features(spec, table), trees=trees)


def battery_workflow(df: DataFrame, spec: SeriesSpec, every: str | None = None, per_month: bool = True, trees: int = 500) -> dict:
    """Calibrate, simulate, correct and score the state of charge.

    The table is resampled to a regular step (the most frequent one, if not given). With ``per_month`` each month is calibrated
    and simulated on its own; one model is trained over all of them.
    """
    from tidewatt.functions.timestamps import width_of

    if every is None:
        step = buckets.infer_step_mode(df, spec).filter("step_seconds > 0").agg(F.min("step_seconds")).first()[0]
        if step is None:
            raise ValueError("no step can be inferred from the timestamps")
        every = f"{max(1, round(step))} seconds"
    hours = width_of(every) / width_of("1 hour")
    signals = [energy.SOC, energy.CHARGE, energy.DISCHARGE, "solar_pv_output", "grid_load_demand", "temperature"]
    rows = freeze(buckets.resample_mean(values.add_missing_columns(df, signals), spec.with_signals(*signals), every))
    spec = SeriesSpec(spec.ts, spec.keys)
    if per_month:
        rows, spec = rows.withColumn("month", F.to_date(F.date_trunc("month", spec.ts))), spec.with_keys("month")
    fitted = freeze(energy.fit_parameters(rows, spec, hours))
    simulated = freeze(physics(rows, spec, hours, fitted))
    table = features.soc_feature_table(simulated, spec)
    model, scored = learn.residual_model(table, spec, residual_features(spec, table), trees=trees)
    hybrid = learn.hybrid_correction(simulated, scored, [*spec.keys, spec.ts])
    known = hybrid.filter(F.col(energy.SOC).isNotNull())
    late = F.col("corrected")
    metrics = known.groupBy(*spec.keys).agg(
        F.count("*").alias("n_obs"),
        *[f(energy.SOC, c).alias(f"{n}_{name}") for n, c in (("phys", "soc_physics"), ("hyb", "soc_hybrid")) for name, f in (("rmse", rmse), ("mae", mae))],
        F.sqrt(F.avg(F.when(late, F.pow(F.col(energy.SOC) - F.col("soc_hybrid"), 2)))).alias("ml_val_rmse"),
        F.avg(F.when(late, F.abs(F.col(energy.SOC) - F.col("soc_hybrid")))).alias("ml_val_mae"),
    )
    return {
        "parameters": fitted, "simulated": hybrid, "metrics": metrics, "model": model,
        "importance": learn.feature_importance(df.sparkSession, model),
    }


def dispatch_report(
    df: DataFrame, spec: SeriesSpec, load: str, renewables, soc: str, charge: str, discharge: str, every: str = "15 minutes"
) -> dict[str, DataFrame]:
    """Daily energy, battery-size sweep and recommendation, peaks, and the import model."""
    from tidewatt.functions.timestamps import width_of

    hours = width_of(every) / width_of("1 hour")
    signals = list(dict.fromkeys([load, *renewables, soc, charge, discharge]))
    rows = buckets.bucket_mean(values.require(df, [*spec.keys, spec.ts, *signals]), spec.with_signals(*signals), every)
    spec = SeriesSpec(spec.ts, spec.keys, tuple(signals))
    days = energy.daily_energy_summary(rows, spec, load, renewables, charge, discharge, soc, hours)
    sweep = energy.capacity_sweep(rows, spec, load, renewables, soc, every)
    dated = energy.grid_balance(rows, load, renewables).withColumn("date", F.to_date(spec.ts))
    peaks = quality.extremes_with_time(dated, SeriesSpec(spec.ts, (*spec.keys, "date"), (load, "renewable_kw")))
    ml = energy.daily_ml_rows(days, spec.keys).withColumn("ts", F.col("date").cast("timestamp_ntz"))
    model = learn.ridge_fit(
        ml, SeriesSpec("ts", spec.keys), ["total_load_kwh", "total_renewable_prod_kwh", "battery_capacity_kwh"], "grid_import_kwh"
    )
    return {
        "days": days, "sweep": sweep, "recommendation": energy.recommend_capacity(sweep, [*spec.keys, "date"]),
        "peaks": peaks, "import_model": model,
    }
