"""Feature tables, forecasts, metrics and models."""

from pyspark.sql import functions as F

from tidewatt.catalog.common import EVENTS, HOURLY, HOURLY_SQL, events, hourly, query, table
from tidewatt.functions.metrics import forecast_metrics
from tidewatt.operators import features, forecast, learn, ordered
from tidewatt.operators.buckets import resample_mean
from tidewatt.spec import SeriesSpec
from tidewatt import workflows

CYCLES = "sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos, sin(2 * pi() * isodow(ts) / 7) AS dow_sin, cos(2 * pi() * isodow(ts) / 7) AS dow_cos"
PARTS = (
    "hour(ts) AS hour, day(ts) AS day, isodow(ts) AS weekday, isodow(ts) - 1 AS dayofweek, CAST(ts AS DATE) AS date, month(ts) AS month, "
    "quarter(ts) AS quarter, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend"
)
SINES = "hour_sin hour_cos dow_sin dow_cos"


@query("calendar_features", f"SELECT event_id, ts, {PARTS} FROM events")
def _(spark, sf):
    return features.calendar_features(events(spark, sf).select("event_id", "ts"), "ts")


@query("calendar_features_friday_weekend", "SELECT event_id, ts, CASE WHEN isodow(ts) >= 5 THEN 1 ELSE 0 END AS is_weekend FROM events")
def _(spark, sf):
    return features.calendar_features(events(spark, sf).select("event_id", "ts"), "ts", 5).select("event_id", "ts", "is_weekend")


@query("cyclic_features", f"SELECT event_id, ts, {CYCLES} FROM events", SINES)
def _(spark, sf):
    return features.cyclic_features(events(spark, sf).select("event_id", "ts"), "ts")


@query(
    "product_features",
    "SELECT l_returnflag, sum(l_quantity * l_discount) AS a, max(l_extendedprice * l_tax) AS b FROM lineitem GROUP BY 1",
    "a b", 4,
)
def _(spark, sf):
    rows = features.product_features(
        table(spark, sf, "lineitem"), {"qd": ("l_quantity", "l_discount"), "pt": ("l_extendedprice", "l_tax")}
    )
    return rows.groupBy("l_returnflag").agg(F.sum("qd").alias("a"), F.max("pt").alias("b"))


SIGNALS = {"load_kw": "view", "pv_kw": "click", "wind_kw": "purchase"}


def site(spark, sf):
    """Raw site rows: one column per signal, shifted so that some readings are negative."""
    return events(spark, sf).select(
        "ts", *[F.when(F.col("event_type") == e, F.col("value") - 5).alias(f"{s}_raw") for s, e in SIGNALS.items()]
    )


def table_sql() -> str:
    base = (
        "SELECT make_timestamp(epoch_us(ts) - epoch_us(ts) % 900000000) AS ts, "
        + ", ".join(f"avg(CASE WHEN event_type = '{e}' THEN value - 5 END) AS {s}" for s, e in SIGNALS.items()) + " FROM events GROUP BY 1"
    )
    out = ["ts", PARTS, CYCLES] + [f"CASE WHEN {s} < 0 THEN 0.0 ELSE {s} END AS {s}" for s in SIGNALS]
    for s in SIGNALS:
        out += [f'lag({s}, {k}) OVER (ORDER BY ts) AS "{s}_t-{k}"' for k in (1, 2, 96)]
        for w in (4, 8, 96):
            frame = f"OVER (ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
            for label, fn in (("mean", "avg"), ("std", "stddev_samp")):
                out.append(f"CASE WHEN count({s}) {frame} = {w} THEN {fn}({s}) {frame} END AS {s}roll_{label}{w}")
    return f"SELECT {', '.join(out)} FROM ({base})"


TABLE_ROUNDS = " ".join(
    [SINES, *SIGNALS, *[f"{s}_t-{k}" for s in SIGNALS for k in (1, 2, 96)], *[f"{s}roll_{m}{w}" for s in SIGNALS for m in ("mean", "std") for w in (4, 8, 96)]]
)


@query("forecast_feature_table", table_sql(), TABLE_ROUNDS, 8)
def _(spark, sf):
    return features.forecast_feature_table(site(spark, sf), SeriesSpec("ts"), {s: f"{s}_raw" for s in SIGNALS})


# The hourly site view under the battery table's column names.
BATTERY = {
    "battery_charging_rate": "charge_kw", "battery_discharging_rate": "discharge_kw", "solar_pv_output": "solar_kw",
    "grid_load_demand": "load_kw", "temperature": "wind_kw", "battery_state_of_charge": "soc",
}
BATTERY_SQL = "SELECT ts, " + ", ".join(f"{v} AS {k}" for k, v in BATTERY.items()) + f", coalesce(discharge_kw, 0.0) - coalesce(charge_kw, 0.0) AS net_power FROM ({HOURLY_SQL})"
SITE = SeriesSpec("ts")


def battery(spark, sf):
    return hourly(spark, sf).select("ts", *[F.col(v).alias(k) for k, v in BATTERY.items()])


def complete_battery(spark, sf):
    return ordered.fill_backward_forward(battery(spark, sf), SITE.with_signals(*BATTERY))


def soc_sql() -> str:
    out = ["*", "hour(ts) AS hour", "isodow(ts) - 1 AS dayofweek"]
    out += [f"lag({s}, {k}) OVER (ORDER BY ts) AS {s}_lag{k}" for k in (1, 3, 6, 24) for s in features.SOC_LAGGED]
    out += [f"avg({s}) OVER (ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {s}_roll_{w}" for w in (3, 6, 24) for s in features.SOC_ROLLED]
    return f"SELECT {', '.join(out)} FROM ({BATTERY_SQL})"


SOC_ROUNDS = " ".join(
    [*BATTERY, "net_power", *[f"{s}_lag{k}" for s in features.SOC_LAGGED for k in (1, 3, 6, 24)], *[f"{s}_roll_{w}" for s in features.SOC_ROLLED for w in (3, 6, 24)]]
)


@query("soc_feature_table", soc_sql(), SOC_ROUNDS, 8)
def _(spark, sf):
    return features.soc_feature_table(battery(spark, sf), SITE)


def daily_cycle(spark, sf):
    """Gap-free hourly means per event type."""
    rows = resample_mean(events(spark, sf), EVENTS, "1 hour")
    return ordered.fill_backward_forward(rows, SeriesSpec("ts", ("event_type",), ("value",)))


HOURS = SeriesSpec("ts", ("event_type",), ("value",))


FILLED_HOURS = (
    "SELECT event_type, ts, coalesce(first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
    "last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value, "
    "row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY event_type) AS n FROM ("
    "SELECT g.event_type, g.h AS ts, b.value FROM (SELECT event_type, unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS h FROM events GROUP BY 1) g "
    "LEFT JOIN (SELECT event_type, date_trunc('hour', ts) AS h, avg(value) AS value FROM events GROUP BY 1, 2) b ON b.event_type = g.event_type AND b.h = g.h)"
)


@query(
    "seasonal_naive",
    f"SELECT event_type, 'value' AS signal, k * 24 + idx - (n - 24) + 1 AS step, idx + 24 * (k + 1) AS idx, value AS forecast FROM ({FILLED_HOURS}) CROSS JOIN (SELECT unnest(range(4)) AS k) WHERE idx >= n - 24",
    "forecast",
)
def _(spark, sf):
    return forecast.seasonal_naive(daily_cycle(spark, sf), HOURS, 96, 24)


ERRORS = (
    "sqrt(avg((a - p) * (a - p))) AS rmse, avg(abs(a - p)) AS mae, avg(abs(a - p) / greatest((abs(a) + abs(p)) / 2, 1e-6)) * 100 AS smape, "
    "avg(abs((a - p) / greatest(a, 1e-6))) * 100 AS mape"
)


@query(
    "forecast_metrics",
    f"SELECT event_type, 'value' AS signal, {ERRORS} FROM (SELECT t.event_type, t.value AS a, s.value AS p FROM ({FILLED_HOURS}) t JOIN ({FILLED_HOURS}) s "
    "ON s.event_type = t.event_type AND s.idx = (t.n - 96 - 24) + (t.idx - (t.n - 96)) % 24 WHERE t.idx >= t.n - 96) GROUP BY 1",
    "rmse mae smape mape", 4,
)
def _(spark, sf):
    pairs = forecast.backtest(daily_cycle(spark, sf), HOURS, 96, 24, forecast.seasonal_naive)
    return forecast.score(pairs, ["event_type", "signal"])


def decomposed(rows: str) -> str:
    """96 steps ahead: line over the last 24 centred means plus centred phase means; period 24."""
    window = "OVER (PARTITION BY event_type ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)"
    return (
        f"WITH f AS ({rows}), c AS (SELECT *, CASE WHEN count(*) {window} = 25 THEN (sum(value) {window} - (lag(value, 12) OVER (PARTITION BY event_type ORDER BY idx) + lead(value, 12) OVER (PARTITION BY event_type ORDER BY idx)) / 2) / 24 END AS trend FROM f), "
        "p AS (SELECT event_type, idx % 24 AS phase, avg(value - trend) AS m FROM c GROUP BY 1, 2), "
        "s AS (SELECT event_type, phase, m - avg(m) OVER (PARTITION BY event_type) AS seasonal FROM p), "
        "l AS (SELECT event_type, n, regr_slope(trend, idx - n) AS k, regr_intercept(trend, idx - n) AS b FROM c WHERE trend IS NOT NULL AND idx >= n - 36 GROUP BY 1, 2), "
        "a AS (SELECT event_type, n, k, b, unnest(range(1, 97)) AS step FROM l) "
        "SELECT a.event_type, 'value' AS signal, step, n + step - 1 AS idx, k * (step - 1) + b + seasonal AS forecast FROM a JOIN s ON s.event_type = a.event_type AND s.phase = (n + step - 1) % 24"
    )


@query("forecast", decomposed(FILLED_HOURS), "forecast", 4)
def _(spark, sf):
    return forecast.forecast(daily_cycle(spark, sf), HOURS, 96, 24)


TRAIN_HOURS = f"SELECT event_type, ts, value, idx, n - 96 AS n FROM ({FILLED_HOURS}) WHERE idx < n - 96"


@query(
    "forecast_backtest",
    f"SELECT t.event_type, 'value' AS signal, {ERRORS} FROM (SELECT t.event_type, t.value AS a, s.forecast AS p FROM ({FILLED_HOURS}) t JOIN ({decomposed(TRAIN_HOURS)}) s ON s.event_type = t.event_type AND s.idx = t.idx) t GROUP BY 1",
    "rmse mae smape mape", 4,
)
def _(spark, sf):
    return forecast.score(forecast.backtest(daily_cycle(spark, sf), HOURS, 96, 24), ["event_type", "signal"])


@query("residual_model", None, "rmse mae smape mape", 4)
def _(spark, sf):
    _, scored = workflows.fit_residual(complete_battery(spark, sf), SITE, hours=1.0, capacity=50.0)
    return scored.agg(*forecast_metrics("residual", "prediction"))


@query("feature_importance", None, "importance", 4)
def _(spark, sf):
    model, _ = workflows.fit_residual(complete_battery(spark, sf), SITE, hours=1.0, capacity=50.0)
    return learn.feature_importance(spark, model)


@query(
    "hybrid_correction",
    f"SELECT ts, soc, load_kw, coalesce(load_kw, 0.0) + CASE WHEN idx >= CAST(floor(0.8::DOUBLE * n) AS BIGINT) THEN soc / 10 ELSE 0 END AS soc_hybrid, idx >= CAST(floor(0.8::DOUBLE * n) AS BIGINT) AS corrected "
    f"FROM (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS n FROM ({HOURLY_SQL}))",
    "soc load_kw soc_hybrid",
)
def _(spark, sf):
    rows = hourly(spark, sf).select("ts", "soc", "load_kw", F.coalesce("load_kw", F.lit(0.0)).alias("physics"))
    late = ordered.time_split(rows, SITE).filter("split = 'validate'").select("ts", (F.col("soc") / 10).alias("prediction"))
    return learn.hybrid_correction(rows, late, ["ts"], physics="physics").drop("physics")


@query("ridge_fit", None, "intercept r2", 4)
def _(spark, sf):
    from tidewatt.catalog.energy import day_table
    from tidewatt.operators.energy import daily_ml_rows

    rows = daily_ml_rows(day_table(spark, sf)).withColumn("ts", F.col("date").cast("timestamp_ntz"))
    fit = learn.ridge_fit(rows, SITE, ["total_load_kwh", "total_renewable_prod_kwh", "battery_capacity_kwh"], "grid_import_kwh")
    return fit.withColumn("coef", F.to_json(F.transform("coef", lambda c: F.round(c, 4))))
