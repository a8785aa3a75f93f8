"""Buckets, profiles and ordered operators."""

from pyspark.sql import functions as F

from tidewatt.catalog.common import (
    EVENTS, FAULTY_SQL, GAPPY_SQL, HOURLY, HOURLY_SQL, ORDERS, events, faulty, gappy, hourly, query, table,
)
from tidewatt.operators import buckets, ordered, quality
from tidewatt.spec import SeriesSpec

BUCKET = "make_timestamp(epoch_us(ts) - epoch_us(ts) % {us})"
OVER = "OVER (PARTITION BY event_type ORDER BY ts, event_id)"
FRAME = "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query("bucket_mean", f"SELECT event_type, {BUCKET.format(us=900_000_000)} AS ts, avg(value) AS value FROM ({GAPPY_SQL}) GROUP BY 1, 2", "value")
def _(spark, sf):
    return buckets.bucket_mean(gappy(spark, sf), EVENTS, "15 minutes")


@query("bucket_mean_1000_minutes", f"SELECT event_type, {BUCKET.format(us=60_000_000_000)} AS ts, avg(value) AS value FROM ({GAPPY_SQL}) GROUP BY 1, 2", "value")
def _(spark, sf):
    return buckets.bucket_mean(gappy(spark, sf), EVENTS, "1000 minutes")


@query(
    "resample_mean",
    f"WITH b AS (SELECT event_type, date_trunc('hour', ts) AS h, avg(value) AS value FROM ({GAPPY_SQL}) GROUP BY 1, 2), "
    "g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h FROM (SELECT event_type, min(h) AS lo, max(h) AS hi FROM b GROUP BY 1)) "
    "SELECT g.event_type, g.h AS ts, b.value FROM g LEFT JOIN b ON b.event_type = g.event_type AND b.h = g.h",
    "value",
)
def _(spark, sf):
    return buckets.resample_mean(gappy(spark, sf), EVENTS, "1 hour")


@query("missing_fraction", f"SELECT date_trunc('week', ts)::TIMESTAMP AS period_start, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing_fraction FROM ({GAPPY_SQL}) GROUP BY 1", "missing_fraction")
def _(spark, sf):
    return buckets.missing_fraction(gappy(spark, sf), SeriesSpec("ts", (), ("value",)), "1 week")


@query("missing_fraction_daily", f"SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS period_start, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing_fraction FROM ({GAPPY_SQL}) GROUP BY 1, 2", "missing_fraction")
def _(spark, sf):
    return buckets.missing_fraction(gappy(spark, sf), EVENTS, "1 day")


GAP = f"(epoch_us(ts) - lag(epoch_us(ts)) {OVER}) / 1000000.0"
ALIAS = (
    "CASE WHEN s % 86400 = 0 THEN CAST(s // 86400 AS VARCHAR) || 'D' WHEN s % 3600 = 0 THEN CAST(s // 3600 AS VARCHAR) || 'H' "
    "WHEN s % 60 = 0 THEN CAST(s // 60 AS VARCHAR) || 'T' ELSE CAST(s AS VARCHAR) || 'S' END"
)


@query(
    "infer_step_median",
    f"SELECT event_type, m AS median_gap_sec, s AS step_seconds, {ALIAS} AS step_alias FROM (SELECT event_type, median(g) AS m, CAST(round_even(median(g), 0) AS BIGINT) AS s "
    f"FROM (SELECT event_type, {GAP} AS g FROM events) GROUP BY 1)",
    "median_gap_sec",
)
def _(spark, sf):
    return buckets.infer_step_median(events(spark, sf), EVENTS)


STEP = SeriesSpec("ts", ("event_type",), ("value",))


@query(
    "infer_step_mode",
    "WITH b AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2), "
    "g AS (SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 1000000.0 AS g FROM b), "
    "c AS (SELECT event_type, g, count(*) AS n FROM g WHERE g IS NOT NULL GROUP BY 1, 2), "
    "r AS (SELECT event_type, g, CAST(g AS BIGINT) AS s, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, g) AS k FROM c) "
    f"SELECT event_type, g AS step_seconds, g / 3600 AS step_hours, {ALIAS} AS step_alias FROM r WHERE k = 1",
    "step_seconds step_hours",
)
def _(spark, sf):
    return buckets.infer_step_mode(buckets.bucket_mean(events(spark, sf), EVENTS, "1 hour"), STEP)


@query(
    "adaptive_interval",
    "SELECT m AS median_gap_sec, CAST(CASE WHEN m IS NULL THEN 3600 WHEN m < 60 THEN 1000 * floor(m) ELSE 60000 END AS BIGINT) AS interval_seconds "
    "FROM (SELECT median(g) AS m FROM (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id)) / 1000000.0 AS g FROM events))",
    "median_gap_sec",
)
def _(spark, sf):
    return buckets.adaptive_interval(events(spark, sf), EVENTS)


@query("hourly_profile", f"SELECT event_type, hour(ts) AS hour, avg(value) AS value FROM ({GAPPY_SQL}) GROUP BY 1, 2", "value")
def _(spark, sf):
    return buckets.hourly_profile(gappy(spark, sf), EVENTS)


@query(
    "weekday_weekend_profile",
    f"SELECT event_type, CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, hour(ts) AS hour, avg(value) AS value FROM ({GAPPY_SQL}) GROUP BY 1, 2, 3",
    "value",
)
def _(spark, sf):
    return buckets.weekday_weekend_profile(gappy(spark, sf), EVENTS)


@query(
    "season_profile",
    "SELECT o_orderpriority, CASE WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'winter' END AS season, hour(o_orderdate) AS hour, avg(o_totalprice) AS o_totalprice "
    "FROM orders WHERE month(o_orderdate) IN (6, 7, 8, 12, 1, 2) GROUP BY 1, 2, 3",
    "o_totalprice", 4,
)
def _(spark, sf):
    return buckets.season_profile(table(spark, sf, "orders"), ORDERS)


HOURS = [f"h{h:02d}" for h in range(24)]


@query(
    "day_hour_heatmap",
    "SELECT event_type, CAST(ts AS DATE) AS date, " + ", ".join(f"avg(CASE WHEN hour(ts) = {i} THEN value END) AS {h}" for i, h in enumerate(HOURS))
    + f" FROM ({GAPPY_SQL}) WHERE value IS NOT NULL GROUP BY 1, 2",
    " ".join(HOURS),
)
def _(spark, sf):
    return buckets.day_hour_heatmap(gappy(spark, sf), EVENTS, "value")


@query(
    "run_per_month",
    "SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, 'o_totalprice' AS signal, min(o_totalprice) AS min, max(o_totalprice) AS max, "
    "avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std FROM orders GROUP BY 1, 2",
    "mean std", 4,
)
def _(spark, sf):
    return buckets.run_per_month(table(spark, sf, "orders"), ORDERS, quality.basic_stats)


@query("gap_minutes", f"SELECT event_id, ts, event_type, value, {GAP} / 60 AS gap_minutes FROM events", "gap_minutes", 9)
def _(spark, sf):
    return ordered.gap_minutes(events(spark, sf), EVENTS)


@query("find_gaps", f"SELECT * FROM (SELECT event_type, ts, event_id, {GAP} / 60 AS gap_minutes FROM events) WHERE gap_minutes > 15", "gap_minutes", 9)
def _(spark, sf):
    return ordered.find_gaps(events(spark, sf), EVENTS)


LAGGED = ("SELECT event_id, ts, event_type, value, " + ", ".join(f'lag(value, {k}) {OVER} AS "value_t-{k}"' for k in (1, 2, 96)) + f" FROM ({GAPPY_SQL})")
# Chunks far smaller than a series, to take the way of series too long for one task.
SMALL_CHUNK = 150


@query("lag_features", LAGGED)
def _(spark, sf):
    return ordered.lag_features(gappy(spark, sf), EVENTS)


@query("lag_features_chunked", LAGGED)
def _(spark, sf):
    return ordered.lag_features(gappy(spark, sf), EVENTS, rows_per_chunk=SMALL_CHUNK)


LONG_NAME = "concat(repeat('x', 60), lpad(CAST(event_id AS VARCHAR(12)), 12, '0'))"


@query(
    "lag_features_text_tie",
    'SELECT event_id, ts, event_type, value, lag(value, 1) OVER w AS "value_t-1", lag(value, 96) OVER w AS "value_t-96" '
    f"FROM (SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS ts, event_type, value, {LONG_NAME} AS name FROM ({GAPPY_SQL})) WINDOW w AS (PARTITION BY event_type ORDER BY ts, name)",
)
def _(spark, sf):
    rows = gappy(spark, sf).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz")).withColumn("name", F.expr(LONG_NAME))
    spec = SeriesSpec("ts", ("event_type",), ("value",), ("name",))
    return ordered.lag_features(rows, spec, (1, 96), rows_per_chunk=SMALL_CHUNK).drop("name")


def full(fn: str, w: int) -> str:
    frame = FRAME.format(w - 1)
    return f"CASE WHEN count(value) {frame} = {w} THEN {fn}(value) {frame} END"


@query(
    "rolling_full",
    "SELECT event_id, ts, event_type, value, " + ", ".join(f"{full('avg', w)} AS valueroll_mean{w}, {full('stddev_samp', w)} AS valueroll_std{w}" for w in (4, 8, 96)) + " FROM events",
    " ".join(f"valueroll_{s}{w}" for s in ("mean", "std") for w in (4, 8, 96)), 7,
)
def _(spark, sf):
    return ordered.rolling_full(events(spark, sf), EVENTS)


@query(
    "rolling_partial_mean",
    "SELECT event_id, ts, event_type, value, " + ", ".join(f"avg(value) {FRAME.format(w - 1)} AS value_roll_{w}" for w in (3, 6, 24)) + f" FROM ({GAPPY_SQL})",
    "value_roll_3 value_roll_6 value_roll_24",
)
def _(spark, sf):
    return ordered.rolling_partial_mean(gappy(spark, sf), EVENTS)


@query(
    "rolling_variance_stability",
    "SELECT event_type, 'value' AS signal, median(v) AS rolling_variance_median, CASE WHEN quantile_cont(v, 0.25) > 0 THEN quantile_cont(v, 0.75) / quantile_cont(v, 0.25) END AS variance_q75_q25_ratio "
    f"FROM (SELECT event_type, var_samp(value) {FRAME.format(23)} AS v FROM (SELECT * FROM ({GAPPY_SQL}) WHERE value IS NOT NULL)) GROUP BY 1",
    "rolling_variance_median variance_q75_q25_ratio",
)
def _(spark, sf):
    return ordered.rolling_variance_stability(gappy(spark, sf), EVENTS)


@query(
    "rolling_corr",
    f"WITH h AS ({HOURLY_SQL}) SELECT ts, CASE WHEN regr_count(solar_kw, load_kw) OVER w >= 24 THEN corr(load_kw, solar_kw) OVER w END AS rolling_corr FROM h "
    "WINDOW w AS (ORDER BY ts ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)",
    "rolling_corr",
)
def _(spark, sf):
    return ordered.rolling_corr(hourly(spark, sf), HOURLY.with_signals("load_kw", "solar_kw"), 48)


STDS = [f"valueroll_std{w}" for w in (4, 8, 96)]


@query(
    "rolling_full_faulty",
    "SELECT event_id, ts, event_type, value, " + ", ".join(f"{full('avg', w)} AS valueroll_mean{w}, round({full('stddev_samp', w)}, 3) AS valueroll_std{w}" for w in (4, 8, 96)) + f" FROM ({FAULTY_SQL})",
    "valueroll_mean4 valueroll_mean8 valueroll_mean96", 7,
)
def _(spark, sf):
    rolled = ordered.rolling_full(faulty(spark, sf), EVENTS)
    # Deviations of windows with a sentinel are near a million: three digits are what doubles hold safely.
    return rolled.withColumns({c: F.round(c, 3) for c in STDS})


SENTINEL_HOURS = "CASE WHEN hour(ts) = 13 AND day(ts) % 5 = 0 THEN -999999.0 ELSE load_kw END"


@query(
    "rolling_corr_faulty",
    f"WITH h AS (SELECT ts, CAST({SENTINEL_HOURS} AS DOUBLE) AS load_kw, solar_kw FROM ({HOURLY_SQL})) "
    "SELECT ts, CASE WHEN regr_count(solar_kw, load_kw) OVER w >= 24 THEN corr(load_kw, solar_kw) OVER w END AS rolling_corr FROM h "
    "WINDOW w AS (ORDER BY ts ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)",
    "rolling_corr",
)
def _(spark, sf):
    rows = hourly(spark, sf).withColumn("load_kw", F.expr(SENTINEL_HOURS).cast("double"))
    return ordered.rolling_corr(rows, HOURLY.with_signals("load_kw", "solar_kw"), 48)


def interpolation_sql(rows: str, value: str, x: str, over: str) -> str:
    """SQL for linear interpolation of one column along x inside an ordered partition."""
    back = f"{over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    ahead = f"{over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return (
        f"SELECT * EXCLUDE (pv, px, nv, nx, {value}), CASE WHEN {value} IS NOT NULL THEN {value} WHEN pv IS NULL THEN NULL WHEN nv IS NULL OR nx = px THEN pv "
        f"ELSE pv + (nv - pv) * ({x} - px) / (nx - px) END AS {value} FROM (SELECT *, "
        f"last_value({value} IGNORE NULLS) OVER ({back}) AS pv, last_value(CASE WHEN {value} IS NOT NULL THEN {x} END IGNORE NULLS) OVER ({back}) AS px, "
        f"first_value({value} IGNORE NULLS) OVER ({ahead}) AS nv, first_value(CASE WHEN {value} IS NOT NULL THEN {x} END IGNORE NULLS) OVER ({ahead}) AS nx FROM ({rows}))"
    )


PART = "PARTITION BY event_type ORDER BY ts, event_id"
NUMBERED_SQL = f"SELECT *, row_number() OVER ({PART}) AS x FROM ({GAPPY_SQL})"
TIMED_SQL = f"SELECT *, epoch_us(ts) AS x FROM ({GAPPY_SQL})"


@query("interpolate_linear", f"SELECT event_id, ts, event_type, value FROM ({interpolation_sql(NUMBERED_SQL, 'value', 'x', PART)})", "value")
def _(spark, sf):
    return ordered.interpolate(gappy(spark, sf), EVENTS, "row")


@query("interpolate_chunked", f"SELECT event_id, ts, event_type, value FROM ({interpolation_sql(NUMBERED_SQL, 'value', 'x', PART)})", "value")
def _(spark, sf):
    return ordered.interpolate(gappy(spark, sf), EVENTS, "row", rows_per_chunk=SMALL_CHUNK)


@query("interpolate_time", f"SELECT event_id, ts, event_type, value FROM ({interpolation_sql(TIMED_SQL, 'value', 'x', PART)})", "value")
def _(spark, sf):
    return ordered.interpolate(gappy(spark, sf), EVENTS, "time")


@query(
    "fill_backward_forward",
    f"SELECT event_id, ts, event_type, coalesce(first_value(value IGNORE NULLS) OVER ({PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
    f"last_value(value IGNORE NULLS) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value FROM ({GAPPY_SQL})",
)
def _(spark, sf):
    return ordered.fill_backward_forward(gappy(spark, sf), EVENTS)


@query("lag_difference", f"SELECT event_id, ts, event_type, value, value - lag(value, 2) {OVER} AS value_diff2 FROM ({GAPPY_SQL})", "value_diff2")
def _(spark, sf):
    return ordered.lag_difference(gappy(spark, sf), EVENTS, 2)


PLACED = "(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query("time_split", f"SELECT event_id, ts, event_type, value, idx, CASE WHEN idx < CAST(floor(0.8::DOUBLE * n) AS BIGINT) THEN 'train' ELSE 'validate' END AS split FROM {PLACED}")
def _(spark, sf):
    return ordered.time_split(events(spark, sf), EVENTS)


@query("holdout_last", f"SELECT event_id, ts, event_type, value, idx, CASE WHEN idx >= n - 96 THEN 'test' ELSE 'train' END AS split FROM {PLACED}")
def _(spark, sf):
    return ordered.holdout_last(events(spark, sf), EVENTS)


@query(
    "first_value_per_group",
    f"SELECT event_type, date, value FROM (SELECT *, CAST(ts AS DATE) AS date, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM ({FAULTY_SQL})) WHERE k = 1",
)
def _(spark, sf):
    rows = faulty(spark, sf).withColumn("date", F.to_date("ts"))
    return ordered.first_value_per_group(rows, EVENTS.with_keys("date"))
