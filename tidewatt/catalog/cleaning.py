"""Anomaly flags and cleaning."""

from pyspark.sql import functions as F

from tidewatt.catalog.common import EVENTS, FAULTY_SQL, HOURLY_SQL, MEASURES, faulty, hourly, query, table
from tidewatt.catalog.timing import interpolation_sql
from tidewatt.operators import clean
from tidewatt.spec import SeriesSpec

PART = "PARTITION BY event_type ORDER BY ts, event_id"


def flags_sql(rows: str, value: str, keys: str) -> str:
    """SQL for sentinel, z-score (4) and IQR (3) flags of one column."""
    over = f"OVER (PARTITION BY {keys})" if keys else "OVER ()"
    known = f"CASE WHEN {value} <> -999999.0 THEN {value} END"
    return (
        "SELECT *, coalesce(abs(k - m) > 4 * s AND s > 0, false) AS z, coalesce(k < q1 - 3 * (q3 - q1) OR k > q3 + 3 * (q3 - q1), false) AS i, "
        f"coalesce({value} = -999999.0, false) AS sentinel FROM (SELECT *, avg(k) {over} AS m, stddev_pop(k) {over} AS s, "
        f"quantile_cont(k, 0.25) {over} AS q1, quantile_cont(k, 0.75) {over} AS q3 FROM (SELECT *, {known} AS k FROM ({rows})))"
    )


FLAGS = flags_sql(FAULTY_SQL, "value", "event_type")
NAMES = "event_id, ts, event_type, value"


@query("sentinel_flags", f"SELECT {NAMES}, sentinel AS value_sentinel FROM ({FLAGS})")
def _(spark, sf):
    return clean.sentinel_flags(faulty(spark, sf), ["value"])


def flag_query(hit: str) -> str:
    return f"SELECT {NAMES}, sentinel AS value_sentinel, {hit} AS value_statistical, sentinel OR ({hit}) AS value_flag FROM ({FLAGS})"


@query("zscore_flags", flag_query("z"))
def _(spark, sf):
    return clean.zscore_flags(faulty(spark, sf), EVENTS)


@query("iqr_flags", flag_query("i"))
def _(spark, sf):
    return clean.iqr_flags(faulty(spark, sf), EVENTS)


@query("combined_flags", flag_query("z AND i"))
def _(spark, sf):
    return clean.combined_flags(faulty(spark, sf), EVENTS)


@query(
    "flag_counts",
    "SELECT event_type, 'value' AS signal, count(CASE WHEN sentinel OR (z AND i) THEN 1 END) AS total_anomalies, "
    f"count(CASE WHEN sentinel THEN 1 END) AS sentinel_values, count(CASE WHEN z AND i THEN 1 END) AS statistical_anomalies FROM ({FLAGS}) GROUP BY 1",
)
def _(spark, sf):
    return clean.flag_counts(clean.combined_flags(faulty(spark, sf), EVENTS), EVENTS)


@query("clean_keep", FAULTY_SQL)
def _(spark, sf):
    return clean.clean(faulty(spark, sf), EVENTS, clean.KEEP)


REMOVED = f"SELECT event_id, ts, event_type, CASE WHEN NOT (sentinel OR (z AND i)) THEN value END AS value FROM ({FLAGS})"


@query("clean_remove", REMOVED)
def _(spark, sf):
    return clean.clean(faulty(spark, sf), EVENTS, clean.REMOVE)


def by_row(rows: str, value: str = "value", part: str = PART) -> str:
    return interpolation_sql(f"SELECT *, row_number() OVER ({part}) AS x FROM ({rows})", value, "x", part)


FILLED = f"SELECT {NAMES} FROM ({by_row(REMOVED)})"


@query("clean_extremes_interpolate", FILLED, "value")
def _(spark, sf):
    return clean.clean(faulty(spark, sf), EVENTS, clean.EXTREMES)


@query("clean_interpolate", FILLED, "value")
def _(spark, sf):
    return clean.clean(faulty(spark, sf), EVENTS, clean.INTERPOLATE)


ONCE = by_row(f"SELECT event_id, ts, event_type, k AS value, sentinel OR (z AND i) AS flag FROM ({FLAGS})")
TWICE = by_row(f"SELECT event_id, ts, event_type, CASE WHEN NOT flag THEN value END AS value FROM ({ONCE})")


@query("clean_sentinels_interpolate", f"SELECT {NAMES} FROM ({TWICE})", "value")
def _(spark, sf):
    return clean.clean(faulty(spark, sf), EVENTS, clean.SENTINELS)


@query(
    "cleaning_report",
    f"WITH f AS ({FLAGS}), c AS ({FILLED}) SELECT f.event_type, 'value' AS signal, "
    "avg(f.value) AS original_mean, stddev_samp(f.value) AS original_std, min(f.value) AS original_min, max(f.value) AS original_max, "
    "avg(c.value) AS cleaned_mean, stddev_samp(c.value) AS cleaned_std, min(c.value) AS cleaned_min, max(c.value) AS cleaned_max, "
    "count(CASE WHEN sentinel OR (z AND i) THEN 1 END) AS total_anomalies, count(CASE WHEN sentinel THEN 1 END) AS sentinel_values, "
    "count(CASE WHEN z AND i THEN 1 END) AS statistical_anomalies, 'remove_extremes_then_interpolate' AS cleaning_strategy "
    "FROM f JOIN c ON f.event_id = c.event_id GROUP BY 1",
    "original_mean original_std cleaned_mean cleaned_std cleaned_min cleaned_max",
)
def _(spark, sf):
    return clean.cleaning_report(faulty(spark, sf), EVENTS, {"value": clean.EXTREMES})


# A wide site table with faults, as one series over the whole table.
HOUR_NO = "CAST(epoch_us(ts) // 3600000000 AS BIGINT)"
WIDE_SQL = (
    f"SELECT ts, CASE WHEN n % 97 = 0 THEN -999999.0 WHEN n % 113 = 0 THEN load_kw * 40 ELSE load_kw END AS load_kw, "
    f"CASE WHEN n % 89 = 0 THEN -999999.0 WHEN n % 127 = 0 THEN solar_kw * 40 ELSE solar_kw END AS solar_kw, wind_kw FROM (SELECT *, {HOUR_NO} AS n FROM ({HOURLY_SQL}))"
)
PLAN = {"load_kw": clean.EXTREMES, "solar_kw": clean.SENTINELS, "wind_kw": clean.KEEP, "not_there": clean.EXTREMES}


def wide_clean(value: str, twice: bool) -> str:
    rows = f"SELECT ts, {value} FROM ({WIDE_SQL})"
    flagged = flags_sql(rows, value, "")
    if not twice:
        removed = f"SELECT ts, CASE WHEN NOT (sentinel OR (z AND i)) THEN {value} END AS {value} FROM ({flagged})"
        return by_row(removed, value, "ORDER BY ts")
    once = by_row(f"SELECT ts, k AS {value}, sentinel OR (z AND i) AS flag FROM ({flagged})", value, "ORDER BY ts")
    return by_row(f"SELECT ts, CASE WHEN NOT flag THEN {value} END AS {value} FROM ({once})", value, "ORDER BY ts")


@query(
    "clean_table",
    f"SELECT w.ts, l.load_kw, s.solar_kw, w.wind_kw FROM ({WIDE_SQL}) w JOIN ({wide_clean('load_kw', False)}) l ON l.ts = w.ts JOIN ({wide_clean('solar_kw', True)}) s ON s.ts = w.ts",
    "load_kw solar_kw wind_kw",
)
def _(spark, sf):
    n = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)

    def faults(name, sentinel, extreme):
        v = F.col(name)
        return F.when(n % sentinel == 0, -999999.0).when(n % extreme == 0, v * 40).otherwise(v).alias(name)

    rows = hourly(spark, sf).select("ts", faults("load_kw", 97, 113), faults("solar_kw", 89, 127), "wind_kw")
    return clean.clean_table(rows, SeriesSpec("ts"), PLAN)


def outlier_sql() -> str:
    limits = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(MEASURES))
    hit = [f"(abs({c} - m{i}) > 3 * s{i})" for i, c in enumerate(MEASURES)]
    rows = f"SELECT {', '.join(f'{h} AS h{i}' for i, h in enumerate(hit))}, {' OR '.join(hit)} AS a FROM lineitem CROSS JOIN (SELECT {limits} FROM lineitem)"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(CASE WHEN h{i} THEN 1 END) AS n_outliers, count(CASE WHEN a THEN 1 END) AS rows_with_outliers FROM ({rows})"
        for i, c in enumerate(MEASURES)
    )


@query("zscore_outlier_counts", outlier_sql())
def _(spark, sf):
    return clean.zscore_outlier_counts(table(spark, sf, "lineitem", *MEASURES), MEASURES)
