"""Quality aggregates, summaries and distributions."""

from pyspark.sql import functions as F

from tidewatt.catalog.common import (
    EVENTS, FAULTY, FAULTY_SQL, GAPPY_SQL, MEASURES, ORDERS, RAW_TS_SQL, PARSED_SQL, events, faulty, gappy, query, raw_times, table,
)
from tidewatt.operators import distributions, ordered, quality


@query(
    "null_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count FROM ({FAULTY_SQL})" for c in ("event_id", "ts", "event_type", "value")),
)
def _(spark, sf):
    return quality.null_counts(faulty(spark, sf))


ISSUES = f"(SELECT event_id, raw_ts, CASE WHEN event_id % 61 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 67 = 0 THEN NULL ELSE value END AS value FROM ({RAW_TS_SQL}))"


@query(
    "column_issues",
    f"SELECT 'event_id' AS \"column\", 'bigint' AS dtype, count(*) - count(event_id) AS null_count, 0 AS inf_count, 0 AS datetime_parse_errors FROM {ISSUES} "
    f"UNION ALL SELECT 'raw_ts', 'string', count(*) - count(raw_ts), 0, count(*) - count({PARSED_SQL}) FROM {ISSUES} "
    f"UNION ALL SELECT 'value', 'double', count(*) - count(value), count(CASE WHEN isinf(value) THEN 1 END), 0 FROM {ISSUES}",
)
def _(spark, sf):
    odd = F.when(F.col("event_id") % 61 == 0, float("inf")).when(F.col("event_id") % 67 == 0, None).otherwise(F.col("value"))
    return quality.column_issues(raw_times(spark, sf).select("event_id", "raw_ts", odd.alias("value")), ts="raw_ts")


@query(
    "dataset_summary",
    "SELECT count(*) AS n_rows, 6 AS n_columns, count(*) * 6 AS total_cells, min(ts) AS first_ts, max(ts) AS last_ts, "
    "'event_id,ts,user_id,event_type,value,props' AS columns FROM events",
)
def _(spark, sf):
    return quality.dataset_summary(table(spark, sf, "events"), "ts")


@query("file_size")
def _(spark, sf):
    return quality.file_size_mb(table(spark, sf, "events"))


@query(
    "missing_percent",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 100 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS missing_pct FROM ({FAULTY_SQL})" for c in ("ts", "value")),
    "missing_pct",
)
def _(spark, sf):
    return quality.missing_percent(faulty(spark, sf), ["ts", "value"])


@query(
    "basic_stats",
    f"SELECT event_type, 'value' AS signal, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std FROM ({FAULTY_SQL}) GROUP BY 1",
    "mean std",
)
def _(spark, sf):
    return quality.basic_stats(faulty(spark, sf), EVENTS)


DESCRIBE = (
    "SELECT event_type, 'value' AS signal, count(value) AS count, count(*) - count(value) AS null_count, avg(value) AS mean, "
    "stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, "
    f"quantile_cont(value, 0.75) AS q75, max(value) AS max FROM ({GAPPY_SQL}) GROUP BY 1"
)


@query("describe", DESCRIBE, "mean std q25 q50 q75")
def _(spark, sf):
    return quality.describe(gappy(spark, sf), EVENTS)


# The way of groups too large for one task, with a chunk far smaller than a group.
@query("describe_ranked", DESCRIBE, "mean std q25 q50 q75")
def _(spark, sf):
    return quality.describe(gappy(spark, sf), EVENTS, rows_per_chunk=100)


@query("duplicate_timestamps", "SELECT o_orderpriority, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return quality.duplicate_timestamps(table(spark, sf, "orders", "o_orderpriority", "o_orderdate"), ORDERS)


TWICE = "(SELECT event_id, ts, event_type, value FROM events UNION ALL SELECT event_id, ts, event_type, value FROM events WHERE event_id % 100 = 0)"


@query("duplicate_rows", f"SELECT event_id, ts, event_type, value FROM (SELECT *, count(*) OVER (PARTITION BY event_id, ts, event_type, value) AS n FROM {TWICE}) WHERE n > 1")
def _(spark, sf):
    rows = events(spark, sf)
    return quality.duplicate_rows(rows.unionByName(rows.filter("event_id % 100 = 0")))


@query(
    "value_counts",
    "SELECT 'l_returnflag' AS \"column\", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL "
    "SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2",
)
def _(spark, sf):
    return quality.value_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("sample_rows", "SELECT event_id, event_type, value FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 2000")
def _(spark, sf):
    return quality.sample_rows(table(spark, sf, "events", "event_id", "event_type", "value"), ["event_id"], 2000)


@query(
    "systematic_sample",
    "SELECT event_id, ts, event_type, value, idx FROM (SELECT event_id, ts, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, "
    "count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE idx % greatest(1, n // 100) = 0",
)
def _(spark, sf):
    return ordered.systematic_sample(events(spark, sf), EVENTS, 100)


@query(
    "variance_rank",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", var_samp({c}) AS variance FROM lineitem" for c in MEASURES) + ") ORDER BY variance DESC LIMIT 3",
    "variance", 4,
)
def _(spark, sf):
    return quality.variance_rank(table(spark, sf, "lineitem"), MEASURES, 3)


@query(
    "extremes_with_time",
    "SELECT event_type, 'value' AS signal, sum(s) AS total, avg(m) AS mean_hourly, max(hi) AS max_value, "
    "min(CASE WHEN hi = top THEN thi END) AS time_of_max, min(lo) AS min_value, min(CASE WHEN lo = bottom THEN tlo END) AS time_of_min "
    "FROM (SELECT *, max(hi) OVER (PARTITION BY event_type) AS top, min(lo) OVER (PARTITION BY event_type) AS bottom FROM ("
    "SELECT event_type, date_trunc('hour', ts) AS h, sum(value) AS s, avg(value) AS m, max(value) AS hi, min(value) AS lo, "
    "min(CASE WHEN value = mx THEN ts END) AS thi, min(CASE WHEN value = mn THEN ts END) AS tlo FROM ("
    "SELECT *, max(value) OVER (PARTITION BY event_type) AS mx, min(value) OVER (PARTITION BY event_type) AS mn FROM events) GROUP BY 1, 2)) GROUP BY 1",
    "total mean_hourly",
)
def _(spark, sf):
    return quality.extremes_with_time(events(spark, sf), EVENTS)


@query("distinct_dates", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders ORDER BY 1 LIMIT 30")
def _(spark, sf):
    return quality.distinct_dates(table(spark, sf, "orders", "o_orderdate"), "o_orderdate", 30)


@query(
    "histogram",
    "WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), "
    "b AS (SELECT v.event_type, least(39, CAST(floor((value - lo) / (hi - lo) * 40) AS BIGINT)) AS bin, count(*) AS n FROM events v JOIN e USING (event_type) GROUP BY 1, 2) "
    "SELECT e.event_type, 'value' AS signal, g.bin, lo + g.bin * ((hi - lo) / 40) AS bin_start, coalesce(n, 0) AS n "
    "FROM e CROSS JOIN (SELECT unnest(range(40)) AS bin) g LEFT JOIN b ON b.event_type = e.event_type AND b.bin = g.bin",
    "bin_start",
)
def _(spark, sf):
    return distributions.histogram(events(spark, sf), EVENTS, 40)


@query(
    "clip_percentiles",
    f"WITH g AS ({GAPPY_SQL}), q AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM g GROUP BY 1) "
    "SELECT event_id, g.event_type, CASE WHEN value IS NOT NULL THEN least(greatest(value, lo), hi) END AS value FROM g JOIN q USING (event_type)",
    "value",
)
def _(spark, sf):
    return distributions.clip_percentiles(gappy(spark, sf).select("event_id", "event_type", "value"), EVENTS)


@query(
    "box_stats",
    f"WITH g AS ({GAPPY_SQL}), q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM g GROUP BY 1) "
    "SELECT g.event_type, 'value' AS signal, min(q1) AS q1, min(median) AS median, min(q3) AS q3, "
    "min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_low, "
    "max(CASE WHEN value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_high, "
    "count(CASE WHEN NOT (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) THEN 1 END) AS n_outliers FROM g JOIN q USING (event_type) GROUP BY 1",
    "q1 median q3 whisker_low whisker_high",
)
def _(spark, sf):
    return distributions.box_stats(gappy(spark, sf), EVENTS)


NORMAL = ", ".join(f"({p!r}::DOUBLE, {z!r}::DOUBLE)" for p, z in distributions.normal_quantiles(99))


@query(
    "qq_points",
    f"WITH t(p, normal_q) AS (VALUES {NORMAL}), i AS (SELECT *, row_number() OVER (ORDER BY p) AS i FROM t), "
    f"g AS ({GAPPY_SQL}), s AS (SELECT event_type, unnest(quantile_cont(value, [{', '.join(repr(p) for p, _ in distributions.normal_quantiles(99))}])) AS sample_q, "
    "unnest(range(1, 100)) AS i FROM g GROUP BY 1), "
    "j AS (SELECT event_type, p, normal_q, sample_q FROM s JOIN i USING (i)) "
    "SELECT event_type, 'value' AS signal, p, normal_q, sample_q, regr_slope(sample_q, normal_q) OVER (PARTITION BY event_type) AS slope, "
    "regr_intercept(sample_q, normal_q) OVER (PARTITION BY event_type) AS intercept FROM j",
    "p normal_q sample_q slope intercept",
)
def _(spark, sf):
    return distributions.qq_points(gappy(spark, sf), EVENTS)


@query(
    "pair_sample",
    f"SELECT event_id, value, user_id FROM (SELECT event_id, user_id, CAST({FAULTY} AS DOUBLE) AS value FROM events) WHERE value IS NOT NULL ORDER BY md5('42:' || event_id), event_id LIMIT 2000",
)
def _(spark, sf):
    rows = table(spark, sf, "events", "event_id", "user_id", "value").withColumn("value", F.expr(FAULTY).cast("double"))
    return distributions.pair_sample(rows, ["value", "user_id"], ["event_id"], 2000)
