"""Sources, sinks, timestamps and missing values."""

from pyspark.sql import functions as F

from tidewatt.catalog.common import (
    EVENTS, FAULTY_SQL, GAPPY_SQL, PARSED_SQL, RAW_TS_SQL, events, faulty, gappy, query, raw_times, table,
)
from tidewatt.functions import values
from tidewatt.functions.timestamps import parse_inferred, parse_timestamp
from tidewatt.operators import quality
from tidewatt.session import scratch_path
from tidewatt import sources

EVENT_CSV = "event_id BIGINT, ts TIMESTAMP_NTZ, event_type STRING, value DOUBLE"


@query("scan_parquet", "SELECT event_id, event_type, value FROM events")
def _(spark, sf):
    return sources.scan_parquet(spark, f"{sf}/events.parquet", ["event_id", "event_type", "value"])


@query("scan_parquet_pushdown", "SELECT event_id, event_type, value FROM events WHERE value > 50")
def _(spark, sf):
    return sources.scan_parquet(spark, f"{sf}/events.parquet", ["event_id", "event_type", "value"]).filter("value > 50")


def event_files(spark, sf, shuffled_last=False):
    """The events as three CSV folders."""
    base = scratch_path(spark, "csv")
    rows = events(spark, sf)
    for part in range(3):
        piece = rows.filter(F.col("event_id") % 3 == part)
        if shuffled_last and part == 2:
            piece = piece.select("event_id", "value", "ts", "event_type")
        piece.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(f"{base}/part{part}")
    return [f"{base}/part{part}" for part in range(3)]


@query(
    "scan_csv",
    "SELECT event_type, count(*) AS n, max(ts) AS last_ts, sum(value) AS total FROM events GROUP BY 1",
    "total", 4,
)
def _(spark, sf):
    rows = sources.scan_csv(spark, event_files(spark, sf), EVENT_CSV)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.sum("value").alias("total"))


@query(
    "check_headers",
    "SELECT * FROM (VALUES ('part0', true, 'event_id,ts,event_type,value'), ('part1', true, 'event_id,ts,event_type,value'), "
    "('part2', false, 'event_id,value,ts,event_type')) t(part, matches, found)",
)
def _(spark, sf):
    report = sources.check_headers(spark, event_files(spark, sf, shuffled_last=True))
    label = F.regexp_extract("file", r"/(part\d)/", 1).alias("part")
    return report.select(label, "matches", F.concat_ws(",", "found").alias("found")).distinct()


@query(
    "merge_files",
    "SELECT concat('part', event_id % 3) AS part, count(*) AS n_rows, (SELECT count(*) FROM events) AS expected_rows, "
    "(SELECT count(*) FROM events) AS actual_rows, true AS rows_kept FROM events GROUP BY 1",
)
def _(spark, sf):
    _, report = sources.merge_files(spark, event_files(spark, sf), EVENT_CSV)
    label = F.regexp_extract("file", r"/(part\d)/", 1).alias("part")
    return report.groupBy(label, "expected_rows", "actual_rows", "rows_kept").agg(F.sum("n_rows").alias("n_rows"))


@query("sink_parquet", "SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "parquet")
    sources.sink_parquet(events(spark, sf), path, ts="ts")
    return spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("n"))


@query(
    "sink_json",
    f"SELECT event_type, count(*) AS n_rows, count(*) - count(value) AS nulls, max(value) AS largest FROM ({FAULTY_SQL}) GROUP BY 1",
)
def _(spark, sf):
    path = scratch_path(spark, "json")
    counts = F.struct(F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("nulls"))
    sources.sink_json(faulty(spark, sf).groupBy("event_type").agg(counts.alias("counts"), F.max("value").alias("largest")), path)
    back = spark.read.schema("event_type STRING, counts STRUCT<n_rows: BIGINT, nulls: BIGINT>, largest DOUBLE").json(path)
    return back.select("event_type", "counts.n_rows", "counts.nulls", "largest")


@query(
    "sink_text_preview",
    "SELECT event_type, 'value' AS signal, line_no, lpad(CAST(line_no AS VARCHAR), 2, ' ') || ': ' || "
    "coalesce(CAST(value AS VARCHAR), 'nan') AS line FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) "
    f"AS line_no FROM ({FAULTY_SQL})) WHERE line_no <= 25",
)
def _(spark, sf):
    path = scratch_path(spark, "preview")
    sources.sink_text_preview(faulty(spark, sf), EVENTS, path, 25)
    written = spark.read.text(path).filter("value LIKE '%: %' AND value NOT LIKE 'Column: %'").groupBy("value").agg(F.count("*").alias("times"))
    lines = sources.text_preview(faulty(spark, sf), EVENTS, 25)
    # Each line stands in the written file; equal lines of different signals are told apart by the plan.
    return lines.join(written, lines["line"] == written["value"], "left_semi")


@query("page", "SELECT event_id, ts, event_type, value FROM events ORDER BY ts, event_id LIMIT 100 OFFSET 500")
def _(spark, sf):
    return sources.page(events(spark, sf), ["ts", "event_id"], 500, 100)


@query("parse_timestamp", f"SELECT event_id, raw_ts, {PARSED_SQL} AS ts FROM ({RAW_TS_SQL})")
def _(spark, sf):
    return raw_times(spark, sf).select("event_id", "raw_ts", parse_timestamp("raw_ts").alias("ts"))


# Three layouts in one column; days up to 12 could be months, later days tell.
ODD_LAYOUTS = {0: ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"), 1: ("dd/MM/yyyy HH:mm:ss", "%d/%m/%Y %H:%M:%S"), 2: ("yyyy/MM/dd HH:mm", "%Y/%m/%d %H:%M")}


def odd_texts(fn: str, side: int) -> str:
    return "CASE " + " ".join(f"WHEN event_id % 53 = 0 THEN 'not a time' WHEN event_id % 3 = {k} THEN {fn}(ts, {chr(34 if side == 0 else 39)}{v[side]}{chr(34 if side == 0 else 39)})" for k, v in ODD_LAYOUTS.items()) + " END"


@query(
    "parse_timestamp_inferred",
    "SELECT event_id, raw_ts, coalesce(" + ", ".join(f"try_strptime(raw_ts, '{v[1]}')" for v in ODD_LAYOUTS.values()) + f") AS ts FROM (SELECT event_id, {odd_texts('strftime', 1)} AS raw_ts FROM events)",
)
def _(spark, sf):
    rows = events(spark, sf).select("event_id", F.expr(odd_texts("date_format", 0)).alias("raw_ts"))
    return parse_inferred(rows, "raw_ts", "ts").select("event_id", "raw_ts", "ts")


@query("drop_invalid_timestamps", f"SELECT event_id, {PARSED_SQL} AS raw_ts, value FROM ({RAW_TS_SQL}) WHERE {PARSED_SQL} IS NOT NULL")
def _(spark, sf):
    return quality.drop_invalid_timestamps(raw_times(spark, sf).select("event_id", "raw_ts", "value"), "raw_ts")


@query(
    "timestamp_report",
    f"SELECT count(*) AS n_rows, count({PARSED_SQL}) AS kept, count(*) - count({PARSED_SQL}) AS removed FROM ({RAW_TS_SQL})",
)
def _(spark, sf):
    return quality.timestamp_report(raw_times(spark, sf), "raw_ts")


@query("invalid_timestamps", f"SELECT raw_ts FROM ({RAW_TS_SQL}) WHERE raw_ts IS NOT NULL AND {PARSED_SQL} IS NULL")
def _(spark, sf):
    return quality.invalid_timestamps(raw_times(spark, sf), "raw_ts")


@query("lowercase_columns", "SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1")
def _(spark, sf):
    upper = events(spark, sf).toDF("Event_ID", "TimeStamp", "EVENT_TYPE", "Value")
    return values.lowercase_columns(upper).groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("project_available", "SELECT event_id, value FROM events")
def _(spark, sf):
    return values.project_available(table(spark, sf, "events"), ["event_id", "value", "no_such_signal"])


@query("require", "SELECT ts, value FROM events")
def _(spark, sf):
    return values.require(table(spark, sf, "events"), ["ts", "value"])


MIXED = "CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE CAST(value AS {}) END"


@query("coerce_numeric", f"SELECT event_id, TRY_CAST({MIXED.format('VARCHAR')} AS DOUBLE) AS reading FROM events")
def _(spark, sf):
    text = events(spark, sf).select("event_id", F.expr(MIXED.format("STRING")).alias("reading"))
    return values.coerce_numeric(text, ["reading"])


@query("sentinel_to_null", f"SELECT event_id, value FROM ({GAPPY_SQL})")
def _(spark, sf):
    return values.sentinel_to_null(faulty(spark, sf).select("event_id", "value"), ["value"])


@query("sentinel_to_null_at_or_below", f"SELECT event_id, CASE WHEN value <= -999999 THEN NULL ELSE value END AS value FROM ({FAULTY_SQL})")
def _(spark, sf):
    return values.sentinel_to_null(faulty(spark, sf).select("event_id", "value"), ["value"], at_or_below=-999999.0)


@query("nan_to_null", "SELECT event_id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE value END AS value FROM events")
def _(spark, sf):
    nan = F.when(F.col("event_id") % 29 == 0, float("nan")).otherwise(F.col("value"))
    return values.nan_to_null(events(spark, sf).select("event_id", nan.alias("value")), ["value"])


@query("drop_null_rows", f"SELECT event_id, value FROM ({GAPPY_SQL}) WHERE value IS NOT NULL")
def _(spark, sf):
    return values.drop_null_rows(gappy(spark, sf).select("event_id", "value"), ["value"])


@query("fill_null", f"SELECT event_id, coalesce(value, 0.0) AS value FROM ({GAPPY_SQL})")
def _(spark, sf):
    return values.fill_null(gappy(spark, sf).select("event_id", "value"), ["value"])


@query("add_missing_columns", "SELECT event_id, value, CAST(NULL AS DOUBLE) AS temperature FROM events")
def _(spark, sf):
    return values.add_missing_columns(events(spark, sf).select("event_id", "value"), ["value", "temperature"])


@query("clip_negative", f"SELECT event_id, CASE WHEN value < 0 THEN 0.0 ELSE value END AS value FROM (SELECT event_id, value - 50 AS value FROM ({GAPPY_SQL}))", "value")
def _(spark, sf):
    shifted = gappy(spark, sf).select("event_id", (F.col("value") - 50).alias("value"))
    return values.clip_negative(shifted, ["value"])
