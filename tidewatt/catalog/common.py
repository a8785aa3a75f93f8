"""Input views shared by the registered queries, in Spark and as SQL text for the checker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatt.spec import SeriesSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounds: str = "", digits: int = 6):
    """Register a query; ``rounds`` lists the double columns rounded on both sides."""

    def register(build):
        columns = rounds.split()

        def run(spark, sf_dir):
            return rounded(build(spark, sf_dir), columns, digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = rounded_sql(sql, columns, digits)
        return build

    return register


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    """Round doubles so that summation order does not show; adding 0.0 removes a negative zero."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c in columns}) if columns else df


def rounded_sql(sql: str, columns, digits: int = 6) -> str:
    if not columns:
        return sql
    parts = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({parts}) FROM ({sql}) AS q"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


EVENTS = SeriesSpec("ts", ("event_type",), ("value",), ("event_id",))
ORDERS = SeriesSpec("o_orderdate", ("o_orderpriority",), ("o_totalprice",), ("o_orderkey",))
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HOURLY = SeriesSpec("ts", (), ("load_kw", "solar_kw", "wind_kw", "charge_kw", "discharge_kw", "soc"))

# The tables hold no faults, so queries and checks insert the same ones: sentinels, gaps, extremes.
FAULTY = (
    "CASE WHEN event_id % 97 = 0 THEN -999999.0 WHEN event_id % 41 = 0 THEN NULL "
    "WHEN event_id % 331 = 0 THEN value * 40 ELSE value END"
)
NO_SENTINEL = (
    "CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 41 = 0 THEN NULL "
    "WHEN event_id % 331 = 0 THEN value * 40 ELSE value END"
)
FAULTY_SQL = f"SELECT event_id, ts, event_type, CAST({FAULTY} AS DOUBLE) AS value FROM events"
GAPPY_SQL = f"SELECT event_id, ts, event_type, CAST({NO_SENTINEL} AS DOUBLE) AS value FROM events"


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")


def faulty(spark, sf_dir) -> DataFrame:
    """Events with sentinels, missing values and extremes."""
    return events(spark, sf_dir).withColumn("value", F.expr(FAULTY).cast("double"))


def gappy(spark, sf_dir) -> DataFrame:
    """Events with missing values and extremes, sentinels already removed."""
    from tidewatt.functions.values import sentinel_to_null

    return sentinel_to_null(faulty(spark, sf_dir), ["value"])


# Timestamps as text in two layouts, some of them unreadable.
RAW_TS_SQL = (
    "SELECT event_id, CASE WHEN event_id % 53 = 0 THEN 'not a time' WHEN event_id % 2 = 0 "
    "THEN strftime(ts, '%Y/%m/%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw_ts, event_type, value FROM events"
)
PARSED_SQL = "coalesce(try_strptime(raw_ts, '%Y/%m/%d %H:%M:%S'), try_strptime(raw_ts, '%Y-%m-%d %H:%M:%S'))"


def raw_times(spark, sf_dir) -> DataFrame:
    text = F.expr(
        "CASE WHEN event_id % 53 = 0 THEN 'not a time' WHEN event_id % 2 = 0 "
        "THEN date_format(ts, 'yyyy/MM/dd HH:mm:ss') ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END"
    )
    return events(spark, sf_dir).select("event_id", text.alias("raw_ts"), "event_type", "value")


SIGNAL_OF = {"load_kw": "view", "solar_kw": "click", "wind_kw": "purchase", "charge_kw": "signup", "discharge_kw": "error"}
HOURLY_SQL = (
    "SELECT date_trunc('hour', ts) AS ts, "
    + ", ".join(f"avg(CASE WHEN event_type = '{e}' THEN value END) AS {s}" for s, e in SIGNAL_OF.items())
    + ", avg((event_id * 37) % 101) AS soc FROM events GROUP BY 1"
)


def hourly(spark, sf_dir) -> DataFrame:
    """Site view: one row per hour, one column per signal, built with one aggregation."""
    return events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        *[F.avg(F.when(F.col("event_type") == e, F.col("value"))).alias(s) for s, e in SIGNAL_OF.items()],
        F.avg((F.col("event_id") * 37) % 101).alias("soc"),
    )


def order_by(keys: str = "event_type", order: str = "ts, event_id") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"{part}ORDER BY {order}"
