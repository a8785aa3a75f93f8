"""Parquet, JSON and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatt.functions.values import quoted
from tidewatt.operators.ordered import first_rows
from tidewatt.plans.sizing import broadcast_if_small
from tidewatt.session import freeze
from tidewatt.spec import SeriesSpec


# Rows of one file of a dated table.
ROWS_PER_FILE = 2_000_000


def placed_by_date(df: DataFrame, date: str = "date", rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Rows dealt so that a date of n rows lies in at most n / ``rows_per_file`` tasks, rounded up.

    Dates are counted first (partial sums). Large ones are cut by a hash of the row, small ones share
    tasks, and all move in one shuffle. Rows that are equal in every column stay together.
    """
    # Longer than any column of the table, so that no name clashes.
    mark = "_" * (1 + max(map(len, df.columns)))
    day, many, slot = f"{mark}day", f"{mark}many", f"{mark}slot"
    counts = freeze(df.groupBy(F.col(date).alias(day)).agg(F.ceil(F.count("*") / rows_per_file).alias(many)))
    row = F.xxhash64(*[quoted(c) for c, kind in df.dtypes if "map<" not in kind])
    dealt = df.join(broadcast_if_small(counts), F.col(date).eqNullSafe(F.col(day)))
    slices = counts.agg(F.sum(many)).first()[0] or 1
    parts = min(slices, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.withColumn(slot, F.pmod(row, F.col(many))).repartition(parts, date, slot)
    return dealt.select(*[quoted(c) for c in df.columns])


def sink_parquet(df: DataFrame, path: str, ts: str | None = None, mode: str = "errorifexists", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write Parquet; with ``ts`` one folder per date, so later time filters prune files.

    Dated tables have at most rows / ``rows_per_file`` + dates files when rows spread evenly over the
    slices of a date, whatever the number of tasks; a slice that comes out larger is cut at twice that size.
    """
    if ts is None:
        df.write.mode(mode).parquet(path)
    else:
        dated = placed_by_date(df.withColumn("date", F.to_date(ts)), rows_per_file=rows_per_file)
        dated.write.mode(mode).option("maxRecordsPerFile", 2 * rows_per_file).partitionBy("date").parquet(path)


def sink_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one JSON object per row; nested columns become nested objects."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def text_preview(df: DataFrame, spec: SeriesSpec, n: int = 25) -> DataFrame:
    """The first ``n`` values of each signal as numbered text lines, in a stable line order."""
    lines = first_rows(df, spec, n)
    value = F.coalesce(F.col("value").cast("string"), F.lit("nan"))
    return lines.select(
        *spec.keys,
        "signal",
        F.col("rn").alias("line_no"),
        F.concat(F.lpad(F.col("rn").cast("string"), 2, " "), F.lit(": "), value).alias("line"),
    )


def sink_text_preview(df: DataFrame, spec: SeriesSpec, path: str, n: int = 25, mode: str = "errorifexists") -> None:
    """Write the preview as text, with a heading per signal."""
    name = F.concat_ws(" ", *spec.keys, "signal")
    body = text_preview(df, spec, n).select(name.alias("_name"), F.col("line_no"), "line")
    title = body.select("_name").distinct()
    head = title.select("_name", F.lit(-1).alias("line_no"), F.concat(F.lit("Column: "), "_name").alias("line"))
    rule = title.select("_name", F.lit(0).alias("line_no"), F.expr("repeat('-', length(_name) + 8)").alias("line"))
    tail = title.select("_name", F.lit(n + 1).alias("line_no"), F.lit("").alias("line"))
    text = head.unionByName(rule).unionByName(body).unionByName(tail)
    text.orderBy("_name", "line_no").select(F.col("line").alias("value")).write.mode(mode).text(path)
