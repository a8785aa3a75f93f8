"""Parquet and CSV sources, header checks, conserving merge, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatt.plans.order import BASE, END, chunked
from tidewatt.plans.sizing import ROWS_PER_CHUNK
from tidewatt.spec import SeriesSpec


def scan_parquet(spark: SparkSession, path, columns=None) -> DataFrame:
    """Lazy scan; only the named columns are read, and later filters reach the files."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, paths, schema=None) -> DataFrame:
    """CSV files with a header line. A given schema avoids the extra inference pass."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(paths)


def check_headers(spark: SparkSession, paths, sep: str = ",") -> DataFrame:
    """Per file: its column list, the list of the first file by path, and whether they agree.

    The first line of a file is the first row of the split that starts at byte 0, so only
    first splits are looked at and each keeps one line.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_at"),
        "value",
        F.monotonically_increasing_id().alias("_row"),
    )
    first = lines.filter("_at = 0").groupBy("file").agg(F.min_by("value", "_row").alias("_line"))
    cells = F.transform(F.split("_line", F.lit(f"\\Q{sep}\\E")), lambda c: F.trim(F.btrim(c, F.lit('"'))))
    found = first.select("file", cells.alias("found"))
    base = found.agg(F.min_by("found", "file").alias("expected"))
    return found.crossJoin(F.broadcast(base)).select(
        "file", "expected", "found", (F.col("expected") == F.col("found")).alias("matches")
    )


def file_counts(df: DataFrame) -> DataFrame:
    """Rows per source file of a file-backed frame."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_rows"))


def merge_files(spark: SparkSession, paths, schema=None, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Stack files vertically; returns the merged frame and its conservation report.

    The files must share names and types: with ``check`` a header that differs from the
    first file's raises. The report holds one row per file with the rows it contributed, the
    lines that the files hold besides their header and blank ones (counted as plain text, so that
    a lost row shows), and the rows of the merged frame.
    """
    if check:
        wrong = check_headers(spark, paths).filter("NOT matches").select("file").limit(5).collect()
        if wrong:
            raise ValueError(f"column lists differ from the first file: {[r['file'] for r in wrong]}")
    merged = scan_csv(spark, paths, schema)
    counts = file_counts(merged)
    lines = spark.read.text(paths).filter(F.trim("value") != "").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("_lines"))
    total = lines.agg(F.sum(F.col("_lines") - 1).alias("expected_rows"))
    actual = merged.agg(F.count("*").alias("actual_rows"))
    report = counts.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(actual))
    return merged, report.withColumn("rows_kept", F.col("expected_rows") == F.col("actual_rows"))


def page(df: DataFrame, order, start: int = 0, size: int = 10_000) -> DataFrame:
    """Rows ``start`` to ``start + size`` in a total order; the end is clamped to the table.

    ``order`` must be a total order whose first column has no nulls.
    Early pages are a top-n. For later ones the table is cut into counted cells along the
    order, and only chunks that reach into the page are sorted.
    """
    order = list(order)
    if start + size <= ROWS_PER_CHUNK:
        return df.orderBy(*order).offset(start).limit(size)
    spec = SeriesSpec(order[0], (), (), tuple(order[1:]))
    parts = chunked(df, spec)
    frame = parts.frame
    if parts.split:
        frame = frame.filter((F.col(BASE) < start + size) & (F.col(END) > start))
    numbered = parts.trim(frame.withColumn("_at", parts.position))
    return numbered.filter((F.col("_at") >= start) & (F.col("_at") < start + size)).orderBy(*order).drop("_at")
