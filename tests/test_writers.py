"""Files of a dated table: few, bounded in rows, and with every row."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewatt.sources import sink_parquet


@pytest.fixture(scope="module")
def many_days(spark):
    """400 days in 32 tasks; a third of all rows on one day, some without a time."""
    day = F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(400)))
    ts = F.when(F.col("id") % 1001 != 0, F.timestamp_seconds(day * 86_400 + F.col("id") % 86_400)).cast("timestamp_ntz")
    return spark.range(0, 40_000, 1, 32).select(ts.alias("ts"), F.col("id").alias("a b"), (F.col("id") % 5).alias("_date"))


def test_files_follow_rows_and_dates(spark, many_days, tmp_path):
    path = str(tmp_path / "out")
    sink_parquet(many_days, path, "ts", rows_per_file=1000)
    sizes = [pq.read_metadata(f).num_rows for f in glob.glob(f"{path}/*/*.parquet")]
    assert sum(sizes) == 40_000 and len(sizes) <= 40_000 / 1000 + 401 and max(sizes) <= 2000
    back = spark.read.parquet(path)
    assert back.drop("date").exceptAll(many_days).isEmpty() and many_days.exceptAll(back.drop("date")).isEmpty()
    assert back.filter("date IS DISTINCT FROM to_date(ts)").isEmpty()


def test_one_file_a_small_date(many_days, tmp_path):
    path = str(tmp_path / "out")
    sink_parquet(many_days, path, "ts")
    assert len(glob.glob(f"{path}/*/*.parquet")) == 401


def test_empty_table(spark, many_days, tmp_path):
    path = str(tmp_path / "out")
    sink_parquet(many_days.filter("false"), path, "ts")
    assert not glob.glob(f"{path}/*/*.parquet")
