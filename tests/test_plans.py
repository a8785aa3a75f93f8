"""Physical plans keep the shape that scales."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tidewatt.catalog import QUERIES
from tidewatt.operators import ordered
from tidewatt.plans import sizing
from tidewatt.plans.order import chunked
from tidewatt.spec import SeriesSpec


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_one_long_series_is_not_one_partition(spark):
    df = spark.range(2000).selectExpr("timestamp_seconds(id)::timestamp_ntz AS ts", "id", "cast(id AS double) AS v")
    out = ordered.lag_features(df, SeriesSpec("ts", (), ("v",), ("id",)), (1, 96), rows_per_chunk=200)
    assert "SinglePartition" not in plan_of(out)
    assert out.filter("`v_t-96` = v - 96").count() == 2000 - 96


def test_lag_and_rolling_share_one_shuffle(spark, sf_dir):
    plan = plan_of(QUERIES["forecast_feature_table"](spark, sf_dir))
    assert plan.split("===")[0].count("Exchange") <= 4
    assert "ArrowEvalPython" not in plan and "FlatMapGroupsInPandas" not in plan


@pytest.mark.parametrize("name", ["bucket_mean", "clean_interpolate", "rolling_corr", "seasonal_decompose", "histogram", "duplicate_rows"])
def test_stays_in_the_jvm(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["scan_parquet_pushdown"](spark, sf_dir))
    assert "GreaterThan(value,50.0)" in plan and "props" not in plan
    assert "props" not in plan_of(QUERIES["bucket_mean"](spark, sf_dir))


def test_attach_without_broadcast_for_many_keys(spark, monkeypatch):
    df = spark.range(600).selectExpr("if(id < 300, 0, id) AS k", "id AS v")
    per_key = df.groupBy("k").agg(F.sum("v").alias("s"))
    want = sorted(map(tuple, sizing.attach(df, per_key, ["k"]).collect()))
    monkeypatch.setattr(sizing, "BROADCAST_VALUES", 10)
    monkeypatch.setattr(sizing, "ROWS_PER_CHUNK", 50)
    assert sorted(map(tuple, sizing.attach(df, per_key, ["k"]).collect())) == want


def test_chunks_are_bounded_for_a_hot_key(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 50 AS string)) AS k", "timestamp_seconds(id)::timestamp_ntz AS ts", "id")
    parts = chunked(df, SeriesSpec("ts", ("k",), (), ("id",)), before=5, rows_per_chunk=200)
    sizes = parts.frame.groupBy("k", "_chunk").agg(F.count("*").alias("n"), F.count_if("_own").alias("own"))
    row = sizes.agg(F.max("n"), F.sum("own")).first()
    assert row[0] <= 200 * 1.5 and row[1] == 5000
