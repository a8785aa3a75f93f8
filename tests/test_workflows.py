"""The end-to-end jobs on telemetry-shaped tables derived from the events."""

import pytest
from pyspark.sql import functions as F

from tidewatt import workflows
from tidewatt.catalog.common import HOURLY, events, hourly
from tidewatt.operators import clean, ordered, seasonal
from tidewatt.operators.energy import CHARGE, DISCHARGE, SOC
from tidewatt.spec import SeriesSpec


@pytest.fixture(scope="module")
def site(spark):
    """Gap-free hourly site table (larger scale than the other tests: a month needs enough hours)."""
    rows = hourly(spark, "/root/testdata/sf0.01")
    return ordered.fill_backward_forward(rows, HOURLY).cache()


def test_ingest_then_clean(spark, sf_dir, tmp_path):
    raw = events(spark, sf_dir).select(
        F.expr("CASE WHEN event_id % 53 = 0 THEN 'not a time' ELSE date_format(ts, 'yyyy/MM/dd HH:mm:ss') END").alias("Timestamp"),
        F.col("event_id").alias("Row_Id"),
        F.expr("CASE WHEN event_id % 97 = 0 THEN -999999.0 ELSE value END").alias("GE_Active_Power"),
    )
    for part in (0, 1):
        raw.filter(F.col("Row_Id") % 2 == part).write.option("header", True).csv(f"{tmp_path}/in/{part}")
    schema = "Timestamp STRING, Row_Id BIGINT, GE_Active_Power DOUBLE"
    out = workflows.ingest(spark, [f"{tmp_path}/in/0", f"{tmp_path}/in/1"], f"{tmp_path}/table", schema)
    bad = raw.filter("Timestamp = 'not a time'").count()
    assert out["files"].agg(F.sum("n_rows")).first()[0] == raw.count() and out["table"].count() == raw.count() - bad
    assert out["issues"].filter("`column` = 'timestamp'").first()["datetime_parse_errors"] == bad
    spec = SeriesSpec("timestamp", (), (), ("row_id",))
    cleaned = workflows.clean_dataset(out["table"], spec, f"{tmp_path}/clean", report=f"{tmp_path}/report")
    assert cleaned.count() == out["table"].count() and cleaned.filter("ge_active_power < -1000").count() == 0
    assert spark.read.json(f"{tmp_path}/report").first()["cleaning_strategy"] == clean.EXTREMES


def test_lag_analysis(site):
    pairs = [("load_kw", "solar_kw"), ("load_kw", "absent")]
    out = workflows.lag_analysis(site, HOURLY.with_signals("load_kw", "solar_kw"), pairs, factor=60, max_lag=12, window=48)
    assert out["bucketed"].count() == 720 and out["acf"].count() == 26 and out["pacf"].count() == 26
    assert {r["pair"] for r in out["ccf"].select("pair").distinct().collect()} == {"load_kw_vs_solar_kw"}
    assert out["rolling_corr"].filter("rolling_corr IS NOT NULL").count() > 600


def test_forecast_metadata(site):
    rows = workflows.forecast_metadata(site, HOURLY.with_signals("load_kw", "solar_kw")).collect()
    assert {r["signal"] for r in rows} == {"load_kw", "solar_kw"}
    for r in rows:
        assert r["stationary"] and len(r["dominant_periods"]) == 5 and len(r["recommended_models"]) == 2
        assert r["suggestion"] in ("boxcox", "shift_then_boxcox_or_log")


def test_forecast_metadata_of_many_series(spark):
    rows = [(f"k{k}", k * 7 + i, 60 * (1 + k % 3) * i, float((i % (4 + k % 3)) + 0.01 * i)) for k in range(12) for i in range(60)]
    rows += [("short", 10**6 + i, 60 * i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, id long, s long, v double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    spec = SeriesSpec("ts", ("k",), ("v",), ("id",))
    got = {r["k"]: r for r in workflows.forecast_metadata(df, spec, max_lag=12).collect()}
    assert len(got) == 13
    for k in range(12):
        best = got[f"k{k}"]["dominant_periods"][0]
        assert best["period_seconds"] == pytest.approx(60 * (1 + k % 3) * (4 + k % 3), rel=0.1)
    periods = spark.createDataFrame([(f"k{k}", "v", p) for k in range(12) for p in (4, 5, 7)], "k string, signal string, period long")
    want = {(r["k"], r["period"]): r["seasonal_amplitude"] for r in seasonal.seasonal_amplitude(df.where("k <> 'short'"), spec, [4, 5, 7]).collect()}
    for size in (None, 25):
        own = {(r["k"], r["period"]): r["seasonal_amplitude"] for r in seasonal.seasonal_amplitude_of(df, spec, periods, size).collect()}
        assert own == pytest.approx(want)


def test_battery_and_dispatch(site):
    named = site.select(
        "ts", F.col("charge_kw").alias(CHARGE), F.col("discharge_kw").alias(DISCHARGE), F.col("soc").alias(SOC),
        F.col("solar_kw").alias("solar_pv_output"), F.col("load_kw").alias("grid_load_demand"), F.col("wind_kw").alias("temperature"),
    )
    out = workflows.battery_workflow(named, SeriesSpec("ts"), trees=3)
    row = out["metrics"].first()
    assert out["parameters"].count() == 1 and row["n_obs"] == 720 and row["hyb_rmse"] <= row["phys_rmse"] * 1.2
    report = workflows.dispatch_report(site, SeriesSpec("ts"), "load_kw", ["solar_kw", "wind_kw"], "soc", "charge_kw", "discharge_kw", "1 hour")
    assert report["days"].count() == 30 and report["sweep"].count() == 150 and report["recommendation"].count() == 30
    assert report["peaks"].count() == 60 and report["import_model"].first()["n_rows"] == 30
