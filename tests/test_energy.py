"""Battery and dispatch operators against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatt.operators import energy
from tidewatt.spec import SeriesSpec

SPEC = SeriesSpec("ts", ("k",), (), ())


@pytest.fixture(scope="module")
def battery(spark):
    rng = np.random.default_rng(5)
    n = 500
    pdf = pd.DataFrame({
        "k": "a", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h"),
        "charge": rng.uniform(-5, 30, n), "discharge": rng.uniform(-5, 30, n),
    })
    state, out = 40.0, []
    for i, (c, d) in enumerate(zip(pdf["charge"].clip(lower=0), pdf["discharge"].clip(lower=0))):
        if i:
            state = min(100.0, max(0.0, state + (0.93 * c - 0.98 * d) / 75.0 * 100.0))
        out.append(state)
    pdf["soc"] = out
    pdf.loc[3::7, "soc"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return np.array(out), df.withColumn("soc", F.when(~F.isnan("soc"), F.col("soc"))).repartition(3).cache()


@pytest.mark.parametrize("size", [None, 60])
def test_balance_equals_loop(battery, size):
    want, df = battery
    rows = df.withColumn("delta", energy.soc_delta(1.0, 75.0, 0.93, 0.98, "charge", "discharge"))
    got = energy.clamped_running_balance(rows, SPEC, "delta", start="soc", rows_per_chunk=size).orderBy("ts").toPandas()
    assert np.allclose(got["balance"], want, atol=1e-9)
    assert want.min() == 0.0 and want.max() == 100.0


@pytest.mark.parametrize("size", [None, 60])
@pytest.mark.parametrize("keys", [("k",), ()])
def test_calibration_finds_the_parameters(battery, size, keys):
    _, df = battery
    fit = energy.fit_parameters(df, SeriesSpec("ts", keys), 1.0, "soc", "charge", "discharge", rows_per_chunk=size).first()
    assert (fit["capacity_kwh"], fit["eta_ch"], fit["eta_dis"]) == (75.0, 0.93, 0.98)
    assert fit["rmse"] < 1e-4 and fit["n_obs"] > 200
    short = energy.fit_parameters(df.limit(5), SeriesSpec("ts", keys), 1.0, "soc", "charge", "discharge").first()
    assert short["capacity_kwh"] is None and short["n_obs"] < 10


def test_sweep_budget(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h) AS ts, IF(h < 12, 0.0D, 20.0D) AS load, IF(h < 12, 10.0D, 0.0D) AS sun, 0.5D AS soc FROM range(24) t(h)")
    rows = {r["candidate_order"]: r for r in energy.capacity_sweep(df, SeriesSpec("ts"), "load", ["sun"], "soc", "1 hour").collect()}
    assert rows[0]["battery_discharged_kwh"] == pytest.approx(80 * 0.93) and rows[0]["grid_import_kwh"] == pytest.approx(240 - 80 * 0.93)
    assert rows[4]["battery_discharged_kwh"] == pytest.approx(120 * 0.9 * 0.93) and rows[4]["grid_export_kwh"] == pytest.approx(0.0)


def test_capacity_scales(spark):
    rows = [("frac", 0.8), ("pct", 3.0), ("kwh", 80.0), ("none", None)]
    df = spark.createDataFrame([(k, i, v) for k, top in rows for i, v in enumerate((top and top / 2, top))], "k string, ts int, soc double")
    got = {r["k"]: (r["capacity_kwh"], r["initial_kwh"]) for r in energy.infer_capacity(df, SPEC, "soc").collect()}
    assert got == {"frac": (100.0, 40.0), "pct": (100.0, 1.5), "kwh": (80.0, 40.0), "none": (100.0, 0.0)}


def test_zero_denominators_stay_null(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS ts, 0.0D AS load, 2.0D AS sun, 50.0D AS soc, 0.0D AS up, 0.0D AS down")
    day = energy.daily_energy_summary(df, SeriesSpec("ts"), "load", ["sun"], "up", "down", "soc", 1.0).first()
    assert day["renewable_fraction_of_load"] is None and day["battery_efficiency"] is None and day["grid_export_kwh"] == 2.0
    sweep = energy.capacity_sweep(df, SeriesSpec("ts"), "load", ["sun"], "soc", "1 hour")
    note = energy.recommend_capacity(sweep).first()
    assert note["reduction_pct"] is None and note["notes"].endswith("by 0.00 kWh.")
