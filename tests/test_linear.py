"""Linear-algebra summaries and the ridge fit against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatt.operators import clean, forecast, learn
from tidewatt.spec import SeriesSpec


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 3)) @ rng.normal(size=(3, 3)) + [3, -2, 10]
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["label"] = np.where(pdf["a"] > 4, "u", np.where(pdf["b"] > -2, "v", "w"))
    pdf["y"] = 2 + pdf["a"] - 0.5 * pdf["b"] + rng.normal(size=120)
    pdf["ts"] = np.arange(120)
    return pdf, spark.createDataFrame(pdf).repartition(3)


def test_vif(matrix):
    pdf, df = matrix
    got = {r["column"]: r["vif"] for r in learn.vif(df, ["a", "b", "c"]).collect()}
    for c in "abc":
        rest = pdf[[o for o in "abc" if o != c]].to_numpy()
        coef, *_ = np.linalg.lstsq(rest, pdf[c], rcond=None)
        error = pdf[c] - rest @ coef
        assert abs(got[c] - (pdf[c] @ pdf[c]) / (error @ error)) < 1e-6 * got[c]


def test_pca(matrix):
    pdf, df = matrix
    values = np.sort(np.linalg.eigvalsh(np.cov(pdf[["a", "b", "c"]].T)))[::-1]
    got = learn.pca_variance(df, ["a", "b", "c"]).orderBy("component").toPandas()["explained_variance_ratio"]
    assert np.allclose(got, values / values.sum())
    holes = df.withColumn("a", F.when(F.col("ts") % 5 > 0, F.col("a")))
    filled = pdf.assign(a=pdf["a"].where(pdf["ts"] % 5 > 0))
    filled["a"] = filled["a"].fillna(filled["a"].mean())
    values = np.sort(np.linalg.eigvalsh(np.cov(filled[["a", "b", "c"]].T)))[::-1]
    got = learn.pca_variance(holes, ["a", "b", "c"], impute=True).orderBy("component").toPandas()["explained_variance_ratio"]
    assert np.allclose(got, values / values.sum())


def test_discriminant(matrix):
    pdf, df = matrix
    x, overall = pdf[["a", "b", "c"]], pdf[["a", "b", "c"]].mean().to_numpy()
    within, between = np.zeros((3, 3)), np.zeros((3, 3))
    for _, g in x.groupby(pdf["label"]):
        m = g.mean().to_numpy()
        within += (g - m).T.to_numpy() @ (g - m).to_numpy()
        between += len(g) * np.outer(m - overall, m - overall)
    values = np.sort(np.linalg.eigvals(np.linalg.solve(within, between)).real)[::-1][:2]
    got = learn.discriminant_variance(df, ["a", "b", "c"], "label").orderBy("axis").toPandas()
    assert np.allclose(got["explained_variance_ratio"], values / values.sum()) and (got["n_classes"] == 3).all()


def test_ridge(matrix):
    pdf, df = matrix
    x = pdf[["a", "b", "c"]].to_numpy()
    x, y = (x - x.mean(0)) / x.std(0), pdf["y"].to_numpy()

    def fit(x, y, alpha):
        xc, yc = x - x.mean(0), y - y.mean()
        coef = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        return coef, y.mean() - x.mean(0) @ coef

    def r2(x, y, model):
        return 1 - ((y - x @ model[0] - model[1]) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    folds = np.array_split(np.arange(120), 3)
    scores = [np.mean([r2(x[f], y[f], fit(np.delete(x, f, 0), np.delete(y, f), a)) for f in folds]) for a in (0.1, 1.0, 10.0)]
    alpha = (0.1, 1.0, 10.0)[int(np.argmax(scores))]
    coef, intercept = fit(x, y, alpha)
    got = learn.ridge_fit(df, SeriesSpec("ts"), ["a", "b", "c"], "y").first()
    assert got["alpha"] == alpha and np.allclose(got["coef"], coef) and abs(got["intercept"] - intercept) < 1e-9
    assert abs(got["r2"] - r2(x, y, (coef, intercept))) < 1e-9


def test_forecast_follows_an_exact_pattern(spark):
    t = np.arange(64)
    pdf = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(t, unit="h"), "v": 10.0 + np.array([0, 3, 1, -4])[t % 4]})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    spec = SeriesSpec("ts", (), ("v",))
    got = forecast.forecast(df, spec, 8, 4).orderBy("step").toPandas()
    assert np.allclose(got["forecast"], pdf["v"][:8]) and list(got["idx"]) == list(range(64, 72))
    rising = forecast.forecast(df.withColumn("v", F.col("v") + F.hour("ts") * 0 + F.unix_timestamp("ts") / 3600), spec, 8, 4).orderBy("step").toPandas()
    start = df.selectExpr("min(unix_timestamp(ts)) / 3600 AS s").first()["s"]
    assert np.allclose(rising["forecast"], pdf["v"][:8] + start + np.arange(64, 72), atol=1e-6)
    assert np.allclose(forecast.seasonal_naive(df, spec, 6, 4).orderBy("step").toPandas()["forecast"], pdf["v"][:6])


def test_constant_and_single_row_series_have_no_outliers(spark):
    df = spark.createDataFrame([("flat", float(5)) for _ in range(20)] + [("one", 1.0), ("none", None)], "k string, v double")
    spec = SeriesSpec(keys=("k",), signals=("v",))
    assert clean.combined_flags(df, spec).filter("v_flag").count() == 0
