"""Long and short path give the same rows on degenerate series: no keys, constants, one instant, nulls, text ties."""

import pytest
from pyspark.sql import functions as F

from tidewatt.operators import buckets, clean, ordered
from tidewatt.operators.lagstats import acf
from tidewatt.plans import sizing
from tidewatt.plans.quantiles import quantile_long, ranked_quantiles
from tidewatt.spec import SeriesSpec

N = 300


@pytest.fixture(scope="module")
def cases(spark):
    base = spark.range(N).select(
        F.col("id"), F.lit("a").alias("k"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id)").alias("ts"),
        F.format_string("a common prefix of the name %04d", "id").alias("name"), (F.col("id") % 7).cast("double").alias("v"),
    )
    nulls = base.withColumn("k", F.lit("none")).withColumn("v", F.lit(None).cast("double"))
    return {
        "regular": base, "constant": base.withColumn("v", F.lit(3.0)), "instant": base.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")),
        "with_nulls": base.unionByName(nulls.withColumn("id", F.col("id") + N).withColumn("name", F.concat("name", F.lit("x")))),
    }


OPERATORS = {
    "position": lambda d, s, n: ordered.with_position(d, s, rows_per_chunk=n),
    "lags": lambda d, s, n: ordered.lag_features(d, s, (1, 5), rows_per_chunk=n),
    "rolling": lambda d, s, n: ordered.rolling_full(d, s, (4, 20), rows_per_chunk=n),
    "fill": lambda d, s, n: ordered.fill_backward_forward(d.withColumn("v", F.when(F.col("id") % 5 > 0, F.col("v"))), s, n),
    "interpolate": lambda d, s, n: ordered.interpolate(d.withColumn("v", F.when(F.col("id") % 5 > 0, F.col("v"))), s, rows_per_chunk=n),
    "stability": lambda d, s, n: ordered.rolling_variance_stability(d, s, 10, rows_per_chunk=n),
    "acf": lambda d, s, n: acf(d, s, 5, rows_per_chunk=n),
}


def rows_of(df):
    return sorted(str([round(v, 7) + 0.0 if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.mark.parametrize("case,keys,tie", [
    ("regular", (), "name"), ("constant", ("k",), "id"), ("instant", ("k",), "name"), ("instant", (), "id"), ("with_nulls", ("k",), "id"),
])
def test_chunks_change_nothing(cases, case, keys, tie):
    df, spec = cases[case], SeriesSpec("ts", keys, ("v",), (tie,))
    for name, run in OPERATORS.items():
        assert rows_of(run(df, spec, 60)) == rows_of(run(df, spec, None)), name


@pytest.mark.parametrize("case,keys", [("regular", []), ("constant", []), ("constant", ["k"]), ("with_nulls", ["k"])])
def test_ranked_quantiles_equal_builtin(cases, case, keys):
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    assert rows_of(ranked_quantiles(cases[case], keys, "v", probs, N, 40)) == rows_of(quantile_long(cases[case], keys, "v", probs))


def test_correlation_window_is_per_series(spark):
    df = spark.range(1100).select(
        F.when(F.col("id") < 100, "short").otherwise("long").alias("k"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"),
        F.sin(F.col("id") * F.col("id")).alias("a"), F.cos(F.col("id") * 3).alias("b"),
    )
    spec = SeriesSpec("ts", ("k",), ("a", "b"))
    alone = {r["ts"]: r["rolling_corr"] for r in ordered.rolling_corr(df.where("k = 'short'"), spec, 200).collect()}
    assert sum(v is not None for v in alone.values()) == 89
    for size in (None, 30):
        beside = {r["ts"]: r["rolling_corr"] for r in ordered.rolling_corr(df, spec, 200, rows_per_chunk=size).where("k = 'short'").collect()}
        assert beside == pytest.approx(alone)
    pdf = df.where("k = 'short'").orderBy("ts").toPandas()
    want = pdf["a"].rolling(25, min_periods=12).corr(pdf["b"])
    assert [alone[t] for t in pdf["ts"]][11:] == pytest.approx(want.tolist()[11:])


def test_thin_out_a_long_regular_series(spark):
    df = spark.range(250_000).select(F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("v"))
    assert buckets.thin_out(df, SeriesSpec("ts", (), ("v",))).count() == 250


def test_cleaning_keeps_rows_without_time(cases):
    df = cases["regular"].withColumn("ts", F.when(F.col("id") % 9 > 0, F.col("ts"))).withColumn("v", F.when(F.col("id") == 9, -999999.0).otherwise(F.col("v")))
    spec = SeriesSpec("ts", ("k",), ("v",), ("id",))
    for strategy in clean.STRATEGIES:
        assert clean.clean(df, spec, strategy).count() == N
    row = clean.clean(df, spec, clean.INTERPOLATE).where("id = 9").first()
    assert row["ts"] is None and row["v"] is None


def test_nan_is_missing(spark):
    from tidewatt.functions.values import fill_null
    from tidewatt.operators import energy

    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h) AS ts, CASE h WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::double ELSE h::double END AS a, 1.0D AS b FROM range(5) t(h)")
    spec = SeriesSpec("ts", (), ("a",))
    assert [r["a"] for r in ordered.fill_backward_forward(df, spec).orderBy("ts").collect()] == [2.0, 2.0, 2.0, 3.0, 4.0]
    assert [r["battery_net_power"] for r in energy.net_power(df, "a", "b").orderBy("ts").collect()] == [1.0, 1.0, -1.0, -2.0, -3.0]
    assert energy.infer_capacity(df, SeriesSpec("ts"), "a").first()["capacity_kwh"] == 100.0
    assert [r["a"] for r in fill_null(df, ["a"]).orderBy("ts").collect()] == [0.0, 0.0, 2.0, 3.0, 4.0]


def test_shuffle_joins_give_the_same(cases, monkeypatch):
    df, spec = cases["regular"], SeriesSpec("ts", ("k",), ("v",), ("id",))
    some = {name: OPERATORS[name] for name in ("position", "interpolate", "acf")}
    want = {name: rows_of(run(df, spec, 60)) for name, run in some.items()}
    monkeypatch.setattr(sizing, "BROADCAST_VALUES", 10)
    for name, run in some.items():
        assert rows_of(run(df, spec, 60)) == want[name], name


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from tidewatt import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError):
        session.shared_dir(Session())
