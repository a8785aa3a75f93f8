"""The tables behind distribution charts."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, functions as F

from tidewatt.functions.values import quoted, replace_columns
from tidewatt.operators.ordered import long_form
from tidewatt.operators.quality import sample_rows, variance_rank
from tidewatt.plans.quantiles import known, quantile_long, quantile_wide
from tidewatt.plans.sizing import attach, profile_keys, same_keys
from tidewatt.spec import SeriesSpec


def histogram(df: DataFrame, spec: SeriesSpec, bins: int = 100) -> DataFrame:
    """Counts in equal-width bins from minimum to maximum; empty bins count 0.

    The top edge belongs to the last bin. A constant column gets a range of width one.
    """
    keys = list(spec.keys)
    wide = df.groupBy(*keys).agg(
        *[f(known(quoted(s))).alias(f"{s}#{n}") for s in spec.signals for n, f in (("lo", F.min), ("hi", F.max))]
    )
    edges = wide.select(
        *keys,
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("signal"), F.col(f"`{s}#lo`").alias("_lo"), F.col(f"`{s}#hi`").alias("_hi")) for s in spec.signals
        ])).alias("_e"),
    ).select(*keys, "_e.*").filter("_lo IS NOT NULL")
    flat = F.col("_lo") == F.col("_hi")
    edges = edges.select(
        *keys, "signal",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    rows = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(s).alias("signal"), known(quoted(s)).alias("value")) for s in spec.signals
    ])).alias("_c")).select(*keys, "_c.*").filter("value IS NOT NULL")
    place = F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    counted = attach(rows, edges, [*keys, "signal"]).groupBy(
        *keys, "signal", F.least(F.lit(bins - 1).cast("bigint"), place).alias("bin")
    ).agg(F.count("*").alias("n"))
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    step = (F.col("_hi") - F.col("_lo")) / bins
    grid = grid.select(*keys, "signal", "bin", (F.col("_lo") + F.col("bin") * step).alias("bin_start"))
    return same_keys(grid, counted, [*keys, "signal", "bin"]).withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def clip_percentiles(df: DataFrame, spec: SeriesSpec, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """Pull values outside two percentiles onto them, per key and column."""
    keys = list(spec.keys)
    profile = profile_keys(df, keys)
    q = quantile_wide(df, keys, spec.signals, [low / 100, high / 100], profile)
    q = q.select(*keys, *[quoted(s).alias(f"{s}#q") for s in spec.signals])
    rows = attach(df, q, keys, profile)
    clipped = {
        s: F.when(known(quoted(s)).isNotNull(), F.least(F.greatest(known(quoted(s)), quoted(f"{s}#q")[0]), quoted(f"{s}#q")[1]))
        for s in spec.signals
    }
    return replace_columns(rows, clipped).select(*[quoted(c) for c in df.columns])


def box_stats(df: DataFrame, spec: SeriesSpec, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (the extreme values within ``reach`` IQR of the box) and outliers."""
    keys = list(spec.keys)
    profile = profile_keys(df, keys)
    q = quantile_wide(df, keys, spec.signals, [0.25, 0.5, 0.75], profile)
    q = q.select(*keys, *[quoted(s).alias(f"{s}#q") for s in spec.signals])
    rows = attach(df.select(*keys, *[known(quoted(s)).alias(s) for s in spec.signals]), q, keys, profile)
    aggs = []
    for s in spec.signals:
        box, v = quoted(f"{s}#q"), quoted(s)
        iqr = box[2] - box[0]
        inside = (v >= box[0] - reach * iqr) & (v <= box[2] + reach * iqr)
        aggs += [
            F.first(box).alias(f"{s}#box"),
            F.min(F.when(inside, v)).alias(f"{s}#whisker_low"),
            F.max(F.when(inside, v)).alias(f"{s}#whisker_high"),
            F.count_if(~inside).alias(f"{s}#n_outliers"),
        ]
    wide = rows.groupBy(*keys).agg(*aggs)
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(s).alias("signal"),
            *[quoted(f"{s}#box")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))],
            *[quoted(f"{s}#{n}").alias(n) for n in ("whisker_low", "whisker_high", "n_outliers")],
        )
        for s in spec.signals
    ]))
    return wide.select(*keys, cells.alias("_c")).select(*keys, "_c.*")


def normal_quantiles(n: int = 99) -> list[tuple[float, float]]:
    """(p, z) for n evenly spaced probabilities."""
    unit = NormalDist()
    return [(i / (n + 1), unit.inv_cdf(i / (n + 1))) for i in range(1, n + 1)]


def qq_points(df: DataFrame, spec: SeriesSpec, n: int = 99) -> DataFrame:
    """Sample quantiles against normal quantiles with the fitted line, per key and signal."""
    rows, long = long_form(df, spec)
    keys = list(long.keys)
    points = normal_quantiles(n)
    q = quantile_long(rows, keys, "value", [p for p, _ in points])
    theory = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(z).alias("z")) for p, z in points])
    pairs = q.select(*keys, F.explode(F.arrays_zip(theory.alias("t"), F.col("quantiles").alias("s"))).alias("_p"))
    pairs = pairs.select(*keys, F.col("_p.t.p").alias("p"), F.col("_p.t.z").alias("normal_q"), F.col("_p.s").alias("sample_q"))
    line = pairs.groupBy(*keys).agg(
        F.regr_slope("sample_q", "normal_q").alias("slope"), F.regr_intercept("sample_q", "normal_q").alias("intercept")
    )
    return same_keys(pairs, line, keys)


def pair_sample(df: DataFrame, columns, key_columns, n: int = 2000, top: int = 10, seed: int = 42) -> DataFrame:
    """A repeatable sample of complete rows, reduced to the columns of largest variance."""
    complete = df.na.drop(subset=list(columns))
    sample = sample_rows(complete, key_columns, n, seed)
    if len(columns) > top:
        ranked = [r["column"] for r in variance_rank(sample, columns, top).collect()]
        columns = [c for c in columns if c in ranked]
    return sample.select(*key_columns, *[quoted(c) for c in columns])
