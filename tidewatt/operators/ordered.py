"""Operators that depend on row order inside a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.functions.timestamps import micros
from tidewatt.functions.values import quoted, replace_columns
from tidewatt.operators.rolling import drop_moments, merge_pair, moments, pair, single, with_moments
from tidewatt.plans.order import BASE, Chunked, chunked, known_neighbours, with_position
from tidewatt.plans.quantiles import known, quantile_wide
from tidewatt.plans.sizing import attach, measured
from tidewatt.spec import SeriesSpec

def long_form(df: DataFrame, spec: SeriesSpec, extra=()) -> tuple[DataFrame, SeriesSpec]:
    """One row per reading: the signal name becomes a key, the reading ``value``."""
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), known(quoted(s)).alias("value")) for s in spec.signals]))
    rows = df.select(*spec.keys, *spec.order, *extra, cells.alias("_c")).select(
        *spec.keys, *spec.order, *extra, "_c.signal", "_c.value"
    )
    return rows, SeriesSpec(spec.ts, (*spec.keys, "signal"), ("value",), spec.tie)


def time_gaps(df: DataFrame, spec: SeriesSpec, name: str, rows_per_chunk: int | None = None) -> DataFrame:
    """Seconds since the previous row of the series; null on its first row."""
    parts = chunked(df, spec, before=1, rows_per_chunk=rows_per_chunk)
    at = micros(spec.ts)
    return parts.trim(parts.frame.withColumn(name, (at - F.lag(at).over(parts.window)) / 1_000_000))


def gap_minutes(df: DataFrame, spec: SeriesSpec, rows_per_chunk: int | None = None) -> DataFrame:
    return time_gaps(df, spec, "gap_minutes", rows_per_chunk).withColumn("gap_minutes", F.col("gap_minutes") / 60)


def find_gaps(df: DataFrame, spec: SeriesSpec, over_minutes: float = 15.0, rows_per_chunk: int | None = None) -> DataFrame:
    """Rows that follow a gap strictly longer than the threshold."""
    return gap_minutes(df.select(*spec.keys, *spec.order), spec, rows_per_chunk).filter(F.col("gap_minutes") > over_minutes)


def rolling_columns(parts: Chunked, signals, windows) -> tuple[DataFrame, dict[tuple[str, int], tuple[Column, Column, Column]]]:
    """Count, mean and sample variance of the last ``w`` rows for each signal and window length."""
    frame = with_moments(parts, {s: single(known(quoted(s))) for s in signals}, {str(n): n for n in windows}, max(windows))
    out = {}
    for s in signals:
        for n in windows:
            m = moments(str(n), s)
            out[s, n] = (F.coalesce(m["n"], F.lit(0.0)), m["m"], m["q"] / F.when(m["n"] > 1, m["n"] - 1))
    return frame, out


def lag_name(signal: str, lag: int) -> str:
    return f"{signal}_t-{lag}"


def lag_features(
    df: DataFrame, spec: SeriesSpec, lags=(1, 2, 96), name=lag_name, rows_per_chunk: int | None = None
) -> DataFrame:
    """The value ``k`` rows earlier for every signal and lag, in one window pass."""
    parts = chunked(df, spec, before=max(lags), rows_per_chunk=rows_per_chunk)
    return parts.trim(parts.frame.select("*", *lag_columns(parts, spec.signals, lags, name)))


def lag_columns(parts: Chunked, signals, lags, name=lag_name) -> list[Column]:
    return [F.lag(quoted(s), k).over(parts.window).alias(name(s, k)) for s in signals for k in lags]


def rolling_full(df: DataFrame, spec: SeriesSpec, windows=(4, 8, 96), rows_per_chunk: int | None = None) -> DataFrame:
    """Trailing mean and sample deviation, null until the window is full of known values."""
    parts = chunked(df, spec, before=max(windows), rows_per_chunk=rows_per_chunk)
    frame, columns = add_rolling_full(parts, spec.signals, windows)
    return drop_moments(parts.trim(frame.select("*", *columns)))


def add_rolling_full(parts: Chunked, signals, windows) -> tuple[DataFrame, list[Column]]:
    columns = []
    frame, stats = rolling_columns(parts, signals, windows)
    for (s, n), (count, mean, var) in stats.items():
        columns.append(F.when(count == n, mean).alias(f"{s}roll_mean{n}"))
        columns.append(F.when(count == n, F.sqrt(var)).alias(f"{s}roll_std{n}"))
    return frame, columns


def rolling_partial_mean(df: DataFrame, spec: SeriesSpec, windows=(3, 6, 24), rows_per_chunk: int | None = None) -> DataFrame:
    """Trailing mean of the known values in the window, from the first row on."""
    parts = chunked(df, spec, before=max(windows), rows_per_chunk=rows_per_chunk)
    frame, columns = add_rolling_partial(parts, spec.signals, windows)
    return drop_moments(parts.trim(frame.select("*", *columns)))


def add_rolling_partial(parts: Chunked, signals, windows) -> tuple[DataFrame, list[Column]]:
    frame, stats = rolling_columns(parts, signals, windows)
    return frame, [mean.alias(f"{s}_roll_{n}") for (s, n), (_, mean, _) in stats.items()]


def rolling_variance_stability(df: DataFrame, spec: SeriesSpec, window: int = 24, rows_per_chunk: int | None = None) -> DataFrame:
    """Median of the rolling variance and the ratio of its quartiles, per key and signal."""
    rows, long = long_form(df, spec)
    parts = chunked(rows.filter("value IS NOT NULL"), long, before=window, rows_per_chunk=rows_per_chunk)
    frame, stats = rolling_columns(parts, ["value"], [window])
    rolled = drop_moments(parts.trim(frame.withColumn("_var", stats["value", window][2])))
    q = quantile_wide(rolled, long.keys, ["_var"], [0.25, 0.5, 0.75])
    low, high = F.col("_var")[0], F.col("_var")[2]
    return q.select(
        *long.keys, F.col("_var")[1].alias("rolling_variance_median"), F.when(low > 0, high / low).alias("variance_q75_q25_ratio")
    )


def rolling_corr(
    df: DataFrame, spec: SeriesSpec, window: int = 4320, min_pairs: int | None = None, rows_per_chunk: int | None = None
) -> DataFrame:
    """Pearson correlation of two signals over the last ``window`` rows (complete pairs).

    A series shorter than two windows uses a quarter of its own rows, whatever other series the
    table holds. Null with too few pairs or where a signal does not vary inside the window.
    """
    a, b = spec.signals
    keys = list(spec.keys)
    both = known(quoted(a)).isNotNull() & known(quoted(b)).isNotNull()
    x, y = F.when(both, known(quoted(a))), F.when(both, known(quoted(b)))
    df = df.filter(F.col(spec.ts).isNotNull()).select(*keys, *spec.order, x.alias("_x"), y.alias("_y"))
    sizes, profile = measured(df, keys)
    quarter = F.greatest(F.lit(2).cast("bigint"), F.floor(F.col("n_obs") / 4))
    own = F.when(F.col("n_obs") >= 2 * window, F.lit(window).cast("bigint")).otherwise(quarter)
    longest = sizes.agg(F.max(own)).first()[0] or 1
    rows = attach(df, sizes.select(*keys, own.alias("_window")), keys, profile)
    parts = chunked(rows, spec, before=longest, rows_per_chunk=rows_per_chunk, profile=profile)
    frame = with_moments(parts, {"xy": pair(F.col("_x"), F.col("_y"))}, {"own": F.col("_window")}, longest, merge_pair)
    m = moments("own", "xy")
    least = F.floor(F.col("_window") / 2) if min_pairs is None else F.lit(min_pairs)
    varies = (m["n"] >= least) & (m["xx"] > 0) & (m["yy"] > 0)
    corr = F.when(varies, m["xy"] / (F.sqrt(F.when(varies, m["xx"])) * F.sqrt(F.when(varies, m["yy"]))))
    return parts.trim(frame.withColumn("rolling_corr", corr)).select(*keys, *spec.order, "rolling_corr")


def interpolated(signal: str, x: str) -> Column:
    """Value on the line between the neighbours; the last known value after the last one."""
    v, p, n = known(quoted(signal)), quoted(f"_prev_{signal}"), quoted(f"_next_{signal}")
    width = F.when(n["x"] > p["x"], n["x"] - p["x"])
    line = p["v"] + (n["v"] - p["v"]) * (F.col(x) - p["x"]) / width
    return F.coalesce(v, F.when(p.isNotNull(), F.coalesce(line, p["v"])))


def drop_neighbours(df: DataFrame, signals) -> DataFrame:
    return df.drop(*[f"_{side}_{s}" for s in signals for side in ("prev", "next")])


def interpolate(df: DataFrame, spec: SeriesSpec, axis: str = "row", rows_per_chunk: int | None = None) -> DataFrame:
    """Fill inner gaps on a straight line over row number or time; leading gaps stay."""
    parts = chunked(df, spec, rows_per_chunk=rows_per_chunk)
    x = parts.position if axis == "row" else micros(spec.ts)
    parts = parts.having(replace_columns(parts.frame.withColumn("_x", x), {s: known(quoted(s)) for s in spec.signals}))
    frame = known_neighbours(parts, spec.signals, "_x")
    frame = replace_columns(frame, {s: interpolated(s, "_x") for s in spec.signals})
    return drop_neighbours(parts.trim(frame), spec.signals).drop("_x")


def fill_backward_forward(df: DataFrame, spec: SeriesSpec, rows_per_chunk: int | None = None) -> DataFrame:
    """The next known value, else the last known one."""
    parts = chunked(df, spec, rows_per_chunk=rows_per_chunk)
    parts = parts.having(parts.frame.withColumn("_x", parts.position))
    frame = known_neighbours(parts, spec.signals, "_x")
    filled = {s: F.coalesce(known(quoted(s)), quoted(f"_next_{s}")["v"], quoted(f"_prev_{s}")["v"]) for s in spec.signals}
    return drop_neighbours(parts.trim(replace_columns(frame, filled)), spec.signals).drop("_x")


def lag_difference(df: DataFrame, spec: SeriesSpec, d: int = 1, mode: str = "lag", rows_per_chunk: int | None = None) -> DataFrame:
    """``mode='lag'``: x[t] - x[t-d]; ``mode='order'``: the d-th order difference."""
    import math

    parts = chunked(df, spec, before=d, rows_per_chunk=rows_per_chunk)
    columns = []
    for s in spec.signals:
        if mode == "lag":
            diff = quoted(s) - F.lag(quoted(s), d).over(parts.window)
        else:
            diff = quoted(s)
            for k in range(1, d + 1):
                diff = diff + (-1) ** k * math.comb(d, k) * F.lag(quoted(s), k).over(parts.window)
        columns.append(diff.alias(f"{s}_diff{d}"))
    return parts.trim(parts.frame.select("*", *columns))


def with_length(df: DataFrame, spec: SeriesSpec, rows_per_chunk: int | None = None) -> DataFrame:
    """Row position ``idx`` and series length ``n_rows``."""
    df = df.filter(F.col(spec.ts).isNotNull())
    sizes, profile = measured(df, spec.keys)
    return with_position(attach(df, sizes.withColumnRenamed("n_obs", "n_rows"), spec.keys, profile), spec, "idx", rows_per_chunk, profile)


def time_split(df: DataFrame, spec: SeriesSpec, train: float = 0.8, rows_per_chunk: int | None = None) -> DataFrame:
    """Label the first part of each series 'train' and the rest 'validate'."""
    rows = with_length(df, spec, rows_per_chunk)
    first = F.col("idx") < F.floor(F.lit(train) * F.col("n_rows"))
    return rows.withColumn("split", F.when(first, "train").otherwise("validate")).drop("n_rows")


def holdout_last(df: DataFrame, spec: SeriesSpec, n: int = 96, rows_per_chunk: int | None = None) -> DataFrame:
    """Label the last ``n`` rows of each series 'test' and the rest 'train'."""
    rows = with_length(df, spec, rows_per_chunk)
    return rows.withColumn("split", F.when(F.col("idx") >= F.col("n_rows") - n, "test").otherwise("train")).drop("n_rows")


def systematic_sample(df: DataFrame, spec: SeriesSpec, max_rows: int = 1000, rows_per_chunk: int | None = None) -> DataFrame:
    """Every k-th row, k being the series length over ``max_rows``; short series stay whole."""
    rows = with_length(df, spec, rows_per_chunk)
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n_rows") / max_rows))
    return rows.filter(F.pmod(F.col("idx"), step) == 0).drop("n_rows")


def first_value_per_group(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The earliest row's value per key, null if that row has none."""
    order = F.struct(*spec.order)
    rows = df.filter(F.col(spec.ts).isNotNull())
    return rows.groupBy(*spec.keys).agg(*[F.min_by(quoted(s), order).alias(s) for s in spec.signals])


def first_rows(df: DataFrame, spec: SeriesSpec, n: int = 25) -> DataFrame:
    """The first ``n`` rows of each series and signal, numbered from 1.

    Only leading chunks reach the window: rows after the first ``n`` positions of a long
    series are dropped before the shuffle.
    """
    parts = chunked(df.select(*spec.keys, *spec.order, *[quoted(s) for s in spec.signals]), spec)
    frame = parts.frame.filter(F.col(BASE) < n) if parts.split else parts.frame
    rows = parts.trim(frame.withColumn("rn", parts.position + 1).filter(F.col("rn") <= n))
    long, _ = long_form(rows, spec, ["rn"])
    return long


__all__ = [n for n in dir() if not n.startswith("_")]
