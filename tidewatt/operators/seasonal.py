"""Additive decomposition and seasonal strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.operators.ordered import long_form
from tidewatt.operators.rolling import drop_moments, moments, single, with_moments
from tidewatt.plans.order import Chunked, chunked, running_total
from tidewatt.plans.sizing import attach, broadcast_if_small, fits_broadcast, measured, same_keys
from tidewatt.session import freeze
from tidewatt.spec import SeriesSpec


def centred_mean(parts: Chunked, value: str, period: int) -> tuple[DataFrame, Column]:
    """Centred moving average over one period, ends weighted half when the period is even."""
    w, v, half = parts.window, F.col(value), period // 2
    inner = period - 1 + period % 2
    frame = with_moments(parts, {value: single(v)}, {"inner": inner}, inner)
    m = F.lead(moments("inner", value), inner // 2).over(w)
    mean = m["m"] * (inner / period)
    if period % 2 == 0:
        mean = mean + (F.lag(v, half).over(w) + F.lead(v, half).over(w)) / (2 * period)
    return frame, F.when(m["n"] == inner, mean)


def seasonal_decompose(
    df: DataFrame, spec: SeriesSpec, period: int, extrapolate: bool = True, rows_per_chunk: int | None = None
) -> DataFrame:
    """Trend, seasonal part and residual of every signal, as long rows with position ``idx``.

    The trend is a centred moving average. With ``extrapolate`` its ends follow lines fitted
    to the first and last period of trend points; otherwise they stay null. The seasonal
    part is the mean detrended value per phase, shifted to mean zero.
    """
    rows, long = long_form(df, spec)
    rows = rows.filter("value IS NOT NULL")
    keys = list(long.keys)
    sizes, profile = measured(rows, keys)
    rows = attach(rows, sizes.filter(F.col("n_obs") >= 2 * period), keys, profile).filter("n_obs IS NOT NULL")
    half = period // 2
    parts = chunked(rows, long, before=half + 1, after=half + 1, rows_per_chunk=rows_per_chunk, profile=profile)
    parts = parts.having(parts.frame.withColumn("idx", parts.position))
    frame, trend = centred_mean(parts, "value", period)
    base = drop_moments(parts.trim(frame.withColumn("trend", trend)))
    base = base.withColumn("_phase", F.pmod(F.col("idx"), F.lit(period).cast("bigint")))
    first, last = F.lit(half), F.col("n_obs") - 1 - half
    # Positions are counted from the near end of the series, which keeps the sums small.
    place = {"front": F.col("idx").cast("double"), "back": (F.col("idx") - F.col("n_obs") + 1).cast("double")}
    fitted = {
        "front": (F.col("idx") >= first) & (F.col("idx") < F.least(first + period, last)),
        "back": (F.col("idx") >= F.greatest(first, last - period)) & (F.col("idx") < last),
    }
    outside = {"front": F.col("idx") < first, "back": F.col("idx") > last}
    t, v = F.col("trend"), F.col("value")
    terms = {"mid_d": v - t, "mid_n": F.when(t.isNotNull(), F.lit(1.0))}
    for side in ("front", "back"):
        x, on, off = place[side], fitted[side], outside[side]
        for name, e in (("n", F.lit(1.0)), ("x", x), ("t", t), ("xx", x * x), ("xt", x * t)):
            terms[f"{side}_{name}"] = F.when(on, e)
        for name, e in (("on", F.lit(1.0)), ("ox", x), ("ov", v)):
            terms[f"{side}_{name}"] = F.when(off, e)
    # One pass gives, per phase, everything the two end lines and the phase means need.
    phases = base.groupBy(*keys, "_phase").agg(*[F.coalesce(F.sum(e), F.lit(0.0)).alias(n) for n, e in terms.items()])
    total, count = F.col("mid_d"), F.col("mid_n")
    by_key = Window.partitionBy(*keys)
    if extrapolate:
        for side in ("front", "back"):
            n, sx, st, xx, xt = (F.sum(f"{side}_{c}").over(by_key) for c in ("n", "x", "t", "xx", "xt"))
            spread = n * xx - sx * sx
            phases = phases.withColumn(f"_{side}_k", (n * xt - sx * st) / F.when(spread > 0, spread))
            phases = phases.withColumn(f"_{side}_b", (st - F.col(f"_{side}_k") * sx) / F.when(n > 0, n))
            line = F.col(f"_{side}_k") * F.col(f"{side}_ox") + F.col(f"_{side}_b") * F.col(f"{side}_on")
            total = total + F.coalesce(F.col(f"{side}_ov") - line, F.lit(0.0))
            count = count + F.when(F.col(f"_{side}_k").isNotNull(), F.col(f"{side}_on")).otherwise(0.0)
    phases = phases.withColumn("_mean", total / F.when(count > 0, count))
    phases = phases.withColumn("seasonal", F.col("_mean") - F.avg("_mean").over(by_key))
    lines = [f"_{side}_{c}" for side in ("front", "back") for c in "kb"] if extrapolate else []
    table = phases.select(*keys, "_phase", "seasonal", *lines)
    if fits_broadcast(table, profile.groups * period):
        out = same_keys(base, F.broadcast(table), [*keys, "_phase"])
    else:
        out = attach(base, table, [*keys, "_phase"])
    if extrapolate:
        end = {side: F.col(f"_{side}_k") * place[side] + F.col(f"_{side}_b") for side in ("front", "back")}
        out = out.withColumn("trend", F.when(outside["front"], end["front"]).when(outside["back"], end["back"]).otherwise(t))
    return out.select(
        *keys, *spec.order, "idx", "value", "trend", "seasonal",
        (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"),
    )


def seasonal_amplitude(df: DataFrame, spec: SeriesSpec, periods, rows_per_chunk: int | None = None) -> DataFrame:
    """Spread (max - min) of the seasonal part for each candidate period; needs n >= 2 periods."""
    rows, long = long_form(df, spec)
    rows = rows.filter("value IS NOT NULL")
    keys, periods = list(long.keys), sorted({int(p) for p in periods if p >= 2})
    reach = max(periods) // 2 + 1
    parts = chunked(rows, long, before=reach, after=reach, rows_per_chunk=rows_per_chunk)
    parts = parts.having(parts.frame.withColumn("idx", parts.position))
    for p in periods:
        frame, trend = centred_mean(parts, "value", p)
        parts = parts.having(drop_moments(frame.withColumn(f"_t{p}", trend)))
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(p).cast("bigint").alias("period"),
            F.pmod(F.col("idx"), F.lit(p).cast("bigint")).alias("phase"),
            (F.col("value") - F.col(f"_t{p}")).alias("d"),
        )
        for p in periods
    ]))
    detrended = parts.trim(parts.frame).select(*keys, cells.alias("_c")).select(*keys, "_c.*")
    phases = detrended.groupBy(*keys, "period", "phase").agg(F.avg("d").alias("_m"), F.count("*").alias("_n"))
    out = phases.groupBy(*keys, "period").agg(
        (F.max("_m") - F.min("_m")).alias("seasonal_amplitude"), F.sum("_n").alias("n_obs")
    )
    return out.filter(F.col("n_obs") >= 2 * F.col("period")).drop("n_obs")


def seasonal_amplitude_of(df: DataFrame, spec: SeriesSpec, wanted: DataFrame, rows_per_chunk: int | None = None) -> DataFrame:
    """Like ``seasonal_amplitude``, each series with its own periods: ``wanted`` has keys, signal, period.

    Centred means are differences of one running sum, fetched by position, so any number of series
    and periods takes the same few joins.
    """
    rows, long = long_form(df, spec)
    rows = rows.filter("value IS NOT NULL")
    keys = list(long.keys)
    stats, profile = measured(rows, keys, _mean=F.avg("value"))
    own = freeze(wanted.filter("period >= 2").select(*keys, F.col("period").cast("bigint").alias("period")).distinct())
    own = same_keys(own, stats.select(*keys, "n_obs"), keys, "inner").filter(F.col("n_obs") >= 2 * F.col("period")).drop("n_obs")
    centred = attach(rows, stats.select(*keys, "_mean"), keys, profile).withColumn("_v", F.col("value") - F.col("_mean"))
    parts = chunked(centred.select(*keys, *long.order, "_v"), long, rows_per_chunk=rows_per_chunk, profile=profile)
    parts = running_total(parts.having(parts.frame.withColumn("idx", parts.position)), F.col("_v"), "_total")
    base = freeze(parts.trim(parts.frame).select(*keys, "idx", "_v", "_total"))
    at = same_keys(base, broadcast_if_small(freeze(own)), keys, "inner").withColumn("_half", F.floor(F.col("period") / 2))
    ends = base.select(*keys, F.col("idx").alias("_pos"), F.col("_v").alias("_e"), F.col("_total").alias("_t"))

    def fetched(rows, position, **names):
        side = ends.select(*keys, "_pos", *[F.col(c).alias(n) for c, n in names.items()])
        return same_keys(rows.withColumn("_pos", position), side, [*keys, "_pos"], "left").drop("_pos")

    at = fetched(at, F.col("idx") + F.col("_half"), _e="_last", _t="_upto")
    at = fetched(at, F.col("idx") - F.col("_half"), _e="_first", _t="_from")
    even = F.when(F.col("period") % 2 == 0, (F.col("_first") + F.col("_last")) / 2).otherwise(0.0)
    trend = (F.col("_upto") - F.col("_from") + F.col("_first") - even) / F.col("period")
    phases = at.groupBy(*keys, "period", (F.col("idx") % F.col("period")).alias("phase")).agg(F.avg(F.col("_v") - trend).alias("_m"))
    return phases.groupBy(*keys, "period").agg((F.max("_m") - F.min("_m")).alias("seasonal_amplitude"))
