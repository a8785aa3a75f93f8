"""Fixed time buckets, gap-free resampling, step inference and calendar profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatt.functions.calendar import is_weekend, season
from tidewatt.functions.timestamps import MONDAY_US, from_micros, micros, tumbling, width_of
from tidewatt.functions.values import quoted
from tidewatt.operators.ordered import time_gaps
from tidewatt.operators.quality import any_null
from tidewatt.plans.quantiles import known, quantile_long
from tidewatt.spec import SeriesSpec

# Buckets generated by one task when empty buckets are filled in.
BUCKETS_PER_BLOCK = 10_000


def means(spec: SeriesSpec) -> list[Column]:
    return [F.avg(known(quoted(s))).alias(s) for s in spec.signals]


def bucket_mean(df: DataFrame, spec: SeriesSpec, every: str = "15 minutes") -> DataFrame:
    """Mean per non-empty window [start, start + every); one shuffle with map-side combine."""
    start = tumbling(spec.ts, width_of(every)).alias(spec.ts)
    return df.filter(F.col(spec.ts).isNotNull()).groupBy(*spec.keys, start).agg(*means(spec))


def resample_mean(df: DataFrame, spec: SeriesSpec, every: str) -> DataFrame:
    """Like ``bucket_mean``, and buckets without rows between first and last appear as null.

    The empty grid is generated in blocks (so one long series does not become one huge
    array) and joins the data before the aggregation, which needs no further shuffle.
    """
    width = width_of(every)
    keys = list(spec.keys)
    data = df.filter(F.col(spec.ts).isNotNull()).select(
        *keys, tumbling(spec.ts, width).alias(spec.ts), *[known(quoted(s)).alias(s) for s in spec.signals]
    )
    at = micros(spec.ts)
    span = data.groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    step = F.lit(width).cast("bigint")
    block = step * BUCKETS_PER_BLOCK
    blocks = span.withColumn("_from", F.explode(F.sequence("_lo", "_hi", block))).repartition(*keys, "_from")
    upto = F.least(F.col("_hi"), F.col("_from") + block - step)
    grid = blocks.withColumn("_at", F.explode(F.sequence("_from", upto, step))).select(
        *keys,
        from_micros(F.col("_at")).alias(spec.ts),
        *[F.lit(None).cast("double").alias(s) for s in spec.signals],
    )
    return data.unionByName(grid).groupBy(*keys, spec.ts).agg(*[F.avg(s).alias(s) for s in spec.signals])


def missing_fraction(df: DataFrame, spec: SeriesSpec, every: str = "1 day") -> DataFrame:
    """Share of rows with a null in any signal per period; weeks start on Monday."""
    width = width_of(every)
    origin = MONDAY_US if width % width_of("1 week") == 0 else 0
    return (
        df.filter(F.col(spec.ts).isNotNull())
        .groupBy(*spec.keys, tumbling(spec.ts, width, origin).alias("period_start"))
        .agg(F.avg(any_null(spec.signals).cast("double")).alias("missing_fraction"))
    )


def step_alias(seconds: Column) -> Column:
    """Whole days, hours, minutes or seconds as a short text such as 15T."""
    def part(unit: int, letter: str):
        return F.concat((seconds / unit).cast("bigint").cast("string"), F.lit(letter))

    return (
        F.when(F.pmod(seconds, F.lit(86_400)) == 0, part(86_400, "D"))
        .when(F.pmod(seconds, F.lit(3_600)) == 0, part(3_600, "H"))
        .when(F.pmod(seconds, F.lit(60)) == 0, part(60, "T"))
        .otherwise(part(1, "S"))
    )


def infer_step_median(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Median difference of consecutive timestamps, rounded to seconds, with its alias."""
    gaps = time_gaps(df, spec, "_gap").filter("_gap IS NOT NULL")
    median = quantile_long(gaps, spec.keys, "_gap", [0.5]).select(*spec.keys, F.col("quantiles")[0].alias("median_gap_sec"))
    seconds = F.rint("median_gap_sec").cast("bigint")
    return median.filter("median_gap_sec IS NOT NULL").withColumn("step_seconds", seconds).withColumn(
        "step_alias", step_alias(F.col("step_seconds"))
    )


def infer_step_mode(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Most frequent difference (the smallest on a tie) as seconds, hours and alias."""
    gaps = time_gaps(df, spec, "_gap").filter("_gap IS NOT NULL").groupBy(*spec.keys, "_gap").agg(F.count("*").alias("_n"))
    best = gaps.groupBy(*spec.keys).agg(F.max_by("_gap", F.struct("_n", -F.col("_gap"))).alias("step_seconds"))
    return best.withColumn("step_hours", F.col("step_seconds") / 3600).withColumn(
        "step_alias", step_alias(F.col("step_seconds").cast("bigint"))
    )


def adaptive_interval(df: DataFrame, spec: SeriesSpec, factor: int = 1000, first_rows: int | None = None) -> DataFrame:
    """Bucket width for thinning out a table: one row with ``interval_seconds``.

    ``factor`` times the median step when that is under a minute, else ``factor`` minutes;
    one hour for a table of fewer than two rows. ``first_rows`` looks at the start only.
    """
    table = SeriesSpec(spec.ts, (), spec.signals, spec.tie)
    if first_rows:
        df = df.orderBy(*table.order).limit(first_rows)
    gaps = time_gaps(df, table, "_gap").filter("_gap IS NOT NULL")
    median = quantile_long(gaps, (), "_gap", [0.5]).select(F.col("quantiles")[0].alias("median_gap_sec"))
    seconds = F.floor("median_gap_sec").cast("bigint")
    width = F.when(F.col("median_gap_sec").isNull(), F.lit(3600)).when(
        F.col("median_gap_sec") < 60, factor * seconds
    ).otherwise(factor * 60)
    return median.withColumn("interval_seconds", width.cast("bigint"))


def thin_out(df: DataFrame, spec: SeriesSpec, factor: int = 1000) -> DataFrame:
    """Bucket means at the adaptive width (one small value is read to choose the width)."""
    seconds = adaptive_interval(df, spec, factor).first()["interval_seconds"]
    return bucket_mean(df, spec, f"{max(seconds, 1)} seconds")


def hourly_profile(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean per hour of day."""
    return df.groupBy(*spec.keys, F.hour(spec.ts).cast("bigint").alias("hour")).agg(*means(spec))


def weekday_weekend_profile(df: DataFrame, spec: SeriesSpec, weekend_from: int = 6) -> DataFrame:
    """Mean per hour of day, split into working days and weekend."""
    kind = F.when(is_weekend(spec.ts, weekend_from), "weekend").otherwise("weekday").alias("day_type")
    return df.groupBy(*spec.keys, kind, F.hour(spec.ts).cast("bigint").alias("hour")).agg(*means(spec))


def season_profile(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean per hour of day for summer and winter; other months are left out."""
    rows = df.withColumn("season", season(spec.ts)).filter("season IS NOT NULL")
    return rows.groupBy(*spec.keys, "season", F.hour(spec.ts).cast("bigint").alias("hour")).agg(*means(spec))


def day_hour_heatmap(df: DataFrame, spec: SeriesSpec, signal: str) -> DataFrame:
    """One row per date with the mean of each hour in columns h00 to h23."""
    hour = F.hour(spec.ts)
    rows = df.filter(F.col(spec.ts).isNotNull() & known(quoted(signal)).isNotNull())
    return rows.groupBy(*spec.keys, F.to_date(spec.ts).alias("date")).agg(
        *[F.avg(F.when(hour == h, known(quoted(signal)))).alias(f"h{h:02d}") for h in range(24)]
    )


def run_per_month(df: DataFrame, spec: SeriesSpec, operator, *args, **options) -> DataFrame:
    """Apply an operator to every calendar month separately: the month is one more key."""
    month = F.to_date(F.date_trunc("month", spec.ts))
    return operator(df.withColumn("month", month), spec.with_keys("month"), *args, **options)
