"""Data-quality aggregates and table summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidewatt.functions.timestamps import parse_timestamp
from tidewatt.functions.values import quoted, replace_columns
from tidewatt.plans.quantiles import known, quantile_wide
from tidewatt.plans.sizing import KeyProfile, same_keys
from tidewatt.spec import SeriesSpec

# Copies of one row written by one task when duplicates are listed.
COPIES_PER_TASK = 1_000_000


def long_rows(wide: DataFrame, keys, names, fields, label: str = "column") -> DataFrame:
    """One aggregate row with ``<name>#<field>`` columns becomes one row per name."""
    rows = [
        F.struct(F.lit(n).alias(label), *[F.col(f"`{n}#{f}`").alias(f) for f in fields]) for n in names
    ]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def drop_invalid_timestamps(df: DataFrame, column: str, formats=None) -> DataFrame:
    """Parse a text timestamp and keep the rows that parse."""
    parsed = parse_timestamp(column, formats) if formats else parse_timestamp(column)
    return replace_columns(df, {column: parsed}).filter(F.col(column).isNotNull())


def invalid_timestamps(df: DataFrame, column: str, formats=None) -> DataFrame:
    """The texts that are present but are no timestamps."""
    parsed = parse_timestamp(column, formats) if formats else parse_timestamp(column)
    return df.filter(F.col(column).isNotNull() & parsed.isNull()).select(column)


def timestamp_report(df: DataFrame, column: str, formats=None) -> DataFrame:
    """Rows, rows kept and rows removed by timestamp validation."""
    parsed = parse_timestamp(column, formats) if formats else parse_timestamp(column)
    return df.agg(
        F.count("*").alias("n_rows"), F.count(parsed).alias("kept"), (F.count("*") - F.count(parsed)).alias("removed")
    )


def null_counts(df: DataFrame, columns=None) -> DataFrame:
    columns = list(columns or df.columns)
    wide = df.agg(*[F.count_if(quoted(c).isNull()).alias(f"{c}#null_count") for c in columns])
    return long_rows(wide, [], columns, ["null_count"])


def column_issues(df: DataFrame, ts: str | None = None, formats=None) -> DataFrame:
    """Per column: type, nulls, infinities (floating columns) and unparsable timestamps."""
    aggs = []
    for field in df.schema.fields:
        c, name = quoted(field.name), field.name
        floating = isinstance(field.dataType, (T.FloatType, T.DoubleType))
        infinite = F.count_if(c.isin(float("inf"), float("-inf"))) if floating else F.lit(0).cast("bigint")
        errors = F.lit(0).cast("bigint")
        if name == ts and isinstance(field.dataType, T.StringType):
            parsed = parse_timestamp(c, formats) if formats else parse_timestamp(c)
            errors = F.count_if(parsed.isNull())
        elif name == ts:
            errors = F.count_if(c.isNull())
        aggs += [
            F.lit(field.dataType.simpleString()).alias(f"{name}#dtype"),
            F.count_if(c.isNull()).alias(f"{name}#null_count"),
            infinite.alias(f"{name}#inf_count"),
            errors.alias(f"{name}#datetime_parse_errors"),
        ]
    fields = ["dtype", "null_count", "inf_count", "datetime_parse_errors"]
    return long_rows(df.agg(F.count("*").alias("_n"), *aggs), [], df.columns, fields)


def dataset_summary(df: DataFrame, ts: str | None = None) -> DataFrame:
    """Rows, columns, cells, time range and column list."""
    n_columns = len(df.columns)
    span = [F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")] if ts else []
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(n_columns).cast("bigint").alias("n_columns"),
        (F.count("*") * n_columns).alias("total_cells"),
        *span,
        F.lit(",".join(df.columns)).alias("columns"),
    )


def file_size_mb(df: DataFrame) -> DataFrame:
    """Size of the files behind a file-backed frame, in MB."""
    files = df.groupBy("_metadata.file_path").agg(F.max("_metadata.file_size").alias("_bytes"))
    return files.agg(F.round(F.sum("_bytes") / (1024 * 1024), 2).alias("file_size_mb"))


def missing_percent(df: DataFrame, columns) -> DataFrame:
    """Share of missing values per column in percent."""
    wide = df.agg(*[(100 * F.avg(quoted(c).isNull().cast("double"))).alias(f"{c}#missing_pct") for c in columns])
    return long_rows(wide, [], columns, ["missing_pct"])


def basic_stats(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Minimum, maximum, mean and sample deviation per key and signal."""
    aggs = []
    for s in spec.signals:
        v = known(quoted(s))
        for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp)):
            aggs.append(f(v).alias(f"{s}#{name}"))
    wide = df.groupBy(*spec.keys).agg(*aggs)
    return long_rows(wide, spec.keys, spec.signals, ["min", "max", "mean", "std"], "signal")


def describe(df: DataFrame, spec: SeriesSpec, profile: KeyProfile | None = None, rows_per_chunk: int | None = None) -> DataFrame:
    """count, null_count, mean, std, min, quartiles (linear interpolation) and max."""
    keys = list(spec.keys)
    aggs = []
    for s in spec.signals:
        v = known(quoted(s))
        aggs += [
            F.count(v).alias(f"{s}#count"),
            F.count_if(v.isNull()).alias(f"{s}#null_count"),
            F.avg(v).alias(f"{s}#mean"),
            F.stddev_samp(v).alias(f"{s}#std"),
            F.min(v).alias(f"{s}#min"),
            F.max(v).alias(f"{s}#max"),
        ]
    moments = df.groupBy(*keys).agg(*aggs)
    quartiles = quantile_wide(df, keys, spec.signals, [0.25, 0.5, 0.75], profile, rows_per_chunk)
    quartiles = quartiles.select(
        *keys,
        *[quoted(s)[i].alias(f"{s}#{q}") for s in spec.signals for i, q in enumerate(("q25", "q50", "q75"))],
    )
    fields = ["count", "null_count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    return long_rows(same_keys(moments, quartiles, keys), keys, spec.signals, fields, "signal")


def duplicate_timestamps(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Timestamps that occur more than once, per series."""
    return df.groupBy(*spec.keys, spec.ts).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every occurrence of rows that occur more than once.

    Equal rows are interchangeable, so they are counted with map-side combine and written
    out again from the count; a large group of copies never meets in one task.
    """
    columns = [quoted(c) for c in df.columns]
    groups = df.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1")
    blocks = groups.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPIES_PER_TASK)))
    )
    copies = F.least(F.lit(COPIES_PER_TASK).cast("bigint"), F.col("_n") - F.col("_block") * COPIES_PER_TASK)
    spread = blocks.repartition("_block", *columns)
    return spread.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).select(*columns)


def value_counts(df: DataFrame, columns) -> DataFrame:
    """Occurrences of each value of the text columns."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("_c")).groupBy("_c.column", "_c.value").agg(F.count("*").alias("n"))


def sample_rows(df: DataFrame, key_columns, n: int = 50_000, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones on every run: those of smallest hash.

    A hash bound that leaves about ``n`` rows is applied first, so the final top-n does not
    gather ``n`` rows from every partition. The bound is widened until enough rows pass.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_columns])
    hashed = df.withColumn("_h", F.md5(text))
    total = df.count()
    keep = n + 10 * n**0.5 + 100
    while keep < total:
        bound = f"{int(keep / total * 16**12):012x}"
        close = hashed.filter(F.col("_h") < bound)
        if close.count() >= n:
            hashed = close
            break
        keep *= 2
    return hashed.orderBy("_h", *key_columns).limit(n).drop("_h")


def variance_rank(df: DataFrame, columns, k: int = 10) -> DataFrame:
    """The ``k`` columns of largest sample variance."""
    wide = df.agg(*[F.var_samp(known(quoted(c))).alias(f"{c}#variance") for c in columns])
    return long_rows(wide, [], columns, ["variance"]).orderBy(F.desc_nulls_last("variance"), "column").limit(k)


def extremes_with_time(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Sum, mean of hourly means, and the largest and smallest value with their first times."""
    keys = list(spec.keys)
    hour = F.date_trunc("hour", spec.ts)
    per_hour, final = [], []
    for s in spec.signals:
        v, t = known(quoted(s)), F.col(spec.ts)
        at = F.when(v.isNotNull(), t)
        per_hour += [
            F.sum(v).alias(f"{s}#s"),
            F.avg(v).alias(f"{s}#m"),
            F.min(F.when(v.isNotNull(), F.struct((-v).alias("v"), at.alias("t")))).alias(f"{s}#hi"),
            F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), at.alias("t")))).alias(f"{s}#lo"),
        ]
        hi, lo = F.min(quoted(f"{s}#hi")), F.min(quoted(f"{s}#lo"))
        final += [
            F.sum(quoted(f"{s}#s")).alias(f"{s}#total"),
            F.avg(quoted(f"{s}#m")).alias(f"{s}#mean_hourly"),
            (-hi["v"]).alias(f"{s}#max_value"),
            hi["t"].alias(f"{s}#time_of_max"),
            lo["v"].alias(f"{s}#min_value"),
            lo["t"].alias(f"{s}#time_of_min"),
        ]
    hourly = df.filter(F.col(spec.ts).isNotNull()).groupBy(*keys, hour.alias("_hour")).agg(*per_hour)
    fields = ["total", "mean_hourly", "max_value", "time_of_max", "min_value", "time_of_min"]
    return long_rows(hourly.groupBy(*keys).agg(*final), keys, spec.signals, fields, "signal")


def distinct_dates(df: DataFrame, ts: str, first_n: int | None = None) -> DataFrame:
    dates = df.select(F.to_date(ts).alias("date")).filter("date IS NOT NULL").distinct()
    return dates.orderBy("date").limit(first_n) if first_n else dates


def any_null(columns):
    return reduce(lambda a, b: a | b, [quoted(c).isNull() for c in columns])
