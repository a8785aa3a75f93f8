"""Missing values, sentinels and column selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: the placeholder telemetry files use for "no reading".
SENTINEL = -999999.0

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def detect_timestamp_column(df: DataFrame, required: bool = False) -> str | None:
    """First column named like a time or date, else the first of a temporal type."""
    for field in df.schema.fields:
        name = field.name.lower()
        if "time" in name or "date" in name:
            return field.name
    for field in df.schema.fields:
        if isinstance(field.dataType, TEMPORAL):
            return field.name
    if required:
        raise ValueError("no timestamp column found")
    return None


def split_columns_by_type(df: DataFrame, skip=()) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the text columns."""
    fields = [f for f in df.schema.fields if f.name not in skip]
    numeric = [f.name for f in fields if isinstance(f.dataType, NUMERIC)]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    return numeric, text


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace or add columns in one projection, keeping the column order."""
    kept = [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept, *[e.alias(c) for c, e in new.items() if c not in df.columns])


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def lowercase_columns(df: DataFrame) -> DataFrame:
    lowered = [c.lower() for c in df.columns]
    if len(set(lowered)) < len(lowered):
        raise ValueError("column names differ only in case")
    return df.toDF(*lowered)


def project_available(df: DataFrame, columns, require_any: bool = True) -> DataFrame:
    """Keep the wanted columns that exist, in the wanted order."""
    present = [c for c in columns if c in df.columns]
    if require_any and not present:
        raise ValueError("none of the wanted columns exist")
    return df.select(*[quoted(c) for c in present])


def require(df: DataFrame, columns) -> DataFrame:
    """Keep exactly these columns; missing ones are an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing required columns: {missing}")
    return df.select(*[quoted(c) for c in columns])


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    """Text to double; what is not a number becomes null."""
    return replace_columns(df, {c: quoted(c).try_cast("double") for c in columns})


def is_sentinel(value: Column, values=(SENTINEL,), at_or_below: float | None = None) -> Column:
    found = value.isin(*[float(v) for v in values]) if at_or_below is None else value <= at_or_below
    return F.coalesce(found, F.lit(False))


def sentinel_to_null(df: DataFrame, columns, values=(SENTINEL,), at_or_below: float | None = None) -> DataFrame:
    """Exact placeholder values, or everything at or below a bound, become null."""
    return replace_columns(
        df, {c: F.when(~is_sentinel(quoted(c), values, at_or_below), quoted(c)) for c in columns}
    )


def nan_to_null(df: DataFrame, columns) -> DataFrame:
    return replace_columns(df, {c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in columns})


def drop_null_rows(df: DataFrame, subset) -> DataFrame:
    return df.na.drop(subset=list(subset))


def fill_null(df: DataFrame, columns, value: float = 0.0) -> DataFrame:
    """Null and NaN become the value."""
    floats = {c for c, kind in df.dtypes if kind in ("float", "double")}
    present = {c: F.when(~F.isnan(quoted(c)), quoted(c)) if c in floats else quoted(c) for c in columns}
    return replace_columns(df, {c: F.coalesce(v, F.lit(value)) for c, v in present.items()})


def add_missing_columns(df: DataFrame, columns, kind: str = "double") -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    return df.select("*", *[F.lit(None).cast(kind).alias(c) for c in absent])


def clip_negative(df: DataFrame, columns) -> DataFrame:
    return replace_columns(df, {c: F.when(quoted(c) < 0, 0.0).otherwise(quoted(c)) for c in columns})
