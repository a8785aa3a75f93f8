"""Size limits and the joins whose strategy depends on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewatt.session import freeze

# Rows that one window group may hold before a series is cut into chunks.
ROWS_PER_CHUNK = 100_000
# Values (rows times columns, about 8 bytes each) a table may have to be broadcast.
BROADCAST_VALUES = 8_000_000
# Values per group up to which the built-in exact percentile is used; it keeps them all in
# memory, for up to 128 groups per task.
PERCENTILE_VALUES = 200_000
# Entries an array column is taken to hold when a table's size is estimated.
ARRAY_ENTRIES = 100


@dataclass(frozen=True)
class KeyProfile:
    """Row count of a table, number of its key groups, rows in the largest one."""

    rows: int
    groups: int
    largest: int


def profile_keys(df: DataFrame, keys) -> KeyProfile:
    """Measure group sizes: one column-pruned count with map-side combine."""
    if not keys:
        rows = df.count()
        return KeyProfile(rows, 1, rows)
    sizes = df.groupBy(*keys).count()
    row = sizes.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("rows"),
        F.count("*").alias("groups"),
        F.coalesce(F.max("count"), F.lit(0)).alias("largest"),
    ).first()
    return KeyProfile(row["rows"], row["groups"], row["largest"])


def measured(df: DataFrame, keys, **aggregates: Column) -> tuple[DataFrame, KeyProfile]:
    """Per-key aggregates plus the row count ``n_obs``, computed once, and the sizes they show.

    The table is written to the shared folder, so the scan behind it is not repeated by the
    operators that use it, and its counts decide how they do.
    """
    columns = [e.alias(name) for name, e in aggregates.items()]
    table = freeze(df.groupBy(*keys).agg(F.count("*").alias("n_obs"), *columns))
    row = table.agg(
        F.coalesce(F.sum("n_obs"), F.lit(0)).alias("rows"), F.count("*").alias("groups"), F.coalesce(F.max("n_obs"), F.lit(0)).alias("largest")
    ).first()
    return table, KeyProfile(row["rows"], row["groups"], row["largest"])


def fits_broadcast(table: DataFrame, rows: int) -> bool:
    """Whether a table with this many rows may be broadcast, by its columns and their kind."""
    width = sum(ARRAY_ENTRIES if kind.startswith("array") else 4 if kind == "string" else 1 for _, kind in table.dtypes)
    return rows * width <= BROADCAST_VALUES


def measured_values(table: DataFrame) -> float:
    """What a table holds, in values of 8 bytes: texts and nested columns by their bytes, all else by rows."""
    plain, bytes_ = 0, []
    for name, kind in table.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            bytes_.append(F.sum(F.octet_length(column)))
        elif kind.startswith(("array", "struct", "map")):
            bytes_.append(F.sum(F.octet_length(F.to_json(F.struct(column)))))
        else:
            plain += 1
    rows, *sizes = table.agg(F.count("*"), *bytes_).first()
    return rows * plain + sum(s or 0 for s in sizes) / 8


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """Hint a written table for broadcast if its measured size allows; else the join shuffles."""
    return F.broadcast(table) if measured_values(table) <= BROADCAST_VALUES else table


def same_keys(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join on keys where null equals null; the right side's key columns are dropped."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    condition: Column | None = None
    for key in keys:
        part = F.col(key).eqNullSafe(F.col(f"_r_{key}"))
        condition = part if condition is None else condition & part
    # Without keys every row matches; an outer join then keeps the left rows even if the right is empty.
    joined = left.join(renamed, F.lit(True) if condition is None else condition, how)
    return joined.drop(*[f"_r_{key}" for key in keys])


def attach(df: DataFrame, per_key: DataFrame, keys, profile: KeyProfile | None = None) -> DataFrame:
    """Add the columns of a one-row-per-key table to every row.

    The table is broadcast when it is known to be small. With more keys than that, the keys
    too large for one task (at most ``rows / ROWS_PER_CHUNK``) are broadcast while they fit, and
    all other rows use a shuffle join; with very many such keys all rows do.
    """
    keys = list(keys)
    if not keys:
        return df.crossJoin(F.broadcast(per_key))
    profile = profile or profile_keys(df, keys)
    if fits_broadcast(per_key, profile.groups):
        return same_keys(df, F.broadcast(per_key), keys)
    if profile.largest <= ROWS_PER_CHUNK:
        return same_keys(df, per_key, keys)
    large = freeze(df.groupBy(*keys).count().filter(F.col("count") > ROWS_PER_CHUNK).drop("count"))
    n_large = large.count()
    if not (fits_broadcast(large, n_large) and fits_broadcast(per_key, n_large)):
        return same_keys(df, per_key, keys)
    flagged = same_keys(df, F.broadcast(large.withColumn("_large", F.lit(True))), keys)
    large_stats = same_keys(per_key, F.broadcast(large.withColumn("_large", F.lit(True))), keys, "inner")
    heavy = same_keys(flagged.filter("_large").drop("_large"), F.broadcast(large_stats.drop("_large")), keys)
    light = same_keys(flagged.filter("_large IS NULL").drop("_large"), per_key, keys)
    return heavy.unionByName(light)
