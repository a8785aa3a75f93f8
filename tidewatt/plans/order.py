"""Exact time order inside a series without putting the series into one partition.

A series that fits one task is windowed by its key. A larger one is cut into cells between sampled
rows, compared by the whole order (time, tie-break, row), the cells are counted, and running
counts over that small table give every cell its position. Consecutive cells form chunks of
bounded size; cells next to a chunk border are copied into the neighbour when an operator
looks back or ahead. Rows then need a single shuffle on (series, chunk).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.plans.sizing import ROWS_PER_CHUNK, KeyProfile, broadcast_if_small, same_keys
from tidewatt.session import freeze
from tidewatt.spec import SeriesSpec

CHUNK, OWN, BASE, END, SPLIT, CELL, TIE = "_chunk", "_own", "_base", "_end", "_split", "_cell", "_tie"
CELLS_PER_CHUNK = 16
# Splitters of one cell at most (a located row carries them for a moment, so they are few), and sampled rows per splitter.
FAN_OUT, OVERSAMPLE = 48, 8
# End of the last chunk of a series that is not cut.
LAST = 2**62


def order_key(df: DataFrame, order) -> Column:
    """The row's place in the order as one comparable value: nulls last, ties told apart by a hash of the row.

    Spark compares the fields themselves, so any type that can be sorted counts in full.
    """
    kinds = dict(df.dtypes)
    fields = []
    for i, name in enumerate(order):
        fields += [F.col(name).isNull().alias(f"n{i}"), F.col(name).alias(f"c{i}")]
    rest = [F.col(f"`{c}`") for c in df.columns if not kinds[c].startswith(("map", "variant"))]
    return F.struct(*fields, F.xxhash64(*rest).alias("hash"))


def _place(splits: Column, key: Column) -> Column:
    """Twice the number of splitters below the key, plus one if the key equals a splitter (binary search)."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(FAN_OUT.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(splits, at + step - 1) < key, at + step).otherwise(at))
    return F.transform(F.array(below), lambda at: 2 * at + F.coalesce((F.get(splits, at) == key).cast("int"), F.lit(0)))[0].cast("bigint")


@dataclass(frozen=True)
class Cells:
    """Row order of the large groups as counted cells, and how rows find their cell."""

    keys: tuple[str, ...]
    key: Column
    rules: tuple[DataFrame, ...]
    leaves: DataFrame
    rows_per_chunk: int

    def locate(self, df: DataFrame, how: str = "left") -> DataFrame:
        """Add the cell path (empty for rows of groups that fit one task) and the hash that tells ties apart."""
        out = df.select("*", self.key.alias("_key")).withColumn(CELL, F.array().cast("array<bigint>"))
        for level, rule in enumerate(self.rules):
            join_on = list(self.keys) + ([CELL] if level else [])
            rule = rule if level else rule.drop(CELL)
            out = same_keys(out, rule, join_on, how if level == 0 else "left")
            deeper = F.concat(F.col(CELL), F.array(_place(F.col("_splits"), F.col("_key"))))
            out = out.withColumn(CELL, F.when(F.col("_splits").isNull(), F.col(CELL)).otherwise(deeper)).drop("_splits")
        return out.withColumn(TIE, F.col("_key")["hash"]).drop("_key")


def _splitters(rows: DataFrame, over: DataFrame, key: Column, keys, limit: int) -> DataFrame:
    """For each over-full cell, sampled keys that cut it into cells of about ``limit / CELLS_PER_CHUNK`` rows.

    The sample is random, but the splitters are written once and every choice of them gives the same order.
    """
    parts = F.least(F.lit(FAN_OUT).cast("bigint"), F.ceil(F.col("_n") * F.lit(CELLS_PER_CHUNK) / F.lit(limit)))
    wanted = over.select(*keys, CELL, parts.alias("_parts"), (parts * OVERSAMPLE / F.col("_n")).alias("_chance"))
    drawn = same_keys(rows.select("*", key.alias("_key")), broadcast_if_small(wanted), [*keys, CELL], "inner").withColumn("_u", F.rand(17))
    some = drawn.groupBy(*keys, CELL).agg(
        F.first("_parts").alias("_parts"), F.collect_list(F.when(F.col("_u") < F.col("_chance"), F.col("_key"))).alias("_some"), F.min_by("_key", "_u").alias("_one")
    )
    some = some.withColumn("_some", F.array_sort(F.array_distinct(F.concat("_some", F.array("_one")))))
    size = F.size("_some").cast("bigint")
    count = F.least("_parts", size)
    picks = F.transform(F.sequence(F.lit(1).cast("bigint"), count), lambda i: F.get("_some", F.floor(i * size / (count + 1)).cast("int")))
    return freeze(some.select(*keys, CELL, F.array_distinct(picks).alias("_splits")))


def count_cells(df: DataFrame, keys, order, rows_per_chunk: int | None = None) -> Cells | None:
    """Cut groups larger than a chunk into counted cells; None when every group fits.

    An over-full cell is cut by splitters sampled from its rows; rows equal to a splitter form a cell of their own,
    so every cut makes progress, and the loop refines only cells that are still too large. There are about ``CELLS_PER_CHUNK * rows /
    rows_per_chunk`` cells. Rows equal in the whole order have no order among themselves, so they are told apart by a
    hash of the row. A group of equal rows cannot be cut and stays whole. The lowest and highest value of the first
    order column of each cell are kept as ``_lo0`` and ``_hi0``.
    """
    keys = tuple(keys)
    key = order_key(df, order)
    limit = rows_per_chunk or ROWS_PER_CHUNK
    first = F.col(order[0])

    def measure(frame):
        return frame.groupBy(*keys, CELL).agg(F.count("*").alias("_n"), F.min(first).alias("_lo0"), F.max(first).alias("_hi0"))

    start = df.withColumn(CELL, F.array().cast("array<bigint>"))
    whole = start.groupBy(*keys, CELL).agg(F.count("*").alias("_n")).persist()
    try:
        largest = whole.agg(F.max("_n")).first()[0] or 0
        if largest <= limit:
            return None
        over = freeze(whole.filter(F.col("_n") > limit))
    finally:
        whole.unpersist()

    rules, leaves, located = [], None, start
    while True:
        rules.append(broadcast_if_small(_splitters(located, over, key, keys, limit)))
        located = Cells(keys, key, tuple(rules), None, limit).locate(df, "inner")
        sizes = freeze(measure(located.filter(F.size(CELL) == len(rules))))
        open_ = (F.col("_n") > limit) & (F.element_at(CELL, -1) % 2 == 0)
        done = sizes.filter(~open_)
        leaves = done if leaves is None else leaves.unionByName(done)
        over = sizes.filter(open_)
        if over.isEmpty():
            break
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    running = by_key.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("_start", F.coalesce(F.sum("_n").over(running), F.lit(0)))
    return Cells(keys, key, tuple(rules), freeze(leaves), limit)


@dataclass(frozen=True)
class Chunked:
    """Rows ready for ordered windows; ``frame`` may hold copies that ``trim`` drops again."""

    frame: DataFrame
    spec: SeriesSpec
    split: bool

    @property
    def groups(self) -> list:
        extra = [CHUNK] if self.split else []
        return [*self.spec.keys, *extra] or [F.lit(0)]

    @property
    def sorting(self) -> list[str]:
        """Rows equal in the whole order are cut by a hash; chunks must then sort by it as well."""
        return [*self.spec.order, *([TIE] if self.split else [])]

    @property
    def window(self):
        return Window.partitionBy(*self.groups).orderBy(*[F.col(c).asc_nulls_last() for c in self.sorting])

    @property
    def reverse(self):
        return Window.partitionBy(*self.groups).orderBy(*[F.col(c).desc_nulls_first() for c in self.sorting])

    @property
    def position(self) -> Column:
        """Zero-based row number inside the whole series."""
        number = F.row_number().over(self.window).cast("bigint") - F.lit(1).cast("bigint")
        return number + F.col(BASE) if self.split else number

    def trim(self, df: DataFrame) -> DataFrame:
        if not self.split:
            return df
        return df.filter(F.col(OWN)).drop(CHUNK, OWN, BASE, END, SPLIT, TIE)

    def having(self, frame: DataFrame) -> "Chunked":
        return Chunked(frame, self.spec, self.split)


def chunked(
    df: DataFrame,
    spec: SeriesSpec,
    before: int = 0,
    after: int = 0,
    rows_per_chunk: int | None = None,
    profile: KeyProfile | None = None,
) -> Chunked:
    """Prepare rows for windows that look at most ``before`` rows back and ``after`` ahead.

    Rows without a timestamp have no place in the order and are dropped. A ``profile`` of
    the same groups that shows they all fit one task saves the counting job.
    """
    df = df.filter(F.col(spec.ts).isNotNull())
    fits = profile is not None and profile.largest <= (rows_per_chunk or ROWS_PER_CHUNK)
    cells = None if fits else count_cells(df, spec.keys, spec.order, rows_per_chunk)
    if cells is None:
        return Chunked(df, spec, False)
    size = F.lit(cells.rows_per_chunk)
    keys = list(spec.keys)
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    own = F.floor(F.col("_start") / size)
    last = F.floor((F.col("_start") + F.col("_n") + F.lit(before - 1)) / size) if before else own
    first = F.floor((F.col("_start") - F.max("_n").over(by_key) - F.lit(after)) / size) if after else own
    placed = cells.leaves.select(
        *keys,
        CELL,
        "_start",
        "_n",
        own.alias("_home"),
        F.greatest(F.lit(0).cast("bigint"), first).alias("_first"),
        F.greatest(own, last).alias("_last"),
    ).withColumn(CHUNK, F.explode(F.sequence("_first", "_last")))
    layout = freeze(
        placed.select(
            *keys,
            CELL,
            CHUNK,
            (F.col(CHUNK) == F.col("_home")).alias(OWN),
            F.min("_start").over(Window.partitionBy(*keys, CHUNK)).alias(BASE),
            F.max(F.col("_start") + F.col("_n")).over(Window.partitionBy(*keys, CHUNK)).alias(END),
        )
    )
    frame = same_keys(cells.locate(df), broadcast_if_small(layout), [*keys, CELL])
    frame = (
        frame.withColumn(SPLIT, F.col(CHUNK).isNotNull())
        .withColumn(CHUNK, F.coalesce(CHUNK, F.lit(0).cast("bigint")))
        .withColumn(OWN, F.coalesce(OWN, F.lit(True)))
        .withColumn(BASE, F.coalesce(BASE, F.lit(0).cast("bigint")))
        .withColumn(END, F.coalesce(END, F.lit(LAST)))
        .drop(CELL)
    )
    return Chunked(frame, spec, True)


def per_chunk(parts: Chunked, values: dict[str, Column], compute, outputs: str) -> DataFrame:
    """Reduce every chunk with numpy: ``compute(first_own, columns)`` returns one row's fields.

    ``columns`` holds the named values in time order; rows before ``first_own`` are copies
    of the previous chunk's last rows. Only these values are sent to the Python worker, and
    a chunk holds a bounded number of rows. Needs a frame without look-ahead copies.
    """
    keys = list(parts.spec.keys)
    groups = [c for c in parts.groups if isinstance(c, str)]
    kinds = dict(parts.frame.dtypes)
    order = [F.unix_micros(F.col(c).cast("timestamp")) if kinds[c].startswith("timestamp") else F.col(c) for c in parts.sorting]
    marks = [f"_o{i}" for i in range(len(order))]
    own = F.col(OWN) if parts.split else F.lit(True)
    slim = parts.frame.select(
        *groups, own.alias("_mine"), *[a.alias(m) for a, m in zip(order, marks)], *[v.alias(n) for n, v in values.items()]
    )

    names = list(values)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(marks)
        mine = pdf["_mine"].to_numpy()
        row = {k: [pdf[k].iloc[0]] for k in keys}
        first = int(np.argmax(mine)) if mine.any() else len(mine)
        fields = compute(first, {n: pdf[n].to_numpy() for n in names})
        return pd.DataFrame({**row, **{n: [v] for n, v in fields.items()}})

    kinds = dict(slim.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], outputs])
    return slim.groupBy(*groups).applyInPandas(run, schema)


def with_position(
    df: DataFrame, spec: SeriesSpec, name: str = "idx", rows_per_chunk: int | None = None, profile: KeyProfile | None = None
) -> DataFrame:
    """Zero-based row number per series in time order."""
    parts = chunked(df, spec, rows_per_chunk=rows_per_chunk, profile=profile)
    return parts.trim(parts.frame.withColumn(name, parts.position))


def running_total(parts: Chunked, value: Column, name: str) -> Chunked:
    """Add ``name``: the sum of a value over all rows of the series up to the current one."""
    upto = parts.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frame = parts.frame.withColumn(name, F.coalesce(F.sum(value).over(upto), F.lit(0.0)))
    if not parts.split:
        return parts.having(frame)
    keys = list(parts.spec.keys)
    sums = parts.frame.filter(F.col(SPLIT) & F.col(OWN)).groupBy(*keys, CHUNK).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_sum"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    past = by_key.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = freeze(sums.select(*keys, CHUNK, F.coalesce(F.sum("_sum").over(past), F.lit(0.0)).alias("_before")))
    joined = same_keys(frame, broadcast_if_small(before), [*keys, CHUNK])
    return parts.having(joined.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0.0))).drop("_before"))


def known_neighbours(parts: Chunked, signals, x: str) -> DataFrame:
    """For each signal, the nearest known (x, v) at or before and at or after every row.

    Adds ``_prev_<signal>`` and ``_next_<signal>`` structs. Inside a chunk these are plain
    windows; across chunks the first and last known points of each chunk (a table of at
    most a few rows per chunk) are carried over.
    """
    upto = parts.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Looking ahead is looking back in reverse order: Spark re-reads the rest of the group
    # for every row of a frame that ends at UNBOUNDED FOLLOWING.
    onward = parts.reverse.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = {s: F.col(f"`{s}`").cast("double") for s in signals}
    point = {s: F.when(v.isNotNull() & ~F.isnan(v), F.struct(F.col(x).alias("x"), v.alias("v"))) for s, v in value.items()}
    out = parts.frame.select(
        "*",
        *[F.last(point[s], True).over(upto).alias(f"_prev_{s}") for s in signals],
        *[F.last(point[s], True).over(onward).alias(f"_next_{s}") for s in signals],
    )
    if not parts.split:
        return out
    keys = list(parts.spec.keys)
    edges = (
        parts.frame.filter(F.col(SPLIT) & F.col(OWN))
        .groupBy(*keys, CHUNK)
        .agg(
            *[F.max(point[s]).alias(f"_end_{s}") for s in signals],
            *[F.min(point[s]).alias(f"_top_{s}") for s in signals],
        )
    )
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    past = by_key.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    future = by_key.orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *keys,
        CHUNK,
        *[F.last(f"_end_{s}", True).over(past).alias(f"_past_{s}") for s in signals],
        *[F.last(f"_top_{s}", True).over(future).alias(f"_future_{s}") for s in signals],
    )
    joined = same_keys(out, broadcast_if_small(freeze(carried)), [*keys, CHUNK])
    for s in signals:
        joined = joined.withColumn(f"_prev_{s}", F.coalesce(f"_prev_{s}", f"_past_{s}")).withColumn(
            f"_next_{s}", F.coalesce(f"_next_{s}", f"_future_{s}")
        )
    return joined.drop(*[f"_past_{s}" for s in signals], *[f"_future_{s}" for s in signals])
