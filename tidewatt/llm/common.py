"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import sys
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatt.session import freeze, shared_dir

#: Rows of a cell that one window task ranks.
ROWS_PER_CELL = 50_000
#: Bits of one block of a bitmap (Spark's size), and the largest bitmap that is broadcast.
BLOCK_BITS = 32_768
BITMAP_BYTES = 64_000_000
#: Links that one task joins at once.
LINKS_PER_TASK = 100_000
#: Removes the shuffle files of an action when it ends.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(df: DataFrame, **columns) -> DataFrame:
    """Only the named columns under fixed names, so that clashing extra columns do no harm."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def durable(df: DataFrame) -> DataFrame:
    """Write a table once to the folder all executors share and read it from there.

    The shuffles behind it are not needed again, and their files go at once: a plan begun under the
    setting removes its own.
    """
    shared_dir(df.sparkSession)
    with settings(df.sparkSession, SHUFFLES_GO):
        return freeze(df.select("*"))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the jobs run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def kept_in_worker(name: str, key, make):
    """What ``make`` gives, made once for ``key`` and kept by this Python worker from task to task.

    Worker code travels with the job, so module variables start anew in every task. Only the newest
    thing is kept, as later stages run in the same worker.
    """
    store = sys.__dict__.setdefault("_tidewatt_kept", {})
    if (name, key) not in store:
        store.clear()
        store[name, key] = make()
    return store[name, key]


def spread(df: DataFrame) -> int:
    """Partitions for a shuffle, as the session sets them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unsigned_bits(hash_column: Column, bits: int) -> Column:
    """The upper ``bits`` of a 64-bit hash as a number from 0."""
    return F.shiftrightunsigned(hash_column, 64 - bits)


def ranked(df: DataFrame, group: str, order: str, tie: str, into: str, rows: int | None = None) -> DataFrame:
    """Add ``into``: the rank of a row from 0 within ``group`` by (``order``, ``tie``).

    ``order`` is an evenly spread 64-bit hash. Its upper bits cut each group into cells of about
    ``ROWS_PER_CELL`` rows; cells are counted first (partial sums), so no task ranks a whole group,
    however large. ``df`` must be cheap to compute twice or be written already.
    """
    n = df.count() if rows is None else rows
    bits = max(1, math.ceil(math.log2(max(2, n / ROWS_PER_CELL))))
    celled = df.withColumn("__cell", unsigned_bits(F.col(order), bits))
    before = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = celled.groupBy(group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select(
        F.col(group).alias("__group"), F.col("__cell").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(group, "__cell").orderBy(order, tie)
    numbered = celled.withColumn("__row", F.row_number().over(inside))
    joined = numbered.join(starts, numbered[group].eqNullSafe(starts["__group"]) & (numbered["__cell"] == starts["__at"]))
    return joined.withColumn(into, F.col("__before") + F.col("__row") - 1).drop("__cell", "__at", "__group", "__before", "__row", "__n")


def only_members(rows: DataFrame, key: str, members: DataFrame, member: str, n: int) -> DataFrame:
    """Drop most rows whose key is not a member before they are shuffled; the join after it is exact.

    Members are hashed into a bitmap of 16 bits each, which is broadcast while it stays under
    ``BITMAP_BYTES``; with more members the rows go to the join as they are.
    """
    blocks = max(1, -(-16 * n // BLOCK_BITS))
    if blocks * BLOCK_BITS // 8 > BITMAP_BYTES:
        return rows

    def bit(column):
        return F.pmod(F.xxhash64(column), F.lit(blocks * BLOCK_BITS))

    marks = members.select(bit(member).alias("bit"))
    marks = marks.groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    marked = rows.withColumn("__bit", bit(key)).join(F.broadcast(marks), F.col("block") == F.bitmap_bucket_number("__bit"))
    place = F.bitmap_bit_position("__bit")
    octet = F.conv(F.hex(F.substring("map", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = marked.withColumn("__octet", octet).withColumn("__shift", (place % 8).cast("int"))
    return marked.where(F.expr("shiftright(__octet, __shift) % 2 = 1")).select(*rows.columns)


def smallest_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For rows 0..n-1 the smallest row reachable over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    while True:
        nearer = label[label]
        if (nearer == label).all():
            return label
        label = nearer


def stars(edges: DataFrame, n: int, at_once: int) -> DataFrame:
    """Links that join the same nodes as the ``n`` ``edges`` (u, v): each lot of ``at_once`` as stars round its smallest nodes.

    The tasks are as many as the links need, however many files they were written to.
    """

    def star(lot: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(lot)
        codes, names = pd.factorize(pd.concat([pdf["u"], pdf["v"]]), sort=True)
        low = smallest_linked(len(names), codes[: len(pdf)], codes[len(pdf) :])
        inner = np.flatnonzero(low < np.arange(len(names)))
        return pd.DataFrame({"u": names[inner], "v": names[low[inner]]})

    def run(batches):
        lot, size = [], 0
        for pdf in batches:
            if size and size + len(pdf) > at_once:
                yield star(lot)
                lot, size = [], 0
            lot.append(pdf)
            size += len(pdf)
        if size:
            yield star(lot)

    return edges.coalesce(max(1, math.ceil(n / at_once))).mapInPandas(run, edges.schema)


def components(edges: DataFrame, rounds: int = 60, at_once: int = LINKS_PER_TASK) -> DataFrame:
    """Connected components of ``edges`` (u, v): rows (node, component = its smallest node).

    Lots of ``at_once`` links are joined inside a task. Links that are one lot are done then; more take
    alternating large-star and small-star steps, whose minima are partial aggregates joined back, so a
    node with very many links is never gathered. Each round is written to the shared folder.
    Nodes without a link to another node do not appear.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def lowest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def named(e: DataFrame) -> DataFrame:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))

    current = durable(edges.where("u is not null and v is not null and u <> v").distinct())
    seen = state(current)
    for _ in range(rounds):
        if seen[0] == 0:
            return named(current)
        joined = durable(stars(current, seen[0], at_once))
        if seen[0] <= at_once:
            return named(joined)
        near = both(joined)
        large = near.join(lowest(near), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        mins = lowest(down)
        small = down.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(mins.select("u", F.col("m").alias("v")))
        current = durable(small.where("u <> v").distinct())
        now = state(current)
        if now == seen:
            return named(current)
        seen = now
    raise RuntimeError(f"links did not settle in {rounds} rounds")
