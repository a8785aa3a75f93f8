"""Near-duplicates among embeddings by a PCA-ordered, tiled comparison.

Equal vectors are merged first. The others are rotated to their principal axes, largest variance
first, so that leading dimensions carry most of a product. Blocks of vectors meet in pairs; a tile of
a pair accumulates the products over the leading dimensions and adds, as bound for the rest, the
product of the suffix norms: both in one matrix product, the suffix norm being one more coordinate.
Pairs that cannot reach the threshold are given up, the others go on to the next dimensions and are
decided on the full vectors in double precision.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, slim
from .simhash_trie import smallest_linked

BLOCK_ROWS = 4096
TILE = 1024
#: Dimensions between two looks at the pairs that are left.
STEP = 8
#: The first look is where this many standard deviations of a product no longer reach the threshold.
DEVIATIONS = 4.0
#: Allowance for rounding: of the first, single-precision look, and of the later ones.
COARSE_SLACK, SLACK = 1e-4, 1e-9
#: Candidate pairs whose products are finished at once.
AT_ONCE = 100_000


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v: array<double>) that can link: finite and not zero."""
    v = F.col("v")
    fine = vectors.where(v.isNotNull() & (F.size(v) > 0))
    return fine.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def axes(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes of the unit vectors as columns, largest variance first, and mean squares along them.

    Tasks send partial sums by matrix cell and Spark adds them; only the d x d matrix comes back.
    """

    def run(batches):
        total = np.zeros((dims + 1, dims + 1))
        for rb in batches:
            x = rb.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(len(x))]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "x"])

    cells = vectors.select("v").mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((dims + 1) ** 2)
    for r in cells:
        total[r["cell"]] = r["x"]
    total = total.reshape(dims + 1, dims + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[:-1, -1] / n
    values, columns = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    columns = columns[:, np.argsort(-values)]
    return columns, np.einsum("dk,de,ek->k", columns, total[:-1, :-1] / n, columns)


def looks(squares: np.ndarray, threshold: float) -> list[int]:
    """After how many dimensions pairs are looked at, from the mean square of each."""
    dims = len(squares)
    rest = np.cumsum(squares[::-1])[::-1]
    spread = np.sqrt(np.cumsum(squares**2))
    enough = [d for d in range(1, dims) if rest[d] + DEVIATIONS * spread[d - 1] < threshold]
    first = enough[0] if enough else dims
    return [*range(first, dims, STEP), dims]


class Side:
    """One block: unit vectors, their rotation and the norms of their suffixes at each stage."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        big = x / np.abs(x).max(axis=1, keepdims=True)
        self.unit = big / np.linalg.norm(big, axis=1, keepdims=True)
        self.turned = self.unit @ turn
        square = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.suffix = np.sqrt(np.c_[square, np.zeros(len(x))])


def linked(a: Side, b: Side, threshold: float, same: bool, stops: list[int]):
    """Index pairs (i, j) with cosine of at least the threshold; i < j if both sides are one."""
    d = stops[0]
    left, right = (np.c_[s.turned[:, :d], s.suffix[:, d]].astype(np.float32) for s in (a, b))
    for i0 in range(0, len(a.unit), TILE):
        for j0 in range(i0 if same else 0, len(b.unit), TILE):
            x, y = a.turned[i0 : i0 + TILE], b.turned[j0 : j0 + TILE]
            bound = left[i0 : i0 + TILE] @ right[j0 : j0 + TILE].T
            i, j = np.divmod(np.flatnonzero(bound >= threshold - COARSE_SLACK), bound.shape[1])
            if same and i0 == j0:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), AT_ONCE):
                p, q = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
                part = np.einsum("nd,nd->n", x[p, :d], y[q, :d])
                for low, high in zip(stops, stops[1:]):
                    part = part + np.einsum("nd,nd->n", x[p, low:high], y[q, low:high])
                    keep = part + a.suffix[i0 + p, high] * b.suffix[j0 + q, high] >= threshold - SLACK
                    p, q, part = p[keep], q[keep], part[keep]
                exact = np.einsum("nd,nd->n", a.unit[i0 + p], b.unit[j0 + q]) >= threshold
                yield i0 + p[exact], j0 + q[exact]


def _compare(rows: pa.Table, turn: np.ndarray, threshold: float, stops: list[int]) -> pa.Table:
    """Counts of links (node, add, null) and edges that span them (node, null, low) for one pair of blocks."""
    dims = len(turn)
    order = np.argsort(rows["node"].to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    side = rows["side"].to_numpy()
    x = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
    same = not rows["cross"][0].as_py()
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    add = np.zeros(len(node), np.int64)
    label = np.arange(len(node))
    if len(left) and len(right):
        a = Side(x[left], turn)
        b = a if same else Side(x[right], turn)
        for p, q in linked(a, b, threshold, same, stops):
            i, j = left[p], right[q]
            np.add.at(add, i, copies[j])
            np.add.at(add, j, copies[i])
            open_ = label[i] != label[j]
            if open_.any():
                label = smallest_linked(len(node), np.r_[np.arange(len(node)), i[open_]], np.r_[label, j[open_]])
    some, moved = np.flatnonzero(add), np.flatnonzero(label != np.arange(len(node)))
    return pa.table({
        "node": pa.array(np.r_[node[some], node[moved]]),
        "add": pa.array([*add[some].tolist(), *[None] * len(moved)], pa.int64()),
        "low": pa.array([*[None] * len(some), *node[label[moved]].tolist()], pa.int64()),
    })


def _met(reps: DataFrame, dims: int, n: int, threshold: float, block_rows: int) -> DataFrame:
    """Counts of links and spanning edges among the ``n`` distinct vectors of one length."""
    turn, squares = axes(reps, dims)
    stops = looks(squares, threshold)
    blocks = max(1, -(-n // block_rows))
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    rows = reps.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select("node", "copies", "v", low.alias("i"), high.alias("j"), (F.col("own") != low).cast("int").alias("side"), (low != high).alias("cross"))
    return durable(rows.groupBy("i", "j").applyInArrow(lambda t: _compare(t, turn, threshold, stops), "node long, add long, low long"))


def near_components(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with nothing; the others
    link with those of their own length, each length with its own axes and blocks. Equal vectors link
    (their cosine is 1), so repeated rows link. A row with a null id links with nothing. An empty
    table gives an empty result; other columns are ignored.
    """
    every = slim(vectors, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    fine = durable(usable(every.where("vec_id is not null")))
    reps = durable(fine.groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    lengths = reps.groupBy(F.size("v").alias("dims")).count().orderBy("dims").collect()
    met = [_met(reps.where(F.size("v") == r["dims"]), r["dims"], r["count"], threshold, block_rows) for r in lengths if r["count"] > 1]
    if met:
        met = reduce(DataFrame.union, met)
        links = met.where("add is not null").groupBy("node").agg(F.sum("add").alias("links"))
        found = components(met.where("low is not null").select(F.col("node").alias("u"), F.col("low").alias("v")))
    else:
        links = reps.where("false").select("node", F.col("copies").alias("links"))
        found = reps.where("false").select("node", F.col("node").alias("component"))
    named = reps.join(links, "node", "left").join(found, "node", "left").select(
        F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    return every.join(named, (F.col("v") == F.col("w")) & F.col("vec_id").isNotNull(), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )
