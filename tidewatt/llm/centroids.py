"""Centroid clustering of integer vectors by a bisector tournament.

Components become integers, so every number here is exact. For two centroids a < b the plane halfway
between them has the integer normal 2 (b - a) and the integer threshold |b|^2 - |a|^2: a vector lies nearer
to b exactly if its product with the normal is above the threshold, and zero difference favours the smaller
number. Each vector holds a champion, at first centroid 0; the others challenge it in ascending order, so
k - 1 sign tests leave the nearest centroid. Its distance is then computed once.

Tasks send the component sums of each cluster; Spark adds them, and only the k centroids come to the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, slim

#: Sums leave a task as digits to this base, so that Spark adds plain longs without overflow.
DIGIT_BITS = 30
#: Up to where doubles, and longs, hold every integer of a product sum.
DOUBLE_EXACT, LONG_EXACT = 2**53, 2**62
LONG_MAX = 2**63 - 1
#: Rows whose normals are gathered at once.
AT_ONCE = 4096


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) without rounding: longs where they fit, else Python integers."""
    if np.abs(x).max(initial=0.0) < DOUBLE_EXACT / scale:
        return np.floor(x * scale).astype(np.int64)
    flat = [math.floor(v * scale) if abs(v) < DOUBLE_EXACT else int(v) * scale for v in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


class Bisectors:
    """The planes between all pairs of centroids, as integers."""

    def __init__(self, centroids: list[list[int]]):
        c = np.array(centroids, object).reshape(len(centroids), -1)
        self.centroids, self.k, self.dims = c, *c.shape
        self.reach = max((abs(v) for v in c.ravel().tolist()), default=0)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])  # [champion, challenger]
        squares = (c * c).sum(axis=1)
        self.thresholds = squares[None, :] - squares[:, None]
        self.cast: dict = {}

    def _as(self, kind):
        if kind not in self.cast:
            self.cast[kind] = [t.astype(kind) for t in (self.normals, self.thresholds, self.centroids)]
        return self.cast[kind]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row and the squared distance, both exact."""
        top = max(self.reach, int(np.abs(x).max(initial=0)))
        most = 8 * self.dims * (top + 1) ** 2
        kind = np.float64 if most < DOUBLE_EXACT else np.int64 if most < LONG_EXACT else object
        normals, thresholds, centroids = self._as(kind)
        champion = np.zeros(len(x), np.int64)
        distance = np.zeros(len(x), object if kind is object else np.int64)
        for at in range(0, len(x), AT_ONCE):
            rows, w = x[at : at + AT_ONCE].astype(kind), champion[at : at + AT_ONCE]
            for challenger in range(1, self.k):
                side = (rows * normals[w, challenger]).sum(axis=1) - thresholds[w, challenger]
                w[side > 0] = challenger
            off = rows - centroids[w]
            distance[at : at + AT_ONCE] = (off * off).sum(axis=1)
        return champion, distance


def digits(sums: np.ndarray) -> list[list[int]]:
    """Signed digits to the base 2**DIGIT_BITS, lowest first, one list of all components per digit."""
    out, left = [], [int(v) for v in sums]
    while not out or any(left):
        out.append([(abs(v) % (1 << DIGIT_BITS)) * (1 if v >= 0 else -1) for v in left])
        left = [(abs(v) >> DIGIT_BITS) * (1 if v >= 0 else -1) for v in left]
    return out


def kept_vectors(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v: array<double>) of the rows with exactly ``dims`` finite components."""
    every = slim(vectors, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return every.where(F.coalesce((F.size("v") == dims) & finite, F.lit(False)))


def _blocks(batches, dims: int, scale: int):
    for rb in batches:
        if rb.num_rows:
            flat = rb.column("v").flatten().to_numpy(zero_copy_only=False)
            yield rb, integers(flat.reshape(-1, dims), scale)


def _moved(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The floor of the mean of each cluster; a centroid without vectors stays."""
    dims = len(centroids[0])

    def run(batches):
        planes = Bisectors(centroids)
        total = np.zeros((planes.k, dims), object)
        count = np.zeros(planes.k, np.int64)
        for _, x in _blocks(batches, dims, scale):
            cluster, _ = planes.nearest(x)
            count += np.bincount(cluster, minlength=planes.k)
            for c in np.unique(cluster).tolist():
                total[c] = total[c] + x[cluster == c].sum(axis=0)
        rows = [(c, i, int(count[c]) if i == 0 else 0, d) for c in np.flatnonzero(count).tolist() for i, d in enumerate(digits(total[c]))]
        columns = zip(*rows) if rows else ([], [], [], [])
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, kinds)], names=["cluster", "digit", "n", "sums"])

    parts = kept.select("v").mapInArrow(run, "cluster int, digit int, n long, sums array<long>")
    added = parts.groupBy("cluster", "digit").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums")).collect()
    count, total = {}, {}
    for r in added:
        count[r["cluster"]] = count.get(r["cluster"], 0) + r["n"]
        value = total.setdefault(r["cluster"], [0] * dims)
        total[r["cluster"]] = [a + (s << DIGIT_BITS * r["digit"]) for a, s in zip(value, r["sums"])]
    return [[s // count[c] for s in total[c]] if c in count else old for c, old in enumerate(centroids)]


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1:",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null or not finite; the rest give no row. The first
    centroids are the k kept rows with the smallest sha256 of ``seed`` and id. Rows with equal ids (repeated
    rows) follow each other by their components, and null ids come last, so both are clustered like any other row. With
    fewer than k kept rows there are as many centroids; without any, and for an empty table, the result
    is empty. Ties of distance go to the smaller number. Integers of any size are exact; a squared distance,
    or a sum of them, that no long can hold is null, as are the sums over it. Other columns are ignored.
    """
    kept = kept_vectors(vectors, dims, id_col, vector_col)
    drawn = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.select("v", drawn.alias("drawn")).orderBy(F.col("drawn").asc_nulls_last(), "v").limit(k).collect()
    centroids = [integers(np.array(r["v"]), scale).tolist() for r in first]
    spark = vectors.sparkSession
    kind = kept.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, cluster int, distance long"
    if not centroids:
        empty = f"{shape}, cluster_inertia long, inertia long, centroid array<string>, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    for _ in range(rounds):
        centroids = _moved(kept, centroids, scale)

    def run(batches):
        planes = Bisectors(centroids)
        for rb, x in _blocks(batches, dims, scale):
            near, distance = planes.nearest(x)
            far = [d if d <= LONG_MAX else None for d in distance.tolist()] if distance.dtype == object else distance
            yield pa.RecordBatch.from_arrays([rb.column("vec_id"), pa.array(near, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    placed = durable(kept.mapInArrow(run, shape))
    every = F.count("distance") == F.count(F.lit(1))
    each = placed.groupBy("cluster").agg(F.when(every, F.try_sum("distance")).alias("cluster_inertia"))
    total = each.agg(F.when(F.count("cluster_inertia") == F.count(F.lit(1)), F.try_sum("cluster_inertia")).alias("inertia"))
    named = spark.createDataFrame(
        [(c, [str(v) for v in m], hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for c, m in enumerate(centroids)],
        "cluster int, centroid array<string>, centroid_sha256 string",
    )
    facts = each.crossJoin(total).join(named, "cluster")
    return placed.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"
    )
