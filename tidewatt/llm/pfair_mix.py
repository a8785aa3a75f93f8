"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are cut into blocks. Block j of a source with share w of all weights is released at
slot floor(j / w) and due at ceil((j + 1) / w); earliest deadline first over these windows keeps every
prefix of a phase within less than one block of each source's share. When a source runs dry the phase
ends and the next one shares its weight among the others: all rows are placed, none twice.

A phase is cut into periods of L slots. At a boundary T a source has had floor(w T) blocks or one
more; which sources are ahead is chosen by deadline, as far as their releases leave slots for them
and keeping those that were ahead before. So one task makes only the table of periods, and the slots
of each period are found on their own.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, ranked, slim

BLOCK_ROWS = 16
#: Slots of a period, at least; there are at least four per source.
PERIOD = 4096


def template(quotas: dict, weights: dict | None = None, start: int = 0, done: dict | None = None) -> dict:
    """Positions of each source's blocks in one period, earliest deadline first among released blocks.

    ``weights`` are whole numbers for all sources of the phase (default: the quotas), ``start`` is the
    slot of the phase where the period starts, ``done`` the blocks placed in the phase before.
    """
    length = sum(quotas.values())
    weights, done = weights or quotas, done or dict.fromkeys(quotas, 0)
    return _slots(quotas, weights, sum(weights.values()), start, done, length)


def _slots(quotas: dict, weights: dict, total: int, start: int, done: dict, length: int) -> dict:
    releases: list[list] = [[] for _ in range(length)]
    for s, q in quotas.items():
        w = weights[s]
        for j in range(done[s], done[s] + q):
            # Only in a phase's last period can a block be released after the blocks run out.
            at = min(max(j * total // w - start, 0), length - 1)
            releases[at].append((-(-(j + 1) * total // w) - start, s, j))
    ready: list = []
    slots: dict = {s: [] for s in quotas}
    clock = 0
    for t in range(length):
        while True:
            if clock < length:
                for job in releases[clock]:
                    heapq.heappush(ready, job)
            clock += 1
            if ready:
                break
        due, s, _ = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a block missed its deadline")
        slots[s].append(t)
    return slots


def _upto(w: np.ndarray, total: int, blocks: np.ndarray, done: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Blocks of each source placed before slot ``stop``, given those before ``start``: a share rounded down or up."""
    floor = np.minimum(w * stop // total, blocks)
    upto = np.maximum(floor, done)
    length, many = stop - start, upto - done
    of = np.repeat(np.arange(len(w)), many)
    j = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + done[of]
    released = np.bincount(np.maximum(j * total // w[of] - start, 0), minlength=length)[:length]
    # Slots from each one to the end of the period that blocks due in it leave free.
    free = np.arange(length, 0, -1) - np.cumsum(released[::-1])[::-1]
    open_ = np.flatnonzero((done <= floor) & (floor < blocks) & (floor * total < w * stop))
    at = np.maximum(floor[open_] * total // w[open_] - start, 0)
    due = -(-(floor[open_] + 1) * total // w[open_])
    room = stop - int(upto.sum())
    for k in np.lexsort((open_, due)).tolist():
        if room <= 0:
            break
        before = free[: at[k] + 1]
        if before.min() > 0:
            before -= 1
            upto[open_[k]] += 1
            room -= 1
    return upto


def periods(blocks: dict, weights: dict, period: int = PERIOD):
    """(sources, whole weights, first slot in the phase, blocks placed before in the phase, quotas) of each period."""
    left = {s: n for s, n in blocks.items() if n > 0}
    period = max(period, 4 * len(left))
    # Products of weights and slots stay within 64 bits; the rounding is far under a block at the stream's end.
    scale = 2**60 // (sum(left.values()) + 1)
    while left:
        names = sorted(left)
        whole = sum(weights[s] for s in names)
        w = np.array([max(1, round(weights[s] / whole * scale)) for s in names], np.int64)
        n = np.array([left[s] for s in names], np.int64)
        total = int(w.sum())
        end = int((-(-n * total // w)).min())
        done = np.zeros(len(names), np.int64)
        for start in range(0, end, period):
            upto = _upto(w, total, n, done, start, min(start + period, end))
            yield names, w, start, done, upto - done
            done = upto
        left = {s: int(k) for s, k in zip(names, n - done) if k}


def phases(blocks: dict, weights: dict, period: int = PERIOD):
    """(quotas, 1) of one period after the other until every source is used up."""
    for names, _, _, _, quota in periods(blocks, weights, period):
        yield {s: int(q) for s, q in zip(names, quota) if q}, 1


PLAN = ["period", "number", "weight", "total", "start", "done", "before", "quota", "slot"]


def _plan(pdf: pd.DataFrame, period: int) -> pd.DataFrame:
    """Per period and source with a block in it: what ``template`` needs, blocks of earlier phases, first slot."""
    blocks = dict(zip(pdf["number"].tolist(), pdf["blocks"].tolist()))
    weights = dict(zip(pdf["number"].tolist(), pdf["weight"].tolist()))
    placed, slot, tables = dict.fromkeys(blocks, 0), 0, []
    for k, (names, w, start, done, quota) in enumerate(periods(blocks, weights, period)):
        if start == 0:
            before = np.array([placed[s] for s in names], np.int64)
            total = int(w.sum())
        at = np.flatnonzero(quota)
        tables.append(pd.DataFrame(dict(zip(PLAN, (k, np.array(names, np.int64)[at], w[at], total, start, done[at], before[at], quota[at], slot)))))
        placed.update(zip(names, (before + done + quota).tolist()))
        slot += int(quota.sum())
    return pd.concat(tables)[PLAN] if tables else pd.DataFrame(columns=PLAN)


def _blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """The slot of each block of one period."""
    names = pdf["number"].tolist()
    quotas, weights, done = (dict(zip(names, pdf[c].tolist())) for c in ("quota", "weight", "done"))
    slots = _slots(quotas, weights, int(pdf["total"].iloc[0]), int(pdf["start"].iloc[0]), done, sum(quotas.values()))
    first = dict(zip(names, (pdf["before"] + pdf["done"]).tolist()))
    base = int(pdf["slot"].iloc[0])
    rows = [(s, first[s] + j, base + t) for s in names for j, t in enumerate(slots[s])]
    return pd.DataFrame(rows, columns=["number", "block", "slot"])


def mix(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per row: doc_id, source, block, slot, place (in the block).

    Order by (slot, place) for the mixed stream. ``weights`` has source and weight (relative, above
    0); a source it does not name counts 1. Without it a source weighs as the square root of its
    blocks. Rows of a source keep no order: they go by a hash of their id. A null source is a source of its own; rows with null or
    repeated ids are placed once each. An empty table gives an empty result.
    """
    rows = durable(slim(docs, doc_id=id_col, source=source_col).withColumn("spot", F.xxhash64(F.lit("mix"), "doc_id")))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("long"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.sqrt("blocks"))
    else:
        given = slim(weights, wanted="source", weight="weight")
        sizes = sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("wanted")), "left").withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    sizes = durable(sizes.select("source", "blocks", "weight", F.xxhash64("source").alias("number")))
    plan = sizes.select("number", "blocks", "weight").groupBy().applyInPandas(
        lambda pdf: _plan(pdf.sort_values("number"), period), ", ".join(f"{c} long" for c in PLAN)
    )
    blocks = durable(plan).groupBy("period").applyInPandas(_blocks, "number long, block long, slot long")
    placed = ranked(rows, "source", "spot", "doc_id", "rank")
    placed = placed.select("doc_id", "source", F.xxhash64("source").alias("number"), F.floor(F.col("rank") / block_rows).cast("long").alias("block"), (F.col("rank") % block_rows).cast("int").alias("place"))
    return placed.join(blocks, ["number", "block"]).select("doc_id", "source", "block", "slot", "place")
