"""SimHash near-duplicates by a self-join of binary tries.

Two fingerprints that differ in at most ``budget`` bits agree on one of ``budget + 1`` bit blocks.
So each fingerprint enters one trie per block, rotated to put that block on top, and only the node
pairs that agree there are roots. Below, the pairs of child nodes are visited together, a few bits
a step; differing bits add up along the path and a pair is dropped once they exceed the budget.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt.plans.sizing import broadcast_if_small

from .common import components, durable, only_members, slim, smallest_linked, spread

BITS = 64
SEED = 42
#: Fingerprints of one root that a task visits at once; larger roots are cut into tiles.
TILE = 1024
#: Root pairs visited in one pass, which bounds the frontier.
PAIRS_AT_ONCE = 1_000_000
STEP_BITS = 6


def simhash(text: bytes, shingle: int) -> int:
    """Majority bits of the XXH64 of all word shingles; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        bits = np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint_column(shingle: int):
    """A column function: the fingerprint as a signed long; null text counts as empty."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        out = np.fromiter((simhash((t or "").encode("utf-8"), shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(out.view(np.int64))

    return of


def block_bounds(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of each block."""
    cuts = [round(i * BITS / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def spans(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``counts``, in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def visit(owner: np.ndarray, value: np.ndarray, roots: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers whose values differ in at most ``budget`` bits below ``depth``.

    Rows are sorted by (owner, value), no value twice in an owner, owners numbered from 0; ``roots``
    pairs owners. A node is
    a run of rows with the same owner and the same upper bits.
    """
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.array([], np.int64)
    left, right, errors = roots[:, 0], roots[:, 1], roots[:, 2]
    while len(left) and depth < BITS:
        step = min(STEP_BITS, BITS - depth)
        below = value >> np.uint64(BITS - depth - step)
        fresh = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (below[1:] != below[:-1])])
        first = np.searchsorted(fresh, starts)
        many = np.diff(np.r_[first, len(fresh)])
        label = below[fresh] & np.uint64((1 << step) - 1)
        a, b = many[left], many[right]
        pair = np.repeat(np.arange(len(left)), a * b)
        inside = spans(a * b)
        wide = b[pair]
        i = first[left[pair]] + inside // wide
        j = first[right[pair]] + inside % wide
        e = errors[pair] + np.bitwise_count(label[i] ^ label[j])
        keep = (e <= budget) & (i <= j)
        left, right, errors, starts, depth = i[keep], j[keep], e[keep], fresh, depth + step
    other = left != right
    return starts[left[other]], starts[right[other]], errors[other]


def nearest_forest(n: int, i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same rows 0..n-1 as (i, j) do at every distance, fewest bits first."""
    label = np.arange(n)
    us, vs = [], []
    for d in np.unique(bits):
        a, b = i[bits == d], j[bits == d]
        while True:
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
            if not len(a):
                break
            pick = np.full(n, len(a))
            at = np.arange(len(a))
            np.minimum.at(pick, label[a], at)
            np.minimum.at(pick, label[b], at)
            best = np.unique(pick[pick < len(a)])
            us.append(a[best])
            vs.append(b[best])
            label = smallest_linked(n, np.r_[np.arange(n), a[best]], np.r_[label, b[best]])
    none = [np.array([], np.int64)]
    return np.concatenate(us or none), np.concatenate(vs or none)


CELL = ["block", "kind", "top", "low", "high"]


def _links(batch: pd.DataFrame, budget: int, bounds) -> pa.RecordBatch:
    """Links of whole cells, thinned to a forest of the nearest."""
    turned = batch["turned"].to_numpy(np.int64).view(np.uint64)
    order = np.lexsort((turned, batch["side"].to_numpy(), batch["cell"].to_numpy(), batch["block"].to_numpy()))
    batch, turned = batch.iloc[order], turned[order]
    node, blocks = batch["node"].to_numpy(np.int64), batch["block"].to_numpy()
    us, vs = [], []
    for block in np.unique(blocks):
        at = np.flatnonzero(blocks == block)
        cell, side = batch["cell"].to_numpy()[at], batch["side"].to_numpy()[at]
        changed = np.r_[True, (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])]
        owner = np.cumsum(changed) - 1
        heads = np.flatnonzero(changed)
        cross = batch["cross"].to_numpy()[at][heads]
        above = (batch["kind"].to_numpy()[at][heads] >= 0).astype(np.int64)
        twin = np.r_[cell[heads][1:] == cell[heads][:-1], False]
        alone, both = np.flatnonzero(~cross), np.flatnonzero(cross & twin)
        roots = np.r_[np.c_[alone, alone, above[alone]], np.c_[both, both + 1, above[both]]]
        if not len(roots):
            continue
        i, j, bits = visit(owner, turned[at], roots, bounds[block][1], budget)
        names, index = np.unique(node[at], return_inverse=True)
        u, v = nearest_forest(len(names), index[i], index[j], bits)
        us.append(names[np.maximum(u, v)])
        vs.append(names[np.minimum(u, v)])
    none = [np.array([], np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us or none)), pa.array(np.concatenate(vs or none))], names=["u", "v"])


def link_edges(reps: DataFrame, budget: int, near_blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that span the links of distinct fingerprints ``reps`` (node, fp).

    With ``near_blocks`` None there are budget + 1 blocks and one of them agrees; else there are so
    many blocks (budget < 2 x near_blocks) and one of them differs in one bit at most: its two values
    are the two sides of a root. Every link is found; each visited cell gives a forest of its nearest
    links. A root with over ``tile`` fingerprints is cut into tiles by hash, and each pair of its tiles
    is a cell of its own.
    """
    bounds = block_bounds(budget if near_blocks is None else near_blocks - 1)
    # A block is a row's data, not an expression of its own: the plan, which the driver compiles, stays small.
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), F.lit(a).alias("first"), F.lit(w).alias("width")) for k, (a, w) in enumerate(bounds)])
    rows = reps.select("node", "fp", F.explode(blocks).alias("r")).select("node", "fp", "r.*")
    # Shifts count modulo 64, so the first block's turn by nothing holds as well.
    rows = rows.withColumn("turned", F.expr(f"shiftleft(fp, first) | shiftrightunsigned(fp, {BITS} - first)"))
    rows = rows.withColumn("whole", F.expr(f"shiftrightunsigned(turned, {BITS} - width)"))
    kinds = F.sequence(F.lit(-1), F.col("width") - 1 if near_blocks else F.lit(-1))
    rows = rows.select("node", "fp", "block", "turned", "whole", F.explode(kinds).alias("kind"))
    rows = rows.withColumn("bit", F.expr("if(kind < 0, 0L, shiftright(whole, kind) % 2)"))
    rows = rows.select("node", "fp", "block", "kind", "turned", F.expr("if(kind < 0, whole, whole - shiftleft(bit, kind))").alias("top"), F.col("bit").cast("int").alias("bit"))
    large = rows.groupBy("block", "kind", "top").agg(F.count(F.lit(1)).alias("n"))
    large = large.where(F.col("n") > tile).select("block", "kind", "top", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    large = broadcast_if_small(durable(large))
    rows = rows.join(large, ["block", "kind", "top"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    paired = F.col("kind") >= 0
    first = F.when(paired, F.col("bit") == 0).otherwise(F.col("own") <= F.col("other"))
    low, high = F.when(first, F.col("own")).otherwise(F.col("other")), F.when(first, F.col("other")).otherwise(F.col("own"))
    rows = rows.select(
        "node", "block", "kind", "turned", "top", low.alias("low"), high.alias("high"),
        F.when(first, 0).otherwise(1).alias("side"), (paired | (F.col("own") != F.col("other"))).alias("cross"),
    )
    rows = rows.repartition(spread(reps), *CELL).sortWithinPartitions(*CELL)

    def run(batches):
        waiting: list[pd.DataFrame] = []
        pairs, number, last = 0, -1, None
        for rb in batches:
            pdf = rb.to_pandas()
            if not len(pdf):
                continue
            keys = pdf[CELL].to_numpy(np.int64)
            new = np.r_[last is None or (keys[0] != last).any(), (keys[1:] != keys[:-1]).any(axis=1)]
            last = keys[-1]
            pdf["cell"] = number + np.cumsum(new)
            number = int(pdf["cell"].iloc[-1])
            cuts = np.r_[np.flatnonzero(new), len(pdf)]
            at = 0
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                if pairs + (b - a) ** 2 > PAIRS_AT_ONCE and (a > at or waiting):
                    waiting.append(pdf.iloc[at:a])
                    yield _links(pd.concat(waiting), budget, bounds)
                    waiting, pairs, at = [], 0, a
                pairs += (b - a) ** 2
            waiting.append(pdf.iloc[at:])
        if waiting:
            yield _links(pd.concat(waiting), budget, bounds)

    return rows.mapInArrow(run, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most ``budget`` differing bits. Null
    or empty text has fingerprint zero and is linked like any other; equal fingerprints, and so
    repeated rows, always link; a row whose id is null takes its group's component (null if the
    group has no id). An empty table gives an empty result; other columns are ignored.
    """
    prints = durable(slim(docs, doc_id=id_col, text=text_col).select("doc_id", fingerprint_column(shingle)("text").alias("fp")))
    reps = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(link_edges(reps.where("node is not null"), budget))
    named = reps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, shingle: int) -> set[bytes]:
    """The set of word shingles; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode("utf-8").lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def jaccard(one: str | None, two: str | None, shingle: int) -> float:
    """Similarity of the sets of word shingles."""
    a, b = shingles(one, shingle), shingles(two, shingle)
    return len(a & b) / len(a | b) if a and b else 0.0


#: Documents on one side of a cell of candidates that are not yet joined.
OPEN_TILE = 512
OPEN_CELL = ["group", "low", "high"]


def open_pairs(pdf: pd.DataFrame, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one cell within ``budget`` bits and with different labels, fewest bits first."""
    fp, label, side = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["label"].to_numpy(np.int64), pdf["side"].to_numpy()
    if pdf["low"].iloc[0] == pdf["high"].iloc[0]:
        left = right = np.arange(len(fp))
    else:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    us, vs, bits = [], [], []
    for at in range(0, len(left), 256):
        some = left[at : at + 256]
        apart = np.bitwise_count(fp[some][:, None] ^ fp[right][None, :])
        i, j = np.nonzero((apart <= budget) & (label[some][:, None] != label[right][None, :]))
        bits.append(apart[i, j])
        us.append(some[i])
        vs.append(right[j])
    none = [np.array([], np.int64)]
    u, v, d = np.concatenate(us or none), np.concatenate(vs or none), np.concatenate(bits or none)
    if left is right:
        u, v, d = u[u < v], v[u < v], d[u < v]
    order = np.argsort(d, kind="stable")
    return u[order], v[order]


def _verify(pdf: pd.DataFrame, budget: int, shingle: int, similarity: float) -> pd.DataFrame:
    """Links of one cell that join its labels: every open pair is compared unless its ends are joined already."""
    numbers: dict[bytes, int] = {}
    sets = [{numbers.setdefault(x, len(numbers)) for x in shingles(t, shingle)} for t in pdf["text"]]
    doc, label = pdf["doc_id"].tolist(), pdf["label"].tolist()
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    out = []
    u, v = open_pairs(pdf, budget)
    for i, j in zip(u.tolist(), v.tolist()):
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1 or not a or not b:
            continue
        x, y = top(label[i]), top(label[j])
        if x == y:
            continue
        both = len(a & b)
        if both / (len(a) + len(b) - both) >= similarity:
            above[max(x, y)] = min(x, y)
            out.append((doc[i], doc[j]))
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def open_links(prints: DataFrame, groups: DataFrame, joined: DataFrame, source: DataFrame, shingle: int, similarity: float, budget: int, tile: int | None = None) -> DataFrame:
    """Links (u, v) between documents that are candidates but that ``joined`` leaves apart.

    ``groups`` and ``joined`` are (node, component) of all candidates and of the links found so far,
    without the smallest node of each.
    Groups with more than one label are cut into tiles; each pair of tiles is a cell. Cells first
    pick by fingerprint the documents with an open pair; only these are sent with their texts.
    """
    tile = tile or OPEN_TILE
    groups = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group"))
    groups = groups.union(groups.select("group", "group").distinct())
    rows = prints.distinct().join(groups, "doc_id")
    rows = rows.join(joined.select(F.col("node").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left")
    rows = durable(rows.withColumn("label", F.coalesce("label", "doc_id")))
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
    # A pair that stands alone was compared already.
    sizes = sizes.where("a <> b and n > 2").select("group", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    rows = rows.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select(
        "doc_id", "fp", "label", "group", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[np.unique(np.concatenate(open_pairs(pdf, budget)))]

    picked = durable(rows.groupBy(*OPEN_CELL).applyInPandas(pick, rows.schema))
    ends = durable(picked.select(F.col("doc_id").alias("id")).distinct())
    texts = only_members(source, "doc_id", ends, "id", ends.count()).join(ends, F.col("doc_id") == F.col("id"), "left_semi")
    texts = texts.groupBy("doc_id").agg(F.max("text").alias("text"))
    return picked.join(texts, "doc_id").groupBy(*OPEN_CELL).applyInPandas(lambda pdf: _verify(pdf, budget, shingle, similarity), "u long, v long")


def verified_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
    print_shingle: int = 2, budget: int = 9, near_blocks: int = 5,
) -> DataFrame:
    """Rows (doc_id, keep_id) of documents that are near copies of others; keep_id is a group's smallest.

    Fingerprints over ``print_shingle`` words that differ in at most ``budget`` bits are candidates;
    only pairs whose sets of ``shingle`` words are at least ``similarity`` alike are links, so
    documents that merely resemble each other are not grouped. A forest of the nearest candidates is
    compared first; then every candidate pair that the links so far leave apart.
    Texts without words are never linked; rows with a null id take no part.
    """
    source = slim(docs, doc_id=id_col, text=text_col).where("doc_id is not null")
    source = source.where(F.regexp_like("text", F.lit(r"[^\x09-\x0d ]")))
    prints = durable(source.select("doc_id", fingerprint_column(print_shingle)("text").alias("fp")))
    reps = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    equal = prints.join(reps, "fp").where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    pairs = durable(link_edges(reps, budget, near_blocks).union(equal).distinct())
    ends = durable(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct())
    texts = only_members(source, "doc_id", ends, "id", ends.count()).join(ends, F.col("doc_id") == F.col("id"), "left_semi")
    texts = texts.groupBy("doc_id").agg(F.max("text").alias("text"))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y, shingle) for x, y in zip(a, b)], dtype=float)

    left, right = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b"))
    links = pairs.join(left, "u").join(right, "v").where(alike("a", "b") >= similarity).select("u", "v")
    joined = components(links)
    more = durable(open_links(prints, components(pairs), joined, source, shingle, similarity, budget))
    if not more.isEmpty():
        joined = components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    return joined.select(F.col("node").alias("doc_id"), F.col("component").alias("keep_id"))
