"""Repeated byte strings by a distributed merge sort of suffixes.

Every window of ``length`` bytes has an anchor: the K-gram with the smallest hash inside it. Equal
windows have equal anchors at equal offsets, so consecutive windows with one anchor form a segment,
and only segments whose anchor K-gram occurs twice in the corpus can hold repeats (a filter that
loses nothing). Each such segment is one suffix, read from its anchor onwards, then backwards.

Tasks sort their suffixes into runs, drop equal ones, front-code the rest (length of the prefix
shared with the one before, and what follows) and send them by anchor. A reducer merges the runs
with a loser tree that carries these prefix lengths: suffixes are compared only from the length
both are known to share with the last output. Equal suffixes arrive as neighbours; different ones
with the same anchor are settled window by window, byte for byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt.session import scratch_path

from .common import slim, spread

GRAM = 32
#: Suffixes a task sorts into one run.
RUN_ITEMS = 200_000
#: Suffixes that one reducer merges, on average.
PART_ITEMS = 100_000
#: Last byte of the key of a lone window; segments have the length of their backward part there.
LONE = 255
#: Longest strings that ``remove_repeats`` looks for.
LONGEST = GRAM + LONE - 1
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIXER = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each GRAM bytes, by doubling."""
    h, m, size = data.astype(np.uint64) + np.uint64(1), _MULTIPLIER, 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * m + h[size:]
            m, size = m * m, size * 2
        h ^= h >> np.uint64(29)
        h *= _MIXER
        h ^= h >> np.uint64(32)
    return h


def segments(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, end of windows, anchor position and anchor hash of each segment.

    An anchor is the smallest of many hashes, so its hash is mixed again to be evenly spread.
    """
    grams = gram_hashes(data)
    wide = length - GRAM + 1
    low = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < wide:
        low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
    anchor = (low & _LOW).astype(np.int64)
    first = np.r_[0, np.flatnonzero(np.diff(anchor)) + 1]
    at = anchor[first]
    with np.errstate(over="ignore"):
        return first, np.r_[first[1:], len(anchor)], at, grams[at] * _MULTIPLIER


def share(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of hash space; grows with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def common_prefixes(keys: list[bytes]) -> np.ndarray:
    """Length of the prefix each key shares with the one before (0 for the first)."""
    out = np.zeros(len(keys), np.int64)
    for at in range(1, len(keys), 20_000):
        some = keys[at - 1 : at + 20_000]
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        wide = int(sizes.max())
        grid = np.frombuffer(b"".join(k.ljust(wide, b"\0") for k in some), np.uint8).reshape(len(some), wide)
        differs = grid[1:] != grid[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), wide)
        out[at : at + len(some) - 1] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def pack_run(keys: list[bytes], docs: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run, front-coded and compressed."""
    shared = common_prefixes(keys)
    tails = [k[s:] for k, s in zip(keys, shared.tolist())]
    sizes = np.fromiter(map(len, tails), np.uint16, len(tails))
    head = np.array([len(keys)], np.int64).tobytes()
    body = head + docs.astype(np.int64).tobytes() + starts.astype(np.int64).tobytes() + counts.astype(np.uint16).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(body + shared.astype(np.uint16).tobytes() + sizes.tobytes() + b"".join(tails))


def open_run(blob: bytes):
    """The items of a run in order: (key, prefix shared with the item before, doc, start, count)."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    columns, at = [], 8
    for kind in (np.int64, np.int64, np.uint16, np.uint16, np.uint16):
        columns.append(np.frombuffer(data, kind, n, at).tolist())
        at += n * np.dtype(kind).itemsize
    key = b""
    for doc, start, count, shared, size in zip(*columns):
        key = key[:shared] + data[at : at + size]
        at += size
        yield key, shared, doc, start, count


def first_difference(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, known to be at least ``at``."""
    end = min(len(a), len(b))
    while at < end:
        x, y = a[at : at + 32], b[at : at + 32]
        if x != y:
            n = min(len(x), len(y))
            bits = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return at + n - (bits.bit_length() + 7) // 8
        at += 32
    return end


def merged(runs: list):
    """Items of all runs in key order: (key, prefix shared with the last output, doc, start, count).

    A tournament of losers. Each contender carries how many bytes it shares with the last output;
    the one that shares more is smaller, and bytes below that length are never compared again.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    known = [0] * k
    losers = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether a's head comes first; the loser then knows what it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if known[a] != known[b]:
            return known[a] > known[b]
        at = first_difference(x[0], y[0], known[a])
        first = x[0][at:] <= y[0][at:]
        known[b if first else a] = at
        return first

    winners = list(range(k))
    level = k
    while level > 1:
        up = []
        for i in range(0, level, 2):
            a, b = winners[i], winners[i + 1]
            won = beats(a, b)
            up.append(a if won else b)
            losers[level // 2 + i // 2] = b if won else a
        winners, level = up, level // 2
    top = winners[0]
    while heads[top] is not None:
        key, _, doc, start, count = heads[top]
        yield key, known[top], doc, start, count
        heads[top] = following = next(runs[top], None) if top < len(runs) else None
        known[top] = following[1] if following else 0
        node = (top + k) // 2
        while node:
            other = losers[node]
            x, y = heads[top], heads[other]
            if x is None:
                swap = y is not None
            elif y is None:
                swap = False
            elif known[top] != known[other]:
                swap = known[other] > known[top]
            else:
                swap = not beats(top, other)
            if swap:
                losers[node], top = top, other
            node //= 2


def settle(group: list, length: int):
    """Windows of different suffixes with one anchor: all but the first of equal ones go."""
    group.sort(key=lambda x: (x[1], x[2]))
    seen: set[bytes] = set()
    for key, doc, start, count in group:
        back = key[-1]
        edge = len(key) - 1 - back
        text = key[edge:-1][::-1] + key[:edge]
        open_at = None
        for i in range(count):
            window = text[i : i + length]
            if window in seen:
                if open_at is None:
                    open_at = i
            else:
                seen.add(window)
                if open_at is not None:
                    yield doc, start + open_at, start + i
                    open_at = None
        if open_at is not None:
            yield doc, start + open_at, start + count


def repeats(runs: list, length: int):
    """Window ranges (doc, from, to) that occur earlier, over the merged runs of one part."""
    group: list = []
    held = None
    near = 0  # least prefix shared since the last segment; lone windows may lie between
    for key, shared, doc, start, count in merged(runs):
        if held is not None and shared == len(key) == len(held[0]):
            if (doc, start) != (held[1], held[2]):
                if (doc, start) < (held[1], held[2]):
                    yield held[1], held[2], held[2] + held[3]
                    held[1:] = [doc, start, count]
                else:
                    yield doc, start, start + count
            continue
        near = min(near, shared)
        held = [key, doc, start, count]
        if key[-1] == LONE:
            continue
        if near < GRAM:
            if len(group) > 1:
                yield from settle(group, length)
            group = []
        near = len(key)
        group.append(held)
    if len(group) > 1:
        yield from settle(group, length)


class Runs:
    """Collects the suffixes of a task and hands them out as sorted, front-coded runs by part."""

    def __init__(self, parts: int, length: int):
        self.parts, self.length = parts, length
        self.clear()

    def clear(self):
        self.keys: list[bytes] = []
        self.rows: list[tuple[int, int, int, int]] = []

    def add(self, doc: int, text: bytes, first, end, at, gram, hot: set[int]):
        part = share(gram, self.parts).tolist()
        for lo, hi, a, p, g in zip(first.tolist(), end.tolist(), at.tolist(), part, gram.tolist()):
            if g in hot:
                for w in range(lo, hi):
                    window = text[w : w + self.length]
                    spot = int.from_bytes(hashlib.blake2b(window, digest_size=4).digest(), "little") % self.parts
                    self.keys.append(window + bytes([LONE]))
                    self.rows.append((spot, doc, w, 1))
            else:
                self.keys.append(text[a : hi + self.length - 1] + text[lo:a][::-1] + bytes([a - lo]))
                self.rows.append((p, doc, lo, hi - lo))

    def flush(self):
        """(part, blob) of each part, and the ranges that repeat inside the run."""
        rows = np.array(self.rows, np.int64).reshape(-1, 4)
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
        keys = self.keys
        gone, blobs = [], []
        cuts = np.r_[0, np.flatnonzero(np.diff(rows[order, 0])) + 1, len(order)]
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            mine = sorted(order[a:b].tolist(), key=keys.__getitem__)
            fresh, last = [], None
            for i in mine:
                if keys[i] == last:
                    if (rows[i, 1:3] != rows[fresh[-1], 1:3]).any():
                        gone.append(i)
                else:
                    fresh.append(i)
                    last = keys[i]
            if fresh:
                some = rows[fresh]
                blobs.append((int(some[0, 0]), pack_run([keys[i] for i in fresh], some[:, 1], some[:, 2], some[:, 3])))
        ranges = joined(rows[gone, 1], rows[gone, 2], rows[gone, 2] + rows[gone, 3])
        self.clear()
        return blobs, ranges


def joined(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges sorted by document, with touching ones joined."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    head = np.r_[True, (doc[1:] != doc[:-1]) | (a[1:] != b[:-1])]
    tail = np.r_[head[1:], True]
    return doc[head], a[head], b[tail]


def _bytes(text) -> bytes:
    return text.encode("utf-8") if text is not None else b""


def anchor_grams(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Per task: its anchor hashes, packed by bucket.

    A hash that a task sees once is sent with its document; one it sees more often is known to
    repeat, so its documents stay out of the exchange and only one witness with the count is sent.
    """

    def run(batches):
        grams, ids = [], []
        for rb in batches:
            for doc, text in zip(rb.column("doc_id").to_pylist(), rb.column("text").to_pylist()):
                data = _bytes(text)
                if doc is not None and len(data) >= length:
                    g = segments(np.frombuffer(data, np.uint8), length)[3]
                    grams.append(g)
                    ids.append(np.full(len(g), doc, np.int64))
        if not grams:
            return
        g, d = np.concatenate(grams), np.concatenate(ids)
        order = np.argsort(g, kind="stable")
        g, d = g[order], d[order]
        head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        many = np.diff(np.r_[head, len(g)])
        often = np.repeat(many > 1, many)
        heads, lone = g[head], many == 1
        parts = share(heads, buckets)
        cuts = np.searchsorted(parts, np.arange(buckets + 1))
        squeeze = zstandard.ZstdCompressor(level=1)
        names, blobs = [], []
        for k in range(buckets):
            s = slice(cuts[k], cuts[k + 1])
            n = cuts[k + 1] - cuts[k]
            if n:
                names.append(k)
                blobs.append(squeeze.compress(
                    np.array([n], np.int64).tobytes() + heads[s].tobytes() + d[head][s].tobytes() + np.where(lone, 1, many)[s].astype(np.uint32).tobytes()
                ))
        yield _packed(names, blobs, np.zeros(0, np.int64), np.zeros(0, np.uint64))
        g, d = g[often], d[often]
        for at in range(0, len(g), 1_000_000):
            yield _packed([], [], d[at : at + 1_000_000], g[at : at + 1_000_000])

    return docs.mapInArrow(run, "bucket int, blob binary, doc_id long, gram long")


def _packed(names, blobs, docs, grams) -> pa.RecordBatch:
    n, m = len(names), len(docs)
    route = (docs % 1_000_003).astype(np.int64) if m else docs
    return pa.RecordBatch.from_arrays([
        pa.array([*names, *route.tolist()], pa.int32()),
        pa.array([*blobs, *[None] * m], pa.binary()),
        pa.array([*[None] * n, *docs.tolist()], pa.int64()),
        pa.array([*[None] * n, *grams.view(np.int64).tolist()], pa.int64()),
    ], names=["bucket", "blob", "doc_id", "gram"])


def repeated_grams(packed: DataFrame, buckets: int, partitions: int) -> DataFrame:
    """(doc_id, gram) of segments whose anchor hash repeats; without a document: (gram, n), its count."""

    def run(batches):
        heads, docs, many = [], [], []
        for rb in batches:
            blob, doc, gram = rb.column("blob"), rb.column("doc_id"), rb.column("gram")
            straight = pc.is_null(blob)
            d, g = doc.filter(straight), gram.filter(straight)
            if len(d):
                yield pa.RecordBatch.from_arrays([d, g, pa.nulls(len(d), pa.int64())], names=["doc_id", "gram", "n"])
            for b in blob.drop_null().to_pylist():
                data = zstandard.ZstdDecompressor().decompress(b)
                n = int(np.frombuffer(data, np.int64, 1)[0])
                heads.append(np.frombuffer(data, np.uint64, n, 8))
                docs.append(np.frombuffer(data, np.int64, n, 8 + 8 * n))
                many.append(np.frombuffer(data, np.uint32, n, 8 + 16 * n))
        if not heads:
            return
        g, d, m = np.concatenate(heads), np.concatenate(docs), np.concatenate(many).astype(np.int64)
        order = np.argsort(g, kind="stable")
        g, d, m = g[order], d[order], m[order]
        head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        total = np.add.reduceat(m, head)
        twice = np.repeat(total > 1, np.diff(np.r_[head, len(g)])) & (m == 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(d[twice]), pa.array(g[twice].view(np.int64)), pa.nulls(int(twice.sum()), pa.int64())], names=["doc_id", "gram", "n"]
        )
        large = total >= 1000
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(int(large.sum()), pa.int64()), pa.array(g[head][large].view(np.int64)), pa.array(total[large])], names=["doc_id", "gram", "n"]
        )

    return packed.repartition(partitions, "bucket").mapInArrow(run, "doc_id long, gram long, n long")


def sorted_runs(docs: DataFrame, length: int, parts: int, hot: set[int]) -> DataFrame:
    """Front-coded runs by part, and the ranges found to repeat inside a run."""

    def run(batches):
        runs = Runs(parts, length)

        def out():
            blobs, (d, a, b) = runs.flush()
            n, m = len(blobs), len(d)
            return pa.RecordBatch.from_arrays([
                pa.array([*[p for p, _ in blobs], *(d % parts).tolist()], pa.int32()),
                pa.array([*[x for _, x in blobs], *[None] * m], pa.binary()),
                pa.array([*[None] * n, *d.tolist()], pa.int64()),
                pa.array([*[None] * n, *a.tolist()], pa.int64()),
                pa.array([*[None] * n, *b.tolist()], pa.int64()),
            ], names=["part", "blob", "doc_id", "a", "b"])

        for rb in batches:
            for doc, text, grams in zip(rb.column("doc_id").to_pylist(), rb.column("text").to_pylist(), rb.column("grams")):
                data = _bytes(text)
                first, end, at, gram = segments(np.frombuffer(data, np.uint8), length)
                wanted = np.isin(gram, grams.values.to_numpy().view(np.uint64))
                runs.add(doc, data, first[wanted], end[wanted], at[wanted], gram[wanted], hot)
                if len(runs.keys) >= RUN_ITEMS:
                    yield out()
        if runs.keys:
            yield out()

    return docs.mapInArrow(run, "part int, blob binary, doc_id long, a long, b long")


def merged_ranges(runs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Window ranges that occur earlier, packed by document bucket; one task merges the runs of a part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.loc[pdf["blob"].isna(), ["doc_id", "a", "b"]].to_numpy(np.int64)
        blobs = pdf["blob"].dropna().tolist()
        found = np.array(list(repeats([open_run(b) for b in blobs], length)), np.int64).reshape(-1, 3)
        d, a, b = joined(*np.r_[own, found].T)
        bucket = share(d.view(np.uint64) * _MULTIPLIER, buckets).astype(np.int64)
        squeeze = zstandard.ZstdCompressor(level=3)
        rows = []
        for k in np.unique(bucket).tolist():
            at = bucket == k
            rows.append((k, squeeze.compress(np.r_[d[at], a[at], b[at] - a[at]].tobytes())))
        return pd.DataFrame(rows, columns=["bucket", "blob"])

    return runs.groupBy("part").applyInPandas(run, "bucket int, blob binary")


def ranges_by_document(packed: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, ranges) from packed ranges."""

    def run(batches):
        parts = []
        for rb in batches:
            for blob in rb.column("blob").to_pylist():
                data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)
                parts.append(data.reshape(3, -1))
        if not parts:
            return
        d, a, n = np.concatenate(parts, axis=1)
        d, a, b = joined(d, a, a + n)
        head = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        pairs = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        ranges = pa.ListArray.from_arrays(pa.array(np.r_[head, len(d)].astype(np.int32)), pairs)
        yield pa.RecordBatch.from_arrays([pa.array(d[head]), ranges], names=["doc_id", "ranges"])

    return packed.repartition(buckets, "bucket").mapInArrow(run, "doc_id long, ranges array<struct<a:long,b:long>>")


def cut_spans(docs: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """Per document: bytes, removed byte spans and the bytes that stay."""

    def run(batches):
        for rb in batches:
            rows = []
            for text, pairs in zip(rb.column("text").to_pylist(), rb.column("ranges").to_pylist()):
                data = _bytes(text)
                spans: list[list[int]] = []
                for a, b in sorted((p["a"], p["b"]) for p in pairs or ()):
                    z = min(b - 1 + length, len(data))
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], z)
                    elif a < z:
                        spans.append([a, z])
                kept, at = [], 0
                for a, z in spans:
                    kept.append(data[at:a])
                    at = z
                kept.append(data[at:])
                rows.append((len(data), [{"start": a, "end": z} for a, z in spans], b"".join(kept)))
            n, s, k = zip(*rows) if rows else ((), (), ())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(n, pa.int64()), pa.array(s, kind), pa.array(k, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return docs.join(ranges, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(
        run, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, parts: int | None = None, hot_share: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, removed (spans of bytes), kept (the bytes that stay).

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document
    with a smaller id, or earlier in the same one. Null or short text loses nothing. Rows with a null
    id take no part. Rows that share an id are versions of one document: ranges found in one are
    cut from each, and equal ones do not remove each other. Empty tables give empty results. Texts of any
    length are read whole. ``length`` lies between ``GRAM`` (shorter strings hold no K-gram) and ``LONGEST`` (a key tells how
    far its anchor lies from the first window in one byte); other lengths raise ValueError.

    A K-gram with over ``hot_share`` segments (default: a quarter of a part's fair share, so there
    are at most four such K-grams a part) is not sent to one reducer: its windows are sent one by
    one, spread by their own bytes.
    """
    if not GRAM <= length <= LONGEST:
        raise ValueError(f"length must be from {GRAM} to {LONGEST}, not {length}")
    spark = docs.sparkSession
    source = slim(docs, doc_id=id_col, text=text_col)
    buckets = spread(source)
    place = scratch_path(spark, "suffix")
    repeated_grams(anchor_grams(source, length, buckets), buckets, buckets).write.parquet(f"{place}/grams")
    found = spark.read.parquet(f"{place}/grams")
    flagged = found.where("doc_id is not null")
    n = flagged.count()
    parts = parts or max(buckets, -(-n // PART_ITEMS))
    limit = hot_share or max(1000, n // (4 * parts))
    hot = {r["gram"] % 2**64 for r in found.where("doc_id is null").where(F.col("n") > limit).select("gram").distinct().collect()}
    wanted = flagged.groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))
    chosen = source.join(wanted, "doc_id").select("doc_id", "text", "grams")
    packed = merged_ranges(sorted_runs(chosen, length, parts, hot), length, buckets)
    return cut_spans(source, ranges_by_document(packed, buckets), length)
