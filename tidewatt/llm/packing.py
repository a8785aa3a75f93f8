"""Sequence packing by Karmarkar-Karp multiway differencing.

Documents are tokenised and cut at multiples of the window length; full pieces fill windows of
their own. The rest of a document, halved if it is over half a window, is packed in batches as the
scan delivers them: the pieces of a batch are split over k windows by repeatedly merging the two partial
partitions with the largest spread, heavy windows of one onto light windows of the other. k starts
at the fewest windows that could hold the batch and rises while a window exceeds the capacity.
Nothing is shuffled, so no key can be hot, and neighbours in the input stay neighbours.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, slim

#: Pieces packed together.
BATCH = 256
#: Words whose ids a worker keeps at hand; only speed depends on it.
CACHE_WORDS = 500_000
#: Characters for which the tokenizer's own split of a text is known to be the pattern below.
#: Texts with others take the tokenizer's full path.
_OTHER = re.compile("[^\t\n\v\f\r\x20-\x7e\xa1-\xac\xae-įı-ſ]")
_LETTERS = "a-zªµºß-öø-ÿĀ-ſ"
_NUMBERS = "0-9²³¹¼½¾"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


class _Known(dict):
    """Ids of text without white space; what is missing is split, looked up in the model and kept."""

    def __init__(self, tokens: WordTokenizer):
        self.letters, self.model = tokens.letters, tokens.model

    def __missing__(self, chunk: str) -> bytes:
        words = _WORDS.findall(chunk.lower())
        if words == [chunk]:
            shown = chunk if chunk.isascii() else "".join(map(self.letters.__getitem__, chunk.encode("utf-8")))
            ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        else:
            ids = b"".join([self[w] for w in words])
        self[chunk] = ids
        return ids


class WordTokenizer:
    """Ids of a text as little-endian 32-bit bytes, word by word through the tokenizer's model."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.cache_words = cache_words

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.known = _Known(self)
        self.plain = self._is_plain()

    def _is_plain(self) -> bool:
        """Whether the word path gives the tokenizer's ids on a sample of all safe characters."""
        probe = "".join(map(chr, range(32, 384)))
        probe = " ".join([_OTHER.sub("", probe), "it's They'll WE'VE x'd 12 3½ <<>> a\tb\nc é Ñandú ÀÉ straße"])
        return self._by_words(probe) == self._whole(probe)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _by_words(self, text: str) -> bytes:
        if len(self.known) > self.cache_words:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, text.split()))

    def encode(self, text: str) -> bytes:
        if not self.plain or _OTHER.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        return self._by_words(text)


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Split ``sizes`` over ``windows`` near equally: (window of each item, load of each window).

    A partial partition is a vector of window loads, largest first, less their smallest. The two
    with the largest spread are merged, largest against smallest, until one is left.
    """
    order = np.argsort(-sizes, kind="stable")
    partials = {}
    heap = []
    for n, i in enumerate(order.tolist()):
        partials[n] = ([int(sizes[i])], [[i]])
        heap.append((-int(sizes[i]), n))
    heapq.heapify(heap)
    fresh = len(partials)
    while len(heap) > 1:
        (_, x), (_, y) = heapq.heappop(heap), heapq.heappop(heap)
        loads, members = _opposed(partials.pop(x), partials.pop(y), windows)
        spread = loads[0] - (loads[-1] if len(loads) == windows else 0)
        partials[fresh] = (loads, members)
        heapq.heappush(heap, (-spread, fresh))
        fresh += 1
    window = np.zeros(len(sizes), np.int64)
    load = np.zeros(windows, np.int64)
    for _, members in partials.values():
        for w, items in enumerate(members):
            window[items] = w
            load[w] = sizes[items].sum()
    return window, load


def _opposed(one, two, windows: int):
    """Merge two partial partitions: heavy windows of one meet light or empty windows of the other."""
    (a, am), (b, bm) = one, two
    if len(a) < len(b):
        a, am, b, bm = b, bm, a, am
    free = windows - len(a)
    alone = min(free, len(b))
    rows = [*zip(b[:alone], bm[:alone])]
    rest, shift = len(b) - alone, len(a) - (len(b) - alone)
    rows += zip(a[:shift], am[:shift])
    for k in range(rest):
        low = len(a) - 1 - k
        rows.append((a[low] + b[alone + k], am[low] + bm[alone + k]))
    rows.sort(key=lambda r: -r[0])
    return [r[0] for r in rows], [r[1] for r in rows]


def balanced(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item; the window count rises until no window exceeds the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, load = differencing(sizes, windows)
        if load.max(initial=0) <= capacity:
            return window
        windows += max(1, windows // 200)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Tokenise and pack: one row per piece with its ids and its place.

    doc_id, start, ids (little-endian 32-bit), length, doc_tokens, sequence_id, offset. Every id lies in one piece, and pieces lie
    gapless in their sequence from 0. Null text counts as empty: with ``end_id`` it is one id, without
    it has no piece. Repeated rows are packed once each; null ids are carried along; an empty
    table gives an empty result. Sequence ids are unique, not consecutive: they hold the input
    partition and a running number.
    """
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    schema = "doc_id {}, start long, ids binary, length long, doc_tokens long, sequence_id long, offset long"

    def run(batches):
        tokens = kept_in_worker("tokenizer", (tokenizer, cache_words), lambda: WordTokenizer(tokenizer, cache_words))
        number = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []

        def place(rows):
            nonlocal number
            sizes = np.array([len(r[2]) // 4 for r in rows], np.int64)
            window = balanced(sizes, capacity)
            order = np.argsort(window, kind="stable")
            at, last, out = 0, -1, []
            for i in order.tolist():
                if window[i] != last:
                    last, at = window[i], 0
                    number += 1
                out.append((*rows[i][:3], int(sizes[i]), rows[i][3], number - 1, at))
                at += int(sizes[i])
            return out

        def emit(rows):
            return pd.DataFrame(rows, columns=["doc_id", "start", "ids", "length", "doc_tokens", "sequence_id", "offset"])

        for pdf in batches:
            out = []
            held = 0
            for doc, text in zip(pdf["doc_id"].array, pdf["text"].array):
                ids = (tokens.encode(text) if text is not None else b"") + tail
                n = len(ids) // 4
                full = n - n % capacity
                for start in range(0, full, capacity):
                    out.append((doc, start, ids[4 * start : 4 * (start + capacity)], capacity, n, number, 0))
                    number += 1
                    held += 4 * capacity
                cuts = -(-(n - full) // (capacity // 2 or 1))
                for k in range(cuts):
                    a, b = full + (n - full) * k // cuts, full + (n - full) * (k + 1) // cuts
                    waiting.append((doc, a, ids[4 * a : 4 * b], n))
                if len(waiting) >= batch:
                    out += place(waiting)
                    waiting = []
                    held += batch * capacity * 2
                if held > 16_000_000:
                    yield emit(out)
                    out, held = [], 0
            if out:
                yield emit(out)
        if waiting:
            yield emit(place(waiting))

    source = slim(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(run, schema.format(kind))


def digest(packed: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
