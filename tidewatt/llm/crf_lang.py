"""Language of each word, and of each text, by a linear-chain conditional random field.

Features of a word are its affixes (n-grams that touch its ends), inner character n-grams and the
lexicons it stands in; transitions between the languages of neighbouring words are learned too. The
field is fitted by gradient steps on the exact likelihood (forward-backward) over a bounded sample of
labelled rows, whose passages are strung together across languages so that switches occur. Words of
a whole text are then labelled by forward-backward, all texts of a batch side by side in blocks.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_in_worker, slim

#: Bounds of the labelled sample: rows per language, and passages and words taken from each.
ROWS_PER_LANGUAGE = 300
PASSAGES = 8
PASSAGE_WORDS = 16
SEQUENCE_WORDS = 48
STEPS = 60
BITS = 18
GRAMS = (1, 2, 3, 4)
#: Words of a batch that are labelled side by side, and words per block.
BATCH_WORDS = 100_000
BLOCK = 64
#: Words whose scores a worker keeps at hand; only speed depends on it.
CACHE_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() for w in words) or any(c.isalpha() for w in words for c in w)


def gram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hashed feature) of all affixes and n-grams of the words, ends marked."""
    raw = [b"\x02" + w.encode("utf-8") + b"\x03" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    rows, features = [], []
    h = np.zeros(len(data), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            if len(data) < n:
                break
            h = h[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :] + np.uint64(1)
            if n in GRAMS:
                whole = owner[: len(h)] == owner[n - 1 :]
                rows.append(owner[: len(h)][whole])
                features.append(((h[whole] ^ np.uint64(n << 56)) * _ODD >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(features)


@dataclass
class Field:
    languages: list[str]
    grams: np.ndarray  # (2**BITS, L)
    lexicon: dict[str, int]  # word -> language whose lexicon holds it
    known: np.ndarray  # (L, L): weight of a lexicon for each label
    moves: np.ndarray  # (L, L)
    start: np.ndarray  # (L,)

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of words, one row each."""
        out = np.zeros((len(words), len(self.languages)))
        if not words:
            return out
        rows, features = gram_features(words)
        many = np.bincount(rows, minlength=len(words))
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(rows, self.grams[features, k], len(words)) / np.sqrt(many)
        listed = np.array([self.lexicon.get(w, -1) for w in words])
        out[listed >= 0] += self.known[listed[listed >= 0]]
        return out


def forward_backward(e: np.ndarray, moves: np.ndarray, start: np.ndarray):
    """Marginals (n, t, L), expected moves (L, L) and log-likelihood parts for equally long chains."""
    n, t, k = e.shape
    top = e.max(axis=2, keepdims=True)
    p, m = np.exp(e - top), np.exp(moves)
    alpha, beta, scale = np.zeros((n, t, k)), np.ones((n, t, k)), np.zeros((n, t))
    alpha[:, 0] = np.exp(start) * p[:, 0]
    for i in range(t):
        if i:
            alpha[:, i] = (alpha[:, i - 1] @ m) * p[:, i]
        scale[:, i] = alpha[:, i].sum(axis=1)
        alpha[:, i] /= scale[:, i, None]
    expected = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        ahead = p[:, i + 1] * beta[:, i + 1] / scale[:, i + 1, None]
        beta[:, i] = ahead @ m.T
        expected += alpha[:, i].T @ ahead * m
    return alpha * beta, expected, np.log(scale).sum() + top.sum()


def fit(passages: list[tuple[str, list[str]]], steps: int = STEPS, seed: int = 7) -> Field:
    """Fit the field on (language, words) passages."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in passages})
    code = {lang: i for i, lang in enumerate(languages)}
    k = len(languages)
    counts: dict[str, np.ndarray] = {}
    for lang, words in passages:
        for w in words:
            counts.setdefault(w, np.zeros(k))[code[lang]] += 1
    vocabulary = list(counts)
    place = {w: i for i, w in enumerate(vocabulary)}
    lexicon = {w: int(c.argmax()) for w, c in counts.items() if c.max() >= 3 and c.max() >= 0.8 * c.sum()}
    # Strings of words: passages in random order, so that neighbours often differ in language.
    order = rng.permutation(len(passages))
    ids = np.array([place[w] for i in order for w in passages[i][1]], np.int64)
    gold = np.array([code[passages[i][0]] for i in order for _ in passages[i][1]], np.int64)
    n = max(1, len(ids) // SEQUENCE_WORDS)
    take = min(len(ids), SEQUENCE_WORDS)
    ids, gold = ids[: n * take].reshape(n, take), gold[: n * take].reshape(n, take)
    rows, features = gram_features(vocabulary)
    norm = 1 / np.sqrt(np.bincount(rows, minlength=len(vocabulary)))
    listed = np.array([lexicon.get(w, -1) for w in vocabulary])
    field = Field(languages, np.zeros((1 << BITS, k)), lexicon, np.zeros((k, k)), np.zeros((k, k)), np.zeros(k))
    seen = [np.full(x.shape, 1e-6) for x in (field.grams, field.known, field.moves, field.start)]
    truth = np.eye(k)[gold]
    moved = np.zeros((k, k))
    np.add.at(moved, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    # A language counts the same however many words it has.
    for _ in range(steps):
        e = field.scores(vocabulary)[ids]
        marginal, expected, _ = forward_backward(e, field.moves, field.start)
        back = np.zeros((len(vocabulary), k))
        np.add.at(back, ids.ravel(), (truth - marginal).reshape(-1, k))
        per = back * norm[:, None]
        grad = np.stack([np.bincount(features, per[rows, c], 1 << BITS) for c in range(k)], 1)
        lex = np.zeros((k, k))
        np.add.at(lex, listed[listed >= 0], back[listed >= 0])
        steps_of = (grad - 1e-3 * field.grams, lex - 1e-3 * field.known, moved - expected - 1e-3 * field.moves, truth[:, 0].sum(0) - marginal[:, 0].sum(0))
        for weights, g, s in zip((field.grams, field.known, field.moves, field.start), steps_of, seen):
            s += g * g
            weights += 0.3 * g / np.sqrt(s)
    field.grams = field.grams.astype(np.float32)
    return field


def training_passages(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[str, list[str]]]:
    """At most so many labelled rows per language, PASSAGES stretches of PASSAGE_WORDS words of each."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= rows_per_language)
    texts = usable.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")

    def run(batches):
        for pdf in batches:
            out = []
            for doc, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"]):
                words = words_of(text)
                rng = np.random.default_rng(abs(int(doc)) if pd.notna(doc) else 0)
                spots = sorted({int(s) for s in rng.integers(0, max(1, len(words) - PASSAGE_WORDS + 1), PASSAGES)})
                out += [(doc, lang, s, " ".join(words[s : s + PASSAGE_WORDS])) for s in spots if words]
            yield pd.DataFrame(out, columns=["doc_id", "lang", "spot", "words"])

    rows = texts.select("doc_id", "lang", "text").mapInPandas(run, "doc_id long, lang string, spot long, words string").collect()
    return [(r["lang"], r["words"].split(" ")) for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["spot"], r["words"]))]


class Labeller:
    """Runs the field over batches of texts; emission scores of words are kept between batches."""

    def __init__(self, field: Field):
        self.field = field
        self.m = np.exp(field.moves).astype(np.float64)
        self.start = np.exp(field.start - field.start.max())
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(field.languages)))

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > CACHE_WORDS:
            self.rows.clear()
        new = list(set(words) - self.rows.keys())
        if new:
            s = self.field.scores(new)
            p = np.exp(s - s.max(axis=1, keepdims=True)) + 1e-12
            at, end = len(self.rows), len(self.rows) + len(new)
            if end > len(self.table):
                grown = np.zeros((max(end, 2 * len(self.table)), self.table.shape[1]))
                grown[: len(self.table)] = self.table
                self.table = grown
            self.table[at:end] = p
            self.rows.update(zip(new, range(at, end)))
        return self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]

    def marginals(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Posterior of each label for each word; texts of ``sizes`` (all above 0) words in a row.

        A text is cut into blocks of BLOCK words. The product of steps inside each block is formed
        for all blocks at once, carried over the blocks of a text, and then filled in again.
        """
        k = p.shape[1]
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        text = np.repeat(np.arange(len(sizes)), blocks)
        at = np.arange(len(p)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row, col = np.repeat(first, sizes) + at // BLOCK, at % BLOCK
        e = np.ones((len(text), BLOCK, k))
        real = np.zeros((len(text), BLOCK), bool)
        e[row, col], real[row, col] = p, True
        head = np.zeros(len(text), bool)
        head[first] = True
        product = np.broadcast_to(np.eye(k), (len(text), k, k)).copy()
        for t in range(BLOCK):
            step = (product.reshape(-1, k) @ self.m).reshape(-1, k, k)
            if t == 0:
                step[head] = product[head]
            step *= e[:, t, None, :]
            step /= step.sum(axis=(1, 2), keepdims=True)
            product = np.where(real[:, t, None, None], step, product)
        enter = np.ones((len(text), k))
        enter[first] = self.start
        leave = np.ones((len(text), k))
        last = first + blocks - 1
        for b in range(1, int(blocks.max())):
            on = first[blocks > b] + b
            x = np.einsum("ni,nij->nj", enter[on - 1], product[on - 1])
            enter[on] = x / x.sum(axis=1, keepdims=True)
            off = last[blocks > b] - b
            y = np.einsum("nij,nj->ni", product[off + 1], leave[off + 1])
            leave[off] = y / y.sum(axis=1, keepdims=True)
        alpha = np.empty_like(e)
        x = enter
        for t in range(BLOCK):
            y = x @ self.m
            if t == 0:
                y[head] = x[head]
            y *= e[:, t]
            y /= y.sum(axis=1, keepdims=True)
            x = np.where(real[:, t, None], y, x)
            alpha[:, t] = x
        x = leave
        for t in range(BLOCK - 1, -1, -1):
            alpha[:, t] *= x
            y = (x * e[:, t]) @ self.m.T
            y /= y.sum(axis=1, keepdims=True)
            x = np.where(real[:, t, None], y, x)
        out = alpha[row, col]
        return out / out.sum(axis=1, keepdims=True)

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[dict], float]]:
        """Per text: language (und without letters), mean posterior of it, runs of languages, and how sure the words are of theirs."""
        out: list = [("und", 0.0, [], 0.0)] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        total = 0
        for i, t in enumerate(texts):
            words = words_of(t)
            if has_letter(words):
                waiting.append((i, words))
                total += len(words)
            if total >= BATCH_WORDS:
                self._settle(waiting, out)
                waiting, total = [], 0
        self._settle(waiting, out)
        return out

    def _settle(self, waiting, out) -> None:
        if not waiting:
            return
        names = self.field.languages
        sizes = np.array([len(w) for _, w in waiting])
        post = self.marginals(self.emissions([w for _, words in waiting for w in words]), sizes)
        starts = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(post, starts, axis=0) / sizes[:, None]
        best = post.argmax(axis=1)
        sure = np.add.reduceat(post.max(axis=1), starts) / sizes
        for (i, _), a, n, m, s in zip(waiting, starts.tolist(), sizes.tolist(), mean, sure.tolist()):
            mine = best[a : a + n]
            cuts = np.flatnonzero(np.diff(mine)) + 1
            edges = [0, *cuts.tolist(), n]
            runs = [{"lang": names[mine[x]], "first_word": x, "n_words": y - x} for x, y in zip(edges, edges[1:])]
            top = int(m.argmax())
            out[i] = (names[top], min(1.0, float(m[top])), runs, min(1.0, s))


def label_texts(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, lang_pred, score, runs (language, first word, number of words).

    Null text and text without a letter is ``und`` with score 0 and no runs. Repeated rows and null
    ids are kept as they come; an empty table gives an empty result.
    """
    source = slim(docs, doc_id=id_col, text=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(vars(field))
    key = uuid.uuid4().hex
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        labeller = kept_in_worker("field", key, lambda: Labeller(Field(**sent.value)))
        for pdf in batches:
            got = labeller.label([None if t is None else t for t in pdf["text"].array])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "runs": [g[2] for g in got]})

    return source.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double, runs array<struct<lang:string,first_word:long,n_words:long>>")


def verdict(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang"):
    """A column (lang_pred, score, sure) for ``docs``, learned from its own labelled rows that are not held out; None without any.

    ``sure`` is the mean over the words of the posterior of each word's best language: high for a text that
    changes languages, too.
    """
    source = slim(docs, doc_id=id_col, text=text_col, lang=lang_col)
    passages = training_passages(source.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    if not passages:
        return None
    sent = docs.sparkSession.sparkContext.broadcast(vars(fit(passages)))
    key = uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double, sure double")
    def of(texts: pd.Series) -> pd.DataFrame:
        got = kept_in_worker("field", key, lambda: Labeller(Field(**sent.value))).label(list(texts))
        return pd.DataFrame({"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "sure": [g[3] for g in got]})

    return of(F.col(text_col))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """Learn from the rows that are not held out and label all: adds held_out to ``label_texts``.

    A row with a null id is not held out. Without any labelled row every text is ``und``.
    """
    source = slim(docs, doc_id=id_col, text=text_col, lang=lang_col)
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    passages = training_passages(source.where(~out), rows_per_language)
    if not passages:
        return source.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), out.alias("held_out"))
    return label_texts(source, fit(passages)).withColumn("held_out", out)
