"""Quality and toxicity of documents by hierarchical empirical Bayes over sites.

A classifier, fitted on a bounded sample of labelled rows, gives each document its own evidence.
Grouped sums of that evidence give a posterior per host and per path of a host, each shrunk towards
the level above it: the fewer documents a site has, and the less sites differ, the closer it stays to
its prior. The strength of the shrinkage is estimated from the spread between groups (moments). A
document's odds are its own evidence times the odds of its path, from which its own share is taken out.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, kept_in_worker, slim

#: Labelled rows the classifier is fitted on, at most (chosen by hash of the id).
TRAIN_ROWS = 6000
BITS = 17
#: Words count as features from so many standard errors of difference between the classes.
TELLING = 6.0
STEPS = 120
TARGETS = ("quality", "toxic")
_WORD = re.compile(r"[^\W\d_]+")
_MARK = re.compile(r"[^\w\s.,;:'\"()-]")
_CACHE = 500_000


class _Spots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = spot = zlib.crc32(word.encode("utf-8")) >> (32 - BITS)
        return spot


SHAPES = 7


def evidence(text: str, known: _Spots) -> tuple[np.ndarray, list[float]]:
    """Hashed words that occur, and measures of the text's shape."""
    words = _WORD.findall(text)
    n = max(1, len(words))
    tokens = max(1, text.count(" ") + text.count("\n") + 1)
    low = [w.lower() for w in words]
    different = set(low)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    marks = len(_MARK.findall(text))
    shapes = [
        1.0, marks / tokens, upper / n, 1 - len(different) / n, text.count("|") / tokens, sum(map(str.isdigit, text)) / max(1, len(text)), np.log1p(n) / 10,
    ]
    spots = np.unique(np.fromiter(map(known.__getitem__, different), np.int64, len(different)))
    return spots, shapes


@dataclass
class Model:
    words: np.ndarray  # (2**BITS, targets)
    shapes: np.ndarray  # (SHAPES, targets)
    base: np.ndarray  # mean of each target

    def probabilities(self, texts, known: _Spots) -> np.ndarray:
        out = np.empty((len(texts), len(TARGETS)))
        for i, t in enumerate(texts):
            if not t:
                out[i] = self.base
                continue
            spots, shapes = evidence(t, known)
            out[i] = self.words[spots].sum(axis=0) + np.array(shapes) @ self.shapes
            out[i] = 1 / (1 + np.exp(-np.clip(out[i], -30, 30)))
        return out


def telling(owner: np.ndarray, spots: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which entries are words whose share differs between the classes by TELLING standard errors."""
    one, zero = y == 1, y == 0
    if not one.any() or not zero.any():
        return np.zeros(len(spots), bool)
    a = np.bincount(spots, one[owner], 1 << BITS) / one.sum()
    b = np.bincount(spots, zero[owner], 1 << BITS) / zero.sum()
    p = (a * one.sum() + b * zero.sum()) / (one.sum() + zero.sum())
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / one.sum() + 1 / zero.sum()))
    return (np.abs(a - b) >= TELLING * error)[spots]


def fit(rows: list[tuple[np.ndarray, list[float], list[float]]], steps: int = STEPS) -> Model:
    """Logistic regressions by adaptive gradient steps; a target of NaN is left out."""
    y = np.array([r[2] for r in rows], float).reshape(-1, len(TARGETS))
    shapes = np.array([r[1] for r in rows], float).reshape(-1, SHAPES)
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    spots = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    often = np.bincount(spots, minlength=1 << BITS)
    kept = often[spots] >= 3
    owner, spots = owner[kept], spots[kept]
    base = np.array([np.clip(np.nanmean(c) if (~np.isnan(c)).any() else 0.5, 0.001, 0.999) for c in y.T]) if len(rows) else np.full(len(TARGETS), 0.5)
    model = Model(np.zeros((1 << BITS, len(TARGETS))), np.zeros((SHAPES, len(TARGETS))), base)
    model.shapes[0] = np.log(base / (1 - base))
    for k in range(len(TARGETS)):
        known = ~np.isnan(y[:, k])
        use = telling(owner, spots, y[:, k])
        mine, words = owner[use], spots[use]
        w, s = model.words[:, k], model.shapes[:, k]
        gw, gs = np.full(len(w), 1e-2), np.full(SHAPES, 1e-2)
        for _ in range(steps):
            z = np.bincount(mine, w[words], len(rows)) + shapes @ s
            wrong = np.where(known, np.nan_to_num(y[:, k]) - 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0)
            dw = np.bincount(words, wrong[mine], 1 << BITS) - 0.1 * w
            ds = shapes.T @ wrong
            gw += dw * dw
            gs += ds * ds
            w += 0.2 * dw / np.sqrt(gw)
            s += 0.5 * ds / np.sqrt(gs)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out (crc32 of the id mod 4 is 2)."""
    known = slim(labels, key="doc_id", **{t: t for t in TARGETS}).where(F.col("key").isNotNull() & ~held_out(F.col("key")))
    chosen = known.orderBy(F.xxhash64("key"), "key", *TARGETS).limit(rows)
    picked = docs.where(F.length("text") > 0).join(F.broadcast(chosen), F.col("doc_id") == F.col("key"))

    def run(batches):
        known = _Spots()
        for pdf in batches:
            out = [evidence(t, known) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spots": [o[0] for o in out], "shapes": [o[1] for o in out], **{t: pdf[t] for t in TARGETS}})

    got = picked.select("doc_id", "text", *[F.col(t).cast("double").alias(t) for t in TARGETS]).mapInPandas(
        run, "doc_id long, spots array<long>, shapes array<double>, " + ", ".join(f"{t} double" for t in TARGETS)
    ).toPandas()
    got = got.sort_values(["doc_id", *TARGETS], kind="stable")
    return fit([(np.asarray(s, np.int64), list(h), list(y)) for s, h, *y in zip(got["spots"], got["shapes"], *[got[t] for t in TARGETS])])


def shrinkage(groups: DataFrame, above: list[str], n: str, total: str, square: str) -> DataFrame:
    """One row: mean, and how many documents a prior counts as (kappa), by moments.

    ``groups`` has a row per group with its count, sum and sum of squares; the spread is taken around
    the mean of the level ``above`` (columns that hold its mean), less what chance explains.
    """
    mean = F.col(total) / F.col(n)
    centre = F.col(above[0]) if above else F.lit(None)
    g = groups.agg(
        F.sum(n).alias("N"), F.sum(total).alias("T"), F.sum(F.col(square) - F.col(total) * mean).alias("within"),
        F.count(F.lit(1)).alias("G"), F.sum(F.col(n) * F.pow(mean - centre, 2)).alias("spread"), F.sum(F.col(n) * F.col(n)).alias("NN"),
        F.sum(F.col(total) * mean).alias("TM"),
    )
    mu = F.col("T") / F.col("N")
    spread = F.coalesce("spread", F.col("TM") - F.col("N") * mu * mu)
    noise = F.when(F.col("N") > F.col("G"), F.col("within") / (F.col("N") - F.col("G"))).otherwise(mu * (1 - mu))
    free = F.col("N") - F.col("NN") / F.col("N")
    tau = F.when(free > 0, (spread - (F.col("G") - 1) * noise) / free)
    kappa = F.when(tau > 0, mu * (1 - mu) / tau - 1).otherwise(F.lit(1e6))
    return g.select(mu.alias("mu"), F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.coalesce(kappa, F.lit(1e6)))).alias("kappa"))


def _logit(p: Column) -> Column:
    q = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    return F.log(q / (1 - q))


def posterior(scored: DataFrame, p: str, into: str) -> DataFrame:
    """Add ``into``: the probability ``p`` combined with the posterior of the row's host and path."""
    paths = durable(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("t"), F.sum(F.col(p) * F.col(p)).alias("tt")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("t").alias("ht"), F.sum("tt").alias("htt"))
    world = F.broadcast(shrinkage(hosts, [], "hn", "ht", "htt").select(F.col("mu"), F.col("kappa").alias("host_kappa")))
    inside = paths.join(hosts.select(F.col("host").alias("h"), "hn", "ht"), F.col("host").eqNullSafe(F.col("h")))
    local = F.broadcast(shrinkage(inside.withColumn("hm", F.col("ht") / F.col("hn")), ["hm"], "n", "t", "tt").select(F.col("kappa").alias("path_kappa")))
    sites = inside.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), "n", "t", "hn", "ht")
    rows = scored.join(sites, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    rows = rows.crossJoin(world).crossJoin(local)
    host = (F.col("host_kappa") * F.col("mu") + F.col("ht") - F.col(p)) / (F.col("host_kappa") + F.col("hn") - 1)
    path = (F.col("path_kappa") * host + F.col("t") - F.col(p)) / (F.col("path_kappa") + F.col("n") - 1)
    odds = _logit(F.col(p)) + _logit(path) - _logit(F.col("mu"))
    return rows.withColumn(into, 1 / (1 + F.exp(-odds))).select(*scored.columns, into, path.alias(f"{into}_path"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row: doc_id, held_out, quality, toxicity, quality_path, toxicity_path, kept.

    ``kept`` asks for quality of at least and toxicity under one half. Null and empty text has no
    evidence of its own: it takes the mean of its path. Null hosts or paths form a group of their
    own, rows with null ids are scored like any other, repeated rows each count, and without any
    label all rows score one half. An empty table gives an empty result.
    """
    source = slim(docs, doc_id=id_col, text=text_col, host=host, path=path)
    sent = docs.sparkSession.sparkContext.broadcast(vars(train(source, labels, rows)))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = Model(**sent.value)
        spots = kept_in_worker("spots", BITS, _Spots)
        for pdf in batches:
            p = model.probabilities(list(pdf["text"].array), spots)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "host": pdf["host"], "path": pdf["path"], "q": p[:, 0], "x": p[:, 1]})

    named = source.select("doc_id", "text", F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"))
    scored = durable(named.mapInPandas(run, f"doc_id {kind}, host string, path string, q double, x double"))
    both = posterior(posterior(scored, "q", "quality"), "x", "toxicity")
    return both.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "quality", "toxicity", "quality_path", "toxicity_path",
        ((F.col("quality") >= 0.5) & (F.col("toxicity") < 0.5)).alias("kept"),
    )
