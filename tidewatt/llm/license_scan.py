"""Fuzzy search for short license notices in whole texts.

A phrase that may carry e edits is split into e + 1 pieces: wherever it occurs with at most e edits,
one piece stands unchanged (pigeonhole). The pieces are found as exact seeds; around each seed the
``regex`` library's bounded-error matching decides and gives edits and span. Words are what stands
between ASCII characters other than letters and digits, A-Z in lower case.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slim

#: Phrase -> label. The first three are searched without edits as well as with.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "lesser general public license": "lgpl",
    "dedicated to the public domain": "public-domain",
}
#: One edit for so many characters of a phrase; shorter phrases are matched exactly.
CHARACTERS_PER_EDIT = 10

_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 96 or 123 <= c <= 127 else c for c in range(256)
)


class Notice:
    def __init__(self, phrase: str, label: str, edits: int | None = None):
        self.phrase, self.label = phrase, label
        self.edits = len(phrase) // CHARACTERS_PER_EDIT if edits is None else edits
        raw = phrase.encode()
        cuts = [round(i * len(raw) / (self.edits + 1)) for i in range(self.edits + 2)]
        self.seeds = [(raw[a:b], a) for a, b in zip(cuts, cuts[1:])]
        self.bounded = regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(phrase, literal_spaces=True)}){{e<={self.edits}}}(?![^ ])")
        self.exact = b" " + raw + b" "

    def spans(self, line: bytes) -> dict[tuple[int, int], tuple[int, str]]:
        """{(start, end) in ``line``: (edits, text)}; ``line`` has single spaces, also at its ends."""
        found: dict[tuple[int, int], tuple[int, str]] = {}
        size = len(self.phrase)
        for seed, offset in self.seeds:
            at = line.find(seed)
            while at >= 0:
                start = at - offset
                if start >= 1 and line[start - 1 : start + size + 1] == self.exact:
                    found[start, start + size] = (0, self.phrase)
                elif self.edits:
                    self._verify(line, start, found)
                at = line.find(seed, at + 1)
        return found

    def _verify(self, line: bytes, start: int, found: dict) -> None:
        """Match around a seed, in a window of whole words with the blanks beside them: without a blank the matcher inserts nothing at the ends."""
        low = max(0, line.rfind(b" ", 0, max(1, start - self.edits + 1)))
        high = line.find(b" ", min(len(line) - 1, start + len(self.phrase) + self.edits - 1))
        window = line[low : high + 1 if high >= 0 else len(line)]
        hit = self.bounded.search(window.decode("utf-8"))
        if hit and hit.group().strip():
            text = hit.group()
            begin = low + len(window.decode("utf-8")[: hit.start()].encode("utf-8"))
            lead = len(text) - len(text.lstrip(" "))
            text = text.strip(" ")
            key = (begin + lead, begin + lead + len(text.encode("utf-8")))
            if key not in found:
                found[key] = (sum(hit.fuzzy_counts), text)


def scan(text: str | None, notices: list[Notice]) -> tuple[int, list[dict]]:
    """Number of words, and the notices in reading order.

    Of matches of one notice that overlap, the one with the fewest edits stays; exact ones all stay.
    """
    words = (text or "").encode("utf-8").translate(_TO_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    out = []
    for notice in notices:
        taken: list[tuple[int, int]] = []
        spans = notice.spans(line)
        for (a, b), (edits, found) in sorted(spans.items(), key=lambda x: (x[1][0], x[0])):
            if edits and any(a < y and x < b for x, y in taken):
                continue
            taken.append((a, b))
            out.append((a, b, notice, edits, found))
    out.sort(key=lambda x: (x[0], x[1], x[2].label))
    rows, at, word = [], 1, 0
    for a, b, notice, edits, found in out:
        word += line.count(b" ", at, a)
        at = a
        rows.append({
            "label": notice.label, "phrase": notice.phrase, "first_word": word, "n_words": found.count(" ") + 1,
            "edits": edits, "similarity": 1.0 - edits / len(notice.phrase), "found": found,
        })
    return len(words), rows


SPAN = "struct<label:string,phrase:string,first_word:long,n_words:long,edits:int,similarity:double,found:string>"


def find_notices(docs: DataFrame, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, spans (label, phrase, words, edits, similarity, text found).

    Null and empty text have no words and no spans. Repeated rows and null ids are kept as they come;
    an empty table gives an empty result; other columns are ignored.
    """
    wanted = BASE | NOTICES if phrases is None else phrases
    source = slim(docs, doc_id=id_col, text=text_col)
    made: list[Notice] = []

    def run(batches):
        if not made:
            made.extend(Notice(p, label) for p, label in wanted.items())
        for pdf in batches:
            n, spans = zip(*[scan(t, made) for t in pdf["text"].array]) if len(pdf) else ((), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": n, "spans": list(spans)})

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(run, f"doc_id {kind}, n_words long, spans array<{SPAN}>")


def summary(found: DataFrame, base: dict[str, str] = BASE) -> DataFrame:
    """Labels and places of the exact base phrases, and all labels with the best similarity."""
    exact = F.filter("spans", lambda s: (s["edits"] == 0) & s["phrase"].isin(*base))
    at = F.transform("base", lambda s: s["first_word"])

    def listed(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    best = F.array_max(F.transform("spans", lambda s: s["similarity"]))
    return found.withColumn("base", exact).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        listed("base").alias("base_labels"), listed("spans").alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"),
    )
