"""Alignment of two tokenizers over the bytes of a text.

Tokens of both cover the same bytes. A dictionary per tokenizer leads from the byte where a token ends
to how many tokens end up to there; the ends that both dictionaries hold, sorted, slice both id lists into
groups, and each slice is expanded into links: all pairs of its occurrences. How many documents hold a
pair of ids linked is counted over the corpus, and each document is told how its links stand in those counts.

Both tokenizers cut between words, so groups never cross them: a word is aligned once, and the Python worker keeps
what it found for the words that come again. Texts for which such a cut is not certain are aligned in one piece.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt.session import scratch_path

from .common import durable, kept_in_worker, slim

#: Characters tokenised at once, and links of a document expanded at once.
AT_ONCE, LINKS = 400_000, 1 << 20
#: Pairs of ids whose counts are broadcast; at most this many are common enough, see ``common_from``.
COMMON_PAIRS = 400_000
#: Between two ASCII letters with one space before the second the byte-level tokenizer always cuts.
_CUT = re.compile("[A-Za-z](?= [A-Za-z])")
#: Texts with other characters than these, or with longer words or gaps, take A's own way: for them the split may differ.
_OTHER, _GAP, LONGEST_WORD = re.compile("[^\t\n\v\f\r\x20-\x7e\xa1-\xac\xae-\u017f]"), re.compile(r"\s{500}"), 500
#: Letters only; after a run of them A cuts unless another letter follows.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: Words of a space and a text: blanks with letters; what follows these without a blank; blanks with anything.
_WORD = re.compile(rf"[ \n]+[{_LETTERS}]+|[ \n]+[^ \n]*|[^ \n]+")
_BLANK, _AFTER_LETTER = re.compile(r"[^\S \n]"), re.compile(f"[{_LETTERS}](?=[^{_LETTERS}])")
#: Bytes of the words a worker keeps in each of two lots (140,000 common ones); texts with a longer word, or one of more links, are aligned in one piece.
KEPT_BYTES, WORD_LENGTH, WORD_LINKS = 50_000_000, 64, 256
#: After texts with fewer words for each one not met before, so many calls take no new words: words that hardly come again cost more than they save.
PAYING, PAUSE = 3, 7
#: Fixed value: A's split of a text into words, as public byte-level tokenizers have it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TokenizerPair:
    """A: byte-level BPE of space and text. B: pieces of the text, to which B itself adds the space.

    A's ids are found from its vocabulary as ranks, which is faster, if that gives A's ids on a sample.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        octet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            known = all(c in octet for c in token)
            self.bytes_a[i] = bytes(octet[c] for c in token) if known else token.encode("utf-8")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(t) for t in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.decimal = [str(i) for i in range(max(size, len(pieces)))]
        plain = {t: i for i, t in enumerate(self.bytes_a) if t and i not in self.a.get_added_tokens_decoder()}
        self.ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})
        probe = "".join(c for c in map(chr, range(32, 384)) if not _OTHER.match(c)) + " it's They'll  x'd 12 3½ <<>> a\tb\n\n c <|endoftext|> ñandú ÀÉ straße "
        self.quick = self.ranks.encode_ordinary(probe) == self.a.encode(probe, add_special_tokens=False).ids
        self.words: dict[str, tuple[int, int, int, str, bytes] | None] = {}
        self.older, self.kept_bytes, self.pause = self.words, 0, 0
        self.by_word = self._cuts_words()

    def _cuts_words(self) -> bool:
        """Whether both tokenizers cut at the ends of all words that :meth:`_fits` lets pass; seen from their settings and pieces.

        A must split by its pattern, which no token crosses. B must merge pairs (no sums over the whole text) of unchanged
        characters, and no piece may hold a line feed or go on after a blank or, unless ``joined`` has the character, after a letter.
        """
        from sentencepiece import sentencepiece_model_pb2

        split = self.a.pre_tokenizer and json.loads(self.a.pre_tokenizer.__getstate__())
        plain = all(t.special for t in self.a.get_added_tokens_decoder().values())
        if self.a.normalizer or not plain or split != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return False
        model = sentencepiece_model_pb2.ModelProto.FromString(self.b.serialized_model_proto())
        how, clean = model.trainer_spec, model.normalizer_spec
        if how.model_type != how.BPE or how.treat_whitespace_as_suffix or clean.precompiled_charsmap or clean.remove_extra_whitespaces:
            return False
        if not clean.add_dummy_prefix or not clean.escape_whitespaces or any(p.type == p.USER_DEFINED for p in model.pieces):
            return False
        pieces = [p.piece for p in model.pieces if p.type not in (p.BYTE, p.CONTROL, p.UNKNOWN)]
        self.joined = {p[m.end()] for p in pieces for m in _AFTER_LETTER.finditer(p)}
        feed = self.b.encode("\n")
        return len(feed) == 2 and self.b.is_byte(feed[1]) and not any("\n" in p or re.search("[^▁]▁", p) for p in pieces)

    def _fits(self, word: str) -> bool:
        """Whether a word is kept. It must have no other white space, and begin with a blank or with what both cut from a letter."""
        if len(word) > WORD_LENGTH or _BLANK.search(word):
            return False
        return word[0] in " \n" or (unicodedata.category(word[0])[0] in "MNPS" and word[0] not in self.joined)

    def _keep(self, word: str, found: tuple[int, int, int, str, bytes] | None) -> None:
        self.words[word] = found
        self.kept_bytes += 300 + 4 * len(word) + (len(found[3]) + len(found[4]) if found else 0)

    def _learn(self, words: list[str]) -> None:
        """Keep for each word: ids of A and B, groups, these as text, and the links (A << 32 | B, 8 bytes each); None if it does not fit.

        The words stand in one row, so that two dictionaries serve all of them.
        """
        row = "".join(words)
        ids_a = list(map(self.ranks.encode_ordinary, words)) if self.quick and not _OTHER.search(row) else self.encode_a(words)
        ids_b = [b[2:] for b in self.b.encode(["\n" + w for w in words], num_threads=1)]
        sizes = list(map(len, words)) if row.isascii() else [len(w.encode("utf-8")) for w in words]
        list_a, list_b = list(chain.from_iterable(ids_a)), list(chain.from_iterable(ids_b))
        a, b = np.array(list_a, np.int64), np.array(list_b, np.int64)
        n_a, n_b = list(map(len, ids_a)), list(map(len, ids_b))
        ends = [np.concatenate([[0], np.cumsum(length)])[np.cumsum(n)] for length, n in ((self.length_a[a], n_a), (self.length_b[b], n_b))]
        if not (all(np.array_equal(e, np.cumsum(sizes)) for e in ends) and self.covers(row, list_a, list_b)):
            covered = [w for w, x, y in zip(words, ids_a, ids_b) if self.covers(w, x, y)]
            for word in set(words).difference(covered):
                self._keep(word, None)
            return self._learn(covered) if covered else None
        cuts_a, cuts_b = shared_ends(self.length_a[a].tolist(), self.length_b[b].tolist())
        groups = shown(list_a, list_b, cuts_a, cuts_b, self.decimal).split(";")
        starts_a, starts_b = np.array(cuts_a), np.array(cuts_b)
        sizes_a, sizes_b = np.diff(starts_a), np.diff(starts_b)
        first = np.searchsorted(starts_a, np.cumsum([0, *n_a]))
        n_links = np.diff(np.concatenate([[0], np.cumsum(sizes_a * sizes_b)])[first])
        light = n_links <= WORD_LINKS
        of_a = np.repeat(np.arange(len(groups)), sizes_a)
        weight = sizes_b[of_a] * np.repeat(light, n_a)
        left = np.repeat(np.arange(len(a)), weight)
        right = np.arange(len(left)) - np.repeat(np.cumsum(weight) - weight, weight) + np.repeat(starts_b[of_a], weight)
        linked = (a[left] << 32 | b[right]).tobytes()
        told = [";".join(groups[i:j]) if j - i > 1 else groups[i] for i, j in zip(first.tolist(), first[1:].tolist())]
        ends = np.cumsum([0, *(8 * n_links * light)]).tolist()
        linked = [linked[i:j] for i, j in zip(ends, ends[1:])]
        self.words.update(zip(words, zip(n_a, n_b, np.diff(first).tolist(), told, linked)))
        self.words.update(dict.fromkeys(w for w, fits in zip(words, light.tolist()) if not fits))
        self.kept_bytes += 300 * len(words) + 4 * len(row) + sum(map(len, told)) + ends[-1]

    def from_words(self, texts: list[str]) -> list[tuple[tuple[int, int, int, int], str, np.ndarray] | None]:
        """Of each text, from its words: tokens of A and B, groups and links, the groups as text, the links; None if it is to be aligned in one piece.

        Words are kept in two lots: when the newer is full, the older goes, but for its words that came again. A text with a word
        that is not kept, as new words are not taken just then, is aligned in one piece too.
        """
        if not self.by_word:
            return [None] * len(texts)
        cut = [_WORD.findall(" " + t) if len(t) <= AT_ONCE else [] for t in texts]
        words = set(chain.from_iterable(cut))
        if self.kept_bytes > KEPT_BYTES:
            self.words, self.older, self.kept_bytes = {}, self.words, 0
        new = words.difference(self.words)
        for word in [w for w in new if w in self.older]:
            self._keep(word, self.older[word])
        new = [w for w in new.difference(self.older) if self._fits(w)]
        if new and not self.pause:
            self._learn(new)
            self.pause = PAUSE if sum(map(len, cut)) < PAYING * len(new) else 0
        elif self.pause:
            self.pause -= 1
        return [self._joined(list(map(self.words.get, row))) for row in cut]

    def _joined(self, words: list[tuple[int, int, int, str, bytes] | None]):
        if not words or not all(words):
            return None
        n_a, n_b, n_groups, groups, linked = zip(*words)
        n_links = sum(map(len, linked)) // 8
        if n_links > LINKS:
            return None
        return (sum(n_a), sum(n_b), sum(n_groups), n_links), ";".join(groups), np.frombuffer(b"".join(linked), np.int64)

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts; long ones are handed over in parts that end where the tokenizer cuts anyway."""
        parts, owner = [], []
        ids: list[list[int]] = [[] for _ in texts]
        for i, text in enumerate(texts):
            if self.quick and not _OTHER.search(text) and (len(text) < LONGEST_WORD or not _GAP.search(text) and max(map(len, text.split()), default=0) <= LONGEST_WORD):
                ids[i] = self.ranks.encode_ordinary(text)
                continue
            at = 0
            while len(text) - at > AT_ONCE:
                cut = _CUT.search(text, at + AT_ONCE)
                if not cut:
                    break
                parts.append(text[at : cut.end()])
                owner.append(i)
                at = cut.end()
            parts.append(text[at:] if at else text)
            owner.append(i)
        for i, e in zip(owner, self.a.encode_batch_fast(parts, add_special_tokens=False)):
            ids[i] = ids[i] + e.ids if ids[i] else e.ids
        return ids

    def covers(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether the bytes of both id lists are those of the text."""
        raw = text.encode("utf-8")
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw


def shared_ends(lengths_a: list[int], lengths_b: list[int]) -> tuple[list[int], list[int]]:
    """Where both id lists are sliced: positions in A and in B after each byte at which tokens of both end."""
    ends_a = dict(zip(accumulate(lengths_a), count(1)))
    ends_b = dict(zip(accumulate(lengths_b), count(1)))
    common = sorted(ends_a.keys() & ends_b.keys())
    return [0, *map(ends_a.__getitem__, common)], [0, *map(ends_b.__getitem__, common)]


def shown(a: list[int], b: list[int], cuts_a: list[int], cuts_b: list[int], decimal: list[str]) -> str:
    """The groups as text: ids of A, a bar, ids of B; groups parted by semicolons."""
    names_a, names_b = [*map(decimal.__getitem__, a)], [*map(decimal.__getitem__, b)]
    return ";".join([
        f"{names_a[i]}|{names_b[k]}" if j - i == 1 == m - k else f"{','.join(names_a[i:j])}|{','.join(names_b[k:m])}"
        for i, j, k, m in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])
    ])


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different ids of each group, in order of the groups, and how often each occurs there."""
    key, times = np.unique(group << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, times


def links(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, at_once: int = LINKS):
    """Linked pairs (id of A << 32 | id of B, ascending) and how many links each has, in blocks.

    A pair stands in one block. A block is cut between ids of A and is expanded from about ``at_once`` links
    (or from those of one id of A, at most the tokens of B times its different ids).
    """
    groups = np.arange(len(sizes_a))
    of_a, of_b = np.repeat(groups, sizes_a), np.repeat(groups, sizes_b)
    times_a, times_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    if int(sizes_a @ sizes_b) > at_once:
        of_a, a, times_a = _counted(of_a, a)
        of_b, b, times_b = _counted(of_b, b)
        order = np.argsort(a, kind="stable")
        of_a, a, times_a = of_a[order], a[order], times_a[order]
    in_b = np.bincount(of_b, minlength=len(groups))
    first_b = np.cumsum(in_b) - in_b
    weight = in_b[of_a]
    upto = np.cumsum(weight)
    low = 0
    while low < len(a):
        high = len(a)
        if upto[-1] - (upto[low] - weight[low]) > at_once:
            high = max(low + 1, int(np.searchsorted(upto, upto[low] - weight[low] + at_once, "right")))
            edge = int(np.searchsorted(a, a[high], "left")) if high < len(a) else high
            high = edge if edge > low else int(np.searchsorted(a, a[low], "right"))
        w = weight[low:high]
        left = np.repeat(np.arange(low, high), w)
        right = np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first_b[of_a[low:high]], w)
        pair, where = np.unique(a[left] << 32 | b[right], return_inverse=True)
        yield pair, np.bincount(where, times_a[left] * times_b[right], len(pair)).astype(np.int64)
        low = high


SHAPE = "row long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignments: row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    ``row`` is unique; ``groups`` is the text of :func:`shown`; ``pairs`` are the document's different linked id pairs
    (A << 32 | B) and ``times`` how many links each has. A document with very many links has further rows that hold only
    ``row``, ``doc_id``, pairs and times. A text that is null, empty, or not covered by both tokenizers byte for byte (B may change
    white space or odd characters) has zeros, the empty text and no pairs. Long texts are read whole. Repeated rows and rows with null ids are each aligned; an
    empty table gives an empty result; other columns are ignored.
    """
    source = slim(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        pair = kept_in_worker("token pair", (path_a, path_b), lambda: TokenizerPair(path_a, path_b))
        number = TaskContext.get().partitionId() << 40
        for rb in batches:
            texts = rb.column("text").to_pylist()
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= AT_ONCE):
                    size += len(texts[upto] or "")
                    upto += 1
                out, number = _aligned(pair, texts[at:upto], number)
                owner = pa.array(np.array(out["owner"]) + at)
                arrays = [rb.column("doc_id").take(owner) if f == "doc_id" else out[f] for f in FIELDS]
                yield pa.RecordBatch.from_arrays(arrays, names=FIELDS)
                at = upto

    return source.mapInArrow(run, SHAPE.format(kind))


FIELDS = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]


def _aligned(pair: TokenizerPair, texts: list[str | None], number: int):
    asked = [i for i, t in enumerate(texts) if t]
    joined = {i: j for i, j in zip(asked, pair.from_words([texts[i] for i in asked])) if j}
    asked = [i for i in asked if i not in joined]
    ids_a = dict(zip(asked, pair.encode_a([" " + texts[i] for i in asked])))
    ids_b = dict(zip(asked, pair.b.encode([texts[i] for i in asked], num_threads=1)))
    owner, rows, figures, groups, pairs, times = [], [], [], [], [], []
    for i, text in enumerate(texts):
        blocks = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        stats, told = (0, 0, 0, 0), ""
        if i in joined:
            stats, told, linked = joined.pop(i)
            blocks = [np.unique(linked, return_counts=True)]
        elif text and pair.covers(" " + text, ids_a[i], ids_b[i]):
            list_a, list_b = ids_a.pop(i), ids_b.pop(i)
            a, b = np.array(list_a, np.int64), np.array(list_b, np.int64)
            cuts_a, cuts_b = shared_ends(pair.length_a[a].tolist(), pair.length_b[b].tolist())
            told = shown(list_a, list_b, cuts_a, cuts_b, pair.decimal)
            sizes_a, sizes_b = np.diff(np.array(cuts_a)), np.diff(np.array(cuts_b))
            stats = (len(a), len(b), len(sizes_a), int(sizes_a @ sizes_b))
            blocks = links(a, b, sizes_a, sizes_b)
        for p, n in blocks:
            owner.append(i)
            rows.append(number)
            figures.append(stats)
            groups.append(told)
            pairs.append(p)
            times.append(n)
            stats, told = (None,) * 4, None
        number += 1
    edges = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
    none = [np.zeros(0, np.int64)]
    columns = [pa.array(v, pa.int64()) for v in zip(*figures)]
    listed = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate([*v, *none]), pa.int64())) for v in (pairs, times)]
    values = [pa.array(rows, pa.int64()), None, *columns, pa.array(groups, pa.string()), *listed]
    return {"owner": owner, **dict(zip(FIELDS, values))}, number


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, and whether no pair of its A id has more."""
    counted = durable(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    of_a = F.shiftright("pair", 32)
    top = counted.groupBy(of_a.alias("a")).agg(F.max("n").alias("top"))
    return counted.join(top, of_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def common_from(total: int, pairs: int = COMMON_PAIRS) -> int:
    """A count that at most ``pairs`` pairs can reach, as all counts together are ``total``."""
    return max(1, -(-total // pairs))


def standing(aligned: DataFrame, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """One row per document of :func:`align` (written already): its columns, n_best and count_sum.

    Counts of common pairs, of which there are at most ``common_pairs``, are broadcast, so no common pair is shuffled;
    links of the others, none of them in many documents, meet their counts by a shuffle.
    """
    counts = durable(link_counts(aligned))
    total, least = counts.agg(F.sum("n"), F.min("n")).first()
    floor = common_from(total or 0, common_pairs)
    each = aligned.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))

    def summed(rows):
        return rows.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
        )

    common = F.broadcast(counts.where(F.col("n") >= floor))
    sums = summed(each.join(common, "pair"))
    if least is not None and least < floor:
        rest = each.join(common, "pair", "left_anti").join(counts.where(F.col("n") < floor), "pair")
        sums = sums.union(summed(rest)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    firsts = aligned.where("n_a is not null")
    return firsts.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def summary(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Figures of every document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 ('' without tokens)."""
    place = scratch_path(docs.sparkSession, "aligned")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    told = align(docs, path_a, path_b).select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times")
    told.write.option("compression", "zstd").parquet(place)
    found = standing(docs.sparkSession.read.parquet(place))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
