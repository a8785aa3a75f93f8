"""Tokenizer alignment, centroid clustering and the URL filter against slow versions, and their odd rows."""

import hashlib
import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatt.llm import centroids, token_align, url_filter
from tidewatt.llm import queries as Q

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PAIR = token_align.TokenizerPair(A, B)


# -- op11


def spelled(text):
    """Tokens of both tokenizers as (id, bytes), by another way than the operator's tables."""
    tokens = Tokenizer.from_file(A)
    tokens.encode_special_tokens = True
    got = tokens.encode(" " + text, add_special_tokens=False)
    letters = {}
    n = 0
    for byte in range(256):
        plain = 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174
        letters[chr(byte if plain else 256 + n)] = byte
        n += not plain
    a = [(i, bytes(letters[c] for c in t)) for i, t in zip(got.ids, got.tokens)]
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        b.append((i, bytes.fromhex(piece[3:5]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
    return a, b


def slow(texts):
    """Per text: groups, links as (a, b) with repeats; by walking both byte positions."""
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        a, b = spelled(text)
        raw = (" " + text).encode()
        if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            out.append(None)
            continue
        groups, i, j, at_a, at_b, left, right = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                left.append(a[i][0])
                at_a += len(a[i][1])
                i += 1
            else:
                right.append(b[j][0])
                at_b += len(b[j][1])
                j += 1
            if at_a == at_b:
                groups.append((left, right))
                left, right = [], []
        out.append((len(a), len(b), groups, [p for g in groups for p in itertools.product(*g)]))
    return out


def slow_figures(ids, texts):
    found = slow(texts)
    n = Counter(p for f in found if f for p in set(f[3]))
    top = defaultdict(int)
    for (x, _), k in n.items():
        top[x] = max(top[x], k)
    rows = []
    for i, f in zip(ids, found):
        if not f:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        told = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in f[2])
        rows.append((i, f[0], f[1], len(f[2]), len(f[3]), sum(n[p] == top[p[0]] for p in f[3]), sum(n[p] for p in f[3]), hashlib.sha256(told.encode()).hexdigest()))
    return sorted(rows, key=str)


ODD = [
    None, "", " ", "a", "  two  blanks ", "tab\tand\nline", "<|endoftext|> is text", "</s><unk><s>", "日本語 текст ñandú 😀 ́ﬁ", "½ Ⅳ ①", "\u0000x", "a" * 300,
    "tail ", "a b c d e", "The same words again", "The same words again", "don't we'll I'VE", "aaa bbb " * 50,
]


def test_alignment_of_odd_texts(spark):
    rows = [(None if i == 3 else i, t, "x", 1) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string, row long")
    got = sorted((tuple(r) for r in token_align.summary(df, A, B).collect()), key=str)
    assert got == slow_figures([r[0] for r in rows], ODD)
    assert token_align.summary(df.where("false"), A, B).count() == 0


def test_alignment_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 5 = 0").select("doc_id", "text")
    rows = docs.collect()
    want = slow_figures([r[0] for r in rows], [r[1] for r in rows])
    assert sorted((tuple(r) for r in token_align.summary(docs, A, B).collect()), key=str) == want


def test_rare_pairs_by_shuffle_equal_broadcast(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 7 = 0")
    token_align.align(docs, A, B).write.parquet(f"{tmp_path}/a")
    table = spark.read.parquet(f"{tmp_path}/a")
    one, two = (sorted((r["row"], r["n_best"], r["count_sum"]) for r in token_align.standing(table, n).collect()) for n in (10**6, 40))
    assert one == two and len(one) == docs.count()


def test_common_pairs_are_bounded():
    counts = np.random.default_rng(1).zipf(1.3, 5000).clip(max=10**6)
    for limit in (1, 10, 400, 10**6):
        assert (counts >= token_align.common_from(int(counts.sum()), limit)).sum() <= limit


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=6), st.lists(st.integers(0, 5), min_size=1, max_size=6)), max_size=8), st.sampled_from([1, 7, 1000]))
def test_links_in_blocks(groups, at_once):
    a, b = (np.array([i for g in groups for i in g[side]], np.int64) for side in (0, 1))
    sizes_a, sizes_b = (np.array([len(g[side]) for g in groups], np.int64) for side in (0, 1))
    want = Counter((x << 32) | y for g in groups for x, y in itertools.product(*g))
    got = list(token_align.links(a, b, sizes_a, sizes_b, at_once))
    pairs = [int(p) for block, _ in got for p in block]
    assert len(pairs) == len(set(pairs)) and dict(zip(pairs, (int(n) for _, times in got for n in times))) == want


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(token_align, "AT_ONCE", 50)
    text = " It's a long text, isn't it; with 12 numbers  and two blanks. " * 20 + "x" * 200
    tokens = Tokenizer.from_file(A)
    assert PAIR.encode_a([text, "", "short"]) == [tokens.encode(t, add_special_tokens=False).ids for t in (text, "", "short")]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.characters(max_codepoint=0x180), st.sampled_from(" \n\t\u00a0\u3000.,'sStTdD12½é▁")), min_size=1, max_size=40))
def test_ranks_give_the_tokenizers_ids(text):
    assert PAIR.quick
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    assert PAIR.encode_a([text])[0] == whole.encode(text, add_special_tokens=False).ids


def test_words_that_come_again_are_tokenised_once(monkeypatch):
    pair, handed = token_align.TokenizerPair(A, B), []
    encode = pair.encode_a
    monkeypatch.setattr(pair, "encode_a", lambda texts: handed.extend(texts) or encode(texts))
    texts = [f"It's said that the {w}, and only the {w}, came again.\nThe {w}!" for w in ("cat", "dog") * 200]
    token_align._aligned(pair, texts[:200], 0)
    token_align._aligned(pair, texts[200:], 200)
    assert sum(map(len, handed)) < 2 * len(texts[0])


def test_words_that_never_come_again_are_seldom_taken(monkeypatch):
    pair, handed = token_align.TokenizerPair(A, B), []
    learn = pair._learn
    monkeypatch.setattr(pair, "_learn", lambda words: handed.extend(words) or learn(words))
    for lot in range(32):
        token_align._aligned(pair, [" ".join(str(10**9 + 200 * lot + i) for i in range(200))], 0)
    assert len(handed) == 4 * 200


def aligned(pair, texts):
    out = token_align._aligned(pair, texts, 7)[0]
    return out["owner"], [out[f].to_pylist() for f in token_align.FIELDS if f != "doc_id"]


WORDY = st.lists(st.one_of(st.sampled_from(
    ["the", "don't", "It's", " ", " ", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", ".", "...", ",", "'", "'s", "nº", "x²", "▁", "a▁", "日本", "\u0301", "é", "ß", "12", "½", "😀", "\u200b", "aaaaaaaa"]
), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=14).map("".join)


@settings(max_examples=250, deadline=None)
@given(st.lists(WORDY, min_size=1, max_size=5), st.sampled_from([(10**6, 64, 256), (0, 64, 256), (10**6, 5, 256), (3000, 64, 2)]))
def test_words_give_what_whole_texts_give(texts, limits):
    pair = token_align.TokenizerPair.__new__(token_align.TokenizerPair)
    pair.__dict__ |= PAIR.__dict__ | {"words": {}, "older": {}}
    assert pair.by_word
    with pytest.MonkeyPatch.context() as patch:
        for name, value in zip(("KEPT_BYTES", "WORD_LENGTH", "WORD_LINKS"), limits):
            patch.setattr(token_align, name, value)
        first, again, _ = (aligned(pair, t) for t in (texts, texts[::-1], texts))
    pair.by_word = False
    assert first == aligned(pair, texts) and again == aligned(pair, texts[::-1])


@pytest.mark.parametrize("kind, across, clean", [("unigram", True, False), ("bpe", False, False), ("bpe", True, True), ("bpe", True, False)])
def test_only_tokenizers_that_cut_between_words_go_by_word(tmp_path, kind, across, clean):
    lines = ["of the cat and of the dog", "of the dog and of the cat", "the end of the cat"] * 5
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(lines), model_prefix=f"{tmp_path}/b", model_type=kind, vocab_size=320, hard_vocab_limit=False, byte_fallback=True,
        split_by_whitespace=across, normalization_rule_name="identity", remove_extra_whitespaces=clean, minloglevel=2,
    )
    assert token_align.TokenizerPair(A, f"{tmp_path}/b.model").by_word == (kind == "bpe" and across and not clean)


# -- op12


def slow_clusters(rows, k, rounds, scale):
    kept = [(i, [math.floor(scale * x) if abs(x) < 2**52 else int(x) * scale for x in v]) for i, v in rows]
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    m = [v for _, v in drawn[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(m))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        m = [[sum(x) // len(members[j]) for x in zip(*members[j])] if j in members else c for j, c in enumerate(m)]
    return [(i, nearest(v)[1], nearest(v)[0], hashlib.sha256(",".join(map(str, m[nearest(v)[1]])).encode()).hexdigest()) for i, v in kept]


@pytest.mark.parametrize("size", [1.0, 1e7, 1e12, 1e300])
def test_clusters_with_numbers_of_any_size(spark, size):
    rng = np.random.default_rng(int(math.log10(size)))
    rows = [(i, (rng.normal(size=3) * size).tolist()) for i in range(60)]
    rows += [(60, rows[0][1]), (60, rows[1][1]), (61, [0.0, -0.0, 0.0]), (None, [size, 0.0, 0.0])]
    bad = [(70, None), (71, []), (72, [1.0, 2.0]), (73, [1.0, None, 2.0]), (74, [1.0, float("nan"), 2.0]), (75, [1.0, 2.0, float("-inf")])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<double>, v string, cluster int").repartition(5)
    got = centroids.cluster(df, k=5, dims=3).collect()
    want = slow_clusters(rows, 5, 3, 64)
    top = 2**63 - 1
    assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in got), key=str) == sorted(
        ((i, c, d if d <= top else None, h) for i, c, d, h in want), key=str
    )
    fits = [d <= top for _, _, d, _ in want]
    if all(fits) and sum(w[2] for w in want) <= top:
        assert {r["inertia"] for r in got} == {sum(w[2] for w in want)}
        assert {(r["cluster"], r["cluster_inertia"]) for r in got} == {(c, sum(w[2] for w in want if w[1] == c)) for c in {w[1] for w in want}}
    else:
        assert {r["inertia"] for r in got} == {None}


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [9.0, 9.0])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["cluster"], r["distance"]) for r in centroids.cluster(df, k=16, dims=2).collect()}
    assert got[1] == got[2] and got[3][0] != got[1][0] and all(d == 0 for _, d in got.values())
    assert centroids.cluster(df, dims=3).collect() == [] and centroids.cluster(df.where("false"), dims=2).columns == centroids.cluster(df, dims=2).columns


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=7), st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=9))
def test_tournament_gives_the_smallest_nearest(middles, points):
    near, distance = centroids.Bisectors(middles).nearest(np.array(points, np.int64))
    for p, n, d in zip(points, near, distance):
        squares = [sum((a - b) ** 2 for a, b in zip(p, m)) for m in middles]
        assert (n, d) == (squares.index(min(squares)), min(squares))


@given(st.lists(st.integers(-(10**40), 10**40), min_size=1, max_size=4))
def test_digits(values):
    parts = centroids.digits(np.array(values, object))
    assert [sum(d[i] << 30 * k for k, d in enumerate(parts)) for i in range(len(values))] == values
    assert all(abs(v) < 2**30 for d in parts for v in d)


# -- op13

URLS = [
    None, "", "no scheme.com/en/", "http://", "http://example.com", "http://example.com/", "https://EXAMPLE.com/en/1", "https://www.Example.COM/en/1?x=1&y=2#top", "https://a.www.example.com/en/",
    "https://notexample.com/en/9", "http://x.net/es/1", "http://net/fr/", "http://x.net/EN/", "http://x.net?/es/", "http://x.net#/es/", "http://h.org/a/b.html", "http://com//en/", "ftp://a://b.com/c",
    "http://ÉX.com/é", "http://x.com:80/en/", "http://example.com/en", "http://example.com/en/", "http://example.com/en/", "x" * 100_000, "http://" + "a." * 20_000 + "com/" + "b/" * 20_000,
]


def slow_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
        path = rest[len(host) :]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule in Q.URL_RULES:
        where, start = rule[: rule.index("/")], rule[rule.index("/") :]
        if ("." + host).endswith("." + where) and path.startswith(start):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(None if i == 4 else i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, score string")
    return url_filter.judge(df, Q.URL_RULES).collect()


def test_rules_of_odd_urls(judged):
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in judged), key=str)
    assert got == sorted(((None if i == 4 else i, *slow_rule(u)) for i, u in enumerate(URLS)), key=str)
    assert all(r["verdict"] == (Q.URL_RULES[r["rule"]] if r["rule"] else "block" if r["score"] >= 0.5 else "allow") for r in judged)


def test_rules_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.judge(pages, Q.URL_RULES).collect()}
    assert got == {r[0]: slow_rule(r[1]) for r in pages.collect()}


def test_without_labels_or_with_one(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id int, url string")
    assert {r["verdict"] for r in url_filter.judge(df, Q.URL_RULES).collect()} == {"allow"}
    assert {r["verdict"] for r in url_filter.judge(df, {"org/": "block"}).collect()} == {"block"}
    assert url_filter.judge(df.where("false"), Q.URL_RULES).collect() == []


def test_features(spark):
    url = "https://a.b.example.com/x/y1/z.html?p=1&q=22#top"
    host, path = url_filter.host_and_path(F.lit(url))
    row = spark.range(1).select(*[v.alias(k) for k, v in {**url_filter.lexical(F.lit(url), host, path), **url_filter.suffixes(host, path)}.items()]).first()
    bits = -sum(n / len(url) * math.log2(n / len(url)) for n in Counter(url).values())
    assert row["entropy"] == pytest.approx(bits) and row["depth"] == 3 and row["parameters"] == 2 and row["labels"] == 4
    assert row["digit_ratio"] == pytest.approx(4 / len(url)) and (row["tld"], row["site"], row["file"], row["folder"]) == ("com", "example.com", ".html", "x")


def test_trees_learn_what_rules_say(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    got = url_filter.judge(pages, Q.URL_RULES, held_out=held).join(pages, "page_id").where(held & F.col("rule").isNotNull())
    right, n, allowed = got.agg(F.count_if((F.col("score") >= 0.5) == (F.col("verdict") == "block")), F.count("*"), F.count_if(F.col("verdict") == "allow")).first()
    assert n > 100 and right / n > 0.9 > max(allowed, n - allowed) / n
