"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatt.llm import crf_lang, embed_dedup, exact_stream, license_scan, packing, pfair_mix, ring_shards, simhash_trie, site_quality, suffix_dedup
from tidewatt.llm import queries as Q

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def whole(text):
    return np.array(Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


WORDS = packing.WordTokenizer(TOKENIZER)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x180), st.sampled_from("'sStTdD 12½\n\t ́İŉ日ß")), max_size=40))
def test_words_give_the_tokenizers_ids(text):
    assert WORDS.plain
    assert WORDS.encode(text) == WORDS._whole(text)


def test_packing_round_trip(docs, texts):
    rows = packing.pieces(docs, TOKENIZER).collect()
    tokens = Tokenizer.from_file(TOKENIZER)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, parts in by_doc.items():
        parts.sort(key=lambda r: r["start"])
        want = tokens.encode(texts[doc], add_special_tokens=False).ids + [1]
        assert b"".join(bytes(p["ids"]) for p in parts) == np.array(want, "<u4").tobytes()
        assert [p["start"] for p in parts] == list(np.cumsum([0, *[p["length"] for p in parts]])[:-1])
        assert {p["doc_tokens"] for p in parts} == {len(want)}
    assert set(by_doc) == set(texts)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in parts] == list(np.cumsum([0, *[p["length"] for p in parts]])[:-1])
        assert sum(p["length"] for p in parts) <= 2048
    digest = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.digest(packing.pieces(docs, TOKENIZER)).collect()}
    assert all(digest[r["doc_id"], r["start"]] == zlib.crc32(bytes(r["ids"])) for r in rows)


def test_differencing_balances():
    rng = np.random.default_rng(5)
    for n, k in ((60, 7), (200, 31), (5, 9), (1, 1)):
        sizes = rng.integers(1, 1000, n)
        window, load = packing.differencing(sizes, k)
        assert (np.bincount(window, sizes, k) == load).all()
        if n >= 4 * k:
            assert load.max() - load.min() < sizes.mean() / 4
    sizes = rng.integers(1, 1025, 256)
    window = packing.balanced(sizes, 2048)
    load = np.bincount(window, sizes)
    assert load.max() <= 2048 and load.sum() / (len(load) * 2048) > 0.95


def test_packing_counts_rise_only_when_needed():
    assert set(packing.balanced(np.array([1500, 1500, 1500]), 2048)) == {0, 1, 2}
    assert set(packing.balanced(np.array([1024, 1024, 1024, 1024]), 2048)) == {0, 1}


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [c + rng.normal(scale=0.25, size=16) for c in centres for _ in range(20)] + list(rng.normal(size=(150, 16)))
    rows += rows[:10]
    x = np.array(rows, dtype=np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    label = np.arange(len(x))
    while True:
        low = np.where(near, label[None, :], len(x)).min(1)
        if (low == label).all():
            break
        label = low
    for block_rows in (64, 4096):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_components(df, block_rows=block_rows).collect()}
        assert got == {i: (int(near[i].sum()) - 1, int(label[i])) for i in range(len(x))}


def test_embeddings_of_mixed_lengths(spark):
    rng = np.random.default_rng(4)
    x = [rng.normal(size=n) for n in (8, 8, 5, 3)]
    rows = [(k, x[k]) for k in range(4)] + [(10 + k, 2 * x[k] + 1e-3) for k in range(4)] + [(20 + k, x[k]) for k in range(4)] + [(30, x[0])]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in rows], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_components(df).collect()}

    def linked(a, b):
        return len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9

    for i, a in rows:
        near = [j for j, b in rows if linked(a, b)]
        assert got[i] == (len(near) - 1, min(near))


def test_axes_are_principal(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) * np.array([1, 4, 2, 1, 3])
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = np.linalg.eigh(np.cov(u.T))[1][:, ::-1]
    assert np.abs(np.abs((want * embed_dedup.axes(df, 5)[0]).sum(0)) - 1).max() < 1e-6


def base_places(text):
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", regex.sub("[A-Z]", lambda m: m.group().lower(), text))
    out = []
    for phrase, label in license_scan.BASE.items():
        p = phrase.split(" ")
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), out


def test_license_base_places(spark, docs, texts):
    extra = {-1: "CC-BY cc by CC by. All Rights\nReserved; ALL rights reserved all rights RESERVED é", -2: "general public licensee general public license", -3: "cc byé by cc by"}
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    for r in license_scan.summary(license_scan.find_notices(df)).collect():
        n, places = base_places(({**texts, **extra})[r["doc_id"]])
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_license_edits_are_found():
    notices = [license_scan.Notice(p, label) for p, label in (license_scan.BASE | license_scan.NOTICES).items()]
    rng = random.Random(4)
    for notice in notices:
        for _ in range(40):
            phrase = list(notice.phrase)
            for _ in range(rng.randint(0, notice.edits)):
                at = rng.randrange(1, len(phrase) - 1)
                kind = rng.randrange(3)
                if kind == 0:
                    phrase[at] = rng.choice("abcxyz")
                elif kind == 1:
                    phrase.insert(at, rng.choice("abcxyz"))
                else:
                    del phrase[at]
            text = "released under the terms of " + "".join(phrase) + " version two"
            n, spans = license_scan.scan(text, notices)
            assert any(s["phrase"] == notice.phrase and s["edits"] <= notice.edits for s in spans), (notice.phrase, text)
    for s in license_scan.scan("Zażółć licensed under the Aпache Apache Licence é", notices)[1]:
        assert s["found"] == "apache licence" and s["first_word"] == 5 and s["edits"] == 1


def test_quality_held_out(spark, sf_dir):
    path = sf_dir.replace("sf0.001", "sf0.01")
    rows = {r["doc_id"]: r for r in site_quality.classify(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).collect()}
    known = [r for r in spark.read.parquet(f"{path}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(known) > 50
    assert np.mean([(rows[r["doc_id"]]["quality"] >= 0.5) == (r["quality"] == 1) for r in known]) > 0.93
    clean = [r["doc_id"] for r in known if r["quality"] == 1 and r["toxic"] == 0]
    assert np.mean([rows[d]["kept"] for d in clean]) > 0.97


def test_sparse_sites_shrink(spark):
    rng = np.random.default_rng(2)
    rows = []
    for h in range(40):
        level = 0.2 if h % 2 else 0.8
        rows += [(h * 10_000 + i, f"h{h}", "p", float(rng.beta(8 * level, 8 * (1 - level)))) for i in range(60)]
    rows += [(10**7, "lone", "p", 0.5), (10**7 + 1, None, None, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, q double")
    got = {r["doc_id"]: r for r in site_quality.posterior(df, "q", "post").collect()}
    mean = np.mean([r[3] for r in rows])
    assert abs(got[10**7]["post_path"] - mean) < 0.02 and abs(got[10**7 + 1]["post_path"] - mean) < 0.02
    assert got[0]["post_path"] > 0.7 and got[10_000]["post_path"] < 0.3
    assert got[0]["post"] > got[0]["q"]


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    e, moves, start = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    weight = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        s = start[path[0]] + sum(e[0, t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
        for t, k in enumerate(path):
            weight[t, k] += np.exp(s)
    want = weight / weight.sum(axis=1, keepdims=True)
    assert np.allclose(crf_lang.forward_backward(e, moves, start)[0][0], want)
    field = crf_lang.Field(["a", "b", "c"], np.zeros((1 << crf_lang.BITS, 3)), {}, np.zeros((3, 3)), moves, start)
    assert np.allclose(crf_lang.Labeller(field).marginals(np.exp(e[0]), np.array([4])), want)


def test_blocks_equal_one_chain():
    rng = np.random.default_rng(6)
    field = crf_lang.Field(["a", "b"], np.zeros((1 << crf_lang.BITS, 2)), {}, np.zeros((2, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    sizes = np.array([1, 64, 65, 700, 3])
    e = rng.normal(size=(sizes.sum(), 2))
    got = crf_lang.Labeller(field).marginals(np.exp(e), sizes)
    at = 0
    for n in sizes:
        want = crf_lang.forward_backward(e[None, at : at + n], field.moves, field.start)[0][0]
        assert np.allclose(got[at : at + n], want, atol=1e-9)
        at += n


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in crf_lang.identify(docs).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows) and len(rows) > 150
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.97


def test_words_of_mixed_text(docs, spark):
    field = crf_lang.fit(crf_lang.training_passages(docs))
    a = next(r["text"] for r in docs.where("lang = 'en' and length(text) > 900").limit(1).collect())
    b = next(r["text"] for r in docs.where("lang = 'de' and length(text) > 900").limit(1).collect())
    first, second = crf_lang.words_of(a)[:60], crf_lang.words_of(b)[:60]
    _, _, runs, _ = crf_lang.Labeller(field).label([" ".join(first + second)])[0]
    labels = [r["lang"] for r in runs for _ in range(r["n_words"])]
    assert np.mean([x == "en" for x in labels[:60]]) > 0.9 and np.mean([x == "de" for x in labels[60:]]) > 0.9


def test_shards_are_even(spark):
    df = spark.range(1003).selectExpr("id as doc_id", "repeat('é', cast(id % 5 as int)) as text")
    rows = ring_shards.shard(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        text = "é" * (r["doc_id"] % 5)
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    a = {r["doc_id"]: r["shard"] for r in ring_shards.shard(df, 8, slack=0.2).collect()}
    b = {r["doc_id"]: r["shard"] for r in ring_shards.shard(df, 9, slack=0.2).collect()}
    assert max(np.bincount(list(a.values()))) <= np.ceil(1003 * 1.2 / 8)
    assert np.mean([a[k] != b[k] for k in a]) < 0.3


def ring_by_hand(keys, points, shards):
    """Keys in ring order go to the next point clockwise whose shard has room."""
    total = len(keys)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = {}
    arcs = [[] for _ in points]
    for spot, key in sorted(keys):
        i = next((i for i, (upto, _) in enumerate(points) if spot >> (64 - ring_shards.GRID_BITS) <= upto), 0)
        arcs[i].append((spot, key))
    for i, some in enumerate(arcs):
        order = [s for _, s in points[i:] + points[:i]]
        for _, key in some:
            s = next(s for s in order if room[s])
            room[s] -= 1
            out[key] = s
    return out


def test_shards_follow_the_ring(spark):
    df = spark.range(400).selectExpr("id as doc_id", "cast(null as string) as text")
    spots = [(r[1] % 2**64, r[0]) for r in df.selectExpr("doc_id", "xxhash64('key', doc_id)").collect()]
    points = {}
    for r in spark.sql("select s, r, shiftrightunsigned(xxhash64('node', cast(s as int), cast(r as int)), 48) u from range(8) t1(s) cross join range(64) t2(r)").collect():
        points[r["u"]] = min(r["s"], points.get(r["u"], 99))
    want = ring_by_hand(spots, sorted(points.items()), 8)
    assert {r["doc_id"]: r["shard"] for r in ring_shards.shard(df).collect()} == want


def test_schedule_stays_within_a_block():
    for trial in range(60):
        rnd = random.Random(trial)
        blocks = {i: rnd.randint(0, 300) for i in range(rnd.randint(1, 12))}
        weights = {i: rnd.choice([1, 0.01, 5, rnd.random() * 10 + 1e-3]) for i in blocks}
        left = dict(blocks)
        for quotas, times in pfair_mix.phases(blocks, weights, rnd.choice([1, 16, 64])):
            length = sum(quotas.values())
            slots = pfair_mix.template(quotas)
            assert sorted(t for s in slots.values() for t in s) == list(range(length))
            for s, n in quotas.items():
                left[s] -= n * times
                done = np.r_[0, np.cumsum(np.isin(np.arange(length), slots[s]))]
                assert np.abs(done - n * np.arange(length + 1) / length).max() < 1
        assert not any(left.values())


def test_schedule_keeps_to_the_weights():
    for trial in range(80):
        rnd = random.Random(trial)
        blocks = {i: rnd.randint(1, 900) for i in range(rnd.randint(2, 12))}
        weights = {i: rnd.choice([1, 1e-5, 0.01, 5, rnd.random() * 10 + 1e-3]) for i in blocks}
        left, shares, count, t = dict(blocks), {}, {}, 0
        for names, w, start, done, quota in pfair_mix.periods(blocks, weights, rnd.choice([1, 16, 64])):
            if start == 0:
                shares, count, t = {s: weights[s] / sum(weights[n] for n in names) for s in names}, dict.fromkeys(names, 0), 0
                assert set(names) == {s for s, n in left.items() if n}
            whole = {s: int(x) for s, x in zip(names, w)}
            slots = pfair_mix.template({s: int(q) for s, q in zip(names, quota)}, whole, start, {s: int(d) for s, d in zip(names, done)})
            order = sorted((at, s) for s, some in slots.items() for at in some)
            assert [at for at, _ in order] == list(range(len(order)))
            for _, s in order:
                count[s] += 1
                left[s] -= 1
                t += 1
                assert all(abs(count[n] - shares[n] * t) < 1 + 1e-6 for n in names)
        assert not any(left.values())


def test_mix_places_every_row(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "case when id < 700 then 'hot' when id = 1999 then null else concat('s', id % 9) end as source")
    weights = spark.createDataFrame([("hot", 3.0), (None, 2.0)], "source string, weight double")
    rows = pfair_mix.mix(df, weights, block_rows=8, period=64).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(2000))
    blocks = {}
    for r in rows:
        blocks.setdefault(r["slot"], set()).add((r["source"], r["block"]))
    assert sorted(blocks) == list(range(len(blocks))) and all(len(b) == 1 for b in blocks.values())
    assert len({(r["slot"], r["place"]) for r in rows}) == 2000


def repeats_by_hand(texts, length):
    seen, out = set(), {}
    for doc in sorted(texts):
        data = texts[doc].encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = (len(data), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def as_digest(df):
    out = {}
    for r in df.collect():
        spans = r["removed"]
        out[r["doc_id"]] = (r["n_bytes"], sum(s["end"] - s["start"] for s in spans), len(spans), hashlib.sha256(bytes(r["kept"])).hexdigest())
    return out


def test_repeats_on_documents(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in Q.op8_suffix_dedup(spark, sf_dir).collect()}
    assert got == repeats_by_hand(texts, 100)


@pytest.mark.parametrize("hot_share,run_items", [(None, 200_000), (2, 40)])
def test_repeats_small_cases(spark, monkeypatch, hot_share, run_items):
    monkeypatch.setattr(suffix_dedup, "RUN_ITEMS", run_items)
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh é") for _ in range(160))
    other = "".join(rng.choice("abcdefgh é") for _ in range(400))
    texts = {0: line, 1: "x" + line, 2: line[:70] + "?" + line[71:], 3: "y" * 300, 4: other + other, 5: line[40:] + other[:150], 6: "", 7: other[13:113]}
    for i in range(8, 60):
        texts[i] = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) + line[rng.randint(0, 60) :] + other[: rng.randint(0, 300)]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert as_digest(suffix_dedup.remove_repeats(df, length=100, parts=3, hot_share=hot_share)) == repeats_by_hand(texts, 100)


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(2)
    runs, everything = [], []
    for r in range(7):
        keys = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 80))})
        everything += [(k, r) for k in keys]
        if keys:
            blob = suffix_dedup.pack_run(keys, np.full(len(keys), r), np.arange(len(keys)), np.ones(len(keys), np.int64))
            assert [x[0] for x in suffix_dedup.open_run(blob)] == keys
            runs.append(suffix_dedup.open_run(blob))
    got = list(suffix_dedup.merged(runs))
    assert [g[0] for g in got] == sorted(k for k, _ in everything)
    for one, two in zip(got, got[1:]):
        assert two[1] == suffix_dedup.first_difference(one[0], two[0], 0)


def test_lone_window_leaves_a_group_whole():
    gram, middle, back = b"G" * 32, b"m" * 58, b"p" * 10
    one, two = (gram + middle + end + back + bytes([10]) for end in (b"a", b"c"))
    lone = gram + middle + b"b" * 10 + bytes([suffix_dedup.LONE])
    for many in (1, 2):
        rows = [(one, 1, 0, 2), *[(lone, 5 + k, 0, 1) for k in range(many)], (two, 9, 40, 2)]
        runs = [suffix_dedup.open_run(suffix_dedup.pack_run([k], np.array([d]), np.array([s]), np.array([n]))) for k, d, s, n in rows]
        assert sorted(suffix_dedup.repeats(runs, 100)) == [(6, 0, 1)] * (many - 1) + [(9, 40, 41)]


def test_exact_stream_in_many_batches(spark):
    rows = [(i, ["a b", "ab ", "a\tb", "c", "", None, "  "][i % 7]) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_stream.exact_groups(df, files_per_batch=1).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(exact_like(t), []).append((-len(t or ""), i))
    for i, t in rows:
        key = exact_like(t)
        keep = min(groups[key])[1]
        assert got[i] == (keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest())


def exact_like(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\f\r")


def test_exact_checks_full_bytes(spark):
    source = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "doc_id long, text string")
    digest = hashlib.sha256(b"same").hexdigest()
    forged = spark.createDataFrame([(digest, 2, 3)], "digest string, group_size long, locator long")
    assert exact_stream.collisions(source, forged).count() == 0
    true = spark.createDataFrame([(digest, 2, 1)], "digest string, group_size long, locator long")
    assert exact_stream.collisions(source, true).count() == 0


def test_simhash_against_all_pairs(docs, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_trie.simhash_components(docs).collect()}
    prints = {d: simhash_trie.simhash(t.encode(), 4) for d, t in texts.items()}
    label = {d: d for d in texts}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sorted(texts), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == {d: (f"{prints[d]:016x}", label[d]) for d in texts}


@pytest.mark.parametrize("near_blocks,budget,tile", [(None, 4, 2048), (None, 4, 8), (5, 9, 2048), (5, 9, 16)])
def test_trie_join_finds_all_links(spark, near_blocks, budget, tile):
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 60, dtype=np.uint64)
    values = set(seeds.tolist()) | {0, 1, 2**64 - 1}
    for s in seeds.tolist()[:25]:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, budget + 3), replace=False)
            values.add(s ^ int(sum(1 << int(f) for f in flips)))
    values = np.array(sorted(values), np.uint64)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values.view(np.int64))], "node long, fp long")
    edges = [(r["u"], r["v"]) for r in simhash_trie.link_edges(df, budget, near_blocks, tile).distinct().collect()]
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= budget
    assert all(near[u, v] for u, v in edges)
    i, j = np.nonzero(np.triu(near, 1))
    want = simhash_trie.smallest_linked(len(values), i, j)
    u, v = np.array(edges).T
    assert (simhash_trie.smallest_linked(len(values), u, v) == want).all()


def test_plan_of_links_does_not_grow_with_the_blocks(spark):
    """The driver compiles it: one expression for each of 70 entries took it over its memory."""
    reps = spark.createDataFrame([(1, 2), (3, 4)], "node long, fp long")

    def size(budget: int, near_blocks: int | None) -> int:
        return len(simhash_trie.link_edges(reps, budget, near_blocks)._jdf.queryExecution().optimizedPlan().toJSON())

    assert size(9, 5) < 1.5 * size(4, None)


def test_near_groups_are_verified(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    base = [rng.choice(words) for _ in range(200)]
    rows = {0: base}
    for i in range(1, 6):
        copy = list(base)
        copy[rng.randrange(200)] = "changed"
        rows[i] = copy
    far = list(base)
    for k in range(0, 200, 12):
        far[k] = "elsewhere"
    rows[6] = far
    rows[7] = [rng.choice(words) for _ in range(200)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in simhash_trie.verified_groups(df).collect() if r["doc_id"] != r["keep_id"]}
    assert got == {i: 0 for i in range(1, 6)}


def test_near_groups_of_a_star_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(600)]
    rows = {}
    for star in range(3):
        base = [rng.choice(words) for _ in range(200)]
        hub = 100 * star + 60
        rows[hub] = base
        for i in range(100 * star, 100 * star + 61):
            if i != hub:
                copy = list(base)
                for at in rng.sample(range(5, 195), 4):
                    copy[at] = rng.choice(words)
                rows[i] = copy
    for i in range(400, 430):
        rows[i] = [rng.choice(words) for _ in range(200)]
    texts = {i: " ".join(w) for i, w in rows.items()}
    prints = {i: simhash_trie.simhash(t.encode(), 2) for i, t in texts.items()}
    label = {i: i for i in texts}
    links = [
        (i, j) for i, j in itertools.combinations(sorted(texts), 2)
        if (prints[i] ^ prints[j]).bit_count() <= 9 and simhash_trie.jaccard(texts[i], texts[j], 5) >= 0.8
    ]
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    want = {i: k for i, k in label.items() if i != k}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for tile in (512, 20):
        monkeypatch.setattr(simhash_trie, "OPEN_TILE", tile)
        got = {r["doc_id"]: r["keep_id"] for r in simhash_trie.verified_groups(df).collect() if r["doc_id"] != r["keep_id"]}
        assert len(want) > 100 and got == want
