"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import public_tokenizers
import pytest
from pyspark.sql import types as T

from tidewatt.llm import crf_lang, embed_dedup, exact_stream, license_scan, packing, pfair_mix, ring_shards, simhash_trie, site_quality, suffix_dedup

CLASHING = ("fp", "node", "digest", "spot", "block", "slot", "rank", "grams", "text_sha256", "score", "host", "v")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = "the quick brown fox and the lazy dog number " * 4000
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "One line of words about the weather today.", "en", "a"),
    (4, "One line of words about the weather today.", "en", "a"), (5, "One line of words about the weather today.", "en", "b"),
    (6, LONG, "en", None), (None, "A row without an id", "en", "a"), (8, "Der Hund und die Katze sind nicht hier", "de", "b"), (9, "12345 !!! ???", "de", "c"),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, None, 1), (8, 0, None), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pack": lambda d: packing.digest(packing.pieces(d, TOKENIZER)),
    "notices": license_scan.find_notices,
    "quality": lambda d: site_quality.classify(d, labels(d.sparkSession)),
    "language": crf_lang.identify,
    "shards": ring_shards.shard,
    "mix": pfair_mix.mix,
    "repeats": suffix_dedup.remove_repeats,
    "exact": exact_stream.exact_groups,
    "simhash": simhash_trie.simhash_components,
}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, *["x"] * len(CLASHING)) for r in ROWS]
    schema = T.StructType([*SCHEMA.fields, *[T.StructField(c, T.StringType()) for c in CLASHING]])
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, name):
    assert OPERATORS[name](nothing).count() == 0


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"pack", "exact", "simhash", "language", "quality"}))
def test_one_row_each(odd, name):
    assert OPERATORS[name](odd).count() == len(ROWS)


def test_pack_odd_rows(odd):
    rows = OPERATORS["pack"](odd).collect()
    total = {}
    for r in rows:
        total.setdefault(r["doc_id"], []).append(r)
    assert sum(r["length"] for r in total[1]) == 1 and sum(r["length"] for r in total[2]) == 1
    assert len(total[4]) == 2 and len(total[None]) == 1
    assert sum(r["length"] for r in total[6]) == total[6][0]["doc_tokens"] > 30_000


def test_exact_odd_rows(odd):
    rows = [tuple(r) for r in OPERATORS["exact"](odd).collect()]
    assert len(rows) == len(ROWS)
    by = {(r[0], r[1], r[2], r[3]) for r in rows}
    assert {(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True)} <= by
    assert {(4, 4, 3, True), (5, 4, 3, False), (None, None, 1, True)} <= by


def test_simhash_odd_rows(odd):
    rows = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in OPERATORS["simhash"](odd).collect()}
    zero = "0" * 16
    assert {(1, zero, 1), (2, zero, 1), (3, zero, 1)} <= rows
    assert {c for i, _, c in rows if i in (4, 5)} == {4}
    assert (None in {i for i, _, _ in rows})


def test_language_odd_rows(odd):
    rows = OPERATORS["language"](odd).collect()
    assert len(rows) == len(ROWS)
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {1, 2, 3, 9}
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_without_labels(odd):
    rows = crf_lang.identify(odd.drop("lang").withColumn("lang", odd["text"].substr(0, 0)).where("false").unionByName(odd.withColumn("lang", odd["lang"].substr(99, 1)).where("false"))).collect()
    assert rows == []


def test_quality_odd_rows(odd, spark):
    rows = OPERATORS["quality"](odd).collect()
    assert len(rows) == len(ROWS) and all(0 < r["quality"] < 1 for r in rows)
    none = site_quality.classify(odd, labels(spark).where("false")).collect()
    assert {round(r["quality"], 6) for r in none} == {0.5}


def test_repeats_odd_rows(odd):
    rows = [(r["doc_id"], r["n_bytes"], len(bytes(r["kept"]))) for r in OPERATORS["repeats"](odd).collect()]
    assert (1, 0, 0) in rows and (2, 0, 0) in rows
    long = next(r for r in rows if r[0] == 6)
    assert long[1] == len(LONG) and long[2] < 300


def test_embeddings_odd_rows(spark):
    nan = float("nan")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0, 0.0]),
        (8, [1.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [0.0, 1.0]), (10, []), (11, [float("inf"), 1.0]),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, node string, v string")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_components(df).collect())
    assert len(got) == len(rows)
    assert (1, 3, 1, True) in got and (2, 3, 1, False) in got and got.count((8, 3, 1, False)) == 2
    assert all((i, 0, i, True) in got for i in (3, 4, 5, 6, 7, 9, 10, 11))
    assert embed_dedup.near_components(df.where("false")).count() == 0
