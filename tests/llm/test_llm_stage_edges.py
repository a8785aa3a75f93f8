"""Stages of the pipeline on empty tables, unlabelled, repeated, null, very long and mixed rows, with extra columns."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the old house by the river was sold again in spring " * 3000
MIXED = "the house is old and the river is wide la casa es vieja y el perro duerme en la calle das Haus ist alt und der Hund schläft auf der Straße"
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "12 !!", None, "a", 5), (4, LONG, "en", "a", 1), (5, MIXED, None, "b", 1), (None, "a row without an id", "en", "a", 1),
    (None, "a row without an id", "en", "a", 1), (6, "same text here", "en", "a", 1), (6, "same  text here", "en", "b", 1), (7, "same text here", "en", "c", 1), (7, "another text of that id", "en", "c", 1),
]
FOUR = P.STAGES[:-1]


def columns_of(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows.collect())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({"k": F.lit("x"), "slot": F.lit(1), "row": F.lit("y"), "__d": F.lit("z")}).cache()


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_empty_tables(spark, sf_dir, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf_dir).count() == 0


@pytest.mark.parametrize("name,stage", FOUR)
def test_columns_of_documents(spark, sf_dir, odd, name, stage):
    assert stage(spark, odd, sf_dir).columns == list(P.COLUMNS)


def test_language_without_labels_keeps_letters(spark, sf_dir, odd):
    got = P.language(spark, odd.withColumn("lang", F.lit(None).cast("string")), sf_dir)
    assert columns_of(got) == columns_of(odd.where("doc_id is null or doc_id > 3"))


def test_language_keeps_mixed_texts(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*P.COLUMNS)
    langs = [r["lang"] for r in docs.where("lang is not null").select("lang").distinct().collect()]
    words = []
    for lang in sorted(langs):
        text = docs.where(F.col("lang") == lang).where("length(text) > 400").orderBy("doc_id").first()["text"]
        words.append(" ".join(text.split()[:20]))
    mixed = spark.createDataFrame([(-9, " ".join(words), None, "m", 1), (-8, "77 88", None, "m", 1)], SCHEMA)
    kept = {r["doc_id"] for r in P.language(spark, docs.unionByName(mixed), sf_dir).select("doc_id").collect()}
    assert -9 in kept and -8 not in kept


def test_exact_keeps_the_longest_of_an_id(spark, sf_dir, odd):
    got = columns_of(P.exact(spark, odd, sf_dir))
    assert len(got) == 7 and (False, 6, "same  text here") in got and (False, 7, "another text of that id") in got and (False, 7, "same text here") not in got


def test_near_and_mix_keep_odd_rows(spark, sf_dir, odd):
    assert columns_of(P.mixed(spark, odd, sf_dir)) == columns_of(odd)
    kept = columns_of(P.near(spark, odd, sf_dir))
    assert {(True, 0, "a row without an id"), (False, 1, ""), (False, 2, ""), (False, 4, LONG)} <= set(kept)


def test_pack_odd_rows(spark, sf_dir, odd):
    rows = P.packed(spark, odd, sf_dir).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1 and sum(r["length"] for r in rows if r["doc_id"] == 4) > 30_000
