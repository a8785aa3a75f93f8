"""From raw documents to packed sequences, one operator a stage.

Each stage reads all that the one before kept, as Parquet. The first four return the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.llm import crf_lang, exact_stream, packing, pfair_mix, simhash_trie
from tidewatt.plans.sizing import broadcast_if_small
from tidewatt.session import freeze, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is rejected if it has no letter, or if its words are on average less sure than this of any language.
LEAST_SURE = 0.5
#: Rows of one batch that goes to a Python worker: whole texts are long, and workers share an executor's memory.
BATCH_ROWS = 1000
#: Words whose ids a packing worker keeps.
PACK_WORDS = 250_000
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def _in_small_batches(docs: DataFrame) -> DataFrame:
    """The columns of documents; batches for Python are cut when a stage is written, so the session keeps this setting."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: texts with letters whose words are sure of theirs, mixed texts included.

    Null, empty and letterless texts go. Very long texts are read whole; repeated rows and null ids are judged like any
    other; extra columns go. Without any labelled row nothing can be learned, and every text with a letter stays. An
    empty table gives an empty one.
    """
    source = _in_small_batches(docs)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    verdict = crf_lang.verdict(source, "text")
    if verdict is None:
        return source.where(has_letter)
    return source.withColumn("__v", verdict).where((F.col("__v.lang_pred") != "und") & (F.col("__v.sure") >= LEAST_SURE)).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of texts that are equal but for blanks: most code points, then smallest id.

    Null and empty texts are one group. Of rows with one id and equal texts the longest stays, then the greatest
    (text, other columns). Null ids come last in their group. Extra columns go; an empty table gives an empty one. Only
    rows whose id is among those of dropped or repeated rows are looked at again.
    """
    source = docs.select(*COLUMNS)
    groups = freeze(exact_stream.exact_groups(source).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    gone = freeze(groups.where("not kept").select(F.col("doc_id").alias("k"), F.col("text_sha256").alias("d")))
    ids = freeze(groups.where("not kept or n > 1").select(F.col("doc_id").alias("k")).distinct())
    small = broadcast_if_small(ids)
    plain = source.join(small, F.col("doc_id").eqNullSafe(F.col("k")), "left_anti")
    again = source.join(small, F.col("doc_id").eqNullSafe(F.col("k")), "left_semi")
    again = again.withColumn("__d", F.sha2(exact_stream.normal(F.col("text")), 256))
    again = again.join(broadcast_if_small(gone), F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("__d") == F.col("d")), "left_anti")
    row = F.struct(F.length("text").alias("points"), "text", "lang", "source", "n_chars")
    best = again.groupBy("doc_id", "__d").agg(F.max(row).alias("row"))
    return plain.unionByName(best.select("doc_id", *[F.col("row")[c].alias(c) for c in COLUMNS[1:]]))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies: links of five-word similarity 0.8 or more.

    Texts without words and rows with a null id are never linked and stay; texts are compared whole, rows that
    share an id stay or go together. Extra columns go; an empty table gives an empty one.
    """
    source = _in_small_batches(docs)
    groups = simhash_trie.verified_groups(source, shingle=SHINGLE_WORDS, similarity=SIMILARITY)
    gone = freeze(groups.where("doc_id <> keep_id").select(F.col("doc_id").alias("g")).distinct())
    return source.join(broadcast_if_small(gone), F.col("doc_id") == F.col("g"), "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mix: files and rows follow the slots of the schedule.

    A null source is a source of its own. Rows that share an id take its first slot; null ids and texts stay. Extra
    columns go; an empty table gives an empty one.
    """
    source = docs.select(*COLUMNS)
    order = freeze(pfair_mix.mix(source).groupBy(F.col("doc_id").alias("o")).agg(F.min("slot").alias("slot"), F.min("place").alias("place")))
    rows = source.join(broadcast_if_small(order), source["doc_id"].eqNullSafe(order["o"]))
    return rows.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids, packed file by file of the mix, so that neighbours there stay near.

    Null and empty texts are one id, the end mark. Long texts fill sequences of their own; repeated rows and null ids
    are packed once each. Extra columns go; an empty table gives no pieces.
    """
    rows = _in_small_batches(docs)
    return packing.digest(packing.pieces(rows, public_tokenizers.path("word_bpe_49k.json"), cache_words=PACK_WORDS))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mixed), ("pack", packed)]

#: Language, near copies, schedule and packing are learned or iterative: tested by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = scratch_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
