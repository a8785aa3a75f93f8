"""Exact dedup as a stateful stream.

Digests flow through Structured Streaming; the state is one row per digest in RocksDB on local disk,
committed to the shared checkpoint folder, and it never expires. A state row holds how often the
digest came, the row that stays so far (code points, stable identifier) and where its text is to be
found (content locator). Sums and maxima are combined before the shuffle, so a text that makes up a
third of the rows costs one state update per task. Every hit is then checked byte by byte against
the text its locator names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.session import scratch_path

from .common import durable, only_members, settings, slim

#: The characters that do not count when texts are compared.
BLANKS = " \t\n\x0b\f\r"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> digest, size in code points, locator; works on batch and stream alike."""
    return docs.select(
        "doc_id",
        F.sha2(normal(F.col("text")), 256).alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"),
        F.col("doc_id").alias("locator"),
    )


def first_seen(stream: DataFrame) -> DataFrame:
    """The stateful step on a stream of digests: one state row per digest, kept for ever."""
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "points", (-F.col("doc_id")).alias("minus_id"), "locator"))
    return stream.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))


def run_stream(spark: SparkSession, stream: DataFrame, checkpoint: str) -> None:
    """Drain what the source holds now; started again on the same checkpoint it goes on from there."""
    with settings(spark, STATE_CONF):
        query = (
            first_seen(stream).writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the state holds: digest, group_size, keep_id, locator."""
    state = spark.read.format("statestore").option("path", checkpoint).load()
    kinds = {f.dataType.typeName(): f.name for f in state.schema["value"].dataType}
    best = F.col("value").getField(kinds["struct"])
    return state.select(
        F.col("key").getField("digest").alias("digest"),
        F.col("value").getField(kinds["long"]).alias("group_size"),
        (-best.getField("minus_id")).alias("keep_id"),
        best.getField("locator").alias("locator"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without space, tab and line-break characters; null
    counts as empty, and all empty texts are one group. The row with the most code points stays,
    then the smallest id. Repeated rows count in group_size, and all rows that bear keep_id are
    marked kept; rows with a null id come last and are kept only if their group has no id at all.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    source = slim(docs, doc_id=id_col, text=text_col)
    place = scratch_path(spark, "exact")
    digests(source).write.parquet(f"{place}/digests")
    slips = spark.read.parquet(f"{place}/digests")
    stream = spark.readStream.schema(slips.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{place}/digests")
    run_stream(spark, stream, f"{place}/checkpoint")
    read_state(spark, f"{place}/checkpoint").write.parquet(f"{place}/state")
    groups = spark.read.parquet(f"{place}/state")
    odd = collisions(source, groups)
    fewer = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("fewer"))
    fine = slips.join(groups.join(fewer, "digest", "left"), "digest").join(odd.select("digest", "doc_id"), ["digest", "doc_id"], "left_anti")
    fine = fine.select("doc_id", "digest", "keep_id", (F.col("group_size") - F.coalesce("fewer", F.lit(0))).alias("group_size"))
    own = odd.groupBy("digest", "bytes").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("points", (-F.col("doc_id")).alias("minus_id"))).alias("best")
    )
    own = own.select("digest", "bytes", "group_size", (-F.col("best.minus_id")).alias("keep_id"))
    others = odd.join(own, ["digest", "bytes"]).select("doc_id", "digest", "keep_id", "group_size")
    return fine.unionByName(others).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def collisions(source: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows whose digest is that of a kept row but whose bytes are not: none, unless digests collide.

    Only the texts of groups with a hit are moved. Written at once, as it is nearly always empty.
    """
    hits = groups.where("group_size > 1 and locator is not null").select("digest", "locator")
    rows = source.select("doc_id", F.sha2(normal(F.col("text")), 256).alias("digest"), normal(F.col("text")).alias("bytes"), F.length("text").cast("long").alias("points"))
    n = hits.count()
    held = only_members(rows, "doc_id", hits, "locator", n)
    held = held.join(hits, (held["doc_id"] == hits["locator"]) & (held["digest"] == hits["digest"])).select(held["digest"], F.col("bytes").alias("held"))
    held = held.groupBy("digest").agg(F.min("held").alias("held"))
    hit = only_members(rows, "digest", hits, "digest", n)
    return durable(hit.join(held, "digest").where("bytes <> held").select("doc_id", "digest", "bytes", "points"))
