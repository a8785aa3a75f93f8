"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``replicas`` points of the ring; a key belongs to the next point clockwise. Shards
have a capacity; keys that find their shard full go on clockwise to the next shard with room. Arcs
of the ring are filled in ring order, so the plan needs only the number of keys on each arc: one
aggregate, folded once over the arcs (their number is shards x replicas, whatever the data) by SQL
higher-order functions. Rows then find their place from their rank on the arc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, ranked, slim

REPLICAS = 64
#: The ring has so many grid cells (as bits); virtual nodes lie on them. Fixed, whatever the data.
GRID_BITS = 16


def ring(spark, shards: int, replicas: int) -> DataFrame:
    """Arcs in ring order: arc, cells (the grid cells it covers), prefer (shards clockwise from it)."""
    points = spark.range(shards * replicas).select(
        F.floor(F.col("id") / replicas).cast("int").alias("shard"), (F.col("id") % replicas).cast("int").alias("replica")
    )
    points = points.withColumn("upto", F.shiftrightunsigned(F.xxhash64(F.lit("node"), "shard", "replica"), 64 - GRID_BITS))
    points = points.groupBy("upto").agg(F.min("shard").alias("shard"))
    line = points.agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("points"))
    clockwise = F.transform(
        F.sequence(F.lit(0), F.size("points") - 1),
        lambda i: F.struct(
            i.alias("arc"),
            F.sequence(F.when(i > 0, F.try_element_at("points", F.greatest(i, F.lit(1)))["upto"] + 1).otherwise(0), F.element_at("points", i + 1)["upto"]).alias("cells"),
            F.sequence(F.element_at("points", -1)["upto"] + 1, F.lit(1 << GRID_BITS).cast("long")).alias("beyond"),
            F.array_distinct(F.transform(F.concat(F.slice("points", i + 1, F.size("points")), F.slice("points", 1, i)), lambda p: p["shard"])).alias("prefer"),
        ),
    )
    arcs = line.select(F.explode(clockwise).alias("a")).select("a.*")
    return arcs.select("arc", "prefer", F.when(F.col("arc") == 0, F.concat("cells", "beyond")).otherwise(F.col("cells")).alias("cells"))


def _plan(arcs: DataFrame, shards: int, slack: float) -> DataFrame:
    """Fold arcs (arc, prefer, n) in ring order: stretches of an arc's keys with shard and first slot.

    Capacities: with no slack as equal as whole rows allow, else (1 + slack) times the mean.
    """
    total = F.aggregate("arcs", F.lit(0).cast("long"), lambda s, a: s + a["n"])
    base = F.floor(F.col("total") / shards).cast("long")
    room = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: (F.ceil(F.col("total") * (1 + slack) / shards).cast("long") if slack else base + F.when(s < F.col("total") % shards, 1).otherwise(0)).cast("long"),
    )
    line = arcs.agg(F.sort_array(F.collect_list(F.struct("arc", "prefer", "n"))).alias("arcs"))
    line = line.withColumn("total", total).withColumn("room", room)

    def fill(state: Column, arc: Column) -> Column:
        start = F.struct(
            state["used"].alias("used"), arc["n"].alias("left"), F.lit(0).cast("long").alias("from"), state["out"].alias("out")
        )

        def offer(s: Column, shard: Column) -> Column:
            taken = F.element_at(s["used"], shard + 1)
            gets = F.least(s["left"], F.element_at(F.col("room"), shard + 1) - taken)
            piece = F.struct(
                arc["arc"].alias("arc"), s["from"].alias("a"), (s["from"] + gets).alias("b"), shard.alias("shard"), taken.alias("slot")
            )
            return F.struct(
                F.transform(s["used"], lambda u, k: F.when(k == shard, u + gets).otherwise(u)).alias("used"),
                (s["left"] - gets).alias("left"),
                (s["from"] + gets).alias("from"),
                F.when(gets > 0, F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"),
            )

        done = F.aggregate(arc["prefer"], start, offer)
        return F.struct(done["used"].alias("used"), done["out"].alias("out"))

    empty = F.expr("cast(array() as array<struct<arc:int,a:bigint,b:bigint,shard:int,slot:bigint>>)")
    first = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("used"), empty.alias("out"))
    plan = line.select(F.explode(F.aggregate("arcs", first, fill)["out"]).alias("p")).select("p.*")
    return plan.groupBy(F.col("arc").alias("on_arc")).agg(F.sort_array(F.collect_list(F.struct("a", "b", "shard", "slot"))).alias("stretches"))


def shard(docs: DataFrame, shards: int = 8, replicas: int = REPLICAS, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, size, text_crc32, shard, slot.

    A key's ring position is the hash of its id. Slots of a shard run gapless from 0 in ring order.
    With ``slack`` 0 the row counts of shards differ by one at most; a larger slack moves fewer keys
    when shards come or go, and no shard exceeds (1 + slack) times the mean, rounded up. Null text
    has size 1 and the checksum of empty text; null ids share one ring position; repeated rows take
    one slot each (ids should be near unique: rows of one id are ranked together). An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    filled = F.coalesce("text", F.lit(""))
    rows = slim(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.octet_length(filled) + 1).cast("long").alias("size"),
        F.crc32(filled.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit("key"), "doc_id").alias("spot"),
    )
    rows = durable(rows)
    arcs = durable(ring(spark, shards, replicas))
    cells = arcs.select("arc", F.explode("cells").alias("cell"))
    rows = rows.withColumn("cell", F.shiftrightunsigned("spot", 64 - GRID_BITS)).join(F.broadcast(cells), "cell").drop("cell")
    counts = rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n"))
    stretches = durable(_plan(arcs.join(counts, "arc").select("arc", "prefer", "n"), shards, slack))
    numbered = ranked(rows, "arc", "spot", "doc_id", "rank")
    placed = numbered.join(F.broadcast(stretches), F.col("arc") == F.col("on_arc"))
    mine = F.filter("stretches", lambda s: (s["a"] <= F.col("rank")) & (F.col("rank") < s["b"]))[0]
    return placed.withColumn("mine", mine).select(
        "doc_id", "size", "text_crc32", F.col("mine.shard").alias("shard"), (F.col("mine.slot") + F.col("rank") - F.col("mine.a")).alias("slot")
    )
