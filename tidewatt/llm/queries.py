"""The registered corpus queries, one per operator, over whole tables with production settings."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids, crf_lang, embed_dedup, exact_stream, license_scan, packing, pfair_mix, ring_shards, simhash_trie, site_quality, suffix_dedup, token_align,
    url_filter,
)
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_components(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.find_notices(table(spark, sf_dir, "documents")))


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_lang.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring_shards.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mix(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_stream.exact_groups(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.simhash_components(table(spark, sf_dir, "documents"), shingle=4, budget=4)


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_align.summary(table(spark, sf_dir, "documents"), *paths)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=CENTROIDS, rounds=ROUNDS).drop("centroid")


#: Rule -> verdict.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
CENTROIDS, ROUNDS = 16, 3


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_embedding_dedup, op3_license_scan, op4_site_quality, op5_language, op6_sharding, op7_mixing, op8_suffix_dedup, op9_exact_dedup,
        op10_simhash, op11_token_align, op12_centroids, op13_url_filter,
    )
}



def _centroid_sql(k: int, rounds: int) -> str:
    """All distances in every round, one row per component; means are floored exactly."""
    steps = ["""
        kept AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, row_number() OVER () AS r
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), x AS (
            SELECT r, unnest(range(64)) AS d, unnest(e) AS v FROM kept
        ), start AS (
            SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS c FROM kept QUALIFY c < """ + str(k) + """
        ), m0 AS (
            SELECT c, d, v FROM start JOIN x USING (r)
        )"""]
    for i in range(rounds + 1):
        steps.append(f"""
        d{i} AS (
            SELECT x.r, m.c, sum((x.v - m.v) * (x.v - m.v)) AS dist FROM x JOIN m{i} m USING (d) GROUP BY 1, 2
        ), a{i} AS (
            SELECT r, CAST(min_by(c, dist * 1000 + c) AS INTEGER) AS c, CAST(min(dist) AS BIGINT) AS dist FROM d{i} GROUP BY r
        )""")
        if i < rounds:
            steps.append(f"""
        s{i} AS (
            SELECT a.c, x.d, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN x USING (r) GROUP BY 1, 2
        ), m{i + 1} AS (
            SELECT m.c, m.d, coalesce((s - ((s % n) + n) % n) // n, m.v) AS v FROM m{i} m LEFT JOIN s{i} s USING (c, d)
        )""")
    return f"""
        WITH {','.join(steps)}, h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS h FROM m{rounds} GROUP BY c)
        SELECT vec_id, a.c AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(dist) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
        FROM a{rounds} a JOIN kept USING (r) JOIN h ON h.c = a.c"""


ORACLE = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), link AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
        ), reach AS (
            SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT reach.u, link.w FROM reach JOIN link ON link.u = reach.w
        )
        SELECT r.u AS vec_id, (SELECT count(*) FROM link WHERE link.u = r.u) AS n_links, min(r.w) AS component_id, min(r.w) = r.u AS kept
        FROM reach r GROUP BY r.u""",
    "op9_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
        ), g AS (
            SELECT doc_id, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY n) AS group_size, sha256(n) AS text_sha256
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op12_centroids": _centroid_sql(CENTROIDS, ROUNDS),
}
