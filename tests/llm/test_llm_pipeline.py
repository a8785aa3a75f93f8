"""Registration, SQL checks of the corpus queries, and the pipeline stage by stage."""

import corpus_pipeline as P
import pytest
from oracle import compare

import __spark_entry__ as entry
from tidewatt.llm import queries as Q
from tidewatt.llm import simhash_trie


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_sql(spark, sf_dir, name):
    assert compare(spark, name, Q.QUERIES[name], Q.ORACLE[name], sf_dir) is None


def test_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in names if k.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    place = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([
        (-1, None, "en", "src1", 0), (-2, "12 34 !!", "en", "src1", 8), (-3, "  The quick  brown fox", "en", None, 4), (-4, "The quick brown fox", "en", "x", 4),
        (-4, "The quick brown fox", "en", "x", 4),
    ], docs.schema)
    out = [docs.unionByName(odd)]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{place}/{k}")
        out.append(spark.read.parquet(f"{place}/{k}"))
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == list(P.COLUMNS)


def test_language_rejects_only_texts_without_language(stages):
    assert set(ids(stages[0])) - set(ids(stages[1])) == {-1, -2}


def test_exact_keeps_one_of_each(stages):
    def key(t):
        return "".join(c for c in t if c not in " \t\n\x0b\f\r")

    before, after = stages[1].collect(), stages[2].collect()
    want = {}
    for r in before:
        best = (-len(r["text"]), r["doc_id"])
        want[key(r["text"])] = min(best, want.get(key(r["text"]), best))
    assert ids(stages[2]) == sorted(i for _, i in want.values())
    assert len({key(r["text"]) for r in after}) == len(after)


def test_near_drops_only_near_copies(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    kept = set(ids(stages[3]))
    for gone in set(before) - kept:
        assert max(simhash_trie.jaccard(before[gone], before[k], 5) for k in before if k != gone) >= 0.8


def test_mix_keeps_all_and_orders(stages, spark):
    assert ids(stages[3]) == ids(stages[4])


def test_pack_takes_every_document(stages):
    rows = stages[5].collect()
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {r["doc_id"]: r["doc_tokens"] for r in rows} and set(total) == set(ids(stages[4]))
