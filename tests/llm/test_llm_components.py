"""Connected components: the same result for any lot, few tasks for few links, and no shuffle files left behind."""

import time
import uuid

import numpy as np
import pytest

from tidewatt.llm import common, simhash_trie


def brute(links):
    """node -> smallest node reachable, of nodes that are not the smallest."""
    top = {}
    for u, v in links:
        top.setdefault(u, u), top.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v in links:
            low = min(top[u], top[v])
            changed |= top[u] != low or top[v] != low
            top[u] = top[v] = low
    return {k: v for k, v in top.items() if k != v}


def some_links(rng):
    path = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 160)]
    loose = [tuple(x) for x in rng.integers(-200, -100, (60, 2)).tolist()]
    return path + star + loose + path[:5] + [(v, u) for u, v in star[:5]] + [(7, 7)]


@pytest.mark.parametrize("at_once", [1, 7, 64, 100_000])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_are_those_of_brute_force_whatever_a_lot_is(spark, at_once, kind):
    links = some_links(np.random.default_rng(5))
    if kind == "string":
        links = [(f"é{u}", f"é{v}") for u, v in links]
    df = spark.createDataFrame([*links, (None, links[0][0]), (links[0][0], None)], f"u {kind}, v {kind}").repartition(6)
    got = [tuple(r) for r in common.components(df, at_once=at_once).collect()]
    assert len(got) == len(set(got)) and dict(got) == brute([x for x in links if x[0] != x[1]])
    assert common.components(df.where("false"), at_once=at_once).count() == 0


def test_links_of_one_lot_take_a_few_passes_over_the_partitions(spark):
    """A path of 200 nodes took round upon round of several passes each, and every task writes files and log lines."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "u long, v long").repartition(4)
    partitions, group, context = 64, uuid.uuid4().hex, spark.sparkContext
    held = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with common.settings(spark, held):
        context.setJobGroup(group, "links of one lot")
        try:
            assert common.components(edges).where("component <> 0").count() == 0
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
            context.setLocalProperty("spark.job.description", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(s.numTasks for s in map(tracker.getStageInfo, stages) if s)
    assert 0 < tasks < 6 * partitions


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_a_durable_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = common.durable(spark.range(5000).selectExpr("id % 700 AS k").groupBy("k").count())
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert table.count() == 700 and table.agg({"count": "sum"}).first()[0] == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_roots_cut_into_tiles_give_the_links_of_whole_ones(spark):
    """Over-full roots are a written table now, which is broadcast while it is small."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (120, 2))})
    reps = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    for tile in (8, 1024):
        got = common.components(simhash_trie.link_edges(reps, 3, tile=tile))
        assert {r["node"]: r["component"] for r in got.collect()} == brute(near)
