"""Small hand-checked cases."""

import pytest
from pyspark.sql import functions as F

from tidewatt.functions import values
from tidewatt.functions.timestamps import infer_layouts, parse_inferred, parse_timestamp
from tidewatt.operators import buckets, clean, distributions, features, lagstats, ordered, quality
from tidewatt.spec import SeriesSpec
from tidewatt import sources

ROWS = SeriesSpec("i", (), ("v",))


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("size", [None, 3])
def test_interpolation_edges(spark, size):
    df = spark.createDataFrame(list(enumerate([None, 1.0, None, None, 4.0, None, 6.0, None])), "i int, v double")
    assert column(ordered.interpolate(df, ROWS, rows_per_chunk=size), "v") == [None, 1, 2, 3, 4, 5, 6, 6]
    assert column(ordered.fill_backward_forward(df, ROWS, size), "v") == [1, 1, 4, 4, 4, 6, 6, 6]
    empty = df.withColumn("v", F.lit(None).cast("double"))
    assert column(ordered.interpolate(empty, ROWS, rows_per_chunk=size), "v") == [None] * 8


def test_gap_is_strict_and_buckets_fill(spark):
    times = ["00:00:00", "00:15:00", "00:31:00", "00:32:00"]
    df = spark.createDataFrame([(t, 1.0) for t in times], "t string, v double").select(
        parse_timestamp(F.concat(F.lit("2024-01-01 "), "t")).alias("ts"), "v"
    )
    spec = SeriesSpec("ts", (), ("v",))
    assert [r["gap_minutes"] for r in ordered.find_gaps(df, spec).collect()] == [16.0]
    grid = buckets.resample_mean(df, spec, "5 minutes").orderBy("ts").collect()
    assert len(grid) == 7 and [r["v"] for r in grid] == [1.0, None, None, 1.0, None, None, 1.0]


def test_missing_kinds(spark):
    rows = [(0, float("nan")), (1, float("inf")), (2, float("-inf")), (3, None), (4, -999999.0), (5, -1000000.0), (6, 2.0)]
    df = spark.createDataFrame(rows, "i int, v double")
    issues = {r["column"]: r for r in quality.column_issues(df).collect()}
    assert (issues["v"]["null_count"], issues["v"]["inf_count"], issues["v"]["dtype"]) == (1, 2, "double")
    assert column(values.sentinel_to_null(df, ["v"]), "v")[4:] == [None, -1000000.0, 2.0]
    assert column(values.sentinel_to_null(df, ["v"], at_or_below=-999999.0), "v")[4:] == [None, None, 2.0]
    assert column(values.nan_to_null(df, ["v"]), "v")[0] is None


def test_calendar(spark):
    days = ["2023-12-31", "2024-01-01", "2024-02-29", "2024-03-01", "2024-03-02"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").cast("timestamp_ntz").alias("ts"))
    rows = features.calendar_features(df, "ts").orderBy("ts").collect()
    assert [r["weekday"] for r in rows] == [7, 1, 4, 5, 6] and [r["is_weekend"] for r in rows] == [1, 0, 0, 0, 1]
    friday = features.calendar_features(df, "ts", 5).orderBy("ts").collect()
    assert [r["is_weekend"] for r in friday] == [1, 0, 0, 1, 1]
    assert [r["quarter"] for r in rows] == [4, 1, 1, 1, 1] and rows[2]["day"] == 29


def test_step_mode_tie_takes_the_smaller(spark):
    df = spark.createDataFrame([(t,) for t in (0, 60, 120, 240, 360)], "s long").select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    row = buckets.infer_step_mode(df, SeriesSpec("ts")).first()
    assert (row["step_seconds"], row["step_alias"]) == (60.0, "1T")
    assert buckets.adaptive_interval(df, SeriesSpec("ts")).first()["interval_seconds"] == 60_000
    assert buckets.adaptive_interval(df.limit(1), SeriesSpec("ts")).first()["interval_seconds"] == 3600


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "2024/01/01 00:00:00", 2.0)], "id int, `Event Time` string, v double")
    assert values.detect_timestamp_column(df) == "Event Time"
    assert values.split_columns_by_type(df) == (["id", "v"], ["Event Time"])
    with pytest.raises(KeyError):
        values.require(df, ["id", "gone"])
    with pytest.raises(ValueError):
        values.lowercase_columns(df.select("id", F.lit(1).alias("ID")))
    with pytest.raises(ValueError):
        values.detect_timestamp_column(df.select("id"), required=True)


def test_constant_columns(spark):
    df = spark.createDataFrame([(i, 5.0, float(i)) for i in range(20)], "i int, v double, w double")
    assert lagstats.correlation_matrix(df, ["v", "w"]).filter("a <> b AND r IS NOT NULL").count() == 0
    assert lagstats.acf(df, ROWS, 3).filter("value IS NOT NULL").count() == 0
    bins = distributions.histogram(df, ROWS, 10).filter("n > 0").collect()
    assert [(r["bin"], r["n"]) for r in bins] == [(5, 20)]
    assert column(ordered.rolling_corr(df, SeriesSpec("i", (), ("v", "w")), 4), "rolling_corr") == [None] * 20


def test_hyphenated_columns_are_cleaned(spark):
    rows = [(i, -999999.0 if i == 5 else float(i % 7), 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "timestamp int, `mg-lv-msb_frequency` double, other double")
    out = clean.clean_table(df, SeriesSpec("timestamp"))
    assert out.columns == df.columns and column(out, "mg-lv-msb_frequency", "timestamp")[5] == 5.0


def test_duplicate_rows_keep_every_copy(spark, monkeypatch):
    monkeypatch.setattr(quality, "COPIES_PER_TASK", 3)
    df = spark.createDataFrame([(1, None)] * 8 + [(2, "x")] + [(3, "y")] * 2, "a int, b string")
    got = sorted((r["a"], r["b"] or "") for r in quality.duplicate_rows(df).collect())
    assert got == [(1, "")] * 8 + [(3, "y")] * 2


def test_merge_rejects_other_headers(spark, tmp_path):
    spark.range(3).selectExpr("id AS a", "id AS b").write.option("header", True).csv(f"{tmp_path}/x")
    spark.range(3).selectExpr("id AS b", "id AS a").write.option("header", True).csv(f"{tmp_path}/y")
    with pytest.raises(ValueError):
        sources.merge_files(spark, [f"{tmp_path}/x", f"{tmp_path}/y"])
    merged, report = sources.merge_files(spark, [f"{tmp_path}/x"])
    assert merged.count() == 3 and report.filter("NOT rows_kept").count() == 0


def test_deep_page_equals_shallow_page(spark, monkeypatch):
    from tidewatt.plans import order
    from tidewatt.sources import readers

    df = spark.range(1000).selectExpr("(id * 37) % 1000 AS t", "id AS tie")
    want = [r["t"] for r in readers.page(df, ["t", "tie"], 400, 50).collect()]
    monkeypatch.setattr(readers, "ROWS_PER_CHUNK", 10)
    monkeypatch.setattr(order, "ROWS_PER_CHUNK", 64)
    assert [r["t"] for r in readers.page(df, ["t", "tie"], 400, 50).collect()] == want == list(range(400, 450))
    assert readers.page(df, ["t", "tie"], 990, 50).count() == 10


def test_sinks_write_what_they_say(spark, tmp_path):
    spec = SeriesSpec("i", (), ("v",))
    df = spark.createDataFrame([(i, float(i)) for i in range(40)], "i int, v double")
    sources.sink_text_preview(df, spec, f"{tmp_path}/t")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/t").collect()]
    assert lines[:3] == ["Column: v", "---------", " 1: 0.0"] and len(lines) == 28


@pytest.mark.parametrize("texts,want,first", [
    (["03/04/2024 10:00:00", "25/12/2024 10:00:00"], ["dd/MM/yyyy HH:mm:ss"], "2024-04-03 10:00:00"),
    (["03/04/2024 10:00:00", "12/25/2024 10:00:00", "bad", None], ["MM/dd/yyyy HH:mm:ss"], "2024-03-04 10:00:00"),
    (["03/04/2024 10:00:00", "05/06/2024 10:00:00"], ["MM/dd/yyyy HH:mm:ss"], "2024-03-04 10:00:00"),
    (["2024-01-02T03:04:05", "2024-01-02T03:04:05", "02.01.2024"], ["yyyy-MM-dd'T'HH:mm:ss", "dd.MM.yyyy"], "2024-01-02 03:04:05"),
    (["no", "time"], [], None), ([], [], None),
])
def test_layouts_are_voted_for(spark, texts, want, first):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert infer_layouts(df, "t")["t"] == want
    got = [r["t"] for r in parse_inferred(df, "t").orderBy("i").collect()]
    assert len(got) == len(texts) and (not texts or (None if got[0] is None else str(got[0])) == first)
