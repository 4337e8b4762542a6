import pytest
from pyspark.sql import functions as F

from watchpost.operators import filters as f
from watchpost.functions.times import from_ts, to_ts, ts_lit

T0 = 1_704_067_200


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.fixture(scope="module", params=["timestamp", "timestamp_ntz"])
def logs(spark, request):
    rows = [
        (1, T0, "error", "Disk FULL 100%", "web", ["env:test", "a:b:c"]),
        (2, T0 + 10, "info", "disk ok", "api", ["env:test"]),
        (3, T0 + 20, "info", None, None, None),
        (4, T0 + 30, "info", "100 of 200", "", []),
    ]
    df = spark.createDataFrame(
        rows, "id long, s long, status string, message string, service string, tags array<string>"
    )
    return df.withColumn("ts", F.timestamp_seconds("s").cast(request.param)).drop("s")


def test_time_range_is_half_open(logs):
    assert ids(f.time_range(logs, T0, T0 + 20)) == [1, 2]
    assert ids(f.time_range(logs, T0 + 20, T0)) == []
    assert ids(f.time_range(logs, T0 + 9.5, T0 + 10.5)) == [2]


def test_time_range_reaches_the_parquet_reader(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = f.time_range(df, T0, T0 + 60)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan


def test_time_range_prunes_days(spark, tmp_path):
    df = spark.range(5).select(
        "id",
        F.timestamp_seconds(F.lit(T0) + F.col("id") * 86400).alias("ts"),
        F.timestamp_seconds(F.lit(T0) + F.col("id") * 86400).cast("date").alias("dt"),
    )
    df.write.partitionBy("dt").parquet(str(tmp_path / "t"))
    found = f.time_range(
        spark.read.parquet(str(tmp_path / "t")), T0 + 86400, T0 + 2 * 86400 + 1, day_col="dt"
    )
    assert ids(found) == [1, 2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_a_column_called_dt_changes_nothing_by_itself(spark):
    df = spark.range(3).select(
        "id",
        F.timestamp_seconds(F.lit(T0) + F.col("id")).alias("ts"),
        F.lit("1999-01-01").cast("date").alias("dt"),
    )
    assert ids(f.time_range(df, T0, T0 + 2)) == [0, 1]


def test_search_terms(logs):
    assert ids(f.search_rows(logs)) == [1, 2, 3, 4]
    assert ids(f.search_rows(logs, text=("*", ""))) == [1, 2, 3, 4]
    assert ids(f.search_rows(logs, text=("DISK",))) == [1, 2]
    assert ids(f.search_rows(logs, text=("100%",))) == [1]
    assert ids(f.search_rows(logs, {"service": "web", "status": "error"})) == [1]
    assert ids(f.search_rows(logs, {"service": "WEB"})) == []
    assert ids(f.search_rows(logs, {"env": "test"}, ("ok",))) == [2]
    assert ids(f.search_rows(logs, {"a": "b:c"})) == [1]
    assert ids(f.search_rows(logs, {"id": "2"})) == [2]
    assert ids(f.search_rows(logs, {"id": "two"})) == []


def test_search_null_is_false_not_null(logs):
    from watchpost.functions.predicates import search

    assert ids(logs.filter(~search(logs, {"service": "web"}))) == [2, 3, 4]


def test_search_meta_and_error(spark):
    spans = spark.createDataFrame(
        [(1, 1, {"http.status_code": "500"}), (2, 0, {"a": "1"}), (3, None, None)],
        "id long, error int, meta map<string,string>",
    )
    assert ids(f.search_rows(spans, {"http.status_code": "500"})) == [1]
    assert ids(f.search_rows(spans, {"error": "true"})) == [1]
    assert ids(f.search_rows(spans, {"error": "false"})) == [2, 3]
    with pytest.raises(ValueError):
        f.search_rows(spans, {"error": "yes"})
    with pytest.raises(ValueError):
        f.search_rows(spans.drop("meta"), {"x": "1"})


def test_span_facets(spark):
    spans = spark.createDataFrame(
        [(1, "web", "get"), (2, "web", "put"), (3, "api", "get")],
        "id long, service string, operation string",
    )
    assert ids(f.span_facets(spans)) == [1, 2, 3]
    assert ids(f.span_facets(spans, "", "")) == [1, 2, 3]
    assert ids(f.span_facets(spans, "web")) == [1, 2]
    assert ids(f.span_facets(spans, "web", "get")) == [1]


@pytest.fixture(scope="module")
def boards(spark):
    return spark.createDataFrame(
        [
            (1, "CPU 50% used", "team:a,env:b"),
            (2, "cpu 500 used", "team:a, env:b"),
            (3, None, None),
            (4, "a_b", ""),
            (5, "axb", "team:A"),
        ],
        "id long, title string, description string",
    )


def test_title_contains(boards):
    assert ids(f.title_contains(boards, "")) == [1, 2, 3, 4, 5]
    assert ids(f.title_contains(boards, None)) == [1, 2, 3, 4, 5]
    assert ids(f.title_contains(boards, "CPU 50")) == [1, 2]
    assert ids(f.title_contains(boards, "50%")) == [1]
    assert ids(f.title_contains(boards, "a_b")) == [4]


def test_csv_tags(boards):
    assert ids(f.csv_tags_all(boards, [])) == [1, 2, 3, 4, 5]
    assert ids(f.csv_tags_all(boards, ["team:a"])) == [1, 2]
    assert ids(f.csv_tags_all(boards, ["team:a", "env:b"])) == [1]
    assert ids(f.csv_tags_all(boards, [" env:b"])) == [2]
    assert ids(f.csv_tags_all(boards, [""])) == [4]


def test_filter_monitors(spark):
    m = spark.createDataFrame(
        [
            (1, "High CPU", ["env:p", "t:x"], "Alert"),
            (2, "low cpu", ["env:p"], "No Data"),
            (3, None, None, None),
            (4, "disk", [], "Warn"),
        ],
        "id long, name string, tags array<string>, overall_state string",
    )
    assert ids(f.filter_monitors(m)) == [1, 2, 3, 4]
    assert ids(f.filter_monitors(m, ["alert", "no data"])) == [1, 2]
    assert ids(f.filter_monitors(m, name="CPU")) == [1, 2]
    assert ids(f.filter_monitors(m, tags=["env:p", "t:x"])) == [1]
    assert ids(f.filter_monitors(m, ["warn"], "disk", [])) == [4]
    with pytest.raises(ValueError):
        f.filter_monitors(m, ["skipped"])


def test_filter_hosts(spark):
    h = spark.createDataFrame(
        [
            (1, "web-01", ["alpha"], ["env:prod"], T0),
            (2, "db", ["WEB-old"], ["env:production"], T0 + 10),
            (3, None, None, None, None),
        ],
        "id long, name string, aliases array<string>, tags array<string>, s long",
    ).withColumn("last_reported", F.timestamp_seconds("s"))
    assert ids(f.filter_hosts(h)) == [1, 2, 3]
    assert ids(f.filter_hosts(h, "env:prod")) == [1]
    assert ids(f.filter_hosts(h, "web")) == [1, 2]
    assert ids(f.filter_hosts(h, None, T0 + 10)) == [2]
    assert ids(f.filter_hosts(h, "web", T0)) == [1, 2]


def test_get_by_id(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert f.get_by_id(df, "b").first()["v"] == 2
    assert f.get_by_id(df, "c").count() == 0
    with pytest.raises(LookupError):
        f.get_by_id(df, "c", strict=True)
    with pytest.raises(ValueError):
        f.get_by_id(df, "")


def test_current_downtimes(spark):
    d = spark.createDataFrame(
        [
            (1, T0, T0 + 10, False),
            (2, T0, None, None),
            (3, T0 + 11, None, False),
            (4, T0, None, True),
            (5, None, T0 + 6, False),
            (6, None, T0 + 5, False),
        ],
        "id long, a long, b long, disabled boolean",
    ).select(
        "id", "disabled", F.timestamp_seconds("a").alias("ts_start"),
        F.timestamp_seconds("b").alias("ts_end"),
    )
    assert ids(f.current_downtimes(d, T0 + 5)) == [1, 2, 3, 4, 5, 6]
    assert ids(f.current_downtimes(d, T0 + 5, True)) == [1, 2, 5]
    assert ids(f.current_downtimes(d, T0 + 10, True)) == [2]


def test_time_units(spark):
    row = spark.range(1).select(
        from_ts(to_ts(F.lit(T0 + 1), "s"), "s").alias("s"),
        from_ts(to_ts(F.lit((T0 + 1) * 1000 + 7), "ms"), "ms").alias("ms"),
        from_ts(to_ts(F.lit(1_704_067_200_123_456_789), "ns"), "us").alias("us"),
        from_ts(to_ts(F.lit(-1), "ns"), "us").alias("neg"),
        from_ts(to_ts(F.lit("2024-01-01T00:00:01.999Z"), "iso"), "s").alias("floor"),
        to_ts(F.lit("not a time"), "iso").alias("bad"),
        from_ts(ts_lit(T0 + 0.25, to_type("timestamp")), "iso").alias("iso"),
    ).first()
    assert row["s"] == T0 + 1
    assert row["ms"] == (T0 + 1) * 1000 + 7
    assert row["us"] == 1_704_067_200_123_456
    assert row["neg"] == -1
    assert row["floor"] == T0 + 1
    assert row["bad"] is None
    assert row["iso"] == "2024-01-01T00:00:00.250Z"


def to_type(name):
    from pyspark.sql import types as T

    return {"timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType()}[name]
