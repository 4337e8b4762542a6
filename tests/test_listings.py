import json

import pytest
from pyspark.sql import functions as F

from watchpost.operators import aggregates, paging, projections
from watchpost.plans.layout import next_values, slice_sorted
from watchpost.sources.entities import ndjson_lines, write_ndjson

T0 = 1_704_067_200

MONITORS = (
    "id long, name string, message string, tags array<string>, query string,"
    " overall_state string, modified timestamp"
)


@pytest.fixture(scope="module")
def monitors(spark):
    states = ["Alert", "Warn", "No Data", "OK", "Ignored", "Skipped", "Unknown", "Paused", "", None]
    rows = [(i, f"m{i}", "x", ["a:b"], "q", s, None) for i, s in enumerate(states)]
    rows.append((None, None, None, None, None, "Alert", None))
    df = spark.createDataFrame(rows, MONITORS)
    return df.withColumn(
        "modified", F.when(F.col("id") == 1, F.timestamp_millis(F.lit(T0 * 1000 + 1999)))
    )


def test_monitor_summary(monitors):
    assert aggregates.monitor_summary(monitors).first().asDict() == {
        "alert": 2, "warn": 1, "noData": 1, "ok": 1, "ignored": 1, "skipped": 1, "unknown": 1,
    }
    empty = aggregates.monitor_summary(monitors.filter("false")).first().asDict()
    assert set(empty.values()) == {0}


def test_monitor_listing(monitors):
    rows = {r["id"]: r for r in projections.monitor_listing(monitors).collect()}
    assert rows[0]["name"] == "" and rows[0]["tags"] == [] or rows[0]["name"] == "m0"
    assert rows[1]["lastUpdatedTs"] == T0 + 1
    assert rows[2]["lastUpdatedTs"] is None
    assert rows[8]["status"] == "unknown" and rows[9]["status"] == "unknown"
    assert rows[7]["status"] == "Paused"
    bare = projections.monitor_listing(monitors.filter("id is null")).first()
    assert (bare["name"], bare["id"], bare["tags"], bare["query"]) == ("", 0, [], "")
    assert bare["message"] is None


def test_host_and_dashboard_listing(spark):
    hosts = spark.createDataFrame(
        [(1, "h", ["a"], ["p"], True, {"platform": "x"}, {"load": 1.0}, ["s"], True),
         (2, None, None, None, None, None, None, None, None)],
        "id long, name string, aliases array<string>, apps array<string>, is_muted boolean,"
        " meta map<string,string>, metrics map<string,double>, sources array<string>, up boolean",
    ).withColumn("last_reported", F.timestamp_seconds(F.lit(T0)))
    a, b = projections.host_listing(hosts, "u?host=").orderBy("id").collect()
    assert a["url"] == "u?host=h" and a["mute"] is True and a["last_reported"] == T0
    assert b["url"] is None
    slim = projections.host_details(hosts)
    assert "meta" not in projections.host_listing(slim, "u").columns
    boards = spark.createDataFrame([("x", "t")], "id string, title string")
    assert projections.dashboard_listing(boards, "d/").first()["url"] == "d/x"


REQUEST = (
    "id long, scope string, start long, end long, message string, timezone string,"
    " monitor_id long, monitor_tags array<string>, recurrence struct<type: string,"
    " period: double, week_days: array<string>, until: long>"
)


def test_normalise_downtimes(spark):
    def row(i, scope="host:a", start=T0, end=T0 + 60, rec=None):
        return (i, scope, start, end, None, None, None, None, rec)

    df = spark.createDataFrame(
        [
            row(1),
            row(2, scope=""),
            row(3, end=T0),
            row(4, rec=("days", 2.0, None, T0 + 5)),
            row(5, rec=("hours", 1.0, None, None)),
            row(6, rec=("days", 0.0, None, None)),
            row(7, rec=("weeks", 1.5, None, None)),
            row(8, rec=("weeks", 1.0, ["Mon", "Day"], None)),
            row(9, rec=("weeks", 1.0, ["Mon", "Sun"], None)),
            row(10, start=None, end=None),
            row(11, rec=(None, None, None, None)),
        ],
        REQUEST,
    )
    valid, rejected = projections.normalise_downtimes(df)
    good = {r["id"]: r for r in valid.collect()}
    assert sorted(good) == [1, 4, 9, 10]
    assert good[1]["scope"] == ["host:a"] and good[1]["recurrence"] is None
    assert good[4]["recurrence"]["period"] == 2 and good[4]["recurrence"]["until"] is not None
    assert {r["id"]: r["reason"] for r in rejected.collect()} == {
        2: "empty scope",
        3: "end not after start",
        5: "unknown recurrence type",
        6: "recurrence period below 1",
        7: "recurrence period not a whole number",
        8: "unknown week day",
        11: "unknown recurrence type",
    }


def test_unknown_time_zones_are_rejected(spark):
    def row(i, zone):
        return (i, "host:a", T0, T0 + 60, None, zone, None, None, None)

    zones = [None, "UTC", "Europe/Berlin", "+05:30", "Mars/Base", "", "+99:00"]
    df = spark.createDataFrame([row(i, z) for i, z in enumerate(zones)], REQUEST)
    valid, rejected = projections.normalise_downtimes(df)
    assert sorted(r["id"] for r in valid.collect()) == [0, 1, 2, 3]
    assert {r["id"]: r["reason"] for r in rejected.collect()} == {
        4: "unknown time zone", 5: "unknown time zone", 6: "unknown time zone",
    }


# paging


@pytest.fixture(scope="module")
def rows(spark):
    # many ties on ts; a third of the rows share one ts
    return spark.range(1000).select(
        "id",
        F.timestamp_seconds(F.lit(T0) + F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)).alias("ts"),
    )


PAGES = [
    (0, 1000, "asc", "timestamp"),
    (5, 0, "desc", "timestamp"),
    (990, 50, "asc_nulls_last", "timestamp_ntz"),
    (333, 400, "desc", "timestamp_ntz"),
    (333, 400, "asc", "timestamp"),
    (700, 1, "desc_nulls_last", "timestamp"),
    (2000, 5, "asc", "timestamp_ntz"),
]


@pytest.mark.parametrize("offset,n,way,kind", PAGES)
def test_deep_pages_equal_top_k(spark, offset, n, way, kind):
    # over five hours, with many ties, one instant holding a third, and some without time
    at = F.when(F.col("id") % 3 == 0, 7000).when(F.col("id") % 10 != 1, F.col("id") % 50 * 360)
    rows = spark.range(1000).select("id", F.timestamp_seconds(F.lit(T0) + at).cast(kind).alias("ts"))
    order = [("ts", way), ("id", "asc")]
    ordered = rows.orderBy(getattr(F.col("ts"), way)(), "id")
    want = [r["id"] for r in ordered.collect()][offset : offset + n]
    for limit in (150, 0):
        got = slice_sorted(rows, order, offset, n, topk_rows=limit)
        assert [r["id"] for r in got.collect()] == want


def test_deep_pages_by_another_field(spark):
    rows = spark.range(500).selectExpr("id", "concat('n', id % 7) AS name")
    want = [r["id"] for r in rows.orderBy("name", "id").collect()]
    got = slice_sorted(rows, [("name", "asc"), ("id", "asc")], 100, 250, topk_rows=0).collect()
    assert [r["id"] for r in got] == want[100:350]


@pytest.mark.parametrize("way", ["asc", "desc", "asc_nulls_last", "desc_nulls_first"])
def test_deep_pages_of_many_rows_and_few_values(spark, way, monkeypatch):
    """Sampled bounds, rows that agree in all order columns, nulls, and no row for each value."""
    from watchpost.plans import layout

    monkeypatch.setattr(layout, "SAMPLE", 400)
    rows = spark.range(9000).selectExpr(
        "id", "IF(id % 11 = 0, NULL, concat('n', id % 900)) AS name", "id % 3 AS kind", "repeat('x', 20) AS wide")
    for order in ([("name", way), ("id", "desc")], [("name", way)], [("kind", "asc"), ("name", way)]):
        by = [getattr(F.col(c), w)() for c, w in order]
        want = [tuple(r) for r in rows.orderBy(*by).select(*[c for c, _ in order]).collect()]
        for offset, n in ((4000, 300), (8990, 50), (100, 8800), (9000, 5), (2995, 10)):
            got = slice_sorted(rows, order, offset, n, topk_rows=0).collect()
            assert [tuple(r[c] for c, _ in order) for r in got] == want[offset : offset + n]
            assert len({r["id"] for r in got}) == len(got)


def test_a_deep_page_writes_its_order_columns_only(spark):
    from watchpost.plans import layout

    written = []
    real = layout.range_blocks
    rows = spark.range(500).selectExpr("id", "concat('n', id % 7) AS name", "repeat('x', 99) AS wide")
    layout.range_blocks = lambda df, *a, **k: written.append(df.columns) or real(df, *a, **k)
    try:
        got = slice_sorted(rows, [("name", "asc"), ("id", "asc")], 100, 250, topk_rows=0)
    finally:
        layout.range_blocks = real
    assert written == [["name", "id"]] and got.columns == ["id", "name", "wide"] and got.count() == 250


@pytest.mark.parametrize("way", ["asc", "desc", "asc_nulls_last", "desc_nulls_first"])
def test_cursors_read_everything_once(spark, way, tmp_path):
    rows = spark.range(300).selectExpr("id", "IF(id % 7 = 0, NULL, timestamp_seconds(id % 40)) AS ts")
    rows.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    order = [("ts", way), ("id", "asc")]
    want = [r["id"] for r in table.orderBy(getattr(F.col("ts"), way)(), "id").collect()]
    got, last = [], None
    while True:
        page = paging.after_cursor(table, order, last, 64).collect()
        if not page:
            break
        got += [r["id"] for r in page]
        last = (page[-1]["ts"], page[-1]["id"])
    assert got == want
    with pytest.raises(ValueError):
        paging.after_cursor(table, order, [1], 5)
    top = table.agg(F.max("ts")).first()[0]
    plan = paging.after_cursor(table, [("ts", "desc"), ("id", "asc")], (top, 5), 5)._jdf.queryExecution()
    assert "LessThanOrEqual(ts" in plan.executedPlan().toString()


def test_latest_and_spans(rows):
    got = [(r["ts"], r["id"]) for r in paging.latest(rows, 20).collect()]
    assert got == sorted(((r["ts"], r["id"]) for r in rows.collect()), reverse=True)[:20]
    up = paging.spans_page(rows, 7, "timestamp", ["id"]).collect()
    assert [(r["ts"], r["id"]) for r in up] == sorted((r["ts"], r["id"]) for r in rows.collect())[:7]
    assert paging.page_count(paging.latest(rows, 20)).first()["count"] == 20
    assert paging.page_count(paging.latest(rows.filter("false"))).first()["count"] == 0
    with pytest.raises(ValueError):
        paging.spans_page(rows, sort="ts")


def test_top_k_plan(rows):
    plan = paging.latest(rows)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_incidents_page_bounds(rows):
    df = rows.withColumnRenamed("ts", "created")
    assert paging.incidents_page(df).count() == 10
    a = [r["id"] for r in paging.incidents_page(df, 20).collect()]
    b = [r["id"] for r in paging.incidents_page(df, 10, 10).collect()]
    assert a[10:] == b
    for bad in (dict(size=0), dict(size=101), dict(offset=-1), dict(size=1.5)):
        with pytest.raises(ValueError):
            paging.incidents_page(df, **bad)


def test_hosts_page(spark):
    df = spark.createDataFrame(
        [(1, "b", None), (2, "a", 5), (3, None, 5), (4, "c", 1)], "id long, name string, v int"
    )
    page = lambda *a: [r["id"] for r in paging.hosts_page(df, *a).collect()]
    assert page() == [2, 1, 4, 3]
    assert page("v", "desc") == [2, 3, 4, 1]
    assert page("v", "asc", 1, 2) == [2, 3]
    for bad in (("nope",), ("v", "up"), ("v", "asc", 0, 1001)):
        with pytest.raises(ValueError):
            page(*bad)


def test_all_services(spark):
    df = spark.createDataFrame(
        [(1, 1, "old"), (2, 2, "b"), (3, 3, None), (4, 4, ""), (5, 5, "a"), (6, 6, "b")],
        "id long, s long, service string",
    ).withColumn("ts", F.timestamp_seconds("s"))
    names = lambda *a, **k: [r["service"] for r in aggregates.all_services(df, *a, **k).collect()]
    assert names() == ["a", "b", "old"]
    assert names(5) == ["a", "b"]
    assert names(5, topk_rows=0) == ["a", "b"]
    assert names(1) == ["b"]


def test_active_hosts(spark):
    df = spark.createDataFrame(
        [(T0, True), (T0 - 7200, False), (T0 - 7201, True), (None, True)], "s long, up boolean"
    ).withColumn("last_reported", F.timestamp_seconds("s"))
    assert aggregates.active_hosts(df, T0).first().asDict() == {"total_active": 2, "total_up": 1}
    none = aggregates.active_hosts(df.filter("false"), T0).first()
    assert (none["total_active"], none["total_up"]) == (0, 0)


def test_next_values_over_blocks(spark):
    import random

    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.choice([None, None, i])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, pos long, v long")
    got = next_values(df, ["k"], ["pos"], {"nxt": "v"}, blocks=9).collect()
    for r in got:
        later = [v for k, p, v in data if k == r["k"] and p > r["pos"] and v is not None]
        assert r["nxt"] == (later[0] if later else None)


def test_ndjson(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, t string").withColumn(
        "at", F.timestamp_seconds(F.lit(T0))
    )
    lines = sorted(r["value"] for r in ndjson_lines(df).collect())
    assert json.loads(lines[0]) == {"id": 1, "at": "2024-01-01T00:00:00.000Z"}
    write_ndjson(df, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == lines
