"""Landed documents: the record shapes, and absent against empty."""

import json

import pytest
from pyspark.sql import functions as F

from watchpost.schemas import CANONICAL
from watchpost.sources.entities import read_entity

S = 1_640_995_199


def land(tmp_path, *docs, indent=None):
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=indent) + "\n")
    return str(tmp_path)


def test_logs(spark, tmp_path):
    path = land(
        tmp_path,
        {"data": [
            {"id": "a", "type": "log", "attributes": {"timestamp": S * 1000, "status": "info",
             "message": "m", "service": "web", "tags": ["env:test"]}},
            {"id": "b", "type": "log", "attributes": {"timestamp": S * 1000 + 5, "status": "error",
             "message": "n", "tags": []}},
        ], "meta": {"page": {"after": "x"}}},
        {"data": []},
    )
    df = read_entity(spark, "logs", path, "json")
    rows = df.withColumn("ms", F.unix_millis("ts")).orderBy("id").collect()
    assert [(r["id"], r["ms"], r["service"]) for r in rows] == [
        ("a", S * 1000, "web"), ("b", S * 1000 + 5, None)]


def test_spans(spark, tmp_path):
    path = land(
        tmp_path,
        {"data": [
            {"id": "s1", "attributes": {"service": "web", "name": "get", "trace_id": "t", "span_id": "9",
             "parent_id": "0", "start": S * 10**9 + 123_456_789, "duration": 5, "error": 1,
             "meta": {"http.status_code": "500"}}},
            {"id": "s2", "attributes": {"service": "web", "name": "get", "start": S * 10**9}},
        ]},
    )
    rows = read_entity(spark, "spans", path, "json").withColumn("us", F.unix_micros("ts")).orderBy("span_id").collect()
    assert rows[0]["span_id"] == "9" and rows[0]["us"] == S * 10**6 + 123_456
    assert rows[0]["meta"] == {"http.status_code": "500"} and rows[0]["operation"] == "get"
    assert rows[1]["span_id"] == "s2" and rows[1]["duration_ns"] is None


def test_metrics(spark, tmp_path):
    path = land(
        tmp_path,
        {"status": "ok", "series": [{"metric": "cpu", "pointlist": [[S * 1000, 1.5], [S * 1000 + 60000, 2]],
                                     "scope": "host:a,env:b"},
                                    {"metric": "cpu", "pointlist": [[S * 1000, 3]], "scope": "*"}]},
        {"status": "ok", "series": []},
    )
    rows = read_entity(spark, "metric_points", path, "json").orderBy("value").collect()
    assert [(r["value"], r["tags"]) for r in rows] == [
        (1.5, ["host:a", "env:b"]), (2.0, ["host:a", "env:b"]), (3.0, [])]
    bad = land_one(tmp_path, "bad", {"status": "error", "message": "Invalid query", "query": "q"})
    with pytest.raises(Exception, match="metric query failed: Invalid query"):
        read_entity(spark, "metric_points", bad, "json").collect()


def land_one(tmp_path, name, doc):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "d.json").write_text(json.dumps(doc) + "\n")
    return str(folder)


def test_monitors_bare_array(spark, tmp_path):
    path = land_one(tmp_path, "ok", [
        {"id": 1, "name": "m", "tags": ["a:b"], "overall_state": "Alert", "modified": "2022-01-01T00:00:00.5Z"},
        {"id": 2, "overall_state": "OK"},
    ])
    rows = read_entity(spark, "monitors", path, "json").orderBy("id").collect()
    assert str(rows[0]["modified"]) == "2022-01-01 00:00:00.500000" and rows[1]["name"] is None


def test_hosts_dashboards_downtimes(spark, tmp_path):
    hosts = read_entity(spark, "hosts", land_one(tmp_path, "h", {"host_list": [
        {"name": "web", "id": 1, "aliases": ["w"], "apps": ["n"], "is_muted": False, "last_reported_time": S,
         "meta": {"platform": "linux"}, "metrics": {"load": 0.5}, "sources": ["agent"], "up": True}],
        "total_matching": 1}), "json")
    h = hosts.withColumn("s", F.unix_timestamp("last_reported")).first()
    assert h["s"] == S and h["meta"]["platform"] == "linux" and h["metrics"]["load"] == 0.5
    boards = read_entity(spark, "dashboards", land_one(tmp_path, "b", {"dashboards": [{"id": "x", "title": "t"}]}), "json")
    assert boards.first()["description"] is None
    down = read_entity(spark, "downtimes", land_one(tmp_path, "d", [
        {"id": 5, "active": True, "disabled": False, "start": S, "end": None, "scope": ["host:a"],
         "monitor_id": None, "monitor_tags": ["env:test"], "timezone": "UTC",
         "recurrence": {"type": "weeks", "period": 1, "week_days": ["Mon"]}}]), "json")
    d = down.first()
    assert d["ts_end"] is None and d["recurrence"]["week_days"] == ["Mon"]


def test_incidents_and_one_incident(spark, tmp_path):
    rec = {"id": "i1", "type": "incidents", "attributes": {
        "title": "t", "created": "2022-01-01T00:00:00Z", "status": "active", "severity": "SEV-1",
        "customer_impacted": True, "fields": {"summary": "s", "services": ["web"]},
        "timeline": {"entries": [{"timestamp": "2022-01-01T00:01:00Z", "content": "c", "type": "x"}]}},
        "relationships": {"created_by": {"data": {"id": "u", "type": "users"}}}}
    many = read_entity(spark, "incidents", land_one(tmp_path, "many", {"data": [rec]}), "json").collect()
    one = read_entity(spark, "incident", land_one(tmp_path, "one", {"data": rec}), "json").collect()
    assert many == one and one[0]["created_by"] == "u" and one[0]["commander"] is None
    assert str(one[0]["timeline"][0]["ts"]) == "2022-01-01 00:01:00"
    with pytest.raises(Exception, match="the document has no incident"):
        read_entity(spark, "incident", land_one(tmp_path, "none", {"data": None}), "json").collect()


@pytest.mark.parametrize("kind,key,message", [
    ("logs", "data", "the document has no logs"), ("spans", "data", "the document has no spans"),
    ("incidents", "data", "the document has no incidents"), ("hosts", "host_list", "the document has no hosts"),
    ("dashboards", "dashboards", "the document has no dashboards"), ("monitors", None, "the document has no monitors"),
])
def test_absent_is_an_error_and_empty_is_not(spark, tmp_path, kind, key, message):
    docs = [None] if key is None else [{key: None}, {"meta": {}}]
    for i, doc in enumerate(docs):
        with pytest.raises(Exception, match=message):
            read_entity(spark, kind, land_one(tmp_path, f"{i}", doc), "json").collect()
    empty = [] if key is None else {key: []}
    assert read_entity(spark, kind, land_one(tmp_path, "empty", empty), "json").count() == 0


def test_absent_downtimes_and_series_are_empty(spark, tmp_path):
    assert read_entity(spark, "downtimes", land_one(tmp_path, "a", None), "json").count() == 0
    assert read_entity(spark, "metric_points", land_one(tmp_path, "b", {"status": "ok"}), "json").count() == 0


def test_whole_files_and_parquet_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = land(tmp_path / "in", {"dashboards": [{"id": "x", "title": "t"}, {"id": "y"}]}, indent=2)
    df = read_entity(spark, "dashboards", path, "json", whole_files=True)
    assert sorted(r["id"] for r in df.collect()) == ["x", "y"]
    df.write.parquet(str(tmp_path / "out"))
    back = read_entity(spark, "dashboards", str(tmp_path / "out"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_landed_kinds_have_their_canonical_columns(spark, tmp_path):
    for kind in ("logs", "spans", "metric_points", "monitors", "hosts", "dashboards", "incidents", "downtimes"):
        doc = [] if kind in ("monitors", "downtimes") else {
            {"hosts": "host_list", "dashboards": "dashboards", "metric_points": "series"}.get(kind, "data"): []}
        df = read_entity(spark, kind, land_one(tmp_path, kind, doc), "json")
        want = spark.createDataFrame([], CANONICAL[kind])
        assert dict(df.dtypes) == dict(want.dtypes), kind


def test_arguments(spark, tmp_path):
    with pytest.raises(ValueError):
        read_entity(spark, "widgets", str(tmp_path), "json")
    with pytest.raises(ValueError):
        read_entity(spark, "logs", str(tmp_path), "csv")


def test_date_partitioned_table_is_pruned(spark, tmp_path):
    from watchpost.operators.filters import time_range

    rows = spark.range(4).selectExpr(
        "concat('l', id) AS id", f"timestamp_seconds({S} + id * 86400) AS ts", "'info' AS status",
        "'m' AS message", "'web' AS service", "'h' AS host", "array('a:b') AS tags",
    )
    path = str(tmp_path / "logs")
    rows.withColumn("dt", F.col("ts").cast("date")).write.partitionBy("dt").parquet(path)
    logs = read_entity(spark, "logs", path)
    assert dict(logs.dtypes)["dt"] == "date"
    found = time_range(logs, S + 86400, S + 86401, day_col="dt")
    assert [r["id"] for r in found.collect()] == ["l1"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "GreaterThanOrEqual(ts" in plan


@pytest.mark.parametrize("kind", ["logs", "downtimes", "metric_points", "monitors", "incident"])
def test_malformed_documents_raise_for_every_kind(spark, tmp_path, kind):
    path = tmp_path / "broken"
    path.write_text('{"series": [{"metric": "cpu", ')
    with pytest.raises(Exception, match="malformed document"):
        read_entity(spark, kind, str(path), "json").collect()


def test_fractions_of_a_time_are_kept(spark, tmp_path):
    down = read_entity(spark, "downtimes", land_one(tmp_path, "d", [
        {"id": 5, "start": 1893456000.5, "end": 1893456001, "scope": ["host:a"]}]), "json").first()
    assert str(down["ts_start"]) == "2030-01-01 00:00:00.500000"
    logs = read_entity(spark, "logs", land_one(tmp_path, "l", {"data": [
        {"id": "a", "attributes": {"timestamp": 1704067200000.5}}]}), "json").first()
    assert str(logs["ts"]) == "2024-01-01 00:00:00.000500"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_written_times_are_utc_in_any_session(spark, zone):
    from watchpost.functions.times import from_ts
    from watchpost.sources.entities import ndjson_lines

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.range(1).selectExpr(
            f"timestamp_seconds({S}) AS ts", "timestamp_ntz'2022-01-01 00:00:00.25' AS wall"
        )
        units = [from_ts(c, u).alias(f"{c}_{u}") for c in ("ts", "wall") for u in ("s", "ms", "us", "iso")]
        got = df.select(*units).first()
        stamp = spark.sql(f"SELECT unix_micros(timestamp_seconds({S})) AS m").first()["m"]
        assert list(got[:3]) == [S, S * 1000, stamp]
        assert got["ts_iso"].endswith("Z") and got["wall_iso"] == "2022-01-01T00:00:00.250Z"
        assert got["wall_ms"] == 1640995200250 and got["wall_s"] == 1640995200
        line = ndjson_lines(df.select("ts")).first()["value"]
        assert got["ts_iso"] in line
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def landed(spark, tmp_path, kind, doc):
    from watchpost.sources.entities import land_entity

    path = land_one(tmp_path, kind, doc)
    rows, rejects = land_entity(spark, kind, path)
    return path, rows.collect(), sorted((r["field"], r["reason"]) for r in rejects.collect())


UNREADABLE = [
    ("downtimes", [{"id": 1, "start": "soon", "scope": ["host:a"]}], [("start", "not decimal(20,6)")]),
    ("downtimes", [{"id": 1, "scope": "host:a"}], [("scope", "not a list of texts")]),
    ("downtimes", [{"id": 1, "scope": [{"host": "a"}]}], [("scope", "not a list of texts")]),
    ("downtimes", {"errors": ["forbidden"]}, [("$", "not a list of records")]),
    ("downtimes", [{"id": 1, "recurrence": {"period": 1.5, "week_days": 3}}], [
        ("recurrence.period", "not int"), ("recurrence.week_days", "not a list of texts")]),
    ("downtimes", ["x"], [("$", "not an object")]),
    ("logs", {"data": [{"id": "a", "attributes": {"timestamp": "x1"}}]}, [("attributes.timestamp", "not decimal(20,6)")]),
    ("logs", {"data": [{"id": "a", "attributes": "none"}]}, [("attributes", "not an object")]),
    ("logs", {"data": "none"}, [("$", "not a list of records")]),
    ("logs", [1], [("$", "the document has no logs")]),
    ("monitors", [{"id": "abc"}, {"id": 2.5}, {"id": True}], [("id", "not bigint")] * 3),
    ("monitors", [{"id": 1, "created": "yesterday"}], [("created", "not a time")]),
    ("hosts", {"host_list": [{"id": 1, "up": "yes", "metrics": {"load": "high"}}]}, [
        ("metrics", "not map<string,double>"), ("up", "not boolean")]),
    ("spans", {"data": [{"id": "s", "attributes": {"start": 1.5e18, "duration": "long", "meta": [1]}}]}, [
        ("attributes.duration", "not bigint"), ("attributes.meta", "not map<string,string>")]),
    ("dashboards", {"dashboards": [{"id": "x", "title": ["t"]}]}, [("title", "not string")]),
    ("incidents", {"data": [{"id": "i", "attributes": {"created": "soon", "timeline": {"entries": [
        {"timestamp": "2022-01-01T00:01:00Z"}, {"timestamp": "later"}]}}}]}, [
        ("attributes.created", "not a time"), ("attributes.timeline.entries[].timestamp", "not a time")]),
    ("metric_points", {"status": "ok", "series": [{"metric": "cpu", "scope": ["a"], "pointlist": [[S, 1]]}]}, [
        ("scope", "not string")]),
    ("metric_points", {"status": "error", "message": "Invalid query"}, [("$", "metric query failed: Invalid query")]),
]


@pytest.mark.parametrize("kind,doc,want", UNREADABLE)
def test_unreadable_values_are_rejects_or_raise(spark, tmp_path, kind, doc, want):
    path, rows, rejects = landed(spark, tmp_path, kind, doc)
    assert rows == [] and rejects == want
    with pytest.raises(Exception, match="unreadable|not a list|not an object|has no|failed"):
        read_entity(spark, kind, path, "json").select(F.lit(1)).collect()


def test_a_bad_point_costs_no_other(spark, tmp_path):
    doc = {"status": "ok", "series": [
        {"metric": "cpu", "scope": "host:a", "pointlist": [[S * 1000, 1.5], ["x", 2], [S * 1000, "high"], [S * 1000], [None, 1],
                                                           [S * 1000 + 1, None]],
         "display_name": "cpu", "expression": "avg:cpu{*}", "unit": [{"family": "percentage", "scale_factor": 1}, None]}]}
    _, rows, rejects = landed(spark, tmp_path, "metric_points", doc)
    assert [(r["value"], r["tags"], r["display_name"], r["expression"]) for r in rows] == [
        (1.5, ["host:a"], "cpu", "avg:cpu{*}"), (None, ["host:a"], "cpu", "avg:cpu{*}")]
    assert rows[0]["unit"][0]["family"] == "percentage" and rows[0]["unit"][1] is None
    assert rejects == [(f"pointlist[{i}]", "not a time and a number") for i in (1, 2, 3, 4)]


def test_rejects_name_their_file_and_record(spark, tmp_path):
    from watchpost.sources.entities import land_entity

    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "one.json").write_text('[{"id": 1, "scope": ["a:b"], "created": 1640995000, "creator_id": 7, "updated_at": 1640995010}]\n')
    (folder / "two.json").write_text('[{"id": "x"}, {"id": 2}]\n{"broken": \n')
    rows, rejects = land_entity(spark, "downtimes", str(folder))
    got = {r["id"]: r for r in rows.withColumn("c", F.unix_timestamp("created")).collect()}
    assert set(got) == {1, 2} and got[1]["c"] == 1640995000 and got[1]["creator_id"] == 7
    found = sorted((r["file"].rsplit("/")[-1], r["text"], r["field"], r["reason"]) for r in rejects.collect())
    assert found == [
        ("two.json", '{"broken": ', "$", 'malformed document: {"broken": '),
        ("two.json", '{"id":"x"}', "id", "not bigint"),
    ]


def test_a_record_cast_whole_is_the_record_taken_field_by_field(spark, tmp_path):
    """A record without attributes sends its document the careful way: all come out the same."""
    fine = [
        {"id": "a", "attributes": {"service": "web", "trace_id": 7, "start": S * 10**9 + 1, "duration": "12",
         "error": 0, "meta": {"n": 1, "o": {"k": [1]}}}},
        {"id": "b", "attributes": {"service": None, "name": True, "resource": 1.50, "start": 999, "meta": None}},
        {"id": "c"},
        {"id": "d", "attributes": {"start": 1.0, "duration": -(2**63), "error": "3", "extra": [1]}},
    ]
    alone = [land_one(tmp_path, f"s{i}", {"data": [r]}) for i, r in enumerate(fine)]
    mixed = land_one(tmp_path, "mixed", {"data": fine})
    by_id = lambda *paths: {
        r["span_id"]: r for p in paths for r in read_entity(spark, "spans", p, "json").collect()
    }
    one, many = by_id(*alone), by_id(mixed)
    assert one == many
    assert one["a"]["meta"] == {"n": "1", "o": '{"k":[1]}'} and one["a"]["duration_ns"] == 12
    assert one["b"]["operation"] == "true" and one["d"]["error"] == 3 and one["d"]["duration_ns"] == -(2**63)


@pytest.mark.parametrize(
    "kind, doc, field",
    [
        ("spans", {"data": [{"id": "a", "attributes": {"start": 1.5}}]}, "attributes.start"),
        ("spans", {"data": [{"id": "a", "attributes": {"start": True}}]}, "attributes.start"),
        ("spans", {"data": [{"id": "a", "attributes": {"error": 2**31}}]}, "attributes.error"),
        ("spans", {"data": [{"id": ["a"]}]}, "id"),
        ("spans", {"data": [{"id": "a", "attributes": "none"}]}, "attributes"),
        ("spans", {"data": [{"id": "a", "attributes": {"meta": [1]}}]}, "attributes.meta"),
        ("logs", {"data": [{"id": "a", "attributes": {"tags": [["x"]]}}]}, "attributes.tags"),
        ("logs", {"data": [{"id": "a", "attributes": {"timestamp": "soon"}}]}, "attributes.timestamp"),
        ("hosts", {"host_list": [{"id": 1, "is_muted": "true"}]}, "is_muted"),
        ("hosts", {"host_list": [{"id": 1, "metrics": {"load": False}}]}, "metrics"),
        ("metric_points", {"series": [{"metric": "m", "pointlist": [[1, True]]}]}, "pointlist[0]"),
        ("metric_points", {"series": [{"metric": "m", "pointlist": [[1, 2], [None, 2]]}]}, "pointlist[1]"),
        ("metric_points", {"series": [{"metric": "m", "pointlist": [[1]]}]}, "pointlist[0]"),
        ("monitors", [{"id": 1, "created": "yesterday"}], "created"),
        ("incidents", {"data": [{"attributes": {"timeline": {"entries": [{"timestamp": "x"}]}}}]},
         "attributes.timeline.entries[].timestamp"),
    ],
)
def test_no_problem_hides_behind_a_whole_cast(spark, tmp_path, kind, doc, field):
    _, _, rejects = landed(spark, tmp_path, kind, doc)
    assert [f for f, _ in rejects] == [field]


def test_a_record_does_not_carry_its_document(spark, tmp_path):
    """Records of one long document, each with the whole of it, would be gigabytes here."""
    from watchpost.sources import landing

    path = land_one(tmp_path, "long", {"series": [{"metric": "m", "pointlist": [[1, 2]]}] * 50})
    plan = landing.parsed(landing.documents(spark, path, False), "metric_points")
    lines = plan._jdf.queryExecution().analyzed().toString().split("\n")
    parse = [x for x in lines if "try_parse_json" in x]
    assert len(parse) == 1 and "left(value" in parse[0] and plan.count() == 50


@pytest.mark.parametrize("pass_bytes", [1 << 30, 60_000])
def test_landed_documents_take_little_disk(spark, tmp_path, monkeypatch, pass_bytes):
    """They are compressed, in files of a few documents each, and only a pass is in shuffle files."""
    from watchpost import catalogue

    monkeypatch.setattr(catalogue, "scratch_path", lambda spark, label: str(tmp_path / label))
    monkeypatch.setattr(catalogue, "FILE_DOCUMENTS", 20)
    monkeypatch.setattr(catalogue, "PASS_BYTES", pass_bytes)
    records = spark.range(0, 20_000, 1, 2).select(
        "id", F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.struct(
            (F.col("id") * 1000).alias("timestamp"), F.lit("a message of some length").alias("message"),
        ).alias("attributes"))).alias("record"),
    )
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    path = catalogue._land(records, "id div 100", "landed-some", "data")
    assert spark.conf.get(key) == before
    files = list((tmp_path / "landed-some").glob("part-*"))
    plain = records.agg(F.sum(F.length("record"))).first()[0]
    assert len(files) >= 10 and sum(f.stat().st_size for f in files) < plain / 4
    read = read_entity(spark, "logs", path, "json")
    assert sorted(int(r["id"]) for r in read.select("id").collect()) == list(range(20_000))
