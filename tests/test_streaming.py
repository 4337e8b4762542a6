import glob
import random

import pytest
from pyspark.sql import functions as F

from test_metrics_monitors import RULES, RULE_DDL, make_points
from test_mutes import DDL, brute, log
from watchpost.operators.metrics import query_metric
from watchpost.operators.monitors import evaluate_monitors_over
from watchpost.streaming.metrics import stream_metric
from watchpost.streaming.monitors import stream_monitors
from watchpost.streaming import mutes
from watchpost.streaming.mutes import read_mute_state, stream_mutes

T0 = 1_704_067_200
POINTS = "metric string, ts timestamp, value double, tags array<string>"


def run(df, folder):
    q = (
        df.writeStream.format("parquet").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    )
    assert q.awaitTermination(300)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Points in order of time over several files, taken one file at a time."""
    raw = sorted(make_points(900, 21), key=lambda p: p[1])
    folder = tmp_path_factory.mktemp("points")
    for i in range(3):
        part = spark.createDataFrame(
            raw[i * 300 : (i + 1) * 300], "metric string, us long, value double, tags array<string>"
        ).select("metric", F.timestamp_micros("us").alias("ts"), "value", "tags")
        part.coalesce(1).write.parquet(str(folder / f"p{i}"))
    return str(folder)


def stream(spark, files):
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(f"{files}/p*")


def rows(df, *cols):
    return {tuple(r[c] for c in cols): pytest.approx(r["value"]) for r in df.collect()}


def test_metric_stream_equals_batch_for_closed_steps(spark, files, tmp_path):
    got = run(stream_metric(stream(spark, files), "cpu", 300, ["host"], "avg", "5 minutes"), str(tmp_path))
    points = spark.read.schema(POINTS).parquet(f"{files}/p*")
    batch = query_metric(points, "cpu", T0, T0 + 7200, "avg", None, ["host"], 300)
    mark = points.filter("metric = 'cpu'").agg(F.max("ts") - F.expr("interval 5 minutes")).first()[0]
    closed = batch.filter(F.col("ts") + F.expr("interval 300 seconds") <= F.lit(mark))
    assert closed.count() > 50
    assert rows(got, "scope", "ts") == rows(closed, "scope", "ts")


def test_monitor_stream_equals_batch_for_all_rules(spark, files, tmp_path):
    """Every lookback, silent steps and silent rules, over three micro-batches."""
    rules = spark.createDataFrame(RULES, RULE_DDL)
    got = run(stream_monitors(stream(spark, files), rules, 60, "5 minutes"), str(tmp_path))
    points = spark.read.schema(POINTS).parquet(f"{files}/p*")
    low, mark = points.agg(
        F.unix_timestamp(F.min("ts")), F.unix_timestamp(F.max("ts") - F.expr("interval 5 minutes"))
    ).first()
    low, high = low // 60 * 60, mark // 60 * 60
    # groups of the whole range, which the stream knows from their first step on
    batch = evaluate_monitors_over(points, rules, low, high, 60).withColumn("s", F.unix_timestamp("ts"))
    want, first = {}, {}
    for r in batch.collect():
        want[r["rule_id"], r["group"], r["s"]] = (r["value"], r["state"])
        if r["value"] is not None:
            key = (r["rule_id"], r["group"])
            first[key] = min(first.get(key, r["s"]), r["s"])
    grouped = {r[0] for r in RULES if r[3]}
    want = {k: v for k, v in want.items() if k[2] >= first.get(k[:2], low) or (k[0] not in grouped)}
    for rule in grouped:
        begin = min((s for (r, _), s in first.items() if r == rule), default=None)
        for s in range(low, high if begin is None else begin, 60):
            want[rule, "*", s] = (None, "No Data")
    found = {
        (r["rule_id"], r["group"], r["s"]): (r["value"], r["state"])
        for r in got.withColumn("s", F.unix_timestamp("ts")).collect()
    }
    assert found.keys() == want.keys()
    assert {k: (v and pytest.approx(v), s) for k, (v, s) in want.items()} == found
    assert sum(s == "No Data" for _, s in found.values()) > 100


def test_closed_steps_are_not_broadcast(spark, files, tmp_path):
    """The last batch has no new file, so the estimated size of its rows says nothing."""
    spark.createDataFrame(RULES, RULE_DDL).write.parquet(f"{tmp_path}/rules")
    # of a known size, other than rows from Python
    rules = spark.read.parquet(f"{tmp_path}/rules")
    q = (
        stream_monitors(stream(spark, files), rules, 60, "5 minutes")
        .writeStream.format("parquet").option("path", f"{tmp_path}/rows")
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    )
    assert q.awaitTermination(300)
    assert q.lastProgress.numInputRows == 0
    plan = q._jsq.explainInternal(False).splitlines()
    assert any("StateStoreSave" in line for line in plan)

    def depth(line):
        return len(line) - len(line.lstrip(" :+-"))

    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = []
            for other in plan[i + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            assert not any("StateStore" in other for other in below)


def test_a_silent_group_is_reported_until_it_speaks_again(spark, tmp_path):
    rule = [(1, "cpu", ["*"], ["host"], "avg", "avg", 120, ">", 1.0)]
    sent = [[(0, "a"), (0, "b")], [(600, "b")], [(1200, "a"), (1500, "b")]]
    for i, part in enumerate(sent):
        spark.createDataFrame(
            [("cpu" if h != "x" else "other", T0 + t, 2.0, [f"host:{h}"]) for t, h in part],
            "metric string, t long, value double, tags array<string>",
        ).select("metric", F.timestamp_seconds("t").alias("ts"), "value", "tags").coalesce(1).write.parquet(
            str(tmp_path / "in" / f"p{i}"))
    rules = spark.createDataFrame(rule, RULE_DDL)
    rows_ = run(stream_monitors(stream(spark, str(tmp_path / "in")), rules, 60, "0 seconds"), str(tmp_path)).collect()
    states = {}
    for r in sorted(rows_, key=lambda r: r["ts"]):
        states.setdefault(r["group"], []).append(r["state"])
    assert states["host:a"] == ["Alert"] * 2 + ["No Data"] * 18 + ["Alert"] * 2 + ["No Data"] * 3
    assert states["host:b"] == ["Alert"] * 2 + ["No Data"] * 8 + ["Alert"] * 2 + ["No Data"] * 13
    assert "*" not in states


def test_mute_stream_over_batches(spark, tmp_path):
    data = log(31, n=240)
    # arrive out of order, but never more than the delay behind
    rng = random.Random(1)
    arrival = sorted(data, key=lambda r: r[1] + rng.random() * 30)
    (tmp_path / "in").mkdir()
    for i in range(4):
        spark.createDataFrame(arrival[i * 60 : (i + 1) * 60], DDL).select(
            "host", F.timestamp_seconds("t").alias("ts"), "seq", "action",
            F.timestamp_seconds("e").alias("mute_end"), "override", "message",
        ).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "p0")).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p*"))
    state = str(tmp_path / "state")
    q = stream_mutes(source, state, str(tmp_path / "cp"), 60, {"availableNow": True})
    assert q.awaitTermination(300)
    got = read_mute_state(spark, state, 3, T0 + 600).withColumn("e", F.unix_timestamp("mute_end")).collect()
    assert {r["host"]: (r["muted"], r["e"], r["message"], r["commands"], r["rejected"]) for r in got} == brute(
        data, T0 + 600
    )
    late = sum(spark.read.parquet(f"{state}/{i}/late").count() for i in range(4))
    assert late == 0


def test_late_mute_commands_are_kept_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, (t, action) in enumerate([(T0 + 1000, "mute"), (T0, "mute"), (T0 + 2000, "unmute")]):
        spark.createDataFrame([("h", t, i, action, None, False, "x")], DDL).select(
            "host", F.timestamp_seconds("t").alias("ts"), "seq", "action",
            F.timestamp_seconds("e").alias("mute_end"), "override", "message",
        ).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "p0")).schema
    state = str(tmp_path / "state")
    for _ in range(2):  # started again with nothing new, it changes nothing
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
            "latestFirst", "false").parquet(str(tmp_path / "in" / "p*"))
        q = stream_mutes(source, state, str(tmp_path / "cp"), 60, {"availableNow": True})
        assert q.awaitTermination(300)
    got = read_mute_state(spark, state, 2, T0 + 3000).collect()
    assert [(r["host"], r["muted"], r["commands"], r["rejected"]) for r in got] == [("h", False, 2, 0)]
    assert spark.read.parquet(f"{state}/1/late").count() == 1


def test_a_command_of_the_far_future_holds_up_no_one(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [
        [("far", 4_070_908_800, 0, "mute"), ("h", T0, 1, "mute")],
        [("h", T0 + 500, 2, "unmute")],
        [("h", T0 + 900, 3, "mute")],
    ]
    for i, rows_ in enumerate(batches):
        spark.createDataFrame([(*r, None, False, "x") for r in rows_], DDL).select(
            "host", F.timestamp_seconds("t").alias("ts"), "seq", "action",
            F.timestamp_seconds("e").alias("mute_end"), "override", "message",
        ).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "p0")).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in" / "p*"))
    state = str(tmp_path / "state")
    q = stream_mutes(source, state, str(tmp_path / "cp"), 60, {"availableNow": True})
    assert q.awaitTermination(300)
    got = read_mute_state(spark, state, 2, T0 + 3000).collect()
    assert [(r["host"], r["muted"], r["commands"], r["rejected"]) for r in got] == [("h", True, 3, 0)]
    assert sum(spark.read.parquet(f"{state}/{i}/late").count() for i in range(3)) == 0


def mute_batches(spark, parts):
    return [
        spark.createDataFrame(p, DDL).select(
            "host", F.timestamp_seconds("t").alias("ts"), "seq", "action",
            F.timestamp_seconds("e").alias("mute_end"), "override", "message",
        )
        for p in parts
    ]


def stored(spark, state):
    """All rows below a state folder by their place, without the files' own names."""
    out = {}
    for folder in glob.glob(f"{state}/*/*") + glob.glob(f"{state}/*/state/bucket=*"):
        if not folder.endswith("state"):
            out[folder.removeprefix(state)] = sorted(map(repr, spark.read.parquet(folder).collect()))
    return out


def test_a_repeated_batch_writes_the_same_rows_at_another_time(spark, tmp_path, monkeypatch):
    data = sorted(log(7, n=160), key=lambda r: r[1])
    # one command of the far future: the wall clock decides whether it counts
    data[30] = ("far", T0 + 10**7, 999, "mute", None, False, "x")
    batches, state = mute_batches(spark, [data[k * 40 : k * 40 + 40] for k in range(4)]), str(tmp_path)
    for n, batch in enumerate(batches):
        monkeypatch.setattr(mutes.time, "time", lambda: T0 + 10**6)
        mutes._apply(batch, n, state, 60, None, 8)
        before = stored(spark, state)
        monkeypatch.setattr(mutes.time, "time", lambda: T0 + 10**8)
        mutes._apply(batch, n, state, 60, None, 8)
        assert stored(spark, state) == before
    got = read_mute_state(spark, state, 3, T0 + 700).withColumn("e", F.unix_timestamp("mute_end")).collect()
    assert {r["host"]: (r["muted"], r["e"], r["message"], r["commands"], r["rejected"]) for r in got} == brute(
        [r for r in data if r[0] != "far"], T0 + 700)


def test_only_touched_buckets_are_written_and_old_ones_go(spark, tmp_path):
    state = str(tmp_path)
    first = [(f"h{k}", T0 + k, k, "mute", None, False, "m") for k in range(60)]
    parts = [first + [("h0", T0 + 1000, 100, "unmute", None, False, "")]]
    parts += [[("h1", T0 + 2000 + 1000 * n, 200 + n, "unmute" if n % 2 == 0 else "mute", None, False, "again")] for n in range(4)]
    for n, batch in enumerate(mute_batches(spark, parts)):
        mutes._apply(batch, n, state, 60, T0 + 10**6, 16)
    buckets = lambda n: {f.rsplit("=")[-1] for f in glob.glob(f"{state}/{n}/state/bucket=*")}
    # the first batch's buckets of all others live on, that of h1 was written in the last one
    assert len(buckets(0)) == 15 - (buckets(1) > set()) or len(buckets(0)) >= 13
    assert len(buckets(4)) == 1 and buckets(4).isdisjoint(buckets(0))
    assert buckets(2) == set() and not glob.glob(f"{state}/2/done") and glob.glob(f"{state}/2/late")
    got = {r["host"]: (r["muted"], r["commands"]) for r in read_mute_state(spark, state, 4, T0 + 9000).collect()}
    assert got["h0"] == (False, 2) and got["h1"] == (True, 5) and got["h59"] == (True, 1) and len(got) == 60
