import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from watchpost.operators.metrics import query_metric, to_pointlist
from watchpost.operators.monitors import evaluate_monitors, evaluate_monitors_over

T0 = 1_704_067_200
AGG = {
    "avg": lambda v: sum(v) / len(v),
    "sum": sum,
    "min": min,
    "max": max,
    "count": len,
}


def make_points(n=600, seed=3, span=7200):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        host = "h0" if rng.random() < 0.4 else f"h{rng.randrange(4)}"
        tags = [f"host:{host}", f"env:{'prod' if host in ('h0', 'h1') else 'dev'}"]
        rng.shuffle(tags)
        out.append(
            (rng.choice(["cpu", "mem"]), T0 * 10**6 + rng.randrange(span * 10**6),
             rng.randrange(10000) / 100, tags)
        )
    return out


@pytest.fixture(scope="module")
def raw():
    return make_points()


@pytest.fixture(scope="module", params=["timestamp", "timestamp_ntz"])
def points(spark, raw, request):
    df = spark.createDataFrame(raw, "metric string, us long, value double, tags array<string>")
    return df.select("metric", F.timestamp_micros("us").cast(request.param).alias("ts"), "value", "tags")


def label(tags, by):
    return ",".join(
        f"{k}:{next((t[len(k) + 1:] for t in sorted(tags) if t.startswith(k + ':')), 'N/A')}" for k in by
    ) or "*"


def brute_steps(raw, metric, scope, by, agg, step_of):
    sets = defaultdict(list)
    for m, us, v, tags in raw:
        step = step_of(us)
        if m == metric and step is not None and all(s in tags for s in scope):
            sets[step, tuple(sorted(set(tags)))].append(v)
    cells = defaultdict(list)
    for (step, tags), vs in sets.items():
        cells[step, label(tags, by)].append(AGG["avg"](vs))
    return {k: AGG[agg](v) for k, v in cells.items()}


@pytest.mark.parametrize("agg", list(AGG))
@pytest.mark.parametrize("by", [[], ["host"], ["env", "zone"]])
def test_query_metric(points, raw, agg, by):
    lo, hi = T0 + 600, T0 + 5000
    got = query_metric(points, "cpu", lo, hi, agg, {"env": "prod"}, by, 300)
    rows = got.select("scope", F.unix_timestamp("ts").alias("s"), "value").collect()

    def step_of(us):
        return us // 10**6 // 300 * 300 if lo * 10**6 <= us < hi * 10**6 else None

    want = brute_steps(raw, "cpu", ["env:prod"], by, agg, step_of)
    assert {(r["s"], r["scope"]): pytest.approx(r["value"]) for r in rows} == want


def test_query_metric_checks(points):
    assert query_metric(points, "nope", T0, T0 + 99).count() == 0
    for bad in (dict(agg="p99"), dict(step_s=0)):
        with pytest.raises(ValueError):
            query_metric(points, "cpu", T0, T0 + 99, **bad)


def test_pointlist(points):
    series = query_metric(points, "cpu", T0, T0 + 7200, "avg", None, ["host"], 60).cache()
    lists = to_pointlist(series, T0, 60, max_points=50).collect()
    flat = sorted((r["scope"], p["ts"], p["value"]) for r in lists for p in r["pointlist"])
    assert flat == sorted((r["scope"], r["ts"], r["value"]) for r in series.collect())
    assert max(len(r["pointlist"]) for r in lists) <= 50
    for r in lists:
        assert [p["ts"] for p in r["pointlist"]] == sorted(p["ts"] for p in r["pointlist"])
    whole = to_pointlist(series, T0, 60)
    assert whole.count() == 4 and whole.filter("part = 0").count() == 4


RULES = [
    (1, "cpu", ["*"], ["host"], "avg", "avg", 300, ">", 50.0),
    (2, "cpu", ["env:prod"], [], "max", "max", 600, ">=", 95.0),
    (3, "mem", [], ["env"], "sum", "min", 120, "<", 60.0),
    (4, "mem", ["env:dev", "host:h3"], ["host"], "count", "sum", 900, "<=", 3.0),
    (5, "none", ["*"], ["host"], "avg", "avg", 300, ">", 1.0),
    (6, "cpu", ["*"], ["host"], "avg", "max", 900, ">", 80.0),
    (7, "cpu", None, None, "min", "count", 60, ">", 0.0),
]
RULE_DDL = (
    "rule_id long, metric string, scope array<string>, by array<string>, space_agg string,"
    " time_agg string, lookback_s long, comparator string, threshold double"
)
CMP = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def judge(values, rule):
    if not values:
        return None, "No Data"
    v = AGG[rule[5]](values)
    return v, "Alert" if CMP[rule[7]](v, rule[8]) else "OK"


def scope_of(rule):
    return [s for s in rule[2] or [] if s not in ("", "*")]


def test_evaluate_at_an_instant(spark, points, raw):
    rules = spark.createDataFrame(RULES, RULE_DDL)
    for as_of in (T0 + 3601, T0 + 60, T0 - 5):
        got = {
            (r["rule_id"], r["group"]): (r["value"], r["state"])
            for r in evaluate_monitors(points, rules, as_of).collect()
        }
        want = {}
        for rule in RULES:
            cells = brute_steps(
                raw, rule[1], scope_of(rule), rule[3] or [], rule[4],
                lambda us: (as_of * 10**6 - us) // (60 * 10**6) if us <= as_of * 10**6 else None,
            )
            for g in {g for _, g in cells} or {"*"}:
                values = [v for (s, gg), v in sorted(cells.items()) if gg == g and s * 60 < rule[6]]
                v, state = judge(values, rule)
                want[rule[0], g] = (None if v is None else pytest.approx(v), state)
        assert got == want


def test_evaluate_since(spark, points):
    rules = spark.createDataFrame(RULES[:1], RULE_DDL)
    none = evaluate_monitors(points, rules, T0 + 90_000, seen_since_s=T0 + 80_000).collect()
    assert [(r["group"], r["state"]) for r in none] == [("*", "No Data")]


@pytest.mark.parametrize("frame_steps", [0, 48])
def test_evaluate_over_a_range(spark, points, raw, frame_steps):
    rules = spark.createDataFrame(RULES, RULE_DDL)
    lo, hi, step = T0 + 1830, T0 + 4000, 60
    got = {
        (r["rule_id"], r["group"], r["s"]): (r["value"], r["state"])
        for r in evaluate_monitors_over(points, rules, lo, hi, step, frame_steps)
        .withColumn("s", F.unix_timestamp("ts"))
        .collect()
    }
    first = lo // step * step
    base = first - 900 + step
    want = {}
    for rule in RULES:
        cells = brute_steps(
            raw, rule[1], scope_of(rule), rule[3] or [], rule[4],
            lambda us: us // 10**6 // step * step if base * 10**6 <= us < hi * 10**6 else None,
        )
        for g in {g for _, g in cells} or {"*"}:
            for at in range(first, hi, step):
                values = [
                    v for (s, gg), v in sorted(cells.items()) if gg == g and at - rule[6] < s <= at
                ]
                v, state = judge(values, rule)
                want[rule[0], g, at] = (None if v is None else pytest.approx(v), state)
    assert got == want


def test_unknown_rule_words_fail(spark, points):
    for change in ({4: "p99"}, {5: "p99"}, {7: "=="}):
        rule = list(RULES[0])
        for k, v in change.items():
            rule[k] = v
        with pytest.raises(Exception, match="unknown"):
            evaluate_monitors(
                points, spark.createDataFrame([tuple(rule)], RULE_DDL), T0 + 3600
            ).collect()


def test_a_point_with_several_values_of_a_tag_is_in_each_group(spark):
    rows = [("cpu", T0 + 1, 4.0, ["env:a", "env:b", "host:x"]), ("cpu", T0 + 2, 2.0, ["env:b"]), ("cpu", T0 + 3, 6.0, [])]
    points = spark.createDataFrame(rows, "metric string, t long, value double, tags array<string>").withColumn(
        "ts", F.timestamp_seconds("t"))
    got = {r["scope"]: r["value"] for r in query_metric(points, "cpu", T0, T0 + 60, "avg", None, ["env"], 60).collect()}
    assert got == {"env:a": 4.0, "env:b": 3.0, "env:N/A": 6.0}
    got = {r["scope"] for r in query_metric(points, "cpu", T0, T0 + 60, "avg", None, ["env", "host"], 60).collect()}
    assert got == {"env:a,host:x", "env:b,host:x", "env:b,host:N/A", "env:N/A,host:N/A"}
    rules = spark.createDataFrame([(1, "cpu", ["*"], ["env"], "max", "max", 60, ">", 3.5)], RULE_DDL)
    states = {r["group"]: r["state"] for r in evaluate_monitors(points, rules, T0 + 30).collect()}
    assert states == {"env:a": "Alert", "env:b": "Alert", "env:N/A": "Alert"}


def test_rules_are_probed_by_the_tag_fewest_share(spark):
    from watchpost.operators.monitors import probed_spaces, with_series

    rules = [(k, "cpu", ["env:prod", f"host:h{k}"], [], "avg", "avg", 60, ">", 1.0) for k in range(20)]
    rules += [(30, "cpu", ["env:prod"], [], "avg", "avg", 60, ">", 1.0), (31, "cpu", ["*"], [], "avg", "avg", 60, ">", 1.0)]
    probes = [r["probe"] for r in probed_spaces(with_series(spark.createDataFrame(rules, RULE_DDL), 60)).collect()]
    assert sorted(probes) == sorted([f"host:h{k}" for k in range(20)] + ["env:prod", "*"])


@pytest.mark.parametrize("width", [1, 2, 5, 7, 40])
def test_trailing_parts_of_any_width(spark, width):
    from watchpost.operators.monitors import trailing

    rng = random.Random(width)
    values = {g: [rng.choice([None, float(rng.randint(-9, 9))]) for _ in range(n)] for g, n in (("a", 33), ("b", 6), ("c", 1))}
    # silent rows for a lookback before the first
    rows = [(1, g, 100 - width + i, v) for g, vs in values.items() for i, v in enumerate([None] * width + vs)]
    frame = spark.createDataFrame(rows, "rule_id int, group string, at long, value double")
    got = trailing(frame, F.col("at"), F.lit(width).cast("long")).collect()
    for r in got:
        i = r["at"] - 100
        if i < 0:
            continue
        held = [v for v in values[r["group"]][max(i - width + 1, 0) : i + 1] if v is not None]
        want = (sum(held), len(held), min(held), max(held)) if held else (None, 0, None, None)
        assert (r["_sum"], r["_n"], r["_min"], r["_max"]) == want, (width, r)


def test_a_long_lookback_costs_as_much_as_a_short_one(spark):
    """No window frame is as wide as the lookback."""
    points = spark.range(100).selectExpr(
        "'cpu' AS metric", f"timestamp_seconds({T0} + id * 60) AS ts", "1.0D AS value", "array('host:a') AS tags")
    rules = spark.createDataFrame([(1, "cpu", ["*"], ["host"], "avg", "max", 172_800, ">", 1.0)], RULE_DDL)
    plan = evaluate_monitors_over(points, rules, T0, T0 + 6000, 60)._jdf.queryExecution().executedPlan().toString()
    frames = [f for f in plan.split("specifiedwindowframe(")[1:]]
    assert frames and all(
        f.startswith(("RowFrame, unboundedpreceding$(), ", "RowFrame, -1, -1", "RowFrame, 1, 1")) for f in frames)


def test_sums_of_doubles_do_not_depend_on_the_order(spark):
    import math
    from watchpost.operators.metrics import exact_sum

    rng = random.Random(8)
    values = [rng.choice([1, -1]) * 10 ** rng.uniform(-12, 20) for _ in range(4000)]
    values += [0.1] * 500 + [1e16, -1e16, 3e33, -3e33, 5e-27]
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(values)
        frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(1 + 3 * seed)
        seen.add(frame.agg(exact_sum("v").alias("s")).first()["s"])
    assert len(seen) == 1 and seen.pop() == pytest.approx(math.fsum(values), rel=1e-12)
    odd = lambda vs: spark.createDataFrame([(v,) for v in vs], "v double").agg(exact_sum("v").alias("s")).first()["s"]
    assert odd([]) is None and odd([None]) is None and odd([0.1] * 10) == 1.0
    assert odd([1e300, 1.0]) == 1e300 and odd([float("inf"), 1.0]) == float("inf")
    assert math.isnan(odd([float("nan"), 1.0])) and odd([9e14] * 3 + [1e15]) == 3.7e15


def test_series_and_states_have_the_same_bits_in_any_order(spark, raw):
    rules = spark.createDataFrame(RULES, RULE_DDL)
    found = set()
    for seed in range(3):
        rows = [(m, us, v + 0.1, t) for m, us, v, t in raw if v is not None]
        random.Random(seed).shuffle(rows)
        points = spark.createDataFrame(rows, "metric string, us long, value double, tags array<string>").select(
            "metric", F.timestamp_micros("us").alias("ts"), "value", "tags").repartition(2 + seed)
        series = query_metric(points, "cpu", T0, T0 + 7200, "avg", None, [], 600).collect()
        states = evaluate_monitors(points, rules, T0 + 3601).collect()
        found.add((tuple(sorted(map(repr, series))), tuple(sorted(map(repr, states)))))
    assert len(found) == 1
