import random

import pytest
from pyspark.sql import functions as F

from watchpost.operators.mutes import fold_mutes, unknown_hosts, with_mute

T0 = 1_704_067_200
DDL = "host string, t long, seq long, action string, e long, override boolean, message string"


def commands(spark, rows, kind="timestamp"):
    return spark.createDataFrame(rows, DDL).select(
        "host", F.timestamp_seconds("t").cast(kind).alias("ts"), "seq", "action",
        F.timestamp_seconds("e").cast(kind).alias("mute_end"), "override", "message",
    )


def brute(rows, as_of):
    out = {}
    for host in {r[0] for r in rows if r[1] <= as_of}:
        end, message, rejected, n = None, None, 0, 0
        for _, t, _, action, e, override, text in sorted(
            (r for r in rows if r[0] == host and r[1] <= as_of), key=lambda r: (r[1], r[2])
        ):
            n += 1
            live = end is not None and end > t
            if action == "unmute":
                if live:
                    end, message = None, None
                else:
                    rejected += 1
            elif live and not override:
                rejected += 1
            else:
                end, message = (float("inf") if e is None else e), text
        muted = end is not None and end > as_of
        finite = muted and end != float("inf")
        out[host] = (muted, int(end) if finite else None, message if muted else None, n, rejected)
    return out


def folded(df, as_of, **kw):
    rows = fold_mutes(df, as_of, **kw).withColumn("e", F.unix_timestamp("mute_end")).collect()
    got = {r["host"]: (r["muted"], r["e"], r["message"], r["commands"], r["rejected"]) for r in rows}
    assert len(got) == len(rows)
    return got


def log(seed, n=300, hosts=4, unmutes=0.2, overrides=0.2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        host = "hot" if rng.random() < 0.5 else f"h{rng.randrange(hosts)}"
        t = T0 + rng.randrange(400)
        action = "unmute" if rng.random() < unmutes else "mute"
        # ends in the past, at once, soon, late, never
        e = rng.choice([t - 5, t, t + rng.randrange(1, 9), t + rng.randrange(90), None])
        rows.append((host, t, i, action, e, rng.random() < overrides, f"m{i}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("seed,unmutes,overrides", [(1, 0.2, 0.2), (2, 0.0, 0.0), (3, 0.5, 0.0), (4, 0.02, 0.02)])
def test_fold_equals_replay(spark, kind, seed, unmutes, overrides):
    rows = log(seed, unmutes=unmutes, overrides=overrides)
    df = commands(spark, rows, kind)
    for as_of in (T0 + 1000, T0 + 200):
        assert folded(df, as_of) == brute(rows, as_of)


@pytest.mark.parametrize(
    "seed,unmutes,overrides,limit", [(5, 0.2, 0.2, 0), (6, 0.0, 0.0, 0), (7, 0.05, 0.0, 60), (8, 0.0, 0.03, 0)]
)
def test_large_hosts_equal_replay(spark, seed, unmutes, overrides, limit):
    rows = log(seed, unmutes=unmutes, overrides=overrides)
    got = folded(commands(spark, rows), T0 + 300, fold_rows=limit)
    assert got == brute(rows, T0 + 300)


def test_long_run_of_plain_mutes(spark):
    # nothing ever resets the host: one mute a second, each for seven
    rows = [("h", T0 + i, i, "mute", T0 + i + 7, False, str(i)) for i in range(200)]
    assert folded(commands(spark, rows), T0 + 500, fold_rows=10) == brute(rows, T0 + 500)


def test_seed_state(spark):
    rows = log(9, hosts=3)
    cut = T0 + 150
    early, late = [r for r in rows if r[1] <= cut], [r for r in rows if r[1] > cut]
    before = fold_mutes(commands(spark, early), cut)
    whole = brute(rows, T0 + 600)
    for limit in (50_000, 0):
        after = folded(commands(spark, late), T0 + 600, initial=before, fold_rows=limit)
        for host, (muted, end, message, _, _) in whole.items():
            if host in after:
                assert after[host][:3] == (muted, end, message)


def test_unknown_action_fails(spark):
    with pytest.raises(Exception, match="unknown mute action"):
        fold_mutes(commands(spark, [("h", T0, 1, "pause", None, False, None)]), T0 + 1).collect()


def test_hosts_with_mute(spark):
    hosts = spark.createDataFrame([(1, "a", None), (2, "b", True)], "id long, name string, is_muted boolean")
    state = fold_mutes(
        commands(spark, [("a", T0, 1, "mute", None, False, "why"), ("zz", T0, 2, "unmute", None, None, None)]),
        T0 + 1,
    )
    rows = {r["name"]: r for r in with_mute(hosts, state).collect()}
    assert rows["a"]["is_muted"] and rows["a"]["mute_end"] is None and rows["a"]["mute_message"] == "why"
    assert rows["b"]["is_muted"] is False
    assert [r["host"] for r in unknown_hosts(hosts, state).collect()] == ["zz"]


@pytest.mark.parametrize("seed", range(3))
def test_ties_give_one_answer_for_any_order_and_size(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        t = T0 + rng.randrange(6)
        action = rng.choice(["mute", "mute", "unmute"])
        e = rng.choice([t + 2, t + 5, None])
        rows.append(("h", t, rng.randrange(2), action, e, rng.random() < 0.3, rng.choice("ab")))
    expected = None
    for order in range(2):
        rng.shuffle(rows)
        for fold_rows in (50_000, 0):
            got = folded(commands(spark, rows), T0 + 100, fold_rows=fold_rows)
            expected = expected or got
            assert got == expected


def test_a_command_without_a_host_is_an_error(spark):
    rows = [(None, T0, 0, "mute", None, False, "m")]
    with pytest.raises(Exception, match="without a host"):
        fold_mutes(commands(spark, rows), T0 + 1).collect()
