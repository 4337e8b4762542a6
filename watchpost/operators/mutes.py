"""Host mutes: folding the command log, and attaching the state to hosts.

A mute is live at ``t`` while its end is after ``t``; a mute without end is live until undone.
A mute of a live host is rejected unless it overrides; so is an unmute of a host that is not
muted. The state of a host after a command therefore depends on all commands before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import ts_lit, ts_type
from ..plans.layout import next_values
from ..session import scratch_root

FOREVER_S = 253_370_764_800  # 9999-01-01, the end of a mute without end
FOLD_ROWS = 50_000


def fold_mutes(
    commands: DataFrame,
    as_of_s: float,
    initial: DataFrame | None = None,
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """The state of every host at ``as_of_s``, with its commands and rejections counted.

    ``initial`` holds earlier results ``(host, mute_end, message)`` of hosts still muted when
    the commands start. Commands of one host and instant follow each other by ``seq``, then by
    action, end, override and message, for hosts of any size. Hosts with up to ``fold_rows`` commands are folded one array each; the
    size is checked first, and larger hosts are resolved by joins that never gather a host.
    """
    kind = ts_type(commands, "ts")
    log = _as_log(commands.filter(F.col("ts") <= ts_lit(as_of_s, kind)), kind)
    if initial is not None:
        seed = initial.filter(F.col("muted")).select(
            "host",
            ts_lit(0, kind).alias("ts"),
            F.lit(-1).cast("long").alias("seq"),
            F.lit("seed").alias("action"),
            F.coalesce("mute_end", ts_lit(FOREVER_S, kind)).alias("end"),
            F.lit(True).alias("override"),
            "message",
        )
        log = log.unionByName(seed)
    sizes = log.groupBy("host").agg(F.count(F.lit(1)).alias("_rows"))
    large = sizes.filter(F.col("_rows") > fold_rows).select("host")
    if large.isEmpty():
        state = _fold_small(log)
    else:
        state = _fold_small(log.join(large, "host", "left_anti")).unionByName(
            _fold_large(log.join(large, "host", "left_semi"))
        )
    now, forever = ts_lit(as_of_s, kind), ts_lit(FOREVER_S, kind)
    muted = F.coalesce(F.col("end") > now, F.lit(False))
    return state.select(
        "host",
        muted.alias("muted"),
        F.when(muted & (F.col("end") < forever), F.col("end")).alias("mute_end"),
        F.when(muted, F.col("message")).alias("message"),
        "commands",
        "rejected",
    )


def _as_log(commands: DataFrame, kind) -> DataFrame:
    known = F.when(F.col("action").isin("mute", "unmute"), F.col("action")).otherwise(
        F.raise_error(F.concat(F.lit("unknown mute action "), F.coalesce("action", F.lit("null"))))
    )
    host = F.when(F.col("host").isNotNull(), F.col("host")).otherwise(
        F.raise_error(F.lit("mute command without a host"))
    )
    return commands.select(
        host.alias("host"),
        "ts",
        "seq",
        known.alias("action"),
        F.coalesce("mute_end", ts_lit(FOREVER_S, kind)).alias("end"),
        F.coalesce("override", F.lit(False)).alias("override"),
        "message",
    )


def _fold_small(log: DataFrame) -> DataFrame:
    """Sort a host's commands into an array and run the rules along it, inside Catalyst."""
    end_type = log.schema["end"].dataType.simpleString()
    start = F.struct(
        F.lit(None).cast(end_type).alias("end"),
        F.lit(None).cast("string").alias("message"),
        F.lit(0).cast("long").alias("rejected"),
    )

    def step(acc: Column, c: Column) -> Column:
        live = F.coalesce(acc["end"] > c["ts"], F.lit(False))
        refused = F.when(c["action"] == "unmute", ~live).otherwise(live & ~c["override"])
        cleared = c["action"] == "unmute"
        return F.struct(
            F.when(refused, acc["end"])
            .when(cleared, F.lit(None).cast(end_type))
            .otherwise(c["end"])
            .alias("end"),
            F.when(refused, acc["message"])
            .when(cleared, F.lit(None).cast("string"))
            .otherwise(c["message"])
            .alias("message"),
            (acc["rejected"] + refused.cast("long")).alias("rejected"),
        )

    row = F.struct("ts", "seq", "action", "end", "override", "message")
    packed = log.groupBy("host").agg(
        F.array_sort(F.collect_list(row)).alias("log"),
        F.count_if(F.col("action") != "seed").alias("commands"),
    )
    return packed.withColumn("s", F.aggregate("log", start, step)).select(
        "host", "s.end", "s.message", "commands", "s.rejected"
    )


def _fold_large(log: DataFrame) -> DataFrame:
    """The same for hosts of any size.

    Each command points to the next one that can change the state after it took effect: after
    an unmute, the very next command; after a mute, the first command at or past its end, or an
    earlier unmute or override. Unmutes and overrides act whatever came before, so they and the
    first command of a host are known to take effect; the other commands that do are those
    reached from them along the pointers. Pointers are doubled each round, so a run of n plain
    mutes takes log2(n) rounds of equi-joins on unique ids.
    """
    scratch_root(log.sparkSession)
    # ids must not change between the uses of the log
    nodes = (
        log.withColumn("node", F.monotonically_increasing_id())
        .withColumn("resets", (F.col("action") == "unmute") | F.col("override"))
        # ties are broken as in the array fold: by what the rows say, not by where they lie
        .withColumn("seq", F.struct("seq", "action", "end", "override", "message"))
        .checkpoint()
    )
    seq_type = nodes.schema["seq"].dataType
    first_of_all = F.struct(
        F.lit(-(2**62)).alias("seq"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in seq_type.fields[1:]],
    )
    self_at = F.struct("ts", "seq", "node", (F.col("action") == "unmute").alias("unmute"), "resets")
    at = self_at.alias("at")
    none = F.when(F.lit(False), self_at)
    after_end = (F.col("action") != "unmute") & (F.col("end") > F.col("ts"))
    # rank orders rows of one instant: a mute's end comes before the commands then
    commands = nodes.select(
        "host",
        "ts",
        "seq",
        F.lit(1).alias("rank"),
        "node",
        at,
        F.when(F.col("resets"), self_at).alias("reset_at"),
    )
    ends = nodes.select(
        "host",
        F.when(after_end, F.col("end")).otherwise(F.col("ts")).alias("ts"),
        F.when(after_end, first_of_all).otherwise(F.col("seq")).alias("seq"),
        F.when(after_end, F.lit(0)).otherwise(F.lit(2)).alias("rank"),
        "node",
        none.alias("at"),
        none.alias("reset_at"),
    )
    ahead = next_values(
        commands.unionByName(ends),
        ["host"],
        ["ts", "seq", "rank", "node"],
        {"next_at": "at", "next_reset": "reset_at"},
    )
    # a command's own row knows the next reset, its end row the next command
    candidate = F.when(F.col("rank") == 1, F.col("next_reset")).otherwise(F.col("next_at"))
    pointers = (
        ahead.groupBy("node").agg(F.min(candidate).alias("to")).filter("to is not null").checkpoint()
    )

    firsts = nodes.groupBy("host").agg(F.min_by("node", F.struct("ts", "seq")).alias("node"))
    reached = (
        nodes.filter("resets").select("node").union(firsts.select("node")).distinct().checkpoint()
    )
    jumps = pointers.filter(~F.col("to.resets")).select("node", F.col("to.node").alias("to"))
    while True:
        new = (
            reached.join(jumps, "node")
            .select(F.col("to").alias("node"))
            .distinct()
            .join(reached, "node", "left_anti")
            .checkpoint()
        )
        if new.isEmpty():
            break
        reached = reached.union(new).checkpoint()
        # many mutes may point to one command; only this side repeats, so a hot target is split
        # by the adaptive skew join
        onward = jumps.select(F.col("node").alias("to"), F.col("to").alias("further"))
        jumps = jumps.join(onward, "to").select("node", F.col("further").alias("to")).checkpoint()

    active = nodes.join(reached, "node", "left_semi").join(pointers, "node", "left")
    is_mute = F.col("action") != "unmute"
    undone = is_mute & F.col("to.unmute") & (F.col("end") > F.col("to.ts"))
    last = F.struct(F.when(is_mute, F.col("end")).alias("end"), F.when(is_mute, F.col("message")).alias("message"))
    states = active.groupBy("host").agg(
        F.max_by(last, F.struct("ts", "seq")).alias("last"),
        F.count_if(is_mute & (F.col("action") != "seed")).alias("mutes"),
        F.count_if(undone).alias("unmutes"),
    )
    totals = nodes.groupBy("host").agg(F.count_if(F.col("action") != "seed").alias("commands"))
    return states.join(totals, "host").select(
        "host",
        "last.end",
        "last.message",
        "commands",
        (F.col("commands") - F.col("mutes") - F.col("unmutes")).alias("rejected"),
    )


def with_mute(hosts: DataFrame, mutes: DataFrame) -> DataFrame:
    """Hosts with their current mute: ``is_muted``, ``mute_end`` and ``mute_message``."""
    current = mutes.select(
        F.col("host").alias("name"), "muted", "mute_end", F.col("message").alias("mute_message")
    )
    return (
        hosts.drop("mute_end", "mute_message")
        .join(current, "name", "left")
        .withColumn("is_muted", F.coalesce("muted", F.lit(False)))
        .drop("muted")
    )


def unknown_hosts(hosts: DataFrame, mutes: DataFrame) -> DataFrame:
    """Hosts named in mute commands that are not in the host list."""
    return mutes.select("host").join(
        hosts.select(F.col("name").alias("host")), "host", "left_anti"
    )
