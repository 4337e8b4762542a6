"""Lines that recur across documents, found by a log-template tree, as SQL functions only.

A line falls down a tree of fixed depth: first by its number of tokens, then by its leading
tokens, with tokens that hold a digit read as a variable field. Lines that are equal but for such
fields have one template. Lines of a leaf that agree in one of several runs of positions are a group; the
runs are so many that a line that agrees with a template in ``SIMILAR`` of its positions agrees with
it in all of some run. In a group the commonest token at each position, weighted by documents, makes
a general template, and lines that agree with it in ``SIMILAR`` of their positions belong to it;
what differs is a variable field as well. The lines left over are grouped again until no template
gets two of them, so a leaf may have any number of general templates.

A line may belong to several; the smallest document that keeps one of them counts.

A template recurs if it stands in at least ``LONG_DOCS`` documents, or in ``SHORT_DOCS`` if it has
fewer than ``LONG_WORDS`` tokens; by themselves lines of fewer than ``MIN_WORDS`` stay. Lines of a
recurring template are dropped from every document but the one with the smallest id.

Short lines count with their neighbours as well: from every short line on, adjacent short lines
up to ``LONG_WORDS`` tokens together are a unit, by their templates, and a unit recurs like a long
line. So a passage wrapped into short lines goes like one on a line of its own. Where a line has
few spaces, ``CHARS`` characters count as a token.

All counts are taken over distinct lines and then aggregated, so that a line or a template that
is everywhere is never gathered in one place.

Cases: a null text stays null, an empty one stays empty, and a text that loses all its lines
becomes empty; rows are never removed. Rows of equal ``doc_id`` are one document, and so are those
with a null one, which sorts before every id. Columns besides ``doc_id`` and ``text`` pass through,
whatever their names; ``n_chars``, where there is one, is counted anew for changed texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import shuffles_removed
from .common import removed, stored, stored_at
from .sequences import bound, walk

DEPTH = 4
SIMILAR = 0.8
MIN_WORDS, LONG_WORDS = 3, 20
LONG_DOCS, SHORT_DOCS = 2, 10
FIELD = "<*>"
CHARS = 12
#: lines of a group that may meet in one task
TOGETHER = 1000


def _masked(line: Column) -> Column:
    with_fields = F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", FIELD)
    # looked for in the bytes, as most lines have none
    digit = reduce(lambda a, b: a | b, [line.contains(d) for d in "0123456789"])
    return F.trim(F.when(digit, with_fields).otherwise(line))


def _place(line: Column) -> Column:
    """struct(template, leaf, n, masked) of a line; its tokens are what stands between spaces."""

    def counted(masked: Column) -> Column:
        n = (
            F.octet_length(masked) - F.octet_length(F.replace(masked, F.lit(" "), F.lit(""))) + 1
        )
        return bound(
            n,
            lambda n: F.struct(
                F.xxhash64(masked).alias("template"),
                F.xxhash64(n, F.substring_index(masked, " ", DEPTH)).alias("leaf"),
                n.alias("n"),
                F.greatest(n, (F.length(masked) / CHARS).cast("int")).alias("w"),
                masked.alias("masked"),
            ),
        )

    # the masked line is made once, and its tokens are counted once
    return bound(_masked(line), counted)


def _lines() -> Column:
    return F.split("text", "\n")


def _units(places: Column, long_words: int) -> Column:
    """For each line struct(key, size): the unit that starts at it; size 0 where there is none.

    ``places`` has ``template`` and ``w`` of each line; a line has a token at least, so a unit has
    at most ``long_words`` lines.
    """
    def join(unit: Column, place: Column) -> Column:
        # a long line, or the end of the text, leaves the unit too short
        open_ = (unit["w"] < long_words) & (place["w"] < long_words) & ~unit["over"]
        return F.struct(
            F.when(open_, F.xxhash64(unit["key"], place["template"])).otherwise(unit["key"]).alias("key"),
            F.when(open_, unit["w"] + place["w"]).otherwise(unit["w"]).alias("w"),
            F.when(open_, unit["size"] + 1).otherwise(unit["size"]).alias("size"),
            (unit["over"] | (place["w"] >= long_words)).alias("over"),
        )

    start = F.struct(
        F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("w"), F.lit(0).alias("size"), F.lit(False).alias("over")
    )

    def unit(place: Column, i: Column) -> Column:
        ahead = F.slice(places, i + 1, F.lit(long_words))
        return F.when(
            place["w"] < long_words,
            F.aggregate(
                ahead,
                start,
                join,
                lambda u: F.struct(
                    u["key"].alias("key"),
                    F.when(u["w"] >= long_words, u["size"]).otherwise(0).alias("size"),
                ),
            ),
        ).otherwise(F.struct(F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("size")))

    return F.transform(places, unit)


def _narrow(places: Column) -> Column:
    return F.transform(places, lambda p: F.struct(p["template"].alias("template"), p["w"].cast("int").alias("w")))


def _runs(similar: float) -> Column:
    """A key for each run of positions of a line: one run more than positions may differ."""
    n = F.col("n").cast("int")
    k = (n - F.ceil(F.lit(similar) * n) + 1).cast("int")

    def key(at: Column) -> Column:
        low, high = F.floor(at * n / k).cast("int"), F.floor((at + 1) * n / k).cast("int")
        return F.xxhash64("leaf", at, F.slice("tokens", low + 1, high - low))

    return F.transform(F.sequence(F.lit(0), k - 1), key)


def general_templates(lines: DataFrame, spread: DataFrame, similar: float) -> DataFrame:
    """(template, group) of the lines that a general template has in common with others.

    ``spread`` has the (template, group) of each run of the lines.
    """
    # runs that the same lines agree in are one group
    same = spread.groupBy("group").agg(
        F.count(F.lit(1)).alias("k"),
        F.bit_xor("template").alias("name"),
        F.bit_xor(F.xxhash64("template")).alias("name2"),
    )
    groups = same.filter("k > 1").groupBy("k", "name", "name2").agg(F.min("group").alias("group"))
    grouped = spread.join(groups.select("group", "k"), "group").join(lines, "template")
    # the lines of all but very large groups meet in one task, where their tokens are counted
    # without being sent on
    few = _members(grouped.filter(F.col("k") <= TOGETHER).repartition("group"), similar)
    return few.unionByName(_members(grouped.filter(F.col("k") > TOGETHER), similar))


def _members(grouped: DataFrame, similar: float) -> DataFrame:
    """(template, group) of the lines that agree with their group's commonest tokens."""
    votes = (
        grouped.select("group", "docs", F.posexplode("tokens").alias("at", "token"))
        .groupBy("group", "at", "token")
        .agg(F.sum("docs").alias("votes"))
        .groupBy("group", "at")
        .agg(F.max(F.struct("votes", "token"))["token"].alias("token"))
    )
    general = votes.groupBy("group").agg(
        F.sort_array(F.collect_list(F.struct("at", "token"))).alias("common")
    )
    agree = F.size(
        F.filter(
            F.zip_with("tokens", "common", lambda t, c: t == c["token"]), lambda same: same
        )
    )
    members = (
        grouped.join(general, "group")
        .filter(agree >= similar * F.col("n"))
        .select("template", "group")
    )
    several = members.groupBy("group").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    return members.join(several.select("group"), "group").select("template", "group")


def recurring_templates(
    docs: DataFrame,
    similar: float = SIMILAR,
    min_words: int = MIN_WORDS,
    long_words: int = LONG_WORDS,
    long_docs: int = LONG_DOCS,
    short_docs: int = SHORT_DOCS,
) -> tuple[DataFrame, DataFrame]:
    """(occurrences, templates).

    ``occurrences`` has a row for each distinct line template or unit of a document, ``templates``
    a row for each that recurs: ``template``, ``unit`` (whether it is a unit) and ``keeper``, the
    document that keeps it.
    """
    def rows(places: Column) -> Column:
        """A row for each line that counts by itself, and one for each unit (null leaf)."""
        lines = F.transform(
            F.filter(places, lambda p: p["w"] >= min_words),
            lambda p: F.struct(p["template"], p["leaf"], p["n"], p["w"]),
        )
        none = F.expr("struct(0L AS template, CAST(NULL AS BIGINT) AS leaf, 0 AS n, 0 AS w)")
        units = bound(
            _narrow(places),
            lambda own: F.transform(
                F.filter(_units(own, long_words), lambda u: u["size"] > 0),
                lambda u: F.struct(
                    u["key"].alias("template"), none["leaf"].alias("leaf"), none["n"].alias("n"), none["w"].alias("w")
                ),
            ),
        )
        return F.concat(lines, units)

    placed = docs.select(
        F.struct("doc_id").alias("doc"),
        F.explode(bound(F.transform(_lines(), _place), rows)).alias("p"),
    )
    seen = stored(placed.select("doc", "p.*").distinct(), "lines")
    units = (
        seen.filter("leaf IS NULL")
        .groupBy("template")
        .agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("keeper"))
        .filter(F.col("docs") >= long_docs)
        .select("template", "keeper", F.lit(True).alias("unit"))
    )
    distinct = seen.filter("leaf IS NOT NULL").groupBy("template", "leaf", "n", "w").agg(
        F.count(F.lit(1)).alias("docs"), F.min("doc").alias("keeper")
    )
    distinct = stored(distinct, "templates")

    # leaves with several templates: read the lines of their keepers again
    mixed = distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    wanted = distinct.join(mixed.select("leaf"), "leaf", "left_semi")
    by_doc = wanted.groupBy(F.col("keeper.doc_id").alias("_doc")).agg(
        F.map_from_entries(F.collect_list(F.struct("template", "docs"))).alias("_wanted")
    )
    full = (
        docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc")))
        .select("_wanted", F.explode(_lines()).alias("line"))
        .select("_wanted", _place(F.col("line")).alias("p"))
        .select("p.*", F.col("_wanted")[F.col("p.template")].alias("docs"))
        .filter("docs is not null")
    )
    lines = full.dropDuplicates(["template", "leaf", "n"]).select(
        "template",
        "leaf",
        "n",
        "docs",
        # hashes, as tokens are only ever compared
        F.transform(F.split("masked", " "), lambda t: F.xxhash64(t)).alias("tokens"),
    )
    lines, path = stored_at(lines, "leaf-lines")
    spread, spread_path = stored_at(
        lines.select("template", F.explode(_runs(similar)).alias("group")), "line-runs"
    )
    members = None
    while True:
        found = stored(general_templates(lines, spread, similar), "line-groups")
        members = found if members is None else members.unionByName(found)
        if not found.limit(1).count():
            break
        # the templates found hold all that this round's lines are still needed for. What a group
        # comes to depends on its lines alone: one that has lost none came to nothing and would
        # again, so only the others go on
        lost = found.select("template").distinct()
        shrunk = spread.join(lost, "template", "left_semi").select("group").distinct()
        spread, next_spread = stored_at(
            spread.join(lost, "template", "left_anti").join(shrunk, "group", "left_semi"), "line-runs"
        )
        lines, next_path = stored_at(lines.join(spread, "template", "left_semi"), "leaf-lines")
        for old in (path, spread_path):
            removed(docs.sparkSession, old)
        path, spread_path = next_path, next_spread
    for old in (path, spread_path):
        removed(docs.sparkSession, old)

    # a general template stands for all its members; any other line for itself
    joined = distinct.join(members, "template", "left")
    of_group = joined.filter("group is not null").groupBy("group").agg(
        F.sum("docs").alias("all_docs"),
        F.min("keeper").alias("first"),
        F.max("keeper").alias("last"),
    )
    enough = F.when(F.col("w") >= long_words, long_docs).otherwise(short_docs)
    alone = joined.filter("group is null").filter(F.col("docs") >= enough)
    grouped = (
        joined.filter("group is not null")
        .join(of_group, "group")
        # several templates of one document are no recurrence
        .filter(
            (F.col("docs") >= enough)
            | ((F.col("all_docs") >= enough) & (F.col("first") != F.col("last")))
        )
    )
    templates = alone.select("template", "keeper").unionByName(
        grouped.groupBy("template").agg(F.min("first").alias("keeper"))
    )
    seen = seen.select("doc", "template", F.col("leaf").isNull().alias("unit"))
    return seen, templates.withColumn("unit", F.lit(False)).unionByName(units)


def drop_recurring_lines(docs: DataFrame, **params) -> DataFrame:
    """The documents without the recurring lines that another document keeps."""
    with shuffles_removed(docs.sparkSession):
        seen, templates = recurring_templates(docs.select("doc_id", "text"), **params)
    hashes = lambda unit: F.collect_set(F.when(F.col("unit") == unit, F.col("template")))
    drops = (
        seen.join(templates, ["template", "unit"])
        .filter(F.col("doc") != F.col("keeper"))
        .groupBy(F.col("doc.doc_id").alias("_doc"))
        .agg(hashes(False).alias("_drops"), hashes(True).alias("_units"))
    )
    # one struct for the row, so that no column of the caller can clash with these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.col("_row")["text"]
    long_words = params.get("long_words", LONG_WORDS)
    by_line = F.filter(
        F.split(text, "\n"), lambda x: ~F.array_contains("_drops", F.xxhash64(_masked(x)))
    )

    def outside(places: Column) -> Column:
        """The lines that are neither dropped by themselves nor in a dropped unit."""
        sizes = F.transform(
            _units(_narrow(places), long_words),
            lambda u: F.when((u["size"] > 0) & F.array_contains("_units", u["key"]), u["size"]).otherwise(0),
        )
        lines = F.arrays_zip(F.split(text, "\n").alias("line"), sizes.alias("size"), places.alias("place"))

        def step(left: Column, at: Column) -> tuple[Column, Column]:
            """``left`` lines from this one on are in a unit."""
            covered = F.greatest(left, at["size"])
            drop = (covered > 0) | F.array_contains("_drops", at["place"]["template"])
            none = F.expr("cast(array() as array<string>)")
            return F.greatest(covered - 1, F.lit(0)), F.when(drop, none).otherwise(F.array(at["line"]))

        return bound(lines, lambda own: walk(own, F.lit(0), "string", step)["out"])

    kept = F.when(F.size("_units") == 0, by_line).otherwise(
        bound(F.transform(F.split(text, "\n"), _place), outside)
    )
    changed = F.when(F.col("_drops").isNotNull(), F.array_join(kept, "\n")).otherwise(text)
    out = rows.join(drops, F.col("_row")["doc_id"].eqNullSafe(F.col("_doc")), "left").select(
        "_row", "_drops", changed.alias("_text")
    )

    def column(name: str) -> Column:
        same = F.col("_row")[name]
        if name == "text":
            return F.col("_text").alias(name)
        if name == "n_chars":
            size = F.length("_text").cast(docs.schema[name].dataType)
            return F.when(F.col("_drops").isNotNull(), size).otherwise(same).alias(name)
        return same.alias(name)

    return out.select(*[column(c) for c in docs.columns])
