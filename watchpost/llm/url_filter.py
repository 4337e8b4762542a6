"""Verdicts on urls by rules and by a list, looked up in sorted digest arrays.

Rules and listed entries are strings ``host/path``. Each set of them is stored as arrays sorted by
64-bit xxhash: the digests, the ends of the strings, and the strings. Files of at most ``PER_FILE``
entries are sent to the executors with ``addFile`` and memory-mapped there, so the list may be
larger than a task's memory, and the driver streams it. A url gives a few candidate strings (its
host and parent domains, with and without parts of the path); the digests of all candidates of a
batch are looked up at once by binary search, and a hit counts only if the stored string is equal.

The longest fitting rule decides; without one, an entry of the list that is the host or a parent
domain, alone or with a leading part of the path that ends in ``/``, blocks; all else is allowed.

Cases: a null url, or one without ``://``, has an empty host and path and is allowed. Rows are
judged on their own, so repeated rows and null or equal ids give a row each. Repeated and null
entries are taken once or not at all. Other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import lower_ascii

PER_FILE = 4_000_000
#: fixed values: the rules of the registered query, (verdict, host and path)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: fixed values: words that put a host on the list when a part of its name is one of them
LISTED_WORDS = (
    "ads", "adult", "bets", "casino", "malware", "phishing", "pills", "porn", "spam", "warez", "xxx",
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_hosts(pages: DataFrame, words: Iterable[str] = LISTED_WORDS) -> DataFrame:
    """(entry): the hosts of the pages that have one of the words between dots or hyphens."""
    pattern = f"(^|[.-])({'|'.join(words)})([.-]|$)"
    host = pages.select(host_of(F.col("url")).alias("entry"))
    return host.filter(F.col("entry").rlike(pattern)).distinct()


class DigestArray:
    """A memory-mapped file of sorted digests and the strings behind them."""

    def __init__(self, path: str):
        n = int(np.fromfile(path, "<u8", 1)[0])
        if n:
            self.digests = np.memmap(path, "<u8", "r", 8, (n,))
            self.ends = np.memmap(path, "<u8", "r", 8 + 8 * n, (n,))
            self.text = np.memmap(path, np.uint8, "r", 8 + 16 * n)
        self.n = n

    @staticmethod
    def write(path: str, rows: list[tuple[int, str]]) -> None:
        strings = [s.encode() for _, s in rows]
        with open(path, "wb") as out:
            out.write(np.array([len(rows)], "<u8").tobytes())
            out.write(np.array([d for d, _ in rows], "<u8").tobytes())
            out.write(np.cumsum([len(s) for s in strings], dtype="<u8").tobytes())
            out.write(b"".join(strings))

    def string(self, k: int) -> bytes:
        low = int(self.ends[k - 1]) if k else 0
        return self.text[low : int(self.ends[k])].tobytes()

    def contains(self, strings: list[str], digests: np.ndarray) -> np.ndarray:
        """Which of the strings are stored; the digests are theirs."""
        found = np.zeros(len(strings), bool)
        if not self.n or not len(strings):
            return found
        at = np.searchsorted(self.digests, digests)
        hits = np.flatnonzero(self.digests[np.minimum(at, self.n - 1)] == digests)
        for i in hits.tolist():
            k, wanted = int(at[i]), strings[i].encode()
            while k < self.n and self.digests[k] == digests[i] and not found[i]:
                found[i] = self.string(k) == wanted
                k += 1
        return found


def _digests(strings: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)


def ship_entries(spark: SparkSession, entries: DataFrame, per_file: int = PER_FILE) -> list[str]:
    """Sort the entries by digest and send them out as files; returns the files' names."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _digests(batch["entry"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                # order of unsigned values kept in a signed column
                [pa.array((keys ^ np.uint64(1 << 63)).view(np.int64)), batch["entry"]],
                names=["digest", "entry"],
            )

    rows = (
        entries.filter("entry is not null")
        .distinct()
        .mapInArrow(digest, "digest bigint, entry string")
        .orderBy("digest", "entry")
    )
    names, held = [], []

    def flush() -> None:
        name = f"digests-{uuid.uuid4().hex}"
        # the driver's own copy; Spark serves it from here to every executor, also to later ones
        path = os.path.join(tempfile.mkdtemp(prefix="digests-"), name)
        DigestArray.write(path, held)
        spark.sparkContext.addFile(path)
        names.append(name)
        held.clear()

    for row in rows.toLocalIterator():
        held.append((row["digest"] + (1 << 63), row["entry"]))
        if len(held) == per_file:
            flush()
    if held or not names:
        flush()
    return names


def _suffixes(host: str, dots: int) -> list[str]:
    """The host and its parent domains, longest first, as far as they have at most so many dots."""
    labels = host.split(".")
    names = [".".join(labels[k:]) for k in range(max(len(labels) - 1 - dots, 0), len(labels))]
    return [n for n in names if n]


def _judge(
    rules: dict[str, str],
    lengths: list[int],
    rule_files: list[str],
    files: list[str],
    listed_lengths: set[int],
    dots: int,
):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rule = [DigestArray(SparkFiles.get(f)) for f in rule_files]
        by_list = [DigestArray(SparkFiles.get(f)) for f in files]

        def known(arrays: list[DigestArray], strings: list[str]) -> set[str]:
            digests = _digests(strings)
            hit = np.zeros(len(strings), bool)
            for a in arrays:
                hit |= a.contains(strings, digests)
            return {strings[i] for i in np.flatnonzero(hit).tolist()}

        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                some = batch.slice(i, 2048)
                asked, listed = [], []
                for host, path in zip(some["host"].to_pylist(), some["path"].to_pylist()):
                    own = _suffixes(host, dots)
                    asked.append([h + path[:n] for h in own for n in lengths if len(path) >= n])
                    ends = [n for n in listed_lengths if not n or path[n - 1 : n] == "/"]
                    listed.append([h + path[:n] for h in own for n in ends])
                fits = known(by_rule, list({s for own in asked for s in own}))
                bad = known(by_list, list({s for own in listed for s in own}))
                chosen, verdicts = [], []
                for own, names in zip(asked, listed):
                    rule = max((s for s in own if s in fits), key=len, default=None)
                    chosen.append(rule)
                    blocked = any(s in bad for s in names)
                    verdicts.append(rules[rule] if rule else "block" if blocked else "allow")
                yield pa.RecordBatch.from_arrays(
                    [
                        some["page_id"],
                        some["host"],
                        some["path"],
                        pa.array(chosen, pa.string()),
                        pa.array(verdicts, pa.string()),
                    ],
                    names=["page_id", "host", "path", "rule", "verdict"],
                )

    return judge


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: Iterable[tuple[str, str]] = RULES
) -> DataFrame:
    """Per row: page_id, host, path, rule (null if none fits) and verdict.

    ``listed`` has a column ``entry``: hosts, or hosts with a path that ends in ``/``.
    """
    spark = pages.sparkSession
    verdicts = {rule: verdict for verdict, rule in rules}
    lengths = sorted({len(r) - r.index("/") if "/" in r else 0 for r in verdicts})
    # a url is asked for in the lengths that the list has only: as many as its entries' paths
    # have lengths, however long the url and however many its slashes and dots
    host = F.substring_index("entry", "/", 1)
    shapes = listed.filter("entry IS NOT NULL").select(
        (F.length("entry") - F.length(host)).alias("path"),
        (F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))).alias("dots"),
    )
    found = shapes.groupBy("path").agg(F.max("dots").alias("dots")).collect()
    listed_lengths = {r["path"] for r in found}
    dots = max([r["dots"] for r in found] + [r.split("/")[0].count(".") for r in verdicts], default=0)
    rule_rows = spark.createDataFrame([(r,) for r in verdicts], "entry string")
    rule_files = ship_entries(spark, rule_rows)
    files = ship_entries(spark, listed.select("entry"))
    return pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).mapInArrow(
        _judge(verdicts, lengths, rule_files, files, listed_lengths, dots),
        "page_id bigint, host string, path string, rule string, verdict string",
    )


def oracle_sql() -> str:
    """The registered query in SQL."""
    fits = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{r}'"
        for r, h, p in sorted(
            ((r, r[: r.index("/")], r[r.index("/") :]) for _, r in RULES),
            key=lambda x: -len(x[0]),
        )
    )
    verdicts = " ".join(f"when '{r}' then '{v}'" for v, r in RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = f"(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)"
    return f"""
        with cut as (
            select page_id,
                coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
                    '{upper}', '{lower}'), '') as host,
                coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
            from pages
        ),
        ruled as (select *, case {fits} end as rule from cut),
        listed as (select distinct host as bad from cut where regexp_matches(host, '{pattern}'))
        select page_id, host, path, rule,
            coalesce(case rule {verdicts} end, case when exists (
                select 1 from listed where host = bad or ends_with(host, '.' || bad)
            ) then 'block' else 'allow' end) as verdict
        from ruled
    """
