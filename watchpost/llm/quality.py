"""Quality rules and a hashed n-gram likelihood ratio, as SQL functions only.

Every word and pair of neighbouring words of a text falls, by a 64-bit hash, into one of
``BUCKETS`` buckets. Two multinomials over the buckets are counted: one over the whole corpus and
one over trusted documents (label quality 1; ``TRUSTED_DOCS`` of them by smallest hash of the id,
a bounded sample to fit on). The score of a text is the mean of log(trusted/raw) over its n-grams,
and a text is kept if the score reaches ``THRESHOLD``. The weights are one array of fixed size.

Words repeated within a text are found by 64-bit hashes of five words.

Cases: a null or blank text has no words and fails the base rules. Rows are judged on their own,
so repeated rows and null or equal ids give a row each; a document with a null id is never
trusted. Without labels the trusted counts are empty and the score is near zero or below. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 16
TRUSTED_DOCS = 20_000
#: nats an n-gram
THRESHOLD = -0.12
PRIOR = 1.0  # n-grams for each bucket, dealt out as the raw corpus is
MIN_WORDS, MAX_REPEAT_PERCENT, SPAN = 10, 20, 5

SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _grams(hashes: Column) -> Column:
    """Hashes of the words, then of the neighbouring pairs."""
    pairs = F.transform(
        F.slice(hashes, 2, F.size(hashes)),
        lambda h, i: F.xxhash64(F.get(hashes, i), h),
    )
    return F.when(F.size(hashes) > 1, F.concat(hashes, pairs)).otherwise(hashes)


def _prepared(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).alias("_text")
    words = docs.select(*more, text).withColumn("_words", _words(F.col("_text")))
    return words.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def _repeat_words(hashes: Column) -> Column:
    """Words inside a span of five that is found twice or more."""
    spans = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - SPAN),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(SPAN)]),
    )
    placed = F.sort_array(
        F.transform(spans, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    )

    def covered(ordered: Column) -> Column:
        again = F.filter(
            F.transform(
                ordered,
                lambda s, k: F.when(
                    F.coalesce(F.get(ordered, k - 1)["h"] == s["h"], F.lit(False))
                    | F.coalesce(F.get(ordered, k + 1)["h"] == s["h"], F.lit(False)),
                    s["at"],
                ),
            ),
            lambda at: at.isNotNull(),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            F.sort_array(again),
            start,
            lambda s, at: F.struct(
                (s["n"] + at + SPAN - F.greatest(s["end"], at)).alias("n"),
                (at + SPAN).alias("end"),
            ),
            lambda s: s["n"],
        )

    # bound once: a lambda over a one-element array
    once = F.get(F.transform(F.array(placed), covered), 0)
    return (
        F.when(F.size(hashes) < SPAN + 1, F.lit(0))
        .when(F.size(F.array_distinct(spans)) == F.size(spans), F.lit(0))
        .otherwise(once)
    )


def gram_weights(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    trusted_docs: int = TRUSTED_DOCS,
    prior: float = PRIOR,
) -> DataFrame:
    """One row with ``weights``: log(trusted/raw) by bucket, counted over all documents."""
    trusted = (
        labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("_trusted"))
        .distinct()
        .orderBy(F.xxhash64("_trusted"), "_trusted")
        .limit(trusted_docs)
    )
    # at most ``trusted_docs`` ids are sent out
    grams = (
        _prepared(docs, "doc_id")
        .join(F.broadcast(trusted), F.col("doc_id") == F.col("_trusted"), "left")
        .select(
            F.col("_trusted").isNotNull().cast("bigint").alias("t"),
            F.explode(_grams(F.col("_hashes"))).alias("h"),
        )
    )
    counts = grams.groupBy(F.pmod("h", F.lit(buckets)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("raw"), F.sum("t").alias("trusted")
    )
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    filled = every.join(counts, "bucket", "left").na.fill(0, ["raw", "trusted"])
    listed = filled.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "trusted", "raw"))).alias("all"),
        F.sum("trusted").alias("n_trusted"),
        F.sum("raw").alias("n_raw"),
    )
    # the trusted shares with the raw ones as their prior, over the raw shares
    prior_mass = f"{prior * buckets}D"
    ratio = f"(c.trusted * n_raw / greatest(c.raw, 1) + {prior_mass}) / (n_trusted + {prior_mass})"
    return listed.select(F.expr(f"transform(all, c -> ln({ratio}))").alias("weights"))


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    trusted_docs: int = TRUSTED_DOCS,
) -> DataFrame:
    """Per row: the counts, ``base_failed``, ``score`` (null without words) and ``kept``."""
    weights = gram_weights(docs, labels, buckets, trusted_docs).scalar()
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    grams = _grams(F.col("_hashes"))
    score = F.aggregate(
        grams,
        F.lit(0.0),
        lambda s, h: s + F.get("_weights", F.pmod(h, F.lit(buckets)).cast("int")),
    ) / F.size(grams)
    counted = (
        _prepared(docs, "doc_id")
        .withColumns({"_lines": lines, "_weights": weights})
        .select(
            "doc_id",
            F.size("_words").cast("bigint").alias("n_words"),
            F.length(F.translate("_text", SEPARATORS, "")).cast("bigint").alias("word_chars"),
            (F.length("_text") - F.length(F.translate("_text", SYMBOLS, "")))
            .cast("bigint")
            .alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines")))
            .cast("bigint")
            .alias("n_dup_lines"),
            _repeat_words(F.col("_hashes")).cast("bigint").alias("n_repeat_words"),
            F.when(F.size("_words") > 0, score).alias("score"),
        )
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))
    )
