import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make_words(rng, n):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdklnrst')}{rng.choice(['', 'a', 'en', 'io'])}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, repeated rows, odd white space, copies and near copies."""
    rng = random.Random(3)
    plain = [" ".join(make_words(rng, rng.randint(3, 90))) for _ in range(30)]
    long = " ".join(make_words(rng, 30_000))
    near = make_words(rng, 120)
    copy = [*near]
    copy[60] = "changed"
    out = [(k, t) for k, t in enumerate(plain)]
    out += [
        (40, None),
        (41, ""),
        (42, " \t\n "),
        (None, "a row without an id"),
        (None, None),
        (43, long),
        (44, " ".join(near)),
        (45, " ".join(copy)),
        (46, " ".join(near)),
        (46, " ".join(near)),
        (47, "one"),
        (48, "ONE"),
        (49, "Two  spaces \t and\n\nlines, \u00e9t\u00e9 \u00df \u4e2d\u6587 \U0001f600 <|endoftext|> don't"),
        (50, "a" * 5000),
        (51, "word " * 300),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(
        [(k, t, "en", "src", len(t or "")) for k, t in rows], SCHEMA
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    """The same rows with columns named like the operators' own."""
    names = ["_row", "_doc", "_key", "_text", "set", "label", "template", "doc", "h", "_drops"]
    schema = SCHEMA + "".join(f", `{n}` string" for n in names)
    return spark.createDataFrame(
        [(k, t, "en", "src", len(t or ""), *names) for k, t in rows], schema
    )
