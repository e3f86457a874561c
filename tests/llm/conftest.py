import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "tree", "river", "stone", "cloud", "light", "paper", "ocean", "ember", "glass", "field", "storm"]
#: Names that operators use inside, as columns of the input.
CLASHING = ["shard", "slot", "group", "grp", "bucket", "copy", "shuffle_key", "cdf", "receiver", "score", "row", "item", "gone", "host", "path", "rule", "verdict", "tokens", "at", "offset", "found_tokens_", "found_verdict_", "parts", "length_", "chunk_"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def nasty_rows() -> list[tuple]:
    """Documents with nulls everywhere, empty and very long texts, copies, near copies, repeated rows and odd characters."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base, "en", "a", 1), (1, base, "en", "a", 1), (2, " ".join(near), "fr", "b", 2), (3, None, None, None, None), (4, "", "en", "a", 0), (5, "   \n\t ", "en", None, 6),
        (6, "one two three", "en", "c", 13), (7, "ONE Two three", "en", "c", 13), (8, prose(2, 30_000), "en", "a", 0), (9, "é😀" * 400, "fr", "b", 800), (10, "x" * 5_000, "en", "a", 5_000),
        (11, prose(3, 80) + " " + base, "de", "c", 9), (11, prose(4, 60), "de", "c", 9), (12, "same row", "en", "a", 8), (12, "same row", "en", "a", 8), (None, base, "en", "a", 1), (None, None, None, None, None), (-5, "negative id " + prose(5, 50), "en", "b", 3),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def nasty(spark):
    return spark.createDataFrame(nasty_rows(), SCHEMA).repartition(3)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(nasty):
    from pyspark.sql import functions as F

    return nasty.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


def as_rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
