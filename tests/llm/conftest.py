"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "row bigint, id bigint, n bigint, key string, digest string, doc string, score double, label string, kept string"


def awkward_rows():
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(9000))
    base = " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(120))
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),  # a repeated row
        (3, " ".join(near), "en", "b", 1),
        (4, base.replace(" ", " \t\n "), None, "b", 1),
        (5, None, "en", None, None),
        (6, "", None, "b", 0),
        (7, " \n\t ", "de", "b", 4),
        (None, base, "en", "c", 1),
        (None, None, None, None, None),
        (8, long, "en", "c", len(long)),
        (9, "ä ö ü ß 日本語 🙂 </s>[INST] \\ <|end|>", "de", "c", 1),
        (10, "ab", "de", "c", 2),
        (11, "12 34 --", "en", "c", 8),
    ]
    return rows + [(20 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), rng.choice(["en", "de"]), "d", 1) for k in range(40)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(5)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The same with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in CLASHING.split(", "))])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
