import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '', '.', ',', chr(10)])}" for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of texts, ids by place unless given, with extra columns whose names the operators use inside."""

    def docs(texts, ids=None):
        rows = [(k if ids is None else ids[k], t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
        df = spark.createDataFrame(rows, COLUMNS).repartition(3) if rows else spark.createDataFrame([], COLUMNS)
        for name in ("id", "key", "n", "bucket", "block", "print", "group", "root", "score", "label", "held_out", "doc", "part", "spans"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
        return df

    return docs


@pytest.fixture(scope="session")
def odd(make):
    """Null, empty, blank and very long texts, repeated rows, null and repeated ids."""
    rng = random.Random(1)
    same = prose(rng, 80)
    texts = [None, "", " \n\t ", "one", "one two three", same, same, same, prose(rng, 60_000), "é" * 3000, "a" * 200_000, None, same + " more"]
    return make(texts, [0, 1, 2, 3, 4, 5, 5, None, 8, 9, 10, None, 5])


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k // 2) % 2) for k in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
