import random

import pytest

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts or (doc_id, text[, lang, source]) rows, in two partitions."""
    def build(*rows, schema=SCHEMA):
        full = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (i, row)
            text = row[1]
            full.append((*row, *(("en", "a")[len(row) - 2:]), None if text is None else len(text)))
        return spark.createDataFrame(full, schema).repartition(2)
    return build


@pytest.fixture(scope="session")
def odd(docs):
    """NULLs in every column, empty and blank texts, a very long one, repeated and tied rows."""
    return docs((1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "Same text here"), (5, "Same text here"), (5, "Other text"),
                (None, "Same text here"), (None, None, None, None), (6, "x" * 200_000), (7, "é 中 \U0001f600 word", None, "b"),
                (8, LONG, "de", None))


@pytest.fixture
def clashing(docs):
    """A table whose extra columns have the names of results and of inner columns."""
    from pyspark.sql import functions as F
    names = ["host", "path", "rule", "verdict", "h", "fp", "component_id", "size", "taken", "copies", "slot", "shard", "kept",
             "n_words", "spans", "words", "place", "hash", "line", "key", "at", "item_ids", "containments", "lang_pred", "score",
             "_row", "_host", "_text", "_mark", "_doc", "_of", "_part", "_piece", "target", "law", "near", "gone", "th", "no"]
    frame = docs((1, "one two three four five six " * 12), (2, "one two three four five six " * 12), (3, None))
    return frame.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture
def rng():
    return random.Random(7)
