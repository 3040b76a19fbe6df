"""Documents for the corpus operators: the smallest table, and a table of edge cases."""

from __future__ import annotations

import random
from collections import Counter

import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row long, key long, text_sha256 string"


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def edges(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(5)
    words = ["ab", "Cd", "efg", "h", "iß", "Ω", "klmno"]
    long = " ".join(rng.choice(words) + str(rng.randrange(300)) for _ in range(9000))
    near = " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(200))
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "two words", "Two  Words", "twowords", long, long, long + " end", near,
             near + " tail", near.upper() + " tail", "x" * 5000, "x" * 399, "x" * 400, "z" * 400, "é" * 300, "same", "same", "<|endoftext|> a"]
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else "a/b", None, True, k, 7, "zz") for k, t in enumerate(texts)]
    rows += [rows[-2], (None, "same", None, None, None, None, None, None, None), (None, near, None, None, None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("edges") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """A function that holds a corpus query to its SQL over the smallest tables."""
    import duckdb

    from tidemark.llm.queries import oracle_sql, queries
    from tidemark.session import ship_package

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")

    def check(name: str) -> None:
        ship_package(spark)
        want, got = duck.sql(oracle_sql()[name]), queries()[name](spark, SMALL)
        assert sorted(got.columns) == sorted(want.columns)
        order = sorted(want.columns)
        assert Counter(tuple(r) for r in got.select(order).collect()) == Counter(want.select(*order).fetchall())

    return check
