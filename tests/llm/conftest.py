import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, SHARD string, slot string, token_ids string, fp string, copies string, signals string, audio string"


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and very long texts, ties, repeated rows, null keys, and columns whose names clash."""
    long = "lang ganz word, " * 40_000 + "é ñ 漢字 end"
    same = "one two three four five six seven eight nine ten " * 3
    texts = [None, "", " \t\n", "a", "hello world", "Hello  world", same, same, same.upper(), long, "漢字 かな\r\n\n x", "a b c", "A B C", "z\x0bw\x1fq", " x  y", "don't stop's '' ...", "a" * 5_000, "10 200 3000,5"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s1", "s2", None][i % 4], len(t or ""), "x", "y", "z", "t", "f", "c", "g", "a") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id", None, None, 5, *rows[0][5:]), (None, None, None, None, None, *rows[0][5:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
