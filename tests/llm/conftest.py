import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, part string, words string, "
          "n_words string, component string, score string")


def odd_rows():
    """Nulls, empty and blank texts, repeated rows and ids, ties, a long text; ids from 9000 on."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    base = " ".join(f"near{i}" for i in range(60))
    texts = [
        (9000, None), (9001, ""), (9002, " \n\t "), (9003, "one"), (9004, "One two three"), (9005, "one TWO three"),
        (9006, base), (9007, base), (9007, base), (None, base + " tail"), (9008, base.replace("near30", "far30")),
        (9009, long), (9010, long + " end"), (9011, "1234 5678 !!"), (9012, "a b " * 400), (None, None), (9013, "É é ​ x y"),
        (9014, "same id"), (9014, "same id, other text"), (9015, "9999 " * 50),
    ]
    return [(i, t, None if k % 2 else "en", "odd", len(t or ""), "id", "part", "words", "n", "c", "s") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows beside the smallest documents table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for c in ("id", "part", "words", "n_words", "component", "score"):
        docs = docs.withColumn(c, F.lit("clash"))
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    return docs.select(*odd.columns).unionByName(odd).cache()


@pytest.fixture(scope="session")
def odd_texts(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]


@pytest.fixture()
def empty(odd):
    return odd.limit(0)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)
