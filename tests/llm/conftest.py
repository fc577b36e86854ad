import random

import pytest
from pyspark.sql import types as T

#: Extra columns whose names the operators use inside or put out.
CLASHING = ("_doc", "_row", "id", "text_key", "print", "copies", "score", "n_lines", "ids", "_lang", "doc", "kmers", "sealed0", "rank", "confidence", "_key")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in CLASHING]
)


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def rows() -> list[tuple]:
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, words(2, 90) + " " + " ".join(base.split()[10:75]), "en", None), (5, None, "en", "a"), (6, "", None, "a"),
        (7, "  \t\n \x0b\f\r ", "de", "b"), (8, "one", "de", "b"), (None, words(3, 30), "en", "a"), (None, words(4, 30), "en", "b"), (9, words(5, 20_000), "en", "a"), (10, "Ünïcode 漢字 🎉 ▁ ▁x\r\nzeile", "de", "c"),
        (11, base, "en", "a"), (11, base, "en", "a"), (11, words(6, 80), "en", "a"), (12, "12345 !!! ---", "en", "c"), (13, "one two three four", "en", "c"), (14, "one two three four", "en", "c"),
    ]
    texts += [(100 + i, f"Shared LINE here \n{words(50 + i, 12)}\nshared line here", "en", "hot") for i in range(12)]
    texts += [(200 + i, f"shared LINE here\n{words(80 + i, 12)}", "de", f"s{i % 3}") for i in range(3)]
    return [(i, t, lang, s, None if t is None else len(t), *CLASHING) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def raw():
    return rows()
