import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()),
                       T.StructField("h", T.StringType()), T.StructField("id", T.StringType())])


def prose(rng, n):
    """Words over a small made-up syllable set, a sentence mark now and then."""
    parts = ["the", "on", "er", "lor", "mi", "tan", "é", "ü", "qua", "ver"]
    out = []
    for _ in range(n):
        word = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        out.append(word + rng.choice(["", "", "", "", ".", ","]) + rng.choice([" ", " ", " ", " ", " ", "\n"]))
    return "".join(out).strip()


def corpus():
    """Rows (doc_id, text, lang, source, ...) with nulls, blanks, copies, near copies, shared passages, ties, long texts."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    rows = []
    for i in range(120):
        text = prose(rng, rng.randint(1, 150))
        if i % 7 == 0:
            text += "\n" + passage + "\n" + prose(rng, 20)
        if i % 11 == 0 and i:
            text = rows[i - 3][1] or ""
        if i % 13 == 0 and i:
            text = (rows[i - 5][1] or "").replace(" the ", "  the\t", 1)
        rows.append((i, text, rng.choice(["en", "de", None]), f"s{i % 4}" if i % 9 else None))
    rows += [(200, None, "en", "s0"), (201, "", "en", "s0"), (202, " \t\n", None, None), (203, "word", "de", "s1"),
             (204, "a b", "de", "s1"), (205, "x" * 5000, "de", "s1"), (206, "same " * 900, "en", "s2"),
             (207, prose(rng, 6000), "en", "s2"), (208, "<|endoftext|> a <|endoftext|>b     c\U0001f600d'll", "en", "s3"),
             (209, "\x00\x01 \x85 it's  we're   12345  §§ -- \r\n end", "en", "s3")]
    return [(*r, len(r[1] or ""), "k", "h", "i") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Repeated rows, one id on different texts, null ids."""
    again = rows[:40] + rows[:10] + [(3, "another text with this id", "en", "s1", 0, "k", "h", "i")] * 2
    again += [(None, r[1], None, None, None, None, None, None) for r in rows[:4]]
    return spark.createDataFrame(again, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
