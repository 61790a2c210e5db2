import random

import pytest
from pyspark.sql import functions as F

WORDS = ["".join(random.Random(k).choices("abcdefghijklmnop", k=3 + k % 6)) for k in range(600)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component string, band string, line string, kept string, n string, high string, registers string"


def prose(seed, n, per_line=12):
    rng = random.Random(seed)
    words = [rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + per_line]) for k in range(0, n, per_line))


def edited(text, seed, n):
    rng = random.Random(seed)
    words = text.split(" ")
    for k in rng.sample(range(len(words)), n):
        words[k] = rng.choice(WORDS)
    return " ".join(words)


def edge_texts():
    """(doc_id, text): nulls, empty and blank texts, ties, repeated rows, groups of copies and near copies, a long text."""
    base, other = prose(1, 150), prose(2, 120)
    rows = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "One"), (5, "a b c"), (6, base), (7, base), (7, base), (8, base.upper()), (9, other)]
    rows += [(10 + k, edited(base, k, 2)) for k in range(12)]
    rows += [(30 + k, prose(100 + k, 60 + 7 * k)) for k in range(15)]
    rows += [(50, other + "\n" + base), (51, prose(3, 9000)), (52, "ab " * 400), (53, "x" * 5000), (54, "é ü 漢字 🎉 " * 30), (55, "\n\n".join([base.split("\n")[0]] * 3))]
    rows += [(60 + k, prose(400, 45) + "\n" + prose(500 + k, 40)) for k in range(6)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return edge_texts()


@pytest.fixture(scope="session")
def documents(spark, rows):
    """The edge texts with columns whose names operators might use themselves."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["z"] * 8) for i, t in rows], SCHEMA.replace("score double", "score string"))
    return df.repartition(3, F.xxhash64("text"))


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
