"""Small document tables with nulls, empty and long texts, copies and clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, shard int, bucket int, row string"


def make_docs(seed=7, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgiou") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = [text(rng.randint(1, 160)) for _ in range(n)]
    shared = text(90)
    texts += [shared + " " + text(30), text(20) + " " + shared, text(10) + " " + shared + " " + text(5)]
    base = text(120).split()
    for k in range(8):
        own = base.copy()
        for _ in range(k):
            own[rng.randrange(len(own))] = "edit" + str(rng.randrange(99))
        texts.append(" ".join(own))
    texts += [texts[0], texts[0].upper(), texts[1], None, None, "", " \t\n", "one", "a b c d", "a b c d", "x" * 3000, "ab" * 900, "Ünïcödé ß 漢字 " * 40, text(5000)]
    rows = [(i, t, "en", "src", None, None, "n", None, 3, "r") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, text(12), None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
