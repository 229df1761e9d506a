import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, start int, c long"


def make_texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta,", "épée", "straße", "x1", "42", "don't", "end."] + [f"w{i}" for i in range(120)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(60)
    near = base.split()
    near[30] = "changed"
    return [None, "", "  \n\t ", "one", base, base, " ".join(near), say(25) + "\n" + base[:180] + "\n" + say(30), "ab " * 40, say(40) + "\n" + say(10) + "\n\n" + say(8), "<|endoftext|> tab\there  two   spaces\r\nÀ la", "日本語 テスト　x", say(3000), "é" * 60 + say(5), "y" + "é" * 60, say(30).upper()]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Distinct ids, with nulls, empty, repeated, near and long texts, and columns of clashing names."""
    rows = [(3 * i, t, None if i % 4 == 0 else "en", "s", None if i % 3 == 0 else len(t or ""), 7, "k", 1, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def odd(spark, docs):
    """The same with a row twice, an id with another text, and null ids."""
    more = [(12, "another text of its own, with some words in it", "en", "s", 3, 1, "k", 1, 1), (None, "no id " * 9, "en", "s", 3, 1, "k", 1, 1), (None, None, None, None, None, None, None, None, None)]
    return docs.unionByName(docs.where("doc_id = 15")).unionByName(spark.createDataFrame(more, COLUMNS))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
