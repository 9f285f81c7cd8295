import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, a bigint, rate string, __text string, copies string"
_WORDS = [f"w{k}" for k in range(400)]


def corpus(seed=1, size=60):
    """Rows with exact and near copies, shared passages and lines, nulls in any column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    passage = " ".join(rng.choices(_WORDS, k=70))
    texts = []
    for k in range(size):
        base = [" ".join(rng.choices(_WORDS, k=rng.randint(1, 60))) for _ in range(rng.randint(1, 4))]
        if k % 5 == 0:
            base.insert(rng.randrange(len(base) + 1), passage)
        if k % 3 == 0:
            base.append("Subscribe to our list")
        texts.append("\n".join(base))
    for k in range(0, 20, 2):
        texts.append(texts[k])
        words = texts[k + 1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", " \t\r\n", "\n\n", "...", "x", " ".join(rng.choices(_WORDS, k=60_000)), ("long line " * 20_000).strip(), passage, "a\x00b é \U0001f600"]
    rows = [(k, t, "en", "web" if k % 3 else "books", len(t or ""), "k", k, "r", "t", "c") for k, t in enumerate(texts)]
    rows += [rows[3], rows[7], (None, texts[1], None, None, None, None, None, None, None, None), (None, None, "en", "web", 0, "k", 1, "r", "t", "c"), (rows[5][0], "another text of one id", "en", None, 1, "k", 1, "r", "t", "c")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
