"""Small documents for the operators: invented prose with copies, near copies, shared passages and odd rows."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, copy string, block string, kept string"


def _prose(rng, n, letters):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(120)]
    return [rng.choice(words) for _ in range(n)]


def make_rows():
    rng = random.Random(11)
    rows = []

    def add(doc_id, text, lang="en", source="s0"):
        rows.append((doc_id, text, lang, source, None if text is None else len(text), "own", "own", "own", "own"))

    passage = _prose(rng, 70, "etaoinshr")
    base = _prose(rng, 200, "etaoinshrdlu")
    for k in range(0, 40):  # plain documents of two languages
        letters = "etaoinshrdlu" if k % 2 else "äßüvwzkgchmfy"
        words = _prose(rng, rng.randint(5, 260), letters)
        if k % 5 == 0:
            words[3:3] = passage  # a shared passage
        add(k, ("\n" if k % 7 == 0 else " ").join(words).capitalize(), "en" if k % 2 else "de", f"s{k % 3}")
    for k in range(40, 60):  # near copies of one text
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = "changed" + str(k)
        add(k, " ".join(words), "en", "s0")
    for k in range(60, 70):  # exact copies
        add(k, " ".join(base), "en", "s0")
    add(70, None)
    add(71, "")
    add(72, " \t\n ", None, None)
    add(73, "word", None, "s9")
    add(74, "Aa bB cc\x00dd é日本 \x85\x1c end", "de", None)
    add(75, "x" * 3000, "en", "s1")
    add(76, "abc abc " * 400, "en", "s1")
    add(77, "1234 5678 ... !!!", "en", "s1")
    add(None, " ".join(passage), "en", "s2")
    add(None, " ".join(passage), "en", "s2")
    add(78, " ".join(passage), "en", "s2")
    add(78, " ".join(passage), "en", "s2")  # a repeated row
    add(79, " ".join(_prose(rng, 5000, "etaoinshrdlu")), "en", "s2")
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


NULL_ID = 2**63 - 1


def order_id(row):
    return NULL_ID if row[0] is None else row[0]
