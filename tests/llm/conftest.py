import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    parts = ["the", "of", "an", "er", "tion", "ou", "é", "ß", "ing", "st"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts by id: prose, exact and near copies, a shared passage, repeats in one text, empty and odd ones."""
    rng = random.Random(5)
    out = {i: prose(rng, rng.randint(30, 200)) for i in range(40)}
    passage = prose(rng, 90)
    for i in range(40, 60):
        out[i] = f"{prose(rng, rng.randint(5, 60))} {passage} {prose(rng, rng.randint(5, 60))}"
    base = prose(rng, 150).split(" ")
    for i in range(60, 80):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        out[i] = " ".join(words)
    out |= {80: out[3], 81: out[3], 82: out[41].upper(), 83: "", 84: None, 85: " \t\n", 86: "word", 87: "word", 88: "a b", 89: "a " * 400, 90: "x" * 2000, 91: "x" * 399, 92: "Hello  world\n a", 93: "▁ é€😀"}
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and columns whose names operators might use themselves."""
    rows = [(None, "some words of a text without id", 1.0, "x", 7, b"k"), (1, "one two three four five six seven", 1.0, "x", 7, None), (1, "one two three four five six seven", 1.0, "x", 7, None), (2, None, None, None, None, None), (3, "one two three four five six seven", 0.5, None, 1, b"")]
    rows = [(i, t, "en", "s", 0, *rest) for i, t, *rest in rows]
    return spark.createDataFrame(rows, SCHEMA + ", score double, key string, id long, k binary")
