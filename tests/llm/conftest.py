import random

import pytest

#: Texts that every operator has to bear: null, empty, blank, one word, odd spaces, astral, long, repeated.
ODD = [None, "", " \n\t ", "one", "Two  words", "\n\nA\n\nB\n", "naïve café 😀 日本 x", "a " * 3000, "same line here\n" * 9, "same line here\n" * 9]


def corpus(n: int = 120, seed: int = 5) -> list[tuple[int, str]]:
    """Invented documents with copies, near copies, shared passages and repeated lines."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    text = lambda k: "".join(w + draw.choice([" "] * 9 + ["\n", ".\n"]) for w in draw.choices(vocabulary, k=k)).strip()
    passage, docs = text(60), []
    for i in range(n):
        kind = draw.random()
        if kind < 0.15 and docs:
            docs.append(draw.choice(docs))
        elif kind < 0.3 and docs:
            words = draw.choice(docs).split(" ")
            words[draw.randrange(len(words))] = "changed"
            docs.append(" ".join(words))
        elif kind < 0.45:
            docs.append(text(30) + "\n" + passage + "\n" + text(20))
        else:
            docs.append(text(draw.randint(1, 200)))
    return list(enumerate(docs))


@pytest.fixture(scope="session")
def rows():
    docs = corpus()
    return docs + [(len(docs) + i, t) for i, t in enumerate(ODD)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The documents with the columns of the table, and one whose name clashes with results."""
    table = [(i, t, "en", None if i % 7 == 6 else f"src{i % 5}", None if t is None else len(t), "x") for i, t in rows]
    return spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_removed string").repartition(3)


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(i, int(len((t or "").split()) > 60), 0) for i, t in rows if i % 3] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def nulls(spark):
    """Rows without any value, and one id repeated."""
    return spark.createDataFrame([(None, None, None, None, None)] * 2 + [(7, "a b c d", "en", "s", 7)] * 2 + [(7, "other text", None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
