import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size long, label string, band int, of_doc string, _doc long, _id long, _key string, _words int, found string, removed int, items map<string,int>"
MORE = ("r", "k", 1, "l", 1, "o", 7, 7, "k", 3, "f", 2, {"a": 1})


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """Small documents with copies, near copies, shared passages, blanks, nulls, odd characters and repeated rows."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "delta,", "été", "ж", "x1", "tok-en", "zeta.", "eta"]) + rng.choice(["", "", "s", "ing", str(rng.randint(0, 99))])
    passage = " ".join(word() for _ in range(60))
    texts = []
    for k in range(n):
        kind = k % 6
        if kind == 0 or not texts:
            words = [word() for _ in range(rng.randint(1, 90))]
        elif kind == 1:
            words = rng.choice(texts).split(" ")
        elif kind == 2:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = word()
        elif kind == 3:
            at = rng.randint(0, 10)
            words = [word() for _ in range(at)] + [passage] + [word() for _ in range(rng.randint(0, 30))]
        elif kind == 4:
            words = passage.split(" ")[rng.randint(0, 30) :] + [word() for _ in range(5)]
        else:
            words = [word() for _ in range(rng.randint(10, 40))]
        texts.append(" ".join(words).replace(" beta", rng.choice(["\nbeta", "\t beta", " beta"])))
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    rows += [(2, None), (5, ""), (8, " \n\t "), (11, "one"), (14, "One two"), (17, texts[0] + " " + " ".join(word() for _ in range(3000))), (20, "日本 語 🙂"), rows[4], rows[9], (rows[5][0], "another text under the same id " * 5)]
    return [(i, t, "en", f"s{j % 3}" if j % 7 else None, len(t or ""), *MORE) for j, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def with_null_id(spark, rows):
    return spark.createDataFrame([*rows, (None, rows[0][1], "en", "s0", 1, *MORE), (None,) * (5 + len(MORE))], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
