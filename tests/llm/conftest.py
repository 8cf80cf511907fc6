"""Small tables for the operators of cohortspark.llm."""

import random

import pytest


def near_copies(seed=7, n=40, size=160):
    """Documents of a hot group of near copies, copies inside one text, shared passages and edge cases."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(size)]
    shared = [r.choice(vocabulary) for _ in range(70)]
    docs = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(size)] = r.choice(vocabulary)
        docs.append((i, " ".join(w)))
    for i in range(n, 2 * n):
        own = [r.choice(vocabulary) for _ in range(r.randrange(5, 90))]
        at = r.randrange(len(own))
        docs.append((i, r.choice([" ", "\n", "\t"]).join(own[:at] + shared + own[at:])))
    docs += [(2 * n, None), (2 * n + 1, ""), (2 * n + 2, "one"), (2 * n + 3, " ".join(["again"] * 300)),
             (2 * n + 4, " ".join(shared + ["x"] + shared)), (2 * n + 5, "é" * 500 + " ü " + "é" * 500),
             (2 * n + 6, docs[3][1]), (2 * n + 7, "One  two\x0bthree\n\nfour FIVE"), (2 * n + 8, "one two three four five")]
    return docs


@pytest.fixture(scope="session")
def planted():
    return near_copies()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text) as documents with further columns, one of them named as operators name theirs."""
    def make(docs):
        return spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in docs],
                                     "doc_id bigint, text string, lang string, source string, n_chars bigint, id string").repartition(3)
    return make
