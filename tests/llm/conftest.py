import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Small documents with copies, near copies, shared passages, odd white space, nulls and empty texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "the", "ré", "ß", "ou", "ing", "日", "st", "er"]) for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.choice([1, 4, 5, 30, 120, 300]))] for _ in range(60)]
    passage = " ".join(word() for _ in range(30))
    out = []
    for i, words in enumerate(base):
        out.append(" ".join(words))
        if i % 3 == 0:
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            out.append(" ".join(near).upper() if i % 2 else " ".join(near))
        if i % 5 == 0:
            out.append(" ".join(words[: len(words) // 2]) + " " + passage + " " + " ".join(words[len(words) // 2 :]))
        if i % 7 == 0:
            out.append(" ".join(words))
    out += [None, "", " ", "\n \t\n", "a", "a  b\n\n c \x85 d", "x" * 49, "x" * 50, "x" * 400, "For For " * 80, passage, passage[3:]]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With repeated rows and an extra column whose name clashes with the operators' own."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or ""), "extra") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, failed string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
