import pytest

WORDS = "the of and to in a is that for it river stone cloud market letter window garden engine paper mountain silver quiet harbor winter signal copper meadow lantern".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(50)) if r.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Documents of all sorts: copies, near copies, short, empty, null, very long, repeated ids."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    far = " ".join(w if i % 6 else "other" for i, w in enumerate(words))
    return [(1, base), (2, base.upper()), (3, near), (4, far), (5, "one two"), (6, "one\ttwo"), (7, ""), (8, None), (9, "   \n"), (10, prose(2, 20_000)), (11, prose(3, 50)), (12, base + " " + prose(4, 10)), (13, prose(5, 400)), (13, prose(5, 400)), (None, base)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The documents, with columns whose names clash with those of operators."""
    rows = [(i, t, "en", None if i == 3 else "src1", len(t) if t else None, "x", 7, "s") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, n int, sid string").cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")
