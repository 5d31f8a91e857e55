import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi"]


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in each column, empty and very long texts, copies, near copies, repeated rows,
    and extra columns whose names clash with the operators' own."""
    base = sentence(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, base.upper(), "fr", "b"),
        (5, sentence(2, 80), "en", "a"), (6, "", "en", "a"), (7, None, "en", None), (8, " \n\t ", None, "a"),
        (9, "one two three", "en", "c"), (10, "One TWO three", "en", "c"), (11, "one two", "en", "c"),
        (12, sentence(3, 30_000), "en", "a"), (13, "x" * 200_000, "de", "c"), (5, sentence(2, 80), "en", "a"),
        (None, base, "en", "a"), (14, "line one two\nline one two\nother\n\nline one two", "en", "a"),
        (15, "a b c d e " * 30, "en", "spam"), (16, "é ü ñ 中文 \u3000 # $ %", "es", "spam"),
    ]
    rows = [(*r, len(r[1] or ""), 0, 0, "k", None, 7) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "id int, sid int, host string, spans string, shard int")


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
