import random

import pytest

#: Columns with names that operators use inside; none may get in the way.
CLASH = "n long, key string, c long, rep long, digest string, w string, toxic_ string, score double"


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def make_rows():
    """(doc_id, text, lang, source): repeats, near copies, shared passages, odd texts, nulls."""
    rows, passage = [], words("passage", 70, 10**6)
    for k in range(60):
        body = words(k, 40 + 7 * k, 10**6)
        if k % 3 == 0:
            body[10:10] = passage
        if k % 10 == 7:
            body = words(k - 1, 40 + 7 * (k - 1), 10**6)
            body[5] = "changed"
        rows.append((k, " ".join(body), "en" if k % 2 else "fr", f"s{k % 4}"))
    rows += [(200 + k, rows[12][1], "en", "s0") for k in range(12)]
    rows += [
        (300, None, None, None),
        (301, "", "en", "s1"),
        (302, "   \n\t ", "en", "s1"),
        (303, "one two", "en", "s1"),
        (304, " ".join(words("long", 20_000, 50)), "en", "s1"),
        (305, "a " * 300, "en", "s1"),
        (None, rows[12][1], "en", "s1"),
        (306, "x\x0by\x1cz é ü 日本語 \U0001f600", "fr", "s2"),
        (12, rows[12][1], "fr", "s0"),
        (5, "another text with the same doc_id", "en", "s1"),
    ]
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
    extra = (1, "k", 2, 3, "d", "w", "t", 0.5)
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in doc_rows], schema).repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
