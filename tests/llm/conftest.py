import pytest

FOLDER = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed=0):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture
def documents(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and extra columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _scan string, score double, k binary, `a.b` int"
    body, long = prose(60, 1), prose(20_000, 2)
    rows = [
        (1, body), (2, body), (2, body), (3, None), (4, ""), (None, body), (None, None), (5, " \n\t"), (6, long),
        (7, prose(60, 3) + " x"), (8, prose(60, 3) + " y"), (9, "one two"), (10, "ONE two"), (11, "." * 3000),
    ]
    full = [(i, t, "en" if i else None, None, len(t or ""), "s", 0.5, b"k", 1) for i, t in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture
def nothing(documents):
    return documents.limit(0)
