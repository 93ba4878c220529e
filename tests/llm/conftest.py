import numpy as np
import pytest

WORDS = [a + b for a in "ba de ki lo mu na po ri sa te".split() for b in "n r s th x y z".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, size=n))


@pytest.fixture(scope="session")
def texts():
    """Texts with every case: null, empty, blank, short, long, copies, near copies, shared passages, odd letters."""
    rng = np.random.default_rng(11)
    made = [prose(rng, int(n)) for n in rng.integers(60, 220, size=24)]
    shared = prose(rng, 130)
    near = made[0].split()
    near[7] = "changed"
    made += [made[0], made[0], " ".join(near), made[1] + " " + shared, shared + "\n" + made[2], shared + made[3]]
    made += [shared * 2, "ab" * 900, "x" * 1000, prose(rng, 3000), "Ünï çödé ÄÖ " * 60, "one two", "Single"]
    made += [made[4] + "\n" + "same line here\n" * 30, "a b c " * 80, "#$%& " * 70]
    return [None, "", " \n\t ", *made]


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The texts under ids with a null, a repeated row, and extra columns named like results."""
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", None][i % 4], i) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[6], "en", None, 0)]
    schema = "doc_id bigint, text string, lang string, source string, N_WORDS bigint"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def rows(documents):
    return [tuple(r) for r in documents.collect()]


@pytest.fixture(scope="session")
def empty(documents):
    return documents.where("doc_id < -1")
