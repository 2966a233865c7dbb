import random

import pytest

WORDS = [f"w{i}" for i in range(40)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): nulls, empty and short texts, exact and near copies, shared passages, long texts, upper case."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(60, 160))) for i in range(40)]
    passage, line = prose(rng, 70), prose(rng, 12)
    for i in range(40, 60):
        rows.append((i, " ".join([prose(rng, rng.randrange(0, 40)), passage, prose(rng, rng.randrange(0, 40))]).strip()))
    for i in range(60, 75):
        rows.append((i, rows[0][1]))
    for i in range(75, 95):
        w = rows[1][1].split()
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w) if i % 2 else " ".join(w).upper()))
    for i in range(95, 105):
        rows.append((i, "\n".join([line] * rng.randrange(1, 8))))
    rows += [(105, None), (106, ""), (107, " \t\n "), (108, "one"), (109, "one"), (110, "two  words\x1f\x85 x"), (111, prose(rng, 6000)), (112, rows[40][1] + "  " + passage), (113, passage), (114, "w1 " * 300), (115, "ünï 日本 " * 40)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t) if t is not None else None, "x", 1) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, n long").cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
