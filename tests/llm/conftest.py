import random

import pytest

#: Extra columns whose names the operators use inside.
CLASHING = ["words", "lines", "doc", "node", "h", "s0", "n", "tok", "z", "runs", "row", "part", "token", "features",
            "score", "gone", "rid", "spans", "entries", "tie"]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          + ", ".join(f"{c} string" for c in CLASHING))


def rows_of(pairs, lang="en", source="src0"):
    return [(i, t, lang, source, None if t is None else len(t), *(None if k % 2 else "x" for k, _ in enumerate(CLASHING)))
            for i, t in pairs]


def prose(rng, n, words=None):
    words = words or WORDS
    out = [rng.choice(words) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(out))


_rng = random.Random(1)
WORDS = ["".join(_rng.choice("etaoinshrdlucmé") for _ in range(_rng.randrange(1, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, blanks, a long text, ties, repeated rows and ids, clashing column names."""
    rng = random.Random(2)
    a = prose(rng, 120)
    pairs = [(1, a), (2, None), (3, ""), (4, " \n\t "), (5, prose(rng, 20000)), (6, a), (7, a), (7, a), (8, prose(rng, 80)),
             (8, prose(rng, 90)), (None, a), (9, "x" * 5000), (10, "one"), (11, "Two  words"), (12, a + " tail"),
             (13, "日本語 \x00 😀 ▁a\n\nb | c | d | e"), (14, "Of " * 300)]
    return spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
