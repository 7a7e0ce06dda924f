import random

import pytest

ODD = [
    (1, "one two three four five six seven eight", "en", "s"),
    (2, None, "en", "s"),
    (3, "", None, None),
    (4, " \n\t\n", "de", "s"),
    (5, "one two three four five six seven eight", "en", None),
    (5, "one two three four five six seven eight", "en", None),
    (None, "a row without an id, but with some words", "fr", "t"),
    (None, None, None, None),
    (6, "word " * 30_000, "en", "s"),
    (7, "\x00\x01 ünï cødé 漢字 \U0001f600 <|endoftext|> #*$%&|<>", "de", "t"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, a long text, a repeated row, and further columns with names that operators use inside."""
    rows = [(*r, "x", 1, 2) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, h string, size int, component long")


@pytest.fixture(scope="session")
def no_rows(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def sentences(seed, n, vocabulary=400):
    """Text of random words, with lines and sentences."""
    r = random.Random(seed)
    words = ["".join(random.Random(1000 + k).choices("abcdefghijklmnopqrstuvwxyz", k=2 + k % 7)) for k in range(vocabulary)]
    out = []
    for k in range(n):
        w = r.choice(words)
        out.append(w + (".\n" if k % 23 == 22 else "." if k % 11 == 10 else ""))
    return " ".join(out).replace("\n ", "\n")
