from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def make():
    """A maker of prose: the same for the same seed."""

    def prose(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + (r.choice(["", "", "", ",", "."])) for _ in range(n))

    return prose


@pytest.fixture(scope="session")
def odd_documents(spark, make):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with names that operators use."""
    rows = [
        (1, make(1, 60)), (2, make(1, 60)), (3, None), (4, ""), (None, make(2, 40)), (5, make(3, 60_000)), (6, " \n\t "), (7, "one"), (7, "one"), (8, make(4, 300)), (9, "ÄÖ é ß 中文 😀 ​ x"), (10, "\n\n  two  spaces \n"), (11, "."), (12, make(1, 60) + " more"),
    ]
    schema = "doc_id long, text string, part int, n long, ids binary, score double, signature string, size string, of_doc long, stood_for_0 long"
    return spark.createDataFrame([(i, t, k, None if k % 2 else k, b"x", None, "s", "z", 1, 2) for k, (i, t) in enumerate(rows)], schema)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def tokenizers_dir():
    public = pytest.importorskip("public_tokenizers")
    return public.path
