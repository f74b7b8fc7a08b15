from __future__ import annotations

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "component_id long, digest long, mark long, places string, rep long, score double, kept boolean, law string")


def passage(rng, n):
    return " ".join(rng.choice(("the", "of", "and")) if rng.random() < 0.3 else f"w{rng.randrange(100000)}" for _ in range(n))


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(5)
    shared = passage(rng, 60)
    base = passage(rng, 300)
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "a row without id"), (None, None), (4, "one"), (5, "one"), (6, "One"),
            (7, "two words"), (8, passage(rng, 30000)), (9, "é\x85ü x \x0b y\x1cz"), (10, "naïve <|endoftext|> text 'll 123  45\n\n x")]
    rows += [(20 + k, base) for k in range(6)] + [(20, base), (21, base)]
    for k in range(30):
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((40 + k, " ".join(w)))
    rows += [(100 + k, passage(rng, 20 + k) + "\n" + shared + "\n" + passage(rng, 20)) for k in range(12)]
    rows += [(200, passage(rng, 40)), (200, passage(rng, 80)), (201, "x " * 400), (202, "x " * 200)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(d, t, None, "s" if d else None, None if t is None else len(t), 1, 2, 3, "p", 4, 0.5, True, "l") for d, t in edge_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
