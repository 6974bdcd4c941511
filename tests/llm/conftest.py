import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n int, row string, score string, component string, block int, spans string, b long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, other planes, clashing columns."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    long_text = " ".join(rng.choice(words) for _ in range(40_000))
    some = " ".join(rng.choice(words) for _ in range(60))
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, some), (5, some), (5, some), (6, some + " last"), (7, long_text), (8, long_text + " end"),
             (9, "😀 it's 'x' é ß\x1c"), (None, some), (None, None), (10, "one"), (11, "ONE"), (12, "a" * 50_000)]
    return spark.createDataFrame([(i, t, None if k % 3 else "aa", None if k % 4 else f"s{k}", None, k, k, "r", "s", "c", 1, "x", 2) for k, (i, t) in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def prose(spark):
    """300 short texts with copies, edits and shared lines."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    hot = " ".join(rng.choice(words) for _ in range(55))
    rows = []
    for k in range(300):
        kind = k % 6
        if kind == 0 or k < 12:
            text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 70))) for _ in range(rng.randint(1, 4)))
        elif kind == 1:
            text = rng.choice(rows)[1]
        elif kind == 5:
            text = rng.choice(rows)[1] + "\n" + hot
        else:  # up to five words changed
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(1, 5)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        rows.append((k * 3 + 1, text))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")
