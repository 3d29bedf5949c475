import random

import pytest

WORDS = [f"{a}{b}" for a in ("lor", "ipsu", "dolo", "sit", "ame", "con", "adip", "eli") for b in
         ("em", "ra", "no", "ti", "va", "ste", "bli", "ko", "da", "fu")]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and long texts, repeated rows, equal texts, letters of all kinds."""
    rng = random.Random(5)
    base = prose(rng, 300)
    words = base.split(" ")
    near = " ".join(words[:150] + ["anders"] + words[151:])
    long = prose(rng, 30_000)
    lines = "\n".join(prose(rng, 12) for _ in range(8))
    return [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, long), (7, lines),
        (8, lines.split("\n")[2] + "\n" + prose(rng, 40)), (9, "  \t "), (9, "  \t "),
        (10, "Ärger ÜBER Ö\u0000 🙂 ..."), (11, "a b c"), (12, "A B C!"), (None, base), (13, near),
        (14, base + " " + near), (15, "x" * 2000), (16, prose(rng, 80)), (16, prose(rng, 80)),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Extra columns carry names the operators use inside."""
    rows = [(i, t, f"s{k}", k, "x", None) for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, id string, size int, n_lines string, score double"
    ).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
