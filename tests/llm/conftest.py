from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    parts = ["an", "er", "th", "ing", "ou", "re", "é", "ß", "st", "tion"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    """Near and exact copies, shared passages, ties, null, empty, blank, short and long texts."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(12)]
    passage = prose(rng, 40)
    out: list[str | None] = [None, "", " ", "a", "a b", "A  b", "\n\t", "日本語 テキスト", "x" * 3000]
    for i in range(50):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        out.append(" ".join(words) + (f"\n{passage}" if i % 5 == 0 else ""))
    out += [base[0], base[0], base[1], prose(rng, 6000)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts under sparse ids, one row twice, dealt over several partitions."""
    rows = [(7 * i - 20, t, "en", "src0", None) for i, t in enumerate(texts)]
    rows.append(rows[30])
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(spark):
    """Extra columns with the names that operators use for their own ones."""
    rows = [(1, "one two three four five", "x", 1, "k"), (2, None, None, None, None), (None, "six", "z", 3, "")]
    names = "doc_id long, text string, _found string, _score int, _windows string"
    return spark.createDataFrame(rows, names)
