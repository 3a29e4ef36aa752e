import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LINE = "this line of boilerplate is found in very many documents of the crawl"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix strong potions near a bridge"


@pytest.fixture(scope="session")
def odd_rows():
    """(id, text) with nulls, ties, repeats and long texts."""
    near = " ".join(f"w{i}" for i in range(400))
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, PROSE),
        (5, PROSE),
        (5, PROSE),
        (None, PROSE),
        (None, None),
        (6, near),
        (7, near.replace("w7 ", "W7\t")),
        (8, near.replace("w200 ", "other ")),
        (9, "Aé " * 3000),
        (10, "one two"),
        (11, f"{LINE}\nfirst own line\n\n  {LINE.upper()} \n"),
        (19, "x" * 5000),
    ]
    rows += [(20 + i, f"{LINE}\nown text number {i} of this document\n{PROSE} {i}") for i in range(7)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows as documents with columns whose names clash with added ones."""
    rows = [(i, t, None, "s" if i and i % 2 else None, 1, "clash", 2.5) for i, t in odd_rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, fp double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
