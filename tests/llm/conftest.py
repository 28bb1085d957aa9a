from __future__ import annotations

import pytest

CLASHING = "id key w n l r block bucket digest text_sha256 size copies component kept part rank y score grams".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
PASSAGE = "the quick brown fox jumps over the lazy dog and then it runs far away into the dark green forest"


def rows_of(pairs):
    return [(i, t, None, f"s{(i or 0) % 3}" if i != 4 else None, None, *("x" for _ in CLASHING)) for i, t in pairs]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, short and very long texts, ties, repeated rows, accents and further columns."""
    pairs = [
        (1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a"), (5, "a"), (6, LONG), (7, LONG + " tail"), (8, "ÄÖ ü\u00a0ß \u2003x 🙂 e\u0301\x1c!"),
        (9, PASSAGE), (10, PASSAGE.upper()), (11, PASSAGE + " again"), (None, PASSAGE), (None, None), (12, "go\n\ngo\n go\ngo"), (13, "<|endoftext|> it's"),
    ]
    return spark.createDataFrame(rows_of(pairs), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
