import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts: ids from 1, or (id, text[, source]) tuples."""

    def of(rows, partitions=3):
        full = []
        for i, r in enumerate(rows, 1):
            doc, text, *rest = r if isinstance(r, tuple) else (i, r)
            full.append((doc, text, "en", rest[0] if rest else f"s{i % 4}", len(text or "")))
        df = spark.createDataFrame(full, SCHEMA)
        return df.repartition(partitions) if rows else df

    return of


@pytest.fixture(scope="session")
def words():
    """Invented words of a seeded generator."""
    rng = random.Random(7)
    parts = "ba re ti on ar th en ou lo mi sa ku".split()
    pool = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(900)]

    def of(n, seed):
        r = random.Random(seed)
        return r.choices(pool, k=n)

    return of
