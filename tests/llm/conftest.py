import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (id, text), with columns whose names clash with those the operators use inside."""

    def make(rows):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit(1) for c in ("_key", "_text", "_h", "_id", "score", "shard", "size", "n_words", "kept", "k", "id", "component")})

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented words, in order of a seed."""

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(["ka", "to", "ri", "mu", "se", "lo", "ne", "vi"]) for _ in range(rng.randint(2, 4))) for _ in range(n))

    return make
