import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (id, text[, lang, source]) tuples."""

    def make(rows):
        full = [(*r, *("en", "s0")[len(r) - 2 :])[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DOCS)

    return make


@pytest.fixture
def words():
    """Pseudo-random words: ``words(seed, n)`` gives a text of n words."""
    import random

    def text(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))

    return text
