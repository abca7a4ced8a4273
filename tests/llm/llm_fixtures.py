"""Fixtures of the operators' tests (not a conftest.py, whose name the top one has)."""
import random
import string

import pytest
from pyspark.sql import functions as F

SF001 = "/root/testdata/sf0.001"
WORDS = ["the", "and", "Über", "naïve", "x1", "end.", "it's", "漢字", "a", "Of", "###", "|", "!!"]


def texts(n, seed=0, most=40):
    """Random texts of words, tabs and lines, with nulls, empties and repeats."""
    rng = random.Random(seed)
    out = [None, "", " ", "\n\n", "same text here again", "same text here again"]
    while len(out) < n:
        out.append("".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(0, most))))
    return out


@pytest.fixture(scope="session")
def messy(spark):
    """(doc_id, text, lang, source, n_chars) with nulls in every column, repeated
    rows and ids, a very long text, and columns whose names the operators use."""
    rows = []
    for i, t in enumerate(texts(120)):
        rows.append((i, t, None if i % 11 == 0 else "en", None if i % 7 == 0 else f"src{i % 4}", len(t or ""), "k", i))
    rows += [rows[20]] * 3 + [(None, "no id at all", None, None, None, None, None)] * 2
    rows.append((500, "word salad. " * 60000, "en", "src0", 720000, "k", 1))
    rows.append((30, "another text under an id that is taken", "en", "src1", 38, "k", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "kept string, size long").cache()


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where(F.lit(False))


def random_words(rng, n, vocabulary=400):
    return [rng.choice(string.ascii_lowercase) + str(rng.randrange(vocabulary)) for _ in range(n)]
