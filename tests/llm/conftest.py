import random

import pytest

#: Null and empty texts, white space only, a long text, ties, copies that differ in white space, rows that repeat.
TEXTS = [
    None, "", " \t\n", "the quick brown fox jumps over the lazy dog near the river bank", "the quick  brown fox\njumps over the lazy dog near the river bank", "the quick brown fox jumps over the lazy dog near the river bend",
    "eins zwei drei", "l1 a\nl2 b\nl3 c\nl4 d\nl5 e\nl6 f\nl7 g\nl8 h\nl9 i\nl10 j", "head\nl1 a\nl2 b\nl3 c\nl4 d\nl5 e\nl6 f\nl7 g\nl8 h\nl9 i\nl10 j", "日本語のテキスト", "😀 emoji  and more space \n \n x", "12345 67890 !!",
]


def make(spark, rows, extra=True):
    """Documents with columns whose names clash with those that operators make."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    if not extra:
        return spark.createDataFrame(rows, kind)
    return spark.createDataFrame([(*r, 1, "x", 2.0, 3, "k") for r in rows], kind + ", size int, key string, score double, id int, kept_in string")


@pytest.fixture(scope="session")
def odd_rows():
    r = random.Random(4)
    long_ = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "x" * 30]) for _ in range(30_000))
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "a", "b"][i % 3], None if t is None else len(t)) for i, t in enumerate([*TEXTS, long_])]
    return [*rows, rows[3], (None, "some text without an id at all", "en", "a", 30), (40, "the quick brown fox jumps over the lazy dog near the river bank", None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows)


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])
