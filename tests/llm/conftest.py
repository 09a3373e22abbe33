import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls long, h long, bucket int, n long, size long, target double, rank int, t string, key string"

BASE = " ".join(f"word{i} thing{i % 7}" for i in range(60))
NEAR = BASE.replace("word3 ", "other3 ")
LONG = " ".join(f"Long{i % 977} text{i % 13}," for i in range(12_000))


def rows():
    """Nulls, empty and very long texts, exact and near copies, repeated rows, odd characters."""
    texts = [
        (1, BASE, "a"), (2, BASE, "a"), (3, NEAR, "b"), (4, None, "b"), (5, "", None), (6, "   \n\t ", "c"), (7, LONG, "a"), (None, "no id here", "c"), (9, "ein zwei drei", None),
        (10, "Tschüß Ǆ é́ \U0001f600 日本", "ä"), (1, "the id again with another text", "a"), (9, "ein zwei drei", None), (12, "a  b c\x1cd <|endoftext|> it's", "c"), (13, BASE.upper(), "b"), (14, "x", None),
    ]
    return [(i, t, "en", s, None if t is None else len(t), 1, 2, 3, 4, 5, 6.0, 7, "t", "k") for i, t, s in texts]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
