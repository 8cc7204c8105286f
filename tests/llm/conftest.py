import pytest

LONG = " ".join(f"word{i % 997} tail{i}" for i in range(30_000))
BASE = "The quick brown fox jumps over the lazy dog while nine small birds watch from an old fence near the river bank today"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [
        (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, BASE.upper() + " again", "en", None, 1),
        (4, None, "en", "b", None), (5, "", None, "", 0), (None, BASE, None, None, 1), (6, "  \t\n ", "en", "c", 1), (7, "un deux", "fr", "é", 1),
        (8, LONG, None, "b", 1), (9, "é\U0001F600 1234 \x00 token = 'abcdef123456' </s>", "fr", "\U0001F600", 1), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies int").selectExpr(
        "*", "1 as size", "2 as target", "'x' as id", "3 as component", "4 as draw", "5 as rank", "0.5 as score", "true as kept")


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
