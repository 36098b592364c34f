import pytest

TEXTS = [
    None,
    "",
    " \n\t",
    "one two",
    "one two",
    "The quick brown fox jumps over the lazy dog again and again, it's <|endoftext|> é ß İ 日本語 12 ½.",
    "x" * 5000,
    " ".join(f"word{i % 700}" for i in range(6000)),
    " ".join(f"word{i % 700}" for i in range(6000)) + " tail",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, blank and long texts, repeated rows and keys, names that clash with the operators' own."""
    data = [(i if i else None, t, None if i % 3 == 0 else "en", None if i % 2 else "s", i, "c", "k") for i, t in enumerate(TEXTS)]
    data += [data[3], data[-1]]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n long, `row` string, `key` string")
