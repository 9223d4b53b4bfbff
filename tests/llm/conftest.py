import pytest

WEIRD = [
    None, "", " ", "\n\n", "a", "The quick brown fox, the QUICK fox.", "x" * 30_000, "  \t" * 500 + "end", "é ß ÑCO!! 北京 😀🤦🏼‍♂️",
    "say <|endoftext|> and <|startoftext|>", "ΑΣ İ ﬁ", "of " * 3_000, "12 3½ 99.9", "don't I'LL we'Ve", "\x00\x01", "١٢٣ 𐥀",
]


@pytest.fixture(scope="session")
def weird(spark):
    """Nulls in any column, empty and long texts, repeated rows, and extra columns
    with names that the operators use inside."""
    rows = [(i, t, "en" if i % 3 else None, i) for i, t in enumerate(WEIRD)]
    rows += [(5, WEIRD[5], "en", 1), (5, WEIRD[5], "en", 1), (None, "no id here", None, None), (7, "other text of the same id", "de", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids long").coalesce(2)


@pytest.fixture(scope="session")
def nothing(weird):
    return weird.limit(0)
