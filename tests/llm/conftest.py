import pytest

AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "Short."),
    (5, "one two three four five six seven eight"),
    (6, "One  two three\nfour five six seven eight"),
    (7, "one two three four five six seven eight"),
    (8, "word " * 30_000),
    (9, "!!! ... 123"),
    (10, "ünïcödé 漢字 \U0001f600 İstanbul <|endoftext|> don't"),
    (11, "All rights reserved.\nReleased under the MIT License.\n\nAll rights reserved."),
    (11, "All rights reserved.\nReleased under the MIT License.\n\nAll rights reserved."),
    (None, "A row without an id, of nine plain words."),
    (9_007_199_254_740_993, "½ ² 5"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, blank and very long texts, ties and repeated rows, clashing extra columns."""
    rows = [(d, x, 5, "s", None) for d, x in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, score string, root string")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
