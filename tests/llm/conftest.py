import pytest

CLASH = ["keep_id", "_key", "_data", "lang_pred", "score", "_content", "_digest", "_keep", "_copies", "size", "ids", "_node", "_row_digest", "kept"]
SENTENCE = "the quick brown fox jumps over the lazy dog and runs into the dark forest until the night falls over all of it "


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty, blank and very long texts, ties, repeated rows, and names that clash."""
    long = (SENTENCE * 900 + "x" * 40_000 + " " + SENTENCE * 300)
    rows = [
        (1, "Le chat est sur la table.", "fr", "b"), (2, None, "en", "a"), (3, "", "en", None), (4, " \n\t ", None, "a"),
        (5, long, "en", "a"), (6, "five words are in here", "en", "b"), (7, "five  words\nare in\there", "en", "b"),
        (7, "five  words\nare in\there", "en", "b"), (None, "a text without a key", None, None), (None, "a text without a key", None, None),
        (8, SENTENCE * 3, "en", "b"), (9, SENTENCE * 3 + "end", "en", "b"), (10, "12 34 !!", "de", "c"), (11, "Straße <|endoftext|> ☃ \\ </s>", "de", "c"),
    ]
    return spark.createDataFrame([(*r, *([1] * len(CLASH))) for r in rows],
                                 "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} long" for c in CLASH))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
