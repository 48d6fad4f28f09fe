import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "Thing other " * 30_000


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of (id, text) with the columns of the table; a text may be given its source."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


#: Nulls, empty, blank and long texts, ties and repeated rows.
ODD = [(1, None), (None, "a b c d"), (2, ""), (2, ""), (3, "   \n\t "), (4, LONG), (5, "same words here now"), (5, "same words here now"), (6, "same words here now"), (None, None), (7, "!!! ??? ***"), (8, "日本語のテキスト é\u0000 😀")]
CLASHING = ["h", "n", "score", "toxic", "copies", "of", "epochs", "band", "label", "new", "gone", "len", "sketch", "round", "quantum", "key", "slot", "start", "value", "c0", "c1", "media", "id", "new_text", "n_tokens"]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(*ODD)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select(*(F.lit("x").alias(c) for c in CLASHING), "*")
